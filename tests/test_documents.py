import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import documents, evaluation, retrieval, routing

POLICY = """# Leave Policy

**Owner:** People Team

## Entitlement

Staff get **18 days** a year.

## Empty

## Carry-forward  
Up to 5 laptops or days.
"""


def test_title_and_sections(spark):
    df = spark.createDataFrame([(1, POLICY), (2, "no heading at all\n"), (3, "## Only\nbody"), (4, "   \n")], "doc_id long, body string")
    rows = documents.sections(df).orderBy("doc_id", "section_no").collect()
    assert [(r.doc_id, r.doc_title, r.section) for r in rows] == [
        (1, "Leave Policy", "Overview"), (1, "Leave Policy", "Entitlement"), (1, "Leave Policy", "Carry-forward"),
        (2, "Untitled Policy", "Overview"), (3, "Untitled Policy", "Only")]
    assert rows[1].section_text == "Staff get **18 days** a year." and rows[2].section_text == "Up to 5 laptops or days."


@pytest.mark.parametrize(("body", "want"), [
    ("", []),
    ("short", ["short"]),
    ("aaaa bbbb cccc dddd", ["aaaa bbbb", "bbbb cccc", "cccc dddd"]),
    ("a\n\nb", ["a\n\nb"]),
    ("one two\n\nthree four five", ["one two", "three", "four five"]),
    ("abcdefghijklmno", ["abcdefghij", "fghijklmno"]),
    ("xx. yyyyyyyyyyyy", ["xx", ". yyyyyyyy", "yyyyyyyyy"]),
])
def test_splitting_rules(body, want):
    got = documents.split_text(body, 10, 5)
    assert all(len(c) <= 10 for c in got)
    if body != "xx. yyyyyyyyyyyy":
        assert got == want


def test_chunk_properties(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdef"), rng.integers(1, 12))) for _ in range(3000)]
    breaks = rng.choice([" ", ". ", "\n", "\n\n"], 3000, p=[0.8, 0.1, 0.07, 0.03])
    body = "".join(w + b for w, b in zip(words, breaks)) + "".join(rng.choice(list("ghijklmnop"), 1200))
    df = spark.createDataFrame([(1, body)], "doc_id long, section_text string")
    got = [r.chunk_text for r in documents.chunks(df).orderBy("chunk_no").collect()]
    assert all(0 < len(c) <= 500 for c in got)
    at, covered = 0, 0
    for c in got:  # chunks appear in order, each starting no later than the end of the last, apart from blanks
        start = body.index(c, max(at, 0))
        assert body[covered:start].strip() in ("", ".") and covered - start <= 60
        at, covered = start + 1, start + len(c)
    assert body[covered:].strip() == ""


def test_significant_words(spark):
    df = spark.createDataFrame([("What policies does the LAPTOPS team's glass bus have? café naïve pass",)], "t string")
    got = set(df.select(text.significant_words(F.col("t"))).first()[0])
    assert got == {"laptop", "glas", "pass"}


def test_lexical_gate_passes_without_words(spark):
    df = spark.createDataFrame([([], ["a"]), (["a"], ["a"]), (["b"], ["a"])], "q array<string>, p array<string>")
    assert [r[0] for r in df.select(text.lexically_grounded(F.col("q"), F.col("p"))).collect()] == [True, True, False]


def brute(queries, corpus, k, metric):
    rows = []
    for q, v in queries.items():
        if metric == "dot":
            order = sorted((-round(float(v @ c), 9) + 0.0, i) for i, c in corpus.items())
        else:
            order = sorted((round(float(((v - c) ** 2).sum()), 9) + 0.0, i) for i, c in corpus.items())
        rows += [(q, i, n + 1) for n, (_, i) in enumerate(order[:k])]
    return sorted(rows)


@pytest.mark.parametrize("metric", ["squared_l2", "dot"])
@pytest.mark.parametrize("limit", [1 << 22, 64])
def test_top_k_with_copies(spark, metric, limit):
    """A third of the corpus are exact copies; the smallest ids win among them, on both paths."""
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(300, 8)), 3)
    vectors[::3] = vectors[0]
    queries = {q: np.round(rng.normal(size=8), 3) for q in range(30)}
    queries[30] = vectors[0]
    corpus = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries.items()], "query_id long, query_vec array<double>")
    got = retrieval.top_k(q, corpus, 4, metric, query_values_limit=limit, shard_rows=70)
    assert sorted((r.query_id, r.chunk_id, r.rank) for r in got.collect()) == brute(queries, dict(enumerate(vectors)), 4, metric)


def test_top_k_smaller_corpus_and_no_queries(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, query_vec array<double>")
    assert [tuple(r) for r in retrieval.top_k(q, corpus, 4).collect()] == [(1, 1, 1, 2.0)]
    assert retrieval.top_k(q.where("query_id < 0"), corpus, 4).count() == 0


TEXTS = ["annual leave days for staff", "laptop loss must be reported in 24 hours", "password change every 90 days", "travel by flight", "", "leave leave leave"]


@pytest.mark.parametrize("limit", [1 << 22, 8])
def test_text_vectors(spark, limit):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, chunk_text string").repartition(3)
    model = retrieval.tfidf_pipeline(dims=1 << 18).fit(corpus)
    embedded = retrieval.embed(corpus, model)
    norms = {r.chunk_id: sum(x * x for x in r.embedding["values"]) for r in embedded.collect()}
    assert all(v == pytest.approx(1.0 if TEXTS[i] else 0.0) for i, v in norms.items())
    asked = spark.createDataFrame([(7, "report a lost laptop"), (8, "annual leave"), (9, "zzz")], "query_id long, question string")
    q = retrieval.embed(asked, model, "question", "query_vec")
    found = retrieval.top_k(q, embedded, 2, "unit_l2", query_values_limit=limit, shard_rows=2)
    vocabulary = sorted({w for t in TEXTS for w in t.split()})
    n = len(TEXTS)
    idf = {w: np.log((n + 1) / (sum(w in t.split() for t in TEXTS) + 1)) for w in vocabulary}

    def vector(t):
        v = np.array([t.split().count(w) * idf[w] for w in vocabulary])
        return v / np.linalg.norm(v) if v.any() else v

    got = {(r.query_id, r.rank): r for r in found.collect()}
    assert got[8, 1].chunk_id in (0, 5) and got[7, 1].chunk_id == 1
    expected = min(((vector("annual leave") - vector(t)) ** 2).sum() for t in TEXTS if t)
    assert got[9, 1].score == 2.0  # nothing in common with anything
    assert got[8, 1].score == pytest.approx(expected, abs=1e-8)


def test_answers(spark):
    passages = spark.createDataFrame(
        [(1, "Leave Policy", "Entitlement", " 18 days of leave "), (2, "Leave Policy", "Carry", "five days"), (3, "IT", "Loss", "laptop"), (4, "IT", "Old", "none")],
        "chunk_id long, doc_title string, section string, chunk_text string")
    questions = spark.createDataFrame([(1, "How much leave?"), (2, "weather forecast"), (3, "leave"), (4, "leave")], "query_id long, question string")
    matches = spark.createDataFrame(
        [(q, c, r, s) for q, far in ((1, 0.0), (2, 0.0), (3, 0.3)) for c, r, s in ((1, 1, 0.8 + far), (2, 2, 0.9 + far), (3, 3, 1.0 + far), (4, 4, 1.01 + far))],
        "query_id long, chunk_id long, rank int, score double")
    rows = {r.query_id: r for r in retrieval.answer_questions(questions, matches, passages).collect()}
    assert rows[1].grounded and rows[1].citations == ["Leave Policy > Entitlement", "Leave Policy > Carry", "IT > Loss", "IT > Old"]
    quoted = "\n**Leave Policy > Entitlement**\n18 days of leave\n\n**Leave Policy > Carry**\nfive days\n\n**IT > Loss**\nlaptop\n"
    assert rows[1].answer == retrieval.ANSWER_HEAD + quoted
    for q in (2, 3, 4):  # no shared word; too far; nothing retrieved
        assert not rows[q].grounded and rows[q].citations == [] and rows[q].answer == retrieval.NOT_FOUND


def test_note_answers(spark):
    notes = spark.createDataFrame([(1, "Head", "AAPL", "2026-06-02", "Body")], "note_id long, headline string, ticker string, date string, text string")
    questions = spark.createDataFrame([(1,), (2,)], "query_id long")
    matches = spark.createDataFrame([(1, 1, 1, 0.3), (2, 1, 1, 0.2999)], "query_id long, note_id long, rank int, score double")
    rows = {r.query_id: r for r in retrieval.answer_from_notes(questions, matches, notes).collect()}
    assert rows[1].grounded and rows[1].citations == ["[1] Head"]
    assert rows[1].answer == retrieval.NOTE_HEAD + "\n**[1] Head** (AAPL, 2026-06-02, similarity=0.30)\nBody\n\n" + retrieval.NOTE_TAIL
    assert not rows[2].grounded and rows[2].answer == retrieval.NOTE_NOT_FOUND


def test_router_order(spark):
    countries = spark.createDataFrame([("Singapore",), ("Malaysia",)], "country string")
    asked = [
        ("Is cust000123 at risk in Singapore?", routing.CUSTOMER_TOOL, "CUST000123"), ("revenue in singapore and malaysia", routing.COUNTRY_TOOL, "Malaysia"),
        ("weather in Singapore", None, None), ("What is the top driver?", routing.DRIVER_TOOL, None),
        ("how accurate is the leave model", routing.DRIVER_TOOL, None), ("a pipe burst", routing.POLICY_TOOL, "a pipe burst"),
        ("CUST0001234 hello", None, None), ("hello", None, None)]
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(asked)], "question_id long, question string")
    got = routing.route_questions(df, countries).orderBy("question_id").collect()
    assert [(r.question, r.tool, r.tool_input) for r in got] == asked
    assert [r.handled for r in got] == [t is not None for _, t, _ in asked]


def test_router_with_more_names_than_a_task_holds(spark):
    countries = spark.createDataFrame([(f"Land{i}x",) for i in range(500)] + [(None,)], "country string")
    df = spark.createDataFrame([(1, "sales in land77x and LAND5X"), (2, "sales in land"), (3, None)], "question_id long, question string")
    for limit in (0, 1 << 20):
        got = {r.question_id: r.tool_input for r in routing.route_questions(df, countries, term_chars=limit).collect()}
        assert got == {1: "Land5x", 2: None, 3: None}


def test_compound_questions(spark):
    asked = spark.createDataFrame(
        [(1, "Is cust000001 at risk, what drives sales in Singapore, a top driver, and how much leave?"), (2, "leave and revenue in Malaysia"), (3, "hi"), (4, "risk of CUST999999 and main driver")],
        "question_id long, question string")
    routed = routing.all_routes(asked, spark.createDataFrame([("Singapore",), ("Malaysia",)], "country string"))
    calls = {r.question_id: [c.tool for c in r.calls] for r in routed.collect()}
    order = [routing.CUSTOMER_TOOL, routing.COUNTRY_TOOL, routing.DRIVER_TOOL, routing.POLICY_TOOL]
    assert calls == {1: order, 2: [order[1], order[3]], 3: [], 4: [order[0], order[2]]}
    scored = spark.createDataFrame(
        [("CUST000001", "Singapore", "S", 0.125, "Low", 10, 2, 1.5, 100)],
        "customer_id string, country string, segment string, churn_probability double, churn_risk_band string, recency_days int, frequency long, monetary_sgd double, tenure_days int")
    importance = spark.createDataFrame([("f", 0.5)], "feature string, importance double")
    metrics = spark.createDataFrame([(0.7, 0.8)], "accuracy double, roc_auc double")
    policy = spark.createDataFrame([(1, "18 days", True, ["Leave"]), (2, "none", False, [])], "question_id long, answer string, grounded boolean, citations array<string>")
    rows = {r.question_id: r for r in routing.dispatch_all(routed, scored, importance, metrics, policy).collect()}
    assert [c.tool for c in rows[1].tool_calls] == order and rows[1].handled
    parts = rows[1].answer.split("\n\n")
    assert [p.split(" ")[0] for p in parts] == ["Customer", "Singapore:", "Top", "18"]
    assert rows[2].answer == "No data for country 'Malaysia'. Valid markets: Singapore.\n\nnone"
    assert rows[3].tool_calls == [] and rows[3].answer == routing.NOT_HANDLED and not rows[3].handled
    assert "error" in rows[4].tool_calls[0].output and rows[4].answer.startswith("No customer found")


def test_retrieval_scoring(spark):
    expected = spark.createDataFrame(
        [(1, "a", ["18"], True), (2, "b", ["x"], True), (3, None, [], True), (4, None, [], False), (5, None, [], False)],
        "query_id long, expected_source string, expected_keywords array<string>, in_scope boolean")
    actual = spark.createDataFrame(
        [(1, ["z", "a"], "18 Days", True, 0.51234), (2, ["z"], "nothing", True, 0.9), (3, ["z"], "", False, 1.2), (4, [], "", False, None), (5, [], "", True, 1.0)],
        "query_id long, sources array<string>, answer string, grounded boolean, best_distance double")
    judged = evaluation.judge_retrieval(expected, actual)
    flags = {r.query_id: (r.retrieval_hit, r.keyword_hit, r.hallucination_flag) for r in judged.collect()}
    assert flags == {1: (True, True, False), 2: (False, False, True), 3: (None, None, False), 4: (None, None, False), 5: (None, None, True)}
    s = evaluation.retrieval_summary(judged).first()
    assert (s.retrieval_accuracy, s.keyword_grounding_accuracy, s.correct_refusal_rate, s.hallucination_flags) == (pytest.approx(1 / 3), pytest.approx(1 / 3), 0.5, 2)
    empty = evaluation.retrieval_summary(judged.where("in_scope")).first()
    assert empty.correct_refusal_rate == 0.0


def test_routing_scoring(spark):
    expected = spark.createDataFrame(
        [(1, "hr_it", ["a"], ["18"], None), (2, "compound", ["a", "b"], [], None), (3, "out_of_scope", [], [], None), (4, "x", ["b", "a"], ["p", "q"], ["band"])],
        "question_id long, category string, expected_tools array<string>, must_contain array<string>, must_not_contain array<string>")
    actual = spark.createDataFrame(
        [(1, ["a"], "18 days", True), (2, ["a"], "", True), (3, [], "", False), (4, ["a", "b", "a"], "only P, risk Band", True)],
        "question_id long, tools_called array<string>, answer string, handled boolean")
    judged = evaluation.judge_routing(expected, actual)
    assert {r.question_id: (r.routing_correct, r.keyword_hit, r.hallucination_flag) for r in judged.collect()} == {
        1: (True, True, False), 2: (False, None, False), 3: (True, None, False), 4: (True, False, True)}
    s = evaluation.routing_summary(judged).first()
    assert (s.routing_accuracy, s.keyword_grounding_accuracy, s.correct_refusal_rate, s.compound_full_success_rate, s.hallucination_flags) == (0.75, 0.5, 1.0, 0.0, 1)


def test_dispatch_trace(spark):
    routed = routing.route_questions(
        spark.createDataFrame([(1, "risk of CUST000001"), (2, "risk of CUST999999"), (3, "sales in Singapore"), (4, "main driver"), (5, "leave days"), (6, "hi")], "question_id long, question string"),
        spark.createDataFrame([("Singapore",)], "country string"))
    scored = spark.createDataFrame(
        [("CUST000001", "Singapore", "S", 0.125, "Low", 10, 2, 12345678.5, 100)],
        "customer_id string, country string, segment string, churn_probability double, churn_risk_band string, recency_days int, frequency long, monetary_sgd double, tenure_days int")
    importance = spark.createDataFrame([(f"f{i}", i / 10) for i in range(7)], "feature string, importance double")
    metrics = spark.createDataFrame([(0.7446, 0.7769)], "accuracy double, roc_auc double")
    policy = spark.createDataFrame([(5, "18 days", True, ["Leave"])], "question_id long, answer string, grounded boolean, citations array<string>")
    rows = {r.question_id: r for r in routing.dispatch(routed, scored, importance, metrics, policy).collect()}
    assert rows[1].answer == ("Customer CUST000001 (Singapore, S segment): churn probability 12%, risk band Low. "
                              "Recency 10 days, frequency 2, monetary SGD 12345678.5, tenure 100 days.")
    assert rows[2].answer == "No customer found with ID 'CUST999999'." and "error" in rows[2].tool_calls[0].output
    assert rows[3].answer == "Singapore: 1 customers, average churn probability 12%, 0 high-risk, total revenue SGD 12,345,678.50."
    assert rows[4].answer == "Top churn drivers: f6 (60%), f5 (50%), f4 (40%), f3 (30%), f2 (20%). Model accuracy 74.5%, ROC-AUC 0.78."
    assert rows[5].answer == "18 days" and rows[5].tool_calls[0].input == {"question": "leave days"}
    assert rows[6].tool_calls == [] and rows[6].answer == routing.NOT_HANDLED
