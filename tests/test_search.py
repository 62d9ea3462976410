"""Hash-table search, posting lists and term dictionaries against plain versions."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import lsh, postings, retrieval, routing, terms


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (12, 16))
    x = centres[rng.integers(0, 12, 600)] + rng.normal(0, 0.4, (600, 16))
    x[100:300] = x[99]  # a hot bucket of copies
    return x


def rows(spark, x, names, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{names[0]} long, {names[1]} array<double>").repartition(3)


@pytest.mark.parametrize("limit, piece", [(1 << 20, 20_000), (0, 20_000), (0, 16)])
def test_hash_tables_against_plain_version(spark, vectors, limit, piece):
    hashing = lsh.Hashing(16, 5, 3)
    queries = vectors[::40] + 0.01
    planes = np.array([[[lsh.plane_weight(t, b, p) for p in range(16)] for b in range(3)] for t in range(5)])
    sides = lambda x: (np.einsum("tbp,p->tb", planes, x) > 0)
    code = lambda x: [tuple(r) for r in sides(x)]
    held = [code(x) for x in vectors]
    want = set()
    for q, v in enumerate(queries):
        met = [i for i in range(len(vectors)) if any(a == b for a, b in zip(code(v), held[i]))]
        best = sorted((round(float(((vectors[i] - v) ** 2).sum()), 9), i) for i in met)[:4]
        want |= {(1000 + q, i, r + 1, s) for r, (s, i) in enumerate(best)}
    corpus = rows(spark, vectors, ("chunk_id", "embedding")).union(spark.createDataFrame([(9999, None)], "chunk_id long, embedding array<double>"))
    found = lsh.lsh_top_k(rows(spark, queries, ("query_id", "query_vec"), 1000), corpus, hashing, query_values_limit=limit, piece_rows=piece).collect()
    assert {(r[0], r[1], r[2]) for r in found} == {w[:3] for w in want} and len(found) == len(want)
    assert all(abs(r["score"] - s) < 1e-8 for r in found for q, i, n, s in want if (r[0], r[2]) == (q, n))


def test_fitted_tables_reach_the_recall(spark, vectors):
    corpus = rows(spark, vectors[300:], ("chunk_id", "embedding"))
    queries = rows(spark, vectors[300::7], ("query_id", "query_vec"))
    hashing = lsh.fit_hashing(corpus)
    assert hashing.dims == 16 and hashing.bits > 1 and hashing.tables <= lsh.MOST_TABLES
    measured = lsh.recall(lsh.lsh_top_k(queries, corpus, hashing), retrieval.top_k(queries, corpus)).first()
    assert measured["queries"] == len(vectors[300::7]) and measured["recall"] >= 0.9
    assert lsh.lsh_top_k(queries.limit(0), corpus, hashing).count() == 0
    assert lsh.lsh_top_k(queries, corpus.limit(0), lsh.fit_hashing(corpus.limit(0))).count() == 0


def plain_search(passages, questions, k):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    n = len(passages)
    df = collections.Counter(w for _, t in passages for w in set(split(t)))
    weigh = lambda t: {w: c * math.log((n + 1) / (df[w] + 1)) for w, c in collections.Counter(split(t)).items()}
    out = {}
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    unit = {i: {w: x / (norm(weigh(t).values()) or 1) for w, x in weigh(t).items()} for i, t in passages}
    for q, t in questions:
        weights = weigh(t)
        known = {w: x for w, x in weights.items() if df[w] and x > 0}
        if not known:
            continue
        dots = {i: round(sum(x / norm(known.values()) * unit[i].get(w, 0) for w, x in known.items()), 9) for i, _ in passages}
        best = sorted((-d, i) for i, d in dots.items() if d > 0)[:k]
        out |= {(q, i, r + 1): 2 + 2 * d * norm(known.values()) / norm(weights.values()) for r, (d, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block, seeds", [(4096, 512), (3, 5)])
def test_postings_against_plain_search(spark, tmp_path, block, seeds):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(200)]
    line = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.03)), 199)] for _ in range(n))
    passages = [(i, "everywhere " + line(rng.randint(1, 60))) for i in range(150)]
    passages += [(1000 + i, passages[i % 3][1]) for i in range(30)] + [(2000, "everywhere " + "w1 " * 3000)]
    questions = [(i, line(rng.randint(1, 12)) + (" unheard of" if i % 3 else "")) for i in range(40)]
    questions += [(100 + i, f"template w3 W5, w150 number{i}") for i in range(20)] + [(200, "nothing known"), (201, ""), (202, None), (203, "everywhere")]
    index = postings.PostingIndex.build(spark.createDataFrame(passages, "chunk_id long, chunk_text string").repartition(3), str(tmp_path / "index"), block=block)
    asked = spark.createDataFrame(questions, "query_id long, question string")
    got = {(r[0], r[1], r[2]): r[3] for r in index.search(asked, 5, seed_postings=seeds).collect()}
    assert got == pytest.approx(plain_search(passages, questions, 5), abs=1e-8)
    if block == 3:
        assert index.read("levels").agg(F.max("pieces")).first()[0] > 1
    again = postings.PostingIndex(spark, str(tmp_path / "index"))  # opened, not built
    assert again.search(asked.where("query_id < 3"), 5).count() == len([g for g in got if g[0] < 3])


@pytest.mark.parametrize("limit", [terms.TERM_CHARS, 0])
def test_first_term_against_plain_version(spark, limit):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    dictionary = [(rng.randint(0, 5), f"r{i}", word(rng.randint(1, 7))) for i in range(300)] + [(None, "null first", "ab"), (0, "gone", None)]
    texts = [(i, word(rng.randint(0, 25)).upper() if i % 2 else word(rng.randint(0, 60))) for i in range(120)] + [(500, None), (501, ""), (502, "zzz"), (503, "ab " * 30_000)]
    texts += texts[:5]
    order = lambda r: [(x is not None, x) for x in r]
    for more in ([], [(9, "anywhere", "")]):
        want = []
        for i, t in texts:
            met = [r for r in dictionary + more if t is not None and r[2] is not None and r[2] in t.lower()]
            want.append((i, min(met, key=order)[1] if met else None))
        df = spark.createDataFrame(texts, "id long, question string").repartition(3)
        known = spark.createDataFrame(dictionary + more, "priority int, route string, term string")
        got = [(r["id"], r["route"]) for r in routing.term_routes(df, known, term_chars=limit).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert routing.term_routes(df, known.limit(0), term_chars=limit).where("route is not null").count() == 0


def test_a_large_dictionary_meets_parts_of_texts(spark, monkeypatch):
    """Long terms, terms that share their beginning and texts of several parts; a part gives each stretch once, and only if a term may have it."""
    monkeypatch.setattr(terms, "PART_CHARS", 2000)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdé😀") for _ in range(n))
    long = [word(200) for _ in range(4)]
    dictionary = [(rng.randint(0, 3), f"r{i}", t) for i, t in enumerate([*(word(rng.randint(3, 6)) for _ in range(60)), *long, *(x[:150] for x in long), long[0][:140] + "zz"])]
    texts = [(i, word(rng.randint(0, 40)) + (long[i % 4][: rng.choice((100, 140, 150, 200))] if i % 3 == 0 else "") + word(5)) for i in range(150)]
    known = spark.createDataFrame(dictionary, "priority int, route string, term string")
    want = {i: min((r for r in dictionary if r[2] in t), default=(None, None))[1] for i, t in texts}
    df = spark.createDataFrame(texts, "id long, question string")
    assert {r["id"]: r["route"] for r in routing.term_routes(df, known, term_chars=0).collect()} == want
    marked = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(500)], "piece long")
    bits, mask = terms._marks(marked)
    assert len(bits) * 8 == mask + 1 and 500 < sum(x.bit_count() for x in bits) <= 500 * terms.PROBES
    part = pa.table({"line": ["abcabcabc", "abc"]})
    shared = type("Held", (), {"value": b"\xff" * 8192})
    assert terms._hits([3], shared, (1 << 16) - 1)((pa.scalar(7),), part).num_rows == 3  # abc, bca, cab
    nothing = type("Held", (), {"value": bytes(8192)})
    assert terms._hits([3], nothing, (1 << 16) - 1)((pa.scalar(7),), part).num_rows == 0


def test_postings_of_repeated_ids_in_many_segments(spark, tmp_path):
    """Texts under one id are one passage, and neither segments nor turns change a result."""
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{min(int(rng.expovariate(0.05)), 99)}" for _ in range(n))
    texts = [(i % 70, line(rng.randint(1, 30))) for i in range(100)]
    asked = spark.createDataFrame([(i, line(rng.randint(1, 8))) for i in range(30)], "query_id long, question string")
    schema, found = "chunk_id long, chunk_text string", []
    for name, rows_, segment, turn in (("few", texts, 10_000, 10_000), ("many", texts[::-1], 40, 20)):
        index = postings.PostingIndex.build(spark.createDataFrame(rows_, schema).repartition(3), str(tmp_path / name), segment_postings=segment)
        found.append(sorted(map(tuple, index.search(asked, 5, asked_words=turn).collect())))
        held = index.read("lists").select("term", F.explode("postings").alias("p"))
        assert held.groupBy("term", "p.id").count().where("count > 1").isEmpty()
    assert index.read("lists").select("segment").distinct().count() > 5
    assert found[0] == found[1] and len(found[0]) > 100


def test_many_questions_share_an_answer(spark):
    """The passages of one answer are gathered once, not once per question."""
    passages = spark.createDataFrame([(1, "T", "s", "holiday words"), (2, "T", "s", "other")], "chunk_id long, doc_title string, section string, chunk_text string")
    asked = spark.createDataFrame([(i, "holiday rules" if i % 2 else "nothing alike") for i in range(40)], "query_id long, question string")
    matches = spark.createDataFrame([(i, c, r, 0.5) for i in range(39) for r, c in ((1, 1), (2, 2))], "query_id long, chunk_id long, rank int, score double")
    each, answers = retrieval.grounded_matches(asked, matches, passages)
    assert answers.count() == 1 and each.count() == 40
    got = {r["query_id"]: r for r in retrieval.answer_questions(asked, matches, passages).collect()}
    assert len(got) == 40 and [got[i]["grounded"] for i in (0, 1, 39)] == [False, True, False]
    assert "holiday words" in got[1]["answer"] and got[1]["citations"] == ["T > s", "T > s"] and got[0]["answer"] == got[39]["answer"] == retrieval.NOT_FOUND
    assert got[39]["best_distance"] is None and got[0]["best_distance"] == 0.5 and got[0]["citations"] == []


def test_scores_are_held_some_rows_at_a_time(monkeypatch):
    """Neither search holds all pairs of a batch, and the cuts change nothing."""
    rng = np.random.default_rng(1)
    x, q, sizes = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, (7, 4)), []
    monkeypatch.setattr(retrieval, "SCORES", 21)
    block = retrieval._Queries(np.arange(7), [list(v) for v in q], False, "squared_l2")
    plain = retrieval._Best(7, 3)
    plain.add(block.scores(pa.array([list(v) for v in x])), np.arange(50))
    best, add = retrieval._Best(7, 3), retrieval._Best.add
    monkeypatch.setattr(retrieval._Best, "add", lambda self, scores, ids: (sizes.append(scores.size), add(self, scores, ids))[1])
    best.scan(block, pa.array([list(v) for v in x]), np.arange(50))
    order = lambda b: [sorted(zip(s, i)) for s, i in b.kept]
    assert order(best) == order(plain) and max(sizes) <= 21
    monkeypatch.setattr(lsh, "PAIR_VALUES", 8)
    row, spot = np.repeat(np.arange(50), 7), np.tile(np.arange(7), 50)
    assert np.allclose(lsh._squared(x, row, q, spot), ((x[row] - q[spot]) ** 2).sum(axis=1), atol=1e-8)
