"""Sectioning, retrieval, grounding, routing and evaluation over the text tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import text, vectors
from tidemark.operators import documents, evaluation, lsh, ranking, retail, retrieval, routing
from tidemark.operators.postings import PostingIndex
from tidemark.plans import views
from tidemark.plans.registry import Registry, round_all, rounded
from tidemark.plans.views import with_views
from tidemark.session import materialize, shared_folder

R = Registry()


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


BOILERPLATE_SQL = "[" + ", ".join(f"regexp_replace('{w}', '{text.PLURAL}', '\\1')" for w in text.BOILERPLATE) + "]"


def words_sql(x: str) -> str:
    plain = f"list_transform(regexp_extract_all({x}, '[a-zA-Z]{{4,}}'), lambda w : CASE WHEN length(w) > 4 AND lower(w) LIKE '%s' THEN lower(w)[:-2] ELSE lower(w) END)"
    return f"list_filter(list_distinct({plain}), lambda w : NOT list_contains({BOILERPLATE_SQL}, w))"


def any_sql(x: str, terms) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


SORTED = "array_to_string(list_sort({}), ' ')"


@R.query("r1_document_title", with_views("markdown_v", f"""
SELECT doc_id, COALESCE(NULLIF({trim_sql("regexp_extract(body, '(?m)^#\\s+(.*)$', 1)")}, ''), 'Untitled Policy') AS doc_title FROM markdown_v"""))
def document_title(spark, d):
    return views.markdown(spark, d).select("doc_id", documents.document_title(F.col("body")).alias("doc_title"))


SECTIONS_SQL = f"""
SELECT doc_id, 'Doc ' || doc_id AS doc_title, CAST(i - 1 AS INTEGER) AS section_no,
  CASE WHEN i = 1 THEN 'Overview' ELSE {trim_sql("split_part(piece, chr(10), 1)")} END AS section,
  {trim_sql("CASE WHEN i = 1 THEN piece ELSE substr(piece, length(split_part(piece, chr(10), 1)) + 1) END")} AS section_text
FROM (SELECT doc_id, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece
      FROM (SELECT doc_id, regexp_split_to_array(body, '(?m)^##\\s+') AS pieces FROM markdown_v))"""


@R.query("r2_sections", with_views("markdown_v", "SELECT * FROM sections WHERE section_text <> ''", sections=SECTIONS_SQL))
def sections(spark, d):
    return documents.sections(views.markdown(spark, d))


@R.query("r3_chunks")
def chunks(spark, d):
    return documents.chunks(documents.sections(views.markdown(spark, d)))


@R.query("r3_chunk_bounds", with_views("markdown_v", """
SELECT doc_id, section_no, TRUE AS fits, TRUE AS starts, TRUE AS ends, CASE WHEN length(section_text) < 500 THEN section_text END AS only_chunk
FROM sections WHERE section_text <> ''""", sections=SECTIONS_SQL))
def chunk_bounds(spark, d):
    """Chunks fit the size, the first opens and the last closes its section, and a short section is one chunk."""
    whole = documents.sections(views.markdown(spark, d))
    pieces = documents.chunks(whole.withColumn("text", F.col("section_text")), "text")
    per_section = pieces.groupBy("doc_id", "section_no").agg(
        (F.max(F.length("chunk_text")) <= documents.CHUNK_SIZE).alias("fits"),
        F.max_by(F.startswith("section_text", "chunk_text"), -F.col("chunk_no")).alias("starts"),
        F.max_by(F.endswith("section_text", "chunk_text"), "chunk_no").alias("ends"),
        F.max(F.when(F.length("section_text") < documents.CHUNK_SIZE, F.col("chunk_text"))).alias("only_chunk"),
    )
    return per_section


def chunk_table(spark, d):
    """Chunks with a long id: their number in the order of document, section and chunk, for tables of any size."""
    return ranking.global_row_number(materialize(chunks(spark, d)), ["doc_id", "section_no", "chunk_no"], "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("long"))


@R.query("r4_tfidf_vectors")
def tfidf_vectors(spark, d):
    table = materialize(chunk_table(spark, d))
    model = retrieval.tfidf_pipeline().fit(table)
    vec = F.col("embedding.values")
    embedded = retrieval.embed(table, model)
    return embedded.select(
        "chunk_id", F.size("embedding.indices").alias("terms"), rounded(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x)).alias("squared_norm")
    )


def search_sql(asked: str) -> dict[str, str]:
    """CTEs that compare all documents with the questions (query_id, question) of ``asked`` by TF-IDF; ``found`` has the best four."""
    counted = "SELECT id, term, COUNT(*) AS tf FROM (SELECT {id} AS id, unnest(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM {table}) WHERE term <> '' GROUP BY id, term"
    return {
        "tf": counted.format(id="doc_id", text="text", table="documents"),
        "df": "SELECT term, COUNT(*) AS df FROM tf GROUP BY term",
        "size": "SELECT COUNT(*) AS n FROM documents",
        "doc_weights": """SELECT id, term, df, raw / sqrt(SUM(raw * raw) OVER (PARTITION BY id)) AS w
FROM (SELECT id, term, df, tf * ln((n + 1e0) / (df + 1)) AS raw FROM tf JOIN df USING (term), size) WHERE raw > 0""",
        "asked_tf": counted.format(id="query_id", text="question", table=asked),
        "asked_weights": """SELECT query_id, term, raw / sqrt(known) AS w, sqrt(known / whole) AS share FROM (
  SELECT *, SUM(raw * raw) OVER (PARTITION BY query_id) AS whole, SUM(CASE WHEN df IS NOT NULL THEN raw * raw END) OVER (PARTITION BY query_id) AS known
  FROM (SELECT id AS query_id, term, df, tf * ln((n + 1e0) / (COALESCE(df, 0) + 1)) AS raw FROM asked_tf LEFT JOIN df USING (term), size) WHERE raw > 0) WHERE df IS NOT NULL""",
        "found": """SELECT query_id, chunk_id, rank, ROUND(2 - 2 * dot * share, 9) AS score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY dot DESC, chunk_id) AS INTEGER) AS rank FROM (
    SELECT query_id, ANY_VALUE(share) AS share, d.id AS chunk_id, ROUND(SUM(q.w * d.w), 9) AS dot FROM asked_weights q JOIN doc_weights d USING (term) GROUP BY query_id, d.id)) WHERE rank <= 4""",
    }


def document_index(spark, d):
    """An index of whole documents, written to the shared folder, and the passages it was made from."""
    passages = views.table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("source").alias("section"), F.col("lang").alias("doc_title")
    )
    return PostingIndex.build(views.spread(passages, "chunk_id"), f"{shared_folder(spark).rstrip('/')}/tidemark-index-{uuid.uuid4().hex}"), passages


BENCHMARK_QUESTIONS = "SELECT item_id AS query_id, text AS question FROM benchmark"


@R.query("r4_index_search", with_views([], "SELECT query_id, chunk_id, rank, ROUND(score, 6) AS score FROM found", asked=BENCHMARK_QUESTIONS, **search_sql("asked")))
def index_search(spark, d):
    """Every benchmark passage asked of the persisted index of all documents."""
    questions = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return round_all(document_index(spark, d)[0].search(questions), "score")


@R.query("r4_index_lists", with_views([], """
SELECT term, COUNT(*) AS postings, ROUND(MAX(w), 6) AS max_weight, ROUND(SUM(w), 6) AS total_weight FROM doc_weights GROUP BY term""", **{k: v for k, v in search_sql("asked").items() if k in ("tf", "df", "size", "doc_weights")}))
def index_lists(spark, d):
    """What the index has written, list by list."""
    lists = document_index(spark, d)[0].read("lists").select("term", F.explode("postings").alias("p"))
    return lists.groupBy("term").agg(
        F.count(F.lit(1)).alias("postings"), rounded(F.max("p.weight")).alias("max_weight"), rounded(F.sum("p.weight")).alias("total_weight"))


TOPK_SQL = """
SELECT query_id, chunk_id, rank, score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER) AS rank FROM (
    SELECT query_id, vec_id AS chunk_id, ROUND(list_sum(list_transform(list_zip(embedding, query_vec), lambda p : pow(CAST(p[1] AS DOUBLE) - p[2], 2))), 9) AS score
    FROM {q}, {c})) WHERE rank <= 4"""
PASSAGE_VECTORS = "(SELECT chunk_id AS vec_id, embedding FROM passages_v)"
SIM_SQL = """
SELECT query_id, chunk_id, rank, score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (
    SELECT query_id, vec_id AS chunk_id, ROUND(list_sum(list_transform(list_zip(embedding, query_vec), lambda p : CAST(p[1] AS DOUBLE) * p[2])), 9) AS score
    FROM centroids_v, {c})) WHERE rank <= 3"""


def vector_corpus(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def label_matches(spark, d, **kw):
    return retrieval.top_k(views.centroids(spark, d), vector_corpus(spark, d), **kw)


@R.query("j5_vector_top_k", with_views("centroids_v", "SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, rank, ROUND(score, 6) AS score FROM m", m=TOPK_SQL.format(q="centroids_v", c="embeddings")))
def vector_top_k(spark, d):
    return round_all(label_matches(spark, d), "score")


@R.query("j5_vector_top_k_blocked", with_views("centroids_v", "SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, rank, ROUND(score, 6) AS score FROM m", m=TOPK_SQL.format(q="centroids_v", c="embeddings")))
def vector_top_k_blocked(spark, d):
    """The same search on the path for query sets beyond the broadcast limit."""
    return round_all(label_matches(spark, d, query_values_limit=256, shard_rows=200), "score")


# Every benchmark question, and every hundredth row of the table, by negative numbers.
LSH_QUERIES_SQL = """SELECT query_id, CAST(query_vec AS DOUBLE[]) AS query_vec FROM vector_questions_v
UNION ALL SELECT -1 - vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id % 100 = 0"""
HASHED_SQL = f"""
SELECT kind, id, t, SUM(CASE WHEN s > 0 THEN 1 << b ELSE 0 END) AS code FROM (
  SELECT kind, id, t, b, SUM(x * (CAST('0x' || substr(md5(t || ':' || b || ':' || pos), 1, 8) AS BIGINT) / 4294967296e0 - 0.5e0)) AS s
  FROM (SELECT kind, id, unnest(range(len(v))) AS pos, unnest(v) AS x FROM (
    SELECT 'q' AS kind, query_id AS id, query_vec AS v FROM asked UNION ALL SELECT 'c', vec_id, CAST(embedding AS DOUBLE[]) FROM embeddings)),
    range({lsh.TABLES}) AS a(t), range({lsh.BITS}) AS c(b)
  GROUP BY kind, id, t, b) GROUP BY kind, id, t"""
LSH_SQL = """
SELECT query_id, chunk_id, rank, ROUND(score, 6) AS score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS INTEGER) AS rank FROM (
    SELECT query_id, vec_id AS chunk_id, ROUND(list_sum(list_transform(list_zip(embedding, query_vec), lambda p : pow(CAST(p[1] AS DOUBLE) - p[2], 2))), 9) AS score
    FROM (SELECT DISTINCT q.id AS query_id, c.id AS vec_id FROM hashed q JOIN hashed c USING (t, code) WHERE q.kind = 'q' AND c.kind = 'c')
    JOIN asked USING (query_id) JOIN embeddings USING (vec_id))) WHERE rank <= 4"""


def with_hashing(body):
    return with_views("vector_questions_v", body, asked=LSH_QUERIES_SQL, hashed=HASHED_SQL)


def lsh_queries(spark, d):
    rows = views.table(spark, d, "embeddings").where(F.col("vec_id") % 100 == 0)
    asked = views.vector_questions(spark, d).select("query_id", "query_vec")
    return asked.unionByName(rows.select((-1 - F.col("vec_id")).alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec")))


def vector_width(corpus):
    """Numbers in a vector of the table."""
    return corpus.agg(F.max(F.size("embedding"))).first()[0] or 1


@R.query("j5_vector_lsh", with_hashing(LSH_SQL))
def vector_lsh(spark, d):
    """Hash tables of random projections: all benchmark questions and every hundredth row against all rows."""
    corpus = vector_corpus(spark, d)
    return round_all(lsh.lsh_top_k(lsh_queries(spark, d), corpus, lsh.Hashing(vector_width(corpus))), "score")


@R.query("j5_vector_lsh_buckets", with_hashing(LSH_SQL))
def vector_lsh_buckets(spark, d):
    """The same search with both sides dealt by bucket, as for more questions than can be shipped."""
    corpus = vector_corpus(spark, d)
    return round_all(lsh.lsh_top_k(lsh_queries(spark, d), corpus, lsh.Hashing(vector_width(corpus)), query_values_limit=0), "score")


@R.query("j5_vector_lsh_recall", with_views("vector_questions_v", "SELECT COUNT(*) AS queries, TRUE AS reached FROM asked", asked=LSH_QUERIES_SQL))
def vector_lsh_recall(spark, d):
    """Recall of the fitted tables against the exact search: nine tenths at least."""
    corpus, asked = vector_corpus(spark, d), lsh_queries(spark, d)
    found = lsh.lsh_top_k(asked, corpus, lsh.fit_hashing(corpus))
    return lsh.recall(found, retrieval.top_k(asked, corpus)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@R.query("t3_top_k_per_query", with_views("centroids_v", "SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, rank, ROUND(score, 6) AS score FROM m", m=SIM_SQL.format(c="embeddings")))
def top_k_per_query(spark, d):
    return round_all(label_matches(spark, d, k=retrieval.NOTE_TOP_K, metric="dot"), "score")


@R.query("t5_best_match", with_views("centroids_v", "SELECT CAST(query_id AS BIGINT) AS query_id, ROUND(MIN(score), 6) AS best FROM m GROUP BY query_id", m=TOPK_SQL.format(q="centroids_v", c="embeddings")))
def best_match(spark, d):
    return label_matches(spark, d).groupBy("query_id").agg(rounded(F.min("score")).alias("best"))


@R.query("r5_distance_gate", with_views("vector_questions_v", """
SELECT CAST(query_id AS BIGINT) AS query_id, ROUND(MIN(score), 6) AS best_score, MIN(score) <= 1.05 AS near FROM m GROUP BY query_id""", m=TOPK_SQL.format(q="vector_questions_v", c="embeddings")))
def distance_gate(spark, d):
    matches = retrieval.top_k(views.vector_questions(spark, d), vector_corpus(spark, d))
    return round_all(retrieval.distance_gate(matches), "best_score")


@R.query("r5_similarity_gate", with_views("centroids_v", """
SELECT CAST(query_id AS BIGINT) AS query_id, ROUND(MAX(score), 6) AS best_score, MAX(score) >= 0.3 AS near FROM m GROUP BY query_id""", m=SIM_SQL.format(c="embeddings")))
def similarity_gate(spark, d):
    return round_all(retrieval.distance_gate(label_matches(spark, d, k=3, metric="dot"), metric="dot"), "best_score")


@R.query("n13_text_functions", with_views("questions_v", """
SELECT question_id, lower(trim(question)) AS lower_text, upper('q' || CAST(question_id AS VARCHAR)) AS upper_key, contains(lower(question), 'tion') AS has_term, length(question) AS n,
       NULLIF(regexp_extract(question, '(?i)\\b(th[a-z]{4})\\b', 1), '') AS word FROM questions_v"""))
def text_functions(spark, d):
    q = F.col("question")
    return views.questions(spark, d).select(
        "question_id", F.lower(F.trim(q)).alias("lower_text"), F.upper(F.concat(F.lit("q"), F.col("question_id").cast("string"))).alias("upper_key"),
        text.contains_any(F.lower(q), ["tion"]).alias("has_term"),
        F.length(q).cast("long").alias("n"), F.nullif(F.regexp_extract(q, r"(?i)\b(th[a-z]{4})\b", 1), F.lit("")).alias("word"),
    )


@R.query("n13_customer_ids", with_views("typed_questions_v", r"""
SELECT question_id, NULLIF(upper(regexp_extract(question, '(?i)\b(CUST\d{6})\b', 1)), '') AS customer_id FROM typed_questions_v"""))
def customer_ids(spark, d):
    return views.typed_questions(spark, d).select("question_id", text.customer_id(F.col("question")).alias("customer_id"))


@R.query("n14_significant_words", f"SELECT doc_id, {SORTED.format(words_sql('text'))} AS words FROM documents")
def significant_words(spark, d):
    words = F.array_join(F.array_sort(text.significant_words(F.col("text"))), " ")
    return views.table(spark, d, "documents").select("doc_id", words.alias("words"))


TURN_PAIRS_SQL = """SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q
JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"""


def turn_pairs(spark, d):
    """Each user turn with the assistant turn that follows it."""
    turns = views.table(spark, d, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replied, ["conv_id", "turn"])


@R.query("u2_word_difference", with_views([], f"""
SELECT conv_id, turn, {SORTED.format(f"list_filter({words_sql('question')}, lambda w : NOT list_contains({words_sql('answer')}, w))")} AS only_asked FROM pairs""", pairs=TURN_PAIRS_SQL))
def word_difference(spark, d):
    gap = F.array_except(text.significant_words(F.col("question")), text.significant_words(F.col("answer")))
    return turn_pairs(spark, d).select("conv_id", "turn", F.array_join(F.array_sort(gap), " ").alias("only_asked"))


@R.query("u3_word_overlap", with_views([], f"""
SELECT conv_id, turn, list_has_any({words_sql('question')}, {words_sql('answer')}) AS shares_word FROM pairs""", pairs=TURN_PAIRS_SQL))
def word_overlap(spark, d):
    both = F.arrays_overlap(text.significant_words(F.col("question")), text.significant_words(F.col("answer")))
    return turn_pairs(spark, d).select("conv_id", "turn", both.alias("shares_word"))


@R.query("r6_lexical_gate", with_views([], f"""
SELECT conv_id, turn, len(qw) = 0 OR list_has_any(qw, aw) AS grounded FROM (SELECT *, {words_sql('question')} AS qw, {words_sql("'Reply' || ' ' || answer")} AS aw FROM pairs)""", pairs=TURN_PAIRS_SQL))
def lexical_gate(spark, d):
    words = turn_pairs(spark, d).select(
        "conv_id", "turn", text.significant_words(F.col("question")).alias("qw"),
        text.significant_words(F.concat_ws(" ", F.lit("Reply"), F.col("answer"))).alias("aw"),
    )
    return words.select("conv_id", "turn", text.lexically_grounded(F.col("qw"), F.col("aw")).alias("grounded"))


@R.query("n15_vector_math", with_views("centroids_v", """
SELECT vec_id, ROUND(list_dot_product(e, query_vec), 6) AS dot, ROUND(sqrt(list_dot_product(e, e)), 6) AS norm,
       ROUND(list_sum(list_transform(list_zip(e, query_vec), lambda p : pow(p[1] - p[2], 2))), 6) AS squared_distance
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) JOIN centroids_v ON query_id = label"""))
def vector_math(spark, d):
    own = views.table(spark, d, "embeddings").join(views.centroids(spark, d).withColumnRenamed("query_id", "label"), "label")
    e, q = F.col("embedding"), F.col("query_vec")
    return own.select(
        "vec_id", rounded(vectors.dot(e, q)).alias("dot"), rounded(vectors.norm(e)).alias("norm"),
        rounded(vectors.squared_distance(e, q)).alias("squared_distance"),
    )


@R.query("n17_citation", with_views("markdown_v", "SELECT doc_id, section_no, doc_title || ' > ' || section AS citation FROM sections WHERE section_text <> ''", sections=SECTIONS_SQL))
def citation(spark, d):
    return documents.sections(views.markdown(spark, d)).select(
        "doc_id", "section_no", text.citation(F.col("doc_title"), F.col("section")).alias("citation")
    )


HEAD, LOST = retrieval.ANSWER_HEAD.replace("'", "''"), retrieval.NOT_FOUND.replace("'", "''")
ANSWERS_SQL = f"""
SELECT q.query_id, q.question, q.expected_source, q.in_scope, best, g AS grounded, sources,
  CASE WHEN g THEN cites ELSE '' END AS citations, CASE WHEN g THEN '{HEAD}' || chr(10) || quotes ELSE '{LOST}' END AS answer
FROM (SELECT *, best <= 1.05 AND (len(qw) = 0 OR list_has_any(qw, pw)) AS g FROM (
  SELECT query_id, MIN(score) AS best, string_agg(doc_title || ' > ' || section, '|' ORDER BY rank) AS cites, list(doc_title ORDER BY rank) AS sources,
    string_agg(CASE WHEN rank <= 3 THEN '**' || doc_title || ' > ' || section || '**' || chr(10) || {trim_sql('chunk_text')} || chr(10) END, chr(10) ORDER BY rank) AS quotes,
    ANY_VALUE(CASE WHEN rank = 1 THEN {words_sql("doc_title || ' ' || section || ' ' || chunk_text")} END) AS pw
  FROM m JOIN passages_v USING (chunk_id) GROUP BY query_id) JOIN (SELECT query_id, {words_sql('question')} AS qw FROM vector_questions_v) USING (query_id))
JOIN vector_questions_v q USING (query_id)"""


def with_answers(body):
    return with_views("passages_v vector_questions_v", body, m=TOPK_SQL.format(q="vector_questions_v", c=PASSAGE_VECTORS), answers=ANSWERS_SQL)


def answers(spark, d):
    questions = views.vector_questions(spark, d)
    passages = views.passages(spark, d)
    matches = materialize(retrieval.top_k(questions, passages.select("chunk_id", "embedding")))
    sources = (
        matches.join(passages.select("chunk_id", "doc_title"), "chunk_id").groupBy("query_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_title"))), lambda r: r["doc_title"]).alias("sources"))
    )
    found = retrieval.answer_questions(questions.select("query_id", "question"), matches, passages.drop("embedding", "label"))
    return found.join(sources, "query_id")


@R.query("r7_batch_ask", with_answers("SELECT CAST(query_id AS BIGINT) AS query_id, ROUND(best, 6) AS best_distance, grounded, citations, answer FROM answers"))
def batch_ask(spark, d):
    return answers(spark, d).select(
        "query_id", rounded("best_distance").alias("best_distance"), "grounded", F.array_join("citations", "|").alias("citations"), "answer"
    )


@R.query("r7_batch_ask_text")
def batch_ask_text(spark, d):
    """Benchmark passages asked of the chunked documents through TF-IDF vectors."""
    table = materialize(chunk_table(spark, d))
    model = retrieval.tfidf_pipeline().fit(table.select("chunk_text"))
    questions = views.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    asked = retrieval.embed(questions, model, "question", "query_vec")
    matches = materialize(retrieval.top_k(asked, retrieval.embed(table.select("chunk_id", "chunk_text"), model), metric="unit_l2"))
    return retrieval.answer_questions(questions, matches, table.select("chunk_id", "doc_title", "section", "chunk_text"))


@R.query("r7_note_answers", with_views("centroids_v passages_v", f"""
SELECT CAST(query_id AS BIGINT) AS query_id, MAX(score) >= 0.3 AS grounded,
  CASE WHEN MAX(score) >= 0.3 THEN string_agg('[' || chunk_id || '] ' || doc_title, '|' ORDER BY rank) ELSE '' END AS citations FROM m JOIN passages_v USING (chunk_id) GROUP BY query_id""", m=SIM_SQL.format(c=PASSAGE_VECTORS)))
def note_answers(spark, d):
    """The research-note form: similarity threshold and note citations, one question per label."""
    passages = views.passages(spark, d)
    notes = passages.select(
        F.col("chunk_id").alias("note_id"), F.col("doc_title").alias("headline"), F.col("section").alias("ticker"),
        F.lit(views.AS_OF).alias("date"), F.col("chunk_text").alias("text"), "embedding",
    )
    questions = views.centroids(spark, d)
    matches = materialize(retrieval.top_k(questions, notes, k=retrieval.NOTE_TOP_K, metric="dot", corpus_id="note_id"))
    found = retrieval.answer_from_notes(questions.select(F.col("query_id").cast("long")), matches, notes.drop("embedding"))
    return found.select("query_id", "grounded", F.array_join("citations", "|").alias("citations"))


TERMS_SQL = "SELECT * FROM (VALUES (1, 'route_a', 'und'), (2, 'route_b', 'que'), (3, 'route_c', 'the')) AS v(priority, route, term)"


@R.query("j7_term_routes", with_views("questions_v", """
SELECT question_id, arg_min(route, priority) AS route FROM questions_v LEFT JOIN terms ON contains(lower(question), term) GROUP BY question_id""", terms=TERMS_SQL))
def term_routes(spark, d):
    terms = spark.createDataFrame([(1, "route_a", "und"), (2, "route_b", "que"), (3, "route_c", "the")], "priority int, route string, term string")
    return routing.term_routes(views.questions(spark, d), terms).select("question_id", "route")


# Words of the documents and names of parts and suppliers; the longest term that a turn holds wins.
DICTIONARY_SQL = """
SELECT -length(term) AS priority, term AS route, term FROM (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{3,}')) AS term FROM documents
  UNION SELECT lower(p_name) FROM part UNION SELECT lower(s_name) FROM supplier UNION SELECT lower(p_type) FROM part UNION SELECT lower(p_brand) FROM part)"""
DICTIONARY_ROUTES_SQL = """
SELECT conv_id, turn, MIN({'priority': priority, 'route': route}).route AS route FROM conversations LEFT JOIN terms ON contains(lower(text), term) GROUP BY conv_id, turn"""


def dictionary(spark, d):
    part, supplier = views.table(spark, d, "part"), views.table(spark, d, "supplier")
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    terms = views.table(spark, d, "documents").select(words.alias("term"))
    for df, name in ((part, "p_name"), (supplier, "s_name"), (part, "p_type"), (part, "p_brand")):
        terms = terms.union(df.select(F.lower(name)))
    return terms.distinct().select((-F.length("term")).alias("priority"), F.col("term").alias("route"), "term")


def dictionary_routes(spark, d, **limit):
    turns = views.table(spark, d, "conversations")
    return routing.term_routes(turns, dictionary(spark, d), "text", **limit).select("conv_id", "turn", "route")


@R.query("j7_term_dictionary", with_views([], DICTIONARY_ROUTES_SQL, terms=DICTIONARY_SQL))
def term_dictionary(spark, d):
    """Every word of the documents looked for in every turn."""
    return dictionary_routes(spark, d)


@R.query("j7_term_dictionary_shuffled", with_views([], DICTIONARY_ROUTES_SQL, terms=DICTIONARY_SQL))
def term_dictionary_shuffled(spark, d):
    """The same on the path for dictionaries that no task can hold."""
    return dictionary_routes(spark, d, term_chars=0)


ROUTED_SQL = f"""
SELECT question_id, category, question, expected_tools, must_contain, tool, handled,
  CASE tool WHEN 'get_customer_churn_risk' THEN cust WHEN 'get_country_kpis' THEN country WHEN 'ask_hr_it_policy' THEN question END AS tool_input
FROM (SELECT *, tool IS NOT NULL AS handled FROM (
  SELECT *, CASE WHEN cust IS NOT NULL THEN 'get_customer_churn_risk' WHEN country IS NOT NULL AND {any_sql('q', routing.ANALYTICS_TERMS)} THEN 'get_country_kpis'
    WHEN {any_sql('q', routing.DRIVER_TERMS)} THEN 'get_churn_risk_drivers' WHEN {any_sql('q', routing.POLICY_TERMS)} THEN 'ask_hr_it_policy' END AS tool
  FROM (SELECT t.*, lower(question) AS q, NULLIF(upper(regexp_extract(question, '(?i)\\b(CUST\\d{{6}})\\b', 1)), '') AS cust,
          (SELECT MIN(n_name) FROM nation WHERE contains(lower(t.question), lower(n_name))) AS country FROM typed_questions_v t)))"""


def routed(spark, d):
    countries = views.customers(spark, d).select("country")
    return routing.route_questions(views.typed_questions(spark, d), countries)


@R.query("r8_keyword_router", with_views("typed_questions_v", "SELECT question_id, tool, tool_input, handled FROM routed", routed=ROUTED_SQL))
def keyword_router(spark, d):
    return routed(spark, d).select("question_id", "tool", "tool_input", "handled")


@R.query("a9_top_drivers", with_views("importance_v metrics_v", """
SELECT feature, ROUND(importance, 4) AS importance, accuracy AS model_accuracy, roc_auc AS model_roc_auc FROM importance_v, metrics_v ORDER BY importance_v.importance DESC, feature LIMIT 3"""))
def top_drivers(spark, d):
    scores = materialize(views.scored(spark, d))
    return retail.top_drivers(views.importance(scores), views.model_metrics(scores), 3)


SCORED_ROWS = "SELECT *, 'CUST' || lpad(CAST(customer_id AS VARCHAR), 6, '0') AS code FROM scored_v"
COUNTRY_ROWS = """SELECT country, COUNT(*) AS n, ROUND(AVG(churn_probability), 4) AS p, SUM(CASE WHEN churn_risk_band = 'High' THEN 1 ELSE 0 END) AS high,
  CAST(ROUND(CAST(SUM(monetary_sgd) AS DECIMAL(28,8)), 2) AS DOUBLE) AS total FROM scored_v GROUP BY country"""
DRIVER_TEXT = """SELECT 'Top churn drivers: ' || string_agg(feature || ' (' || CAST(CAST(round_even(ROUND(importance, 4) * 100, 0) AS INTEGER) AS VARCHAR) || '%)', ', ' ORDER BY importance DESC, feature)
  || '. Model accuracy ' || printf('%.1f', ANY_VALUE(round_even(accuracy * 100, 1))) || '%, ROC-AUC ' || printf('%.2f', ANY_VALUE(round_even(roc_auc, 2))) || '.' AS line
FROM (SELECT * FROM importance_v ORDER BY importance DESC, feature LIMIT 5), metrics_v"""
NOT_HANDLED_SQL = routing.NOT_HANDLED.replace("'", "''")
# Every call of a question, in the order of the tools.
CALLS_SQL = f"""
SELECT question_id, category, question, expected_tools, must_contain, CAST(unnest(range(1, len(calls) + 1)) AS INTEGER) AS step, unnest(calls).tool AS tool, unnest(calls).tool_input AS tool_input
FROM (SELECT *, CASE WHEN len(found) = 0 THEN [{{'tool': NULL, 'tool_input': NULL}}] ELSE found END AS calls FROM (
  SELECT *, list_filter([
    CASE WHEN cust IS NOT NULL THEN {{'tool': 'get_customer_churn_risk', 'tool_input': cust}} END,
    CASE WHEN country IS NOT NULL AND {any_sql('q', routing.ANALYTICS_TERMS)} THEN {{'tool': 'get_country_kpis', 'tool_input': country}} END,
    CASE WHEN {any_sql('q', routing.DRIVER_TERMS)} THEN {{'tool': 'get_churn_risk_drivers', 'tool_input': CAST(NULL AS VARCHAR)}} END,
    CASE WHEN {any_sql('q', routing.POLICY_TERMS)} THEN {{'tool': 'ask_hr_it_policy', 'tool_input': question}} END], lambda c : c IS NOT NULL) AS found
  FROM (SELECT t.*, lower(question) AS q, NULLIF(upper(regexp_extract(question, '(?i)\\b(CUST\\d{{6}})\\b', 1)), '') AS cust,
          (SELECT MIN(n_name) FROM nation WHERE contains(lower(t.question), lower(n_name))) AS country FROM typed_questions_v t)))"""
POLICY_SQL = f"""
SELECT a.query_id AS question_id, CASE WHEN best <= 1.05 AND (len(qw) = 0 OR list_has_any(qw, pw)) THEN '{HEAD}' || chr(10) || quotes ELSE '{LOST}' END AS policy_answer
FROM (SELECT *, {words_sql('question')} AS qw FROM policy_asked) a LEFT JOIN (
  SELECT query_id, MIN(score) AS best,
    string_agg(CASE WHEN rank <= 3 THEN '**' || lang || ' > ' || source || '**' || chr(10) || {trim_sql('text')} || chr(10) END, chr(10) ORDER BY rank) AS quotes,
    ANY_VALUE(CASE WHEN rank = 1 THEN {words_sql("lang || ' ' || source || ' ' || text")} END) AS pw
  FROM found JOIN documents ON doc_id = chunk_id GROUP BY query_id) f ON f.query_id = a.query_id"""
ANSWER_TEXT_SQL = f"""
SELECT question_id, ANY_VALUE(category) AS category, ANY_VALUE(expected_tools) AS expected_tools, ANY_VALUE(must_contain) AS must_contain, COUNT(tool) > 0 AS handled,
  COALESCE(list(tool ORDER BY step) FILTER (WHERE tool IS NOT NULL), []) AS tools, string_agg(line, chr(10) || chr(10) ORDER BY step) AS answer FROM (
SELECT r.*, CASE
  WHEN r.tool = 'get_customer_churn_risk' AND s.code IS NULL THEN 'No customer found with ID ''' || r.tool_input || '''.'
  WHEN r.tool = 'get_customer_churn_risk' THEN 'Customer ' || s.code || ' (' || s.country || ', ' || s.segment || ' segment): churn probability '
    || CAST(round_even(s.churn_probability * 100, 0) AS INTEGER) || '%, risk band ' || s.churn_risk_band || '. Recency ' || s.recency_days || ' days, frequency '
    || s.frequency || ', monetary SGD ' || regexp_replace(CAST(CAST(s.monetary_sgd AS DECIMAL(28,2)) AS VARCHAR), '(\\.\\d)0$', '\\1') || ', tenure ' || COALESCE(CAST(s.tenure_days AS VARCHAR), 'n/a') || ' days.'
  WHEN r.tool = 'get_country_kpis' THEN c.country || ': ' || c.n || ' customers, average churn probability ' || CAST(round_even(c.p * 100, 0) AS INTEGER) || '%, '
    || c.high || ' high-risk, total revenue SGD ' || format('{{:,.2f}}', c.total) || '.'
  WHEN r.tool = 'get_churn_risk_drivers' THEN (SELECT line FROM driver_text)
  WHEN r.tool IS NULL THEN '{NOT_HANDLED_SQL}' ELSE p.policy_answer END AS line
FROM calls r LEFT JOIN scored_rows s ON r.tool = 'get_customer_churn_risk' AND s.code = r.tool_input LEFT JOIN country_rows c ON r.tool = 'get_country_kpis' AND c.country = r.tool_input
LEFT JOIN policy_answers p ON p.question_id = r.question_id) GROUP BY question_id"""


def with_routed_answers(body):
    return with_views(
        "typed_questions_v scored_v importance_v metrics_v", body, calls=CALLS_SQL, scored_rows=SCORED_ROWS, country_rows=COUNTRY_ROWS, driver_text=DRIVER_TEXT,
        policy_asked="SELECT question_id AS query_id, question FROM calls WHERE tool = 'ask_hr_it_policy'", **search_sql("policy_asked"), policy_answers=POLICY_SQL,
        said=ANSWER_TEXT_SQL,
    )


def dispatched(spark, d):
    """Every question sent to all tools it calls for; the documents answer the policy questions."""
    scores = materialize(views.coded_scores(spark, d))
    questions = materialize(routing.all_routes(views.typed_questions(spark, d), scores.select("country")))
    asked = questions.where(F.exists("calls", lambda c: c["tool"] == routing.POLICY_TOOL)).select("question_id", "question")
    index, passages = document_index(spark, d)
    matches = materialize(index.search(asked, query_id="question_id"))
    policy, texts = retrieval.grounded_matches(asked, matches, passages, "question_id")
    return routing.dispatch_all(questions, scores, views.importance(scores), views.model_metrics(scores), policy, policy_texts=texts)


@R.query("f12_answer_text", with_routed_answers("SELECT question_id, answer FROM said"))
def answer_text(spark, d):
    return dispatched(spark, d).select("question_id", "answer")


def tools_called():
    return F.transform("tool_calls", lambda c: c["tool"])


@R.query("r9_dispatch")
def dispatch(spark, d):
    return dispatched(spark, d).select("question_id", F.array_join(tools_called(), ",").alias("tools"), "handled", F.to_json("tool_calls").alias("trace"), "answer")


@R.query("r9_dispatch_trace", with_routed_answers("""
SELECT question_id, array_to_string(tools, ',') AS tools, CAST(len(tools) AS INTEGER) AS calls, handled, contains(answer, 'No customer found') AS failed FROM said"""))
def dispatch_trace(spark, d):
    return dispatched(spark, d).select(
        "question_id", F.array_join(tools_called(), ",").alias("tools"), F.size("tool_calls").alias("calls"), "handled",
        F.exists("tool_calls", lambda c: F.get_json_object(c["output"], "$.error").isNotNull()).alias("failed"),
    )


def judged_routing(spark, d):
    done = dispatched(spark, d)
    actual = done.select("question_id", tools_called().alias("tools_called"), "answer", "handled")
    expected = views.typed_questions(spark, d).withColumn("must_not_contain", F.array(F.lit("No customer found"))).drop("question")
    return evaluation.judge_routing(expected, actual)


JUDGED_SQL = """
SELECT *, list_sort(list_distinct(tools)) = list_sort(list_distinct(expected_tools)) AS routing_correct,
  CASE WHEN len(must_contain) > 0 THEN len(list_filter(must_contain, lambda w : contains(lower(answer), lower(w)))) = len(must_contain) END AS keyword_hit,
  contains(lower(answer), 'no customer found') AS hallucination_flag FROM said"""


@R.query("j9_expected_vs_actual", with_routed_answers(f"SELECT question_id, category, routing_correct, keyword_hit, hallucination_flag FROM ({JUDGED_SQL})"))
def expected_vs_actual(spark, d):
    return judged_routing(spark, d).select("question_id", "category", "routing_correct", "keyword_hit", "hallucination_flag")


@R.query("u4_set_equality", with_routed_answers(f"SELECT question_id, routing_correct FROM ({JUDGED_SQL})"))
def set_equality(spark, d):
    return judged_routing(spark, d).select("question_id", "routing_correct")


@R.query("a11_routing_eval", with_routed_answers(f"""
SELECT COUNT(*) AS total_questions, ROUND(AVG(CAST(routing_correct AS INTEGER)), 6) AS routing_accuracy, ROUND(AVG(CAST(keyword_hit AS INTEGER)), 6) AS keyword_grounding_accuracy,
  CAST(SUM(CAST(hallucination_flag AS INTEGER)) AS BIGINT) AS hallucination_flags,
  ROUND(AVG(CASE WHEN category = 'out_of_scope' THEN CASE WHEN len(tools) = 0 THEN 1 ELSE 0 END END), 6) AS correct_refusal_rate,
  ROUND(COALESCE(AVG(CASE WHEN category = 'compound' THEN CAST(routing_correct AS INTEGER) END), 0), 6) AS compound_full_success_rate FROM ({JUDGED_SQL})"""))
def routing_eval(spark, d):
    return round_all(
        evaluation.routing_summary(judged_routing(spark, d)),
        "routing_accuracy", "keyword_grounding_accuracy", "correct_refusal_rate", "compound_full_success_rate",
    )


@R.query("a11_routing_by_category", with_routed_answers(f"""
SELECT category, COUNT(*) AS questions, ROUND(AVG(CAST(routing_correct AS INTEGER)), 6) AS routing_accuracy FROM ({JUDGED_SQL}) GROUP BY category"""))
def routing_by_category(spark, d):
    return round_all(evaluation.routing_by_category(judged_routing(spark, d)), "routing_accuracy")


@R.query("a10_retrieval_eval", with_answers(f"""
SELECT COUNT(*) AS total_questions, CAST(SUM(CAST(in_scope AS INTEGER)) AS BIGINT) AS in_scope_questions, CAST(SUM(CAST(NOT in_scope AS INTEGER)) AS BIGINT) AS out_of_scope_questions,
  ROUND(AVG(CASE WHEN in_scope THEN CAST(list_contains(sources, expected_source) AS INTEGER) END), 6) AS retrieval_accuracy,
  ROUND(AVG(CASE WHEN in_scope THEN CAST(COALESCE(kw, FALSE) AS INTEGER) END), 6) AS keyword_grounding_accuracy,
  ROUND(AVG(CASE WHEN NOT in_scope THEN CAST(NOT grounded AS INTEGER) END), 6) AS correct_refusal_rate,
  CAST(SUM(CAST(CASE WHEN in_scope THEN grounded AND NOT COALESCE(kw, TRUE) ELSE grounded END AS INTEGER)) AS BIGINT) AS hallucination_flags
FROM (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x : contains(lower(answer), x))) > 0 END AS kw FROM (SELECT *, {words_sql('question')} AS w FROM answers))"""))
def retrieval_eval(spark, d):
    expected = views.vector_questions(spark, d).select(
        "query_id", "expected_source", "in_scope", text.significant_words(F.col("question")).alias("expected_keywords")
    )
    judged = evaluation.judge_retrieval(expected, answers(spark, d).select("query_id", "sources", "answer", "grounded", "best_distance"))
    return round_all(evaluation.retrieval_summary(judged), "retrieval_accuracy", "keyword_grounding_accuracy", "correct_refusal_rate")
