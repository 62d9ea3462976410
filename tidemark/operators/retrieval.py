"""Nearest-chunk search, grounding gates and extractive answers for a whole table of questions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tidemark.functions.text import citation, lexically_grounded, significant_words, strip
from tidemark.session import broadcast_if_small, materialize

# Fixed values.
TOP_K = 4
MAX_DISTANCE = 1.05
MIN_SIMILARITY = 0.30
NOTE_TOP_K = 3
QUOTED = 3
NOT_FOUND = (
    "I couldn't find anything in the HR/IT policy knowledge base that answers this "
    "question confidently. Please check with the People Team or IT Service Desk directly "
    "rather than relying on a guess."
)
ANSWER_HEAD = "Here's what the policy documents say (mock mode — extractive, no LLM used):\n"
NOTE_NOT_FOUND = (
    "Nothing in the research note corpus is closely related to this question. "
    "Rather than guess, treat this as a gap to research through primary sources "
    "(filings, transcripts, real news) instead of this tool."
)
NOTE_HEAD = "Candidate signal ideas from the research notes (mock mode — extractive, no LLM used):\n"
NOTE_TAIL = "Reminder: these are notes, not verified facts — treat as a starting point for research, not investment advice."

METRICS = ("squared_l2", "unit_l2", "dot")
HASH_DIMS = 1 << 16
QUERY_VALUES_LIMIT = 1 << 22  # floats of query vectors that one broadcast may hold, 32 MB
SHARD_ROWS = 50_000
PRODUCTS = 1 << 22  # of a corpus entry and a query that are held at a time
SCORES = 1 << 21  # of corpus rows and queries that a task holds at a time, 16 MB
SCORE_DIGITS = 9  # scores are rounded before ranking, so equal vectors tie and the id decides


def tfidf_pipeline(text: str = "chunk_text", dims: int = HASH_DIMS) -> Pipeline:
    """Unit-length TF-IDF vectors of hashed words. The fitted model is one vector of ``dims`` document frequencies."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="_unit"),
        ]
    )


def embed(df: DataFrame, model: PipelineModel, text: str = "chunk_text", out: str = "embedding") -> DataFrame:
    """Add a sparse vector ``struct<indices, values>``; tokenising and hashing stay in the JVM."""
    source = model.stages[0].getInputCol()
    named = df.withColumn(source, F.col(text)) if text != source else df
    vector = F.unwrap_udt("_unit")
    scored = model.transform(named).withColumn(
        out, F.struct(vector["indices"].alias("indices"), vector["values"].alias("values"))
    )
    return scored.select(*df.columns, out)


def _is_sparse(df: DataFrame, col: str) -> bool:
    return df.schema[col].dataType.typeName() == "struct"


def _unpack(column: pa.Array, sparse: bool):
    """Arrow vectors as a dense matrix, or as (offsets, indices, values)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not sparse:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)
    indices, values = column.field("indices"), column.field("values")
    offsets = indices.offsets.to_numpy()
    return offsets - offsets[0], indices.flatten().to_numpy(), values.flatten().to_numpy()


class _Queries:
    """A block of query vectors prepared for matrix products."""

    def __init__(self, ids, vectors, sparse: bool, metric: str):
        self.ids, self.sparse, self.metric = np.asarray(ids), sparse, metric
        if sparse:
            self.dims = np.unique(np.concatenate([np.asarray(v[0], dtype=np.int64) for v in vectors]))
            matrix = np.zeros((len(vectors), len(self.dims)))
            for row, (indices, values) in enumerate(vectors):
                matrix[row, np.searchsorted(self.dims, indices)] = values
        else:
            matrix = np.asarray(vectors, dtype=float)
        self.by_dim = np.ascontiguousarray(matrix.T)
        self.squares = (matrix * matrix).sum(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Corpus batch by queries, smaller is nearer."""
        data = _unpack(column, self.sparse)
        if self.sparse:
            offsets, indices, values = data
            rows = np.repeat(np.arange(len(column)), np.diff(offsets))
            dots = np.zeros((len(column), len(self.ids)))
            squares = np.bincount(rows, values * values, minlength=len(column))
            spot = np.minimum(np.searchsorted(self.dims, indices), max(len(self.dims) - 1, 0))
            known = self.dims[spot] == indices if len(self.dims) else np.zeros(len(indices), bool)
            rows, spot, values = rows[known], spot[known], values[known]
            # products of some rows at a time, summed by row; the entries of a row lie together
            begin = np.flatnonzero(np.diff(rows, prepend=-1))
            at = 0
            while at < len(begin):
                to = max(at + 1, int(np.searchsorted(begin, begin[at] + PRODUCTS // max(len(self.ids), 1))))
                part = slice(begin[at], begin[to] if to < len(begin) else len(rows))
                dots[rows[begin[at:to]]] = np.add.reduceat(values[part, None] * self.by_dim[spot[part]], begin[at:to] - begin[at], axis=0)
                at = to
        else:
            dots, squares = data @ self.by_dim, (data * data).sum(axis=1)
        if self.metric == "dot":
            far = -dots
        elif self.metric == "unit_l2":
            far = 2 - 2 * dots
        else:
            far = squares[:, None] + self.squares[None, :] - 2 * dots
        return np.round(far, SCORE_DIGITS) + 0.0


def _nearest(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores; equal scores go to the smaller id."""
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = np.partition(scores, k - 1)[k - 1]
    inside, tied = np.flatnonzero(scores < edge), np.flatnonzero(scores == edge)
    need = k - len(inside)
    if len(tied) > need:
        tied = tied[np.argsort(ids[tied], kind="stable")[:need]]
    return np.concatenate([inside, tied])


class _Best:
    """Running k nearest corpus rows of each query."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.kept = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in range(n_queries)]

    def scan(self, block: _Queries, vectors: pa.Array, ids: np.ndarray) -> None:
        """Compare corpus rows with the queries, as many rows at a time as SCORES allows."""
        step = max(1, SCORES // max(len(block.ids), 1))
        for at in range(0, len(ids), step):
            self.add(block.scores(vectors.slice(at, step)), ids[at : at + step])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for q in range(scores.shape[1]):
            column = scores[:, q]
            near = _nearest(column, ids, self.k)
            s, i = np.concatenate([self.kept[q][0], column[near]]), np.concatenate([self.kept[q][1], ids[near]])
            pick = _nearest(s, i, self.k)
            self.kept[q] = (s[pick], i[pick])

    def rows(self, query_ids: np.ndarray) -> dict:
        sizes = [len(s) for s, _ in self.kept]
        return {
            "query_id": np.repeat(query_ids, sizes),
            "corpus_id": np.concatenate([i for _, i in self.kept]),
            "score": np.concatenate([s for s, _ in self.kept]),
        }


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    metric: str = "squared_l2",
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    corpus_id: str = "chunk_id",
    corpus_vec: str = "embedding",
    query_values_limit: int = QUERY_VALUES_LIMIT,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The k nearest corpus rows of every query: exact, with a rank, and never a row per (query, corpus) pair.

    A query set within ``query_values_limit`` is shipped to the tasks; the corpus is then read once, not shuffled,
    and each task returns k rows per query. A larger set is cut into blocks and the corpus into shards, and each
    (block, shard) group is one bounded matrix product. Both paths finish with a window per query over
    the partial results. Ids are integers. ``metric`` is ``squared_l2`` (distance), ``unit_l2`` (the same
    for unit vectors, with an all-zero vector at distance 2 from everything) or ``dot`` (similarity).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")
    sparse = _is_sparse(corpus, corpus_vec)
    q = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).alias("v"))
    c = corpus.select(F.col(corpus_id).cast("long").alias("corpus_id"), F.col(corpus_vec).alias("v"))
    width = F.size("v.values") if sparse else F.size("v")
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("values")).first()
    # A sparse block is densified over the dimensions it uses, at most all of its values.
    values = stats["values"] * stats["n"] if sparse else stats["values"]
    schema = "query_id long, corpus_id long, score double"
    if stats["n"] == 0:
        partial = q.sparkSession.createDataFrame([], schema)
    elif values <= query_values_limit:
        rows = q.collect()
        block = _Queries([r["query_id"] for r in rows], [_plain(r["v"], sparse) for r in rows], sparse, metric)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(block.ids), k)
            for batch in batches:
                if batch.num_rows:
                    best.scan(block, batch.column("v"), batch.column("corpus_id").to_numpy())
            yield pa.RecordBatch.from_pydict(best.rows(block.ids))

        partial = c.mapInArrow(scan, schema)
    else:
        n_blocks = min(stats["n"], math.ceil(math.sqrt(values / query_values_limit) if sparse else values / query_values_limit))
        n_shards = max(1, math.ceil(c.count() / shard_rows))
        partial = _blocked(q, c, k, metric, sparse, n_blocks, n_shards, schema)
    order = Window.partitionBy("query_id").orderBy("score", "corpus_id")
    score = -F.col("score") + F.lit(0.0) if metric == "dot" else F.col("score")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("query_id").alias(query_id), F.col("corpus_id").alias(corpus_id), "rank", score.alias("score"))
    )


def _plain(vector, sparse: bool):
    return (vector["indices"], vector["values"]) if sparse else vector


def _blocked(q, c, k, metric, sparse, n_blocks, n_shards, schema) -> DataFrame:
    block, shard = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)), F.pmod(F.xxhash64("corpus_id"), F.lit(n_shards))
    left = q.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    right = c.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))

    def multiply(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "corpus_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        vectors = [_plain(v, sparse) for v in queries.column("v").to_pylist()]
        prepared = _Queries(queries.column("query_id").to_numpy(), vectors, sparse, metric)
        best = _Best(len(prepared.ids), k)
        best.scan(prepared, rows.column("v"), rows.column("corpus_id").to_numpy())
        return pa.table(best.rows(prepared.ids))

    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(multiply, schema)


def distance_gate(matches: DataFrame, query_id: str = "query_id", metric: str = "squared_l2") -> DataFrame:
    """Best score of each question and whether it is near enough to answer from."""
    if metric == "dot":
        best = F.max("score")
        near = best >= MIN_SIMILARITY
    else:
        best = F.min("score")
        near = best <= MAX_DISTANCE
    return matches.groupBy(query_id).agg(best.alias("best_score"), near.alias("near"))


def passage_words(title: str = "doc_title", section: str = "section", text: str = "chunk_text") -> Column:
    return significant_words(F.concat_ws(" ", title, section, text))


def grounded_matches(
    questions: DataFrame, matches: DataFrame, passages: DataFrame, query_id: str = "query_id", corpus_id: str = "chunk_id",
) -> tuple[DataFrame, DataFrame]:
    """The questions with ``best_distance``, ``grounded`` and ``answer_id``, and the answers (answer_id, citations, answer).

    Questions with the same matches at the same scores share an answer, so its passages are gathered once, however many
    questions quote them. The matches are few and narrow, so while they fit they are sent to the passages, which are then read
    without a shuffle.
    """
    lists = matches.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", "score", F.col(corpus_id).alias("id")))).alias("_list"))
    lists = materialize(lists.withColumn("answer_id", F.md5(F.to_json("_list"))))
    wanted = lists.groupBy("answer_id").agg(F.first("_list").alias("_list")).select("answer_id", F.explode("_list").alias("m"))
    wanted = materialize(wanted.select("answer_id", "m.rank", "m.score", F.col("m.id").alias(corpus_id)))
    item = F.struct("rank", "score", citation(F.col("doc_title"), F.col("section")).alias("cite"), "chunk_text", "_words")
    top = F.col("_top")
    quote = lambda m: F.concat(F.lit("**"), m["cite"], F.lit("**\n"), strip(m["chunk_text"]), F.lit("\n"))
    found = (
        passages.join(broadcast_if_small(wanted), corpus_id)
        .withColumn("_words", F.when(F.col("rank") == 1, passage_words()))
        .groupBy("answer_id")
        .agg(F.sort_array(F.collect_list(item)).alias("_top"))
    )
    found = materialize(found.select(
        "answer_id", F.array_min(F.transform(top, lambda m: m["score"])).alias("best_distance"), F.get(top, F.lit(0))["_words"].alias("_words"),
        F.transform(top, lambda m: m["cite"]).alias("citations"), F.concat_ws("\n", F.lit(ANSWER_HEAD), F.transform(F.slice(top, 1, QUOTED), quote)).alias("answer"),
    ))
    grounded = F.coalesce((F.col("best_distance") <= MAX_DISTANCE) & lexically_grounded(significant_words(F.col("question")), F.col("_words")), F.lit(False))
    asked = questions.join(lists.select(query_id, "answer_id"), query_id, "left").join(broadcast_if_small(found.drop("citations", "answer")), "answer_id", "left")
    asked = asked.withColumn("grounded", grounded).select(*questions.columns, "best_distance", "grounded", "answer_id")
    return asked, found.select("answer_id", "citations", "answer")


def answer_columns(grounded: Column, citations: Column, answer: Column) -> dict[str, Column]:
    """``citations`` and ``answer`` of a question from its answer's: empty and the not-found text where it is not grounded."""
    return {
        "citations": F.when(grounded, citations).otherwise(F.array().cast("array<string>")),
        "answer": F.when(grounded, answer).otherwise(NOT_FOUND),
    }


def answer_questions(
    questions: DataFrame,
    matches: DataFrame,
    passages: DataFrame,
    query_id: str = "query_id",
    corpus_id: str = "chunk_id",
) -> DataFrame:
    """Extractive answers with citations, or the not-found text where either gate fails.

    ``questions`` has ``question``; ``matches`` comes from :func:`top_k`; ``passages`` has ``doc_title``, ``section``
    and ``chunk_text``. See :func:`grounded_matches`.
    """
    asked, answers = grounded_matches(questions, matches, passages, query_id, corpus_id)
    whole = asked.join(broadcast_if_small(answers), "answer_id", "left").withColumns(answer_columns(F.col("grounded"), F.col("citations"), F.col("answer")))
    return whole.select(*questions.columns, "best_distance", "grounded", "citations", "answer")


def answer_from_notes(questions: DataFrame, matches: DataFrame, notes: DataFrame, query_id: str = "query_id", corpus_id: str = "note_id") -> DataFrame:
    """Research-note answers: quotes the notes when the best similarity reaches the threshold. ``matches`` uses ``dot``."""
    item = F.struct("rank", "score", corpus_id, "headline", "ticker", "date", "text")
    found = (
        notes.join(broadcast_if_small(matches), corpus_id).groupBy(query_id).agg(F.sort_array(F.collect_list(item)).alias("_top"))
    )
    top = F.col("_top")
    tag = lambda m: F.concat(F.lit("["), m[corpus_id].cast("string"), F.lit("] "), m["headline"])

    def quote(m):
        facts = F.concat_ws(", ", m["ticker"], m["date"].cast("string"), F.format_string("similarity=%.2f", m["score"]))
        return F.concat(F.lit("**"), tag(m), F.lit("** ("), facts, F.lit(")\n"), m["text"], F.lit("\n"))

    quoted = F.concat_ws("\n", F.lit(NOTE_HEAD), F.transform(F.slice(top, 1, QUOTED), quote), F.lit(NOTE_TAIL))
    grounded = F.coalesce(F.get(top, F.lit(0))["score"] >= MIN_SIMILARITY, F.lit(False))
    return (
        questions.join(found, query_id, "left")
        .withColumn("grounded", grounded)
        .withColumn("citations", F.when(F.col("grounded"), F.transform(top, tag)).otherwise(F.array().cast("array<string>")))
        .withColumn("answer", F.when(F.col("grounded"), quoted).otherwise(NOTE_NOT_FOUND))
        .drop("_top")
    )
