"""Approximate nearest vectors: hash tables of random projections.

A table has ``bits`` planes; the bucket of a vector is the sides it lies on. A corpus row is compared with a question only if
they share a bucket of some table, and by their exact distance. Planes come from a digest of their numbers, so an index built
anywhere is the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.retrieval import QUERY_VALUES_LIMIT, SCORE_DIGITS, TOP_K
from tidemark.session import broadcast_if_small, materialize

TABLES = 24
BITS = 4
MOST_TABLES = 32
MOST_BITS = 30
FIT_ROWS = 4000  # rows of the corpus that the sizes are fitted on
FIT_QUERIES = 200  # of these
TARGET_RECALL = 0.95
PAIRS = 1 << 18  # pairs of vectors scored at a time
PAIR_VALUES = 1 << 21  # numbers of such pairs on each side, 16 MB
PIECE_ROWS = 20_000  # of a bucket in one task


def plane_weight(table: int, bit: int, position: int) -> float:
    return int(hashlib.md5(f"{table}:{bit}:{position}".encode()).hexdigest()[:8], 16) / 2**32 - 0.5


@dataclass(frozen=True)
class Hashing:
    """Tables and bits of an index over vectors of ``dims`` numbers."""

    dims: int
    tables: int = TABLES
    bits: int = BITS

    def planes(self) -> np.ndarray:
        return np.array([[plane_weight(t, b, p) for p in range(self.dims)] for t in range(self.tables) for b in range(self.bits)])

    def buckets(self, vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
        """One bucket number per vector and table."""
        sides = (vectors @ planes.T > 0).reshape(len(vectors), self.tables, self.bits)
        return sides @ (1 << np.arange(self.bits, dtype=np.int64))


def expected_recall(agreement: np.ndarray, bits: int, tables: int) -> float:
    """Mean probability that pairs whose sides agree with the given probabilities share a bucket."""
    return float((1 - (1 - agreement**bits) ** tables).mean())


def fit_hashing(corpus: DataFrame, vector: str = "embedding", k: int = TOP_K, target: float = TARGET_RECALL, rows: int = FIT_ROWS) -> Hashing:
    """The most selective hashing that reaches the target recall with MOST_TABLES tables, judged by the angles between FIT_QUERIES
    vectors and their k nearest among a sample of about ``rows`` rows. In the whole corpus neighbours are nearer than in a sample, so
    the recall there is no less."""
    n = corpus.count()
    sample = corpus.select(vector).where(F.col(vector).isNotNull())
    if n > rows:
        sample = sample.sample(rows / n, seed=3).limit(2 * rows)
    x = np.array([r[0] for r in sample.collect()], float)
    if len(x) < 2:
        return Hashing(x.shape[1] if x.size else 1, 1, 1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    near = unit[:FIT_QUERIES] @ unit.T
    near[np.arange(len(near)), np.arange(len(near))] = -2
    best = -np.partition(-near, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
    agreement = 1 - np.arccos(np.clip(best, -1, 1)).reshape(-1) / math.pi
    fitting = [(b, t) for b in range(1, MOST_BITS + 1) for t in range(1, MOST_TABLES + 1) if expected_recall(agreement, b, t) >= target]
    bits = max((b for b, _ in fitting), default=1)
    return Hashing(x.shape[1], min((t for b, t in fitting if b == bits), default=MOST_TABLES), bits)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def _first_k(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (score, id) of each query."""
    order = np.lexsort((ident, score, query))
    new = np.ones(len(order), bool)
    new[1:] = query[order][1:] != query[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


class _Running:
    """k best pairs of each query so far; a pair may arrive more than once."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.ident, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, query, ident, score) -> None:
        query, ident, score = (np.concatenate(x) for x in ((self.query, query), (self.ident, ident), (self.score, score)))
        order = np.lexsort((ident, query))
        once = np.ones(len(order), bool)
        once[1:] = (query[order][1:] != query[order][:-1]) | (ident[order][1:] != ident[order][:-1])
        query, ident, score = (x[order[once]] for x in (query, ident, score))
        keep = _first_k(query, score, ident, self.k)
        self.query, self.ident, self.score = query[keep], ident[keep], score[keep]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": self.query, "corpus_id": self.ident, "score": self.score})


def _squared(a: np.ndarray, row: np.ndarray, b: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Squared distances of a[row] and b[spot], some pairs at a time."""
    out, step = np.zeros(len(row)), max(1, PAIR_VALUES // max(a.shape[1], 1))
    for at in range(0, len(row), step):
        gap = a[row[at : at + step]] - b[spot[at : at + step]]
        out[at : at + step] = (gap * gap).sum(axis=1)
    return np.round(out, SCORE_DIGITS) + 0.0


def _shipped(ids: np.ndarray, vectors: np.ndarray, hashing: Hashing, k: int):
    """Scan of the corpus with the queries at hand: a row meets the queries in its buckets, found by binary search."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, best = hashing.planes(), _Running(k)
        mine = hashing.buckets(vectors, planes)
        order = np.argsort(mine, axis=0, kind="stable")
        ordered = np.take_along_axis(mine, order, axis=0)
        step = max(1, PAIRS // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, ident = _matrix(part.column("v"), hashing.dims), part.column("corpus_id").to_numpy()
                theirs = hashing.buckets(x, planes)
                met = []
                for t in range(hashing.tables):
                    low, high = (np.searchsorted(ordered[:, t], theirs[:, t], side) for side in ("left", "right"))
                    count = high - low
                    row = np.repeat(np.arange(len(x)), count)
                    spot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[row]
                    met.append(row * len(ids) + order[spot, t])
                row, q = np.divmod(np.unique(np.concatenate(met)), len(ids))
                best.add(ids[q], ident[row], _squared(x, row, vectors, q))
        yield best.batch()

    return scan


def _hashed(df: DataFrame, hashing: Hashing) -> DataFrame:
    """(table, bucket, id, v): a row per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = hashing.planes()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS // hashing.tables + 1):
                part = batch.slice(at, PIECE_ROWS // hashing.tables + 1)
                codes = hashing.buckets(_matrix(part.column("v"), hashing.dims), planes)
                take = np.repeat(np.arange(part.num_rows), hashing.tables)
                table = np.tile(np.arange(hashing.tables, dtype=np.int32), part.num_rows)
                columns = [pa.array(table), pa.array(codes.reshape(-1)), part.column("id").take(take), part.column("v").take(take)]
                yield pa.RecordBatch.from_arrays(columns, ["table", "bucket", "id", "v"])

    return df.mapInArrow(run, "table int, bucket long, id long, v array<double>")


def _bucket_join(queries: DataFrame, corpus: DataFrame, hashing: Hashing, k: int, piece_rows: int) -> DataFrame:
    """Both sides dealt by bucket; large buckets are cut on both sides, and every piece meets every piece of the other side."""
    place = ["table", "bucket"]
    sides = []
    for df, name in ((queries, "asked"), (corpus, "held")):
        rows = _hashed(df, hashing)
        pieces = rows.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / piece_rows).alias(name))
        sides.append((rows, materialize(pieces)))
    (asked, few), (held, many) = sides
    both = broadcast_if_small(materialize(few.join(many, place)))  # buckets with rows on both sides
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asked.join(both, place).withColumn("a", F.pmod(F.xxhash64("id"), "asked")).withColumn("h", numbers("held"))
    held = held.join(both, place).withColumn("h", F.pmod(F.xxhash64("id"), "held")).withColumn("a", numbers("asked"))
    place = [*place, "a", "h"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Running(k)
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v"), hashing.dims), _matrix(right.column("v"), hashing.dims)
            ids, ident = left.column("id").to_numpy(), right.column("id").to_numpy()
            step = max(1, PAIRS // len(x))
            for at in range(0, len(q), step):
                part = np.arange(at, min(at + step, len(q)))
                row, spot = np.repeat(part, len(x)), np.tile(np.arange(len(x)), len(part))
                best.add(ids[row], ident[spot], _squared(x, spot, q, row))
        return pa.Table.from_batches([best.batch()])

    dealt = asked.select(*place, "id", "v").groupBy(*place).cogroup(held.select(*place, "id", "v").groupBy(*place))
    return dealt.applyInArrow(meet, "query_id long, corpus_id long, score double").distinct()


def lsh_top_k(
    queries: DataFrame, corpus: DataFrame, hashing: Hashing, k: int = TOP_K, query_id: str = "query_id", query_vec: str = "query_vec",
    corpus_id: str = "chunk_id", corpus_vec: str = "embedding", query_values_limit: int = QUERY_VALUES_LIMIT, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The k nearest corpus rows of every query among those that share a bucket with it: rank and exact squared distance.

    Queries within ``query_values_limit`` numbers are shipped to the corpus tasks, which return k rows per query; more of them are
    dealt by bucket like the corpus. Both ways compare the same rows. Ids are integers and unique; equal distances are ranked by
    id. Rows without a vector take no part; a query that shares no bucket has no row.
    """
    q = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null")
    c = corpus.select(F.col(corpus_id).cast("long").alias("corpus_id"), F.col(corpus_vec).cast("array<double>").alias("v")).where("v is not null")
    schema = "query_id long, corpus_id long, score double"
    n = q.count()
    if not n:
        found = q.sparkSession.createDataFrame([], schema)
    elif n * hashing.dims <= query_values_limit:
        rows = q.collect()
        found = c.mapInArrow(_shipped(np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], float), hashing, k), schema)
    else:
        found = _bucket_join(q, c.withColumnRenamed("corpus_id", "id"), hashing, k, piece_rows)
    order = Window.partitionBy("query_id").orderBy("score", "corpus_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("corpus_id").alias(corpus_id), "rank", "score")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", corpus_id: str = "chunk_id") -> DataFrame:
    """One row (queries, recall): the share of the exact (query, corpus) pairs that were found."""
    pairs = [query_id, corpus_id]
    both = exact.select(*pairs).join(found.select(*pairs, F.lit(1).alias("hit")), pairs, "left")
    return both.agg(F.count_distinct(query_id).alias("queries"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))
