"""Helpers the operators share: words of Arrow batches as numpy arrays, stored intermediates, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import materialize, shared_folder

BATCH_ROWS = 250  # of an Arrow batch, and of a batch that the Parquet reader fills, while intermediate tables are made
BLOCK_BYTES = 16 << 20  # of a row group of an intermediate table: a writer holds one, a reader the columns it wants of one
CHUNK_BYTES = 1 << 20  # text held as numpy arrays at a time; a longer document makes a chunk of its own
GOLDEN = 0x9E3779B97F4A7C15
ODD = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Jobs that start inside read texts and hand them to Python in batches of few rows: a batch lies in memory whole, on both sides."""
    before = {key: spark.conf.get(key) for key in (ARROW_ROWS, READER_ROWS)}
    for key, value in before.items():
        spark.conf.set(key, str(min(int(value), rows) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Stored:
    """Intermediate tables as Parquet in the shared folder: columns can be pruned and lost executors lose nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        self.tables: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.tables)}"
        with small_batches(self.spark):
            df.write.option("parquet.block.size", BLOCK_BYTES).parquet(path)
        self.tables.append((self.spark.read.schema(df.schema).parquet(path), path))
        return self.tables[-1][0]

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that no later step reads, and let Spark delete the shuffle files of the steps that are over.

        Spark does the latter once the driver's garbage collector finds the shuffles unused, which it may not do for a long
        time; by then the files of every step would lie on the executors' disks together.
        """
        jvm = self.spark._jvm
        for df, path in self.tables:
            if any(df is d for d in dfs):
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        gc.collect()
        jvm.System.gc()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes, modulo 2**64, of stretches of a number sequence, from one running sum."""

    def __init__(self, base: int = ODD):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def stretches(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        total = np.zeros(n, np.uint64)
        np.cumsum(values * self.up[: n - 1], out=total[1:])
        return (total[ends] - total[starts]) * self.down[starts]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Words:
    """Words (runs of bytes other than blanks and control blanks) of the documents of a chunk."""

    data: np.ndarray  # bytes of all documents
    offsets: np.ndarray  # of the documents in them
    start: np.ndarray  # byte positions of the words
    end: np.ndarray
    first: np.ndarray  # number of the first word of each document, and one past the last
    hash: np.ndarray  # of each word

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its document."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))

    def windows(self, rolling: Rolling, size: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of ``size`` words that lie in one document."""
        at = np.flatnonzero(self.room() >= size)
        return at, mix(rolling.stretches(self.hash if values is None else values, at, at + size))


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return free memory to the system. A Python worker outlives its task and would keep what the task needed at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def frugal(run):
    """``run`` over batches, with its memory given back once it is through and its arrays are gone."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of text, one row at least."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = byte_view(batch.column(column))[1][1:]
            row = 0
            while row < batch.num_rows:
                done = ends[row - 1] if row else 0
                stop = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
                yield batch.slice(row, stop - row)
                row = stop
            give_back()
    finally:
        give_back()


def words_of(texts: pa.Array, rolling: Rolling) -> Words:
    data, offsets = byte_view(texts)
    gap = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    start, end = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))[data]
    hashes = mix(rolling.stretches(values, start, end) + (end - start).astype(np.uint64))
    return Words(data, offsets, start, end, np.searchsorted(start, offsets), hashes)


def int_lists(values: np.ndarray, bounds: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values))


def batch_of(schema, **columns) -> pa.RecordBatch:
    """A record batch with the columns of a Spark schema, in its order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    arrays = [pa.array(columns[f.name]) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in target]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, target)], schema=target)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label) per node, label the smallest node.

    Every round each node takes the smallest label among its neighbours and follows that label's own label, until nothing
    changes. Labels are longs; partial aggregation keeps a node with many edges from filling one task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = labels.join(near, "node").join(hop, "label")
        new = F.least("label", "near", "far")
        following = materialize(step.select("node", new.alias("label"), (new < F.col("label")).alias("moved")))
        if not following.agg(F.max("moved")).first()[0]:
            return following.select("node", "label")
        labels = following.select("node", "label")
