"""Duplicate substrings by looking up windows in an index of the corpus itself, in place of a relative Lempel-Ziv parse.

The reference is the whole corpus. Its index is cut into blocks by seed hash (the partitions of the shuffles). A seed is the
smallest hash among the five-word stretches of a window, so equal windows hold equal seeds wherever they stand. Only seeds
that occur twice can start a factor of window length; the others are dropped after one count. Documents are then matched
against every block that holds one of their seeds: each window around a repeated seed is looked up in its block, which answers
with the first document that holds it. There is no greedy parse: a window with an earlier occurrence is marked, wherever that
lies, and the unions of marked windows are the duplicate spans. They are the stretches that factors of window length or more
could cover together, without the places where one factor would end and the next begin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Rolling, Words, chunks, mix, words_of
from tidemark.llm.common import SPACE, Stored

WINDOW = 20
SEED = 5
OTHER_BASE = 0xA0761D6478BD642F
LAST_ID = 2**63 - 1  # stands for a null id: after all others


def _sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``size`` values from each position on; the ends see fewer values."""
    out, width = values, 1
    while width < size:
        step = min(width, size - width)
        longer = out.copy()
        longer[:-step] = pick(out[:-step], out[step:])
        out, width = longer, width + step
    return out


def _seeds(words: Words, rolling: Rolling, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the seed of each window, and for each word position the seed that starts there (0 where none is chosen)."""
    n = len(words.start)
    stretch = np.full(n, 2**64 - 1, np.uint64)
    at, hashes = words.windows(rolling, seed)
    stretch[at] = hashes | np.uint64(1)
    starts = np.flatnonzero(words.room() >= window)
    span = window - seed + 1
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(n, np.uint64)
    least = _sliding(stretch, span, np.minimum)[starts]
    # A position is chosen when some window over it has its hash as minimum: the largest of those minima is its own hash.
    reached = np.zeros(n, np.uint64)
    reached[starts] = least
    largest = _sliding(reached[::-1].copy(), span, np.maximum)[::-1]
    return starts, least, np.where(largest == stretch, stretch, np.uint64(0))


def _unique_pairs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first of each (doc, key), and how often each occurs; positions ascend within equal pairs."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(d)))


def _emit_seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in chunks(batches):
            words = words_of(batch.column("text"), rolling)
            chosen = _seeds(words, rolling, window, seed)[2]
            at = np.flatnonzero(chosen)
            doc = words.doc[at]
            first, times = _unique_pairs(doc, chosen[at])
            ids = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(chosen[at][first].view(np.int64)), pa.array(ids[doc[first]]), pa.array(np.minimum(times, 2).astype(np.int8))], ["seed", "id", "times"]
            )

    return run


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of a list<long> column."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _within(doc: np.ndarray, key: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which (doc, key) are among the listed ones."""
    tag = lambda d, k: mix(k ^ mix(d.astype(np.uint64) + np.uint64(1)))
    return np.isin(tag(doc, key), tag(*listed))


def _emit_windows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, second = Rolling(), Rolling(OTHER_BASE)
        for batch in chunks(batches):
            words = words_of(batch.column("text"), rolling)
            starts, least, _ = _seeds(words, rolling, window, seed)
            doc = words.doc[starts]
            open_ = _within(doc, least, _listed(batch.column("seeds")))
            starts, doc = starts[open_], doc[open_]
            key = mix(rolling.stretches(words.hash, starts, starts + window))
            first, times = _unique_pairs(doc, key)
            check = mix(second.stretches(words.hash, starts[first], starts[first] + window)) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[first].view(np.int64)), pa.array(check.astype(np.uint32).view(np.int32)),
                    pa.array(batch.column("id").to_numpy()[doc[first]]), pa.array(times > 1),
                ],
                ["window", "check", "id", "again"],
            )

    return run


def _parse(window: int):
    """Duplicate spans and kept words of documents (doc_id, text, elsewhere, within, copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in chunks(batches):
            words = words_of(batch.column("text"), rolling)
            n = batch.num_rows
            elsewhere, within = _listed(batch.column("elsewhere")), _listed(batch.column("within"))
            gone = np.zeros(len(words.start) + 1, np.int64)
            spans = [[] for _ in range(n)]
            touched = np.zeros(n, bool)
            touched[elsewhere[0]] = touched[within[0]] = True
            starts, key = words.windows(rolling, window)
            copy = batch.column("copy").to_numpy(zero_copy_only=False)
            mine = (touched | copy)[words.doc[starts]]
            starts, key = starts[mine], key[mine]
            doc = words.doc[starts]
            copied = copy[doc] | _within(doc, key, elsewhere)
            local = np.flatnonzero(~copied & _within(doc, key, within))
            first = _unique_pairs(doc[local], key[local])[0]
            repeats = np.ones(len(local), bool)
            repeats[first] = False
            copied[local[repeats]] = True
            hit = starts[copied]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
            removed = np.cumsum(gone[:-1]) > 0 if len(words.start) else np.zeros(0, bool)
            edge = np.ones(len(removed), bool)
            edge[1:] = ~removed[:-1]
            edge[words.first[:-1][words.first[:-1] < len(removed)]] = True
            opened = np.flatnonzero(removed & edge)
            edge = np.ones(len(removed), bool)
            edge[:-1] = ~removed[1:]
            edge[words.first[1:][words.first[1:] > 0] - 1] = True
            closed = np.flatnonzero(removed & edge) + 1
            for a, b, d in zip(opened, closed, words.doc[opened] if len(opened) else []):
                spans[d].append({"start": int(a - words.first[d]), "end": int(b - words.first[d])})
            texts = kept_texts(words, ~removed)
            n_removed = np.bincount(words.doc, removed, n) if len(removed) else np.zeros(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.count), pa.array(n_removed.astype(np.int64)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([t.decode() for t in texts]),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return run


def kept_texts(words: Words, kept: np.ndarray) -> list[bytes]:
    """The kept words of each document, joined by one space."""
    size = len(words.data)
    level = np.zeros(size + 1, np.int8)
    level[words.start[kept]] += 1
    level[words.end[kept]] -= 1
    inside = np.cumsum(level[:-1], dtype=np.int8) > 0
    after = words.end[kept]
    after = after[after < size]
    after = after[SPACE[words.data[after]]]
    out = np.where(inside, words.data, np.uint8(0x20))
    inside[after] = True
    where = np.concatenate([[0], np.cumsum(inside)])[words.offsets]
    joined = out[inside].tobytes()
    return [joined[a:b].strip(b" ") for a, b in zip(where[:-1], where[1:])]


def duplicate_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept_sha256, spans, kept_text) per input row.

    A word goes if a window of ``window`` words over it also starts earlier: in a document with a smaller id, or earlier in the
    same one. Spans are word ranges, end exclusive. A null or empty text has no words and the hash of nothing. Null ids come
    after all others. Repeated rows are the same document and do not remove each other. Windows are compared by 96 hash bits.
    Extra columns are ignored; an empty table gives an empty result.
    """
    store = Stored(documents.sparkSession)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(F.col(id_column).cast("long"), F.lit(LAST_ID)).alias("id"))
    copies = store.keep(later_copies(rows))
    seeds = store.keep(rows.select("id", "text").mapInArrow(_emit_seeds(window, seed), "seed long, id long, times byte"))
    repeated = seeds.groupBy("seed").agg(F.sum("times").alias("n")).where("n > 1").select("seed")
    # the distinct repeated seeds of one document: no more than it has words
    open_ = seeds.join(repeated, "seed").groupBy("id").agg(F.collect_set("seed").alias("seeds"))
    open_ = store.keep(open_.join(copies, "id", "left_anti"))
    store.drop(seeds)
    found = rows.select("id", "text").join(open_, "id").mapInArrow(_emit_windows(window, seed), "window long, check int, id long, again boolean")
    found = store.keep(found)
    store.drop(open_)
    first = found.groupBy("window", "check").agg(F.min("id").alias("reference"), F.count(F.lit(1)).alias("n")).where("n > 1")
    elsewhere = found.join(first.drop("n"), ["window", "check"]).where("id > reference").select("id", "window", F.lit(True).alias("copied"))
    factors = elsewhere.union(found.where("again").select("id", "window", F.lit(False).alias("copied")))
    lists = factors.groupBy("id").agg(
        F.collect_set(F.when(F.col("copied"), F.col("window"))).alias("elsewhere"), F.collect_set(F.when(~F.col("copied"), F.col("window"))).alias("within")
    )
    lists = store.keep(lists.join(copies.withColumn("copy", F.lit(True)), "id", "full"))
    store.drop(found, copies)
    parsed = rows.join(lists, "id", "left").select("doc_id", "text", "elsewhere", "within", F.coalesce("copy", F.lit(False)).alias("copy"))
    return parsed.mapInArrow(
        _parse(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept_text string"
    )


def later_copies(rows: DataFrame) -> DataFrame:
    """(id) of the documents whose whole text stands in a document with a smaller id: one factor covers them.

    An id that comes with several texts is left to the general way.
    """
    texts = rows.where("text is not null").select("id", F.md5("text").alias("key"))
    one = texts.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key = other").select("id", "key")
    first = texts.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    return one.join(first, "key").where("id > first").select("id")
