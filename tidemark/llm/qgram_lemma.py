"""Benchmark decontamination with the q-gram lemma.

An occurrence of an item of m characters with at most k edits keeps at least m - q + 1 - k q of the item's q-grams, and all of
them lie on 2 k + 1 neighbouring diagonals (position in the document minus position in the item). So shared q-grams are counted
in diagonal bands twice that wide, each overlapping half of the next; only bands that reach the bound are aligned, and only
inside the band. The benchmark is a query set that is taken to the documents in blocks of bounded size. The longest q for which the
lemma still asks an item for one shared q-gram is its length over its edits plus one; items have it up to Q, and each q its own index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import Rolling, chunks, frugal, mix

Q = 8  # for items of 40 characters and more; shorter ones have what their edits allow
EDIT_SHARE = 0.1  # edits allowed per character of the item
BLOCK_CHARS = 4_000_000  # benchmark text that one pass over the documents carries
FILTER_BITS = 21


def normalised(text: Column) -> Column:
    """Lower case, one space for any white space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(size: int, edit_share: float = EDIT_SHARE) -> int:
    return int(size * edit_share)


class Index:
    """q-grams of the items of a block that share a q: hash -> (item, position), with the edit budgets and bounds of the items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edit_share: float = EDIT_SHARE):
        self.q, self.rolling = q, Rolling()
        self.items = items
        self.points = [_points(t) for _, t in self.items]
        sizes = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.array([budget(n, edit_share) for n in sizes.tolist()], np.int64)
        self.bound = sizes - q + 1 - self.edits * q
        self.sizes = sizes
        hashes = [self.hash(p) for p in self.points] or [np.zeros(0, np.uint64)]
        item = np.repeat(np.arange(len(sizes)), [len(h) for h in hashes[: len(sizes)]])
        at = np.concatenate([np.arange(len(h)) for h in hashes])
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes, kind="stable")
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.item, self.at = item[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - FILTER_BITS)] = True

    def hash(self, points: np.ndarray) -> np.ndarray:
        n = len(points) - self.q + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        at = np.arange(n)
        return mix(self.rolling.stretches((points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), at, at + self.q))

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, position in the item) of all shared q-grams."""
        hashes = self.hash(points)
        position = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(position) or not len(self.keys):
            return (np.zeros(0, np.int64),) * 3
        row = np.minimum(np.searchsorted(self.keys, hashes[position]), len(self.keys) - 1)
        same = self.keys[row] == hashes[position]
        position, row = position[same], row[same]
        n = self.first[row + 1] - self.first[row]
        flat = np.repeat(self.first[row] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(position, n), self.item[flat], self.at[flat]

    def regions(self, points: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of runs of bands that reach the bound."""
        position, item, at = self.hits(points)
        width = 2 * self.edits[item] + 1
        band = (position - at) // width
        span = len(points) + 2 * int(self.sizes.max(initial=0)) + 4
        key = item * span + band + int(self.sizes.max(initial=0)) + 1
        found, counts = np.unique(key, return_counts=True)
        both = counts.copy()  # a band reaches over the next one
        both[:-1] += np.where(found[1:] == found[:-1] + 1, counts[1:], 0)
        open_ = found[both >= self.bound[found // span]]
        if not len(open_):
            return
        cut = np.flatnonzero(np.diff(open_) > 1) + 1
        for run in np.split(open_, cut):
            i = int(run[0] // span)
            w = int(2 * self.edits[i] + 1)
            low, high = (int(r % span) - int(self.sizes.max()) - 1 for r in (run[0], run[-1]))
            yield i, low * w, (high + 2) * w - 1


def indexes(items: list[tuple[int, str]], q: int = Q, edit_share: float = EDIT_SHARE) -> list[Index]:
    """An index for every q that the items ask for."""
    groups: dict[int, list[tuple[int, str]]] = {}
    for i, text in items:
        groups.setdefault(min(q, len(text) // (budget(len(text), edit_share) + 1)), []).append((i, text))
    return [Index(group, own, edit_share) for own, group in sorted(groups.items())]


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """Fewest edits of ``pattern`` against a stretch of ``text`` on diagonals low to high, and that stretch's end; None above ``most``."""
    m, n, wide = len(pattern), len(text), high - low + 1
    far = m + n + 1
    shift = max(0, -low)
    padded = np.full(shift + max(n, m + high + 1), 2**32 - 1, np.uint32)  # what lies outside equals no character
    padded[shift : shift + n] = text
    ends = low + np.arange(wide)
    row = np.where((ends >= 0) & (ends <= n), 0, far)
    steps = np.arange(wide)
    for i in range(1, m + 1):
        a = shift + i - 1 + low
        step = row + (padded[a : a + wide] != pattern[i - 1])
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - steps) + steps
        row = np.where((ends + i >= 0) & (ends + i <= n), row, far)
        if row.min() > most:
            return None
    best = int(row.argmin())
    return int(row[best]), low + best + m


def _search(items: list[tuple[int, str]], q: int, edit_share: float):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = indexes(items, q, edit_share)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes = np.array([len(t) + 1 for t in texts])
            begin = np.cumsum(sizes) - sizes
            points = _points("\0".join(texts))
            rows, found = [], []
            for index, i, low, high in ((x, *region) for x in every for region in x.regions(points)):
                m, k = int(index.sizes[i]), int(index.edits[i])
                # documents that the band runs through; a run of bands may touch two
                for row in range(max(0, int(np.searchsorted(begin, low, "right")) - 1), int(np.searchsorted(begin, high + m, "right"))):
                    text = texts[row]
                    start = text.find(index.items[i][1])
                    if start >= 0:
                        match = (0, start, start + m)
                    else:
                        own = points[begin[row] : begin[row] + len(text)]
                        got = banded_distance(index.points[i], own, max(low - int(begin[row]), -m), min(high - int(begin[row]), len(text)), k)
                        if got is None:
                            continue
                        edits, end = got
                        back = banded_distance(index.points[i][::-1], own[:end][::-1], 0, min(k, end), k)
                        match = (edits, end - (back[1] if back and back[0] <= edits else m), end)
                    rows.append(row)
                    found.append((index.items[i][0], *match))
            columns = np.array(found, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "text_hash")] + [pa.array(c) for c in columns],
                ["doc_id", "text_hash", "item_id", "edits", "start", "end"],
            )

    return run


def leaks(
    documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
    q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row (doc_id, item_id, edits, start, end, text_hash) per document and benchmark item found in it, at its best place.

    A document holds an item if some stretch of its normalised text is within ``edit_share`` edits per item character. Start and
    end are characters of the normalised text. Null and empty texts on either side match nothing; an item under ten characters is
    found as it is, in whatever word it stands. Equal items are found under each of their ids; repeated rows are searched and reported once per distinct row. Extra columns
    are ignored. With an empty table on either side the result is empty.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), normalised(F.col(item_text)).alias("text")).where("text <> ''").distinct()
    rows = documents.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, item_id long, edits long, start long, end long"
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        found = rows.mapInArrow(_search([(r["item_id"], r["text"]) for r in block.toLocalIterator()], q, edit_share), schema)
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "text_hash", "item_id").agg(F.min(F.struct("edits", "start", "end")).alias("best"))
    return best.select("doc_id", "item_id", "best.*", "text_hash")
