"""SimHash near duplicates: fingerprints of word shingles, compared exactly in tiles.

Two fingerprints within ``radius`` bits differ in at most ``radius`` of their 32 bit pairs. With the pairs dealt into radius + 1
parts, one part at least has the same population count in every pair, so only fingerprints of one cell (part, its population
counts) are compared. Inside a cell they lie in tiles ordered by population count of the whole; two tiles meet in one numpy
exclusive-or and bit count unless their population counts differ by more than the radius. Cells too large for one task are
cut into tiles by population count and the tile pairs are dealt over the tasks. A comparison gives each fingerprint one
link to a smallest position it is connected with, so a dense group of m gives m links a cell and not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import Stored, byte_view, chunks, components
from tidemark.session import broadcast_if_small

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 256  # fingerprints a side in one exclusive-or: 64 thousand comparisons
CELL = 2048  # fingerprints that one task holds of a cell; larger cells are cut
LOW_BITS = 0x5555555555555555  # the lower bit of every pair


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and split at the six ASCII blanks
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    line, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w) + 1
        ends.append(at - 1)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = byte_view(batch.column("text"))
            data = data.tobytes()
            votes = np.zeros((batch.num_rows, 64), np.int64)
            counts = np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                hashes = np.array(shingle_hashes(data[offsets[i] : offsets[i + 1]], size), "<u8")
                counts[i] = len(hashes)
                for part in range(0, len(hashes), 1 << 16):
                    lanes = hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
                    votes[i] += np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            prints = np.packbits(2 * votes > counts[:, None], axis=1, bitorder="little").view("<i8").reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], ["doc_id", "print"])

    return run


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint as a long; a text without words, null too, has zero."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_prints(shingle), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long")


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give connected positions the same label, the smallest of them."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while (label[label] != label).any():
            label[:] = label[label]


def tile_links(prints: np.ndarray, others: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that connect what lies within the radius: among the fingerprints, or between them and others."""
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    left = right = prints[order]
    shift = 0
    if others is not None:
        right, shift = others[np.argsort(np.bitwise_count(others), kind="stable")], len(left)
    low, high = np.bitwise_count(left).astype(int), np.bitwise_count(right).astype(int)
    label = np.arange(len(left) + (len(right) if shift else 0))
    for i in range(0, len(left), tile):
        rows = left[i : i + tile]
        for j in range(0 if shift else i, len(right), tile):
            columns = right[j : j + tile]
            if high[j] - low[i + len(rows) - 1] > radius:
                break
            if low[i] - high[j + len(columns) - 1] > radius:
                continue
            a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ columns[None, :]) <= radius)
            _join(label, a + i, b + j + shift)
    every = np.concatenate([left, right]) if shift else left
    moved = np.flatnonzero(label != np.arange(len(label)))
    return every[moved], every[label[moved]]


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.split(flat, np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))[:-1])


def _compared(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = _lists(batch.column("prints")), _lists(batch.column("others"))
            found = [tile_links(p, o if len(o) else None, radius) for p, o in zip(*sides)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)], ["a", "b"])

    return run


def cells(radius: int = RADIUS) -> Column:
    """Array of (part, key): the population counts of the bit pairs of each part."""
    high = F.shiftrightunsigned("print", 1)
    one, two = F.col("print").bitwiseXOR(high).bitwiseAND(F.lit(LOW_BITS)), F.col("print").bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS))
    counts = one.bitwiseOR(F.shiftleft(two, 1))  # 0, 1 or 2 in every pair
    edges = [round(32 * i / (radius + 1)) for i in range(radius + 2)]
    masks = [sum(3 << (2 * k) for k in range(a, b)) for a, b in zip(edges, edges[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("part"), counts.bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])


def close_links(prints: DataFrame, store: Stored, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(a, b): links that connect all different fingerprints (print) within the radius, directly or through others."""
    if not 0 <= radius < 32:
        raise ValueError(f"the radius must be between 0 and 31, got {radius}")
    members = prints.select("print", F.explode(cells(radius)).alias("cell")).select("cell.part", "cell.key", "print")
    place = ["part", "key"]
    large = store.keep(members.groupBy(*place).agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > cell).select(*place))
    nothing = F.array().cast("array<long>")
    small = members.join(broadcast_if_small(large), place, "left_anti").groupBy(*place).agg(F.collect_list("print").alias("prints"))
    links = small.where(F.size("prints") > 1).select("prints", nothing.alias("others")).mapInArrow(_compared(radius), "a long, b long")
    if large.isEmpty():
        return links
    cut = members.join(broadcast_if_small(large), place).withColumn("ones", F.bit_count("print"))
    levels = cut.groupBy(*place, "ones").agg(F.ceil(F.count(F.lit(1)) / cell).alias("pieces"))
    cut = cut.join(broadcast_if_small(store.keep(levels)), [*place, "ones"]).withColumn("piece", F.pmod(F.xxhash64("print"), "pieces"))
    tiles = store.keep(cut.groupBy(*place, "ones", "piece").agg(F.collect_list("print").alias("prints")))
    ids = tiles.select(F.struct(*place, "ones", "piece").alias("tile"))
    reach = ids.select(F.col("tile").alias("first"), *[F.col(f"tile.{c}") for c in place], F.explode(F.sequence(F.col("tile.ones"), F.col("tile.ones") + radius)).alias("ones"))
    pairs = reach.join(ids.select(F.col("tile").alias("second"), "tile.*"), [*place, "ones"]).where("first <= second").select("first", "second")
    held = tiles.select(F.struct(*place, "ones", "piece").alias("tile"), "prints")
    sides = pairs.repartition("first", "second").join(held.withColumnsRenamed({"tile": "first"}), "first")
    sides = sides.join(held.select(F.col("tile").alias("second"), F.col("prints").alias("others")), "second")
    sides = sides.select("prints", F.when(F.col("first") == F.col("second"), nothing).otherwise(F.col("others")).alias("others"))
    return links.union(sides.mapInArrow(_compared(radius), "a long, b long"))


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, cell: int = CELL,
) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per input row.

    component_id is the smallest id among all rows that links of at most ``radius`` differing bits reach, its own included; null
    ids count only where there is no other. Equal texts share a fingerprint and so a component; a text with fewer words than a
    shingle is one shingle; texts without a word, null or empty, have the fingerprint zero and link like any other. Repeated rows
    each give a row. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    store = Stored(documents.sparkSession)
    rows = store.keep(fingerprints(documents, id_column, text_column, shingle))
    prints = store.keep(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    labels = components(store.keep(close_links(prints, store, radius, cell)))
    linked = store.keep(prints.join(labels, F.col("print") == F.col("node")).select("print", "label", "least"))
    reached = linked.groupBy("label").agg(F.min("least").alias("reached"))
    wider = linked.join(broadcast_if_small(store.keep(reached)), "label").select("print", "reached")
    ids = store.keep(prints.join(wider, "print", "left").select("print", F.coalesce("reached", "least").alias("component_id")))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return rows.join(broadcast_if_small(ids), "print").select("doc_id", hexed, "component_id")
