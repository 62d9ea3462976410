"""The first term of a dictionary that occurs in a text, for dictionaries of any size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.session import materialize

TERM_CHARS = 1 << 20  # characters of terms that every task may hold as an automaton: some tens of megabytes
EXACT = 64  # characters up to which a term of a larger dictionary meets the texts as a whole
PART_CHARS = 1 << 19  # characters of texts that meet a larger dictionary together, about; a longer text is a part of its own
MARK_BITS = 28  # a power of two: the most bits that mark the pieces of a dictionary, 32 MB
PROBES = 4  # bits that mark a piece
ODD = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2**64


def first_term(texts: DataFrame, terms: DataFrame, fields: list[str], text: str, out: str, term: str = "term", term_chars: int = TERM_CHARS) -> DataFrame:
    """Add ``out``: of the terms contained in the lower-cased text, the smallest struct of ``fields``, else null.

    ``fields`` includes ``term``. A dictionary of up to ``term_chars`` characters goes to the tasks, which walk each text once; a
    larger one meets them in parts, through hashes of the terms, see ``_joined``. Null terms are left out, an empty term occurs in every text,
    and a null text holds none.
    """
    known = materialize(terms.select(*fields).where(F.col(term).isNotNull()).distinct())
    size = known.agg(F.coalesce(F.sum(F.length(term) + 1), F.lit(0)).alias("n")).first()["n"]
    return _walked(texts, known, fields, text, out, term) if size <= term_chars else _joined(texts, known, fields, text, out, term)


def _walked(texts: DataFrame, known: DataFrame, fields: list[str], text: str, out: str, term: str) -> DataFrame:
    rows = sorted((tuple(r) for r in known.collect()), key=lambda r: [(x is not None, x) for x in r])
    at = fields.index(term)
    first: dict[str, int] = {}
    for i, row in enumerate(rows):
        first.setdefault(row[at], i)
    none = len(rows)
    anywhere = first.pop("", none)
    held = texts.sparkSession.sparkContext.broadcast(list(first.items()))

    @pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = ahocorasick.Automaton()
        for word, i in held.value:
            automaton.add_word(word, i)
        if len(automaton):
            automaton.make_automaton()

        def smallest(line):
            if line is None:
                return None
            best = min((i for _, i in automaton.iter(line)), default=none) if len(automaton) else none
            best = min(best, anywhere)
            return best if best < none else None

        for lines in batches:
            yield pd.Series([smallest(x) for x in lines], dtype="Int64")

    ranked = texts.sparkSession.createDataFrame([(i, row) for i, row in enumerate(rows)], _ranked_schema(known, out))
    return texts.withColumn("_place", place(F.lower(text))).join(F.broadcast(ranked), "_place", "left").drop("_place")


def _ranked_schema(known: DataFrame, out: str):
    from pyspark.sql.types import LongType, StructType

    return StructType().add("_place", LongType()).add(out, known.schema)


def _size(length: Column) -> Column:
    """Characters of a term that texts are searched for: all of a short one; of a longer one as many of its first as a power of two allows."""
    return F.when(length <= EXACT, length).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double")))).cast("int"))


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(32))


class _Stretches:
    """Hashes of the stretches of some lines, every one from two running sums. Different stretches may have one hash."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(x) for x in lines), np.int64, len(lines))
        up = np.full(len(points) + 1, ODD)
        down = np.full(len(points) + 1, np.uint64(pow(int(ODD), -1, 1 << 64)))
        up[0] = down[0] = 1
        up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self.total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])
        self.start = np.cumsum(sizes) - sizes
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from each to the end of its line

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mixed((self.total[at + size] - self.total[at]) * self.down[at] ^ _mixed(size.astype(np.uint64)))


def _pieces():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("word").to_pylist()
            found, sizes = _Stretches(lines), np.array(batch.column("size").to_pylist(), np.int64)
            piece = found.of(found.start, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(piece.view(np.int64)), batch.column("entry")], ["piece", "entry"])

    return run


def _hits(sizes: list[int], marks, mask: int):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        bits, found = np.frombuffer(marks.value, np.uint64), _Stretches(part.column("line").to_pylist())
        held = [np.zeros(0, np.uint64)]
        for size in sizes:
            hashes = found.of(np.flatnonzero(found.left >= size), np.array([size]))
            for i in range(PROBES):
                spot = ((hashes & np.uint64(mask)) + np.uint64(i) * (hashes >> np.uint64(32) & np.uint64(mask))) & np.uint64(mask)
                hashes = hashes[(bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)]
            held.append(np.unique(hashes))
        piece = np.unique(np.concatenate(held)).view(np.int64)
        return pa.table({"part": pa.array(np.full(len(piece), key[0].as_py(), np.int64)), "piece": pa.array(piece)})

    return run


def _marks(pieces: DataFrame) -> tuple[bytes, int]:
    """Bits of a fixed number that say which pieces some term may have: some are set for no term, none is missing. With the mask of their places."""
    n = pieces.count()
    mask = (1 << min(max(16, (32 * n).bit_length()), MARK_BITS)) - 1
    low, high = F.col("piece").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("piece", 32).bitwiseAND(F.lit(mask))
    spots = pieces.select(F.explode(F.array(*[(low + F.lit(i) * high).bitwiseAND(F.lit(mask)) for i in range(PROBES)])).alias("spot"))
    cells = spots.groupBy(F.shiftright("spot", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros((mask + 1) >> 6, np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out.tobytes(), mask


def _best(term: str):
    def run(texts: pa.Table, met: pa.Table) -> pa.Table:
        held, lines = met.column("entry").to_pylist(), texts.column("line").to_pylist()
        rows = sorted(range(len(held)), key=lambda i: [(x is not None, x) for x in held[i].values()])
        automaton = ahocorasick.Automaton()
        for place, i in enumerate(rows):
            automaton.add_word(held[i][term], place)
        best = [None] * len(lines)
        if rows:
            automaton.make_automaton()
            best = [min((place for _, place in automaton.iter(line)), default=None) for line in lines]
        some = [i for i, place in enumerate(best) if place is not None]
        entries = met.column("entry").take(pa.array([rows[best[i]] for i in some], pa.int64()))
        return pa.table({"key": texts.column("key").take(pa.array(some, pa.int64())), "_found": entries})

    return run


def _joined(texts: DataFrame, known: DataFrame, fields: list[str], text: str, out: str, term: str) -> DataFrame:
    """The different texts are dealt by hash into parts of about PART_CHARS characters. A part gives the hash of each of its stretches, once, that is
    as long as some term's piece (see ``_size``) and that the marks of all pieces let through; through these hashes it meets the terms that it may
    hold, and an automaton of them alone walks its texts. So what is shuffled follows the terms that a part holds, not its stretches,
    and no task holds more of the dictionary than one part's share."""
    from pyspark.sql.types import LongType, StringType, StructType

    words = materialize(known.where(F.length(term) > 0).groupBy(F.col(term).alias("word")).agg(F.min(F.struct(*fields)).alias("entry")))
    words = words.withColumn("size", _size(F.length("word")))
    sizes = sorted(r[0] for r in words.select("size").distinct().collect())  # EXACT and the powers of two beyond, at most
    line = F.lower(text)
    anywhere = known.where(F.col(term) == "").agg(F.min(F.struct(*fields)).alias("e")).select("e").scalar()
    entry = words.schema["entry"].dataType
    pieces = materialize(words.mapInArrow(_pieces(), StructType().add("piece", LongType()).add("entry", entry)))
    marks, mask = _marks(pieces.select("piece"))
    lines = texts.select(line.alias("line")).where("line is not null").distinct()
    parts = max(1, math.ceil((lines.agg(F.sum(F.length("line") + 1)).first()[0] or 0) / PART_CHARS))
    lines = lines.select(F.pmod(F.xxhash64("line"), F.lit(parts)).alias("part"), F.md5("line").alias("key"), "line")
    hits = lines.groupBy("part").applyInArrow(_hits(sizes, texts.sparkSession.sparkContext.broadcast(marks), mask), "part long, piece long")
    met = hits.join(pieces, "piece").select("part", "entry")
    found = lines.groupBy("part").cogroup(met.groupBy("part")).applyInArrow(_best(term), StructType().add("key", StringType()).add("_found", entry))
    best = F.when(line.isNotNull(), F.least("_found", anywhere))
    return texts.withColumn("_key", F.md5(line)).join(found.withColumnRenamed("key", "_key"), "_key", "left").withColumn(out, best).drop("_key", "_found")
