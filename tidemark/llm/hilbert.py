"""Sharding in Hilbert-curve order, with DataFrame functions only.

Each metadata dimension is quantised into 2 ** BITS ranges at its own quantiles; the ranges' numbers are the coordinates of a cell,
and the cell's index on the Hilbert curve orders the rows. Neighbours on the curve are neighbours in every dimension, so a shard,
which is a run of the curve, covers a narrow box and a file's minima and maxima prune on all dimensions at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import Stored
from tidemark.operators.ranking import cumulative_counts

BITS = 3
SHARDS = 16
ROWS_PER_PART = 100_000  # rows of one cell that one task ranks
QUANTILE_ACCURACY = 10_000


def string_cuts(rows: DataFrame, column: str, steps: list[float]) -> list[str]:
    """Values of the column at the given shares of all its rows, without nulls; whole values, so that common beginnings don't matter. The
    driver sees one row per share."""
    values = rows.select(F.col(f"`{column}`").alias("v")).where("v is not null")
    total = values.count()
    shares = F.array(*[F.lit(s * total) for s in steps])
    upto = F.col("n_before") + F.col("n")
    held = cumulative_counts(values, "v").select("v", F.explode(F.filter(shares, lambda s: (F.col("n_before") <= s) & (upto > s))).alias("s"))
    return [r["v"] for r in sorted(held.collect(), key=lambda r: r["s"])]


def curve_index(coordinates: list[Column], bits: int = BITS) -> tuple[Column, Column]:
    """Hilbert index of a cell as a fold over the column ``_digits``, and that column. Level by level, from the highest bits, the bits of all dimensions are one digit; the state (entry
    corner e, direction d) turns the digit into the curve's order in that corner, and the digit's place gives the next state."""
    n = len(coordinates)
    full = (1 << n) - 1
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    trailing = lambda i: ((i ^ (i + 1)).bit_length() - 1) % n  # set bits at the end
    entry = [gray[2 * ((i - 1) // 2)] if i else 0 for i in range(1 << n)]
    turn = [0 if i == 0 else trailing(i - 1) if i % 2 == 0 else trailing(i) for i in range(1 << n)]
    place = [gray.index(i) for i in range(1 << n)]
    array = lambda values: "array(" + ",".join(map(str, values)) + ")"
    k = f"((s.d + 1) % {n})"
    turned = f"((shiftright(l ^ s.e, {k}) | shiftleft(l ^ s.e, {n} - {k})) & {full})"
    w = f"element_at({array(place)}, {turned} + 1)"
    corner = f"element_at({array(entry)}, {w} + 1)"
    step = f"""named_struct(
        'e', (s.e ^ (shiftleft({corner}, {k}) | shiftright({corner}, {n} - {k}))) & {full},
        'd', (s.d + element_at({array(turn)}, {w} + 1) + 1) % {n},
        'h', s.h * {1 << n} + {w})"""
    digits = F.array(*[
        sum((F.shiftright(c, level).bitwiseAND(F.lit(1)) * (1 << i) for i, c in enumerate(coordinates)), F.lit(0)).cast("int")
        for level in reversed(range(bits))
    ])
    return F.expr(f"aggregate(_digits, named_struct('e', 0, 'd', 0, 'h', 0), (s, l) -> {step}).h"), digits


def with_cells(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``cell``, the Hilbert index of the quantised dimensions; a null lies in the first range."""
    kinds = dict(rows.dtypes)
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = {d: F.col(f"`{d}`").cast("double") for d in dimensions if kinds[d] != "string"}
    cuts = rows.agg(*[F.percentile_approx(number, steps, QUANTILE_ACCURACY).alias(f"`{d}`") for d, number in numbers.items()]).first() if numbers else []
    bounds = {d: (F.col(f"`{d}`"), string_cuts(rows, d, steps)) for d in dimensions if kinds[d] == "string"}
    bounds |= {d: (number, [float(c) for c in cut or []]) for (d, number), cut in zip(numbers.items(), cuts)}
    coordinates = []
    for d in dimensions:
        value, cut = bounds[d]
        below = F.size(F.filter(F.array(*[F.lit(c) for c in cut]), lambda b: b < value)) if cut else F.lit(0)
        coordinates.append(F.when(value.isNull(), 0).otherwise(below).cast("int"))
    index, digits = curve_index([F.col(f"_c{i}") for i in range(len(dimensions))], bits)
    placed = rows.select("*", *[c.alias(f"_c{i}") for i, c in enumerate(coordinates)])
    return placed.withColumn("_digits", digits).withColumn("cell", index).drop("_digits", *[f"_c{i}" for i in range(len(dimensions))])


def ranked(rows: DataFrame, tiebreak: list[str]) -> DataFrame:
    """Adds ``rank`` (from 0) in the order of ``cell``.

    Cells are counted, at most 2 ** (dimensions * BITS) rows; a cell with many rows is cut into parts by a hash, so each task ranks
    a bounded part and adds the rows before it. Which of two rows of one cell comes first is of no account to pruning.
    """
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select("cell", F.ceil(F.col("_n") / ROWS_PER_PART).alias("_parts"), (F.sum("_n").over(Window.orderBy("cell")) - F.col("_n")).alias("_cell_before"))
    dealt = rows.join(F.broadcast(cells), "cell").withColumn("_part", F.pmod(F.xxhash64(*tiebreak), F.col("_parts")))
    parts = dealt.groupBy("cell", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("cell", "_part", (F.sum("_n").over(Window.partitionBy("cell").orderBy("_part")) - F.col("_n")).alias("_part_before"))
    inside = F.row_number().over(Window.partitionBy("cell", "_part").orderBy(*tiebreak)) - 1
    placed = dealt.withColumn("_inside", inside).join(parts, ["cell", "_part"])
    rank = (F.col("_cell_before") + F.col("_part_before") + F.col("_inside")).cast("long")
    return placed.withColumn("rank", rank).drop("_parts", "_cell_before", "_part", "_part_before", "_inside")


def shard(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", dimensions: tuple[str, ...] = ("lang", "source"), shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, cell.

    The dimensions are the named columns, the text's size and the id. Shards are runs of the curve with row counts at most one
    apart (law ``rows``); slot is the place in the shard's run. A null text has size 1 and the checksum of no bytes; nulls in a
    dimension lie in its first range; repeated rows get places of their own; extra columns are ignored, and an empty table stays
    empty. Only these few numbers are written and shuffled, not the texts.
    """
    size = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long") + 1
    checksum = F.coalesce(F.crc32(F.col(text_column).cast("binary")), F.lit(0).cast("long"))
    rows = documents.select(F.col(id_column).alias("doc_id"), size.alias("size"), checksum.alias("text_crc32"), *[F.col(d).alias(f"by_{d}") for d in dimensions])
    rows = Stored(documents.sparkSession).keep(rows)
    total = rows.count()
    placed = ranked(with_cells(rows, [*[f"by_{d}" for d in dimensions], "size", "doc_id"], bits), ["doc_id", "text_crc32", "size"])
    number = F.expr(f"rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("_shard", number).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "cell",
    )
