"""How the sources of a language differ in their words: in-mapper stripes.

Every task folds whole documents into stripes, one per language and term: in how many documents the term is and how often
each source has it. A task that holds MOST_ENTRIES of them spills the stripes as rows and goes on; Spark merges the stripes by
(language, term). The merged stripes, dealt in blocks of bounded size, meet the totals of their language and give the divergences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import Stored, byte_view, chunks
from tidemark.session import broadcast_if_small

MIN_DOCUMENTS = 30
SMOOTHING = 5
TOP_TERMS = 50
MOST_ENTRIES = 100_000  # (term, source) counts a task holds: about 50 MB
BLOCK_CELLS = 1 << 16  # terms times sources in one block
SOURCES_A_TILE = 256  # sources whose divergences one task works out
STRIPE = "lang string, term string, documents long, sources array<struct<source: string, n: long>>"

# Terms are runs of ASCII letters, lower-cased, and of all bytes of other characters; everything else becomes a blank.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Stripes:
    """Folded documents of one task."""

    def __init__(self):
        self.held: dict[tuple[str, bytes], list] = {}
        self.entries = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        for term, n in Counter(text.translate(LETTERS).split()).items():
            stripe = self.held.get((lang, term))
            if stripe is None:
                stripe = self.held[lang, term] = [0, {}]
            stripe[0] += 1
            counts = stripe[1]
            if source in counts:
                counts[source] += n
            else:
                counts[source] = n
                self.entries += 1

    def spill(self) -> pa.RecordBatch:
        sizes = np.cumsum([0, *[len(s[1]) for s in self.held.values()]])
        names = pa.array([name for s in self.held.values() for name in s[1]], pa.string())
        counts = pa.array([n for s in self.held.values() for n in s[1].values()], pa.int64())
        sources = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([names, counts], ["source", "n"]))
        columns = [
            pa.array([lang for lang, _ in self.held], pa.string()), pa.array([term for _, term in self.held], pa.binary()).cast(pa.string()),
            pa.array([s[0] for s in self.held.values()], pa.int64()), sources,
        ]
        self.held, self.entries = {}, 0
        return pa.RecordBatch.from_arrays(columns, ["lang", "term", "documents", "sources"])


def _folded(most_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = Stripes()
        for batch in chunks(batches):
            data, offsets = byte_view(batch.column("text"))
            data = data.tobytes()
            for i, (lang, source) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                stripes.fold(lang, source, data[offsets[i] : offsets[i + 1]])
                if stripes.entries >= most_entries:
                    yield stripes.spill()
        yield stripes.spill()

    return run


def merged_stripes(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(lang, term, sources) of the terms that enough documents of the language hold; documents has lang, source and text, none null.

    A stripe reaches the shuffle once per task and spill, so a frequent term has no more rows there than there are of those.
    """
    stripes = documents.select("lang", "source", "text").mapInArrow(_folded(most_entries), STRIPE)
    dealt = stripes.repartition("lang", "term")  # serves both aggregations
    entries = dealt.select("lang", "term", F.posexplode("sources").alias("i", "s"), "documents")
    once = F.when(F.col("i") == 0, F.col("documents")).otherwise(0)
    summed = entries.groupBy("lang", "term", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"), F.sum(once).alias("documents"))
    whole = summed.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return whole.where(F.col("documents") >= min_documents).select("lang", "term", "sources")


def share(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), by three steps of long division, so that no product passes 64 bits."""
    whole = np.asarray(total, np.int64) + SMOOTHING * terms
    rest, out = counts + SMOOTHING, np.zeros(counts.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def _divergences(top: int):
    def run(key, stripes: pa.Table, totals: pa.Table) -> pa.Table:
        lang, _, tile = (k.as_py() for k in key)
        if not totals.num_rows:
            raise ValueError(f"no totals for the language {lang!r}")
        row = totals.to_pylist()[0]
        names, held = [g["source"] for g in row["groups"]], np.array([g["n"] for g in row["groups"]], np.int64)
        mine = range(tile * SOURCES_A_TILE, min(len(names), (tile + 1) * SOURCES_A_TILE))
        terms = stripes.column("term").to_pylist()
        counts = np.zeros((len(terms), len(names)), np.int64)
        rows = {"source": [], "part": [], "item": [], "value": []}

        def add(source, part, items, values):
            rows["source"] += [source] * len(items)
            rows["part"] += [part] * len(items)
            rows["item"] += items
            rows["value"] += values

        if terms:
            sources = stripes.column("sources").combine_chunks()
            at = np.repeat(np.arange(len(terms)), pc.list_value_length(sources).to_numpy(zero_copy_only=False))
            flat = sources.flatten()
            spot = pc.index_in(flat.field("source"), value_set=pa.array(names, flat.field("source").type)).to_numpy(zero_copy_only=False)
            counts[at, spot] = flat.field("n").to_numpy(zero_copy_only=False)
            p, q = share(counts, held[None, :], row["terms"]), share(counts.sum(axis=1), held.sum(), row["terms"])
            place = np.empty(len(terms), np.int64)
            place[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
        for a in mine:
            far = np.abs(p - p[:, a : a + 1]).sum(axis=0).tolist() if terms else [0] * len(names)
            add(names[a], "pair", names[:a] + names[a + 1 :], far[:a] + far[a + 1 :])
            if terms:
                more = np.flatnonzero((counts[:, a] > 0) & (p[:, a] > q))
                value = p[more, a] - q[more]
                best = np.lexsort((place[more], -value))[:top]
                add(names[a], "term", [terms[t] for t in more[best]], value[best].tolist())
        n = len(rows["item"])
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.table({"lang": pa.array([lang] * n, pa.string()), **{c: pa.array(v, kind) for (c, v), kind in zip(rows.items(), kinds)}})

    return run


def source_divergences(
    documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS, most_entries: int = MOST_ENTRIES, block_cells: int = BLOCK_CELLS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for every (lang, source) that occurs; documents has text, lang and source.

    Part ``pair`` ranks the other sources of the language by the distance of their term shares, part ``term`` the terms that the
    source has more of than its language, ``top`` of them at most. Null text, lang and source count as ''. Repeated rows count
    each time. Equal values are ranked by the item's UTF-8 bytes. A language without a kept term gives pairs of value 0; a
    source that is alone in its language has no pair. Other columns are ignored, whatever their names; an empty table gives an
    empty result. Counts are exact up to 9 * 10**15 terms in a language.
    """
    store = Stored(documents.sparkSession)
    rows = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = store.keep(merged_stripes(rows, min_documents, most_entries))
    counts = kept.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("n"))
    groups = rows.select("lang", "source").distinct().join(counts, ["lang", "source"], "left").na.fill(0, ["n"])
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(terms, "lang", "left").na.fill(0, ["terms"])
    width = F.size("groups")
    totals = store.keep(totals.withColumns({
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") * width / block_cells)), "tiles": F.ceil(width / SOURCES_A_TILE)}))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sizes = broadcast_if_small(totals.select("lang", "blocks", "tiles"))
    left = kept.join(sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks")).withColumn("tile", numbers("tiles"))
    right = totals.withColumn("block", numbers("blocks")).withColumn("tile", numbers("tiles"))
    place = ["lang", "block", "tile"]
    found = left.select(*place, "term", "sources").groupBy(*place).cogroup(right.select(*place, "groups", "terms").groupBy(*place))
    parts = store.keep(found.applyInArrow(_divergences(top), "lang string, source string, part string, item string, value long"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = pairs.unionByName(parts.where("part = 'term'"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return ranked.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
