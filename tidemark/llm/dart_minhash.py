"""Near duplicates by DartMinHash signatures, banded joining and an exact check.

A document is a weighted set: its five-word shingles with their numbers of occurrences. Each shingle owns the half-plane
(weight, rank); weight is cut into regions [0,1), [1,2), [2,4), [4,8)..., and into every region darts are thrown by a hash of
the shingle, the region and the dart's number, with exponential gaps along the rank. A dart counts if it lands below the
shingle's weight; it also carries a coordinate. The earliest dart of a coordinate is that coordinate's signature, so two
documents agree in a coordinate with the probability of their weighted Jaccard similarity. Only the few darts below a rank
limit are thrown: about k (ln k + 4) for a document of any length; where a coordinate stays empty the limit is doubled.

Documents that share a whole band are candidates. Copies of a text are one node. In a bucket every member is compared with a
few leaders at a time; what is left when that finds nothing more is compared by an exact shingle join; see ``linked``.

With ``native`` the same search runs on DataFrame functions only: plain MinHash of the shingles' occurrences takes the place of the darts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import sql_shingles
from tidemark.llm.common import GOLDEN, Rolling, Stored, chunks, components, frugal, mix, words_of

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES = 144  # 24 bands of 6: a pair at 0.8 is missed with probability 0.0007
BAND_ROWS = 6
CHUNK = 1 << 19  # bytes of text that a task turns into shingles at a time
LEADERS = 3  # of a bucket in a round; more make more pairs and fewer rounds


def shingles(words, rolling: Rolling, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, occurrences), ordered by document; a text shorter than a shingle is one shingle."""
    at, hashes = words.windows(rolling, size)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    tiny = mix(rolling.stretches(words.hash, words.first[short], words.first[short + 1]))
    doc = np.concatenate([words.doc[at], short]).astype(np.uint64)
    hashes = np.concatenate([hashes, tiny])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if not len(doc):
        return doc.astype(np.int64), hashes, np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at].astype(np.int64), hashes[at], np.diff(np.append(at, len(doc)))


def _throw(signature: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray) -> None:
    """Throw the darts of all elements whose rank is under the limit of their document; keep the earliest per coordinate."""
    k = signature.shape[1]
    flat = signature.reshape(-1)
    region, low, high = 0, 0.0, 1.0
    while True:
        own = np.flatnonzero(weight > low)
        if not len(own):
            return
        seed = mix(element[own] ^ mix(np.array([region + 1], np.uint64)))
        rank, number = np.zeros(len(own)), 0
        while len(own):
            number += 1
            dart = mix(seed + np.uint64((number * GOLDEN) & (2**64 - 1)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (high - low)
            alive = rank < limit[doc[own]]
            own, seed, rank, dart = own[alive], seed[alive], rank[alive], mix(dart[alive])
            height = low + (dart & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * (high - low)
            hit = height < weight[own]
            coordinate = (((dart[hit] >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, doc[own[hit]] * k + coordinate, rank[hit])
        region, low, high = region + 1, high, high * 2


def signatures(n: int, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Ranks of the earliest darts, one row per document; infinite for documents without elements."""
    out = np.full((n, k), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    open_ = total > 0
    darts = k * (np.log(k) + 4)
    while open_.any():
        mine = open_[doc]
        _throw(out, doc[mine], element[mine], weight[mine], darts / np.maximum(total, 1))
        open_ &= np.isinf(out).any(axis=1)
        darts *= 2
    return out


def _bands(rows: int, k: int, size: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in chunks(batches, CHUNK):
            found = shingles(words_of(batch.column("text"), rolling), rolling, size)
            ranks = signatures(batch.num_rows, *found, k)
            full = np.flatnonzero(~np.isinf(ranks).any(axis=1))
            nodes = batch.column("node").to_numpy(zero_copy_only=False)[full]
            cells = ranks[full].view(np.uint64).reshape(len(full), k // rows, rows)
            band = np.broadcast_to(np.arange(k // rows, dtype=np.uint64), cells.shape[:2]).copy()
            for r in range(rows):
                band = mix(band ^ cells[:, :, r]) + np.uint64(GOLDEN)
            columns = [pa.array(band.view(np.int64).reshape(-1)), pa.array(np.repeat(nodes, band.shape[1]))]
            yield pa.RecordBatch.from_arrays(columns, ["band", "node"])

    return run


def _similar(size: int, names: list[str]):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in chunks(batches, CHUNK):
            left = shingles(words_of(batch.column("text"), rolling), rolling, size)
            right = shingles(words_of(batch.column("other"), rolling), rolling, size)
            n = batch.num_rows
            doc, key, weight = (np.concatenate(x) for x in zip(left, right))
            order = np.lexsort((key, doc))
            doc, key, weight = doc[order], key[order], weight[order]
            same = np.flatnonzero((doc[1:] == doc[:-1]) & (key[1:] == key[:-1])) if len(doc) else np.zeros(0, int)
            shared = np.bincount(doc[same], np.minimum(weight[same], weight[same + 1]), n)
            total = np.bincount(doc, weight, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(shared / np.maximum(total - shared, 1))], [*names, "similarity"]
            )

    return run


def similarities(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, native: bool = False) -> DataFrame:
    """Adds the exact weighted Jaccard similarity to the pairs (node, leader, any other longs)."""
    other = texts.select(F.col("node").alias("leader"), F.col("text").alias("other"))
    names = pairs.columns
    # a leader of many pairs is a hot key, split in a join of Spark's own; the nodes deal the pairs evenly to the Python tasks
    sides = pairs.join(other, "leader").join(texts, "node").select(*names, "text", "other")
    if native:
        return sides.select(*names, sql_shingles.similarity(F.col("text"), F.col("other"), shingle).alias("similarity"))
    return sides.mapInArrow(_similar(shingle, names), ", ".join(f"{c} long" for c in names) + ", similarity double")


def band_rows(texts: DataFrame, shingle: int = SHINGLE, coordinates: int = COORDINATES, rows: int = BAND_ROWS) -> DataFrame:
    """(band, node): the band hashes of texts (node, text); copies in one task give equal rows."""
    return texts.select("node", "text").mapInArrow(_bands(rows, coordinates, shingle), "band long, node long")


def led(members: DataFrame) -> DataFrame:
    """The rows (band, node, shared, label, weight) of the buckets that hold several groups, with the bucket's leaders: of each
    LEADERS-th of the nodes the greatest by weight and label of its group and by the number of buckets it is in."""
    part = F.pmod("node", F.lit(LEADERS))
    tops = [F.max(F.when(part == i, F.struct("weight", "label", "shared", "node"))) for i in range(LEADERS)]
    several = members.groupBy("band").agg(F.array_compact(F.array(*tops)).alias("leaders"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return members.join(several.select("band", "leaders"), "band")


def _meetings(members: DataFrame) -> DataFrame:
    """(node, leader, label, weight, leader_label, leader_weight), once for each node and leader of other groups that share a bucket.

    The buckets of a node have mostly the same leaders, so their lists, LEADERS of each of its bands, become one per node before a row is made of each."""
    others = F.filter("leaders", lambda top: top["label"] != F.col("label"))
    met = members.select("node", "label", "weight", others.alias("leaders")).groupBy("node", "label", "weight")
    met = met.agg(F.array_distinct(F.flatten(F.collect_set("leaders"))).alias("leaders")).select("node", "label", "weight", F.explode("leaders").alias("top"))
    return met.select("node", F.col("top.node").alias("leader"), "label", "weight", F.col("top.label").alias("leader_label"), F.col("top.weight").alias("leader_weight"))


def _hooks(found: DataFrame) -> DataFrame:
    """(label, to_weight, to): the group that each group of the links joins. Of two linked groups the lesser by (weight, label)
    joins the greater, so there are no circles; it joins the greatest of them, or the one which that group joins in turn."""
    sides = F.struct("weight", "label"), F.struct(F.col("leader_weight").alias("weight"), F.col("leader_label").alias("label"))
    hook = found.select(F.least(*sides)["label"].alias("label"), F.greatest(*sides).alias("to")).groupBy("label").agg(F.max("to").alias("to"))
    further = hook.select(F.col("label").alias("via"), F.col("to").alias("further"))
    to = F.coalesce("further", "to")
    return hook.join(further, F.col("to.label") == F.col("via"), "left").select("label", to["weight"].alias("to_weight"), to["label"].alias("to"))


def _renamed(names: DataFrame, found: DataFrame) -> DataFrame:
    """The groups (node, label, weight) of the nodes after a round: one row per node, however many buckets it is in."""
    named = names.join(_hooks(found), "label", "left")
    return named.select("node", F.coalesce("to", "label").alias("label"), F.coalesce("to_weight", "weight").alias("weight"))


def _elements(size: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in chunks(batches, CHUNK):
            doc, key, weight = shingles(words_of(batch.column("text"), rolling), rolling, size)
            total = np.bincount(doc, weight, batch.num_rows).astype(np.int64)
            row = np.repeat(np.arange(len(doc)), weight)
            time = np.arange(len(row)) - np.repeat(np.cumsum(weight) - weight, weight)
            element = mix(key[row] ^ mix((time + 1).astype(np.uint64)))  # an occurrence of a shingle is an element of its own
            nodes, labels = (batch.column(c).to_numpy(zero_copy_only=False)[doc[row]] for c in ("node", "label"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes), pa.array(labels), pa.array(total[doc[row]]), pa.array(element.view(np.int64))], ["node", "label", "size", "element"]
            )

    return run


def overlapping(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, native: bool = False) -> DataFrame:
    """(node, leader, label, leader_label): every pair of nodes (node, label) of different labels that can reach the similarity.

    Two texts of a and b shingles at the similarity t share o = t / (1 + t) (a + b) of them at least, so they meet among the
    a - o + 1 rarest of the one and the b - o + 1 rarest of the other. What a template gives to texts that are too far apart by it
    alone lies behind these, so such texts do not meet through it.
    """
    held = nodes.join(texts, "node")
    store = Stored(texts.sparkSession)
    counted = store.keep(sql_shingles.element_rows(held, shingle) if native else held.mapInArrow(_elements(shingle), "node long, label long, size long, element long"))
    several = counted.groupBy("element").agg(F.count(F.lit(1)).alias("holders"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("holders", "element"))
    placed = counted.join(several, "element").withColumn("place", place).where("holders > 1")
    longest = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-6) + 1
    placed = store.keep(placed.where(F.col("place") <= longest).select("node", "label", "size", "element", "place"))
    share = similarity / (1 + similarity)
    # the rows of an element's most frequent label don't meet each other: every other row meets them and its like
    held = placed.groupBy("element", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("element").agg(F.max(F.struct("n", "label"))["label"].alias("top"))
    fewer = placed.join(held, "element").where(F.col("label") != F.col("top")).drop("top")
    named = {"node": "leader", "label": "leader_label", "size": "other_size", "place": "other_place"}
    met = placed.join(fewer.withColumnsRenamed(named), "element").where(F.col("label") != F.col("leader_label"))
    own, other = F.struct("size", "node", "label", "place"), F.struct(*[F.col(n).alias(c) for c, n in (("size", "other_size"), ("node", "leader"), ("label", "leader_label"), ("place", "other_place"))])
    # the smaller one of a pair is looked for by fewer of its elements
    pair = met.select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"))
    least = F.ceil(F.lit(share) * (F.col("a.size") + F.col("b.size")) - 1e-6)
    pair = pair.where(
        (F.col("a.place") <= F.col("a.size") - F.ceil(F.lit(2 * share) * F.col("a.size") - 1e-6) + 1)
        & (F.col("a.size") - F.col("a.place") + 1 >= least) & (F.col("b.size") - F.col("b.place") + 1 >= least)
    )
    return pair.select(F.col("a.node").alias("node"), F.col("b.node").alias("leader"), F.col("a.label").alias("label"), F.col("b.label").alias("leader_label")).distinct()


def linked(bands: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, native: bool = False) -> DataFrame | None:
    """(node, label): components of the similarity links among the members of shared bands; None where nothing is linked.

    A round compares in each bucket LEADERS leaders with all members of other groups, so a bucket of n copies gives a few n pairs
    and a large group is not walked through pair by pair. The leaders then leave the bucket, and buckets whose members are all in one
    group end. Rounds go on as long as one finds a link between groups anywhere; there is no limit to their number. A group is
    named by one of its members and follows the links of a round two steps far, which takes one pass; groups that are linked
    in longer ways meet again in a later round or stay apart, and the components of all links, taken once at the end, join them.
    """
    store = Stored(texts.sparkSession)
    groups = bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    shared = store.keep(bands.join(groups, "band").distinct())
    wanted = store.keep(shared.groupBy("node").agg(F.count(F.lit(1)).alias("shared")))
    texts = store.keep(texts.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    names = wanted.select("node", F.col("node").alias("label"), F.col("shared").alias("weight"))
    members = store.keep(led(shared.join(wanted, "node").withColumns({"label": F.col("node"), "weight": F.col("shared")})))
    links = None
    while not members.isEmpty():
        close = similarities(_meetings(members), texts, shingle, native).where(F.col("similarity") >= similarity)
        found = store.keep(close.select("label", "weight", "leader_label", "leader_weight"))
        if found.isEmpty():
            left = members.select("node", "label").distinct()
            close = similarities(overlapping(left, texts, similarity, shingle, native), texts, shingle, native).where(F.col("similarity") >= similarity)
            edges = store.keep(close.select(F.col("label").alias("a"), F.col("leader_label").alias("b")))
            if not edges.isEmpty():
                links = edges if links is None else links.union(edges)
            break
        edges = found.select(F.col("label").alias("a"), F.col("leader_label").alias("b"))
        links = edges if links is None else links.union(edges)
        names = store.keep(_renamed(names, found))
        rest = members.where("not exists(leaders, l -> l.node = node)").select("band", "node", "shared")
        members = store.keep(led(rest.join(names, "node")))
    return None if links is None else components(links)


def near_duplicate_classes(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", similarity: float = SIMILARITY,
    shingle: int = SHINGLE, coordinates: int = COORDINATES, rows: int = BAND_ROWS, native: bool = False,
) -> DataFrame:
    """One row (doc_id, class_id, is_first, text_hash) per input row.

    class_id is the smallest id of the class; is_first marks the rows that hold it. Classes are the components of the similarity
    graph. A null text is alone in its class; equal texts, the empty text too, are one class. Texts without words have no
    shingles and match only their copies. Texts are told apart by a 64-bit hash. Repeated rows each give a row; null ids come
    after all others. Extra columns are ignored. An empty table gives an empty result. With ``native``, which has bands of its own, no Python
    runs on the executors.
    """
    spark = documents.sparkSession
    every = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    every = every.withColumn("node", F.when(F.col("text").isNotNull(), F.xxhash64("text")))
    texts = every.where("text is not null").select("node", "text")
    bands = Stored(spark).keep(sql_shingles.band_rows(texts, shingle) if native else band_rows(texts, shingle, coordinates, rows))
    labels = linked(bands, texts, similarity, shingle, native)
    ids = every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    if labels is not None:
        named = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = named.groupBy("label").agg(F.min("class_id").alias("smallest"))
        ids = named.join(smallest, "label").select("node", F.col("smallest").alias("class_id"))
    out = every.select("doc_id", "node").join(ids, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), class_id.eqNullSafe(F.col("doc_id")).alias("is_first"), F.col("node").alias("text_hash"))
