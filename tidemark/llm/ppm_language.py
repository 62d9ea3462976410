"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts up to ORDER long with the counts of the bytes that followed. In a context, a byte seen
there costs -log2(count / (total + distinct)); any other byte costs the escape, -log2(distinct / (total + distinct)), and is coded
by the context one byte shorter, where the bytes already ruled out are excluded. Below order 0 all bytes are alike. The statistics
are frozen after training, so the exact code length of each (context, byte) is computed once into a table of all languages, and a
text's code length is a sum of table entries. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import byte_view, chunks, frugal

ORDER = 3
TRAIN_BYTES = 4_000_000  # of training text per language, at most, on average over the hash that picks the documents
MIN_CONTEXT = 4  # contexts seen less often, in all languages together, are left to the shorter one
PAD = 0x0A  # stands before a text
FOLDS, HELD_OUT_FOLD = 4, 2
UNKNOWN = "und"


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with ORDER pad bytes before each text, and each text's first byte position."""
    data, offsets = byte_view(pc.utf8_lower(texts))
    n = len(offsets) - 1
    out = np.full(len(data) + ORDER * n, PAD, np.uint8)
    shift = ORDER * np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, offsets[:-1] + ORDER * np.arange(1, n + 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language of (context, byte), as one number of four bytes."""
    for batch in chunks(batches):
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        data, first = _padded(batch.column("text"))
        wide = data.astype(np.uint32)
        grams = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        inside = np.ones(len(data), bool)
        inside[(first[:, None] - np.arange(1, ORDER + 1)).reshape(-1)] = False
        row = np.searchsorted(first, np.arange(len(data)), side="right") - 1
        inside, row = inside[3:], row[3:]
        for lang in np.unique(langs):
            found, counts = np.unique(grams[inside & (langs[row] == lang)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


@dataclass
class Model:
    """Frozen context trees of all languages, laid out for table lookup."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; bytes never seen in training share the last one
    two: np.ndarray  # (symbol, symbol) -> node of that context, 0 where it is not kept
    three: np.ndarray  # (node of two, symbol) -> node
    cost: np.ndarray  # (language, node * symbols + symbol) -> bits; nodes 1 .. symbols are the contexts of one symbol

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length in bits, (texts, languages)."""
        data, first = _padded(texts)
        n = len(first)
        ends = np.append(first[1:] - ORDER, len(data))
        out = np.zeros((n, len(self.langs)))
        full = np.flatnonzero(ends > first)
        if not len(full):
            return out
        symbols = int(self.symbol.max()) + 1
        s = self.symbol[data].astype(np.int64)
        two, three = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        two[1:] = self.two[s[:-1] * symbols + s[1:]]
        three[2:] = self.three[two[1:-1] * symbols + s[2:]]
        node = np.where(three > 0, three, np.where(two > 0, two, s + 1))
        at = np.zeros(len(s), np.int64)
        at[1:] = node[:-1] * symbols + s[1:]
        cuts = np.stack([first[full], ends[full]], 1).reshape(-1)
        open_end = cuts[-1] == len(s)
        for i in range(len(self.langs)):
            sums = np.add.reduceat(self.cost[i][at].astype(np.float64), cuts[:-1] if open_end else cuts)
            out[full, i] = sums[::2]
        return out


def _tree_costs(grams: np.ndarray, counts: np.ndarray, contexts: list[np.ndarray], symbols: int) -> np.ndarray:
    """Probabilities (node, symbol) of one language for all kept contexts of orders 1, 2 and 3, shorter first.

    ``grams`` are the symbol quadruples as numbers in base ``symbols``; a context of order k is a number of k digits.
    """
    rare = 256 - (symbols - 1)  # bytes behind the last symbol

    def refined(keys: np.ndarray, shorter: np.ndarray, order: int) -> np.ndarray:
        digits = symbols ** (order + 1)
        found, inverse = np.unique(grams % digits, return_inverse=True)
        n = np.bincount(inverse, counts, len(found))
        row = np.searchsorted(keys, found // symbols)
        known = (row < len(keys)) & (keys[np.minimum(row, len(keys) - 1)] == found // symbols)
        seen = np.zeros((len(keys), symbols))
        seen[row[known], (found % symbols)[known]] = n[known]
        total, distinct = seen.sum(1, keepdims=True), (seen > 0).sum(1, keepdims=True)
        ruled_out = np.where(seen > 0, shorter, 0).sum(1, keepdims=True)
        escape = distinct / np.maximum(total + distinct, 1)
        below = np.where(seen > 0, 0, shorter) / np.maximum(1 - ruled_out, 1e-12)
        out = np.where(seen > 0, seen / np.maximum(total + distinct, 1), escape * below)
        return np.where(total > 0, out, shorter)

    uniform = np.full((1, symbols), 1 / 256)
    uniform[0, -1] = rare / 256
    root = refined(np.zeros(1, np.int64), uniform, 0)
    one = refined(np.arange(symbols), np.repeat(root, symbols, 0), 1)
    two = refined(contexts[0], one[contexts[0] % symbols], 2)
    # a context of three whose last two symbols are no kept context takes over from the last one
    tail = contexts[1] % symbols**2
    row = np.minimum(np.searchsorted(contexts[0], tail), max(len(contexts[0]) - 1, 0))
    has = contexts[0][row] == tail if len(contexts[0]) else np.zeros(len(tail), bool)
    shorter = np.where(has[:, None], two[row] if len(contexts[0]) else 0, one[contexts[1] % symbols])
    three = refined(contexts[1], shorter, 3)
    out = np.concatenate([root, one, two, three])
    out[:, -1] /= rare  # one particular byte of those never seen
    return out


def build(counted: pa.Table, min_context: int = MIN_CONTEXT) -> Model:
    """The model from (lang, gram, n)."""
    langs = sorted(set(counted.column("lang").to_pylist()))
    lang = np.array([langs.index(x) for x in counted.column("lang").to_pylist()], np.int64)
    gram, n = counted.column("gram").to_numpy().astype(np.int64), counted.column("n").to_numpy().astype(np.float64)
    digits = [(gram >> shift) & 255 for shift in (24, 16, 8, 0)]
    seen = np.unique(np.concatenate(digits + [np.array([PAD])]))
    symbol = np.full(256, len(seen), np.int64)
    symbol[seen] = np.arange(len(seen))
    symbols = len(seen) + 1
    coded = np.zeros(len(gram), np.int64)
    for d in digits:
        coded = coded * symbols + symbol[d]

    def kept(keys: np.ndarray) -> np.ndarray:
        found, inverse = np.unique(keys, return_inverse=True)
        return found[np.bincount(inverse, n, len(found)) >= min_context]

    contexts = [kept(coded // symbols % symbols**2), kept(coded // symbols)]
    two = np.zeros(symbols * symbols, np.int64)
    two[contexts[0]] = 1 + symbols + np.arange(len(contexts[0]))
    contexts[1] = contexts[1][two[contexts[1] // symbols] > 0]
    three = np.zeros((1 + symbols + len(contexts[0])) * symbols, np.int64)
    three[two[contexts[1] // symbols] * symbols + contexts[1] % symbols] = 1 + symbols + len(contexts[0]) + np.arange(len(contexts[1]))
    cost = []
    for i in range(len(langs)):
        own = lang == i
        cost.append(-np.log2(_tree_costs(coded[own], n[own], contexts, symbols)).astype(np.float32).reshape(-1))
    return Model(langs, symbol, two, three, np.stack(cost))


def fold(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS))


def train(rows: DataFrame, train_bytes: int = TRAIN_BYTES, min_context: int = MIN_CONTEXT) -> Model | None:
    """Fit on the labelled rows (doc_id, text, lang): whole documents picked by a hash of id and text, about ``train_bytes`` per
    language. None if nothing is labelled. The driver gets counts of byte quadruples, which that bound limits."""
    rows = rows.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, train_bytes / max(n, 1)) * 1_000_000))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")])
    counted = picked.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return build(counted, min_context) if counted.num_rows else None


def _score(parts, names: list[str]):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*parts.value)
        langs = np.array(m.langs, object)
        for batch in chunks(batches):
            bits = m.bits(batch.column("text"))
            size = np.diff(byte_view(batch.column("text"))[1])
            best = bits.argmin(1)
            least = bits[np.arange(len(bits)), best]
            with np.errstate(over="ignore", under="ignore"):
                share = 1 / np.exp2(least[:, None] - bits).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(langs[best], pa.string()), pa.array(share), pa.array(least / np.maximum(size, 1))],
                names + ["lang_pred", "score", "bits_per_byte"],
            )

    return run


def identify(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", train_bytes: int = TRAIN_BYTES, whole_rows: bool = False
) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score, bits_per_byte) per input row; with ``whole_rows`` also the input row as the
    struct ``row``.

    Learns from the labelled documents outside the held-out fold; the label is no input of a prediction. score is the winner's
    posterior under equal priors. Null texts and texts without a letter get ``und``, score 0 and null bits; so does everything
    when nothing is labelled. Ties go to the first language by name. A null id is in no fold that is held out. Repeated rows each
    give a row; extra columns are ignored.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    held = F.coalesce(fold() == HELD_OUT_FOLD, F.lit(False))
    model = train(rows.where(~held), train_bytes)
    lettered = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    carried = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if whole_rows else []
    rows = documents.select(*[F.col(c).alias(n) for c, n in ((id_column, "doc_id"), (text_column, "text"))], *carried)
    flagged = rows.select("doc_id", held.alias("held_out"), "text", lettered.alias("lettered"), *(["row"] if whole_rows else []))
    names = [c for c in flagged.columns if c != "text"]
    unknown = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte")]
    if model is None:
        return flagged.select("doc_id", "held_out", *unknown, *(["row"] if whole_rows else []))
    kinds = ", ".join(f"{n} {t}" for n, t in flagged.dtypes if n != "text")
    shared = documents.sparkSession.sparkContext.broadcast((model.langs, model.symbol, model.two, model.three, model.cost))
    scored = flagged.mapInArrow(_score(shared, names), f"{kinds}, lang_pred string, score double, bits_per_byte double")
    known = F.col("lettered")
    return scored.select(
        "doc_id", "held_out", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, F.col("score")).otherwise(0.0).alias("score"), F.when(known, F.col("bits_per_byte")).alias("bits_per_byte"),
        *(["row"] if whole_rows else []),
    )
