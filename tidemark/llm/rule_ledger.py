"""Quality rules as a ledger: every rule is evaluated once per document into one failure bit, next to its measurements.

Policies are versions of a bit mask over the rules, so a new policy, or the question what a rule alone rejects, reads the ledger
and never the text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import Rolling, chunks, mix, words_of
from tidemark.llm.common import GOLDEN

REPEAT_WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

# Failure conditions; the position is the bit. Append only: stored ledgers keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
]
# Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines"],
    "v2": ["few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"],
}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _repeated(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its (doc, key) occurs twice or more, and whether it is not the first of them."""
    if not len(doc):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    later, several = np.zeros(len(d), bool), np.zeros(len(d), bool)
    later[order[1:]] = same
    several[order[1:]] = same
    several[order[:-1]] |= same
    return several, later


def _measure(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in chunks(batches):
            words = words_of(batch.column("text"), rolling)
            n, data, offsets = batch.num_rows, words.data, words.offsets
            per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
            level = np.zeros(len(data) + 1, np.int8)
            level[words.start] += 1
            level[words.end] -= 1
            in_word = np.cumsum(level[:-1], dtype=np.int8) > 0
            # lines: stretches between newlines; a newline at a document's end opens no line with a word
            cut = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
            begin, stop = cut[:-1], cut[1:].copy()
            stop -= data[stop - 1] == 0x0A if len(stop) else 0
            begin, stop = begin[begin < stop], stop[begin < stop]
            with_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
            begin, stop = begin[with_word], stop[with_word]
            bytes_ = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))[data]
            lines = mix(rolling.stretches(bytes_, begin, stop) + (stop - begin).astype(np.uint64))
            line_doc = np.searchsorted(offsets, begin, side="right") - 1
            later = _repeated(line_doc, lines)[1]
            at, hashes = words.windows(rolling, REPEAT_WINDOW)
            several = at[_repeated(words.doc[at], hashes)[0]]
            covered = np.zeros(len(words.start) + REPEAT_WINDOW + 1, np.int64)
            np.add.at(covered, several, 1)
            np.add.at(covered, several + REPEAT_WINDOW, -1)
            covered = np.cumsum(covered)[: len(words.start)] > 0
            values = {
                "n_words": words.count,
                "word_chars": per_doc(in_word & ((data & 0xC0) != 0x80)),
                "n_symbols": per_doc(_SYMBOLS[data]),
                "n_lines": np.bincount(line_doc, minlength=n),
                "n_dup_lines": np.bincount(line_doc[later], minlength=n),
                "n_repeat_words": np.bincount(words.doc[covered], minlength=n),
            }
            carried = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(carried + [pa.array(values[m].astype(np.int64)) for m in MEASURES], names + MEASURES)

    return run


def failure_bits() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, rule) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, the measurements and ``failures``, a bit per failed rule.

    Words are runs of characters other than blanks and control blanks. A null or empty text has no words and fails the rule on
    few words only. Repeated rows each give a row; extra columns are ignored; an empty table gives an empty ledger.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(_measure(["doc_id"]), f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    return measured.withColumn("failures", failure_bits())


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that the policy keeps without it.

    Documents are first counted by failure pattern, at most 2 ** rules rows; everything else is bit arithmetic on those.
    """
    m = mask(policy)
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(m).cast("long")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    names = [name for name, _ in RULES]
    bits = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("b")
    each = patterns.select("pattern", "n", bits).select("pattern", "n", "b.*")
    without = F.col("pattern").bitwiseAND(F.bitwise_not("bit"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        total(F.col("pattern").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("pattern") == F.col("bit")).alias("only_this"),
        total(without == 0).alias("kept_without"),
    )
