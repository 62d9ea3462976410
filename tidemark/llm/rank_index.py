"""Fill-in-middle: a text is cut at two token boundaries and its parts change places.

The token boundaries of all texts of a chunk form one rising sequence of byte offsets. A learned index maps ranks to offsets:
straight segments, each as long as a line from its first point can stay within ERROR bytes of every boundary, and one small
residual per boundary. A cut is predicted from its segment and put right by its residual, so it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import SPACE, byte_view, chunks

# Fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50  # percent of the texts that change
SUFFIX_FIRST = 80  # percent of those with the suffix in front

ERROR = 100  # bytes a prediction may be off, so that a residual fits in eight bits
MOST_ERROR = 120
FIRST_LOOK = 64  # boundaries looked at first when a segment grows; doubled every time


@dataclass
class RankIndex:
    """Offsets by rank: segments (first rank, offset there, slope) and a residual per rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def _segment(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
    """End of the longest segment from ``at`` and its slope: all lines within the error of the points so far form a cone,
    which narrows with every point until none is left."""
    low, high, stop, look = 0.0, np.inf, at + 1, FIRST_LOOK
    while stop < len(offsets):
        to = min(stop + look, len(offsets))
        run, rise = np.arange(stop - at, to - at), offsets[stop:to] - offsets[at]
        steepest = np.minimum.accumulate(np.minimum((rise + error) / run, high))
        flattest = np.maximum.accumulate(np.maximum((rise - error) / run, low))
        closed = flattest > steepest
        if closed[-1]:  # once empty, a cone stays empty
            fit = int(np.argmax(closed))
            if fit:
                low, high = flattest[fit - 1], steepest[fit - 1]
            stop += fit
            break
        low, high, stop, look = flattest[-1], steepest[-1], to, 2 * look
    return stop, (low + high) / 2 if stop > at + 1 else 0.0


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    if not 1 <= error <= MOST_ERROR:
        raise ValueError(f"the error must be between 1 and {MOST_ERROR}, got {error}")
    first, slopes, at = [], [], 0
    while at < len(offsets):
        stop, slope = _segment(offsets, at, error)
        first.append(at)
        slopes.append(slope)
        at = stop
    first = np.array(first, np.int64)
    index = RankIndex(first, offsets[first], np.array(slopes), np.zeros(0, np.int8))
    index.residual = (offsets - index.predict(np.arange(len(offsets)))).astype(np.int8)
    return index


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the token boundaries of all texts, the start of a text being its first, and where each text's begin.

    A token is a word with the blanks before it, or the blanks at the end of a text.
    """
    start, end = offsets[:-1], offsets[1:]
    gap = SPACE[data]
    after = np.ones(len(data), bool)
    after[:-1] = gap[1:]
    after[end[end > start] - 1] = True
    closing = end[(end > start)]
    closing = closing[gap[closing - 1]]
    tokens = np.sort(np.concatenate([np.flatnonzero(after & ~gap) + 1, closing]))
    count = np.diff(np.searchsorted(tokens, np.append(start, len(data)), side="right"))
    first = np.append(0, np.cumsum(count + 1))
    out = np.empty(first[-1], np.int64)
    is_start = np.zeros(first[-1], bool)
    is_start[first[:-1]] = True
    out[is_start], out[~is_start] = start, tokens
    return out, first


def _rearranged(rate: int, suffix_first: int, error: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            data, offsets = byte_view(batch.column("text"))
            points, first = boundaries(data, offsets)
            index = fit(points, error)
            n = np.diff(first) - 1
            draws = [batch.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            cuts = np.sort(np.stack([draws[0] % (n + 1), draws[1] % (n + 1)]), axis=0) + first[:-1]
            left, right = index.at(cuts[0]), index.at(cuts[1])
            points_before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
            lengths = np.stack([points_before[left] - points_before[offsets[:-1]], points_before[right] - points_before[left]])
            whole, changed = data.tobytes(), np.zeros(len(n), bool)
            forms, outputs = [], []
            for i in range(len(n)):
                text = whole[offsets[i] : offsets[i + 1]]
                changed[i] = draws[2][i] % 100 < rate and text and not any(m in text for m in marks)
                if not changed[i]:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                p, s, m = marks[0] + whole[offsets[i] : left[i]], marks[1] + whole[right[i] : offsets[i + 1]], marks[2] + whole[left[i] : right[i]]
                forms.append("spm" if draws[3][i] % 100 < suffix_first else "psm")
                outputs.append((s + p if forms[-1] == "spm" else p + s) + m)
            columns = [
                batch.column("doc_id"), pa.array(n), pa.array(forms), *[pa.array(x.astype(np.int64), mask=~changed) for x in lengths],
                pa.array(outputs, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST, error: int = ERROR,
) -> DataFrame:
    """One row (doc_id, n, form, prefix_chars, middle_chars, output) per input row; output is the rearranged text.

    The id and the seed alone decide the cuts and the form, so repeated rows give repeated results and no row needs another: no
    shuffle. A null id draws like an empty id. A null or empty text has no tokens and stays plain, output ''; a text of blanks is
    one token. A text that holds one of the markers stays plain, as it could not be restored. For plain texts the lengths are
    null. Texts of any length are cut whole. Other columns are ignored, whatever their names; an empty table gives an empty
    result. ``restored`` takes the output back.
    """
    number = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), number), 256).alias("digest"))
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.select("doc_id", "text", *draws).mapInArrow(_rearranged(rate, suffix_first, error), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    head, body = F.substring_index(output, MIDDLE, 1), F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    middle = F.substring(output, F.length(head) + len(MIDDLE) + 1, F.length(output))
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    second = F.substring(head, len(PREFIX) + F.length(first) + len(SUFFIX) + 1, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
