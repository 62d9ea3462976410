"""Packing documents into sequences by linear grouping of large lengths and best fit of small ones.

The driver plans on the histogram of piece lengths, at most one row per length up to the capacity, however many documents there
are. Large pieces, sorted by length, are cut into groups of equal cardinality and rounded up to the longest of their group, so
that only few sizes remain; configurations of those sizes are chosen one after another, the largest open size first, filled up
by a knapsack over the others, and repeated while they last. Then the groups' actual lengths take the places of the rounded
ones, and small pieces go by best fit into what is left. The plan is kept as runs of equal sequences. On the cluster each piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import SPACE, Stored, byte_view, chunks, frugal

CAPACITY = 2048
END_ID = 0
GROUPS = 96
SMALL_SHARE = 8  # pieces up to capacity / SMALL_SHARE are small
PIECES_PER_RANK = 1_000_000  # pieces of one length that one task ranks, on average

# Fixed value: how byte-level tokenizers cut a text into words.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_RUN = 500  # bytes without change between white space and other text; longer runs go to the tokenizer


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: its own where it prints, else the next beyond 255."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TextIds:
    """Token ids of whole texts.

    A byte-level vocabulary whose ids follow its merges is handed to the ranked byte-pair encoder, which gives the same ids several
    times faster; texts with a very long run of letters or white space, and any other tokenizer, go to the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.ranked = self._ranked(json.load(file))

    @staticmethod
    def _ranked(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        regular = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        if model.get("type") != "BPE" or spec.get("normalizer") or not regular or model.get("dropout"):
            return None
        letters, vocabulary = _byte_letters(), model["vocab"]
        merged = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        order = [vocabulary.get(m.replace(" ", "", 1)) for m in merged]
        if any(set(word) - set(letters) for word in vocabulary) or None in order or order != sorted(set(order)) or len(order) + 256 != len(vocabulary):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items()}
        return tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        data, offsets = byte_view(texts)
        gap, turn = SPACE[data], np.ones(len(data), bool)
        turn[1:] = gap[1:] != gap[:-1]
        turn[offsets[:-1][offsets[:-1] < len(data)]] = True
        edges = np.append(np.flatnonzero(turn), len(data))  # where runs of white space, runs of other bytes and texts begin
        slow = np.zeros(len(texts), bool)
        slow[np.searchsorted(offsets, edges[:-1][np.diff(edges) > LONG_RUN], side="right") - 1] = True
        lines = pc.fill_null(texts, "").to_pylist()
        if self.ranked is None:
            slow[:] = True
        encode = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
        return [encode(t) if hard else np.array(self.ranked.encode_ordinary(t), np.uint32) for t, hard in zip(lines, slow)]


def _tokenize(path: str, capacity: int, end_id: int, names: list[str]):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = TextIds(path)
        for batch in chunks(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encoder.texts(batch.column("text"))):
                ids = np.append(ids, end_id).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    rows.append(row), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b]))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in names]
                + [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names + ["piece", "start", "length", "ids_crc32"],
            )

    return run


def _pattern(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """Copies per size of the fullest configuration that holds the size at ``first``; sizes descend."""
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    by = np.full(room + 1, -1)
    for g in range(first, len(sizes)):
        free = left[g] - (g == first)
        size = sizes[g]
        if size > room or free <= 0:
            continue
        # one more copy at a time: sums already reached with this size may be extended by it
        fresh = reach.copy()
        for _ in range(min(free, room // size)):
            extended = np.zeros(room + 1, bool)
            extended[size:] = fresh[:-size]
            extended &= ~reach
            if not extended.any():
                break
            reach |= extended
            by[extended] = g
            fresh = extended
        if reach[room]:
            break
    out = [0] * len(sizes)
    out[first] = 1
    at = int(np.flatnonzero(reach)[-1])
    while at:
        g = by[at]
        out[g] += 1
        at -= sizes[g]
    return out


class Runs:
    """Runs of equal sequences: how many there are of each, with their contents, found by the room that is left."""

    def __init__(self):
        self.by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, n: int, contents: tuple[int, ...]) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append((n, contents))

    def take(self, least: int) -> tuple[int, int, tuple[int, ...]] | None:
        """A run of the smallest room that is large enough."""
        at = bisect_left(self.rooms, least)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        n, contents = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[at]
        return room, n, contents


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> list[tuple[int, tuple[int, ...]]]:
    """Runs (number of sequences, lengths in them) that hold exactly the histogram's pieces."""
    limit = capacity // small_share
    large = sorted(((l, n) for l, n in histogram.items() if l > limit and n), reverse=True)
    total = sum(n for _, n in large)
    # linear grouping: equal cardinality, except that pieces of one length are cut only between groups
    members: list[list[list[int]]] = []
    share = max(1, -(-total // groups))
    room = 0
    for length, n in large:
        while n:
            if room == 0:
                members.append([])
                room = share
            k = min(n, room)
            members[-1].append([length, k])
            n, room = n - k, room - k
    sizes, left = [m[0][0] for m in members], [sum(k for _, k in m) for m in members]
    runs = Runs()
    first = 0
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        pattern = _pattern(sizes, left, first, capacity)
        n = min(left[g] // a for g, a in enumerate(pattern) if a)
        slots = [g for g, a in enumerate(pattern) for _ in range(a)]
        # substitution: n pieces of each place's group, longest first; places change length at different points
        taken = []
        for g in slots:
            need, part = n, []
            while need:
                length, k = members[g][0]
                use = min(k, need)
                part.append([length, use])
                need -= use
                if use == k:
                    members[g].pop(0)
                else:
                    members[g][0][1] -= use
            left[g] -= n
            taken.append(part)
        while taken[0]:
            k = min(part[0][1] for part in taken)
            contents = tuple(part[0][0] for part in taken)
            runs.add(capacity - sum(contents), k, contents)
            for part in taken:
                part[0][1] -= k
                if not part[0][1]:
                    part.pop(0)
    for length, n in sorted(((l, n) for l, n in histogram.items() if l <= limit and n), reverse=True):
        while n:
            found = runs.take(length)
            if found is None:
                copies = capacity // length
                whole, rest = divmod(n, copies)
                if whole:
                    runs.add(capacity - copies * length, whole, (length,) * copies)
                if rest:
                    runs.add(capacity - rest * length, 1, (length,) * rest)
                break
            room, k, contents = found
            use = min(k, n)
            runs.add(room - length, use, contents + (length,))
            if k > use:
                runs.add(room, k - use, contents)
            n -= use
    return [run for room in runs.rooms for run in runs.by_room[room]]


def places(runs: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Per place of a run: the length, the first rank among pieces of that length, the first sequence and the offset in it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, contents in runs:
        offset = 0
        for length in contents:
            rank = used.get(length, 0)
            used[length] = rank + n
            rows.append((length, rank, sequence, offset))
            offset += length
        sequence += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "rank", "sequence", "offset"), columns))


def _assign(place: dict[str, np.ndarray], names: list[str]):
    keys = (place["length"].astype(np.uint64) << np.uint64(48)) | place["rank"].astype(np.uint64)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.uint64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << np.uint64(48)) | rank, side="right") - 1
            sequence = place["sequence"][at] + rank.astype(np.int64) - place["rank"][at]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(place["offset"][at])], names + ["sequence_id", "offset"])

    return run


def pieces(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): token ids plus ``end_id``, cut into pieces of the capacity where longer.

    Of a cut document only the first piece is shorter. A null text is empty and gives one piece with the end id alone.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_tokenize(tokenizer, capacity, end_id, ["doc_id"]), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> DataFrame:
    """Adds sequence_id and offset to stored rows with a ``length`` between 1 and the capacity.

    Equal lengths are interchangeable, so ties need no order; every row, repeated ones too, gets a place of its own. Extra
    columns stay. An empty table stays empty. Pieces of one length are ranked in parts, so a common length fills no task.
    """
    counted = cut.groupBy("length").count().collect()  # at most one row per length
    histogram = {r["length"]: r["count"] for r in counted}
    place = places(plan(histogram, capacity, groups, small_share))
    parts = max(64, max(histogram.values(), default=0) // PIECES_PER_RANK)
    names = cut.columns
    order = [c for c in names if c != "length"]
    dealt = cut.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")
    ranked = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1)
    ranked = ranked.join(sizes.select("length", "_part", before.alias("_before")), ["length", "_part"]).withColumn("rank", F.col("_at") + F.col("_before"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(_assign(place, names), schema)


def pack_documents(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack: see ``pieces`` and ``pack``. The pieces, not the ids, are stored in between."""
    cut = Stored(documents.sparkSession).keep(pieces(documents, tokenizer, id_column, text_column, capacity, end_id))
    return pack(cut, capacity)
