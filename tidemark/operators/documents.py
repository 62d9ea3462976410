"""Markdown documents to titled sections, and sections to overlapping chunks."""

from __future__ import annotations

import re
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.functions.text import strip

# Fixed values.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 60
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
UNTITLED, PREAMBLE = "Untitled Policy", "Overview"


def document_title(body: Column) -> Column:
    """Text of the first level-one heading."""
    found = F.regexp_extract(body, r"(?md)^#\s+(.*)$", 1)
    return F.coalesce(F.nullif(strip(found), F.lit("")), F.lit(UNTITLED))


def sections(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per non-empty section with its position, title and text; text before the first heading is the overview."""
    piece = F.col("_piece")
    headed = F.col("section_no") > 0
    title = F.when(headed, strip(F.regexp_extract(piece, r"(?d)\A(.*)", 1))).otherwise(PREAMBLE)
    text = strip(F.when(headed, F.regexp_replace(piece, r"(?d)\A.*", "")).otherwise(piece))
    return (
        documents.withColumn("doc_title", document_title(F.col(body)))
        .select(
            *[c for c in documents.columns if c != body],
            "doc_title",
            F.posexplode(F.split(body, r"(?md)^##\s+")).alias("section_no", "_piece"),
        )
        .withColumn("section", title)
        .withColumn("section_text", text)
        .where(F.col("section_text") != "")
        .drop("_piece")
    )


def _pieces(text: str, separators: tuple[str, ...]) -> tuple[list[str], tuple[str, ...]]:
    """Cut at the first separator that occurs; a separator stays at the head of the piece it starts."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    if separators[at] == "":
        return list(text), ()
    cut = re.split(f"(?={re.escape(separators[at])})", text) if separators[at] != "\n\n" else _double_newlines(text)
    return [p for p in cut if p], separators[at + 1 :]


def _double_newlines(text: str) -> list[str]:
    """Blank lines pair up from the left, so a run of three newlines holds one separator."""
    head, *rest = text.split("\n\n")
    return [head] + ["\n\n" + r for r in rest]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbours up to ``size``; each chunk repeats up to ``overlap`` characters of whole pieces from the last."""
    chunks, held, length = [], deque(), 0
    for piece in pieces:
        if held and length + len(piece) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.popleft())
        held.append(piece)
        length += len(piece)
    chunks.append("".join(held))
    return [c.strip() for c in chunks if c.strip()]


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works."""
    pieces, finer = _pieces(text, separators)
    chunks, run = [], []
    for piece in pieces:
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        chunks += _pack(run, size, overlap) if run else []
        chunks += split_text(piece, size, overlap, finer)
        run = []
    return chunks + (_pack(run, size, overlap) if run else [])


def chunks(sections_df: DataFrame, text: str = "section_text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk of each section. Splitting recurses over separators, so it runs on Arrow batches."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap))

    return sections_df.select(
        *[c for c in sections_df.columns if c != text], F.posexplode(split(F.col(text))).alias("chunk_no", "chunk_text")
    )
