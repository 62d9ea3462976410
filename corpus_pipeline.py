"""From raw documents to packed sequences: language ID, line dedup, near-dedup, decontamination, packing.

Every stage reads what the one before kept, written as Parquet; all but the last return the columns of ``documents``. Documents are
found again by id and text, nulls included; extra columns stay as they are, whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import dart_minhash, grouped_packing, ppm_language, qgram_lemma, site_lines
from tidemark.llm.common import Stored, table
from tidemark.session import broadcast_if_small

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MOST_BITS = 8.0  # a text whose best language needs more bits a byte than storing it plainly is in none of them


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in a known language. Rejected: null texts, texts without a letter, and texts that the best
    language model codes with more than MOST_BITS a byte. ``lang`` becomes the prediction where it was null. Repeated rows each get the
    same decision; a tie between languages goes to the first by name."""
    scored = ppm_language.identify(docs, whole_rows=True)
    known = scored.where((F.col("lang_pred") != ppm_language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS))
    out = known.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])
    return Stored(spark).keep(out)  # whole rows pass through Python, in small batches while they are stored


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; a document with no other line is nothing but boilerplate and
    goes. n_chars follows the text. Exact and near copies count as one document, so copies alone make no line boilerplate and a
    group of them is left to near_dedup; no Python finds them. Null and empty texts stay as they are; documents without a source are one source."""
    found = dart_minhash.near_duplicate_classes(docs, native=True).where("text_hash is not null")
    classes = Stored(spark).keep(found.groupBy("text_hash").agg(F.min("class_id").alias("class")))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    rows = docs.select("source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("row"))
    out = site_lines.drop_site_lines(rows, "source", classes=classes).where((F.col("n_lines") > F.col("n_dropped")) | (F.col("n_dropped") == 0))
    return Stored(spark).keep(out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each near-duplicate class; of repeated rows of it one stays.

    Texts without words, empty ones too, stay once for each different text, null texts once for each id. A null id comes after all others.
    """
    classes = Stored(spark).keep(dart_minhash.near_duplicate_classes(docs).where("is_first").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")))
    rows = _same_document(docs, classes.where("n = 1"), "inner")
    repeated = classes.where("n > 1")
    if not repeated.isEmpty():
        rows = rows.unionByName(_same_document(docs, repeated, "inner").dropDuplicates(["own_id", "own_hash"]))
    return _whole(rows, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay, and so do repeated rows."""
    found = qgram_lemma.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct()
    return _whole(_same_document(docs, Stored(spark).keep(found), "left_anti"), docs)


def _same_document(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """(row, own_id, own_hash): the documents, each as one struct, joined with stored decisions (doc_id, text_hash), which go to the documents while
    they are few, so that texts are not shuffled."""
    decided = broadcast_if_small(decided.select("doc_id", "text_hash"))
    own_hash = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), own_hash.alias("own_hash"))
    met = rows.join(decided, F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_hash").eqNullSafe(F.col("text_hash")), how)
    return met.select("row", "own_id", "own_hash")


def _whole(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences. Null texts count as empty, and every row, repeated ones too, gets pieces of its own; columns
    other than doc_id and text are ignored."""
    return grouped_packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", packing),
]

STORED = ("language_id", "line_dedup")  # stages that store their result themselves

# SQL can't express the language model, the signatures and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = Stored(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if name not in STORED and i < len(STAGES) - 1:
            docs = store.keep(docs)
    return docs
