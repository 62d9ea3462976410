"""Fill-in-middle: the learned index is exact and within its error, rows against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rank_index

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = TOKENS.findall(text)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    parts = ["word", " ", "\n\t", "é€", "<", ">", "<S", "P>", "\x0b", "\x85", "", "😀😀", "x" * 700]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " ", "one", " one ", "<P>", "a <S> b", "a <M", "word " * 60_000, "y" * 300_000, "é " * 5000] * 6
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id here"), (None, None)]


def test_rows_against_plain_version(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    clash = docs.withColumns({c: F.lit("extra") for c in ("n", "form", "output", "digest", "h1", "row", "prefix_chars")})
    for df in (docs, clash):
        out = rank_index.fill_in_middle(df)
        got = sorted(map(repr, (tuple(r)[:6] for r in out.collect())))
        assert got == sorted(repr((i, *plain_version(i, t))) for i, t in rows)
    back = out.select("doc_id", rank_index.restored(F.col("output"), F.col("form")).alias("text"), "form").collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in back))) == sorted(repr((i, t or "")) for i, t in rows)
    assert {r["form"] for r in back} == {"plain", "spm", "psm"}
    assert rank_index.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("error", [1, 7, 100, 120])
def test_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(3)
    steps = np.concatenate([rng.integers(0, 9, 5000), rng.integers(1000, 100_000, 50), np.zeros(300, int), np.full(4000, 7), rng.integers(1, 400, 3000)])
    offsets = np.cumsum(steps)
    index = rank_index.fit(offsets, error)
    ranks = np.arange(len(offsets))
    assert (index.at(ranks) == offsets).all()
    assert np.abs(index.predict(ranks) - offsets).max() <= error + 1
    assert len(index.first) < len(offsets) / 2
    # segments can't be longer: no line within the error goes on to the next boundary
    for a, b in zip(index.first[:40], index.first[1:41]):
        run, rise = np.arange(1, b - a + 1), offsets[a + 1 : b + 1] - offsets[a]
        assert max(0, ((rise - error) / run).max()) > ((rise + error) / run).min()


def test_small_and_wrong_indexes():
    assert len(rank_index.fit(np.zeros(0, np.int64)).residual) == 0
    assert rank_index.fit(np.array([5])).at(np.array([0])).tolist() == [5]
    for error in (0, 121):
        with pytest.raises(ValueError):
            rank_index.fit(np.arange(3), error)
