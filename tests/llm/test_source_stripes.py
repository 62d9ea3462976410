"""Source divergences against a plain version, with spills, many blocks and many sources."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import source_stripes

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_version(rows, min_documents, top):
    held, groups, counts = collections.defaultdict(int), collections.defaultdict(set), collections.Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        for t in terms:
            counts[lang, source, t] += 1
        for t in set(terms):
            held[lang, t] += 1
    out = set()
    for lang, sources in groups.items():
        kept = [t for (l, t), n in held.items() if l == lang and n >= min_documents]
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        share = lambda n, all_: 1 + 1_000_000_000 * (n + 5) // (all_ + 5 * len(kept))
        p = {s: {t: share(counts[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, rank + 1) for rank, (value, item) in enumerate(found)}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(400):
        lang, source = rng.choice("xyz"), f"s{min(rng.randint(0, 40), 20)}"  # half of the rows have one source
        words = [rng.choice(vocabulary[: 40 + 4 * (int(source[1:]) % 20)]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice([" ", "1", "\n", "[", "\x7f"]).join(words).upper() if i % 3 else " ".join(words), lang, source))
    rows += [(None, "x", "s1"), ("", "x", "none"), ("a b", None, "s1"), ("a", "", None), ("a", None, None), ("12 !", "alone", "s"), ("", "empty", "a"), ("", "empty", "B")]
    return rows + rows[:20] + [("word " * 50_000 + "é", "x", "s2")]


@pytest.mark.parametrize("entries, cells, tile, least, top", [(100_000, 1 << 20, 256, 5, 50), (7, 200, 3, 5, 4), (60, 50, 1, 1, 2), (1000, 300, 5, 10_000, 50)])
def test_against_plain_version(spark, rows, monkeypatch, entries, cells, tile, least, top):
    monkeypatch.setattr(source_stripes, "SOURCES_A_TILE", tile)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    clash = docs.withColumns({c: F.lit("extra") for c in ("term", "n", "documents", "sources", "groups", "terms", "block", "tile", "rank", "item", "part")})
    got = source_stripes.source_divergences(clash, least, top, entries, cells).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_version(rows, least, top)
    assert source_stripes.source_divergences(docs.limit(0)).count() == 0


def test_spilled_stripes_add_up():
    stripes = source_stripes.Stripes()
    stripes.fold("x", "a", b"One one TWO")
    stripes.fold("x", "b", "one é".encode())
    assert stripes.entries == 4
    rows = {r["term"]: (r["documents"], {s["source"]: s["n"] for s in r["sources"]}) for r in stripes.spill().to_pylist()}
    assert rows == {"one": (2, {"a": 2, "b": 1}), "two": (1, {"a": 1}), "é": (1, {"b": 1})}
    assert stripes.entries == 0 and stripes.spill().num_rows == 0


def test_share_is_exact():
    import numpy as np

    for count, total, terms in [(0, 0, 1), (10**12 + 7, 3 * 10**12 + 1, 12345), (10**14, 8 * 10**15, 10**6), (5, 5, 1)]:
        want = 1 + 10**9 * (count + 5) // (total + 5 * terms)
        assert source_stripes.share(np.array([count], np.int64), total, terms).tolist() == [want]
