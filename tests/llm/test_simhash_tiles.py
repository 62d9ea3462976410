"""SimHash: fingerprints and components against all pairs, in small and in cut cells."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash_tiles
from tidemark.llm.common import Stored, components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_print(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """Smallest print reachable from each."""
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in itertools.combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= radius:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {p: find(p) for p in prints}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(900)]
    texts = [" ".join(base), " ".join(base).upper(), "\n".join(base)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 8)):
            words[rng.randrange(900)] = f"É{i}x"
        texts.append(" ".join(words))
    texts += [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(300)]
    texts += [None, "", " \n", "one", "ONE", "two words", "three word text", "É é", "word " * 90_000]
    out = [(5 + i, t) for i, t in enumerate(texts)]
    return out + [out[0], out[200], (None, texts[0]), (None, "only without an id here"), (0, texts[130])]


@pytest.mark.parametrize("cell, radius", [(2048, 2), (4, 2), (4, 5), (2048, 0)])
def test_components_against_all_pairs(spark, rows, cell, radius):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = docs.withColumns({c: F.lit("extra") for c in ("print", "node", "label", "least", "component_id", "fingerprint", "part", "key")})
    prints = {t: plain_print(t) for _, t in rows}
    reach = plain_components(list(prints.values()), radius)
    least = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[reach[prints[t]]].append(i)
    want = collections.Counter((i, f"{prints[t]:016x}", min(least[reach[prints[t]]], default=None)) for i, t in rows)
    got = simhash_tiles.near_duplicates(clash, radius=radius, cell=cell).collect()
    assert collections.Counter(map(tuple, got)) == want
    if radius:
        assert max(collections.Counter(r["component_id"] for r in got).values()) > 20
    assert simhash_tiles.near_duplicates(docs.limit(0)).count() == 0


def test_dense_and_chained_prints(spark):
    """A ball of prints, a long chain and strangers, cut into tiny cells: a link for each, not all pairs."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    ball = {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    chain, at = [], rng.getrandbits(64)
    for b in rng.sample(range(64), 60):
        at ^= 1 << b
        chain.append(at)
    prints = sorted(ball | set(chain) | {rng.getrandbits(64) for _ in range(500)} | {0, 2**64 - 1, 1 << 63})
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    want = plain_components(prints, 2)

    def groups(label):
        held = collections.defaultdict(set)
        for p, name in label.items():
            held[name].add(p)
        return {frozenset(g) for g in held.values() if len(g) > 1}

    for cell in (16, 100_000):
        links = simhash_tiles.close_links(df, Stored(spark), cell=cell).cache()
        got = {r["node"] % 2**64: r["label"] for r in components(links).collect()}
        assert groups(got) == groups(want)
    assert links.count() <= 3 * len(prints)


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 2**10, 300).astype(np.uint64) << np.uint64(20))
    left, right = prints[::2], prints[1::2]
    for tile in (3, 16, 1000):
        a, b = simhash_tiles.tile_links(prints, None, 1, tile)
        label = plain_components(prints.tolist(), 1)
        assert all(label[x] == label[y] for x, y in zip(a.tolist(), b.tolist()))
        assert len(set(a.tolist())) == len(a) == len(prints) - len(set(label.values()))
        a, b = simhash_tiles.tile_links(left, right, 1, tile)
        near = {(x, y) for x in left.tolist() for y in right.tolist() if (x ^ y).bit_count() <= 1}
        parent = {p: p for p in prints.tolist()}
        find = lambda p: p if parent[p] == p else find(parent[p])
        for x, y in near:
            parent[find(x)] = find(y)
        whole = {p: find(p) for p in parent}
        assert all(whole[x] == whole[y] for x, y in zip(a.tolist(), b.tolist()))
        assert len(a) == len(parent) - len(set(whole.values()))
    with pytest.raises(ValueError):
        simhash_tiles.close_links(None, None, 32)
