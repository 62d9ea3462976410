"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import collections
import functools
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    dart_minhash, grouped_packing, hilbert, ppm_language, qgram_lemma, quotation_links, relative_lz, rule_ledger, site_lines, sql_shingles, warc_transactions,
)

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars) with every awkward case."""
    rng = random.Random(5)
    base, other, passage = sentence(rng, 300), sentence(rng, 260, "pqrstuv"), sentence(rng, 60)
    words = base.split()
    near = [" ".join(w if i % 90 != k else "changed" for i, w in enumerate(words)) for k in range(4)]
    texts = [base, *near, base, other, f"{other}\n{passage}", f"start {passage} end", passage, None, "", " \n\t ", "one", "two words", "x " * 300,
             "a b c\nd\n\na b c\n a b c", "é " * 40 + "€ and more", sentence(rng, 4000), "12 34 #!"]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[7], (None, "no id here", None, None, None), (None, base, "en", "s1", 1)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named like the operators' own."""
    names = "node label class_id is_first band leader score held_out row sequence_id offset length rank cell shard site _hits _salt _row _id _hash list salt salts copy seeds".split()
    return docs.withColumns({n: F.lit("extra") for n in names})


def multiset(df):
    return collections.Counter(tuple(r) for r in df.collect())


def shingle_bag(text):
    w = text.split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def similarity(a, b):
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 0.0


def test_near_duplicate_classes(docs, corpus):
    texts = sorted({t for _, t, *_ in corpus if t is not None})
    parent = {t: t for t in texts}
    find = lambda t: t if parent[t] == t else find(parent[t])
    bags = {t: shingle_bag(t) for t in texts}
    for a, b in itertools.combinations(texts, 2):
        if similarity(bags[a], bags[b]) >= 0.8:
            parent[find(a)] = find(b)
    first = collections.defaultdict(list)
    for i, t, *_ in corpus:
        if t is not None and i is not None:
            first[find(t)].append(i)
    want = collections.Counter((i, i if t is None else min(first[find(t)], default=None)) for i, t, *_ in corpus)
    got = dart_minhash.near_duplicate_classes(docs)
    assert multiset(got.select("doc_id", "class_id")) == want
    assert all(r["is_first"] == (r["doc_id"] == r["class_id"]) for r in got.collect())


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    element = rng.integers(0, 2**63, 400).astype(np.uint64)
    left, right = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    true = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    doc = np.repeat([0, 1], 400)
    weight = np.concatenate([left, right])
    keep = weight > 0
    sig = dart_minhash.signatures(2, doc[keep], np.tile(element, 2)[keep], weight[keep], 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_a_hot_group_and_strangers(spark):
    rng = random.Random(9)
    words = sentence(rng, 150).split()
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        changed = list(words)
        for k in rng.sample(range(150), 2):
            changed[k] = f"w{i}x{k}"
        rows.append((i, " ".join(changed)))
    rows += [(100 + i, sentence(rng, 120)) for i in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(60)) and all(got[100 + i] == 100 + i for i in range(20))


def edit_distance_inside(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_against_alignment(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, rng.randint(14, 30))) for i in range(6)] + [(6, None), (7, ""), (8, "tiny"), (9, sentence(rng, 20))]
    items += [(20, "2+2=4"), (21, "7"), (22, "fifteen letters"), (23, "ten char's"), (24, "twenty-two characters?")]
    rows = [(0, None), (1, ""), (2, "short")]
    for n in range(40):
        text = items[n % 6][1]
        for _ in range(rng.randint(0, len(text) // 7)):
            k = rng.randrange(len(text))
            text = text[:k] + rng.choice(["", "z", text[k] + "q"]) + text[k + 1 :]
        rows.append((10 + n, f"{sentence(rng, rng.randint(0, 60))} {text.upper()}\n{sentence(rng, rng.randint(0, 60))}"))
    rows += [(60, "so 2+2=4, they say"), (61, "2+2=5"), (62, "fifteenXletters"), (63, "in fiftenletters"), (64, "a tenchar's"), (65, "twenty-two chracterz?"), (66, "tiny 7")]
    rows += [rows[5], (None, items[9][1])]
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in qgram_lemma.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    clean = lambda t: " ".join((t or "").lower().split())
    want = {}
    for i, t in rows:
        for j, p in items:
            p = clean(p)
            if p and clean(t):
                d = edit_distance_inside(p, clean(t))
                if d <= int(len(p) * 0.1):  # one edit for every ten characters, as documented
                    want[i, j] = d
    assert got == want and len(want) > 20 and {(60, 20), (62, 22), (64, 23), (65, 24), (66, 8), (66, 21)} <= set(got)
    # in several blocks
    blocks = qgram_lemma.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=300)
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in blocks.collect()} == want


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_steps_to_neighbours(spark, dimensions, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dimensions))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dimensions)))
    index, digits = hilbert.curve_index([F.col(f"c{i}") for i in range(dimensions)], bits)
    order = sorted((r["h"], tuple(r)[:dimensions]) for r in df.withColumn("_digits", digits).withColumn("h", index).drop("_digits").collect())
    assert [h for h, _ in order] == list(range(len(cells)))
    assert all(sum(abs(x - y) for x, y in zip(a[1], b[1])) == 1 for a, b in zip(order, order[1:]))


def test_shards_by_rows(docs, corpus, monkeypatch):
    monkeypatch.setattr(hilbert, "ROWS_PER_PART", 2)  # so that cells are cut
    rows = hilbert.shard(docs).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(hilbert.SHARDS)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_runs_of_the_curve_and_prune(spark):
    """Sources with a long common beginning still lie in few shards each."""
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 50), rng.choice(["en", "fr", None]), f"https://site{rng.randrange(15):02d}.example/") for i in range(4000)]
    out = hilbert.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)).collect()
    of = {r["doc_id"]: r["shard"] for r in out}
    cells = collections.defaultdict(list)
    for r in out:
        cells[r["shard"]].append(r["cell"])
    assert all(max(cells[s]) <= min(cells[s + 1]) for s in range(hilbert.SHARDS - 1))
    sources = collections.defaultdict(set)
    for i, _, _, source in rows:
        sources[of[i]].add(source)
    assert sum(map(len, sources.values())) / hilbert.SHARDS < 9  # of 15


def test_spans_against_brute_force(docs, corpus):
    seen, want = {}, {}
    for i, t in sorted({(i, t) for i, t, *_ in corpus if i is not None}, key=lambda r: r[0]):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if seen.setdefault(tuple(w[s : s + 20]), (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    rows = relative_lz.duplicate_spans(docs).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) == want[r["doc_id"]]
            assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert any(r["doc_id"] is None and r["n_removed"] == 300 for r in rows)  # a null id comes last


def test_ledger_against_brute_force(docs, corpus):
    got = collections.Counter(tuple(r)[:7] for r in rule_ledger.ledger(docs).collect())
    want = collections.Counter()
    for i, t, *_ in corpus:
        t = t or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        windows = [tuple(w[s : s + 5]) for s in range(len(w) - 4)]
        n = collections.Counter(windows)
        covered = {s + j for s, x in enumerate(windows) if n[x] > 1 for j in range(5)}
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want


def test_ablation_is_consistent(docs):
    rows = rule_ledger.ledger(docs)
    out = {r["rule"]: r for r in rule_ledger.ablation(rows, "v1").collect()}
    kept = rule_ledger.judged(rows, "v1").where("kept").count()
    for i, (name, rule) in enumerate(rule_ledger.RULES):
        if name in out:
            assert out[name]["failed"] == rows.where(rule).count()
            assert out[name]["kept_without"] == kept + out[name]["only_this"]


def test_site_lines(spark, monkeypatch):
    rows = [(i, "a", f"unique {i}\nshared menu\n  shared menu \nrare {i % 6}") for i in range(40)] + [(100 + i, "b", f"page {i}\nshared menu") for i in range(5)]
    rows += [(200, "a", None), (201, "a", ""), (202, None, "shared menu"), (203, "a", "shared menu"), (300, "c", "two pages\nshared menu"), (301, "c", "shared menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sent = site_lines.drop_site_lines(df, ratio=0.2).collect()
    monkeypatch.setattr(site_lines, "LISTS", 0)  # so that pages and lists are shuffled
    monkeypatch.setattr(site_lines, "PAGES_PER_TASK", 7)  # and sites have salts
    got = {r["doc_id"]: r for r in site_lines.drop_site_lines(df, ratio=0.2).collect()}
    assert sorted(map(str, sent)) == sorted(map(str, got.values()))
    assert got[300]["text"] == "two pages\nshared menu" and got[301]["n_dropped"] == 0
    assert got[3]["text"] == "unique 3\nrare 3" and (got[3]["n_lines"], got[3]["n_dropped"]) == (4, 2)
    assert got[101]["text"] == "page 1" and got[202]["text"] == "shared menu" and got[203]["text"] == ""
    assert got[200]["text"] is None and got[201]["text"] == "" and len(got) == len(rows)


def test_plan_holds_every_piece_once():
    rng = random.Random(2)
    for n in (0, 1, 30, 3000):
        lengths = collections.Counter(min(2048, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(n))
        runs = grouped_packing.plan(lengths)
        held = collections.Counter()
        for times, contents in runs:
            assert sum(contents) <= 2048
            for length in contents:
                held[length] += times
        assert held == +lengths
        assert sum(t for t, _ in runs) <= 1.05 * -(-sum(k * v for k, v in lengths.items()) // 2048) + 1


def test_packing_against_the_tokenizer(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = collections.Counter()
    for i, t, *_ in corpus:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = grouped_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_whole_texts_have_the_ids_of_the_tokenizer():
    rng = random.Random(4)
    parts = ["foo", " ", "  ", "\n", "\t", "é", "'s", "12", "#!", "\x85", "\u3000", "<|endoftext|>", "\x1c", "e\u0301", "😀", "\x00", "'LL", " ", "İ", "日本語", "a" * 40]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", " " * 3000, "x" * 3000 + " y", "ab " * 20_000, "\n" * 600 + "z", "end" + " " * 600]
    encoder = grouped_packing.TextIds(public_tokenizers.path("byte_bpe_50k.json"))
    whole = [e.ids for e in encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert encoder.ranked is not None
    assert [x.tolist() for x in encoder.texts(pa.array(texts))] == whole
    other = grouped_packing.TextIds(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ranked is None and [x.tolist() for x in other.texts(pa.array(["Some words", None]))] == [other.tokenizer.encode("Some words", add_special_tokens=False).ids, []]


def test_archives_round_trip(spark):
    big = "payload with WARC/1.1\r\n\r\ninside é " * 60
    rows = [(1, "http://a.example/x", big), (2, "http://b.example/", big), (3, None, "small"), (4, "http://c.example/\r\ny", "small"), (5, "u", None), (6, "u", ""),
            (2, "http://b.example/", big), (None, "http://n.example/", "no id")]
    got = warc_transactions.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    body = lambda h: (h or "").encode()
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == collections.Counter(
        (i, len(body(h)), hashlib.sha1(body(h)).hexdigest()) for i, _, h in rows
    )
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] >= 1000)
    assert [k[:2] for k in kinds] == [(1, "revisit"), (2, "response"), (2, "revisit")] and {k[2] for k in kinds if k[1] == "revisit"} == {2}
    assert all(r["record_type"] == "response" and r["refers_to"] is None for r in got if r["payload_bytes"] < 1000)
    assert len({r["capture_id"] for r in got}) == len(rows) and all(r["request_id"] for r in got)


def test_cut_off_archive_is_an_error():
    with pytest.raises(ValueError):
        list(warc_transactions.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(quotation_links, "BUCKET", 2)
    rows = [("t", 0, "Hello\nthere"), ("t", 1, "Reply\n\nOn Monday A wrote:\n> Hello\n>  there"), ("t", 2, "Again\n> Reply\n> > HELLO there"),
            ("t", 3, "other branch\n> hello there"), ("t", 4, "lost\n> nowhere\n>> reply"), ("t", 5, "Hello there"), ("t", 9, "late\n> hello there"), ("t", 10, "none\n> nowhere"),
            ("u", 0, "x\n> Hello there"), ("u", 1, None), ("u", 2, ""), (None, 3, "> Hello there"), ("t", 2, "Again\n> Reply\n> > HELLO there")]
    got = quotation_links.conversations(spark.createDataFrame(rows, "thread string, position long, text string")).collect()
    at = {(r["thread"], r["position"]): r for r in got}
    assert len(got) == len(rows) and at["t", 1]["own_text"] == "Reply"
    parents = {p: at["t", p]["parent"] for p in (0, 1, 2, 3, 4, 5, 9, 10)}
    assert parents == {0: None, 1: 0, 2: 1, 3: 0, 4: 1, 5: None, 9: 5, 10: None}
    assert (at["t", 2]["root"], at["t", 2]["depth"], at["t", 9]["root"]) == (0, 2, 5)
    assert at["u", 0]["parent"] is None and at["u", 1]["own_text"] == "" and at[None, 3]["root"] is None


def test_language_costs_are_codes(spark):
    """In every kept context the code lengths of all bytes are those of a probability distribution."""
    rows = [(i, sentence(random.Random(i), 50, "abc" if i % 2 else "cde"), "x" if i % 2 else "y") for i in range(20)]
    model = ppm_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    symbols = int(model.symbol.max()) + 1
    share = np.exp2(-model.cost.astype(float)).reshape(len(model.langs), -1, symbols)
    share[:, :, -1] *= 256 - (symbols - 1)
    assert np.allclose(share.sum(2), 1, atol=1e-3)


def plain_code_lengths(training, texts, order=3, least=4, pad=b"\n"):
    """Bits of each text in each language, byte by byte from the definition: longest kept context, escapes, exclusion."""
    counts, seen = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in training:
        data = pad * order + text.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[lang, data[i - k : i]][data[i]] += 1
            seen[data[i - 3 : i]] += 1
            seen[data[i - 2 : i]] += 1
    kept = lambda c: len(c) < 2 or (seen[c] >= least and (len(c) == 2 or kept(c[:2])))

    @functools.cache
    def probabilities(lang, context):
        if context is None:
            return [1 / 256] * 256
        shorter = None if not context else context[1:]
        while shorter is not None and not kept(shorter):
            shorter = shorter[1:]
        below = probabilities(lang, shorter)
        own = counts.get((lang, context))
        if not own:
            return below
        whole = sum(own.values()) + len(own)
        free = 1 - sum(below[b] for b in own)
        return [own[b] / whole if b in own else len(own) / whole * below[b] / free for b in range(256)]

    out = []
    for text in texts:
        data = pad * order + text.lower().encode()
        row = []
        for lang in sorted({l for _, l in training}):
            bits = 0.0
            for i in range(order, len(data)):
                context = next(data[i - k : i] for k in (3, 2, 1) if kept(data[i - k : i]))
                bits -= math.log2(probabilities(lang, context)[data[i]])
            row.append(bits)
        out.append(row)
    return out


def test_code_lengths_against_the_definition(spark):
    rng = random.Random(8)
    training = [(sentence(rng, 12, "abcd" if i % 3 else "cdeé"), "xyz"[i % 3]) for i in range(40)] + [("", "x"), ("a", "y")]
    model = ppm_language.train(spark.createDataFrame([(i, t, l) for i, (t, l) in enumerate(training)], "doc_id long, text string, lang string"))
    texts = ["", "a", "abcd", "never seen: Ωß", "cde é", sentence(rng, 30, "abcdeé"), "ABCD abcd", "\n\n"]
    assert model.langs == ["x", "y", "z"]
    assert np.allclose(model.bits(pa.array(texts)), plain_code_lengths(training, texts), atol=1e-3)


def test_language_prediction(spark, docs, corpus):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 60, "abcdef" if i % 2 else "cdefgh"), "x" if i % 2 else "y") for i in range(200)] + [(900, None, "x"), (901, "12 !", "y"), (902, "", None)]
    got = {r["doc_id"]: r for r in ppm_language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] == (lang if i < 200 else "und")
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in ppm_language.identify(unlabelled).collect()} == {"und"}


RUNS = {
    "near": lambda d: dart_minhash.near_duplicate_classes(d),
    "shards": lambda d: hilbert.shard(d),
    "spans": lambda d: relative_lz.duplicate_spans(d),
    "ledger": lambda d: rule_ledger.ledger(d),
    "lines": lambda d: site_lines.drop_site_lines(d, "source"),
    "packing": lambda d: grouped_packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")),
    "language": lambda d: ppm_language.identify(d),
    "leaks": lambda d: qgram_lemma.leaks(d, d.sparkSession.createDataFrame([(1, "no id here")], "item_id long, text string")),
    "archives": lambda d: warc_transactions.round_trip(d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))),
    "mail": lambda d: quotation_links.conversations(d, "source", "doc_id"),
}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table_and_extra_columns(docs, clashing, corpus, name):
    assert RUNS[name](docs.limit(0)).count() == 0
    plain, more = RUNS[name](docs), RUNS[name](clashing)
    if name not in ("packing", "lines", "mail", "shards"):
        shared = [c for c in plain.columns if dict(plain.dtypes)[c][:5] != "array"]
        assert multiset(plain.select(*shared)) == multiset(more.select(*shared))
    else:
        assert plain.count() == more.count()
    if name == "lines":
        extra = [c for c in clashing.columns if c not in docs.columns]
        assert multiset(plain) == multiset(more.drop(*extra)) and multiset(more.select(*extra).distinct()) == {("extra",) * len(extra): 1}


def test_pipeline_stages(spark, docs, corpus, tmp_path):
    """Each stage against brute force on what the one before kept."""
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, corpus[9][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    current = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        following = stage(spark, current, path)
        if name != "packing":
            assert following.columns == current.columns
            following.write.parquet(f"{path}/{name}")
            following = spark.read.parquet(f"{path}/{name}")
        kept.append(following.collect())
        current = following
    letters = [r for r in corpus if r[1] and re.search(r"[^\W\d_]", r[1])]
    coded = ppm_language.identify(docs).where("lang_pred <> 'und'")
    assert coded.count() == len(letters)
    foreign = coded.where(F.col("bits_per_byte") > corpus_pipeline.MOST_BITS).count()  # letters the labelled documents never use
    assert 0 < foreign < 4 and len(kept[0]) == len(letters) - foreign and len(kept[1]) == len(kept[0])
    texts = [r["text"] for r in kept[2]]
    assert not any(similarity(shingle_bag(a), shingle_bag(b)) >= 0.8 for a, b in itertools.combinations(texts, 2))
    every = {r["text"] for r in kept[1]}
    assert all(any(similarity(shingle_bag(t), shingle_bag(k)) >= 0.8 or t == k for k in texts) for t in every)
    assert {r["text"] for r in kept[3]} == {t for t in texts if corpus[9][1] not in " ".join(t.split())}
    assert {r["doc_id"] for r in kept[4]} == {r["doc_id"] for r in kept[3]}
    assert corpus_pipeline.run(spark, path).count() == len(kept[4])


def test_copies_are_no_boilerplate(spark):
    """A third of a source are copies of one text and a third near copies of another: a document of each stays whole."""
    rng = random.Random(12)
    body = lambda: [sentence(rng, 12) for _ in range(12)]
    copied, near = body(), body()
    texts = ["\n".join(copied)] * 15 + ["\n".join([*near[:-1], f"{near[-1]} n{i}"]) for i in range(15)] + ["\n".join(["site menu line", *body()]) for _ in range(15)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    cleaned = corpus_pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "")
    kept = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert all(kept[i] == texts[i] for i in range(30))
    assert all(kept[i] == texts[i].removeprefix("site menu line\n") for i in range(30, 45))
    first = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, cleaned, "").collect()}
    assert first == {0, 15, *range(30, 45)}


def test_pairs_inside_a_template_family(spark):
    """Texts that share a template are not near duplicates by it; the planted pairs among them are found."""
    rng = random.Random(21)
    template = sentence(rng, 176)
    rows = []
    for i in range(200):
        own = [f"w{i}x{k}" for k in range(28)]
        rows.append((i, f"{template} {' '.join(own)}"))
        if i < 12:
            rows.append((1000 + i, f"{template} {' '.join([*own[:12], *[f'v{i}x{k}' for k in range(16)]])}"))
    bags = {i: shingle_bag(t) for i, t in rows}
    assert all(similarity(bags[i], bags[1000 + i]) >= 0.8 for i in range(12)) and similarity(bags[0], bags[1]) < 0.8
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicate_classes(texts).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    nodes = texts.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"))
    met = dart_minhash.overlapping(nodes, texts.select(F.col("doc_id").alias("node"), "text"))
    pairs = {tuple(sorted((r["node"], r["leader"]))) for r in met.collect()}
    assert pairs == {(i, 1000 + i) for i in range(12)}


def test_partial_quotes_and_mail_without_threads(spark):
    rows = [("a", 0, "One line\nand two\n\nsecond part\n\nthird part\n\nfourth"), ("a", 1, "x\n> second part\n>\n> third\n> part"), ("b", 2, "y\n> and two"),
            (None, 3, "z\n> second part\n> third part\n> fourth"), ("a", 4, "w\n> third part\n> second part"), ("a", 5, "v\n> y")]
    mail = spark.createDataFrame(rows, "thread string, position long, text string")
    parents = lambda out: {r["position"]: r["parent"] for r in out.collect()}
    assert parents(quotation_links.conversations(mail)) == {0: None, 1: 0, 2: None, 3: None, 4: None, 5: None}
    assert parents(quotation_links.conversations(mail, None)) == {0: None, 1: 0, 2: 0, 3: 0, 4: None, 5: 2}


def test_stages_on_empty_tables_and_clashing_columns(spark, docs, clashing, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(1, "no id here")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    names = docs.columns
    extra = [c for c in clashing.columns if c not in names]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
        plain, more = stage(spark, docs, path), stage(spark, clashing, path)
        if name == "packing":
            assert multiset(plain.drop("sequence_id", "offset")) == multiset(more.drop("sequence_id", "offset"))
        else:
            assert plain.columns == names and more.columns == clashing.columns
            assert multiset(plain) == multiset(more.select(*names)) and multiset(more.select(*extra).distinct()) == {("extra",) * len(extra): 1}
    # nulls and repeated rows: one row of each null id and text, and of each class
    first = corpus_pipeline.near_duplicates(spark, docs, path).collect()
    assert sum(r["text"] is None for r in first) == 1 and len({(r["doc_id"], r["text"]) for r in first}) == len(first)


def test_string_ranges_count_all_rows(spark, monkeypatch):
    """Cuts lie at exact shares of all rows, not of a sample."""
    monkeypatch.setattr(hilbert, "SAMPLE_ROWS", 16, raising=False)
    values = [f"{i * i % 997:03d}" for i in range(800)] + [None] * 100
    steps = [i / 8 for i in range(1, 8)]
    rows = spark.createDataFrame([(v,) for v in values], "lang string").repartition(4)
    known = sorted(v for v in values if v is not None)
    assert hilbert.string_cuts(rows, "lang", steps) == [known[int(s * len(known))] for s in steps]
    assert hilbert.string_cuts(rows.where("lang is null"), "lang", steps) == []
    assert hilbert.string_cuts(rows.where("lang = '001'").limit(1), "lang", steps) == ["001"] * 7


def test_groups_are_renamed_once_per_node(spark):
    """The step that names groups anew sees a row per node, not one per bucket that the node is in."""
    names = spark.createDataFrame([(1, 1, 5), (2, 2, 4), (3, 2, 4), (4, 4, 1)], "node long, label long, weight long")
    found = spark.createDataFrame([(2, 4, 1, 5)], "label long, weight long, leader_label long, leader_weight long")
    assert multiset(dart_minhash._renamed(names, found)) == multiset(spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 1, 5), (4, 4, 1)], names.schema))


def test_leaders_of_many_buckets_are_met_once(spark):
    """A node that shares all its buckets with the same leaders makes a row for each of them, not for each bucket."""
    rows = [(band, node, 24, node, 24) for band in range(24) for node in range(40)]
    members = dart_minhash.led(spark.createDataFrame(rows, "band long, node long, shared long, label long, weight long"))
    met = dart_minhash._meetings(members)
    plan = met._jdf.queryExecution().optimizedPlan()
    assert plan.toString().index("Generate") < plan.toString().index("Aggregate")  # above it, so later
    got = multiset(met.select("node", "leader"))
    assert got == {(n, l): 1 for n in range(40) for l in (37, 38, 39) if n != l}
    assert multiset(met.select("label", "weight", "leader_label", "leader_weight").distinct()) == {(n, 24, l, 24): 1 for n in range(40) for l in (37, 38, 39) if n != l}


def test_native_elements_and_similarity(spark):
    """Against brute force: repeated shingles, short texts, blanks of all kinds, texts without words."""
    rng = random.Random(31)
    made = [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["", " \t\n", "a", "\va b\f c\r\n", "a b c d e", "ä\u00a0ö b c d e f"]
    rows = [(i, a, b) for i, (a, b) in enumerate((rng.choice(made), rng.choice(made)) for _ in range(200))] + [(200 + i, t, t) for i, t in enumerate(made)]
    bag = lambda t: (lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w])
    want = {i: (sum(bag(a).values()), sum((bag(a) & bag(b)).values()) / max(sum((bag(a) | bag(b)).values()), 1)) for i, a, b in rows}
    found = sql_shingles.elements(F.col("a"), 5)
    got = spark.createDataFrame(rows, "i long, a string, b string").select(
        "i", F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("distinct"), sql_shingles.similarity(F.col("a"), F.col("b"), 5).alias("similarity")).collect()
    assert {r["i"]: (r["n"], r["similarity"]) for r in got} == want and all(r["n"] == r["distinct"] for r in got)


def test_native_search_finds_the_same_classes(docs, corpus):
    columns = ("doc_id", "class_id", "is_first", "text_hash")
    found = dart_minhash.near_duplicate_classes(docs, native=True)
    assert multiset(found.select(*columns)) == multiset(dart_minhash.near_duplicate_classes(docs).select(*columns))


def test_line_stage_runs_no_python(spark, docs, monkeypatch):
    """The stage line_dedup is made of DataFrame functions, its search for copies too."""
    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    want = multiset(corpus_pipeline.lines(spark, docs, ""))
    monkeypatch.setattr(type(docs), "mapInArrow", refused)
    assert multiset(corpus_pipeline.lines(spark, docs, "")) == want


def test_stored_tables_are_made_in_small_pieces(spark, docs):
    from tidemark.llm import common

    keys = (common.ARROW_ROWS, common.READER_ROWS)
    before = [spark.conf.get(k) for k in keys]
    with common.small_batches(spark):
        assert [int(spark.conf.get(k)) for k in keys] == [common.BATCH_ROWS] * 2
    assert [spark.conf.get(k) for k in keys] == before
    stored = corpus_pipeline.language(spark, docs, "")
    assert stored.inputFiles() and multiset(stored) == multiset(spark.read.parquet(*stored.inputFiles()))
