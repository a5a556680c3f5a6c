"""Decontamination, lexical search and spelling variants: brute force and the defined results of odd rows."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from regioprofile.llm import decontam, lexical, plainwords, spelling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "Eins zwei, DREI vier; fünf sechs"), (3, "Eins zwei, DREI vier; fünf sechs"), (None, "eins-zwei drei ÄÖ äö\x00x"), (5, "!!! ..."), (6, "zwei " * 40_000), (7, "ab1 漢字 𝒳y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in ("_row", "_text", "n_words", "spans", "items", "n", "terms", "tf", "id", "word", "contamination")})


ITEMS = [(1, "zwei drei vier"), (2, "ZWEI zwei zwei zwei zwei zwei zwei zwei zwei zwei zwei"), (3, None), (4, ""), (5, "?!"), (None, "eins zwei"), (6, "fünf"), (6, "ab1 漢字"), (7, "äö X"), (8, "nie da")]


def brute_hits(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        q = words(t)
        k = min(10, len(q))
        windows = {tuple(q[p : p + k]) for p in range(len(q) - k + 1)} if k else set()
        for p in range(len(w) - k + 1):
            if windows and tuple(w[p : p + k]) in windows:
                hit |= set(range(p, p + k))
                found |= {i}
    return len(w), len(hit), sorted({str(i) for i in found if i is not None}), hit


@pytest.mark.parametrize("block", [3_000_000, 40])
def test_hits_and_spans_equal_brute_force(spark, odd, monkeypatch, block):
    """In one pass over the texts and in several, whose spans are merged."""
    monkeypatch.setattr(plainwords, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 1000)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("own"))
    got = decontam.scan(odd, items)
    assert got.columns == odd.columns and got.count() == odd.count()
    for r in got.collect():
        n, n_hit, found, hit = brute_hits(r.text, ITEMS)
        c = r.contamination
        assert (c.n_words, c.n_hit, c["items"]) == (n, n_hit, found)
        places = [m.span() for m in WORD.finditer(lower(r.text or ""))]
        covered = {k for k, (a, b) in enumerate(places) if any(s.start <= a and b <= s.end for s in c.spans)}
        assert covered == hit and all(r.text[s.start : s.end] == r.text[s.start : s.end].strip(" .,;!-") for s in c.spans)
    assert decontam.scan(odd.limit(0), items).count() == 0
    assert all(r.contamination.n_hit == 0 for r in decontam.scan(odd, items.limit(0)).collect())


def test_contamination_is_removed(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = decontam.without_contamination(odd, items)
    assert whole.columns == odd.columns and sorted(str(r.doc_id) for r in whole.collect()) == ["1", "2", "5"]
    cut = {r.doc_id: r.text for r in decontam.without_contamination(odd, items, remove="spans").collect()}
    assert cut[3] == "  ;   sechs" or not words(cut[3]) or words(cut[3]) == ["sechs"]
    assert cut[1] is None and cut[2] == "" and cut[5] == "!!! ..." and words(cut[7]) == ["𝒳y"] and not words(cut[6])
    some = decontam.without_contamination(odd, items, max_share=0.7)
    assert {r.doc_id: words(r.text) for r in some.collect()}[7] == ["𝒳y"]
    with pytest.raises(ValueError, match="documents"):
        decontam.without_contamination(odd, items, remove="words")


def brute_ranking(docs, items, top=10):
    counts = [(d, collections.Counter(words(t))) for d, t in docs]
    some = [(d, c) for d, c in counts if c]
    n_docs, n_words = len(some), sum(sum(c.values()) for _, c in some)
    df = collections.Counter(t for _, c in some for t in c)
    out = []
    for i, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        q, scored = collections.Counter(words(text)), []
        for d, c in some:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_words
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, k in q.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("block", "exact"), [(3_000_000, True), (40, True), (3_000_000, False)])
def test_ranking_equals_brute_force(spark, odd, monkeypatch, block, exact):
    monkeypatch.setattr(plainwords, "BLOCK_CHARS", block)
    if not exact:
        monkeypatch.setattr(lexical, "EXACT_BELOW", 1)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rng = random.Random(6)
    docs += [(100 + i % 50, " ".join(rng.choice(["eins", "zwei", "drei", "vier", "da", "zweig"]) for _ in range(rng.randint(1, 9)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(5)
    items = spark.createDataFrame([*ITEMS, (9, "zwei zwei da"), (9, "zwei zwei da")], "item_id long, text string")
    got = lexical.search(df, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_ranking(docs, [*ITEMS, (9, "zwei zwei da")])
    assert lexical.search(df.limit(0), items).count() == 0 and lexical.search(df, items.limit(0)).count() == 0


def test_ranking_of_the_supplied_tables_and_text_ids(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = lexical.search(docs.withColumn("doc_id", F.format_string("d%06d", "doc_id")), items)
    want = brute_ranking([(int(r.doc_id), r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(str((r.item_id, r.rank, int(r.doc_id[1:]), r.score)) for r in got.collect()) == want


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(vocab):
    near = {w: [v for v in vocab if edits(w, v)] for w in vocab}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * vocab[w] else None
    out = []
    for w in vocab:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, vocab[w], form[w], root, len(near[w]), vocab[form[w]] if form[w] else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [8192, 7])
def test_near_words_of_dense_lists(spark, monkeypatch, size):
    """Words over a small alphabet, hence many near ones, long shared prefixes and repeated letters; blocks of any size."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", size)
    monkeypatch.setattr(spelling, "VISITORS", 5)
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
    stems = ["aaaaaa", "abcabcabcabc", "é" * 70, "b" * 66]
    vocab = {word() for _ in range(150)} | {s[:i] + x + s[i + c :] for s in stems for i in range(0, len(s) + 1, 3) for x in ("a", "b", "z") for c in (0, 1)} | {"aaaaaaa", "aaaaaaaa"}
    counts = {w: rng.choice([5, 6, 25, 30, 150, 900]) for w in sorted(vocab) if len(w) >= 6}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df).collect()}
    for w in counts:
        own = [v for v in counts if edits(w, v)]
        best = min(own, key=lambda v: (-counts[v], v), default=None)
        assert got.get(w) == ((len(own), counts[best], best) if own else None), w


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["Straßenbahn", "strassenbahn", "wanderung", "Wanderungen", "économie", "economie", "abcdef", "abcdeg", "kurz"]
    docs = []
    for i in range(400):
        w = [b if rng.random() < 0.85 else b[: (k := rng.randrange(len(b)))] + rng.choice(["", "x", "é"]) + b[k + 1 :] for b in rng.choices(base, [1, 30, 200, 20, 9, 60, 3, 90, 9], k=12)]
        docs.append((None if i % 50 == 0 else i % 300, rng.choice([" ", "-", "1"]).join(w)))
    docs += [(500, "kettenxx " * 6 + "kettenx " * 40 + "ketten " * 300), (1, None), (2, ""), (3, "123 !"), (4, "Wanderung " * 30_000), (4, "Wanderung " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("word", "n", "id")})
    vocab = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            vocab[run] += 1
    vocab = {w: n for w, n in vocab.items() if len(w) >= 6 and n >= 5}
    got = spelling.variants(df)
    assert got.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_variants(vocab) and any(r.root != (r.form or r.word) for r in got.collect())
    assert spelling.variants(df.limit(0)).count() == 0


def test_a_prefix_reaches_what_one_edit_can_change():
    assert spelling.reaches("", "abc") and spelling.reaches("abc", "abc") and spelling.reaches("axc", "abcd") and spelling.reaches("bc", "abcd") and spelling.reaches("xabc", "abcd")
    assert not spelling.reaches("xyc", "abcd") and not spelling.reaches("bcx", "abcd")
