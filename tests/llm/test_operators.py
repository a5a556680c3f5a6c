"""Corpus operators: brute force, round trips and the defined results of odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regioprofile.llm import common, dedup, hmm, langid, licenses, neighbours, packing, quality, queries, rules, segment, warc

SF = "/root/testdata/sf0.001"
LONG = "wort " * 30_000
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with names that operators use."""
    rows = [(1, None, "en", None), (2, "", None, "s"), (3, LONG, "en", "s"), (4, "a b c", None, None), (4, "a b c", None, None), (None, "x y", "de", "s"), (6, "!!! 123", "de", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("own") for c in ("score", "kept", "length", "n", "row", "key", "value")})


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_count_as_brute_force(docs, odd):
    for df in (docs, odd):
        for r in rules.quality_rules(df).collect():
            q = r.quality_rules
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == brute_counts(r.text)
            assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words) and not (q.base_failed and q.kept)
    assert rules.quality_rules(odd).columns == [*odd.columns, "quality_rules"]
    assert rules.quality_rules(odd.limit(0)).count() == 0


def test_rules_reject_outliers_of_a_group(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(120)), "xx", "s") for i in range(300)] + [(999, " ".join(word() + "$$$" for _ in range(120)), "xx", "s")]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert [(r.doc_id, r.quality_rules.reason) for r in got.filter("not quality_rules.kept").collect()] == [(999, "symbol_share")]


def test_rules_let_a_small_source_have_its_style(spark):
    rng = random.Random(5)
    word = lambda upper: "".join(rng.choice("abcdefgh") for _ in range(5)).capitalize() if upper else "".join(rng.choice("abcdefgh") for _ in range(5))
    text = lambda upper: " ".join(word(upper) for _ in range(120))
    for n in (150, 250):  # on both sides of the size at which cutoffs once switched
        rows = [(i, text(False), "xx", "big") for i in range(900)] + [(1000 + i, text(True), "xx", "own") for i in range(n)] + [(2000, text(True).upper(), "xx", "own")]
        got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
        assert [(r.doc_id, r.quality_rules.reason) for r in got.filter("not quality_rules.kept").collect()] == [(2000, "upper_share")]


def test_rules_reject_repetition_in_long_lines(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    rows = [(i, "\n".join(words(10) for _ in range(20)), "xx", "s") for i in range(300)]
    line, part = words(10), words(40)
    rows += [(998, "\n".join([line] * 5 + [words(10) for _ in range(15)]), "xx", "s"), (999, f"{part} {words(170)} {part}", "xx", "s")]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted((r.doc_id, r.quality_rules.reason) for r in got.filter("not quality_rules.kept").collect()) == [(998, "dup_line_share"), (999, "repeat_share")]


def test_rules_on_long_and_short_words_and_cutoffs_of_groups(spark):
    """The two cutoffs of the mean word, and that one text is within its own group's cutoff and beyond another's."""
    rng = random.Random(11)
    text = lambda low, high, n=120: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(low, high))) for _ in range(n))
    rows = [(i, text(4, 6), "xx", "short") for i in range(200)] + [(300 + i, text(9, 14), "xx", "long") for i in range(200)]
    rows += [(900, text(9, 14), "xx", "short"), (901, text(4, 6), "xx", "long")]
    got = rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted((r.doc_id, r.quality_rules.reason) for r in got.filter("not quality_rules.kept").collect()) == [(900, "mean_word"), (901, "mean_word_low")]


def test_rules_adapt_in_the_supplied_table(spark):
    """At 10,000 rows: no cutoff is one constant, several rules reject, two runs agree, and good documents stay."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.quality_rules for r in rules.quality_rules(docs, keep=["doc_id"]).collect()}
    again = {r.doc_id: r.quality_rules for r in rules.quality_rules(docs.repartition(7), keep=["doc_id"]).collect()}
    assert got == again
    row = F.struct(F.col("doc_id")).alias("_row")
    measured = rules._shares(docs.select(row, F.col("lang").alias("_lang"), F.col("source").alias("_source"), rules.measures(F.col("text")).alias("_m")))
    limits = rules._limits(measured).collect()
    assert len(limits) == 80 and all(len({r[f"_high_{m}"] for r in limits}) >= 10 for m in rules.CUTOFFS)
    reasons = collections.Counter(r.reason for r in got.values() if not r.base_failed and not r.kept)
    assert len(reasons) >= 4 and reasons["symbol_share"] < sum(reasons.values())
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lost = [d for d, r in got.items() if quality.get(d) == 1 and not r.base_failed and not r.kept]
    assert len(lost) < 0.02 * sum(q == 1 for q in quality.values())
    assert not [d for d, r in got.items() if quality.get(d) == 0 and r.kept]


def test_cross_parsing_equals_substring_search(docs):
    samples = langid.language_samples(docs, chars=4000) | {"zh": "".join(chr(0x4E00 + i * i % 3000) for i in range(4000)), "ja": "".join(chr(0x3041 + i * i % 83) + chr(0x20000 + i % 500) for i in range(1000))}
    parser = langid.CrossParser(samples)
    as_text = lambda t: "".join(map(chr, langid.letters_and_gaps([t])[0]))
    rng = random.Random(3)
    varied = " ".join(rng.choice(samples[rng.choice(["de", "en", "zh"])][i:][:30]) for i in range(400))
    source = as_text(samples["en"])
    texts = [*(r.text for r in docs.limit(8).collect()), "", "123", "Ünï 漢字 𝒳 test", varied, source[500:3000], samples["zh"][900:3500], "ab" * 3000, *samples.values()]
    points, lengths, _ = langid.letters_and_gaps(texts)
    got = parser.phrases(parser.codes(points), lengths)
    for row, text in enumerate(texts):
        stream = as_text(text)
        for k, lang in enumerate(parser.langs):
            source, n, i = as_text(samples[lang]), 0, 0
            while i < len(stream):
                j = i + 1
                while j <= len(stream) and stream[i:j] in source:
                    j += 1
                i, n = max(i + 1, j - 1), n + 1
            assert got[row, k] == n


def test_languages_of_other_scripts_need_little_memory(spark):
    rng = random.Random(8)
    zh = [chr(c) for c in rng.sample(range(0x4E00, 0x9FA0), 4000)]
    text = lambda own, n: "".join(rng.choice(own) for _ in range(n))
    common = {"zh": [text(zh, 3) for _ in range(900)], "ja": [text([chr(c) for c in range(0x3041, 0x3097)], 4) for _ in range(500)], "en": [text("abcdefghij", 5) for _ in range(300)]}
    rows = [(f"{k}{i}", " ".join(rng.choice(own) for _ in range(200)), k) for k, own in common.items() for i in range(80)]
    samples = langid.language_samples(spark.createDataFrame(rows[::2], "doc_id string, text string, lang string"))
    parser = langid.CrossParser(samples)
    assert parser.next.owner.nbytes + parser.next.to.nbytes < 20_000_000
    assert parser.predict([r[1] for r in rows[1::2]])["lang_pred"].tolist() == [r[2] for r in rows[1::2]]


def test_languages(spark, docs, odd):
    got = queries.op3_cross_parsing_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.98 * len(got)
    samples = langid.language_samples(docs)
    und = {(r.doc_id, r.text): r.language.lang_pred for r in langid.with_language(odd, samples).collect()}
    assert und[(1, None)] == und[(2, "")] == und[(6, "!!! 123")] == "und" and und[(4, "a b c")] != "und"
    assert langid.with_language(odd, langid.language_samples(odd.limit(0))).filter("language.lang_pred <> 'und'").count() == 0


def test_language_predictions_equal_brute_force(spark, docs):
    """lang_pred and score of the query, from greedy parses by plain substring search."""
    held = common.id_remainder("doc_id", 4) == 2
    drawn = langid.language_samples(docs.filter(~held))
    samples = {k: "".join(map(chr, langid.letters_and_gaps([v])[0])) for k, v in drawn.items()}
    cost = {k: math.log2(2 + len(v)) / math.log2(2 + max(map(len, drawn.values()))) for k, v in drawn.items()}
    got = {r.doc_id: r for r in queries.op3_cross_parsing_language(spark, SF).collect()}
    texts = sorted((r for r in docs.collect() if r.text), key=lambda r: (len(r.text), r.doc_id))[:40]
    for r in texts:
        stream, phrases = "".join(map(chr, langid.letters_and_gaps([r.text])[0])), {}
        for lang, source in samples.items():
            i = n = 0
            while i < len(stream):
                j = i + 1
                while j <= len(stream) and stream[i:j] in source:
                    j += 1
                i, n = max(i + 1, j - 1), n + 1
            phrases[lang] = n * cost[lang]
        letters = any(c.isalpha() for c in r.text)
        best = min(sorted(phrases), key=phrases.get) if letters else "und"
        score = 1 / sum(2.0 ** (phrases[best] - n) for n in phrases.values()) if letters else 0.0
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - score) < 1e-9


def test_languages_of_unequal_samples(spark):
    """A language of which only 300 characters are known is found as well as the others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200").orderBy("doc_id").collect()
    by = {k: [r.text for r in docs if r.lang == k] for k in ("de", "en", "fr", "es")}
    for small in ("fr", "de"):
        samples = {k: "\n".join(t[:1000] for t in texts[:40])[: 300 if k == small else 32_000] for k, texts in by.items()}
        texts, langs = zip(*[(t, k) for k, own in by.items() for t in own[40:110]], strict=True)
        got = langid.CrossParser(samples).predict(list(texts))["lang_pred"].tolist()
        assert sum(a != b for a, b in zip(got, langs, strict=True)) <= 0.01 * len(langs)


def test_quality_on_held_out_rows(spark, odd):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    x = queries.op2_compression_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in x) >= 0.95 * len(x)
    model = quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id"))
    got = quality.with_quality(odd, model).collect()
    assert len(got) == 7 and all(0 <= r.quality_score.score <= 1 for r in got)
    assert quality.with_quality(odd, quality.fit(odd.limit(0).withColumn("quality", F.lit(1)))).count() == 7


def test_quality_equals_brute_force(spark):
    """Sample, dictionaries, sizes, calibration and scores of the query, made again with plain zstandard and gradient steps."""
    import zstandard

    root = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{root}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in docs}
    assert 0 < len(labels) < quality.SAMPLE_ROWS  # all are drawn
    rows = spark.createDataFrame([(docs[i], y) for i, y in labels.items()], "t string, y int").selectExpr("t", "y", "pmod(xxhash64(t, 9), 2) AS half", "pmod(xxhash64(t, 5), greatest(1, length(t) - 999)) AS place").collect()
    parts = sorted(((r.t[r.place : r.place + 1000].encode(), r.y) for r in rows if r.half == 0), key=lambda r: (zlib.crc32(r[0]), r))
    held = [zstandard.ZstdCompressionDict(b"\n".join(b for b, z in parts if z == y)[:600_000], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for y in (0, 1)]
    size = lambda d, b: len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False).compress(b))

    def features(t):
        b = t.encode()
        bad, good = (sum(size(d, b[k : k + 262144]) for k in range(0, len(b), 262144)) for d in held)
        return [1.0, (bad - good) / len(b), (bad - good) / (bad + good)] if b else [1.0, 0.0, 0.0]

    x, y = (np.array(c, float) for c in zip(*((features(r.t), r.y) for r in rows if r.half == 1)))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    got = {r.doc_id: r for r in queries.op2_compression_quality(spark, root).collect()}
    some = sorted(docs)[::7]
    score = np.array([got[i].score for i in some])
    logit = np.log(score / (1 - score))
    f = np.array([features(docs[i]) for i in some])
    inner = np.abs(logit) < 20
    w = np.linalg.lstsq(f[inner], logit[inner], rcond=None)[0]
    assert np.abs(sigmoid(f @ w) - score).max() < 1e-6  # the scores are a logistic curve of these sizes ...
    slope = x.T @ (y - sigmoid(x @ w)) - 1e-3 * w
    assert np.abs(slope).max() < 1e-3  # ... whose weights make the labels likeliest
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.5) for i in docs)


def test_quality_counts_the_end_of_a_long_text():
    rng = random.Random(1)
    lists = [["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)] for _ in range(3)]
    text = lambda k, size: " ".join(rng.choice(lists[k]) for _ in range(size // 8))
    scorer = quality.Scorer(quality.Model(text(0, 600_000).encode(), text(1, 600_000).encode(), (0.0, 0.0, 0.0)))
    short, filler = text(0, 300_000), text(2, 3_000_000)
    gain = lambda t: scorer.features([t])[0, 1] * len(t)
    assert gain(short) > 1000 and abs(gain(filler + short) - gain(filler) - gain(short)) < 0.2 * gain(short)


def test_licences(docs, odd):
    model = licenses.train(docs)
    got = {(r.doc_id, r.family, r.start, r.length) for r in licenses.scan(docs, model).collect() if r.confirmed}
    want = set()
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    for r in docs.collect():
        at = 0
        for line in r.text.split("\n"):
            if line in lines:
                want.add((r.doc_id, lines[line], at, len(line)))
            at += len(line) + 1
    assert got == want and want
    assert licenses.scan(odd, model).count() == 0 and licenses.scan(odd.limit(0), model).count() == 0


def test_licences_wrapped_over_lines_and_two_in_a_line(docs):
    model = licenses.train(docs)
    mit, bsd, gpl = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["BSD"][0], licenses.TEMPLATES["GPL-3.0"][1]
    for family, template in (("MIT", mit), ("BSD", bsd), ("GPL-3.0", gpl)):
        own = template.split(" ")
        for width in (5, 9, 12):
            body = "\n".join(" * " + " ".join(own[i : i + width]) for i in range(0, len(own), width))
            rows = list(licenses.scan_text(model, f"some words\n\n{body}\n\nother words"))
            assert [(r[0], r[1], r[2], r[3], r[7]) for r in rows] == [(2, 12, len(body), family, True)]
    both = f"one two three {mit} and then four five six Licensed under CC BY-SA 4.0. seven eight"
    assert {r[3] for r in licenses.scan_text(model, both) if r[7]} == {"MIT", "CC-BY-SA"}


def test_licences_of_misleading_lines_and_order_of_the_sample(spark, docs):
    model = licenses.train(docs)
    lines = ["He was granted a license to drive free of charge.", "The software was provided by a general public of apache clerks.", "version 3 of the work", "The terms of the agreement are licensed to any person.", "Permission to land was hereby granted."]
    assert not [r for line in lines for r in licenses.scan_text(model, line) if r[7]]
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            assert [r[3] for r in licenses.scan_text(model, f"Some words before.\n{t}\nOther words.") if r[7]] == [family], t
    again = licenses.train(docs.repartition(7, "text"))
    assert again.index == model.index and np.array_equal(again.weights, model.weights)


def test_licences_in_other_words_are_found_wrapped_as_in_a_line(docs):
    model = licenses.train(docs)
    notices = {
        "BSD": "Redistribution and use of the source code / and of compiled binary forms, modified or not, / is permitted so long as these conditions are met:",
        "Apache-2.0": "This software may be used under the / terms of the licence of the Apache / Software Foundation, in its version / 2.0; the license is at hand.",
    }
    filler = "\n".join(["Whbles onin ganing rel tieser"] * 20)
    for family, notice in notices.items():
        flat, body = notice.replace(" / ", " "), notice.replace(" / ", "\n")
        (one,) = licenses.scan_text(model, f"some words\n\n{flat}\n\nother words")
        (several,) = licenses.scan_text(model, f"some words\n\n{body}\n\nother words")
        assert one[3] == several[3] == family and abs(one[4] - several[4]) < 1e-9 and one[6:] == several[6:] and several[:3] == (2, 12, len(body))
        (inside,) = licenses.scan_text(model, f"{filler}\n{body}\n{filler}")
        assert inside[3] == family and body.startswith((f"{filler}\n{body}\n{filler}")[inside[1] : inside[1] + inside[2]][:20])


def test_licence_rows_equal_a_plain_classifier(docs):
    """Family, probability and similarity of every row, from the weights and templates by plain loops, and that no line is missed."""
    model = licenses.train(docs)
    names = {row: f for f, row in model.index.items()}

    def plain(text):
        own = re.findall(r"[a-z0-9.]*[a-z0-9]", text.lower())
        have = set(own) | {f"{a} {b}" for a, b in zip(own, own[1:])}
        z = [model.sharpness * (model.bias[k] + sum(model.weights[row, k] for row in range(len(names)) if names[row] in have)) for k in range(len(model.families))]
        total = sum(math.exp(v - max(z)) for v in z)
        k = max(range(len(z)), key=z.__getitem__)
        pairs = list(zip(own, own[1:]))
        share = lambda t: (lambda w: sum(p in pairs for p in zip(w, w[1:])) / max(1, len(w) - 1))(re.findall(r"[a-z0-9.]*[a-z0-9]", t.lower()))
        return model.families[k], math.exp(z[k] - max(z)) / total, max(map(share, licenses.TEMPLATES[model.families[k]])) if k else 0.0

    got = {(r.doc_id, r.start): r for r in licenses.scan(docs, model).collect()}
    known = set(model.alert)
    lines = 0
    for d in docs.collect():
        at = 0
        for line in d.text.split("\n"):
            own = re.findall(r"[a-z0-9.]*[a-z0-9]", line.lower())
            if known & set(own):
                family, p, share = plain(line)
                r = got.pop((d.doc_id, at), None)
                assert (r is not None) == (family != "unknown" and p >= licenses.NAMES), line
                if r:
                    lines += 1
                    assert r.family == family and abs(r.probability - p) < 1e-9 and abs(r.similarity - share) < 1e-9 and r.confirmed == (share >= licenses.CONFIRMS) and r.length == len(line)
            at += len(line) + 1
    assert lines and not got


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD)
    special = [(20, "a <|endoftext|> b"), (21, "<|ENDOFTEXT|> It's <|startoftext|>")]
    for df in (docs, odd, docs.sparkSession.createDataFrame(special, "doc_id long, text string")):
        rows = packing.pack_documents(df, WORD, with_ids=True).collect()
        texts = collections.Counter((r.doc_id, r.text) for r in df.collect())
        ids = {k: plain.encode(k[1] or "", add_special_tokens=False).ids + [1] for k in texts}
        assert sum(r.length for r in rows) == sum(len(ids[k]) * n for k, n in texts.items())
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and any(r.ids == ids[k][r.start : r.start + r.length] for k in ids if k[0] == r.doc_id) for r in rows)
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append((r.offset, r.length))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
    assert packing.pack_documents(odd.limit(0), WORD).count() == 0


def test_word_tokenizer_equals_the_plain_one():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(WORD), packing.WordTokenizer(WORD)
    assert own.by_words
    rng = random.Random(1)
    texts = ["", None, "ΣΑΣ ß İ é é ́x .́ ≮ a≮", "don't.stop 'so' x'll y'S 3a4b a1.2", "\x0b\x0c x\u00a0y\u2003z", "漢字 テスト。 a漢", "a<|endoftext|>b <|Endoftext|>"]
    texts += ["".join(rng.choice("abS'T .,$1é́\t\n<|>ß漢") for _ in range(60)) for _ in range(500)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    other = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(other), packing.WordTokenizer(other)
    assert not own.by_words and [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_plan_holds_each_piece_once_and_is_tight(spark):
    rng = np.random.default_rng(0)
    drawn = np.bincount(np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 2), minlength=4097)
    few = np.zeros(4097, np.int64)
    few[[1500, 300]] = 1000, 7
    for have in (drawn, 1000 * drawn, few, np.zeros(4097, np.int64)):
        groups = packing.plan(have)
        again = np.zeros_like(have)
        for items, n in groups:
            assert sum(k * m for k, m in items) <= 4096
            for k, m in items:
                again[k] += m * n
        assert (again == have).all()
        assert sum(n for _, n in groups) <= (500 if have is few else 1.0005 * math.ceil((have * np.arange(4097)).sum() / 4096))
        assert have is few or packing.by_patterns(have)[1].sum() <= 0.65 * have.sum()
    # the patterns carry the supplied documents, and no sequence more is needed than the tokens fill
    for sf, most in (("sf0.001", 44), ("sf0.01", 221)):
        rows = packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), WORD).groupBy("length").count().collect()
        have = np.zeros(4097, np.int64)
        have[[r[0] for r in rows]] = [r[1] for r in rows]
        assert packing.by_patterns(have)[1].sum() < 0.5 * have.sum() and sum(n for _, n in packing.plan(have)) == most


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_banded_alignment_equals_full_matrix():
    rng = random.Random(0)
    for _ in range(1500):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 14))]
        b = a[:]
        for _ in range(rng.randint(0, 5)):
            i = rng.randint(0, len(b))
            b = b[:i] + [rng.randint(0, 3)] * rng.randint(0, 2) + b[i + rng.randint(0, 2) :]
        most, want = rng.randint(0, 8), lev(a, b)
        d = dedup.edit_distance(np.array(a), np.array(b), most)
        assert d == want if want <= most else d > most


def test_near_duplicates_equal_brute_force(docs, odd):
    rows = docs.select("doc_id", "text").collect()
    seqs = dict(zip([r.doc_id for r in rows], dedup.shingle_sequences([r.text for r in rows])))
    parent = {k: k for k in seqs}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(seqs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if root(a) != root(b) and len(set(seqs[a].tolist()) & set(seqs[b].tolist())) and dedup.similarity(seqs[a], seqs[b]) >= dedup.SIMILAR:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.component_id, r.kept) for r in dedup.near_duplicates(docs).collect()}
    assert got == {k: (root(k), root(k) == k) for k in ids}
    assert sorted((str(r.doc_id), r.kept) for r in dedup.near_duplicates(odd).collect()) == [(k, True) for k in ("1", "2", "3", "4", "6", "None")]
    assert dedup.near_duplicates(odd.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in dedup.without_near_duplicates(odd).collect()) == ["1", "2", "3", "4", "6", "None"]


def test_near_duplicates_of_repeated_and_null_ids_and_long_texts(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randint(0, 99999)}" for _ in range(n)]
    one, two, three, long = text(80), text(90), text(70), text(400_000)  # 2.7 MB
    changed = lambda w: " ".join(w[:20] + ["new"] + w[21:])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (5, " ".join(two)), (7, changed(one)), (8, changed(two)), (9, " ".join(three)), (None, changed(three)), (None, changed(three)), (1, None), (20, " ".join(long)), (21, changed(long)), (None, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("_kept", "h", "n", "t", "kept", "component", "row", "id")})
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True), (None, 9, False), (1, 1, True), (20, 20, True), (21, 20, False), (None, None, True)], key=str)
    kept = dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, (r.text or "")[:5])) for r in kept.collect()) == sorted(str((i, (t or "")[:5])) for i, t in [rows[0], rows[1], rows[5], rows[8], rows[9], rows[11]])


def test_copies_without_an_id_go_from_tables(spark):
    """Of rows of null id one stays for each group, none beside a row with an id; texts without words all stay."""
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(40))
    a, b, c = text(), text(), text()
    rows = [(None, a, "1"), (None, a, "2"), (None, a.upper() + ".", "3"), (None, a + " x", "4"), (7, b, "5"), (None, b, "6"), (None, c, "7"), (None, "", "8"), (None, None, "9"), (None, "", "10")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = dedup.without_near_duplicates(df)
    assert got.columns == df.columns
    kept = {r.h for r in got.collect()}
    assert len(kept & {"1", "2", "3", "4"}) == 1 and kept - {"1", "2", "3", "4"} == {"5", "7", "8", "9", "10"}


def test_members_of_a_hot_bucket_are_dealt_over_salts(spark):
    """Leaders, verdicts and pairs of a bucket with a third of all rows are those of plain joins, and no task has it whole."""
    n = 900
    rows = [(7 if i % 3 == 0 else i // 2, i * 2654435761 % 2**61 - 2**60, 50 + i % 40, i % 5) for i in range(n)]
    keys = spark.createDataFrame(rows, "key long, h long, n int, c long")
    members = {}
    for k, h, size, c in rows:
        members.setdefault(k, []).append((h, size, c))
    apart = {k: m for k, m in members.items() if len({c for *_, c in m}) > 1}
    got = dedup._apart(keys, dedup.BUCKET)
    assert sorted((r.key, r.h, r.few) for r in got.collect()) == sorted((k, m[0], len(v) <= dedup.BUCKET) for k, v in apart.items() for m in v)
    near = lambda a, b: min(a, b) >= dedup.SIMILAR * max(a, b) - 1e-6
    pairs = {(a[0], b[0]) for v in apart.values() for a in v for b in v if a[2] < b[2] and near(a[1], b[1])}
    found = [(r.lead, r.b) for r in dedup._pairs_apart(got).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    led = {(r.lead, r.b) for r in dedup._led(keys).collect()}
    first = {(min(v)[0], m[0]) for v in members.values() for m in v if m[2] != min(v)[2] and near(m[1], min(v)[1])}
    assert first <= led and led <= {(a[0], b[0]) for v in members.values() for a in v for b in v if a[2] != b[2]}
    dealt = got.filter("key = 7").groupBy(dedup._salt()).count().collect()
    assert len(dealt) > dedup.SALTS // 2 and max(r[1] for r in dealt) < 40
    assert dedup._apart(keys.limit(0)).count() == 0 and dedup._led(keys.limit(0)).count() == 0


def test_buckets_with_many_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 2)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(40):
        own = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        rows.append((3 * g, " ".join(passage + own)))
        rows.append((3 * g + 1, " ".join(passage + own[:-1] + ["changed"])))
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3 * g + 1] == got[3 * g] == 3 * g for g in range(40))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_warc_round_trip(spark, odd):
    pages = spark.createDataFrame([(5, "u", "<p>é</p>"), (3, None, "<p>é</p>"), (7, "u\r\nX: y", None), (8, "u", ""), (9, "u", LONG), (None, "u", "<p>é</p>"), (9, "u", LONG)], "page_id long, url string, html string")
    warc.write_archives(pages, path := common.new_path(spark, "test-warc"))
    got = warc.read_archives(spark, path, with_payload=True).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert [r.record_type for r in got if r.page_id is None] == ["revisit"]
    assert (by["3"].record_type, by["5"].record_type, by["5"].refers_to, by["8"].refers_to) == ("response", "revisit", "3", "7")
    assert by["9"].payload.decode() == LONG and by["5"].payload_bytes == len("<p>é</p>".encode())
    assert by["7"].payload_digest == base64.b32encode(hashlib.sha1(b"").digest()).decode()
    warc.write_archives(pages.limit(0), path := common.new_path(spark, "test-warc"))
    assert warc.read_archives(spark, path).count() == 0
    with pytest.raises(ValueError):
        list(warc.frames(b"not an archive at all"))
    good = warc.record(1, "u", b"abc", None)
    for bad in (good.replace(b"abc", b"abd"), good.replace(b"abc", b"abcd"), good.replace(b"WARC-Date", b"WARC-Dote"), b"HTTP" + good):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_warc_of_repeated_ids(spark):
    pages = spark.createDataFrame([(3, "X"), (4, "Y"), (5, "X"), (5, "Y"), (5, "Q"), (6, "Z"), (None, "X")], "page_id long, html string").withColumns({"url": F.lit("u"), "sha1": F.lit("own"), "first": F.lit("own")})
    warc.write_archives(pages, path := common.new_path(spark, "test-warc"))
    got = sorted((r.page_id or "-", r.record_type, r.refers_to or "", r.payload.decode(), r.payload_bytes) for r in warc.read_archives(spark, path, with_payload=True).collect())
    assert got == [
        ("-", "revisit", "3", "", 1), ("3", "response", "", "X", 1), ("4", "response", "", "Y", 1), ("5", "response", "", "Q", 1),
        ("5", "revisit", "3", "", 1), ("5", "revisit", "4", "", 1), ("6", "response", "", "Z", 1),
    ]


def test_warc_of_other_writers(spark, tmp_path):
    import io
    import struct

    import zstandard

    block = lambda *lines, body=b"": "\r\n".join(lines).encode() + b"\r\n\r\n" + body
    record = lambda kind, name, body, *more, version="WARC/1.0": block(version, f"warc-type:{kind}", f"WARC-Record-ID: <{name}>", "Warc-Date:2020-01-01T00:00:00Z", *more, f"CONTENT-LENGTH: {len(body)}", body=body) + b"\r\n\r\n"
    http = block("HTTP/1.1 200 OK", "content-type: text/html", "X-Long: a", " b", body=b"<p>hello</p>")
    sha1 = base64.b32encode(hashlib.sha1(b"<p>hello</p>").digest()).decode()
    records = [
        record("warcinfo", "urn:info", b"software: other"), record("request", "urn:q", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"), record("metadata", "urn:m", b"a: b"),
        record("response", "urn:uuid:1", http, f"WARC-Payload-Digest: sha256:{hashlib.sha256(b'<p>hello</p>').hexdigest()}"), record("response", "urn:uuid:2", http),
        record("revisit", "urn:uuid:3", block("HTTP/1.1 200 OK"), f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:1>", version="WARC/1.1"), record("response", "urn:uuid:4", b"plain"),
    ]
    held = zstandard.train_dictionary(2048, [r + bytes([i]) * 50 for i in range(200) for r in records])
    streamed = zstandard.ZstdCompressor(dict_data=held, write_content_size=False)
    packed = zstandard.ZstdCompressor().compress(held.as_bytes())
    data = struct.pack("<II", warc.DICTIONARY, len(packed)) + packed
    for r in records:
        one = streamed.compressobj()
        data += one.compress(r) + one.flush()
    (tmp_path / "other.warc.zst").write_bytes(data)
    got = {r.page_id: (r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload) for r in warc.read_archives(spark, str(tmp_path), with_payload=True).collect()}
    whole = ("response", 12, sha1, None, b"<p>hello</p>")
    plain = ("response", 5, base64.b32encode(hashlib.sha1(b"plain").digest()).decode(), None, b"plain")
    assert got == {"urn:uuid:1": whole, "urn:uuid:2": whole, "urn:uuid:3": ("revisit", None, sha1, "urn:uuid:1", b""), "urn:uuid:4": plain}
    with pytest.raises(ValueError):
        list(warc.frames(data[:-3]))
    # what is written here is a plain stream of frames to other readers
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>\n" * 300) for i in range(50)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), path := common.new_path(spark, "test-warc"))
    texts = 0
    for r in spark.read.format("binaryFile").load(path).collect():
        content = bytes(r.content)
        size = struct.unpack_from("<I", content, 4)[0]
        own = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size])) if struct.unpack_from("<I", content)[0] == warc.DICTIONARY else zstandard.ZstdDecompressor()
        texts += own.stream_reader(io.BytesIO(content), read_across_frames=True).read().count(b"WARC-Type: response")
    assert texts == 50


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    rows = [(i, (base[i % 40] + rng.standard_normal(24) * rng.choice([0.02, 0.15, 0.25])).tolist()) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, [0.0] * 24), (1004, [math.nan] * 24), (1005, [1.0] * 3), (1006, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("own"))
    x = np.array([r[1] for r in rows[:402]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= neighbours.LINK
    np.fill_diagonal(link, False)
    ids = [r[0] for r in rows[:402]]
    part = np.arange(402)
    while True:
        new = np.minimum(part, np.where(link, part[None, :], 9999).min(1))
        if (new == part).all():
            break
        part = new
    got = {r.vec_id: r for r in neighbours.linked_vectors(df).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, k in enumerate(ids) if got[k].n_links != link[i].sum() or got[k].component_id != ids[part[i]]]
    assert not wrong
    assert all(got[k].n_links == 0 and got[k].kept for k in range(1002, 1007))
    assert neighbours.linked_vectors(df.limit(0)).count() == 0


def cones(rng, n, dim, noise, directions):
    """Unit vectors around common directions, as most encoders' embeddings lie; noise is that of a component."""
    centre = rng.standard_normal((directions, dim))
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    x = centre[rng.integers(0, directions, n)] + rng.standard_normal((n, dim)) * noise / math.sqrt(dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("dim", "noise", "directions"), [(64, 0.24, 1), (64, 0.20, 1), (64, 0.22, 5), (160, 0.22, 3)])
def test_vectors_in_cones_keep_their_links(spark, dim, noise, directions):
    x = cones(np.random.default_rng(8), 500, dim, noise, directions)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    link = x @ x.T >= neighbours.LINK
    np.fill_diagonal(link, False)
    part = np.arange(len(x))
    while (new := np.minimum(part, np.where(link, part[None, :], 9999).min(1))).tolist() != part.tolist():
        part = new
    got = {r.vec_id: r for r in neighbours.linked_vectors(df).collect()}
    assert link.sum() > 10_000
    assert sum(r.n_links for r in got.values()) >= 0.999 * link.sum() and all(got[i].n_links <= link[i].sum() for i in got)
    assert [got[i].component_id for i in range(len(x))] == part.tolist()


def test_vectors_of_several_dimensions(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (6, [1.0, 0.0, 0.0, 0.0]), (7, []), (None, [3.0, 0.0]), (5, [0.0, 1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (None, 2, 4, False)], key=str)


def test_hidden_markov_scores(docs, odd):
    held = common.id_remainder("doc_id", 7) == 2
    rows = docs.select("doc_id", "text", held.alias("held")).collect()
    counts, ends = collections.Counter(), 0
    for r in rows:
        if not r.held:
            counts.update(r.text.encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {r.doc_id: r for r in hmm.fit_and_score(docs, ~held).collect()}
    better = 0
    for r in rows:
        w = r.text.encode().lower().split()
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*(counts[x] for x in w), ends])
        g = got[r.doc_id]
        assert (g.train_tokens, g.n_tokens, g.n_known) == (n, len(w) + 1, sum(counts[x] > 0 for x in w) + 1)
        assert abs(g.base_score - base) < 1e-6
        better += g.score > g.base_score
    assert better > 0.8 * len(rows)
    assert hmm.fit_and_score(odd, F.lit(True)).count() == 7
    assert hmm.fit_and_score(odd, F.lit(False)).filter("n_known > 0").count() == 0
    assert hmm.fit_and_score(odd.limit(0), F.lit(True)).count() == 0


def test_hidden_markov_words_outside_the_head_have_states(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 20)
    rng = random.Random(4)
    text = lambda k, n: " ".join(f"{k}{rng.randint(0, 9)}" for _ in range(n))
    rows = [(i, f"{text(k, 8)} {w} {text(k, 8)}") for i in range(200) for k, w in (("a", "foozz"), ("b", "barzz"))]
    rows += [(1000, "a1 a2 a3 foozz a4 a5"), (1001, "a1 a2 a3 barzz a4 a5"), (1002, "a1 a2 a3 newzz a4 a5")]
    got = {r.doc_id: r for r in hmm.fit_and_score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert abs(got[1000].base_score - got[1001].base_score) < 1e-9 and got[1002].n_known == got[1000].n_known - 1
    assert got[1000].score > got[1001].score + 1 and got[1000].score > got[1002].score + 1


def test_hidden_markov_scores_of_a_table_equal_a_plain_recursion(spark, docs, monkeypatch):
    """The trained model's scores, rare words and unknown ones too, and that its words' probabilities sum to one."""
    monkeypatch.setattr(hmm, "HEAD", 300)
    held = common.id_remainder("doc_id", 7) == 2
    train = docs.filter(~held)
    counts = common.written(hmm.count_words(train), "words")
    voc = hmm.vocabulary(counts, train.count())
    codes = hmm.coded(docs, voc, ~held)
    model, words, seen = hmm.train_model(codes, voc, rounds=6)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] and 0 < len(voc.head) <= 300
    k, head = len(model.start), len(voc.head)
    rare = {r.word: [r.s0, r.s1, r.s2, r.c * hmm.UNIT - r.s0 - r.s1 - r.s2] for r in words.collect()}
    known = {r.word: (r["class"], r.c) for r in counts.collect()}
    symbol = {int(w): i for i, w in enumerate(voc.head.view(np.int64))}

    def emission(word, group):
        if word in symbol:
            return model.emit[:, symbol[word]]
        t, n = voc.class_tokens[group], voc.class_words[group]
        e = np.array(rare.get(word, [0] * k)) / hmm.UNIT
        e = e + hmm.LEAN * e.sum()
        return model.emit[:, head + group] * (e * model.ratio[:, head + group] + 1) / (t + n + 1)

    total = sum(emission(w, g) for w, (g, _) in known.items()) + model.emit[:, -1] + sum(emission(None, g) for g in range(hmm.CLASSES))
    assert np.allclose(total, 1, atol=1e-4)
    got = {r.doc_id: r for r in hmm.score(codes, counts, voc, model, words).collect()}
    for r in docs.orderBy("doc_id").limit(25).collect():
        prints, last, _ = hmm.hashed_words([r.text])
        a, log = model.start, 0.0
        steps = [emission(int(w), int(c) % hmm.CLASSES) for w, c in zip(prints.view(np.int64), last)] + [model.emit[:, -1]]
        for i, e in enumerate(steps):
            a = (a if i == 0 else a @ model.move) * e
            log += math.log10(a.sum())
            a = a / a.sum()
        assert abs(got[r.doc_id].score - log) < 1e-6 * abs(log)


def test_forward_and_counts_equal_enumeration():
    rng = np.random.default_rng(0)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3))
    texts = [rng.integers(0, 5, k) for k in (6, 4, 4, 1)]

    def paths(t):
        import itertools

        for p in itertools.product(range(3), repeat=len(t)):
            q = m.start[p[0]] * m.emit[p[0], t[0]]
            for i in range(1, len(t)):
                q *= m.move[p[i - 1], p[i]] * m.emit[p[i], t[i]]
            yield p, q

    want = [math.log10(sum(q for _, q in paths(t))) for t in texts]
    assert np.allclose(m.log10_likelihoods(texts), want)
    start, moves, emitted, ll = m.counts(texts)
    s, a, e = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for t in texts:
        total = sum(q for _, q in paths(t))
        for p, q in paths(t):
            s[p[0]] += q / total
            for i, k in enumerate(p):
                e[k, t[i]] += q / total
                if i:
                    a[p[i - 1], k] += q / total
    assert np.allclose(start, s) and np.allclose(moves, a) and np.allclose(emitted, e) and np.isclose(ll, sum(want) * math.log(10))


def test_segmentations_follow_their_distribution():
    pieces = segment.Pieces(PIECE)
    lat = segment.Lattice(pieces, *segment.points_of(["it"]))

    def paths(p):
        if lat.last[p]:
            return [((), 1.0)]
        return [((int(lat.ids[e]), *r), lat.chance[e] * q) for e in range(lat.first[p], lat.first[p] + lat.count[p]) for r, q in paths(lat.to[e])]

    chance = dict(paths(0))
    assert abs(sum(chance.values()) - 1) < 1e-9
    n, first, pair, weight = 20_000, collections.Counter(), collections.Counter(), collections.Counter()
    by = collections.defaultdict(list)
    for d, _, ids, lp, li in segment.sample_texts(pieces, ["it"] * n, segment.mix(np.arange(n, dtype=np.uint64) + np.uint64(3)), 2):
        by[d].append(tuple(ids.tolist()))
        weight[tuple(ids.tolist())] += math.exp(lp - li) / n
    for own in by.values():
        assert len(set(own)) == 2
        first[own[0]] += 1 / n
        pair[tuple(own)] += 1 / n
    for a, q in chance.items():
        assert abs(first[a] - q) < 0.01 and abs(weight[a] - q) < 0.012
        for b, r in chance.items():
            if a != b:
                assert abs(pair[(a, b)] - q * r / (1 - q)) < 0.01


def test_segmentations_of_tables(docs, odd):
    for df in (docs, odd):
        rows = segment.decode(segment.encode(df, PIECE), PIECE).collect()
        texts = collections.defaultdict(set)
        for r in df.collect():
            texts[r.doc_id].add(r.text or "")
        assert all(r.text in texts[r.doc_id] for r in rows)
        assert {(r.doc_id, r.sample) for r in rows if r.sample == 0} == {(k, 0) for k in texts}
    a, b = ([(r.doc_id, r.sample, r.ids_crc32) for r in segment.encode(docs, PIECE, seed=s).collect()] for s in (0, 0))
    assert sorted(a) == sorted(b)
    assert segment.encode(odd.limit(0), PIECE).count() == 0


def test_pipeline(spark, docs, odd):
    import corpus_pipeline

    named = odd.withColumns({c: F.lit("own") for c in ("_kept", "_language", "quality_rules", "language", "_row", "id")})
    for name, stage in corpus_pipeline.STAGES[:3]:
        for df in (docs, odd, named, odd.limit(0)):
            got = stage(spark, df, SF)
            assert got.columns == df.columns and {r.language for r in (got.collect() if df is named else [])} <= {"own"}, name


def test_pipeline_equals_brute_force_stage_by_stage(spark):
    """Each stage on all that the stage before kept, made again without the operators' plans."""
    import corpus_pipeline
    import duckdb
    from tokenizers import Tokenizer

    from regioprofile.llm.oracles import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = common.written(corpus_pipeline.quality_rules(spark, docs, SF), "first")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op8_adaptive_rules']}) WHERE kept").fetchall()}
    assert sorted(r.doc_id for r in first.collect()) == sorted(kept)

    second = common.written(corpus_pipeline.language_id(spark, first, SF), "second")
    held = common.id_remainder("doc_id", 4) == 2
    parser = langid.CrossParser(langid.language_samples(first.filter(~held)))
    rows = first.collect()
    found = parser.predict([r.text or "" for r in rows])
    fits = collections.defaultdict(list)
    for r, f in zip(rows, found.itertuples()):
        if r.lang == f.lang_pred and zlib.crc32(str(r.doc_id).encode()) % 4 == 2:
            fits[r.lang].append(f.phrases_per_char)
    limit = {k: 1.3 * sorted(v)[math.ceil(0.99 * len(v)) - 1] for k, v in fits.items()}
    want = [r.doc_id for r, f in zip(rows, found.itertuples()) if f.lang_pred != "und" and f.score >= 0.5 and f.phrases_per_char <= limit.get(f.lang_pred, math.inf)]
    assert sorted(r.doc_id for r in second.collect()) == sorted(want)

    third = common.written(corpus_pipeline.near_dedup(spark, second, SF), "third")
    rows = sorted(second.select("doc_id", "text").collect())
    seqs = dedup.shingle_sequences([r.text for r in rows])
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and set(seqs[i].tolist()) & set(seqs[j].tolist()) and dedup.similarity(seqs[i], seqs[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert sorted(r.doc_id for r in third.collect()) == sorted({rows[g].doc_id for g in group})

    plain = Tokenizer.from_file(WORD)
    ids = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [1] for r in third.collect()}
    packed = corpus_pipeline.best_fit_packing(spark, third, SF).collect()
    want = [(d, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(np.array(x[k : k + 4096], "<u4").tobytes())) for d, x in ids.items() for k in range(0, len(x), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    places = collections.defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), [*sorted(own)[1:], (sum(n for _, n in own), 0)])) and sorted(own)[0][0] == 0 and sum(n for _, n in own) <= 4096
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, corpus_pipeline.best_fit_packing(spark, third, SF).select("doc_id", "piece", "ids_crc32").collect()))


def test_pipeline_rejects_a_language_without_labels(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 300").select("doc_id", "text", "lang")
    rng = random.Random(6)
    noise = [(-k, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(100)), None) for k in range(1, 6)]
    given = docs.withColumn("lang", F.when(F.col("lang") != "fr", F.col("lang"))).unionByName(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, given, "").select("doc_id").collect()}
    by = collections.defaultdict(set)
    for r in docs.collect():
        by[r.lang == "fr"].add(r.doc_id)
    assert len(by[True] & kept) <= 0.05 * len(by[True]) and len(by[False] & kept) >= 0.97 * len(by[False])
    assert not {k for k, _, _ in noise} & kept
