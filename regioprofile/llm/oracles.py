"""SQL for the queries that it can express, run by DuckDB over the same tables."""

from __future__ import annotations

from .rules import COUNT_BITS, COUNTS, CUTOFFS, LOWER, MAX_REPEAT_PCT, MIN_WORDS, PRIOR_ROWS, SHARES

#: crc32 of a text of ASCII characters.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::UBIGINT)), "
    "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
)
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable AS a JOIN usable AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
reached AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reached AS r JOIN links AS l ON r.other = l.a),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) AS c USING (vec_id)"""


def _rules() -> str:
    """Counts, base rule and cutoffs from weighted quantiles on the sketches' grid."""
    leading = lambda x, bits: f"({x}) - ({x}) % (1::BIGINT << greatest(length(bin({x})) - {bits}, 0))"
    grid = {}
    for m, (n, d, steps, bits) in SHARES.items():
        x = f"(({steps} * {n}::BIGINT) // greatest({d}, 1)::BIGINT)"
        grid[m] = leading(x, bits) if bits else x
    grid |= {c: leading(f"{c}::BIGINT", COUNT_BITS) for c in COUNTS}
    values = ", ".join(f"{{'k': '{k}', 'v': ({x})::BIGINT}}" for k, x in grid.items())
    wanted = sorted({(m, q) for m, (low, high, *_) in CUTOFFS.items() for q in (low, high)} | {(of, 0.5) for *_, of in CUTOFFS.values()})
    name = lambda m, q: f"{m}_{round(100 * q)}"
    columns = ", ".join(f"min(v) FILTER (WHERE k = '{m}' AND upto >= {q - 1e-9!r}::DOUBLE * total)::DOUBLE AS {name(m, q)}" for m, q in wanted)
    reasons = ["WHEN base_failed THEN 'base'"]
    for m, (lower, upper, factor, units, of) in CUTOFFS.items():
        low, high, steps, slack = name(m, lower), name(m, upper), float(SHARES[m][2]), f"{units}::DOUBLE / {name(of, 0.5)}"
        reasons.append(f"WHEN {m} > ({high} + {factor}::DOUBLE * ({high} - {low})) / {steps}::DOUBLE + {slack} THEN '{m}'")
        if m in LOWER:
            reasons.append(f"WHEN {m} < ({low} - {factor}::DOUBLE * ({high} - {low})) / {steps}::DOUBLE - {slack} THEN '{m}_low'")
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
counted AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN covered USING (rid)),
m AS (SELECT *, coalesce(n_symbols / nullif(word_chars, 0)::DOUBLE, 0) AS symbol_share, coalesce(n_upper / nullif(word_chars, 0)::DOUBLE, 0) AS upper_share, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_share,
    coalesce(n_repeat_words / nullif(n_words, 0)::DOUBLE, 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed FROM counted),
s AS (SELECT lang, source, k, v, count(*)::DOUBLE AS w FROM (SELECT lang, source, x.k AS k, x.v AS v FROM (SELECT lang, source, unnest([{values}]) AS x FROM m WHERE NOT base_failed)) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM m),
a AS (SELECT k, v, {PRIOR_ROWS} * w / sum(w) OVER (PARTITION BY k) AS w FROM (SELECT k, v, sum(w) AS w FROM s GROUP BY k, v)),
l AS (SELECT lang, k, v, {PRIOR_ROWS} * w / sum(w) OVER (PARTITION BY lang, k) AS w FROM (SELECT lang, k, v, sum(w) AS w FROM (SELECT lang, k, v, w FROM s UNION ALL SELECT lang, k, v, w FROM (SELECT DISTINCT lang FROM g) CROSS JOIN a) GROUP BY lang, k, v)),
o AS (SELECT lang, source, k, v, sum(w) AS w FROM (SELECT * FROM s UNION ALL SELECT g.lang, g.source, k, v, w FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang) GROUP BY lang, source, k, v),
q AS (SELECT lang, source, {columns} FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, k ORDER BY v) AS upto, sum(w) OVER (PARTITION BY lang, source, k) AS total FROM o) GROUP BY lang, source),
judged AS (SELECT m.*, CASE {" ".join(reasons)} END AS reason FROM m LEFT JOIN q ON q.lang IS NOT DISTINCT FROM m.lang AND q.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM judged"""


_BITS = "array_to_string(list_transform(string_split(sha1(html), ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', c)]), '')"
ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, {_BITS} AS bits, min(page_id) OVER (PARTITION BY html) AS low FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest,
  CASE WHEN page_id = low OR low IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
FROM b"""

UNIGRAMS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_CRC.format("(doc_id::VARCHAR)")} % 7 = 2 AS held_out, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, unnest({_WORDS}) AS w FROM d),
c AS (SELECT w, count(*) AS c FROM w JOIN d USING (rid) WHERE NOT held_out GROUP BY w),
s AS (SELECT (SELECT count(*) FROM d WHERE NOT held_out) AS ends, (SELECT coalesce(sum(c), 0) FROM c) AS tokens, (SELECT count(*) FROM c) AS types),
n AS (SELECT (tokens + ends)::BIGINT AS n, types + (ends > 0)::INT AS v, ends FROM s),
by_doc AS (SELECT rid, count(*) AS k, count(c.c) AS known, sum(log10((coalesce(c.c, 0) + 1) / (n + v + 1)::DOUBLE)) AS score FROM w LEFT JOIN c USING (w) CROSS JOIN n GROUP BY rid)
SELECT doc_id, held_out, coalesce(k, 0) + 1 AS n_tokens, coalesce(known, 0) + (ends > 0)::INT AS n_known, n AS train_tokens, coalesce(score, 0) + log10((ends + 1) / (n + v + 1)::DOUBLE) AS base_score
FROM d CROSS JOIN n LEFT JOIN by_doc USING (rid)"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: UTF-8 of a run of letters: one byte below 128, else 195 and the code point less 64.
_BYTES = "flatten(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN unicode({0}[i]) < 128 THEN [unicode({0}[i])::UBIGINT] ELSE [195::UBIGINT, (unicode({0}[i]) - 64)::UBIGINT] END))"
_CRC_OF_BYTES = "xor(list_reduce(list_prepend(4294967295::UBIGINT, {0}), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"

SPELLING = rf"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT id, run, count(*) AS k, {_CRC_OF_BYTES.format(_BYTES.format("(id || ':' || run)"))} AS h FROM r WHERE length(run) >= 6 GROUP BY id, run),
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM d GROUP BY 1),
v AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 6 AND n >= 5),
c AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n FROM c AS a JOIN c AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM c JOIN v ON c.rest = v.word UNION SELECT v.word, c.word, c.n FROM c JOIN v ON c.rest = v.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * v.n THEN top END AS form_n,
  (SELECT min(other) FROM near WHERE near.word = v.word AND near.n = top AND top >= 5 * v.n) AS form FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM formed UNION ALL SELECT s.word, f.form FROM steps AS s JOIN formed AS f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, n, form, root, n_near, form_n FROM formed AS f JOIN steps USING (word) WHERE root IN (SELECT word FROM formed WHERE form IS NULL)"""

LEAKS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN.format("coalesce(" + _LOWER + ", '')")} AS w FROM documents),
i AS (SELECT DISTINCT item_id, {_PLAIN.format(_LOWER)} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM iw))),
found AS (SELECT rid, p, k, item_id FROM dw JOIN iw USING (k, g)),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS pos FROM (SELECT DISTINCT rid, p, k FROM found)) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)"""

SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_PLAIN.format("coalesce(" + _LOWER + ", '')")} AS w FROM documents),
i AS (SELECT row_number() OVER () AS qid, item_id, {_PLAIN.format(_LOWER)} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY rid, t),
s AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
q AS (SELECT qid, t, count(*) AS k FROM (SELECT qid, unnest(w) AS t FROM i) GROUP BY qid, t),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf CROSS JOIN s GROUP BY t, n_docs),
m AS (SELECT rid, doc_id, 25 + (75 * len(w)::BIGINT * n_docs) // n_words AS m FROM d CROSS JOIN s WHERE len(w) > 0),
score AS (SELECT qid, rid, sum(k * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (t) JOIN weights USING (t) JOIN m USING (rid) GROUP BY qid, rid),
ranked AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM score JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked JOIN i USING (qid) WHERE rank <= 10"""

ORACLES = {"op1_vector_neighbours": VECTORS, "op8_adaptive_rules": _rules(), "op9_warc_archives": ARCHIVES, "op11_spelling_variants": SPELLING, "op12_decontamination": LEAKS, "op13_lexical_search": SEARCH, "unigram_base_scores": UNIGRAMS}
