"""DuckDB SQL of the queries that SQL can express: the same rows by other means, over whole tables."""

from __future__ import annotations

from granary.llm import langid, licenses, quality

_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    measures = quality.MEASURES
    p = quality.PRECISION
    values = ", ".join(f"({m[2]} * {m[0]}) // greatest({m[1]}, 1) AS {name}" for name, m in measures.items())
    long = " UNION ALL ".join(f"SELECT lang, source, {i} AS m, {m} AS v FROM good" for i, m in enumerate(measures))
    rules = ", ".join(f"({i}, {m[4]}, {m[5]}, {str(m[3]).lower()})" for i, m in enumerate(measures.values()))

    def fences(name: str, by: str) -> str:
        keys = f"{by}, m" if by else "m"
        at = lambda level: f"min(CASE WHEN seen * 1000 >= total * ({level}) THEN bucket END)"
        return f"""
{name}_c AS (SELECT {keys}, bucket, count(*) AS n FROM cells GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY {keys}) AS total FROM {name}_c JOIN rules USING (m)),
{name}_q AS (SELECT {keys}, reach, two, max(total)::DOUBLE AS n, {at('1000 - level')} AS a, {at('500')} AS c, {at('level')} AS b FROM {name}_r GROUP BY {keys}, reach, two),
{name} AS (SELECT {keys}, n, (CASE WHEN two THEN val(a) - reach * (val(c) - val(a)) ELSE -1 END)::DOUBLE AS low, (top(b) + reach * (val(b) - val(c)))::DOUBLE AS high FROM {name}_q)"""

    def drawn(side: str, own: str, wide: str) -> str:
        return f"(({own}.n * {own}.{side} + {float(quality.WEIGHT)}::DOUBLE * {wide}.{side}) / ({own}.n + {float(quality.WEIGHT)}::DOUBLE)) AS {side}"

    # val() and top(): the least and the greatest number of a bucket
    text = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM d, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
f AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
      len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {values} FROM f),
good AS (SELECT * FROM b WHERE NOT base_failed),
rules AS (SELECT * FROM (VALUES {rules}) r(m, level, reach, two)),
cells AS (SELECT lang, source, m, greatest(0, length(bin(v)) - {p}) * {1 << p} + (v >> greatest(0, length(bin(v)) - {p})::BIGINT) AS bucket FROM ({long})),{fences("own", "lang, source")},{fences("wide", "lang")},{fences("everything", "")},
lang_ AS (SELECT wide.lang, m, {drawn("low", "wide", "everything")}, {drawn("high", "wide", "everything")} FROM wide JOIN everything USING (m)),
last AS (SELECT own.lang, own.source, own.m, {drawn("low", "own", "lang_")}, {drawn("high", "own", "lang_")} FROM own JOIN lang_ ON own.m = lang_.m AND own.lang IS NOT DISTINCT FROM lang_.lang),
v AS (SELECT doc_id, m, CASE m {" ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(measures))} END AS v, CASE m {" ".join(f"WHEN {i} THEN {m[0]}" for i, m in enumerate(measures.values()))} END AS top, CASE m {" ".join(f"WHEN {i} THEN {m[1]}" for i, m in enumerate(measures.values()))} END AS bottom, CASE m {" ".join(f"WHEN {i} THEN {m[2]}" for i, m in enumerate(measures.values()))} END::DOUBLE AS scale, lang, source FROM b, (SELECT unnest(range(0, {len(measures)})) AS m)),
j AS (SELECT v.doc_id, bool_and(coalesce(v.v BETWEEN o.low AND o.high OR NOT two AND v.top <= o.high * v.bottom / v.scale + reach::DOUBLE * sqrt(o.high * v.bottom / v.scale + (1000 - level) / 1000), true)) AS fine
      FROM v JOIN rules USING (m) LEFT JOIN last o ON o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source AND o.m = v.m GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept, n_lines, n_upper FROM b JOIN j USING (doc_id)"""
    for c in "abc":
        text = text.replace(f"val({c})", f"(({c} % {1 << p}) << ({c} // {1 << p})::BIGINT)").replace(f"top({c})", f"((({c} % {1 << p}) + 1) << ({c} // {1 << p})::BIGINT) - 1")
    return text


NEAR = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM t),
x AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS least FROM reach GROUP BY node)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.least, s.doc_id) AS component_id, coalesce(c.least, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c ON c.node = s.doc_id"""

WARC = """
WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, html, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', hex[i])]), '') AS bits FROM h),
b AS (SELECT page_id, payload_bytes, html, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM m"""


def _licences() -> str:
    """The templates' weights are made here anew; every ancestor directory is tried."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda x: "[" + ", ".join(map(quoted, x)) + "]::VARCHAR[]"
    rows = ", ".join(f"({i}, {quoted(x.name)}, {quoted(x.text)}, {listed(x.must)}, {listed(x.never)})" for i, x in enumerate(licenses.TEMPLATES))
    return f"""
WITH tpl AS (SELECT *, regexp_extract_all(lower(body), '{licenses.TERM}') AS w FROM (VALUES {rows}) v(t, name, body, must, never)),
tw AS (SELECT t, w[i] AS term, i - 1 AS o, len(w) AS k FROM (SELECT t, w, unnest(range(1, len(w) + 1)) AS i FROM tpl)),
df AS (SELECT term, count(DISTINCT t) AS df FROM tw GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tpl)) / (1 + df)) + 1 AS idf FROM df),
raw AS (SELECT t, term, count(*) * any_value(idf) AS x FROM tw JOIN idf USING (term) GROUP BY t, term),
wt AS (SELECT t, term, x / sqrt(sum(x * x) OVER (PARTITION BY t)) AS w FROM raw),
place AS (SELECT tw.* FROM tw JOIN tpl ON tw.t = tpl.t AND tw.term = tpl.must[1]),
p AS (SELECT doc_id, text, ['tree', (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR, (doc_id // 10)::VARCHAR][1 : CASE WHEN doc_id % 1000 = 0 THEN 2 WHEN doc_id % 100 = 0 THEN 3 ELSE 4 END] AS dirs,
      CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS base FROM documents),
d AS (SELECT doc_id, dirs, base, array_to_string(dirs, '/') AS dir, array_to_string(dirs, '/') || '/' || base AS path, regexp_extract_all(lower(coalesce(text, '')), '{licenses.TERM}') AS w FROM p),
h AS (SELECT doc_id, w[i] AS term, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT term FROM place)),
c AS (SELECT DISTINCT doc_id, t, greatest(i - o, 0) AS start, least(i - o, 0) + k AS k FROM h JOIN place USING (term)),
b AS (SELECT c.doc_id, c.t, c.start, d.w[c.start + 1 : c.start + c.k] AS w FROM c JOIN d USING (doc_id) UNION ALL SELECT DISTINCT c.doc_id, c.t, -1, d.w FROM c JOIN d USING (doc_id)),
f AS (SELECT b.* FROM b JOIN tpl USING (t) WHERE list_has_all(b.w, must) AND NOT list_has_any(b.w, never)),
tf AS (SELECT doc_id, t, start, term, count(*) AS tf FROM (SELECT doc_id, t, start, unnest(w) AS term FROM f) GROUP BY ALL),
x AS (SELECT tf.doc_id, tf.t, tf.start, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM tpl)) + 1) AS x, coalesce(wt.w, 0.0)::DOUBLE AS w FROM tf LEFT JOIN idf USING (term) LEFT JOIN wt ON wt.t = tf.t AND wt.term = tf.term),
s AS (SELECT doc_id, t, start, round(sum(x * w) / sqrt(sum(x * x)), 6) AS score FROM x GROUP BY ALL),
o AS (SELECT doc_id, name AS own, score, whole FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, t, start) AS r, max(CASE WHEN start < 0 THEN score END) OVER (PARTITION BY doc_id) AS whole FROM s WHERE score >= {licenses.LEAST}) JOIN tpl USING (t) WHERE r = 1),
e AS (SELECT d.doc_id, d.dirs, d.dir, d.path, o.own, o.score, o.own IS NOT NULL AND (coalesce(o.whole, 0) >= {licenses.WHOLE} OR d.base = 'LICENSE') AS is_file FROM d LEFT JOIN o USING (doc_id)),
files AS (SELECT dir, path, own, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) AS r FROM e WHERE is_file) WHERE r = 1),
up AS (SELECT doc_id, n, array_to_string(dirs[1 : n], '/') AS dir FROM (SELECT doc_id, dirs, unnest(range(1, len(dirs) + 1)) AS n FROM e WHERE own IS NULL)),
near AS (SELECT * FROM (SELECT up.doc_id, files.path, files.own, files.score, row_number() OVER (PARTITION BY up.doc_id ORDER BY n DESC) AS r FROM up JOIN files USING (dir)) WHERE r = 1)
SELECT e.doc_id, e.path, coalesce(e.own, near.own, 'none') AS license, CASE WHEN e.own IS NOT NULL THEN 'own' WHEN near.own IS NOT NULL THEN 'inherited' ELSE 'none' END AS method,
       CASE WHEN e.own IS NOT NULL THEN e.score ELSE coalesce(near.score, 0.0)::DOUBLE END AS score, near.path AS licence_path FROM e LEFT JOIN near USING (doc_id)"""


def _languages() -> str:
    """crc32 bit by bit; n-grams as strings, whose order among those of one length is that of their codes."""
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, lang, {crc} % 3 = 1 AS held_out, list_transform(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+'), lambda x: ' ' || x || ' ') AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS w FROM d),
c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, g, sum(n) AS n FROM (SELECT doc_id, n, w[i : i + k - 1] AS g FROM (SELECT doc_id, w, n, k, unnest(range(1, length(w) - k + 2)) AS i FROM c, (SELECT unnest(range(1, {langid.N_MAX + 1})) AS k) WHERE length(w) >= k)) WHERE g <> ' ' GROUP BY ALL),
learned AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS r FROM (SELECT lang, g, sum(n) AS n FROM g JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY r < {langid.K}),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS r FROM g QUALIFY r < {langid.K}),
size AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
met AS (SELECT doc_id, l.lang, sum({langid.K} - abs(own.r - l.r)) AS near FROM own JOIN learned l USING (g) GROUP BY ALL),
away AS (SELECT doc_id, l.lang, {langid.K} * n - coalesce(near, 0) AS away, n FROM size CROSS JOIN (SELECT DISTINCT lang FROM learned) l LEFT JOIN met USING (doc_id, lang)),
best AS (SELECT doc_id, lang, away, n FROM away QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1.0::DOUBLE - away::DOUBLE / ({langid.K} * n)::DOUBLE, 0.0::DOUBLE) AS score FROM d LEFT JOIN best USING (doc_id)"""


NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_inner_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5"""


SQL = {"op1_language_id": _languages(), "op4_license_scan": _licences(), "op5_quality_rules": _quality(), "op8_minhash_near_dedup": NEAR, "op9_warc_bundles": WARC, "op13_hard_negatives": NEGATIVES}
