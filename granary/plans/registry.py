"""The registered queries, each with the SQL that gives its rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import prompts, similarity
from granary.functions import text as T
from granary.operators import catalog, changes, chunking, dedup, generate, hybrid, incremental, ivf, keyed, lexical, matter, paraphrase, postings, sections, vectors
from granary.plans import catalogue, ingest
from granary.sources import files
from granary.sources.extract import html_to_text
from granary.storage import Scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text

# the tables hold no entity, fence or compatibility character (a test says so), where the native rules are all
TIDY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""


@query(f"SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM (SELECT doc_id, {TIDY_SQL} AS t FROM documents)")
def q_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("digest"))


@query(f"SELECT doc_id, sha256(t) AS digest FROM (SELECT doc_id, {TIDY_SQL} AS t FROM documents)")
def q_normalize_native(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text"), native=True), 256).alias("digest"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def q_light_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.light_clean("text"), 256).alias("digest"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 780)) AS pos FROM t),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, substring(t, pos + 1, 900) AS chunk FROM s)
SELECT doc_id, i::INT AS chunk_idx, CASE WHEN n = 1 THEN doc_id || '.txt' ELSE doc_id || '.part' || lpad((i + 1)::VARCHAR, 3, '0') || '.txt' END AS chunk_path, length(chunk)::INT AS n_chars, sha256(chunk) AS digest FROM c
""")
def q_chunk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.strip(F.col("text")).alias("text"))
    rows = chunking.chunk(docs, 900, 120)
    path = chunking.chunk_path(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("chunk_idx"), F.col("n_chunks"))
    return rows.select("doc_id", "chunk_idx", path.alias("chunk_path"), F.char_length("chunk").alias("n_chars"), F.sha2("chunk", 256).alias("digest"))


@query(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS n, parts FROM l)
SELECT doc_id, n::INT AS line_no, doc_id || ':' || n AS line_id, regexp_replace(parts[n], '^\s+|\s+$', '', 'g') AS line FROM x WHERE regexp_replace(parts[n], '^\s+|\s+$', '', 'g') <> ''
""")
def q_lines(spark, sf_dir):
    rows = chunking.lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", chunking.line_id(F.col("doc_id").cast("string"), F.col("line_no")).alias("line_id"), "line")


@query(r"""
SELECT doc_id, len(n)::INT AS n_numbers, list_aggregate(n, 'string_agg', ',') AS numbers FROM (
SELECT doc_id, list_transform(regexp_extract_all(text || ' 1,234.50 vs 12% of 1234,567', '(?:(?:\d{1,3}(?:,\d{3})+)|\d+)(?:\.\d+)?%?'), lambda x: rtrim(replace(x, ',', ''), '%')) AS n FROM documents)
""")
def q_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.concat("text", F.lit(" 1,234.50 vs 12% of 1234,567"))).alias("n"))
    return rows.select("doc_id", F.size("n").alias("n_numbers"), F.array_join("n", ",").alias("numbers"))


WORDS_SQL = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?)', 1)"


@query(f"SELECT doc_id, len(w)::INT AS n_words, len(list_distinct(w))::INT AS n_distinct FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def q_word_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.words(F.lower("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query(f"SELECT doc_id, CASE WHEN len(w) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END::INT AS n_shingles FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def q_shingle_counts(spark, sf_dir):
    sets = T.shingles(T.words(F.lower("text")), 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(sets).alias("n_shingles"))


@query(r"""SELECT doc_id, sha256('{"v": "v1", "t": "' || sha256(text) || '", "s": "' || sha256('plain style') || '", "m": 256}') AS cache_key FROM documents""")
def q_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.col("text"), F.lit("plain style"), 256).alias("cache_key"))


@query(r"""
SELECT doc_id, CASE WHEN len(t) = 0 THEN '""' ELSE array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' AND ') END AS expression
FROM (SELECT doc_id, regexp_extract_all(text, '([0-9A-Za-z_]+)', 1) AS t FROM documents)
""")
def q_match_expression(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.match_expression(F.col("text")).alias("expression"))


@query(r"""
SELECT url, CASE WHEN regexp_matches(p, '[^/.][^/]*\.[^/.]+$') THEN lower(regexp_extract(p, '(\.[^/.]+)$', 1)) ELSE '' END AS ext, regexp_replace(b, '(.)\.[^.]+$', '\1') AS stem, b AS base
FROM (SELECT url, p, regexp_extract(p, '([^/]*)$', 1) AS b FROM (SELECT url, regexp_replace(url, '[?#].*$', '') AS p FROM pages))
""")
def q_paths(spark, sf_dir):
    p = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("url", T.suffix(p).alias("ext"), T.stem(p).alias("stem"), T.basename(p).alias("base"))


@query()
def q_html_extract(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("t"))
    return rows.select("page_id", F.char_length("t").alias("n_chars"), F.size(F.split("t", "\n")).alias("n_lines"), F.md5("t").alias("digest"))


@query(r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
b AS (SELECT doc_id, unnest(range(0, len(l))) AS section, unnest(l) AS line, len(l) AS n FROM s),
c AS (SELECT doc_id, section, CASE WHEN section = 0 THEN '# ' ELSE '## ' END || line || CASE WHEN section < n - 1 THEN chr(10) ELSE '' END AS body FROM b),
p AS (SELECT doc_id, section, body, unnest(range(0, CASE WHEN length(body) <= 900 THEN 1 ELSE 1 + (length(body) - 1) // 780 END)) AS part FROM c)
SELECT doc_id, section::INT AS section, regexp_extract(body, '^#{1,6} +([^\n]*)', 1) AS heading, part::INT AS part, CASE WHEN length(body) <= 900 THEN length(body) ELSE least(900, length(body) - 780 * part) END::INT AS n_chars FROM p
""")
def q_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), F.regexp_replace("text", "\n", "\n## ")).alias("text"))
    return chunking.sections(docs).select("doc_id", "section", "heading", "part", F.char_length("chunk").alias("n_chars"))


# ---- near duplicates

SIGN_SQL = f"""
sig AS (SELECT doc_id AS id, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
ex AS (SELECT id, unnest(s) AS x, len(s) AS n FROM sig),
near AS (SELECT a.id AS a, b.id AS b, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb FROM ex a JOIN ex b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a, b, inter / (na + nb - inter) AS j FROM near WHERE inter / (na + nb - inter) >= 0.9)"""


def _signatures(spark, sf_dir):
    return dedup.signatures(table(spark, sf_dir, "documents"), 5, native=True)


@query(f"""
WITH {SIGN_SQL},
cls AS (SELECT id, min(id) OVER (PARTITION BY list_sort(s)) AS rep FROM sig WHERE len(s) > 0)
SELECT a, b, round(j, 6) AS jaccard FROM pairs WHERE a IN (SELECT rep FROM cls) AND b IN (SELECT rep FROM cls)
UNION ALL SELECT rep, id, 1.0::DOUBLE FROM cls WHERE id <> rep
""")
def q_dup_pairs(spark, sf_dir):
    """Pairs of the first documents of equal signature, and each other one with its first."""
    return dedup.pairs(_signatures(spark, sf_dir), 0.90).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
WITH RECURSIVE {SIGN_SQL},
edges AS (SELECT b AS id, list(a) AS before FROM pairs GROUP BY b),
o AS (SELECT s.id, row_number() OVER (ORDER BY s.id) AS rn, coalesce(e.before, []) AS before FROM (SELECT DISTINCT b AS id FROM pairs UNION SELECT DISTINCT a FROM pairs) s LEFT JOIN edges e ON s.id = e.id),
w AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept UNION ALL
      SELECT o.rn, CASE WHEN list_has_any(w.kept, o.before) THEN w.kept ELSE list_append(w.kept, o.id) END FROM w JOIN o ON o.rn = w.rn + 1),
last AS (SELECT kept FROM w ORDER BY rn DESC LIMIT 1)
SELECT s.id AS doc_id, CASE WHEN len(s.s) = 0 THEN s.id = (SELECT min(id) FROM sig WHERE len(s) = 0) WHEN s.id IN (SELECT id FROM o) THEN list_contains((SELECT kept FROM last), s.id) ELSE true END AS kept FROM sig s
""")
def q_dedup_keep(spark, sf_dir):
    return dedup.deduplicate(table(spark, sf_dir, "documents"), 0.90, 5, native=True).select(F.col("id").alias("doc_id"), "kept")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def q_exact_dedup(spark, sf_dir):
    return dedup.exact(table(spark, sf_dir, "documents"))


@query()
def q_simhash(spark, sf_dir):
    return dedup.simhash_pairs(_signatures(spark, sf_dir), 3)


# the vectors are random: pairs at the usual 0.92 and 0.96 don't occur
SAME, CROSS = 0.35, 0.4


@query(f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.vec_id < b.vec_id
WHERE list_inner_product(a.e, b.e) >= CASE WHEN a.label IS NOT DISTINCT FROM b.label THEN {SAME} ELSE {CROSS} END
""")
def q_semantic_pairs(spark, sf_dir):
    return dedup.semantic_pairs(table(spark, sf_dir, "embeddings"), SAME, CROSS, group="label", copies=True).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) >= CASE WHEN a.label IS NOT DISTINCT FROM b.label THEN {SAME} ELSE {CROSS} END),
edges AS (SELECT b AS id, list(a) AS before FROM pairs GROUP BY b),
o AS (SELECT s.id, row_number() OVER (ORDER BY s.id) AS rn, coalesce(e.before, []) AS before FROM (SELECT DISTINCT b AS id FROM pairs UNION SELECT DISTINCT a FROM pairs) s LEFT JOIN edges e ON s.id = e.id),
w AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept UNION ALL
      SELECT o.rn, CASE WHEN list_has_any(w.kept, o.before) THEN w.kept ELSE list_append(w.kept, o.id) END FROM w JOIN o ON o.rn = w.rn + 1),
last AS (SELECT kept FROM w ORDER BY rn DESC LIMIT 1)
SELECT v.vec_id, CASE WHEN v.vec_id IN (SELECT id FROM o) THEN list_contains((SELECT kept FROM last), v.vec_id) ELSE true END AS kept FROM v
""")
def q_semantic_dedup(spark, sf_dir):
    return dedup.semantic_dedup(table(spark, sf_dir, "embeddings"), SAME, CROSS, group="label").select(F.col("id").alias("vec_id"), "kept")


# ---- retrieval

# every document whose id is divisible by 100 asks for the two longest of its words that are plain ASCII
BM25_SQL = rf"""
q AS (SELECT doc_id AS qid, array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}\p{{M}}]+)', 1), lambda x: regexp_matches(x, '^[a-z0-9]+$'))), lambda x: {{'n': -length(x), 'w': x}}))[1:2], lambda x: x.w), ' ') AS query FROM documents WHERE doc_id % 100 = 0),
asked AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest(regexp_extract_all(lower(query), '([0-9a-z]+)', 1)) AS term FROM q) GROUP BY 1, 2),
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}\p{{M}}]+)', 1) AS w FROM documents),
lens AS (SELECT id, len(w) AS length FROM tok),
st AS (SELECT count(*) AS n_docs, avg(length) AS avgdl FROM lens),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT term, CASE WHEN ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
sc AS (SELECT qid, p.id, -sum(times * idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))) AS bm25, count(*) AS got
       FROM post p JOIN asked USING (term) JOIN idf USING (term) JOIN lens USING (id), st GROUP BY 1, 2),
need AS (SELECT qid, count(*) AS need FROM asked GROUP BY 1),
hit AS (SELECT qid, id, bm25 FROM sc JOIN need USING (qid) WHERE got = need),
lex AS (SELECT * FROM (SELECT qid, id, bm25, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9), id) AS rank FROM hit) WHERE rank <= 18)"""


def _asked(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(lexical.TOKEN), F.lit(1)))
    plain = F.filter(words, lambda w: w.rlike("^[a-z0-9]+$"))
    longest = F.slice(F.sort_array(F.transform(plain, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 2)
    docs = table(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    return docs.select(F.col("doc_id").alias("qid"), F.array_join(F.transform(longest, lambda x: x["w"]), " ").alias("query"))


def _index(spark, sf_dir, stem=False):
    return lexical.build(table(spark, sf_dir, "documents"), stem=stem).saved()


@query(f"WITH {BM25_SQL} SELECT qid, id AS doc_id, rank::INT AS rank, round(bm25, 6) AS bm25 FROM lex")
def q_bm25_topk(spark, sf_dir):
    hits = lexical.search(_index(spark, sf_dir), _asked(spark, sf_dir), 18)
    return hits.select("qid", F.col("id").alias("doc_id"), "rank", F.round("bm25", 6).alias("bm25"))


@query(f"WITH {BM25_SQL} SELECT qid, id AS doc_id FROM hit")
def q_bm25_prefilter(spark, sf_dir):
    return lexical.matches(_index(spark, sf_dir), _asked(spark, sf_dir)).select("qid", F.col("id").alias("doc_id"))


@query()
def q_bm25_stemmed(spark, sf_dir):
    hits = lexical.search(_index(spark, sf_dir, stem=True), _asked(spark, sf_dir), 18)
    return hits.select("qid", F.col("id").alias("doc_id"), "rank", F.round("bm25", 6).alias("bm25"))


@query("SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(e, lambda x: x / greatest(n, 1e-12))), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def q_l2_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    total = F.aggregate(similarity.l2_normalize(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(similarity.l2_norm(F.col("embedding")), 6).alias("norm"), F.round(total, 6).alias("total"))


KNN_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
sims AS (SELECT q.vec_id AS qid, v.vec_id AS id, list_inner_product(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 100 = 0),
vec AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM sims) WHERE rank <= 18)"""


def _neighbours(spark, sf_dir, k):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.knn(rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), k)


@query(f"WITH {KNN_SQL} SELECT qid, id AS vec_id, rank::INT AS rank, round(score, 6) AS score FROM vec")
def q_knn_topk(spark, sf_dir):
    return _neighbours(spark, sf_dir, 18).select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("SELECT event_id, round((value - min(value) OVER w) / CASE WHEN max(value) OVER w = min(value) OVER w THEN 1 ELSE max(value) OVER w - min(value) OVER w END, 6) AS scaled FROM events WINDOW w AS (PARTITION BY event_type)")
def q_minmax(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(similarity.min_max(F.col("value"), ["event_type"]), 6).alias("scaled"))


FUSE_SQL = """
lx AS (SELECT qid, {lex_id} AS id, rank, (s - min(s) OVER w) / CASE WHEN max(s) OVER w = min(s) OVER w THEN 1 ELSE max(s) OVER w - min(s) OVER w END AS s FROM (SELECT qid, id, rank, {score} AS s FROM lex) WINDOW w AS (PARTITION BY qid)),
vx AS (SELECT qid, {vec_id} AS id, rank, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE max(score) OVER w - min(score) OVER w END AS s FROM vec WINDOW w AS (PARTITION BY qid)),
both_ AS (SELECT coalesce(l.qid, v.qid) AS qid, coalesce(l.id, v.id) AS id, coalesce(0.5 * l.s + 0.5 * v.s, l.s, v.s) AS score, l.rank IS NULL AS late, coalesce(l.rank, v.rank) AS place FROM lx l FULL JOIN vx v ON l.qid = v.qid AND l.id = v.id),
fused AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, late, place, id) AS rank FROM both_) WHERE rank <= 6)"""


def _hits(spark, sf_dir, compat=False):
    lex = lexical.search(_index(spark, sf_dir), _asked(spark, sf_dir), 18).select("qid", "id", hybrid.lexical_score(compat).alias("score"), "rank")
    return hybrid.merge_and_rank(lex, _neighbours(spark, sf_dir, 18), 0.5, 6, prefix_ids=compat)


@query(f"WITH {BM25_SQL}, {KNN_SQL}, {FUSE_SQL.format(lex_id='id', vec_id='id', score='-bm25')} SELECT qid, id AS doc_id, rank::INT AS rank, round(score, 6) AS score FROM fused")
def q_hybrid(spark, sf_dir):
    return _hits(spark, sf_dir).select("qid", F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


COMPAT = FUSE_SQL.format(lex_id="'lex-' || id", vec_id="'vec-' || id", score="CASE WHEN bm25 <> -1 THEN 1 / (1 + bm25) END")


@query(f"WITH {BM25_SQL}, {KNN_SQL}, {COMPAT} SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM fused")
def q_hybrid_compat(spark, sf_dir):
    return _hits(spark, sf_dir, compat=True).select("qid", "id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {KNN_SQL} SELECT qid, id AS vec_id, rank::INT AS rank, coalesce(d.text, '[Missing mapping for ' || id || ']') AS text, coalesce(d.source, 'faiss') AS source FROM vec LEFT JOIN documents d ON d.doc_id = id AND d.doc_id IN (SELECT doc_id FROM labels)")
def q_hit_lookup(spark, sf_dir):
    """Hits among labelled documents: the ids of others show the note."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return hybrid.resolve(_neighbours(spark, sf_dir, 18), docs).select("qid", F.col("id").alias("vec_id"), "rank", "text", "source")


@query(f"WITH {KNN_SQL}, j AS (SELECT qid, id, score, d.source FROM vec JOIN documents d ON d.doc_id = id) SELECT qid, id AS vec_id, source, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS rank FROM (SELECT j.*, v.rank, row_number() OVER (PARTITION BY j.qid, source ORDER BY v.rank) AS own FROM j JOIN vec v USING (qid, id)) WHERE own = 1")
def q_diversity(spark, sf_dir):
    hits = _neighbours(spark, sf_dir, 18).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return hybrid.diverse(hits, "source").select("qid", F.col("id").alias("vec_id"), "source", "rank")


# ---- tables

@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def q_upsert(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    half = F.col("event_id") % 2 == 0
    old, new = (catalog.latest(events.where(w), "user_id", ["ts", "event_id"]) for w in (half, ~half))
    # rows of the second batch replace those of the first where they are later
    newer = new.join(old.select("user_id", F.struct("ts", "event_id").alias("was")), "user_id", "left").where(F.col("was").isNull() | (F.struct("ts", "event_id") > F.col("was"))).drop("was")
    return catalog.upsert(old, newer, "user_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def q_fk_orphans(spark, sf_dir):
    return catalog.orphans(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "doc_id").select("doc_id", "quality", "toxic")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def q_cascade(spark, sf_dir):
    return catalog.cascade(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_acctbal < 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT 'documents' AS \"table\", count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages")
def q_counts(spark, sf_dir):
    return catalog.counts(**{n: table(spark, sf_dir, n) for n in ("documents", "labels", "pages")})


@query("SELECT source, count(*) FILTER (n_chars <= 2000) AS processed, count(*) FILTER (n_chars <= 2000) AS written, count(*) FILTER (n_chars > 2000) AS skipped_size, 0::BIGINT AS skipped_ext, 0::BIGINT AS failed, 0::BIGINT AS ocr_used FROM documents GROUP BY source")
def q_stage_stats(spark, sf_dir):
    status = F.when(F.col("n_chars") <= 2000, "ok").otherwise("skipped_size")
    docs = table(spark, sf_dir, "documents").select("source", F.lit(".txt").alias("ext"), status.alias("status"))
    return files.stats(docs, ["source"])


# ---- prompts and rewriting

@query("SELECT conv_id, string_agg(upper(role) || ':' || chr(10) || trim(text) || chr(10), chr(10) ORDER BY turn, role, text) AS prompt FROM conversations GROUP BY conv_id")
def q_history_prompt(spark, sf_dir):
    rows = generate.history_table(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", prompts.flattened(F.col("history")).alias("prompt"))


@query(f"""
WITH {KNN_SQL}, c AS (SELECT qid, string_agg('[' || id || '] (score=' || printf('%.3f', score) || ') source=' || coalesce(d.source, 'faiss') || chr(10) || coalesce(d.text, '[Missing mapping for ' || id || ']'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS ctx, string_agg(id::VARCHAR, ',' ORDER BY rank) AS citations FROM vec LEFT JOIN documents d ON d.doc_id = id WHERE rank <= 3 GROUP BY qid)
SELECT qid, '[ECHO RESPONSE]' || chr(10) || 'User question:' || chr(10) || 'question ' || qid || chr(10) || chr(10) || 'Context:' || chr(10) || ctx AS text, citations FROM c
""")
def q_context_prompt(spark, sf_dir):
    hits = hybrid.resolve(_neighbours(spark, sf_dir, 3), table(spark, sf_dir, "documents"))
    asked = hits.select("qid").distinct().select("qid", F.concat(F.lit("question "), F.col("qid").cast("string")).alias("message"), F.lit(None).cast(generate.MESSAGE).alias("history"), F.lit(None).cast("string").alias("persona"), F.lit(None).cast("double").alias("temperature"), F.lit(None).cast("int").alias("max_tokens"))
    said = generate.echo_answers(generate.messages(asked, generate.contexts(hits)))
    return said.select("qid", "text", F.array_join("citations", ",").alias("citations"))


def _turn_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    own = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("reply", F.lead("text").over(own)).where("role = 'user' AND reply IS NOT NULL")


# a row of the table of common subsequences a step; its entries are running maxima of what each word adds
@query(r"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations),
p AS (SELECT row_number() OVER () AS k, conv_id, turn, text, reply, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])', 1) AS a, regexp_extract_all(lower(reply), '([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])', 1) AS b FROM turns WHERE role = 'user' AND reply IS NOT NULL),
t AS (SELECT k, 0 AS i, list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT) AS old FROM p UNION ALL
      SELECT k, i + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j])) FROM (
        SELECT t.k, i, list_concat([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: CASE WHEN a[i + 1] = b[j] THEN old[j] + 1 ELSE old[j + 1] END)) AS cand FROM t JOIN p ON t.k = p.k WHERE i < len(a))),
l AS (SELECT k, max_by(old[len(old)], i) AS lcs FROM t GROUP BY k),
n AS (SELECT p.*, lcs, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE lcs / greatest(len(a), len(b)) END AS r,
      list_sort(list_transform(regexp_extract_all(text, '(?:(?:\d{1,3}(?:,\d{3})+)|\d+)(?:\.\d+)?%?'), lambda x: rtrim(replace(x, ',', ''), '%'))) = list_sort(list_transform(regexp_extract_all(reply, '(?:(?:\d{1,3}(?:,\d{3})+)|\d+)(?:\.\d+)?%?'), lambda x: rtrim(replace(x, ',', ''), '%'))) AS same FROM p JOIN l USING (k))
SELECT conv_id, turn, round(r, 6) AS rouge_l, same AND r >= 0.75 AS safe FROM n
""")
def q_rouge_lcs(spark, sf_dir):
    score = similarity.rouge_l(F.col("text"), F.col("reply"))
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(score, 6).alias("rouge_l"), similarity.passes_safety(F.col("text"), F.col("reply")).alias("safe"))


@query(r"""SELECT doc_id, sha256('{"v": "v1", "t": "' || sha256(text) || '", "s": "' || sha256('plain') || '", "m": 256}') AS cache_key, CASE WHEN doc_id % 3 = 0 THEN 'cached ' || doc_id ELSE text END AS paraphrased, CASE WHEN doc_id % 3 = 0 THEN 'cache' ELSE 'source' END AS origin FROM (SELECT doc_id, text || ' #' || doc_id AS text FROM documents)""")
def q_paraphrase_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" #", "text", F.col("doc_id").cast("string")).alias("text"))
    known = docs.where("doc_id % 3 = 0").select(T.cache_key(F.col("text"), F.lit("plain"), 256).alias("cache_key"), F.concat_ws(" ", F.lit("cached"), F.col("doc_id").cast("string")).alias("output_text"))
    return paraphrase.paraphrase(docs, known, "plain").select("doc_id", "cache_key", "paraphrased", "origin")


@query()
def q_hash_embed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", vectors.hashed_counts(F.col("text"), 64).alias("v"))
    return rows.select("doc_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("n_words"), F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")).alias("digest"))


@query(f"""
WITH RECURSIVE t AS (SELECT doc_id, {TIDY_SQL} AS t FROM documents),
s AS (SELECT doc_id, t, unnest(range(0, greatest(length(t), 1), 780)) AS pos FROM t),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, substring(t, pos + 1, 900) AS text FROM s),
k AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS id, lpad(doc_id::VARCHAR, 12, '0') AS stem, i, n, text FROM c),
sig AS (SELECT id, CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM (SELECT id, {WORDS_SQL} AS w FROM k)),
ex AS (SELECT id, unnest(s) AS x, len(s) AS n FROM sig),
near AS (SELECT a.id AS a, b.id AS b, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb FROM ex a JOIN ex b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM near WHERE inter / (na + nb - inter) >= 0.9),
edges AS (SELECT b AS id, list(a) AS before FROM pairs GROUP BY b),
o AS (SELECT s.id, row_number() OVER (ORDER BY s.id) AS rn, coalesce(e.before, []) AS before FROM (SELECT DISTINCT b AS id FROM pairs UNION SELECT DISTINCT a FROM pairs) s LEFT JOIN edges e ON s.id = e.id),
w AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept UNION ALL
      SELECT o.rn, CASE WHEN list_has_any(w.kept, o.before) THEN w.kept ELSE list_append(w.kept, o.id) END FROM w JOIN o ON o.rn = w.rn + 1),
last AS (SELECT kept FROM w ORDER BY rn DESC LIMIT 1),
good AS (SELECT s.id FROM sig s WHERE CASE WHEN len(s.s) = 0 THEN s.id = (SELECT min(id) FROM sig WHERE len(s) = 0) WHEN s.id IN (SELECT id FROM o) THEN list_contains((SELECT kept FROM last), s.id) ELSE true END)
SELECT stem || '.txt' AS doc_path, i::INT AS chunk_idx, CASE WHEN n = 1 THEN stem || '.txt' ELSE stem || '.part' || lpad((i + 1)::VARCHAR, 3, '0') || '.txt' END AS chunk_path, md5(text) AS digest FROM k JOIN good USING (id)
""")
def q_ingest(spark, sf_dir):
    """Normalise, chunk and de-duplicate all documents: the kept chunks."""
    docs = table(spark, sf_dir, "documents").select(F.format_string("%012d.txt", "doc_id").alias("doc_path"), "text")
    return ingest.kept(ingest.normalize(docs)).select("doc_path", "chunk_idx", "chunk_path", F.md5("text").alias("digest"))


# ---- stored indexes and their upkeep

@query(f"WITH {BM25_SQL} SELECT qid, id AS doc_id, rank::INT AS rank, round(bm25, 6) AS bm25 FROM lex")
def q_bm25_blocks(spark, sf_dir):
    """BM25 over the written index: term-clustered blocks, whose bounds leave most of them unread."""
    store = postings.Store.create(table(spark, sf_dir, "documents"), _folder(spark, "postings"))
    return store.search(_asked(spark, sf_dir), 18).select("qid", F.col("id").alias("doc_id"), "rank", F.round("bm25", 6).alias("bm25"))


def _folder(spark, name):
    return Scratch(spark, name).root


def _earlier(spark, sf_dir):
    """An earlier state of the documents: a fifth not there yet, a seventh with other texts, and some that are gone by now."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("old words of "), F.reverse("text"))).otherwise(F.col("text")))
    return docs, old.unionByName(docs.where("doc_id % 11 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))


EARLIER_SQL = """
old AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old words of ' || reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0
        UNION ALL SELECT -1 - doc_id, text FROM documents WHERE doc_id % 11 = 0)"""


def _changes(docs, old):
    hashed = lambda rows: rows.select("doc_id", changes.content_hash(F.col("text")).alias("content_hash"))
    return changes.diff(hashed(old), hashed(docs))


@query(f"WITH {EARLIER_SQL} SELECT coalesce(d.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'gone' WHEN o.text IS NOT DISTINCT FROM d.text THEN 'same' ELSE 'changed' END AS state FROM old o FULL JOIN documents d ON d.doc_id = o.doc_id")
def q_changes(spark, sf_dir):
    return _changes(*_earlier(spark, sf_dir))


@query(f"WITH {BM25_SQL} SELECT qid, id AS doc_id, rank::INT AS rank, round(bm25, 6) AS bm25 FROM lex")
def q_bm25_delta(spark, sf_dir):
    """The index of an earlier state, brought up to date by what changed: the same rows as from one built anew."""
    docs, old = _earlier(spark, sf_dir)
    store = postings.Store.create(old, _folder(spark, "postings"))
    store.apply(*changes.split(_changes(docs, old), docs))
    return store.search(_asked(spark, sf_dir), 18).select("qid", F.col("id").alias("doc_id"), "rank", F.round("bm25", 6).alias("bm25"))


def _lists(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), ivf.Lists.build(rows, _folder(spark, "lists"))


@query()
def q_ivf_topk(spark, sf_dir):
    """Probed lists, as many as a measured recall of 0.95 takes; every row is indexed."""
    rows, asked, index = _lists(spark, sf_dir)
    probes, _ = index.tune(rows, 18)
    return index.search(asked, 18, probes).select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(f"WITH {KNN_SQL} SELECT qid, id AS vec_id, rank::INT AS rank, round(score, 6) AS score FROM vec")
def q_ivf_exact(spark, sf_dir):
    """The same index without loss: lists are left out by their bounds only."""
    _, asked, index = _lists(spark, sf_dir)
    return index.search(asked, 18, 2, exact=True).select("qid", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(SQL["q_dedup_keep"])
def q_dedup_batches(spark, sf_dir):
    """Three batches by id, each against what the earlier ones kept: the verdicts of one run over all."""
    docs = table(spark, sf_dir, "documents")
    most = F.broadcast(docs.agg(F.max("doc_id").alias("most")))  # one row
    part = docs.join(most).withColumn("part", F.when(F.col("doc_id") * 2 < F.col("most"), 0).when(F.col("doc_id") * 4 < F.col("most") * 3, 1).otherwise(2))
    corpus = incremental.Corpus(spark, _folder(spark, "corpus"))
    for batch in range(3):
        corpus.add(part.where(F.col("part") == batch), batch, native=True)
    return corpus.verdicts().select(F.col("id").alias("doc_id"), "kept")


@query(SQL["q_upsert"])
def q_upsert_buckets(spark, sf_dir):
    """The same upsert into a table on disk, of which only the buckets of the new keys are written again."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    half = F.col("event_id") % 2 == 0
    old, new = (catalog.latest(events.where(w), "user_id", ["ts", "event_id"]) for w in (half, ~half))
    stored = keyed.KeyedTable.create(old, _folder(spark, "keyed"), "user_id", buckets=16)
    was = stored.lookup(new).select("user_id", F.struct("ts", "event_id").alias("was"))
    stored.upsert(new.join(was, "user_id", "left").where(F.col("was").isNull() | (F.struct("ts", "event_id") > F.col("was"))).drop("was"))
    return stored.rows().select("user_id", "event_id", "event_type")


# ---- sections, front matter, names

# every fifth line is a heading, of a level by its number, but not where a line of the text opens a fence
MARKED_SQL = """
marked AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 5 = 2 THEN repeat('#', (1 + (i + doc_id) % 4)::INT) || ' ' || left(x, 24) ELSE x END), chr(10)) AS text FROM documents)"""


def _marked(spark, sf_dir):
    # lambdas count from 0 here, from 1 there
    line = lambda x, i: F.when((i + 1) % 5 == 2, F.concat(F.repeat(F.lit("#"), (1 + (i + 1 + F.col("doc_id")) % 4).cast("int")), F.lit(" "), F.substring(x, 1, 24))).otherwise(x)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(rf"""
WITH RECURSIVE {MARKED_SQL},
l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM marked),
h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})[ \t]+\S', 1)) AS level, regexp_replace(regexp_replace(line, '^#{{1,6}}[ \t]+', ''), '[ \t]+#*[ \t]*$', '') AS title FROM l),
n AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h),
heads AS (SELECT doc_id, s, level, title FROM n WHERE level > 0),
path AS (SELECT a.doc_id, a.s, array_to_string(list(b.title ORDER BY b.s), ' / ') AS path FROM heads a JOIN heads b ON b.doc_id = a.doc_id AND b.s <= a.s AND (b.s = a.s OR b.level < a.level)
         AND NOT EXISTS (SELECT 1 FROM heads c WHERE c.doc_id = a.doc_id AND c.s > b.s AND c.s <= a.s AND c.level <= b.level AND c.s <> b.s) GROUP BY ALL),
body AS (SELECT doc_id, s, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM n GROUP BY ALL),
sec AS (SELECT body.doc_id, row_number() OVER (PARTITION BY body.doc_id ORDER BY body.s) AS k, coalesce(path, '') AS path, body, len(regexp_extract_all(body, '\S+')) AS tokens FROM body LEFT JOIN path USING (doc_id, s) WHERE regexp_matches(body, '\S')),
m AS (SELECT doc_id, k, path, body, tokens, 1 AS c FROM sec WHERE k = 1 UNION ALL
      SELECT m.doc_id, sec.k, CASE WHEN m.tokens < 40 AND m.tokens + sec.tokens <= 200 THEN m.path ELSE sec.path END, CASE WHEN m.tokens < 40 AND m.tokens + sec.tokens <= 200 THEN m.body || chr(10) || chr(10) || sec.body ELSE sec.body END,
             CASE WHEN m.tokens < 40 AND m.tokens + sec.tokens <= 200 THEN m.tokens + sec.tokens ELSE sec.tokens END, CASE WHEN m.tokens < 40 AND m.tokens + sec.tokens <= 200 THEN c ELSE c + 1 END
      FROM m JOIN sec ON sec.doc_id = m.doc_id AND sec.k = m.k + 1),
whole AS (SELECT doc_id, c, path, body, tokens FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, c ORDER BY k DESC) = 1),
cut AS (SELECT doc_id, c, path, tokens, body, unnest(range(0, CASE WHEN tokens > 200 THEN tokens ELSE 1 END, 200)) AS pos FROM whole),
out AS (SELECT doc_id, c, pos, path, CASE WHEN tokens > 200 THEN regexp_replace(array_to_string(regexp_extract_all(body, '\S+\s*')[pos + 1 : pos + 200], ''), '\s+$', '') ELSE body END AS body, CASE WHEN tokens > 200 THEN least(tokens - pos, 200) ELSE tokens END AS tokens FROM cut)
SELECT doc_id || '#' || (row_number() OVER (PARTITION BY doc_id ORDER BY c, pos) - 1) AS chunk_id, doc_id, path AS section_path, md5(body) AS digest, tokens::INT AS token_count FROM out
""")
def q_section_chunks(spark, sf_dir):
    """The chunks table of all documents, every fifth line of which is made a heading."""
    return sections.chunks(_marked(spark, sf_dir)).select("chunk_id", "doc_id", "section_path", F.md5("norm_text").alias("digest"), "token_count")


@query(r"""
SELECT doc_id::VARCHAR || '.md' AS doc_id, CASE WHEN doc_id % 4 = 3 THEN regexp_replace(doc_id || '.md', '\.[^.]+$', '') ELSE 'Doc: ' || doc_id END AS title,
       CASE WHEN doc_id % 4 IN (0, 2) THEN '["' || coalesce(lang, 'none') || '","t' || doc_id % 7 || '"]' END AS tags_json,
       CASE WHEN doc_id % 4 = 0 THEN '{"created":"' || strftime(DATE '2024-01-01' + (doc_id % 500)::INT, '%Y-%m-%d') || '"}' WHEN doc_id % 4 = 2 THEN '{}' END AS dates_json,
       CASE WHEN doc_id % 4 = 2 THEN 'wrong type: dates.created' END AS reason, md5(text) AS body FROM documents
""")
def q_front_matter(spark, sf_dir):
    """Typed front matter of documents with a planted block: flow and block lists, dates, a bad date, and none."""
    n, lang = F.col("doc_id"), F.coalesce("lang", F.lit("none"))
    head = F.concat(F.lit('---\ntitle: "Doc: '), n.cast("string"), F.lit('"\n'))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (n % 500).cast("int")).cast("string")
    flow = F.concat(head, F.lit("tags: ["), lang, F.lit(", t"), (n % 7).cast("string"), F.lit("]\ndates:\n  created: "), day, F.lit("\n---\n"))
    block = F.concat(head, F.lit("tags:\n  - "), lang, F.lit("\n  - t"), (n % 7).cast("string"), F.lit("\ndates:\n  created: soon\n---\n"))
    text = F.when(n % 4 == 0, F.concat(flow, "text")).when(n % 4 == 2, F.concat(block, "text")).when(n % 4 == 1, F.concat(head, F.lit("---\n"), "text")).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.concat(n.cast("string"), F.lit(".md")).alias("doc_id"), text.alias("text"))
    rows = matter.document_rows(docs.withColumnRenamed("doc_id", "doc_path")).select("doc_id", "title", "tags_json", "dates_json", F.md5("body").alias("body"))
    return rows.join(matter.parsed(docs).select("doc_id", F.col("matter.reason").alias("reason")), "doc_id")


NAMES_SQL = T.NAME.replace("'", "''")


@query(rf"""
WITH p AS (SELECT * FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) WHERE role = 'user' AND reply IS NOT NULL),
w AS (SELECT conv_id, turn, list_distinct(list_filter(flatten(list_transform(regexp_extract_all(reply, '{NAMES_SQL}'), lambda n: regexp_extract_all(lower(regexp_replace(n, '^[^\p{{Lu}}]+', '')), '{T.WORD.replace("'", "''")}', 1))), lambda x: NOT list_contains(regexp_extract_all(lower(text), '{T.WORD.replace("'", "''")}', 1), x))) AS fresh FROM p)
SELECT conv_id, turn, len(fresh)::INT AS n_new, array_to_string(list_sort(fresh), ',') AS new_names FROM w
""")
def q_new_names(spark, sf_dir):
    """Words of names in each reply that its question doesn't have: what the safety check of a rewrite refuses."""
    fresh = T.new_names(F.col("text"), F.col("reply"))
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.size(fresh).alias("n_new"), F.array_join(F.sort_array(fresh), ",").alias("new_names"))


@query(r"""
WITH b AS (SELECT doc_id || '.txt' AS doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents),
t AS (SELECT *, len(regexp_extract_all(body, '\S+')) AS tokens FROM b WHERE regexp_matches(body, '\S')),
c AS (SELECT *, unnest(range(0, CASE WHEN tokens > 200 THEN tokens ELSE 1 END, 200)) AS pos FROM t)
SELECT doc_id || '#' || pos // 200 AS chunk_id, doc_id, '' AS section_path, md5(CASE WHEN tokens > 200 THEN regexp_replace(array_to_string(regexp_extract_all(body, '\S+\s*')[pos + 1 : pos + 200], ''), '\s+$', '') ELSE body END) AS digest, (CASE WHEN tokens > 200 THEN least(tokens - pos, 200) ELSE tokens END)::INT AS token_count FROM c
""")
def q_catalogue(spark, sf_dir):
    """Documents and chunks kept up to date from an earlier state: the rows of a table filled at once."""
    docs, old = _earlier(spark, sf_dir)
    scan = lambda rows: rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_path"), "text")
    base = _folder(spark, "catalogue")
    catalogue.update(scan(old), base, buckets=16)
    catalogue.update(scan(docs), base, buckets=16)
    rows = keyed.KeyedTable(spark, f"{base}/chunks").rows()
    return rows.select("chunk_id", "doc_id", "section_path", F.md5("norm_text").alias("digest"), "token_count")
