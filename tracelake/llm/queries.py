"""The numbered operators over the driver tables, as queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import chat_format, decontaminate, hard_negatives, importance, lm_scoring, minhash_dedup, mixing, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, url_filter
from tracelake.tables import table

#: The rules of op1: host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


_OP1_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                           ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
n AS (SELECT *, row_number() OVER () AS rid FROM u),
fit AS (SELECT n.rid, r.host || r.path AS rule, r.verdict,
               row_number() OVER (PARTITION BY n.rid ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict) AS k
        FROM n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path))
SELECT n.page_id, n.host, n.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM n LEFT JOIN fit ON fit.rid = n.rid AND fit.k = 1
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_chats(turns).withColumn("turns", chat_format.read_back(F.col("formatted")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.withColumn("loss", chat_format.loss_text(F.col("segments"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS text_len,
             length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS role_len
      FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(8 + sum(text_len + CASE WHEN k = 1 THEN role_len + 6 WHEN role = before THEN 12 ELSE role_len + 14 END) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan.scan(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.listed(secret_scan.base_only(F.col("spans"))), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
        "n_opaque",
        "n_copied",
    )


_OP2_SQL = r"""
WITH kinds(kind, name, pat, least) AS (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 6),
  (1, 'access', 'AKIA[A-Z0-9]{16,}', 20), (2, 'hex', '[0-9a-f]{24,}', 24),
  (3, 'opaque', '[A-Za-z0-9+/_-]{32,}(?:\.[A-Za-z0-9+/_-]{8,}){0,2}={0,2}', 32)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(source, '') AS repo, coalesce(text, '') AS text FROM documents),
m AS (SELECT rid, owner, repo, kind, name, least, regexp_extract_all(text, pat) AS found, string_split_regex(text, pat) AS gaps FROM d, kinds WHERE regexp_matches(text, pat)),
u AS (SELECT rid, owner, repo, kind, name, least, i, found[i] AS match, length(gaps[i]) AS gap
      FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
v AS (SELECT *, CASE WHEN kind = 0 THEN regexp_extract(match, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE match END AS value,
             CAST(sum(gap + length(match)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM u),
g AS (SELECT *, stop - length(match) AS start FROM v
      WHERE length(value) >= least AND (kind < 3 OR (regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[0-9]')))),
c AS (SELECT value FROM g GROUP BY value HAVING count(DISTINCT owner) > 2 OR count(DISTINCT repo) > 8),
k AS (SELECT *, value IN (SELECT value FROM c) AS copied FROM g),
s AS (SELECT * FROM k WHERE kind < 3 OR (NOT copied AND NOT EXISTS (SELECT 1 FROM k b WHERE b.rid = k.rid AND b.kind < 3 AND b.start < k.stop AND k.start < b.stop)))
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind IS NOT NULL), '') AS spans,
       count(*) FILTER (kind = 3) AS n_opaque, count(*) FILTER (copied) AS n_copied
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.judge(table(spark, sf_dir, "documents"))
    return done.withColumn("failed", F.array_join("failed", ","))


_OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, unnest([0, 1, 2]) AS o FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1) GROUP BY rid),
m AS (SELECT rid, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(l) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             [coalesce(n_symbols / nullif(n_words, 0), 0), coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(n_repeat_words / nullif(n_words, 0), 0),
              coalesce(n_upper / nullif(word_chars, 0), 0), coalesce(word_chars / nullif(n_words, 0), 0), n_words, n_lines, word_chars]::DOUBLE[] AS x FROM m),
b AS (SELECT lang, source, k, CASE WHEN x[k] < 1e-9 THEN -1048576 ELSE CAST(ceil(ln(x[k]) / ln(1.02::DOUBLE)) AS INT) END AS bin FROM v, range(1, 9) r(k) WHERE NOT base_failed),
s0 AS (SELECT 0 AS level, lang, source, k, bin, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 1, lang, NULL, k, bin, count(*) FROM b GROUP BY ALL
       UNION ALL SELECT 2, NULL, NULL, k, bin, count(*) FROM b GROUP BY ALL),
s AS (SELECT * FROM s0 UNION ALL SELECT level, lang, source, k + 10, bin, n FROM s0 WHERE k <= 5 AND bin > -1048576),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY level, lang, source, k) AS total,
             CASE WHEN bin = -1048576 THEN 0 ELSE pow(1.02::DOUBLE, bin) END AS value FROM s),
lv(j, p) AS (VALUES (1, 0.05), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.9), (6, 0.95)),
q AS (SELECT level, lang, source, k, j, max(total) AS n, min(value) FILTER (upto >= p * total) AS y FROM c, lv GROUP BY ALL),
g AS (SELECT DISTINCT d.lang, d.source, r.k, lv.j FROM d, range(1, 16) r(k), lv),
pl AS (SELECT g.*, CASE WHEN l.n IS NULL THEN e.y ELSE (l.n * l.y + 50 * e.y) / (l.n + 50) END AS y
       FROM g LEFT JOIN q l ON l.level = 1 AND l.lang = g.lang AND l.k = g.k AND l.j = g.j LEFT JOIN q e ON e.level = 2 AND e.k = g.k AND e.j = g.j),
pg AS (SELECT p.lang, p.source, p.k, p.j, CASE WHEN o.n IS NULL THEN p.y ELSE (o.n * o.y + 50 * p.y) / (o.n + 50) END AS y
       FROM pl p LEFT JOIN q o ON o.level = 0 AND o.lang = p.lang AND o.source = p.source AND o.k = p.k AND o.j = p.j),
pw AS (SELECT lang, source, k, max(y) FILTER (j = 1) AS q05, max(y) FILTER (j = 2) AS q25, max(y) FILTER (j = 3) AS q50, max(y) FILTER (j = 4) AS q75, max(y) FILTER (j = 5) AS q90, max(y) FILTER (j = 6) AS q95 FROM pg GROUP BY ALL),
ph AS (SELECT a.*, greatest(a.q75 + 3 * (a.q75 - a.q25) + CASE WHEN a.q50 > 0 THEN a.q95 - a.q50 ELSE 0 END, a.q90, coalesce(0.9::DOUBLE * z.q05, 0),
                            CASE WHEN a.k < 5 THEN list_extract([5, 5, 50, 5], a.k) / greatest(n.q50, 1) ELSE 0 END) AS top
       FROM pw a JOIN pw z ON z.lang = a.lang AND z.source = a.source AND z.k = a.k + 10
       JOIN pw n ON n.lang = a.lang AND n.source = a.source AND n.k = list_extract([6, 7, 6, 8, 6], a.k) WHERE a.k <= 5 AND a.q50 IS NOT NULL),
p AS (SELECT lang, source, k, CASE WHEN k IN (2, 3, 4) THEN least(top, 0.9::DOUBLE) ELSE top END AS hi, q25 - 3 * (q75 - q25) - (q50 - q05) AS lo FROM ph),
f AS (SELECT rid, string_agg(list_extract(['symbol_rate', 'dup_line_share', 'repeat_share', 'upper_share', 'mean_word'], k), ',' ORDER BY k) AS failed
      FROM v JOIN p USING (lang, source) WHERE n_words > 0 AND (x[k] > hi OR (k = 5 AND x[k] < lo)) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed, '') AS failed, NOT base_failed AND failed IS NULL AS kept FROM v LEFT JOIN f USING (rid)
"""



def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
           FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
      FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT rid, dw.k, i, item FROM dw JOIN bw USING (k, win)),
cov AS (SELECT rid, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT rid, i, unnest(range(0, k)) AS o FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


_OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
ed AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT u AS node, u AS seen FROM ed UNION SELECT reach.node, ed.v FROM reach JOIN ed ON ed.u = reach.seen),
c AS (SELECT node AS doc_id, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT rid, i + o AS p FROM (SELECT win.rid, win.i, unnest(range(0, 50)) AS o FROM win JOIN least_doc USING (s) WHERE win.doc_id > m)),
off AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN off USING (rid)
"""


#: Scores from here on count as label 1.
QUALITY_CUT = 0.7


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.withColumn("predicted", (F.col("score") >= QUALITY_CUT).cast("int"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


_OP11_SQL = r"""
WITH bits AS (SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM b) GROUP BY w),
words AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
crc AS (SELECT w, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                                       lambda a, x: xor(a >> 8, list_extract(t, (xor(a, x) & 255) + 1))), 4294967295) % 10000 AS BIGINT) AS k FROM words, bits),
s AS (SELECT k, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY k),
g AS (SELECT s.k, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(s), 0) FROM s) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(t), 0) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (k)),
x AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN crc USING (w) JOIN g USING (k) GROUP BY rid),
y AS (SELECT doc_id, len(w) AS n_words, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN x USING (rid)),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, (SELECT count(*) FROM y WHERE n_words >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM z
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


_OP12_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, a.vec_id IS DISTINCT FROM c.vec_id AS other, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a, v c WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE alike AND other),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.k ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.rid = p.rid AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_secret_scans,
        op3_quality_rules,
        op4_substring_dedup,
        op5_lm_scoring,
        op6_quality_classifier,
        op7_minhash_near_dedup,
        op8_packing,
        op9_chat_formatting,
        op10_benchmark_decontamination,
        op11_importance_resampling,
        op12_hard_negatives,
        op13_source_mixing,
    )
}
#: SQL can't express operators 5 and 6 (models), 8 (a tokenizer) and 13 (draws): they are tested against plain functions.
ORACLE_SQL = {
    "op1_url_filters": _OP1_SQL,
    "op2_secret_scans": _OP2_SQL,
    "op3_quality_rules": _OP3_SQL,
    "op4_substring_dedup": _OP4_SQL,
    "op7_minhash_near_dedup": _OP7_SQL,
    "op9_chat_formatting": _OP9_SQL,
    "op10_benchmark_decontamination": _OP10_SQL,
    "op11_importance_resampling": _OP11_SQL,
    "op12_hard_negatives": _OP12_SQL,
}
