"""Queries over texts: token estimates, normal forms, what people did, catalog tiers, near-duplicate bodies and descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions import interventions, text
from tracelake.operators import graph, judging, mentions, similarity
from tracelake.plans.registry import Registry
from tracelake.tables import table

R = Registry()
#: White space as \s with Unicode has it, for SQL.
_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_EST = r"""CASE WHEN coalesce(length({0}), 0) = 0 THEN 0 ELSE greatest(1, length({0}) - length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]', '', 'g'))
  + length(regexp_replace({0}, '[\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}]', '', 'g')) // 4) END"""


def _est(col: str) -> str:
    return _EST.format(col)


@R.query(
    f"""SELECT 'document' AS origin, doc_id AS id, 0 AS part, CAST({_est('text')} AS BIGINT) AS tokens FROM documents
UNION ALL SELECT 'benchmark', item_id, 0, CAST({_est('text')} AS BIGINT) FROM benchmark
UNION ALL SELECT 'conversation', conv_id, turn, CAST({_est('text')} AS BIGINT) FROM conversations"""
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(origin: str, name: str, ident: str, part: str | None = None) -> DataFrame:
        t = table(spark, sf_dir, name)
        return t.select(F.lit(origin).alias("origin"), F.col(ident).alias("id"), (F.col(part) if part else F.lit(0)).cast("long").alias("part"), text.estimate_tokens(F.col("text")).alias("tokens"))

    return of("document", "documents", "doc_id").unionByName(of("benchmark", "benchmark", "item_id")).unionByName(of("conversation", "conversations", "conv_id", "turn"))


@R.query(f"SELECT doc_id, sha1(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents")
def normalize_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.digest(F.col("text")).alias("digest"))


_PEOPLE = "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'"
#: What the invented prose can be; the other rules have tests of their own.
_LABELS = rf"""WITH c AS ({_PEOPLE}), s AS (SELECT *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS bare FROM c),
l AS (SELECT *, trim(regexp_replace(lower(regexp_replace(bare, '{_WS}+', ' ', 'g')), '^[。．.！!？?，,、；;：:~ \t]+|[。．.！!？?，,、；;：:~ \t]+$', '', 'g')) AS form FROM s),
r AS (SELECT conv_id, turn, CASE WHEN bare <> '' AND regexp_replace(bare, '[？?]', '', 'g') = '' THEN 'status' WHEN regexp_matches(form, '^[a-z0-9]$') OR form = 'ok' THEN 'confirm'
       WHEN form IN ('push', 'ls', 'exit', 'services') THEN 'chore' WHEN regexp_matches(bare, '[？?]$') AND regexp_matches(bare, '[^。．.！!？?\n]+[？?]$') THEN 'question' ELSE 'unclassified' END AS label,
       regexp_extract(bare, '[^。．.！!？?\n]+[？?]$') AS clause FROM l)
"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").where("role = 'user'")
    return t.select("conv_id", "turn", interventions.classify(F.col("text")).alias("c"), "text")


@R.query(f"SELECT conv_id, turn, sha1(text) AS lead_sha1, 0 AS n_carriers FROM ({_PEOPLE})")
def carrier_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = interventions.strip_carriers(F.col("text"))
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.sha1(s["lead"]).alias("lead_sha1"), F.size(s["carriers"]).alias("n_carriers"))


@R.query(_LABELS + f"SELECT conv_id, turn, label, CASE WHEN label = 'question' THEN sha1(regexp_replace(clause, '^{_WS}+', '')) END AS clause_sha1 FROM r")
def intervention_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _people(spark, sf_dir).select("conv_id", "turn", F.col("c.label").alias("label"), F.when(F.col("c.label") == "question", F.sha1(F.col("c.evidence"))).alias("clause_sha1"))


@R.query(
    _LABELS
    + """, f AS (SELECT text, arg_min(label, row(conv_id, turn)) AS first_label, count(DISTINCT label) AS labels, count(*) AS n FROM r JOIN c USING (conv_id, turn) GROUP BY text)
SELECT first_label AS label, count(*) AS leads, sum(n)::BIGINT AS n, count(*) FILTER (labels > 1) AS conflicts,
  round(sum(n) / sum(sum(n)) OVER (), 6) AS share FROM f GROUP BY first_label"""
)
def intervention_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct leads by their first label, leads with more than one, and each label's share; that of unclassified is the residue."""
    p = _people(spark, sf_dir).select("conv_id", "turn", F.sha2("text", 256).alias("lead"), F.col("c.label").alias("label"))
    leads = p.groupBy("lead").agg(F.min_by("label", F.struct("conv_id", "turn")).alias("label"), F.count_distinct("label").alias("_labels"), F.count("*").alias("_n"))
    g = leads.groupBy("label").agg(F.count("*").alias("leads"), F.sum("_n").alias("n"), F.count_if(F.col("_labels") > 1).alias("conflicts"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row for each label at most


@R.query(
    r"""WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>') AS b,
  regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<nav\b[^>]*>.*?</nav\s*>', '', 'g') AS human FROM pages)
SELECT page_id, sha1(human) AS human_sha1, sha1(array_to_string(b, chr(10))) AS injected_sha1 FROM p"""
)
def inject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    human, injected = text.split_injected(F.col("html"), ("script", "style", "nav"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(human).alias("human_sha1"), F.sha1(injected).alias("injected_sha1"))


@R.query(
    f"""WITH d AS (SELECT doc_id, source, CAST({_est('text')} AS BIGINT) AS tokens, sha1(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')) AS digest FROM documents)
SELECT digest, count(*) AS n, count(DISTINCT source) AS n_buckets, count(DISTINCT source) > 1 AS cross_bucket, (sum(tokens) - arg_min(tokens, doc_id))::BIGINT AS repeat_tokens, min(doc_id) AS first_item
FROM d GROUP BY digest HAVING count(*) >= 2"""
)
def redundancy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.operators import redundancy

    d = table(spark, sf_dir, "documents").select("doc_id", "source", text.estimate_tokens(F.col("text")).alias("tokens"), text.digest(F.col("text")).alias("digest"))
    return redundancy.duplicate_groups(d, "digest", "doc_id", "source", "tokens", "doc_id")


_BODIES = r"""WITH RECURSIVE l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda s: trim(regexp_replace(regexp_replace(s, '^[ \t]*(?:[#>*+-]|\d+\.)+[ \t]*', ''), '[ \t\r\f\x0B]+', ' ', 'g'))), lambda s: s <> '') AS l FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i + 2], chr(10))) ELSE l END)) AS sh FROM l),
r AS (SELECT min(doc_id) AS id, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS w FROM r),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, a.n AS n_a, b.n AS n_b FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY ALL),
bp AS (SELECT *, round(shared / least(n_a, n_b), 6) AS score FROM p WHERE shared / least(n_a, n_b) >= 0.6)
"""


def _body_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), similarity.body_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return d.select("id", similarity.windows(F.col("lines"), similarity.LINES, "\n").alias("shingles"))


@R.query(_BODIES + "SELECT * FROM bp")
def dup_body_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal bodies; dup_body_classes tells whom a class holds."""
    return similarity.similar_pairs(_body_sets(spark, sf_dir), similarity.CONTAINMENT, "containment")


@R.query(_BODIES + "SELECT doc_id AS node, id AS class_id FROM s JOIN r USING (sh)")
def dup_body_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.classes(_body_sets(spark, sf_dir))


@R.query(
    r"""WITH d AS (SELECT conv_id * 10000 + turn AS doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w FROM conversations),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE w END)) AS sh FROM d),
r AS (SELECT min(doc_id) AS id, sh FROM s WHERE len(sh) > 0 GROUP BY sh),
x AS (SELECT id, len(sh) AS n, unnest(sh) AS w FROM r),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS shared, a.n AS n_a, b.n AS n_b FROM x a JOIN x b ON a.w = b.w AND a.id < b.id GROUP BY ALL)
SELECT *, round(shared / (n_a + n_b - shared), 6) AS score FROM p WHERE shared / (n_a + n_b - shared) >= 0.8"""
)
def dup_desc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations stand for descriptions of catalog entries: short texts, taken whole."""
    turn = (F.col("conv_id") * 10_000 + F.col("turn")).alias("id")
    d = table(spark, sf_dir, "conversations").select(turn, similarity.words(F.coalesce("text", F.lit(""))).alias("w"))
    return similarity.similar_pairs(d.select("id", similarity.windows(F.col("w"), similarity.WORDS, " ").alias("shingles")), similarity.JACCARD, "jaccard")


_CLUSTERS = """, ed AS (SELECT a AS u, b AS v FROM bp UNION SELECT b, a FROM bp),
reach AS (SELECT u AS node, u AS seen FROM ed UNION SELECT reach.node, ed.v FROM reach JOIN ed ON ed.u = reach.seen),
cl AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
"""


@R.query(_BODIES + _CLUSTERS + "SELECT * FROM cl")
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(dup_body_pairs(spark, sf_dir))


@R.query(
    _BODIES
    + _CLUSTERS
    + """, m AS (SELECT count(*) AS n FROM s JOIN r USING (sh) WHERE id IN (SELECT node FROM cl) OR doc_id <> id OR id IN (SELECT r2.id FROM s s2 JOIN r r2 USING (sh) WHERE s2.doc_id <> r2.id))
SELECT n AS members, (SELECT count(*) FROM documents) AS documents, round(n / (SELECT count(*) FROM documents), 6) AS dup_rate FROM m"""
)
def dup_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of documents whose body some other body equals or contains for the most part."""
    c = similarity.classes(_body_sets(spark, sf_dir)).groupBy("class_id").agg(F.count("*").alias("n"))
    near = dup_clusters(spark, sf_dir).select(F.col("node").alias("class_id")).withColumn("_near", F.lit(True))
    m = c.join(near, "class_id", "left").where("_near or n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    every = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))
    return m.crossJoin(every).withColumn("dup_rate", F.round(F.col("members") / F.col("documents"), 6))  # one row each


@R.query(
    """WITH t AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents)
SELECT doc_id, lines, CASE WHEN lines > 500 THEN 'oversize' WHEN lines > 200 THEN 'large' ELSE 'ok' END AS tier FROM t"""
)
def catalog_size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("lines"))
    return t.withColumn("tier", text.size_tier(F.col("lines")))


@R.query(
    """WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars FROM conversations)
SELECT conv_id, turn, chars, CASE WHEN chars < 3 THEN 'unusable' WHEN chars > 300 THEN 'verbose' WHEN chars < 50 THEN 'terse' ELSE 'ok' END AS tier FROM t"""
)
def desc_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return t.withColumn("tier", text.description_tier(F.col("chars")))


@R.query(
    f"""WITH t AS (SELECT source, CAST({_est('string_split(text, chr(10))[1]')} AS BIGINT) AS d, CAST({_est('text')} AS BIGINT) AS a FROM documents)
SELECT source, sum(d)::BIGINT AS discovery, sum(a)::BIGINT AS activation, round(sum(a) / nullif(sum(d), 0), 6) AS ratio, count(*) AS skills FROM t GROUP BY source"""
)
def layering_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", text.estimate_tokens(F.split("text", "\n", 2)[0]).alias("d"), text.estimate_tokens(F.col("text")).alias("a"))
    g = d.groupBy("source").agg(F.sum("d").alias("discovery"), F.sum("a").alias("activation"), F.count("*").alias("skills"))
    return g.withColumn("ratio", F.round(F.try_divide(F.col("activation"), F.col("discovery")), 6))


@R.query(
    r"""WITH p AS (SELECT page_id, regexp_replace(html, '<a href="([^"]*)"[^>]*>', '[x](\1)', 'g') AS body FROM pages),
m AS (SELECT page_id, list_distinct(list_concat(regexp_extract_all(body, '\[[^\]]*\]\(([^)\s]+)\)', 1), regexp_extract_all(body, '(?:^|[\s`(])((?:references|scripts|assets)/[A-Za-z0-9_./-]+)', 1))) AS t FROM p),
f AS (SELECT page_id, list_sort(list_filter(list_transform(list_filter(t, lambda x: NOT regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:|^#|^//')), lambda x: regexp_replace(x, '[#?].*$', '')), lambda x: x <> '')) AS t FROM m)
SELECT page_id, len(t) AS n_refs, sha1(array_to_string(t, chr(10))) AS refs_sha1 FROM f"""
)
def local_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace("html", r'<a href="([^"]*)"[^>]*>', r"[x]($1)")
    p = table(spark, sf_dir, "pages").select("page_id", text.local_references(body).alias("t"))
    return p.select("page_id", F.size("t").alias("n_refs"), F.sha1(F.array_join("t", "\n")).alias("refs_sha1"))


@R.query(
    """WITH l AS (SELECT page_id, unnest(string_split(html, '>')) AS line, unnest(range(1, len(string_split(html, '>')) + 1)) AS n FROM pages),
k AS (SELECT page_id, n, CASE WHEN starts_with(lower(trim(line)), '<script') THEN 'scripted' WHEN starts_with(lower(trim(line)), '<nav') THEN 'navigated' WHEN starts_with(lower(trim(line)), '<article') THEN 'article' END AS kind FROM l)
SELECT page_id, arg_min(kind, n) FILTER (kind IS NOT NULL) AS format FROM k GROUP BY page_id"""
)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first decisive record tells the format; records that tell nothing are passed over."""
    from tracelake.sources.transcripts import first_decisive

    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", ">", -1)).alias("n", "line"))
    low = F.lower(F.trim("line"))
    kind = F.when(F.startswith(low, F.lit("<script")), "scripted").when(F.startswith(low, F.lit("<nav")), "navigated").when(F.startswith(low, F.lit("<article")), "article")
    return first_decisive(rows.withColumn("format", kind), "page_id", "n", "format")


@R.query(
    """WITH n AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{3,}'))) AS name FROM benchmark),
c AS (SELECT conv_id, string_agg(lower(text), chr(10) ORDER BY turn, text) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT DISTINCT conv_id, name FROM c JOIN n ON contains(t, name)"""
)
def mentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that occur in what people wrote in a session; all words of the benchmark's texts are names."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    names = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("name")).select(F.lower("name").alias("name"))
    said = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.lower(t["text"])), "\n").alias("t"))
    return mentions.mentions(said, names, "conv_id", "t", "name")


@R.query(
    """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, CASE WHEN length(text) > 60 THEN substr(text, 1, 60) || ' ...' ELSE text END AS t FROM c WHERE role = 'user'),
b AS (SELECT conv_id, string_agg('Turn ' || n || ': ' || t, chr(10) || chr(10) ORDER BY n) AS block FROM u GROUP BY conv_id),
a AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS t FROM c GROUP BY conv_id)
SELECT conv_id, coalesce(block, '(no user turns found)') AS block, CASE WHEN length(t) > 400 THEN substr(t, 1, 400) || ' ...' ELSE t END AS trajectory FROM a LEFT JOIN b USING (conv_id)"""
)
def judge_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge gets to read of each conversation: its user turns, each cut, and its trajectory within a budget."""
    c = table(spark, sf_dir, "conversations")
    block = judging.turns_block(c, c.where("role = 'user'"), ["conv_id"], "turn", most=60)
    line = c.select("conv_id", "turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("text"))
    return block.join(judging.trajectory(line, ["conv_id"], ["turn"], budget=400), "conv_id")
