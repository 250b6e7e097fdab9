"""Queries over evidence: tiers, phases, and counts of links, where documents stand for what was dispatched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import evidence
from tracelake.plans.registry import Registry
from tracelake.tables import table

R = Registry()

#: Rules on texts (briefs) and on sources (paths that were read).
RULES = (
    evidence.Rule("credentials", "Credentials", (evidence.Pattern("pass(word|wd)"), evidence.Pattern("tok[e]n *[:=]"), evidence.Pattern("src1[0-4]", "read", "dir"))),
    evidence.Rule("licensing", "Licensing", (evidence.Pattern("[Ll]icen[cs]e", kind="phase_file"), evidence.Pattern("src1$", "read", "skill_file"))),
    evidence.Rule("contacts", None, (evidence.Pattern("[a-z0-9.]+@[a-z0-9]+"), evidence.Pattern("src[2-4]", "read", "no such kind"))),
)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as briefs: one that a label calls toxic is known for it, whatever its text says; others are told by rules."""
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    refs = F.concat(evidence.match_refs(F.col("text"), F.lit("brief"), RULES, "brief"), evidence.match_refs(F.col("source"), F.concat(F.lit("read:"), "source"), RULES, "read"))
    d = d.select("doc_id", "lang", F.col("n_chars").alias("cost"), F.concat(F.lit("toxic-"), "lang").alias("fact"), (F.col("toxic") == 1).alias("sure"), refs.alias("refs"))
    d = d.withColumn("refs", F.when(F.col("sure"), F.array().cast(d.schema["refs"].dataType)).otherwise(F.col("refs")))
    return evidence.resolved(d, "fact", F.col("sure"))


_TIERS = r"""WITH p(no, phase, target, kind, pat) AS (VALUES (1, 'credentials', 'brief', 'unknown', 'pass(word|wd)'), (2, 'credentials', 'brief', 'unknown', 'tok[e]n *[:=]'), (3, 'licensing', 'brief', 'phase_file', '[Ll]icen[cs]e'),
  (4, 'contacts', 'brief', 'unknown', '[a-z0-9.]+@[a-z0-9]+'), (5, 'credentials', 'read', 'dir', 'src1[0-4]'), (6, 'licensing', 'read', 'skill_file', 'src1$')),
t AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, text, source, lang, n_chars, coalesce(toxic = 1, false) AS sure FROM documents LEFT JOIN t USING (doc_id)),
h AS (SELECT doc_id, no, phase, kind, CASE target WHEN 'brief' THEN 'brief' ELSE 'read:' || source END AS source, CASE target WHEN 'brief' THEN text ELSE source END AS t, pat FROM d, p
      WHERE NOT sure AND regexp_matches(CASE target WHEN 'brief' THEN text ELSE source END, pat)),
r AS (SELECT *, regexp_extract(t, pat) AS ref FROM h),
g AS (SELECT doc_id, string_agg(phase || '|' || kind || '|' || source || '|' || ref || '|' || (strpos(t, ref) - 1), ';' ORDER BY no) AS refs, count(DISTINCT phase) AS n, min(phase) AS one, list_sort(list_distinct(list(phase))) AS phases FROM r GROUP BY doc_id),
v AS (SELECT doc_id, lang, n_chars AS cost, CASE WHEN sure THEN 'A' WHEN n > 0 THEN 'B' ELSE 'C' END AS tier, CASE WHEN sure THEN 'toxic-' || lang WHEN n = 1 THEN one END AS phase_id, coalesce(refs, '') AS refs,
             CASE WHEN sure THEN ['toxic-' || lang] ELSE phases END AS phases FROM d LEFT JOIN g USING (doc_id))
"""


@R.query(_TIERS + "SELECT doc_id, tier, phase_id, coalesce(array_to_string(phases, ','), '') AS phases, refs FROM v")
def dispatch_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.transform("refs", lambda r: F.concat_ws("|", r["phase_id"], r["kind"], r["source"], r["ref"], r["offset"].cast("string")))
    return _tiers(spark, sf_dir).select("doc_id", "tier", "phase_id", F.array_join("phases", ",").alias("phases"), F.array_join(ref, ";").alias("refs"))


@R.query(
    _TIERS
    + """, o AS (SELECT doc_id, lang, tier, unnest(phases) AS phase, len(phases) AS n, cost FROM v)
SELECT doc_id, phase, CASE WHEN tier = 'A' THEN lang WHEN phase = 'credentials' THEN 'Credentials' WHEN phase = 'licensing' THEN 'Licensing' END AS name, CASE WHEN n = 1 THEN cost END AS cost FROM o"""
)
def phase_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each phase that a document is evidence of; its cost is withheld where there are several."""
    o = evidence.observed(_tiers(spark, sf_dir), "cost", RULES, "lang")
    return o.select("doc_id", F.col("observed_phase").alias("phase"), F.col("phase_name").alias("name"), "cost")


@R.query(
    """WITH k AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'records' AS how FROM labels UNION SELECT CAST(vec_id AS VARCHAR), 'meta' FROM embeddings
  UNION SELECT CAST(conv_id AS VARCHAR), 'chat' FROM conversations UNION SELECT source, 'meta' FROM documents),
p AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents),
j AS (SELECT p.id, p.lang, k.how FROM p JOIN k USING (id))
SELECT lang, count(how) FILTER (how = 'records') AS joined, count(how) FILTER (how = 'chat') AS joined_via_ide_db, count(how) FILTER (how = 'meta') AS joined_via_meta_only,
       count(*) FILTER (how IS NULL) AS orphan_dispatches, count(*) AS dispatches, (SELECT count(*) FROM k WHERE id IS NULL OR id NOT IN (SELECT id FROM p)) AS unmatched_subagent_files
FROM (SELECT * FROM j UNION ALL SELECT id, lang, NULL FROM p WHERE id NOT IN (SELECT id FROM k)) GROUP BY lang"""
)
def dispatch_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are calls; labels, vectors and conversations their children by number, of three kinds; children named by a source belong
    to nobody. Counts of both sides by language."""
    text = lambda c: F.col(c).cast("string").alias("id")
    d = table(spark, sf_dir, "documents")
    p = d.select(text("doc_id"), "lang")
    kinds = [
        table(spark, sf_dir, "labels").select(text("doc_id"), F.lit("records").alias("how")),
        table(spark, sf_dir, "embeddings").select(text("vec_id"), F.lit("meta").alias("how")),
        table(spark, sf_dir, "conversations").select(text("conv_id"), F.lit("chat").alias("how")),
        d.select(text("source"), F.lit("meta").alias("how")),
    ]
    k = kinds[0]
    for more in kinds[1:]:
        k = k.unionByName(more)
    k = k.distinct()
    # one join both ways: a side without the other is a row of its own
    j = p.withColumn("_p", F.lit(True)).join(k, "id", "full")
    count = lambda c: F.count_if(c)
    by = j.groupBy("lang").agg(
        count((F.col("how") == "records") & F.col("_p")).alias("joined"),
        count((F.col("how") == "chat") & F.col("_p")).alias("joined_via_ide_db"),
        count((F.col("how") == "meta") & F.col("_p")).alias("joined_via_meta_only"),
        count(F.col("how").isNull()).alias("orphan_dispatches"),
        count(F.col("_p")).alias("dispatches"),
        count(F.col("_p").isNull()).alias("lost"),
    )
    every = F.sum("lost").over(Window.partitionBy(F.lit(1)))  # rows are one a language
    return by.withColumn("unmatched_subagent_files", every).where("dispatches > 0").drop("lost")
