"""Queries over what several operators make together: gaps, bills, parts of growth, fleets, libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import asof, billing, gaps, growth, loads, pairing
from tracelake.plans import sessions as s
from tracelake.plans.adapters import RECORDS, S, boundaries, items, records
from tracelake.plans.registry import Registry
from tracelake.tables import table

R = Registry()

# Skills are the nation and the market segment of the customer whose number an event names; signups list them, views are stubs, clicks
# bodies, purchases executions. The catalog holds nations and suppliers, but no segments. A session's person names the nations of the region
# that the customer of its number lives in, and each order of that customer is a judgment on the customer's own nation.
_SKILLS = RECORDS + """, kc AS (SELECT e.session, n_name, c_mktsegment, event_type FROM e JOIN customer ON c_custkey = k JOIN nation ON n_nationkey = c_nationkey WHERE event_type <> 'error'),
sk AS (SELECT session, lower(n_name) AS skill_id, event_type FROM kc UNION ALL SELECT session, lower(c_mktsegment), event_type FROM kc),
cn AS (SELECT session, skill_id, count(*) FILTER (event_type = 'signup') AS listed, count(*) FILTER (event_type = 'click') AS bodies, count(*) FILTER (event_type = 'view') AS stubs,
              count(*) FILTER (event_type = 'purchase') AS executed FROM sk GROUP BY ALL),
ca AS (SELECT n_name AS name FROM nation UNION SELECT s_name FROM supplier),
ma AS (SELECT cn.*, bodies + stubs AS loaded, ca.name AS catalog_name FROM cn LEFT JOIN ca ON lower(ca.name) = skill_id),
sa AS (SELECT DISTINCT e.session, lower('all about ' || b.n_name) AS text FROM e JOIN customer ON c_custkey = session JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_regionkey = a.n_regionkey),
ju AS (SELECT o_custkey AS session, n_name AS skill_name, o_orderstatus = 'F' AS triggered, CASE o_orderstatus WHEN 'P' THEN 'timeout' END AS error
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
op AS (SELECT ma.session, skill_id, catalog_name, catalog_name IS NOT NULL AND EXISTS (SELECT 1 FROM sa WHERE sa.session = ma.session AND contains(text, skill_id)) AS candidate
       FROM ma WHERE listed > 0 AND loaded = 0 AND executed = 0)
"""


def _skills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """matched, open, catalog, judgments."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey", "c_mktsegment")
    kinds = {"signup": "listing", "view": "stub", "click": "body", "purchase": "execution"}
    r = items(records(spark, sf_dir)).join(home, F.col("k") == F.col("c_custkey")).select("session", F.explode(F.array(F.lower("n_name"), F.lower("c_mktsegment"))).alias("skill_id"), "event_type")
    counted = gaps.counts(r.replace(kinds, subset="event_type").withColumnRenamed("event_type", "kind"), S)
    catalog = nation.select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    names = gaps.names_of(counted, S)
    matched = gaps.in_catalog(counted, names, catalog, S)
    near = home.join(nation.select("n_regionkey", F.concat(F.lit("all about "), "n_name").alias("text")), "n_regionkey").select(F.col("c_custkey").alias("session"), "text")
    own = table(spark, sf_dir, "orders").join(home, F.col("o_custkey") == F.col("c_custkey"))
    judgments = own.select(F.col("o_custkey").alias("session"), F.col("n_name").alias("skill_name"), (F.col("o_orderstatus") == "F").alias("triggered"), F.when(F.col("o_orderstatus") == "P", "timeout").alias("error"))
    return matched, gaps.candidates(matched, names, near, S), catalog, judgments


@R.query(_SKILLS + "SELECT * FROM op")
def gap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that were listed and never used, and whether a judge is to be asked about them."""
    return _skills(spark, sf_dir)[1]


@R.query(
    _SKILLS
    + """, g AS (SELECT session, count(catalog_name) AS matched, coalesce(string_agg(skill_id, ',' ORDER BY skill_id) FILTER (catalog_name IS NULL), '') AS ir_only,
  (SELECT count(DISTINCT lower(name)) FROM ca) - count(DISTINCT lower(catalog_name)) AS catalog_only, count(*) FILTER (listed > 0) AS listed, count(*) FILTER (loaded > 0) AS loaded, count(*) FILTER (executed > 0) AS executed,
  coalesce(string_agg(skill_id, ',' ORDER BY skill_id) FILTER (listed > 0 AND loaded = 0 AND executed = 0), '') AS listed_unloaded, coalesce(string_agg(skill_id, ',' ORDER BY skill_id) FILTER (bodies > 0 AND executed = 0), '') AS loaded_unused
  FROM ma GROUP BY session),
o AS (SELECT session, count(*) FILTER (candidate) AS candidates, count(*) FILTER (NOT candidate) AS prefiltered FROM op GROUP BY session),
j AS (SELECT session, count(*) AS judged, count(error) AS judge_errors, count(*) FILTER (error IS NULL AND triggered) AS missed FROM ju GROUP BY session),
r AS (SELECT g.*, coalesce(candidates, 0) AS candidates, coalesce(prefiltered, 0) AS prefiltered, coalesce(judge_errors, 0) AS judge_errors, coalesce(missed, 0) AS missed,
             greatest(0, coalesce(candidates, 0) - coalesce(judged, 0)) AS over_limit FROM g LEFT JOIN o USING (session) LEFT JOIN j USING (session))
SELECT *, prefiltered + over_limit + judge_errors AS unjudged FROM r"""
)
def gap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = gaps.report(*_skills(spark, sf_dir), S)
    return done.withColumns({c: F.array_join(c, ",") for c in ("ir_only", "listed_unloaded", "loaded_unused")})


@R.query(
    _SKILLS
    + """SELECT ju.session, skill_name, count(*) AS judgments, max(ma.skill_id) AS skill_id FROM ju LEFT JOIN ma ON ma.session = ju.session AND lower(catalog_name) = lower(skill_name)
WHERE error IS NULL AND triggered GROUP BY ALL"""
)
def missed_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments that say a skill should have been loaded, met with the skills that were seen."""
    matched, _, _, judgments = _skills(spark, sf_dir)
    return gaps.missed_triggers(matched, judgments, S).groupBy("session", "skill_name").agg(F.count("*").alias("judgments"), F.max("skill_id").alias("skill_id"))


_KINDS = ["view", "click"]
_PARTS = """, pt AS (SELECT it.session, event_type, floor(tokens / 8)::BIGINT AS tokens, (SELECT max(turn_no) FROM tu WHERE tu.session = it.session AND tu.seq <= it.seq) AS turn_no FROM it),
ps AS (SELECT session, turn_no, sum(tokens) FILTER (event_type = 'view')::BIGINT AS v, sum(tokens) FILTER (event_type = 'click')::BIGINT AS c FROM pt WHERE turn_no IS NOT NULL GROUP BY ALL),
pr AS (SELECT tr.*, CASE WHEN comparable THEN coalesce(v, 0) END AS view_added, CASE WHEN comparable THEN coalesce(c, 0) END AS click_added,
              CASE WHEN comparable THEN greatest(0, added - coalesce(v, 0) - coalesce(c, 0)) END AS system_added FROM tr LEFT JOIN ps USING (session, turn_no))
"""


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = s._turns(spark, sf_dir)
    own = items(records(spark, sf_dir)).select("session", "seq", F.col("event_type").alias("bucket"), F.floor(F.col("tokens") / 8).alias("tokens"))
    own = asof.asof(own, turns.select("session", "seq", "turn_no"), S, "seq", ["turn_no"]).where("turn_no is not null")
    return growth.turn_parts(turns, own, S, _KINDS)


@R.query(RECORDS + s._TURNS + _PARTS + "SELECT * FROM pr")
def turn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entered in each turn, and what the growth of its context leaves unexplained."""
    return _parted(spark, sf_dir)


@R.query(
    RECORDS + s._TURNS + _PARTS
    + """, t AS (SELECT session, coalesce(sum(view_added), 0)::BIGINT AS "view", coalesce(sum(click_added), 0)::BIGINT AS click, coalesce(sum(system_added), 0)::BIGINT AS system FROM pr GROUP BY session),
l AS (UNPIVOT t ON "view", click, system INTO NAME bucket VALUE bucket_tokens), w AS (SELECT *, sum(bucket_tokens) OVER (PARTITION BY session) AS whole FROM l)
SELECT session, bucket, bucket_tokens, round(bucket_tokens / whole, 6) AS share FROM w WHERE whole > 0"""
)
def part_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.part_totals(_parted(spark, sf_dir), S, _KINDS)


# Each session's figures: growth of comparable turns, repeats and their classes, listings shown again, loads, returns, output.
_FIGURES = RECORDS + s._TURNS + s._CLASSES + """, f1 AS (SELECT session, sum(added)::BIGINT AS growth FROM tr WHERE comparable GROUP BY session),
f2 AS (SELECT session, sum(tokens)::BIGINT AS repeat_extra, sum(tokens) FILTER (class = 'post_compaction')::BIGINT AS post_compaction FROM oc WHERE class IS NOT NULL GROUP BY session),
f3 AS (SELECT session, sum(tokens) FILTER (event_type = 'signup' AND nth > 1)::BIGINT AS listing_extra, count(*) FILTER (event_type = 'click' AND tokens > 15000) AS loads, sum(tokens) FILTER (event_type = 'click' AND tokens > 15000)::BIGINT AS load_cost,
              count(*) FILTER (event_type = 'view' AND tokens > 12000) AS dispatches, sum(tokens) FILTER (event_type = 'view' AND tokens > 12000)::BIGINT AS return_tokens,
              count(*) FILTER (event_type = 'purchase' AND tokens > 9000) AS usage_records, sum(tokens) FILTER (event_type = 'purchase' AND tokens > 9000)::BIGINT AS output,
              count(*) FILTER (event_type = 'signup') AS turns, count(*) FILTER (event_type = 'signup' AND k >= 10) AS signal,
              sum(tokens) FILTER (event_type = 'view') AS rd, sum(tokens) FILTER (event_type IN ('view', 'click')) AS inp
       FROM (SELECT *, row_number() OVER (PARTITION BY session, event_type, k ORDER BY seq) AS nth FROM it) GROUP BY session),
f4 AS (SELECT session, count(*) AS compactions FROM bo GROUP BY session),
fg AS (SELECT f3.*, growth, repeat_extra, post_compaction, coalesce(compactions, 0) AS compactions, round_even(CASE WHEN usage_records > 0 THEN rd / nullif(inp, 0) END, 4) AS cache_hit_rate
       FROM f3 LEFT JOIN f1 USING (session) LEFT JOIN f2 USING (session) LEFT JOIN f4 USING (session))
"""


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    grown = s._turns(spark, sf_dir).where("comparable").groupBy("session").agg(F.sum("added").alias("growth"))
    classed = s._classed(spark, sf_dir).where("class is not null").groupBy("session").agg(F.sum("tokens").alias("repeat_extra"), F.sum(F.when(F.col("class") == "post_compaction", F.col("tokens"))).alias("post_compaction"))
    nth = F.row_number().over(Window.partitionBy("session", "event_type", "k").orderBy("seq"))
    of = {"listing_extra": "event_type = 'signup' and nth > 1", "load_cost": "event_type = 'click' and tokens > 15000", "return_tokens": "event_type = 'view' and tokens > 12000", "output": "event_type = 'purchase' and tokens > 9000"}
    number = {"loads": of["load_cost"], "dispatches": of["return_tokens"], "usage_records": of["output"], "turns": "event_type = 'signup'", "signal": "event_type = 'signup' and k >= 10"}
    read, every = F.sum(F.expr("case when event_type = 'view' then tokens end")), F.sum(F.expr("case when event_type in ('view', 'click') then tokens end"))
    f = items(r).withColumn("nth", nth).groupBy("session").agg(*[F.sum(F.when(F.expr(c), F.col("tokens"))).alias(n) for n, c in of.items()], *[F.count_if(F.expr(c)).alias(n) for n, c in number.items()], read.alias("rd"), every.alias("inp"))
    f = f.withColumn("cache_hit_rate", F.bround(F.when(F.col("usage_records") > 0, F.try_divide(F.col("rd"), F.col("inp"))), 4))
    n = boundaries(r).groupBy("session").agg(F.count("*").alias("compactions"))
    return f.join(grown, "session", "left").join(classed, "session", "left").join(n, "session", "left").fillna(0, ["compactions"])


@R.query(
    _FIGURES
    + """, r0 AS (SELECT session, unnest([
  {'row_name': 'context_growth', 'applies': coalesce(growth, 0) > 0, 'volume': growth}, {'row_name': 'repeat_tax', 'applies': coalesce(repeat_extra, 0) > 0, 'volume': repeat_extra},
  {'row_name': 'skill_load_cost', 'applies': loads > 0, 'volume': nullif(load_cost, 0)}, {'row_name': 'subagent_returns', 'applies': dispatches > 0, 'volume': nullif(return_tokens, 0)},
  {'row_name': 'ceremony', 'applies': coalesce(listing_extra, 0) + coalesce(post_compaction, 0) > 0, 'volume': coalesce(listing_extra, 0) + coalesce(post_compaction, 0)},
  {'row_name': 'output', 'applies': true, 'volume': CASE WHEN usage_records > 0 THEN coalesce(output, 0) END}, {'row_name': 'cache_signal', 'applies': true, 'volume': NULL::BIGINT}]) AS r FROM fg),
r1 AS (SELECT session, r.row_name AS row_name, r.volume AS volume, list_position(['context_growth', 'repeat_tax', 'skill_load_cost', 'subagent_returns', 'ceremony', 'output', 'cache_signal'], r.row_name) AS k FROM r0 WHERE r.applies),
r2 AS (SELECT *, coalesce(sum(volume) FILTER (k <= 4) OVER (PARTITION BY session), 0)::BIGINT AS subtotal FROM r1)
SELECT session, row_name, volume, subtotal, CASE WHEN k <= 4 THEN round(volume / nullif(subtotal, 0), 4) END AS share,
       row_number() OVER (PARTITION BY session ORDER BY k <= 4 DESC, CASE WHEN k <= 4 THEN -coalesce(volume, 0) END, k) AS place FROM r2"""
)
def bill_cost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each session's bill."""
    return billing.cost_rows(_figures(spark, sf_dir), S)


_FLEET_SUMS = """count(*) AS sessions, count(cache_hit_rate) AS with_usage, round(sum(turns) / count(*), 1) AS avg_turns, round(CAST(sum(CAST(cache_hit_rate AS DECIMAL(20, 4))) AS DOUBLE) / nullif(count(cache_hit_rate), 0), 3) AS avg_cache_hit_rate,
  coalesce(sum(output), 0)::BIGINT AS output, coalesce(sum(repeat_extra), 0)::BIGINT AS repeat_extra, coalesce(sum(listing_extra), 0)::BIGINT AS listing_extra,
  (coalesce(sum(listing_extra), 0) + coalesce(sum(post_compaction), 0))::BIGINT AS ceremony, coalesce(sum(compactions), 0)::BIGINT AS compactions, round(sum(signal) / count(*), 1) AS avg_signal"""


def _styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _figures(spark, sf_dir).withColumn("style", loads.process_style(F.col("dispatches") > 0, F.col("loads") > 0))


@R.query(
    _FIGURES
    + ", sty AS (SELECT *, CASE WHEN dispatches > 0 AND loads > 0 THEN 'pipeline' WHEN dispatches = 0 AND loads = 0 THEN 'direct' ELSE 'mixed' END AS style FROM fg)\n"
    + f"SELECT style, {_FLEET_SUMS} FROM sty GROUP BY style UNION ALL SELECT 'all', {_FLEET_SUMS} FROM sty"
)
def fleet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions together, by the way they worked and overall."""
    every = _styled(spark, sf_dir)
    return loads.fleet_report(every, ["style"]).unionByName(loads.fleet_report(every, []).withColumn("style", F.lit("all")))


@R.query(s.growth_verdict_sql + "SELECT string_split(verdict, ' ')[1] AS shape, count(*) AS sessions FROM gv GROUP BY 1")
def growth_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.shapes(growth.growth_verdict(s._turns(spark, sf_dir), S), [])


_LIBRARY = """WITH pa AS (SELECT *, p_name || '-' || p_size AS nm FROM part),
g AS (SELECT DISTINCT l_orderkey AS grp, CASE WHEN l_quantity > 48 THEN nm ELSE p_brand || ':' || nm END AS m FROM lineitem JOIN pa ON p_partkey = l_partkey),
w AS (SELECT a.m AS a, b.m AS b, count(*) AS weight FROM g a JOIN g b ON a.grp = b.grp AND a.m < b.m GROUP BY ALL),
d AS (SELECT DISTINCT least(nm, nx) AS a, greatest(nm, nx) AS b FROM (SELECT nm, lead(nm) OVER (PARTITION BY p_type, p_name ORDER BY p_partkey) AS nx FROM pa) WHERE nx IS NOT NULL AND nx <> nm),
dn AS (SELECT a AS n FROM d UNION SELECT b FROM d), o AS (SELECT DISTINCT m FROM g), ex AS (SELECT m FROM o WHERE m IN (SELECT n FROM dn)),
tw AS (SELECT m, split_part(m, ':', 2) AS n, count(*) OVER (PARTITION BY split_part(m, ':', 2)) AS c FROM o WHERE contains(m, ':') AND split_part(m, ':', 2) IN (SELECT n FROM dn) AND split_part(m, ':', 2) NOT IN (SELECT m FROM ex)),
rs AS (SELECT o.m AS observed_id, CASE WHEN ex.m IS NOT NULL THEN o.m WHEN c = 1 THEN tw.n END AS id, CASE WHEN ex.m IS NOT NULL THEN 'exact' WHEN tw.n IS NULL THEN 'none' WHEN c = 1 THEN 'suffix' ELSE 'ambiguous' END AS how
       FROM o LEFT JOIN tw USING (m) LEFT JOIN ex USING (m)),
jn AS (SELECT least(x, y) AS a, greatest(x, y) AS b, max(weight) AS weight FROM (SELECT coalesce(r.id, w.a) AS x, coalesce(q.id, w.b) AS y, weight FROM w JOIN rs r ON r.observed_id = w.a JOIN rs q ON q.observed_id = w.b) GROUP BY ALL)
"""


def _library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part").withColumn("nm", F.concat_ws("-", "p_name", F.col("p_size").cast("string")))
    full = F.when(F.col("l_quantity") > 48, F.col("nm")).otherwise(F.concat_ws(":", "p_brand", "nm"))
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", full.alias("skill"))
    following = F.lead("nm").over(Window.partitionBy("p_type", "p_name").orderBy("p_partkey"))
    declared = part.select(F.col("nm").alias("a"), following.alias("b")).where("b is not null and a <> b").distinct()
    return pairing.library_report(declared, pairs, "l_orderkey", "skill", parts=pairing.tasks(lines))


@R.query(_LIBRARY + "SELECT * FROM rs")
def library_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed names with a namespace and the declared names they belong to."""
    return _library(spark, sf_dir)["resolved"]


@R.query(
    _LIBRARY
    + """SELECT a, b, 'over_declared' AS verdict FROM d WHERE NOT EXISTS (SELECT 1 FROM jn WHERE jn.a = d.a AND jn.b = d.b)
UNION ALL SELECT a, b, 'consistent' FROM d JOIN jn USING (a, b)
UNION ALL SELECT a, b, 'implicit' FROM jn WHERE weight >= 2 AND NOT EXISTS (SELECT 1 FROM d WHERE jn.a = d.a AND jn.b = d.b)"""
)
def library_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared edges against what was loaded together, under the declared names."""
    return _library(spark, sf_dir)["diff"]


@R.query(
    """WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS prompt, l.n AS completion, CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice) AS BIGINT) ELSE 0 END AS cached
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) l ON l_orderkey = o_orderkey)
SELECT o_custkey, count(*) AS requests, coalesce(sum(prompt), 0)::BIGINT AS prompt_total, coalesce(sum(completion), 0)::BIGINT AS completion_total, coalesce(sum(cached), 0)::BIGINT AS cached_total,
       round(sum(cached) / nullif(sum(prompt), 0), 4) AS cached_share FROM o GROUP BY o_custkey"""
)
def billed_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("completion"))
    prompt = F.round("o_totalprice").cast("long")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", prompt.alias("prompt"), F.when(F.col("o_orderstatus") == "F", prompt).otherwise(0).alias("cached"))
    return billing.billed_block(o.join(lines, "o_orderkey", "left"), ["o_custkey"])
