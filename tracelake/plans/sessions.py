"""Queries over sessions: spans, liveness, loads, growth, repeats, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import asof, billing, growth, islands, liveness, loads, redundancy
from tracelake.plans.adapters import BUCKETS, RECORDS, S, boundaries, items, records
from tracelake.plans.registry import Registry
from tracelake.tables import table

R = Registry()


def _calls(r: DataFrame) -> DataFrame:
    return islands.spans(items(r), S, anchor="tokens")


def _gone(r: DataFrame) -> DataFrame:
    return liveness.gone_after(items(r), boundaries(r), S)


@R.query(RECORDS + "SELECT session, span_no, first_seq, last_seq, n_records FROM sp")
def spans_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.spans(items(records(spark, sf_dir)), S)


@R.query(RECORDS + "SELECT session, count(*) AS n_ungroupable FROM sp3 WHERE NOT in_span GROUP BY session")
def ungroupable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = islands.positional_spans(items(records(spark, sf_dir)), S)
    return rows.where("not in_span").groupBy("session").agg(F.count("*").alias("n_ungroupable"))


_RUNS = """, ar1 AS (SELECT *, CASE WHEN k % 5 <> 0 THEN k % 2 END AS a FROM it),
ar2 AS (SELECT * FROM ar1 WHERE kind = 'user' OR a IS NOT NULL),
ar3 AS (SELECT *, kind = 'user' OR coalesce(lag(kind) OVER w, 'user') = 'user' OR lag(a) OVER w <> a AS st FROM ar2 WINDOW w AS (PARTITION BY session ORDER BY seq)),
ar4 AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY session ORDER BY seq) AS run FROM ar3),
ar AS (SELECT session, CAST(run AS BIGINT) AS run, min(a) AS anchor, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_records, list(seq ORDER BY seq) AS seqs
       FROM ar4 WHERE kind <> 'user' GROUP BY session, run)
"""


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(records(spark, sf_dir)).withColumn("a", F.when(F.col("k") % 5 != 0, F.col("k") % 2))


@R.query(RECORDS + _RUNS + "SELECT session, run, anchor, first_seq, last_seq, n_records FROM ar")
def anchor_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.anchor_runs(_anchored(spark, sf_dir), S, "a").select("session", F.col("run").cast("long").alias("run"), "anchor", "first_seq", "last_seq", "n_records")


@R.query(
    RECORDS
    + _RUNS
    + """, own AS (SELECT session, min(seq) AS first_seq, list(seq ORDER BY seq) AS own_seqs FROM sp3 WHERE in_span GROUP BY session, grp)
SELECT session, count(*) AS checked, count(*) FILTER (own_seqs <> seqs) AS mismatched FROM own JOIN ar USING (session, first_seq) GROUP BY session"""
)
def span_run_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.verify_spans(_anchored(spark, sf_dir), S, "a")


@R.query(RECORDS + "SELECT session, seq, gone_seq FROM gi")
def gone_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gone(records(spark, sf_dir)).select("session", "seq", "gone_seq")


@R.query(
    RECORDS
    + """SELECT sp.session, span_no, first_seq, last_seq, n_records, min(nullif(anchor, 0) * 50) AS anchor,
  coalesce(sum(tokens) FILTER (event_type = 'signup'), 0)::BIGINT AS signup_tokens, coalesce(sum(tokens) FILTER (event_type = 'view'), 0)::BIGINT AS view_tokens,
  coalesce(sum(tokens) FILTER (event_type = 'click'), 0)::BIGINT AS click_tokens, coalesce(sum(tokens) FILTER (event_type = 'purchase'), 0)::BIGINT AS purchase_tokens,
  count(gi.seq) AS n_alive, min(nullif(anchor, 0) * 50) - coalesce(sum(tokens), 0)::BIGINT AS unattributed
FROM sp LEFT JOIN gi ON gi.session = sp.session AND gi.seq < first_seq AND (gone_seq IS NULL OR first_seq < gone_seq)
GROUP BY sp.session, span_no, first_seq, last_seq, n_records"""
)
def liveness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens alive in each request's context by bucket, and how much of the measured prompt they don't explain."""
    out = liveness.span_contexts(records(spark, sf_dir), S, BUCKETS, bucket="event_type")
    out = out.withColumn("anchor", F.nullif(F.col("anchor"), F.lit(0)) * 50)
    return out.withColumn("unattributed", F.col("anchor") - sum(F.col(f"{b}_tokens") for b in BUCKETS))


@R.query(
    RECORDS
    + """, c AS (SELECT sp.session, span_no, coalesce(sum(tokens) FILTER (event_type = 'view'), 0)::BIGINT AS view_tokens, coalesce(sum(tokens) FILTER (event_type = 'click'), 0)::BIGINT AS click_tokens, count(gi.seq) AS n_alive
FROM sp LEFT JOIN gi ON gi.session = sp.session AND gi.seq < first_seq AND (gone_seq IS NULL OR first_seq < gone_seq) GROUP BY sp.session, span_no)
SELECT * FROM c"""
)
def liveness_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by births and deaths, as it is for items that die each at a place of their own."""
    r = records(spark, sf_dir)
    out = liveness.alive_sums(_gone(r), _calls(r), S, ["view", "click"], bucket="event_type")
    return out.select("session", "span_no", "view_tokens", "click_tokens", "n_alive")


@R.query(
    RECORDS
    + """SELECT sp.session, span_no, count(*) AS n_refs, sum(gi.tokens)::BIGINT AS ref_tokens
FROM sp JOIN gi ON gi.session = sp.session AND gi.seq < first_seq AND (gone_seq IS NULL OR first_seq < gone_seq) GROUP BY ALL"""
)
def liveness_refs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    refs = liveness.alive_refs(_gone(r), _calls(r), S)
    return refs.groupBy("session", "span_no").agg(F.count("*").alias("n_refs"), F.sum("item_tokens").alias("ref_tokens"))


@R.query(RECORDS + "SELECT it.session, it.seq, (SELECT min(span_no) FROM sp WHERE sp.session = it.session AND sp.last_seq >= it.seq) AS span_no FROM it")
def call_for_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return asof.holding_or_next(items(r).select("session", "seq"), _calls(r), S, "seq", ["span_no"])


@R.query(
    RECORDS
    + """SELECT bo.session, bo.seq AS boundary_seq, count(x.seq) AS n_restored
FROM bo LEFT JOIN e x ON x.session = bo.session AND x.event_type = 'view' AND x.seq > bo.seq
  AND NOT EXISTS (SELECT 1 FROM e y WHERE y.session = bo.session AND y.seq > bo.seq AND y.seq < x.seq AND y.event_type IN ('click', 'purchase', 'error'))
GROUP BY ALL"""
)
def compaction_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return liveness.first_after_boundary(r.where("event_type = 'view'"), boundaries(r), r.where("event_type in ('click', 'purchase')"), S)


_LEDGER = """, en AS (SELECT session, seq, k % 10 AS skill, CASE event_type WHEN 'view' THEN 'stub' ELSE 'body' END AS kind, gone_seq
           FROM gi WHERE event_type IN ('view', 'click')),
en2 AS (SELECT *, lag(kind) OVER w AS bk, lag(seq) OVER w AS bs, lead(kind) OVER w AS ak,
               count(*) FILTER (kind = 'body') OVER (PARTITION BY session, skill ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier,
               (SELECT arg_max(coalesce(p.gone_seq, -1), p.seq) FROM en p WHERE p.session = en.session AND p.skill = en.skill AND p.kind = 'body' AND p.seq < en.seq) AS last_gone
        FROM en WINDOW w AS (PARTITION BY session, skill ORDER BY seq)),
en3 AS (SELECT *, CASE WHEN kind = 'stub' AND coalesce(ak, '') <> 'body' THEN 'unavailable'
                       WHEN kind = 'body' AND (bk = 'stub' OR earlier = 0) THEN 'load' WHEN kind = 'body' AND last_gone > 0 THEN 'reload' END AS load_kind,
               CASE WHEN kind = 'body' AND bk = 'stub' THEN bs ELSE seq END AS opened_seq FROM en2),
ledger AS (SELECT session, skill, load_kind, opened_seq, CASE WHEN kind = 'body' THEN seq END AS body_seq,
                  row_number() OVER (PARTITION BY session ORDER BY opened_seq, seq) AS load_no FROM en3 WHERE load_kind IS NOT NULL)
"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gone(records(spark, sf_dir)).where("event_type in ('view', 'click')")
    g = g.select("session", "seq", (F.col("k") % 10).alias("skill"), F.when(F.col("event_type") == "view", "stub").otherwise("body").alias("kind"), "gone_seq")
    return loads.load_ledger(g, S, "skill")


@R.query(RECORDS + _LEDGER + "SELECT * FROM ledger")
def load_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@R.query(
    RECORDS
    + _LEDGER
    + """SELECT session, count(*) AS n_loads, count(*) FILTER (load_kind = 'load') AS n_load, count(*) FILTER (load_kind = 'reload') AS n_reload,
  count(*) FILTER (load_kind = 'unavailable') AS n_unavailable FROM ledger GROUP BY session"""
)
def load_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.load_rollup(_ledger(spark, sf_dir), S)


_TURNS = """, tu AS (SELECT session, seq, us, row_number() OVER (PARTITION BY session ORDER BY seq) AS turn_no, lead(seq) OVER (PARTITION BY session ORDER BY seq) AS next_seq
           FROM e WHERE kind = 'user'),
st AS (SELECT * FROM e WHERE positive),
tc AS (SELECT tu.*, coalesce((SELECT arg_max(tokens, st.seq) FROM st WHERE st.session = tu.session AND st.seq <= tu.seq),
                             (SELECT arg_min(tokens, st.seq) FROM st WHERE st.session = tu.session)) AS context,
              EXISTS (SELECT 1 FROM bo WHERE bo.session = tu.session AND bo.seq > tu.seq AND bo.seq < tu.next_seq) AS crossed FROM tu),
tg AS (SELECT *, lead(context) OVER (PARTITION BY session ORDER BY turn_no) - context AS added FROM tc),
tr AS (SELECT session, seq, turn_no, context, crossed, added, coalesce(added >= 0 AND NOT crossed, false) AS comparable FROM tg)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the context at their beginning, and whether a boundary lies between them and the next."""
    r = records(spark, sf_dir)
    w = Window.partitionBy("session").orderBy("seq")
    t = r.where("kind = 'user'").select("session", "seq").withColumns({"turn_no": F.row_number().over(w).cast("long"), "next_seq": F.lead("seq").over(w)})
    measured = r.where("positive").select("session", "seq", F.col("tokens").alias("context"))
    t = asof.asof(t, measured, S, "seq", ["context"])
    first = measured.groupBy("session").agg(F.min_by("context", "seq").alias("_first"))
    t = t.join(first, "session", "left").withColumn("context", F.coalesce("context", "_first")).drop("_first")
    t = liveness.gone_after(t, boundaries(r).select("session", "seq"), S)
    t = t.withColumn("crossed", F.coalesce(F.col("gone_seq") < F.col("next_seq"), F.lit(False)))
    return growth.turn_growth(t.select("session", "seq", "turn_no", "context", "crossed"), S)


@R.query(RECORDS + _TURNS + "SELECT * FROM tr")
def turn_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir)


#: Common table gv: the verdict of each session.
growth_verdict_sql = (
    RECORDS
    + _TURNS
    + """, c AS (SELECT session, count(*) AS n, sum(turn_no)::DOUBLE AS sx, sum(added)::DOUBLE AS sy, sum(turn_no * added)::DOUBLE AS sxy, sum(turn_no * turn_no)::DOUBLE AS sxx
             FROM tr WHERE comparable GROUP BY session),
v AS (SELECT session, coalesce(n, 0) AS n_turns, CASE WHEN n >= 4 THEN round(CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0 END
        / CASE WHEN sy = 0 THEN 1 ELSE sy / n END, 6) END AS relative_slope FROM (SELECT DISTINCT session FROM tr) LEFT JOIN c USING (session)),
gv AS (SELECT *, CASE WHEN n_turns < 4 THEN 'insufficient data (' || n_turns || ' turns)' WHEN relative_slope > 0.2 THEN 'accelerating'
               WHEN relative_slope < -0.2 THEN 'sublinear' ELSE 'linear' END AS verdict FROM v)
"""
)


@R.query(growth_verdict_sql + "SELECT * FROM gv")
def growth_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.growth_verdict(_turns(spark, sf_dir), S)


@R.query(
    RECORDS
    + _TURNS
    + """, et AS (SELECT it.session, it.event_type, it.tokens, (SELECT max(turn_no) FROM tu WHERE tu.session = it.session AND tu.seq <= it.seq) AS turn_no FROM it),
b AS (SELECT et.session, event_type, sum(tokens)::BIGINT AS total FROM et JOIN tr ON tr.session = et.session AND tr.turn_no = et.turn_no AND comparable GROUP BY ALL)
SELECT session, event_type AS bucket, total AS bucket_tokens, round(total / sum(total) OVER (PARTITION BY session), 6) AS share FROM b"""
)
def bucket_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    own = asof.asof(items(records(spark, sf_dir)).select("session", "seq", "event_type", "tokens"), turns.select("session", "seq", "turn_no", "comparable"), S, "seq", ["turn_no", "comparable"])
    g = own.where("comparable").groupBy("session", F.col("event_type").alias("bucket")).agg(F.sum("tokens").alias("bucket_tokens"))
    return g.withColumn("share", F.round(F.col("bucket_tokens") / F.sum("bucket_tokens").over(Window.partitionBy("session")), 6))


@R.query(
    RECORDS
    + """SELECT v.session, v.seq, arg_min(p.seq, row(p.us, p.seq)) AS status_seq, arg_min(p.tokens, row(p.us, p.seq)) AS status_tokens
FROM e v LEFT JOIN e p ON p.session = v.session AND p.positive AND p.us >= v.us WHERE v.event_type = 'view' GROUP BY ALL"""
)
def status_asof_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first status at or after each load."""
    r = records(spark, sf_dir)
    status = r.where("positive").select("session", "us", "seq", F.col("seq").alias("status_seq"), F.col("tokens").alias("status_tokens"))
    return asof.asof(r.where("event_type = 'view'").select("session", "us", "seq"), status, S, "us", ["status_seq", "status_tokens"], "forward", ["seq"]).drop("us")


@R.query(
    RECORDS
    + "SELECT v.session, v.seq, min(bo.us) AS evicted_us FROM e v LEFT JOIN bo ON bo.session = v.session AND bo.us >= v.us WHERE v.event_type = 'view' GROUP BY ALL"
)
def evicted_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first boundary at or after each load."""
    r = records(spark, sf_dir)
    ends = boundaries(r).select("session", "us", F.col("us").alias("evicted_us"))
    return asof.asof(r.where("event_type = 'view'").select("session", "us", "seq"), ends, S, "us", ["evicted_us"], "forward").drop("us")


@R.query(
    RECORDS
    + """, tu AS (SELECT session, us, row_number() OVER (PARTITION BY session ORDER BY us, seq) AS turn_no, lead(us) OVER (PARTITION BY session ORDER BY us, seq) AS next_us FROM e WHERE kind = 'user'),
s AS (SELECT * FROM e WHERE positive),
o AS (SELECT tu.session, turn_no, arg_min(s.tokens, row(s.us, s.seq)) AS own FROM tu LEFT JOIN s ON s.session = tu.session AND s.us >= tu.us AND (next_us IS NULL OR s.us < next_us) GROUP BY ALL)
SELECT session, turn_no, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn_no ROWS UNBOUNDED PRECEDING),
  (SELECT arg_min(tokens, row(s.us, s.seq)) FROM s WHERE s.session = o.session), 0) AS context FROM o"""
)
def billing_turn_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    t = r.where("kind = 'user'").select("session", "us", F.row_number().over(Window.partitionBy("session").orderBy("us", "seq")).cast("long").alias("turn_no"))
    return billing.turn_contexts(t, r.where("positive"), S, ts="us", prompt="tokens", tie="seq").drop("us")


_HASHES = """, h1 AS (SELECT session, event_type, seq, k % 3 AS h, coalesce(lag(k % 3) OVER (PARTITION BY session, event_type ORDER BY seq) <> k % 3, true) AS st FROM it),
h2 AS (SELECT *, sum(CAST(st AS INT)) OVER (PARTITION BY session, event_type ORDER BY seq) AS run_no FROM h1),
hr AS (SELECT session, event_type, CAST(run_no AS BIGINT) AS run_no, min(h) AS h, count(*) AS n, min(seq) AS first, max(seq) AS last FROM h2 GROUP BY session, event_type, run_no)
"""


def _hash_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = items(records(spark, sf_dir)).withColumn("h", F.col("k") % 3)
    return islands.value_runs(r, ["session", "event_type"], "h", ["seq"]).withColumn("run_no", F.col("run_no").cast("long"))


@R.query(RECORDS + _HASHES + "SELECT * FROM hr")
def hash_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hash_runs(spark, sf_dir)


@R.query(RECORDS + _HASHES + "SELECT session, event_type, count(*) - 1 AS flips FROM hr GROUP BY ALL")
def hash_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands.flips(_hash_runs(spark, sf_dir), ["session", "event_type"])


_CLASSES = """, cw AS (SELECT session, us FROM bo WHERE tokens >= 12000),
oc1 AS (SELECT session, k, seq, us, event_type, nullif(event_type, 'signup') AS tool, tokens, row_number() OVER w AS occurrence, lag(us) OVER w AS pus, lag(nullif(event_type, 'signup')) OVER w AS pt
            FROM it WINDOW w AS (PARTITION BY session, k ORDER BY us, seq)),
oc AS (SELECT session, k, seq, event_type, tool, tokens, occurrence,
              CASE WHEN occurrence = 1 THEN NULL
                   WHEN EXISTS (SELECT 1 FROM cw WHERE cw.session = oc1.session AND cw.us < oc1.us AND cw.us > pus) THEN 'post_compaction'
                   WHEN us - pus <= 86400000000 AND tokens < 20000 AND pt = tool THEN 'poll'
                   WHEN EXISTS (SELECT 1 FROM cw WHERE cw.session = oc1.session) THEN 'no_compaction' ELSE 'unclassified' END AS class FROM oc1)
"""


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time runs 720 times as fast and sizes are ten times as large as in transcripts; the tool of a signup isn't known, and only
    boundaries of a large value are windows, so some sessions have none: every class occurs."""
    r = records(spark, sf_dir)
    tool = F.nullif(F.col("event_type"), F.lit("signup"))
    rows = items(r).select("session", "k", "seq", (F.col("us") / 720e6).alias("ts"), tool.alias("tool"), F.floor(F.col("tokens") / 10).alias("chars"), "tokens")
    b = r.where("kind = 'meta' and tokens >= 12000").select("session", (F.col("us") / 720e6).alias("window_start"), (F.col("us") / 720e6).alias("window_end"))
    return growth.classify_occurrences(rows, b, ["session", "k"])


@R.query(RECORDS + _CLASSES + "SELECT session, k, seq, occurrence, class FROM oc")
def classify_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).select("session", "k", "seq", "occurrence", "class")


@R.query(
    RECORDS
    + _CLASSES
    + """, g AS (SELECT session, k, count(*) AS n, (count(*) - 1) * arg_min(tokens, occurrence) AS extra_tokens,
  CASE WHEN count(DISTINCT coalesce(tool, '')) = 1 THEN min(tool) END AS tool FROM oc GROUP BY session, k HAVING count(*) > 1)
SELECT * FROM g ORDER BY extra_tokens DESC, session, k LIMIT 10"""
)
def repeats_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.repeats(_classed(spark, sf_dir), ["session", "k"]).orderBy(F.desc("extra_tokens"), "session", "k").limit(growth.TOP_REPEATS)


@R.query(RECORDS + _CLASSES + "SELECT session, class, count(*) AS n, sum(tokens)::BIGINT AS class_tokens FROM oc WHERE class IS NOT NULL GROUP BY ALL")
def repeat_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(spark, sf_dir).where("class is not null").groupBy("session", "class").agg(F.count("*").alias("n"), F.sum("tokens").alias("class_tokens"))


_SERIES = """WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS us, CAST(round(o_totalprice * 100) AS BIGINT) AS prompt, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS cached,
                  o_orderpriority FROM orders),
s AS (SELECT *, lag(prompt) OVER w AS prev_prompt, lag(us) OVER w AS prev_us FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY us, o_orderkey)),
t AS (SELECT * FROM s WHERE prev_prompt > 0 AND prompt < 0.75 * prev_prompt AND cached = 0)
"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracelake.plans.adapters import micros

    o = table(spark, sf_dir, "orders")
    s = o.select("o_custkey", "o_orderkey", micros(F.col("o_orderdate")).alias("us"), F.round(F.col("o_totalprice") * 100).cast("long").alias("prompt"),
                 F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("cached"), "o_orderpriority")
    return s.withColumn("prev_us", F.lag("us").over(Window.partitionBy("o_custkey").orderBy("us", "o_orderkey")))


@R.query(_SERIES + "SELECT o_custkey, o_orderkey, prompt, prev_prompt FROM t")
def sawtooth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return growth.sawtooth(_series(spark, sf_dir), ["o_custkey"], ["us", "o_orderkey"]).select("o_custkey", "o_orderkey", "prompt", "prev_prompt")


@R.query(
    _SERIES
    + """, w AS (SELECT o_custkey, prev_us AS window_start, us AS window_end, 'billed' AS s FROM t
UNION ALL SELECT o_custkey, prev_us, us, 'transcript' FROM s WHERE o_orderpriority = '1-URGENT' AND prev_us IS NOT NULL)
SELECT o_custkey, window_start, window_end, string_agg(DISTINCT s, '+' ORDER BY s DESC) AS source FROM w GROUP BY ALL"""
)
def compaction_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    shape = ["o_custkey", F.col("prev_us").alias("window_start"), F.col("us").alias("window_end")]
    billed = growth.sawtooth(s, ["o_custkey"], ["us", "o_orderkey"]).select(shape)
    return billing.merge_windows(s.where("o_orderpriority = '1-URGENT' and prev_us is not null").select(shape), billed, ["o_custkey"])


@R.query(
    RECORDS
    + """, u AS (SELECT session, coalesce(sum(tokens) FILTER (event_type = 'click'), 0)::BIGINT AS input_other, coalesce(sum(tokens) FILTER (event_type = 'view'), 0)::BIGINT AS cache_read,
  coalesce(sum(tokens) FILTER (event_type = 'signup'), 0)::BIGINT AS cache_creation, coalesce(sum(tokens) FILTER (event_type = 'purchase'), 0)::BIGINT AS output FROM e GROUP BY session)
SELECT *, round_even(cache_read / nullif(input_other + cache_read + cache_creation, 0), 4) AS cache_hit_rate FROM u"""
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda t: F.when(F.col("event_type") == t, F.col("tokens")).otherwise(0)
    return growth.usage_totals(records(spark, sf_dir), S, of("click"), of("view"), of("signup"), of("purchase"))


@R.query(
    RECORDS
    + """, rf AS (SELECT sp.session, first_seq, gi.seq, gi.tokens, row_number() OVER (PARTITION BY sp.session, gi.k ORDER BY first_seq, gi.seq) = 1 AS is_new
  FROM sp JOIN gi ON gi.session = sp.session AND gi.seq < first_seq AND (gone_seq IS NULL OR first_seq < gone_seq))
SELECT session, first_seq, coalesce(sum(tokens) FILTER (is_new), 0)::BIGINT AS new_tokens, coalesce(sum(tokens) FILTER (NOT is_new), 0)::BIGINT AS repeated_tokens FROM rf GROUP BY ALL"""
)
def new_vs_reinjected(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    refs = redundancy.new_and_repeated(liveness.alive_refs(_gone(r), _calls(r), S), S, "item_k", ["first_seq", "item_seq"])
    part = lambda new: F.coalesce(F.sum(F.when(F.col("is_new") == F.lit(new), F.col("item_tokens"))), F.lit(0))
    return refs.groupBy("session", "first_seq").agg(part(True).alias("new_tokens"), part(False).alias("repeated_tokens"))


@R.query(RECORDS + "SELECT session, k, count(*) AS n FROM e WHERE positive GROUP BY ALL HAVING count(*) >= 2")
def exact_resend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundancy.resends(records(spark, sf_dir).where("positive"), S, "k")


@R.query(
    RECORDS
    + """, a AS (SELECT session, k % 10 AS skill, event_type, tokens, seq, row_number() OVER (PARTITION BY session, k % 10, event_type, k ORDER BY seq) AS nth, k FROM e WHERE kind <> 'meta')
SELECT session, skill, count(*) FILTER (event_type = 'signup') AS listings, coalesce(sum(tokens) FILTER (event_type = 'signup'), 0)::BIGINT AS listing_tokens,
  coalesce(sum(tokens) FILTER (event_type = 'signup' AND nth > 1), 0)::BIGINT AS repeat_tokens, count(DISTINCT k) FILTER (event_type = 'signup') AS versions,
  count(*) FILTER (event_type = 'view') AS stubs, count(*) FILTER (event_type = 'click') AS bodies, count(*) FILTER (event_type = 'purchase') AS executions,
  coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type), '') AS channels, count(DISTINCT k) FILTER (event_type = 'click') > 1 AS version_drift FROM a GROUP BY ALL"""
)
def skill_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(records(spark, sf_dir)).withColumn("skill", F.col("k") % 10)
    role = {"signup": "listing", "view": "stub", "click": "body", "purchase": "execution"}
    rows = rows.replace(role, subset="event_type").withColumn("channel", F.col("event_type"))
    out = loads.observation_audit(rows, [*S, "skill"], kind="event_type", digest="k", tokens="tokens", channel="channel", order="seq")
    back = {v: k for k, v in role.items()}
    names = F.transform("channels", lambda c: F.element_at(F.create_map(*[F.lit(x) for p in back.items() for x in p]), c))
    return out.withColumn("channels", F.array_join(F.array_sort(names), ","))


_FLEET = """, p AS (SELECT session, count(*) FILTER (event_type = 'view') AS touches, count(*) FILTER (event_type = 'click' AND k < 50) AS loads,
  count(*) FILTER (event_type = 'signup') AS turns, count(*) FILTER (event_type = 'signup' AND k >= 10) AS signal, sum(tokens)::BIGINT AS total FROM e GROUP BY session),
ps AS (SELECT *, CASE WHEN touches > 12 AND loads > 6 THEN 'pipeline' WHEN touches <= 12 AND loads <= 6 THEN 'direct' ELSE 'mixed' END AS style FROM p)
"""


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session has a few of each kind, so counts above a floor stand for 'any'."""
    n = lambda c: F.count_if(F.expr(c))
    g = records(spark, sf_dir).groupBy("session").agg(
        n("event_type = 'view'").alias("touches"), n("event_type = 'click' and k < 50").alias("loads"), n("event_type = 'signup'").alias("turns"),
        n("event_type = 'signup' and k >= 10").alias("signal"), F.sum("tokens").alias("total"),
    )
    return g.withColumn("style", loads.process_style(F.col("touches") > 12, F.col("loads") > 6))


@R.query(RECORDS + _FLEET + "SELECT * FROM ps")
def process_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir)


@R.query(RECORDS + _FLEET + "SELECT style, count(*) AS sessions, round(sum(turns) / count(*), 1) AS avg_turns, sum(total)::BIGINT AS total, sum(signal)::BIGINT AS signal FROM ps GROUP BY style")
def fleet_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.fleet(_signatures(spark, sf_dir), ["style"])


@R.query(RECORDS + _FLEET + "SELECT count(*) AS sessions, round(sum(turns) / count(*), 1) AS avg_turns, sum(total)::BIGINT AS total, sum(signal)::BIGINT AS signal FROM ps")
def fleet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loads.fleet(_signatures(spark, sf_dir), [])


@R.query(
    RECORDS
    + """, g AS (SELECT session, sum(tokens) FILTER (event_type = 'view')::BIGINT AS context_growth, sum(tokens) FILTER (event_type = 'click')::BIGINT AS skill_load_cost, sum(tokens) FILTER (event_type = 'signup')::BIGINT AS ceremony,
  sum(tokens) FILTER (event_type = 'purchase')::BIGINT AS output FROM e GROUP BY session),
l AS (UNPIVOT (SELECT session, context_growth, skill_load_cost, ceremony, output FROM g) ON context_growth, skill_load_cost, ceremony, output INTO NAME row_name VALUE volume),
m AS (SELECT *, row_name IN ('context_growth', 'skill_load_cost') AS estimate FROM l)
SELECT session, row_name, volume, CASE WHEN estimate THEN round(volume / sum(volume) FILTER (estimate) OVER (PARTITION BY session), 6) END AS share,
  row_number() OVER (PARTITION BY session ORDER BY estimate DESC, CASE WHEN estimate THEN -volume ELSE 0 END, row_name) AS place FROM m"""
)
def bill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = {"context_growth": "view", "skill_load_cost": "click", "ceremony": "signup", "output": "purchase"}
    g = records(spark, sf_dir).groupBy("session").agg(*[F.sum(F.when(F.col("event_type") == t, F.col("tokens"))).alias(n) for n, t in of.items()])
    long = g.unpivot("session", list(of), "row_name", "volume").where("volume is not null")
    return billing.bill(long, S, estimates=["context_growth", "skill_load_cost"])
