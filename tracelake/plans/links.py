"""Queries over links: pairs, parents and children, identities, co-occurrence, closures, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators import graph, pairing, returns
from tracelake.plans.adapters import RECORDS, micros, records
from tracelake.plans.registry import Registry
from tracelake.tables import table

R = Registry()


@R.query(
    RECORDS
    + """, ca AS (SELECT session, k, seq FROM e WHERE event_type = 'click'), re AS (SELECT session, k, seq, tokens FROM e WHERE event_type = 'view')
SELECT 'paired' AS side, ca.session, ca.k, ca.seq, arg_max(re.seq, re.seq) AS result_seq FROM ca JOIN re USING (session, k) GROUP BY ALL
UNION ALL SELECT 'call', session, k, seq, NULL FROM ca WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.session = ca.session AND re.k = ca.k)
UNION ALL SELECT 'result', session, k, seq, NULL FROM re WHERE NOT EXISTS (SELECT 1 FROM ca WHERE re.session = ca.session AND re.k = ca.k)"""
)
def call_result_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    calls, results = r.where("event_type = 'click'").select("session", "k", "seq"), r.where("event_type = 'view'").select("session", "k", "seq")
    last = pairing.pair_last(calls, results.withColumn("result_seq", F.col("seq")), ["session", "k"], "seq", ["result_seq"])
    lone_calls, lone_results = pairing.unpaired(calls, results, ["session", "k"])
    side = lambda d, s: d.withColumn("side", F.lit(s))
    paired = side(last.where("result_seq is not null"), "paired")
    return paired.unionByName(side(lone_calls, "call"), allowMissingColumns=True).unionByName(side(lone_results, "result"), allowMissingColumns=True)


_DAYS = """WITH o AS (SELECT epoch_us(o_orderdate) // 86400000000 AS ck, o_orderkey FROM orders), c AS (SELECT DISTINCT epoch_us(l_shipdate) // 86400000000 AS ck FROM lineitem)
"""


def _days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Days of orders, with the orders, and days on which something was shipped: either side has some without the other."""
    day = lambda c: F.floor(micros(F.col(c)) / 86_400_000_000).cast("long").alias("ck")
    return table(spark, sf_dir, "orders").select(day("o_orderdate"), "o_orderkey"), table(spark, sf_dir, "lineitem").select(day("l_shipdate")).distinct()


def _dispatch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders are calls, known by their day; days of shipping are the children."""
    return pairing.link_children(*_days(spark, sf_dir), "ck", "o_orderkey")


@R.query(_DAYS + "SELECT ck, min(o_orderkey) AS o_orderkey FROM o JOIN c USING (ck) GROUP BY ck")
def dispatch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A child belongs to the first call of its key."""
    return _dispatch(spark, sf_dir)[0]


@R.query(_DAYS + "SELECT * FROM o WHERE ck NOT IN (SELECT ck FROM c)")
def orphan_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatch(spark, sf_dir)[1]


@R.query(_DAYS + "SELECT * FROM c WHERE ck NOT IN (SELECT ck FROM o)")
def unmatched_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dispatch(spark, sf_dir)[2]


@R.query(
    """WITH w AS (SELECT l_orderkey AS k, l_linenumber AS seq, CAST(round(l_quantity * 100) AS BIGINT) AS tokens, l_suppkey % 7 AS digest FROM lineitem),
b AS (SELECT k, arg_min(tokens, row(seq, digest, tokens)) AS return_tokens, arg_min(digest, row(seq, digest, tokens)) AS d FROM w WHERE seq <= 2 GROUP BY k),
p AS (SELECT k, sum(tokens)::BIGINT AS process_tokens FROM w WHERE seq > 2 GROUP BY k),
j AS (SELECT o_orderkey AS k, process_tokens, return_tokens, EXISTS (SELECT 1 FROM w WHERE w.k = o_orderkey AND w.seq > 2 AND w.digest = d) AS echo
      FROM orders LEFT JOIN b ON b.k = o_orderkey LEFT JOIN p ON p.k = o_orderkey)
SELECT *, round_even(return_tokens / process_tokens, 4) AS ratio,
  concat_ws(',', CASE WHEN process_tokens IS NULL THEN 'process_unavailable' END, CASE WHEN return_tokens >= 2000 THEN 'bloated' END, CASE WHEN echo THEN 'echo' END) AS flags FROM j"""
)
def subagent_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(F.col("l_quantity") * 100).cast("long").alias("tokens"), (F.col("l_suppkey") % 7).alias("digest"))
    w = w.withColumn("seq", F.struct("n", "digest", "tokens"))
    return returns.subagent_returns(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), w.where("n <= 2"), w.where("n > 2"), "k")


_CO = """WITH p AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS m FROM lineitem),
w AS (SELECT x.m AS a, y.m AS b, count(*) AS weight FROM p x JOIN p y ON x.g = y.g AND x.m < y.m GROUP BY ALL)
"""


def _co_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return pairing.co_load_edges(lines, "l_orderkey", "l_partkey", pairing.tasks(lines))


@R.query(_CO + "SELECT * FROM w")
def co_load_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order holds a few parts: pairs within it are few."""
    return _co_load(spark, sf_dir)


@R.query(
    """WITH p AS (SELECT DISTINCT o_custkey AS session, o_orderkey AS g, l_partkey AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
w AS (SELECT x.session, x.m AS a, y.m AS b, count(*) AS weight, string_agg(CAST(x.g AS VARCHAR), ',' ORDER BY x.g) AS groups FROM p x JOIN p y ON x.session = y.session AND x.g = y.g AND x.m < y.m GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY session ORDER BY weight DESC, a, b) AS place FROM w"""
)
def co_load_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a customer's orders hold together, with the orders, the most frequent pair first."""
    lines = table(spark, sf_dir, "lineitem")
    n = pairing.tasks(lines)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("session"))
    dealt = lambda d: d.repartition(n, "l_orderkey")
    pairs = dealt(lines.select("l_orderkey", "l_partkey")).join(dealt(o), "l_orderkey")
    found = pairing.co_load_groups(pairs, ["session"], "l_orderkey", "l_partkey", n)
    return found.withColumn("groups", F.array_join(F.col("groups").cast("array<string>"), ","))


@R.query(
    _CO
    + """, de AS (SELECT p_partkey AS a, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
d AS (SELECT * FROM de WHERE b IS NOT NULL)
SELECT a, b, 'over_declared' AS verdict FROM d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = d.a AND w.b = d.b)
UNION ALL SELECT a, b, 'consistent' FROM d JOIN w USING (a, b)
UNION ALL SELECT a, b, 'implicit' FROM w WHERE weight >= 2 AND NOT EXISTS (SELECT 1 FROM d WHERE w.a = d.a AND w.b = d.b)"""
)
def diff_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    following = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    declared = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), following.alias("b")).where("b is not null")
    return pairing.diff_edges(declared, _co_load(spark, sf_dir))


_IDS = """WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id IN (SELECT page_id FROM pages) AS listed FROM documents
UNION ALL SELECT source || ':' || doc_id, true FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT lang || ':' || doc_id, true FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
f AS (SELECT split_part(id, ':', 2) AS suffix, min(id) AS full_id, count(*) AS n FROM (SELECT DISTINCT id FROM i) WHERE contains(id, ':') GROUP BY 1)
"""


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by bare numbers, listed if a page has the number; by source if they have a label; by language if they have a vector."""
    d = table(spark, sf_dir, "documents")
    of = lambda name, c: d.join(table(spark, sf_dir, name).select(F.col(c).alias("doc_id")), "doc_id", "left_semi")
    known = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).distinct().withColumn("listed", F.lit(True))
    bare = d.join(known, "doc_id", "left").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("listed", F.lit(False)).alias("listed"))
    spaced = lambda c, rows: rows.select(F.concat_ws(":", c, F.col("doc_id").cast("string")).alias("id"), F.lit(True).alias("listed"))
    return bare.unionByName(spaced("source", of("labels", "doc_id"))).unionByName(spaced("lang", of("embeddings", "vec_id")))


@R.query(_IDS + "SELECT id AS raw_id, CASE WHEN NOT contains(id, ':') AND NOT listed AND n = 1 THEN full_id ELSE id END AS id FROM i LEFT JOIN f ON suffix = id")
def identity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.merge_by_suffix(_ids(spark, sf_dir))


@R.query(
    _IDS
    + """, d AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM documents), o AS (SELECT DISTINCT id FROM i WHERE contains(id, ':') UNION SELECT CAST(conv_id AS VARCHAR) FROM conversations),
t AS (SELECT split_part(id, ':', 2) AS suffix, min(id) AS twin, count(*) AS n FROM o WHERE contains(id, ':') GROUP BY 1)
SELECT d.id, coalesce(o.id, CASE WHEN n = 1 THEN twin END) AS observed_id, CASE WHEN o.id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how
FROM d LEFT JOIN o ON o.id = d.id LEFT JOIN t ON t.suffix = d.id"""
)
def declared_observed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are declared by number; what is observed are their spaced names and the numbers of conversations."""
    bare = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"))
    observed = _ids(spark, sf_dir).where(F.contains("id", F.lit(":"))).select("id").unionByName(bare)
    declared = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return pairing.match_declared(declared, observed)


_SETS = """WITH l AS (SELECT DISTINCT doc_id AS id FROM labels), o AS (SELECT DISTINCT doc_id AS id FROM documents WHERE lang = 'en'), x AS (SELECT DISTINCT doc_id AS id FROM documents WHERE n_chars > 1000),
a AS (SELECT id FROM l UNION SELECT id FROM o UNION SELECT id FROM x)
"""


@R.query(
    _SETS
    + """SELECT CASE WHEN id IN (SELECT id FROM o) AND id IN (SELECT id FROM x) THEN 'used' WHEN id IN (SELECT id FROM o) THEN 'loaded_unused' WHEN id IN (SELECT id FROM x) AND id IN (SELECT id FROM l) THEN 'missed'
  WHEN id IN (SELECT id FROM l) THEN 'listed_unloaded' ELSE 'unlisted' END AS status, count(*) AS n FROM a GROUP BY 1"""
)
def gap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all that is listed, loaded or executed: what belongs to which gap."""
    d = table(spark, sf_dir, "documents")
    listed, loaded, executed = table(spark, sf_dir, "labels").select("doc_id"), d.where("lang = 'en'").select("doc_id"), d.where("n_chars > 1000").select("doc_id")
    return pairing.gaps(listed, loaded, executed, "doc_id").groupBy("status").agg(F.count("*").alias("n"))


@R.query(
    """WITH d AS (SELECT doc_id, max(n_chars) AS c FROM documents GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN c > 500 THEN 'loaded' ELSE 'file-read' END AS status FROM labels l LEFT JOIN d USING (doc_id)"""
)
def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return pairing.expected(table(spark, sf_dir, "labels").select("doc_id"), d.where("n_chars > 500").select("doc_id"), d.select("doc_id"), "doc_id")


@R.query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS s, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS d FROM part
  UNION SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_type ORDER BY p_partkey DESC) FROM part),
r AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS depth FROM part UNION SELECT r.root, n.d, r.depth + 1 FROM r JOIN n ON n.s = r.node AND n.d IS NOT NULL WHERE r.depth < 4)
SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY ALL"""
)
def closure_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part requires the next of its brand and size, and the one before of its type; what it requires within four steps."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    step = lambda w: p.select(key.alias("src"), F.lead("p_partkey").over(w).alias("dst")).where("dst is not null")
    e = step(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")).unionByName(step(Window.partitionBy("p_type").orderBy(F.desc("p_partkey"))))
    return graph.closure(e, p.select(key.alias("src")), root="src")


@R.query(
    """WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey AS root, 0 AS depth FROM customer WHERE c_custkey < 3
UNION ALL SELECT c.c_custkey, t.root, t.depth + 1 FROM customer c JOIN t ON c.c_custkey // 3 = t.node AND c.c_custkey >= 3)
SELECT node, root, CAST(depth AS BIGINT) AS depth FROM t"""
)
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    links = table(spark, sf_dir, "customer").select(c.alias("node"), F.when(c >= 3, F.floor(c / 3)).cast("long").alias("parent"))
    return graph.parents_to_roots(links).select("node", "root", "depth")


@R.query(
    """WITH RECURSIVE n AS (SELECT c_custkey AS node, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS up FROM customer),
e AS (SELECT a.node, b.node AS up FROM n a LEFT JOIN n b ON a.up = b.node),
w AS (SELECT node, [node] AS path, up AS next FROM e
      UNION ALL SELECT w.node, list_append(w.path, w.next), e.up FROM w JOIN e ON e.node = w.next WHERE NOT list_contains(w.path, w.next)),
f AS (SELECT node, path, next, list_position(path, next) AS pos FROM w WHERE next IS NULL OR list_contains(path, next))
SELECT node, CASE WHEN next IS NULL THEN path[len(path)] ELSE list_min(list_slice(path, pos, len(path))) END AS root, CAST(CASE WHEN next IS NULL THEN len(path) ELSE pos END - 1 AS BIGINT) AS depth,
       next IS NOT NULL AS cyclic, CASE WHEN next IS NULL THEN path[len(path)] ELSE next END AS entry FROM f"""
)
def cycle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who point at the customer whose key their balance names: trees, cycles with tails, and keys that don't exist."""
    b = F.col("c_acctbal")
    return graph.parents_to_roots(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(b >= 0, F.floor(b)).cast("long").alias("parent")))


@R.query(
    """WITH RECURSIVE c AS (SELECT c_custkey AS node, c_nationkey AS k, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS up FROM customer),
n AS (SELECT k, node FROM c), e AS (SELECT k, up AS src, node AS dst, row_number() OVER (PARTITION BY k, up ORDER BY node) AS place FROM c WHERE up IS NOT NULL),
r AS (SELECT k, node, row_number() OVER (PARTITION BY k ORDER BY node) AS place FROM c a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.k = a.k AND n.node = a.up)),
t AS (SELECT k, [place] AS path, node, [node] AS above, 0 AS depth, 'node' AS status FROM r
      UNION ALL SELECT t.k, list_append(path, e.place), e.dst, list_append(above, e.dst), depth + 1, CASE WHEN list_contains(above, e.dst) THEN 'cycle' WHEN depth + 1 = 3 THEN 'capped' ELSE 'node' END
      FROM t JOIN e ON e.k = t.k AND e.src = t.node WHERE status = 'node' AND depth < 3)
SELECT CAST(k AS BIGINT) AS k, array_to_string(path, '.') AS path, node, CAST(depth AS BIGINT) AS depth, status FROM t"""
)
def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of the customers of a nation, each below the one that its balance names, in print order and three deep."""
    b = F.col("c_acctbal")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("node"), F.when(b >= 0, F.floor(b)).cast("long").alias("up"))
    nodes = c.select("k", "node")
    roots = c.join(nodes.withColumnRenamed("node", "up"), ["k", "up"], "left_anti").select("k", "node", F.col("node").alias("at"))
    edges = c.where("up is not null").select("k", F.col("up").alias("src"), F.col("node").alias("dst"), F.col("node").alias("at"))
    found = graph.preorder(roots, edges, nodes, ["k"], ["at"], 3)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "."))


@R.query(
    """WITH RECURSIVE n AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'user'),
t AS (SELECT conv_id, turn, turn AS root FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE p.conv_id = n.conv_id AND p.turn = n.turn - 1)
UNION ALL SELECT n.conv_id, n.turn, t.root FROM n JOIN t ON t.conv_id = n.conv_id AND t.turn = n.turn - 1)
SELECT conv_id, turn, root AS root_turn FROM t"""
)
def sidechain_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topmost ancestor that is still off the main chain."""
    side = table(spark, sf_dir, "conversations").where("role <> 'user'").select("conv_id", "turn").distinct()
    key = F.struct("conv_id", "turn")
    up = side.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("p"))
    chain = side.join(up, ["conv_id", "turn"], "left").select(key.alias("node"), F.when(F.col("p").isNotNull(), F.struct("conv_id", F.col("p").alias("turn"))).alias("parent"))
    return graph.parents_to_roots(chain).select("node.conv_id", "node.turn", F.col("root.turn").alias("root_turn"))


@R.query(
    """WITH o AS (SELECT o_custkey AS agent, count(*) AS attachments, sum(CAST(round(o_totalprice) AS BIGINT))::BIGINT AS total FROM orders GROUP BY o_custkey)
SELECT CAST(n_nationkey AS BIGINT) AS parent, count(c_custkey) AS agents, coalesce(sum(attachments), 0)::BIGINT AS attachments, coalesce(sum(total), 0)::BIGINT AS total, count(*) FILTER (c_custkey IS NOT NULL AND attachments IS NULL) AS loose
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN o ON agent = c_custkey GROUP BY n_nationkey"""
)
def agent_tree_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node its agents, what is attached to them, and agents with nothing attached."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice").cast("long")).alias("t"))
    c = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey"))
    c = c.agg(F.count("*").alias("agents"), F.sum("n").alias("attachments"), F.sum("t").alias("total"), F.count_if(F.col("n").isNull()).alias("loose"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("parent"), *[zero(x) for x in ("agents", "attachments", "total", "loose")])


@R.query(_DAYS + "SELECT ck AS id FROM o UNION SELECT ck FROM c")
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _days(spark, sf_dir)
    return o.select(F.col("ck").alias("id")).union(c).distinct()


@R.query(_DAYS + "SELECT ck AS id FROM o EXCEPT SELECT ck FROM c")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _days(spark, sf_dir)
    return o.select(F.col("ck").alias("id")).distinct().join(c.withColumnRenamed("ck", "id"), "id", "left_anti")
