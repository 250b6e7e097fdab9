"""Components, closures and depths over edge tables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's checkpoint folder. Where none is set, a temporary one in local mode; a cluster must name
    one that all its machines share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="tracelake-"))
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the least node reachable. Labels are lowered along edges, then along labels, until nothing changes."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    label = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("component")).withColumnRenamed("u", "node"))
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("c"))
        step = label.join(near, F.col("node") == F.col("u")).select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        up = label.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        step = cut(step.join(up, F.col("component") == F.col("n2"), "left").select("node", F.least("component", F.coalesce("c2", "component")).alias("component"), "was"))
        if step.where("component <> was").isEmpty():
            return step.select("node", "component")
        label = step.select("node", "component")


def closure(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", root: str = "root", depth: int = 4) -> DataFrame:
    """root, node, depth: nodes reached in at most ``depth`` steps, each at its least depth; the root itself at 0. Cycles end, as a
    node that is known is not walked again."""
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).distinct()
    found = roots.select(F.col(root).alias("root"), F.col(root).alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    last = found
    for d in range(1, depth + 1):
        step = last.join(e, F.col("node") == F.col("_s")).select("root", F.col("_d").alias("node")).distinct()
        last = cut(step.join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(d).cast("long")))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def parents_to_roots(parent: DataFrame, node: str = "node", up: str = "parent") -> DataFrame:
    """node, root, depth, cyclic, entry: where parent links lead, for any links at all.

    Of a tree, root and entry are its topmost node and depth is the way there; a parent that is no node itself ends the way before it.
    Nodes on a cycle (a node that is its own parent is one), and all that hangs on one, share its least node as root; entry is the
    first node of the cycle on the way up, depth the way to it. A node with several parents has the least; null nodes are left out.

    Links are doubled each round and carry the least node of the way they span. As long as a tree's node is open, each round closes some;
    if one closes none, all that are open go round, and once they have gone as far as there are of them, each has seen all of its cycle.
    So rounds grow with the logarithm of the longest way. Each ends in a reliable checkpoint."""
    links = parent.select(F.col(node).alias("node"), F.col(up).alias("up")).where("node is not null").groupBy("node").agg(F.min("up").alias("up"))
    nodes = links.select(F.col("node").alias("up"), F.lit(True).alias("_in"))
    links = cut(links.join(nodes, "up", "left").select("node", F.when(F.col("_in"), F.col("up")).alias("up")))
    ends, open_ = _doubled(links)
    found = ends.select("node", "root", "depth", F.lit(False).alias("cyclic"), F.col("root").alias("entry"))
    if open_ is None:
        return found
    ring = cut(open_.select(F.col("at").alias("node")).distinct().join(open_.select("node", F.col("least").alias("cycle")), "node"))
    tails = links.join(open_.select("node"), "node", "left_semi").join(ring.select("node", F.lit(True).alias("_on")), "node", "left")
    to_ring, _ = _doubled(cut(tails.select("node", F.when(F.col("_on").isNull(), F.col("up")).alias("up"))))
    round_ = to_ring.select("node", F.col("root").alias("entry"), "depth").join(ring.withColumnRenamed("node", "entry"), "entry")
    return found.unionByName(round_.select("node", F.col("cycle").alias("root"), "depth", F.lit(True).alias("cyclic"), "entry"))


def _doubled(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Nodes whose way ends, with root and depth; and those that go round, if there are any: at (a node on their cycle) and least (the
    least node of their way, which is the cycle's for nodes on it). links: node, up (a node, or null)."""
    top = F.col("up").isNull()
    p = cut(links.select("node", F.col("up").alias("at"), F.when(top, F.col("node")).alias("root"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), F.col("node").alias("least")))
    gone, before, left = 1, None, p.where("at is not null").count()
    while left and not (left == before and gone >= left):
        hop = p.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("least").alias("_least"))
        on = p.where("at is not null").drop("root").join(hop, "at").select("node", F.col("_at").alias("at"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.least("least", "_least").alias("least"))
        p = cut(p.where("at is null").unionByName(on))
        gone, before, left = 2 * gone, left, p.where("at is not null").count()
    ends = p.where("at is null").select("node", "root", "depth")
    return ends, p.where("at is not null") if left else None


def preorder(roots: DataFrame, edges: DataFrame, nodes: DataFrame, keys: Sequence[str], order: Sequence[str], depth: int = 12) -> DataFrame:
    """keys, path, node, depth, status: the rows of trees, which sorted by keys and path come in print order. roots: keys, node, and
    ``order``; edges: keys, src, dst, and ``order`` among the edges of a node; nodes: keys, node.

    path holds the places of a node and of those above it. status says why a row isn't gone on from: absent (the edge leads to no node),
    cycle (the node is on the row's own path) or capped (it lies ``depth`` below its root); else it is node. An edge is a row for each
    path that leads to it. There are ``depth`` rounds at most, each a join of the last level with the edges, and a checkpoint."""
    known = nodes.select(*keys, F.col("node").alias("_dst"), F.lit(True).alias("_known")).distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "src").orderBy(*order)).cast("long")
    numbered = cut(edges.withColumn("_place", place).select(*keys, F.col("src").alias("_src"), F.col("dst").alias("_dst"), "_place").join(known, [*keys, "_dst"], "left"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    level = cut(roots.select(*keys, F.array(first).alias("path"), "node", F.array("node").alias("_above"), F.lit(0).cast("long").alias("depth"), F.lit("node").alias("status")))
    out = level
    for d in range(1, depth + 1):
        step = level.where("status = 'node'").withColumnRenamed("node", "_src").join(numbered, [*keys, "_src"])
        status = F.when(F.col("_known").isNull(), "absent").when(F.array_contains("_above", F.col("_dst")), "cycle").otherwise("capped" if d == depth else "node")
        level = cut(step.select(*keys, F.concat("path", F.array("_place")).alias("path"), F.col("_dst").alias("node"), F.concat("_above", F.array("_dst")).alias("_above"), F.lit(d).cast("long").alias("depth"), status.alias("status")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("_above")
