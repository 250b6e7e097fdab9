"""Calls and results, parents and children, identities by suffix, declared and observed edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_last(calls: DataFrame, results: DataFrame, keys: Sequence[str], order: str, take: Sequence[str]) -> DataFrame:
    """``calls`` with ``take`` of the last result of their keys, null if there is none."""
    last = results.groupBy(*keys).agg(F.max_by(F.struct(*take), order).alias("_last"))
    return calls.join(last, list(keys), "left").select(*calls.columns, *[F.col(f"_last.{t}").alias(t) for t in take])


def unpaired(calls: DataFrame, results: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Calls without a result and results without a call; a null key is never paired."""
    ids = lambda d: d.select(*keys).dropna().distinct()
    return calls.join(ids(results), list(keys), "left_anti"), results.join(ids(calls), list(keys), "left_anti")


def link_children(parents: DataFrame, children: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links by the first parent row of each key; parents without a child; children without a parent."""
    w = Window.partitionBy(key).orderBy(order)
    first = parents.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    keyed = children.where(F.col(key).isNotNull())
    return first.join(keyed, key), parents.join(keyed.select(key).distinct(), key, "left_anti"), children.join(first.select(key), key, "left_anti")


def merge_by_suffix(ids: DataFrame, name: str = "id", listed: str = "listed", within: Sequence[str] = ()) -> DataFrame:
    """raw_id and id: a bare id (without ``:``) that has no listing of its own takes the id ``space:bare`` if that is the only
    one of its suffix. An equi-join on the suffix, within groups if asked for."""
    spaced = ids.where(F.col(name).contains(":")).select(*within, F.col(name).alias("_full"), F.substring_index(F.col(name), ":", -1).alias("_suffix")).distinct()
    only = spaced.groupBy(*within, "_suffix").agg(F.min("_full").alias("_full"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    bare = ids.withColumn("_suffix", F.when(~F.col(name).contains(":") & ~F.col(listed), F.col(name)))
    j = bare.join(only, [*within, "_suffix"], "left")
    return j.select(*within, F.col(name).alias("raw_id"), F.coalesce("_full", name).alias("id"))


def match_declared(declared: DataFrame, observed: DataFrame, name: str = "id") -> DataFrame:
    """id (declared), observed_id, how: exact (case folded), suffix (the only twin), ambiguous or none."""
    fold = lambda c: F.lower(F.upper(c))
    d = declared.select(F.col(name).alias("id"), fold(F.col(name)).alias("_key")).distinct()
    o = observed.select(F.col(name).alias("observed_id"), fold(F.col(name)).alias("_fold")).distinct()
    exact = o.groupBy("_fold").agg(F.min("observed_id").alias("_exact"))
    twin = o.where(F.col("_fold").contains(":")).groupBy(F.substring_index("_fold", ":", -1).alias("_suffix")).agg(F.min("observed_id").alias("_twin"), F.count("*").alias("_twins"))
    j = d.join(exact, F.col("_key") == F.col("_fold"), "left").join(twin, F.col("_key") == F.col("_suffix"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_twins") == 1, "suffix").when(F.col("_twins") > 1, "ambiguous").otherwise("none")
    return j.select("id", F.coalesce("_exact", F.when(F.col("_twins") == 1, F.col("_twin"))).alias("observed_id"), how.alias("how"))


#: Pairs of a group and a member to a task, so that what a task holds doesn't grow with the input.
ROWS = 1 << 18
#: Classes of groups to a task: members that meet in several of its groups leave it once for each class.
CLASSES = 8


def tasks(rows: DataFrame) -> int:
    """How many tasks take ROWS rows each. Counts them, which for a table needs no more than its footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def _met(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _g, a < b: any two members that a group holds. Groups are put together where they lie, if dealt by ``keys``."""
    held = pairs.groupBy(*keys, "_g").agg(F.array_sort(F.collect_set("_m")).alias("_ms"))
    each = held.select(*keys, "_g", "_ms", F.posexplode("_ms").alias("_at", "a"))
    return each.select(*keys, "_g", "a", F.explode(F.slice("_ms", F.col("_at") + 2, F.size("_ms"))).alias("b"))


def co_load_edges(pairs: DataFrame, group: str, member: str, parts: int | None = None) -> DataFrame:
    """a < b, weight: in how many groups two distinct members meet. Groups are dealt once; their pairs are counted before and after a
    second shuffle. ``parts`` tasks take part in each, by default as many as the rows need."""
    p = pairs.select(F.col(group).alias("_g"), F.col(member).alias("_m")).where("_g is not null and _m is not null")
    n = parts or tasks(p)
    p = p.withColumn("_class", F.pmod(F.xxhash64("_g"), F.lit(CLASSES * n))).repartition(n, "_class")
    some = _met(p, ["_class"]).groupBy("_class", "a", "b").agg(F.count("*").alias("_n")).drop("_class")
    return some.repartition(n, "a", "b").groupBy("a", "b").agg(F.sum("_n").alias("weight"))


def co_load_groups(pairs: DataFrame, keys: Sequence[str], group: str, member: str, parts: int | None = None) -> DataFrame:
    """keys, a < b, weight, groups (sorted) and place (from 1, the heaviest edge first, then by a and b): which groups hold two members
    together, within each of ``keys``. An edge lists the groups of one session, say, so its list is bounded by that. One shuffle, to
    ``parts`` tasks, by default as many as the rows need."""
    p = pairs.select(*keys, F.col(group).alias("_g"), F.col(member).alias("_m")).dropna()
    p = p.repartition(parts or tasks(p), *(keys or ["_g"]))
    both = _met(p, keys).groupBy(*keys, "a", "b").agg(F.array_sort(F.collect_list("_g")).alias("groups"))
    both = both.withColumn("weight", F.size("groups").cast("long"))
    heaviest = Window.partitionBy(*keys).orderBy(F.desc("weight"), "a", "b")
    return both.withColumn("place", F.row_number().over(heaviest).cast("long")).select(*keys, "a", "b", "weight", "groups", "place")


def diff_edges(declared: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """a, b, verdict: over_declared (never met), implicit (met ``least`` times, undeclared) or consistent."""
    d = declared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("_d", F.lit(True))
    # one join of all edges: each kind by a join of its own would make the edges anew
    both = d.join(edges.select("a", "b", "weight", F.lit(True).alias("_e")), ["a", "b"], "full")
    known, met = F.col("_d").isNotNull(), F.col("_e").isNotNull()
    verdict = F.when(known & met, "consistent").when(known, "over_declared").when(F.col("weight") >= least, "implicit")
    return both.select("a", "b", verdict.alias("verdict")).where("verdict is not null")


def gaps(listed: DataFrame, loaded: DataFrame, executed: DataFrame, name: str) -> DataFrame:
    """name, status of everything met: used, loaded_unused, missed (executed and listed, never loaded), listed_unloaded, unlisted."""
    mark = lambda d, m: d.select(name).distinct().withColumn("_m", F.lit(m))
    g = mark(listed, "l").unionByName(mark(loaded, "o")).unionByName(mark(executed, "x")).groupBy(name).agg(F.collect_set("_m").alias("_in"))
    has = lambda m: F.array_contains("_in", m)
    status = (
        F.when(has("o") & has("x"), "used").when(has("o"), "loaded_unused").when(has("x") & has("l"), "missed").when(has("l"), "listed_unloaded").otherwise("unlisted")
    )
    return g.select(name, status.alias("status"))


def expected(names: DataFrame, loads: DataFrame, reads: DataFrame, name: str) -> DataFrame:
    """``names`` with status: loaded, file-read or missing."""
    mark = lambda d, c: d.select(name).distinct().withColumn(c, F.lit(True))
    j = names.join(mark(loads, "_l"), name, "left").join(mark(reads, "_r"), name, "left")
    return j.withColumn("status", F.when(F.col("_l"), "loaded").when(F.col("_r"), "file-read").otherwise("missing")).drop("_l", "_r")


def resolve_observed(declared: DataFrame, observed: DataFrame, name: str = "id") -> DataFrame:
    """observed_id, id, how: the declared name that an observed id belongs to. exact: equal but for case; suffix: its only twin
    ``space:name`` where the name itself wasn't observed; ambiguous: one of several such twins; none: anything else."""
    fold = lambda c: F.lower(F.upper(c))
    d = declared.groupBy(fold(F.col(name)).alias("_key")).agg(F.min(name).alias("_name"))
    o = observed.select(F.col(name).alias("observed_id"), fold(F.col(name)).alias("_fold")).distinct()
    exact = o.join(d, F.col("_fold") == F.col("_key"), "left").select("observed_id", "_fold", F.col("_name").alias("_exact"))
    plain = exact.where("_exact is not null").select(F.col("_fold").alias("_suffix"), F.lit(True).alias("_plain")).distinct()
    twins = exact.where("_exact is null and contains(_fold, ':')").withColumn("_suffix", F.substring_index("_fold", ":", -1))
    twins = twins.join(d.select(F.col("_key").alias("_suffix"), "_name"), "_suffix").join(plain, "_suffix", "left")
    twins = twins.withColumn("_n", F.count("*").over(Window.partitionBy("_suffix"))).select("observed_id", F.col("_name").alias("_twin"), (F.col("_n") == 1).alias("_only"), "_plain")
    j = exact.join(twins, "observed_id", "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_twin").isNull() | F.col("_plain"), "none").when(F.col("_only"), "suffix").otherwise("ambiguous")
    return j.select("observed_id", F.coalesce("_exact", F.when(how == "suffix", F.col("_twin"))).alias("id"), how.alias("how"))


def rename_edges(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges a < b with the names that observed ids belong to; ids that belong to none stay as they are."""
    names = resolved.where("id is not null").select("observed_id", "id")
    of = lambda c: names.select(F.col("observed_id").alias(c), F.col("id").alias(f"_{c}"))
    j = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"_a": F.coalesce("_a", "a"), "_b": F.coalesce("_b", "b")})
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return j.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), *rest)


def library_report(declared: DataFrame, pairs: DataFrame, group: str, member: str, least: int = 2, names: DataFrame | None = None, parts: int | None = None) -> dict[str, DataFrame]:
    """edges (what groups loaded together), resolved (observed ids and the declared names they belong to), and diff of declared
    edges (a, b) with the observed ones under their declared names. Declared names are ``names`` (id), else those of the edges."""
    ends = declared.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    resolved = resolve_observed(ends if names is None else names, pairs.select(F.col(member).alias("id")).where("id is not null"))
    named = resolved.select("observed_id", F.coalesce("id", "observed_id").alias("name")).join(ends.select(F.col("id").alias("name"), F.lit(True).alias("end")), "name", "left")
    # members bring along another name and whether a declared edge ends there, so that of what met once little is shuffled again
    label = F.struct("observed_id", F.nullif("name", "observed_id").alias("name"), "end").alias("_label")
    labelled = pairs.select(F.col(group).alias("_group"), F.col(member).alias("observed_id")).join(named, "observed_id").select("_group", label)
    some = co_load_edges(labelled, "_group", "_label", parts)
    some = some.where((F.col("weight") >= least) | (F.col("a.end") & F.col("b.end")))
    x, y = (F.coalesce(f"{c}.name", f"{c}.observed_id") for c in ("a", "b"))
    joined = some.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "weight").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return {"edges": co_load_edges(pairs, group, member, parts), "resolved": resolved, "diff": diff_edges(declared.where("a <> b"), joined, least)}
