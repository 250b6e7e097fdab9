"""URL filters: a sort-merge range join of urls and host-and-path rules.

A rule is (host, path, verdict). It fits a url whose host is the rule's or one of its subdomains and whose path begins
with the rule's path. Hosts are turned into canonical keys (``m.example.org`` becomes ``org.example.m.``), so that a rule
host and all its subdomains fill one interval of the key order. Both sides are dealt into key ranges, sorted there, and
swept once; the sweep holds a stack of the rule hosts whose intervals are open.

Dealing: range bounds come from a bounded sample of (key, path, salt) of the urls. They decide only where the cuts lie. As
path and a salt follow the key, one host, or one url, that holds a third of all rows still spreads over many ranges. A rule goes to each range that its interval meets: the copies number at most the rules plus the ranges times the
nesting depth.

Defined cases. Null url or no ``://``: host and path are empty, only the default verdict. Equal fits: the longest
``host + path`` wins, then the longer host, then the alphabetically lower verdict. Repeated rows are judged each.
A rule with a null host or path fits nothing. No rules or no urls: each url gets the default, or the result is empty.
Other columns of the input aren't read, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, shuffle_width

#: Rows of the bounded sample that places the range bounds.
BOUND_SAMPLE = 8192
#: Above every character that a key holds.
_TOP = "\U0010ffff"
_OUT = "id long, host string, path string, rule string, verdict string"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    """``a.b.c`` as ``c.b.a.``: a host and its subdomains share a prefix that ends at a label."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _bounds(urls: DataFrame, parts: int) -> list[tuple[str, str, int]]:
    """parts - 1 cuts of (key, path, salt) from a bounded sample, the same at each run: of each of BOUND_SAMPLE classes of salts the
    row with the least one. Salts are numbers, so tasks send a hash table of them at most, and urls travel for chosen ones alone."""
    chosen = urls.groupBy(F.col("salt").bitwiseAND(F.lit(BOUND_SAMPLE - 1)).alias("class")).agg(F.min("salt").alias("salt")).select("salt")
    sample = urls.select("key", "path", "salt").join(F.broadcast(chosen), "salt", "left_semi").distinct().select("key", "path", "salt").collect()
    # the salt picked the sample, so its low values say nothing of its spread: it is spread anew by rank
    step = 2**32 // max(1, len(sample))
    sample.sort(key=lambda r: (r["salt"], r["key"], r["path"]))
    rows = sorted((r["key"], r["path"], i * step) for i, r in enumerate(sample))
    return sorted({rows[len(rows) * i // parts] for i in range(1, parts)}) if rows else []


def _sweep(batches: Iterator[pd.DataFrame], default: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by (bucket, key, rules first): a stack of open rule hosts, each with its paths and verdicts."""
    stack: list[tuple[str, dict[str, tuple[str, str]], set[int]]] = []
    bucket = None
    for pdf in batches:
        out: list[tuple] = []
        for b, key, is_url, ident, host, path, rule, verdict in pdf.itertuples(index=False, name=None):
            if b != bucket:
                bucket, stack = b, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                paths, lengths = stack[-1][1:]
                paths[path] = min((rule, verdict), paths.get(path, (rule, verdict)))
                lengths.add(len(path))
                continue
            best: tuple | None = None
            for k, paths, lengths in stack:
                n = max((n for n in lengths if path[:n] in paths), default=-1)
                if n >= 0:
                    r, v = paths[path[:n]]
                    fit = (-len(r), -len(k), r, v)
                    best = fit if best is None else min(best, fit)
            out.append((ident, host, path, best[2] if best else None, best[3] if best else default))
        yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"]).astype({"id": "Int64"})


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """A row for each row of ``urls``: id, host, path, rule (null if none fits) and verdict.

    ``rules`` has host, path and verdict (allow or block) as strings.
    """
    spark = urls.sparkSession
    parts = shuffle_width(spark)
    u = urls.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    u = u.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    u = u.withColumn("key", reversed_key(F.col("host"))).withColumn("salt", F.xxhash64("id", "host", "path").bitwiseAND(F.lit(2**32 - 1)))
    cuts = _bounds(u, parts)

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series, path: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, x) for x in zip(key, path, salt, strict=True)], dtype="int32")

    r = rules.select(ascii_lower(F.col("host").cast("string")).alias("host"), F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict"))
    r = r.dropna(subset=["host", "path"]).distinct().withColumn("key", reversed_key(F.col("host")))
    r = r.withColumn("rule", F.concat("host", "path"))
    first = bucket_of(F.col("key"), F.lit(""), F.lit(-1).cast("long"))
    last = bucket_of(F.concat("key", F.lit(_TOP)), F.lit(""), F.lit(-1).cast("long"))
    r = r.withColumn("lo", first).withColumn("hi", last).withColumn("bucket", F.explode(F.sequence("lo", "hi")))
    u = u.withColumn("bucket", bucket_of(F.col("key"), F.col("path"), F.col("salt")))
    cols = ["bucket", "key", "is_url", "id", "host", "path", "rule", "verdict"]
    nothing = F.lit(None).cast("string")
    both = u.withColumns({"is_url": F.lit(True), "rule": nothing, "verdict": nothing}).select(cols).unionByName(
        r.withColumns({"is_url": F.lit(False), "id": F.lit(None).cast("long")}).select(cols)
    )
    dealt = both.repartition(parts, "bucket").sortWithinPartitions("bucket", "key", "is_url")
    # ids may be null: they travel as strings, which pandas doesn't turn into floats
    return (
        dealt.withColumn("id", F.col("id").cast("string"))
        .mapInPandas(lambda it: _sweep(it, default), _OUT)
        .select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
    )
