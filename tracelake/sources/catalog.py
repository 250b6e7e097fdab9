"""Catalogs of instruction files: SKILL.md files and entries supplied from outside, as one table.

A file is an optional front matter between lines of three dashes, then a body. Spark takes files apart and derives all columns;
only the front matter's block of text goes through a small parser for the YAML that such files use.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of the body that decide a trigger, the shortest description that says something, depth of folders.
TRIGGER_CHARS, LEAST_CHARS, DEPTH = 800, 3, 5
_FRONT = r"\A---[ \t]*\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)"
_META = "name string, description string, disabled string, requires array<string>"


def _plain(value: str) -> str:
    value = value.strip()
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        inner = value[1:-1]
        return inner.replace("''", "'") if value[0] == "'" else inner.replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
    return re.split(r"\s#", value, maxsplit=1)[0].strip() if not value.startswith("#") else ""


def _block(style: str, lines: list[str]) -> str:
    """A literal (|) or folded (>) block: common indentation goes; in folded ones an empty line is a break and others are joined."""
    indent = min((len(x) - len(x.lstrip()) for x in lines if x.strip()), default=0)
    text = [x[indent:].rstrip() for x in lines]
    joined = "\n".join(text) if style == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(text))
    return re.sub(r"\n\n", "\n", joined).strip() if style == ">" else joined.strip("\n")


def front_matter(block: str) -> dict[str, str | list[str]]:
    """Top-level keys: scalars (plain, quoted, wrapped, block) and sequences. Nested maps are passed over."""
    out: dict[str, str | list[str]] = {}
    lines = block.splitlines()
    i = 0
    while i < len(lines):
        m = re.match(r"([A-Za-z0-9_-]+):(?:[ \t]+(.*))?$", lines[i])
        i += 1
        if not m:
            continue
        inner = []
        while i < len(lines) and (not lines[i].strip() or lines[i][0] in " \t" or lines[i].startswith("- ")):
            inner.append(lines[i])
            i += 1
        key, value = m[1], (m[2] or "").strip()
        if re.fullmatch(r"[|>][+-]?\d?", value):
            out[key] = _block(value[0], inner)
        elif not value and any(x.lstrip().startswith("- ") for x in inner):
            out[key] = [_plain(x.lstrip()[2:]) for x in inner if x.lstrip().startswith("- ")]
        elif not value and any(re.match(r"\s+[\w-]+:(\s|$)", x) for x in inner):
            continue
        else:
            out[key] = _plain(" ".join([value, *(x.strip() for x in inner if x.strip())]))
    return out


def names(value: str | list[str] | None) -> list[str]:
    """A sequence, ``[a, b]`` or ``a, b``; each name once."""
    if value is None:
        return []
    items = value if isinstance(value, list) else re.sub(r"^\[(.*)\]$", r"\1", value.strip()).split(",")
    return list(dict.fromkeys(x for x in (i.strip().strip("\"'") for i in items) if x))


def _meta(front: pd.Series) -> pd.DataFrame:
    rows = []
    for block in front:
        m = front_matter(block or "")
        text = lambda k: m[k] if isinstance(m.get(k), str) else None  # noqa: B023, E731
        rows.append((text("name"), text("description"), text("disable-model-invocation"), names(m.get("requires"))))
    return pd.DataFrame(rows, columns=["name", "description", "disabled", "requires"])


def parse(files: DataFrame) -> DataFrame:
    """(path, text) as catalog rows: name (else the folder's), description, trigger_excerpt, body, disable_model_invocation,
    description_parse_failed, requires, text."""
    f = files.withColumn("_m", F.pandas_udf(_meta, f"struct<{_META.replace(' ', ':').replace(',:', ',')}>")(F.regexp_extract("text", _FRONT, 1)))
    body = _body(F.col("text"))
    description = F.trim(F.coalesce("_m.description", F.lit("")))
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    return f.select(
        F.coalesce(F.nullif("_m.name", F.lit("")), folder).alias("name"),
        description.alias("description"),
        F.trim(F.concat(description, F.lit("\n"), F.substring(body, 1, TRIGGER_CHARS))).alias("trigger_excerpt"),
        body.alias("body"),
        (F.lower(F.coalesce("_m.disabled", F.lit(""))) == "true").alias("disable_model_invocation"),
        (F.length(description) < LEAST_CHARS).alias("description_parse_failed"),
        F.coalesce("_m.requires", F.array().cast("array<string>")).alias("requires"),
        "path",
        "text",
        F.lit("scanned").alias("source"),
    )


def scan(spark: SparkSession, directories: list[str]) -> DataFrame:
    """Skills below the directories, at most DEPTH folders deep. Of one name, the first directory and then the first path counts."""
    found = None
    for rank, d in enumerate(directories):
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "SKILL.md").text(d, wholetext=True)
        one = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.lit(rank).alias("rank"), F.lit(d.rstrip("/")).alias("root"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no directories")
    below = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    root = F.regexp_replace("root", "^[a-z0-9]+:/*", "/")
    found = found.where(F.size(F.split(F.substr(below, F.length(root) + 2), "/")) <= DEPTH + 1)
    rows = parse(found.select("path", "text")).join(found.select("path", "rank"), "path")
    w = Window.partitionBy("name").orderBy("rank", F.split("path", "/"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "rank")


def _body(text: Column) -> Column:
    """A file's text without its front matter and outer white space."""
    return F.regexp_replace(F.regexp_replace(text, _FRONT, ""), r"(?U)\A\s+|\s+\z", "")


def injected(entries: DataFrame, files: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Catalog rows from a column ``json``: an object of name to {description, intent, body_path}, or one such object below ``skills``.
    Bad entries are left out, as are those with neither description nor body. keys: columns of ``entries`` that rows keep.

    files: path, text of the bodies that entries give by path. A path that none of them has leaves the entry its description alone.
    """
    keys = keys or []
    v = F.try_parse_json("json")
    of = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.skills", "variant")).startswith("OBJECT"), F.try_variant_get(v, "$.skills", "variant")), v)
    pairs = entries.where(F.schema_of_variant(v).startswith("OBJECT")).select(*keys, F.explode(F.map_entries(F.from_json(F.to_json(of), "map<string,string>"))).alias("e"))
    field = lambda f: F.get_json_object("e.value", f"$.{f}")
    rows = pairs.select(*keys, F.col("e.key").alias("name"), F.trim(F.coalesce(field("description"), F.lit(""))).alias("description"), F.nullif(F.trim(field("intent")), F.lit("")).alias("intent"), F.nullif(field("body_path"), F.lit("")).alias("path"))
    if files is None:
        rows = rows.withColumn("text", F.lit(None).cast("string"))
    else:
        rows = rows.join(files.select("path", "text").dropDuplicates(["path"]), "path", "left")
    rows = rows.withColumn("body", F.coalesce(_body(F.col("text")), F.lit(""))).where("description <> '' or body <> ''")
    return rows.select(*keys, "name", "description", F.regexp_replace(F.concat("description", F.lit("\n"), F.substring("body", 1, TRIGGER_CHARS)), r"(?U)\A\s+|\s+\z", "").alias("trigger_excerpt"), "body", F.lit(False).alias("disable_model_invocation"),
                       (F.length("description") < LEAST_CHARS).alias("description_parse_failed"), F.array().cast("array<string>").alias("requires"), F.coalesce("path", F.lit("<injected>")).alias("path"),
                       "text", F.lit("injected").alias("source"), "intent")


def fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fingerprint: what entries from injected() amount to, whatever the order of their keys, their form or their layout was.
    Sets without any usable entry have none."""
    one = F.to_json(F.struct("name", "description", F.coalesce("intent", F.lit("")).alias("intent"), "path"))
    return rows.groupBy(*keys).agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(one)), "\n")), 1, 16).alias("fingerprint"))


def merge(catalog: DataFrame, extra: DataFrame) -> DataFrame:
    """An injected entry replaces the catalog's of the same name, whatever its case; others are added."""
    both = catalog.withColumn("_rank", F.lit(1)).unionByName(extra.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(F.lower("name")).orderBy("_rank", F.desc("name"), "path")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def directory_counts(catalog: DataFrame, directory: Column) -> DataFrame:
    """Skills and failed descriptions by directory."""
    return catalog.groupBy(directory.alias("directory")).agg(F.count("*").alias("skills"), F.count_if("description_parse_failed").alias("failed"))
