"""Secret scans with DataFrame functions: regular expressions, then corpus-wide ownership frequency.

Base kinds (always kept): ``assign``, ``access`` and ``hex``. A further kind, ``opaque``, holds long mixed tokens, which
may just as well be identifiers or published examples; whether one is reported depends on the corpus. All candidate values
are hashed and counted by distinct owner and, apart from that, by distinct repository. A value that more than MAX_OWNERS owners
share, or that more than MAX_REPOS repositories hold (of whatever owners: a template), is a widely copied example; one that stays
with its owner, in a few repositories, looks live. Copied opaque candidates are dropped; copied base spans stay, and are counted
apart (n_copied). Each span carries both counts.

Plan: one scan finds matches and keeps ids, matches and owners, no text, in a table in the shared folder. Offsets are
running sums of gap and match lengths over a document's matches. Counting is two-step (distinct hash, owner and repository
first, then by hash), so a value copied into a third of all documents shrinks before each shuffle.

Defined cases. Null text: empty. Null owner or repository: one unnamed owner. Repeated rows: each gets its own result,
while ownership counts them once. Equal starts: by kind as listed. No rows: no result rows. Offsets are in code points,
end exclusive. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut

#: Kind, pattern, group of the value, least length of the value. In the order in which spans are listed.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9+/_-]{32,}(?:\.[A-Za-z0-9+/_-]{8,}){0,2}={0,2}", 0, 32),
]
BASE = 3
#: A value seen with more owners than this is taken for a published example.
MAX_OWNERS = 2
#: A value seen in more repositories than this is taken for one too, even of a single owner.
MAX_REPOS = 8


def _matches(text: Column, k: int) -> Column:
    """Matches of kind k in order: kind, number, length of the text before it, its length, whether it counts, value hash."""
    name, pattern, group, least = KINDS[k]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def one(match: Column, i: Column) -> Column:
        value = F.regexp_extract(match, pattern, group) if group else match
        good = F.length(value) >= least
        if k >= BASE:
            good = good & match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
        return F.struct(
            F.lit(k).alias("kind"),
            i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(match).alias("len"),
            good.alias("good"),
            F.sha2(value, 256).alias("hash"),
        )

    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,good:boolean,hash:string>>")
    return F.when(text.rlike(pattern), F.transform(found, one)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """A row for each input row: id, n_assign, n_access, n_hex, n_opaque, n_copied (long) and spans, an array of
    struct<start, end, kind, copied, owners, repos> by start and kind, and text_hash (xxhash64 of the text)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = cut(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
            F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"),
            F.xxhash64(text).alias("hash"),
            F.concat(*[_matches(text, k) for k in range(len(KINDS))]).alias("matches"),
        )
    )
    each = found.where(F.size("matches") > 0).select("row", "owner", "repo", F.inline("matches"))
    seen = each.where("good").select("hash", "owner", "repo").distinct()
    counted = seen.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"))
    counted = counted.withColumn("copied", (F.col("owners") > max_owners) | (F.col("repos") > max_repos))

    so_far = Window.partitionBy("row", "kind").orderBy("i")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn("start", F.col("end") - F.col("len"))
    each = each.where("good").join(counted, "hash")
    each = each.where((F.col("kind") < BASE) | ~F.col("copied"))
    base_end, base_start = F.when(F.col("kind") < BASE, F.col("end")), F.when(F.col("kind") < BASE, F.col("start"))
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    before = F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(base_start).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumns({"before": before, "after": after}).where(
        (F.col("kind") < BASE) | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end")))
    )
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{kind[0]}") for k, kind in enumerate(KINDS)]
    per_row = each.groupBy("row").agg(
        *counts,
        F.count(F.when(F.col("copied"), 1)).alias("n_copied"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "copied", "owners", "repos"))).alias("spans"),
    )
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind"), s["copied"].alias("copied"), s["owners"].alias("owners"), s["repos"].alias("repos")))
    numbers = [f"n_{k[0]}" for k in KINDS] + ["n_copied"]
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string,copied:boolean,owners:bigint,repos:bigint>>")
    return (
        found.select("row", "id", F.col("hash").alias("text_hash"))
        .join(per_row, "row", "left")
        .select(F.col("id").alias(id_col), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in numbers], F.coalesce(spans, none).alias("spans"), "text_hash")
    )


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin([k[0] for k in KINDS[:BASE]]))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return (
            F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, F.concat(F.lit("["), s["kind"], F.lit("]")))).alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        )

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.aggregate(spans, zero, step, rest)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The rows of ``docs``, with all their columns, where each span of scan() is masked in the text."""
    spans = scan(docs, id_col, text_col, owner_col, repo_col, max_owners, max_repos).where(F.size("spans") > 0)
    spans = spans.select(F.col(id_col).alias("span_id"), F.col("text_hash").alias("span_hash"), F.col("spans").alias("span_list")).dropDuplicates(["span_id", "span_hash"])
    same = docs[id_col].eqNullSafe(spans["span_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == spans["span_hash"])
    masked = F.when(spans["span_list"].isNotNull(), _masked(docs[text_col], spans["span_list"])).otherwise(docs[text_col])
    return docs.join(spans, same, "left").select(*[masked.alias(c) if c == text_col else docs[c] for c in docs.columns])
