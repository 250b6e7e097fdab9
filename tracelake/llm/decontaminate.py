"""Benchmark decontamination by winnowing, with DataFrame functions only.

Both sides are cut into words and hashed in K-word grams; of each W consecutive grams the one with the least hash is kept,
so any shared span of K + W - 1 = WINDOW words leaves at least one common fingerprint at the same place in it. Fingerprints
are joined, each hit names a diagonal (place in the document less place in the item), and along each diagonal equal words
are extended to maximal runs. Runs of WINDOW words, or of the whole item if it is shorter, are the hits: words are compared
themselves, so nothing rests on hashes being free of collisions. Items shorter than WINDOW are one fingerprint each, sought
among the documents' grams of that length; only lengths that occur are.

Plan: items with the same words are one class, so copies multiply nothing. The item side is written to the shared folder and
counted; up to BROADCAST_ROWS fingerprints (24 bytes each) are broadcast, more are joined by shuffle. A document leaves the
first pass as (id, text hash, class) with its distinct diagonals only. A second pass joins those to the texts and extends the hits.

Defined cases. Null or empty text: no words, no hit; such an item never occurs. Repeated rows: each gets its own result. One
id with several texts: told apart by the text's hash. Null ids: joined as equal. Items without id: they count as an empty
id. Ties of hashes: the leftmost gram. No items: no hits. Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, cut

#: Fixed value: what separates words, after A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
K = 4
W = WINDOW - K + 1
#: Bits of a fingerprint that hold the place; the rest are the hash. Texts of over 2^28 words don't fit Spark's strings' practical size.
_PLACE = 28
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS, -1), "")


def _grams(words: Column, n: Column, k: int) -> Column:
    """The k-grams' hashes with their places in the low bits, in order."""
    top = F.lit(-(1 << _PLACE))
    one = lambda i: F.xxhash64(F.slice(words, i + 1, k)).bitwiseAND(top).bitwiseOR(i.cast("long"))
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, n: Column) -> Column:
    least = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.array_min(F.slice(grams, i, W)))
    return F.when(n >= WINDOW, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def _split(fp: Column) -> tuple[Column, Column]:
    return F.shiftright(fp, _PLACE), fp.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")


def _runs(words: Column, n: Column, item: Column, m: Column, d: Column) -> Column:
    """Maximal runs of equal words on a diagonal that are long enough: array of struct<start, end>, in words of the document."""
    need = F.least(m, F.lit(WINDOW))
    start = F.lit(0).cast("int")
    zero = F.struct(start.alias("run"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def close(acc: Column, at: Column) -> Column:
        span = F.array(F.struct((at - acc["run"]).cast("int").alias("start"), at.cast("int").alias("end")))
        return F.when(acc["run"] >= need, F.concat(acc["out"], span)).otherwise(acc["out"])

    def step(acc: Column, at: Column) -> Column:
        same = F.get(words, at) == F.get(item, at - d)
        return F.when(F.coalesce(same, F.lit(False)), F.struct((acc["run"] + 1).cast("int").alias("run"), acc["out"].alias("out"))).otherwise(
            F.struct(start.alias("run"), close(acc, at).alias("out"))
        )

    first, last = F.greatest(d, F.lit(0)), F.least(n, m + d)
    return F.aggregate(F.sequence(first, last), zero, step, lambda acc: acc["out"])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each input row: id, n_words, n_hit, n_items (long), items (their ids as strings, sorted) and spans (array of
    struct<start, end> in words) and text_hash (xxhash64 of the text)."""
    classes = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text_col)).alias("item_words"))
    classes = classes.where(F.size("item_words") > 0).groupBy("item_words").agg(F.collect_set("item").alias("ids"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    m = F.size("item_words")
    prints = F.when(m < WINDOW, F.array(F.xxhash64("item_words").bitwiseAND(F.lit(-(1 << _PLACE))))).otherwise(_winnowed(_grams(F.col("item_words"), m, K), m))
    index = classes.select("class", F.least(m, F.lit(WINDOW)).alias("size"), F.explode(prints).alias("fp"))
    fp, place = _split(F.col("fp"))
    index = cut(index.select("class", "size", fp.alias("fp"), place.alias("q")))
    found = index.groupBy("size").count().collect()  # WINDOW rows at most
    short = sorted(r["size"] for r in found if r["size"] < WINDOW)

    key = [F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    texts = docs.select(*key).withColumn("hash", F.xxhash64("text"))
    w = texts.select("id", "hash", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    w = w.withColumn("grams", _grams(F.col("words"), F.col("n"), K))
    sides = [(WINDOW, w.select("id", "hash", F.explode(_winnowed(F.col("grams"), F.col("n"))).alias("fp")))]
    sides += [(k, w.select("id", "hash", F.explode(_grams(F.col("words"), F.col("n"), k)).alias("fp"))) for k in short]
    hits = None
    for size, side in sides:
        of_size = index.where(F.col("size") == size).drop("size")
        if sum(r["count"] for r in found) <= BROADCAST_ROWS:
            of_size = F.broadcast(of_size)
        fp, place = _split(F.col("fp"))
        some = side.select("id", "hash", fp.alias("fp"), place.alias("p")).join(of_size, "fp").select("id", "hash", "class", (F.col("p") - F.col("q")).alias("d"))
        hits = some if hits is None else hits.unionByName(some)
    # the diagonals of a class first, so that its words come once to a document, however many hits it has there
    hits = hits.groupBy("id", "hash", "class").agg(F.collect_set("d").alias("ds"))
    hits = hits.join(classes, "class").groupBy("id", "hash").agg(F.collect_list(F.struct("ds", "item_words", "ids")).alias("hits"))
    hits = hits.select(F.col("id").alias("hit_id"), F.col("hash").alias("hit_hash"), "hits")

    j = texts.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")), "left")
    j = j.select("id", "hash", words_of(F.col("text")).alias("words"), "hits").withColumn("n", F.size("words"))
    along = lambda h: F.flatten(F.transform(h["ds"], lambda d: _runs(F.col("words"), F.col("n"), h["item_words"], F.size(h["item_words"]), d)))
    runs = F.transform("hits", lambda h: F.struct(along(h).alias("runs"), h["ids"].alias("ids")))
    j = j.select("id", "hash", "n", F.filter(runs, lambda r: F.size(r["runs"]) > 0).alias("found"))
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda r: r["runs"]))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda r: r["ids"]))))
    no_spans, no_ids = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    j = j.select("id", "hash", "n", F.coalesce(spans, no_spans).alias("spans"), F.coalesce(ids, no_ids).alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    return j.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        F.col("hash").alias("text_hash"),
    )


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item."""
    leaks = find_leaks(docs, items, id_col, text_col, item_id_col, item_text_col).where("n_hit > 0")
    leaks = leaks.select(F.col(id_col).alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct()
    same = docs[id_col].eqNullSafe(leaks["leak_id"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == leaks["leak_hash"])
    return docs.join(leaks, same, "left_anti")
