"""Small corpora with odd rows, and plain functions that the operators are compared with."""

import hashlib
import random
import re

from pyspark.sql import types as T

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that the operators use inside: extra columns of the input must not meet them.
CLASHES = ["id", "hash", "n", "words", "kind", "row", "bucket", "component", "class", "key", "spans", "held", "score", "salt"]


def words_of(text):
    return SPACE.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def corpus(seed=1):
    """(doc_id, text, lang, source, n_chars) with nulls, empty and very long texts, copies, near copies, ties and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 80)
    long_text = prose(rng, 30_000, 5000)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \t\n", "one", "one two three four", "one two three four", "ONE two Three four", base, base, " ".join(near), long_text, "ÄÖ é ß\u00a0x \U0001f600 " * 20]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(20)]
    texts += [prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 40) for _ in range(3)]
    texts += [long_text + " tail"]
    rows = [(i + 1, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((rows[8][0], prose(rng, 90), "en", "s0", 1))  # an id with two texts
    rows.append((None, prose(rng, 90), "en", "s0", 1))
    rows.append((None, None, None, None, None))
    return rows


def documents(spark, rows=None):
    """As a table, with extra columns of clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    df = spark.createDataFrame(corpus() if rows is None else rows, schema)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASHES})


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
