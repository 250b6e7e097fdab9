"""Names that occur inside texts, by an equi-join on short grams instead of all names against all texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import let

GRAM = 3


def mentions(texts: DataFrame, names: DataFrame, text_id: str, text: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """within, text_id, name: names that are substrings of a text, distinct; of the same ``within``, if any are given.

    A name is probed by its first GRAM characters (all of it if shorter); grams of a text are taken once each, and what they
    meet is checked against the whole text. Empty names and texts meet nothing. A text's grams are found in time linear in its length.
    """
    keys = list(within)
    n = names.select(*keys, name).where(F.length(name) > 0).distinct().withColumn("_gram", F.substring(name, 1, GRAM))

    def grams_of(c: Column) -> Column:  # of the text's characters, taken apart once: places in a string are found from its beginning
        part = lambda i, k: F.array_join(F.slice(c, i, k), "")
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: F.array(*[part(i, k) for k in range(1, GRAM + 1)]))))

    grams = let(F.split(F.col(text), ""), grams_of)
    t = texts.where(F.length(text) > 0).select(*keys, text_id, text)
    each = t.select(*keys, text_id, F.explode(grams).alias("_gram")).join(n.select(*keys, "_gram").distinct(), [*keys, "_gram"], "left_semi")
    return each.join(n, [*keys, "_gram"]).join(t, [*keys, text_id]).where(F.contains(text, name)).select(*keys, text_id, name).distinct()
