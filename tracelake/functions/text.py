"""Column functions over text: token estimates, normal forms, previews, tiers, references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often f names it; projections that are merged would repeat it."""
    return F.transform(F.array(value), f)[0]


#: Letters that count as a token each, beside four other characters to a token.
CJK = "[\\u4e00-\\u9fff\\u3040-\\u30ff\\uac00-\\ud7af]"
OVERSIZE_LINES, LARGE_LINES = 500, 200
VERBOSE_CHARS, TERSE_CHARS, LEAST_CHARS = 300, 50, 3


def estimate_tokens(text: Column) -> Column:
    """0 for empty or null, else the wide letters plus a quarter of the rest, at least 1."""
    wide = F.length(text) - F.length(F.regexp_replace(text, CJK, ""))
    other = F.length(text) - wide
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), wide + F.floor(other / 4))).cast("long")


def normalize(text: Column) -> Column:
    """Without one leading line that is an ISO timestamp, white space joined to single spaces, ends trimmed."""
    body = F.regexp_replace(text, r"\A(?U)\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}[^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(body, r"(?U)\s+", " "), r"\A | \z", "")


def digest(text: Column) -> Column:
    return F.sha1(normalize(text))


def preview(text: Column, limit: int = 200) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\A | \z", ""), 1, limit)


def size_tier(lines: Column) -> Column:
    return F.when(lines > OVERSIZE_LINES, "oversize").when(lines > LARGE_LINES, "large").otherwise("ok")


def description_tier(chars: Column) -> Column:
    """A failed parse outranks length."""
    return F.when(chars < LEAST_CHARS, "unusable").when(chars > VERBOSE_CHARS, "verbose").when(chars < TERSE_CHARS, "terse").otherwise("ok")


def local_references(body: Column) -> Column:
    """Targets of markdown links and bare mentions below references/, scripts/ or assets/, without schemes and anchors, sorted."""
    links = F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    bare = F.regexp_extract_all(body, F.lit(r"(?:^|[\s`(])((?:references|scripts|assets)/[A-Za-z0-9_./-]+)"), F.lit(1))
    local = F.filter(F.array_union(links, bare), lambda x: ~x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^//"))
    return F.array_sort(F.filter(F.transform(local, lambda x: F.regexp_replace(x, r"[#?].*$", "")), lambda x: x != ""))


def casefold(text: Column) -> Column:
    return F.lower(F.upper(text))


def split_injected(text: Column, tags: tuple[str, ...]) -> tuple[Column, Column]:
    """What a person wrote, and the blocks <tag>...</tag> that were put in, joined by newlines."""
    pattern = r"(?is)<(" + "|".join(tags) + r")\b[^>]*>.*?</\1\s*>"
    blocks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.regexp_replace(text, pattern, ""), F.array_join(blocks, "\n")
