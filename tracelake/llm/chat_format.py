"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted, and adjacent turns of one role are merged by an array
aggregation into blocks. A block is written as::

    ### role:
    text<turn-break>text</turn>

and a newline follows. Inside texts and roles three characters are replaced, so that no text can hold a control string:
``\\`` becomes ``\\b``, ``<`` becomes ``\\l`` and ``#`` becomes ``\\h``; in roles also ``:`` becomes ``\\c``. As each backslash
of the output begins such a pair, plain replacements undo this exactly; merged turns stay apart by ``<turn-break>``.

The loss mask is carried as segments: consecutive pieces of the formatted text, each with its mark. Only assistant texts
are marked, without headers, breaks and ends.

Long conversations: turns are numbered in order, collected and merged in runs of TURN_RUN turns (whatever numbers they have: all
of them may be equal or null), then the runs' blocks are put together, so no array that grows holds more than a run. One shuffle by
conversation, which carries each text once, serves all steps.

Defined cases. Null text or role: empty. Null turn: before all others. Equal turn numbers: by role, then text. Repeated
rows: each is a turn. Null conversation: a conversation of its own. Other columns aren't read. No rows: no result rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_RUN = 256
END = "</turn>\n"
BREAK = "<turn-break>"
_BLOCK = "array<struct<role:string,parts:array<string>>>"


#: What is replaced in texts and in roles; in this order, and undone in the other.
_IN_TEXT = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_IN_ROLE = (*_IN_TEXT, (":", "\\c"))


def escape(text: Column, pairs: tuple[tuple[str, str], ...] = _IN_TEXT) -> Column:
    for raw, safe in pairs:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(_IN_ROLE):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _merge(turns: Column) -> Column:
    """Blocks of adjacent turns of one role."""

    def step(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.concat(
            F.slice(blocks, 1, F.size(blocks) - 1),
            F.array(F.struct(last["role"].alias("role"), F.concat(last["parts"], F.array(turn["text"])).alias("parts"))),
        )
        own = F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("parts"))))
        same = (F.size(blocks) > 0) & F.coalesce(F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"], F.lit(False))
        return F.when(same, grown).otherwise(own)

    return F.aggregate(turns, F.array().cast(_BLOCK), step)


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """id, formatted (string) and segments (array of struct<text, loss>), whose texts in order are ``formatted``."""
    t = turns.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(escape(F.col(role_col).cast("string"), _IN_ROLE), F.lit("")).alias("role"),
        F.coalesce(escape(F.col(text_col).cast("string")), F.lit("")).alias("text"),
    )
    numbered = t.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("turn", "role", "text")))
    runs = (
        numbered.groupBy("id", F.expr(f"(k - 1) div {TURN_RUN}").alias("run"))
        .agg(F.sort_array(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
        .select("id", "run", _merge(F.col("turns")).alias("blocks"))
    )
    blocks = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("run", "blocks"))).alias("runs"))
    blocks = blocks.select("id", F.flatten(F.transform("runs", lambda r: r["blocks"])).alias("blocks"))

    def pieces(block: Column, i: Column) -> Column:
        before = F.get(F.col("blocks"), i - 1)["role"]
        goes_on = (i > 0) & F.coalesce(before == block["role"], F.lit(False))
        header = F.concat(F.lit("### "), block["role"], F.lit(":\n"))
        lead = F.when(goes_on, F.lit(BREAK)).when(i > 0, F.concat(F.lit(END), header)).otherwise(header)
        loss = block["role"] == "assistant"
        return F.flatten(
            F.transform(
                block["parts"],
                lambda part, j: F.array(
                    F.struct(F.when(j > 0, F.lit(BREAK)).otherwise(lead).alias("text"), F.lit(False).alias("loss")),
                    F.struct(part.alias("text"), loss.alias("loss")),
                ),
            )
        )

    body = blocks.select("id", F.flatten(F.transform("blocks", pieces)).alias("body"))
    end = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    done = body.select("id", F.concat("body", end).alias("segments"))
    return done.select(F.col("id").alias(id_col), F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as array of struct<role, text>: the inverse of the template."""
    blocks = F.filter(F.split(formatted, "</turn>\n", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        header = F.regexp_extract(block, r"(?s)^### (.*?):\n", 1)
        text = F.substring(block, F.length(header) + 7, F.length(block))
        return F.transform(F.split(text, BREAK, -1), lambda part: F.struct(unescape(header).alias("role"), unescape(part).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
