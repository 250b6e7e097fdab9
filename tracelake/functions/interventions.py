"""What people did when they wrote to an assistant: wrappers taken off, then the first of an ordered list of rules that fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import let

# Fixed values ---------------------------------------------------------------------------------------------------------------
#: Wrappers that tools put around a text, in the order in which they are looked for.
COMMAND_NAME = r"<command-name>(?U)\s*(/[^<]*?)\s*</command-name>"
COMMAND_ARGS = r"(?s)<command-args>(.*?)(?:</command-args>|\z)"
CARRIERS = [
    ("selection", r"(?s)<选中文本[^>]*>.*?(?:</选中文本>|\z)"),
    ("image_block", r"(?s)<image\b[^>]*>.*?(?:</image>|\z)"),
    ("image_ref", r"\[Image #\d+\]"),
    ("attachment", r"附件引用：(?U)\s*(?:-\s*文件：[^\n]*\n?)+"),
]
#: Rules that fire on a marker: name, label, markers.
MARKERS = [
    ("goal_nudge", "noise", ["Continue working toward the active thread goal.", "A goal has been set."]),
    ("environment_context", "noise", ["<environment_context>"]),
    ("local_command_caveat", "noise", ["Caveat: The messages below were generated by the user"]),
    ("background_task_notification", "noise", ["[SYSTEM NOTIFICATION - NOT USER INPUT]"]),
    ("subagent_notification", "noise", ["<subagent_notification>"]),
    ("resume_nudge", "noise", ["Output token limit hit."]),
    ("structured_output_nag", "noise", ["你尚未调用 mcp__"]),
    ("pause_notifier_nudge", "noise", ["[内部指令·严格模式]"]),
    ("staged_prompt_envelope", "noise", ["\nPrompt version: ", 'Return exactly JSON {"claims"']),
    ("interrupt_marker", "interrupt", ["[Request interrupted by user"]),
    ("operator_command", "self_serve", ["<bash-input>", "<local-command-stdout>", "<bash-stdout>", "<bash-stderr>"]),
]
EDGES = "。．.！!？?，,、；;：:~ \t"
STATUS_WORDS = ["进展", "进度", "如何了", "咋样了", "怎么样了", "还需要做什么"]
STATUS_CHARS = 40
ERRANDS = ["push", "ci push", "commit push", "commit and push", "push github", "ls", "exit", "services", "提交一下", "提交到 main", "同步"]
GO_AHEAD = ["ok", "继续", "开始", "开工", "要"]
GO_AHEAD_PHRASES = [
    "ok， 实现吧",
    "开始落地",
    "按照你的建议继续",
    "我看过了， 可以的，你继续吧",
    "同意写入和执行操作",
    "允许使用工具执行生成与验证",
    "批准方案 a，开始写 spec",
    "进入实施计划",
    "继续完成所有任务",
    "先等代理评审完成",
    "start subagent-driven execution",
    "enable tools to resume implementation",
]
TERMINAL_PROMPT = r"^(?U)\S+@\S+[ \t]+\S+[ \t]+%"
URL = r"[a-zA-Z][a-zA-Z0-9+.\-]*://(?U)\S+"
QUESTION = r"[^。．.！!？?\n]+[？?]\z"
FORM_CHARS = 300
CORRECTIONS = ["我说的是", "我的意思", "我指的是", "为啥没", "(?<!是)不是"]
REJECTIONS = ["不要", "不用", "不做"]
# ----------------------------------------------------------------------------------------------------------------------------


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def strip_carriers(text: Column) -> Column:
    """struct(lead, carriers, command): what the person wrote. Without wrappers, lead is the text as it is."""

    def named(t: Column) -> Column:
        has = t.rlike(COMMAND_NAME)
        command = F.when(has, F.regexp_extract(t, COMMAND_NAME, 1))
        lead = F.when(has, F.regexp_extract(t, COMMAND_ARGS, 1)).otherwise(t)
        return F.struct(lead.alias("lead"), F.array_compact(F.array(F.when(has, "command"))).alias("carriers"), command.alias("command"))

    def without(name: str, pattern: str) -> Callable[[Column], Column]:
        def of(s: Column) -> Column:
            carriers = F.concat(s["carriers"], F.array_compact(F.array(F.when(s["lead"].rlike(pattern), name))))
            return F.struct(F.regexp_replace(s["lead"], pattern, " ").alias("lead"), carriers.alias("carriers"), s["command"].alias("command"))

        return of

    out = let(text, named)
    for name, pattern in CARRIERS:
        out = let(out, without(name, pattern))

    def tidy(s: Column) -> Column:
        lead = F.when(F.size(s["carriers"]) > 0, _strip(F.regexp_replace(s["lead"], r"(?U)\s+", " "))).otherwise(s["lead"])
        return F.struct(lead.alias("lead"), s["carriers"].alias("carriers"), s["command"].alias("command"))

    return let(out, tidy)


def _first_marker(text: Column, markers: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(m)), m) for m in markers])


def _first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in patterns])


def _forms(text: Column) -> Column:
    """struct(text, bare, form, tail): without space at the ends; in lower case without punctuation at the ends; without space
    at the end."""
    edge = "[" + EDGES.replace(".", r"\.").replace("?", r"\?") + "]+"
    form = F.lower(F.regexp_replace(_strip(F.regexp_replace(text, r"(?U)\s+", " ")), rf"\A{edge}|{edge}\z", ""))
    return F.struct(text.alias("text"), _strip(text).alias("bare"), form.alias("form"), F.regexp_replace(text, r"(?U)\s+\z", "").alias("tail"))


def _rules(x: Column) -> list[tuple[str, str, Column]]:
    """Rule, label, evidence (null if it doesn't fit), most telling first. x: _forms()."""
    text, bare, form, tail = (x[f] for f in ("text", "bare", "form", "tail"))
    short = F.length(bare) <= FORM_CHARS
    out = [(rule, label, _first_marker(text, markers)) for rule, label, markers in MARKERS]
    lone = (bare != "") & (F.regexp_replace(bare, r"\A[？?]+|[？?]+\z", "") == "")
    asked = F.rlike(F.regexp_replace(F.regexp_replace(text, URL, " "), r"(?U)\s+\z", ""), F.lit(r"[？?]\z"))
    clause = F.nullif(_strip(F.regexp_extract(tail, QUESTION, 0)), F.lit(""))
    agreed = form.rlike(r"\A[a-z0-9]\z") | form.isin(GO_AHEAD) | form.isin(GO_AHEAD_PHRASES)
    return [
        *out,
        ("terminal_paste_back", "fact", _first_match(text, [TERMINAL_PROMPT])),
        ("status_prod", "status", F.when(lone, bare).when(F.length(bare) <= STATUS_CHARS, _first_marker(text, STATUS_WORDS))),
        ("operational_errand", "chore", F.when(form.isin(ERRANDS), bare)),
        ("acknowledgement", "confirm", F.when((form != "") & agreed, bare)),
        ("correction", "correction", F.when(short, _first_match(text, CORRECTIONS))),
        ("rejection", "rejection", F.when(short, _first_match(text, REJECTIONS))),
        ("terminal_question", "question", F.when(asked, clause)),
    ]


def _verdict(label: str, rule: str, evidence: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(rule).alias("rule"), evidence.alias("evidence"))


def _cascade(text: Column) -> Column:
    """The first rule that fits, null if none does."""

    def first(x: Column) -> Column:
        each = [F.when(ev.isNotNull(), _verdict(label, rule, ev)) for rule, label, ev in _rules(x)]
        return F.try_element_at(F.array_compact(F.array(*each)), F.lit(1))

    return let(_forms(text), first)


def classify(text: Column) -> Column:
    """struct(label, rule, evidence, carriers). If the wrappers held everything, the rules read the whole text; a bare slash
    command is a chore; what no rule fits is unclassified. Null text: null."""

    def judge(s: Column) -> Column:
        blank = _strip(s["lead"]) == ""
        # with nothing left, the whole text is read instead: a blank lead itself fits no rule
        read = F.when(blank, text).otherwise(s["lead"])
        command = F.when(s["command"].isNotNull() & blank, _verdict("chore", "bare_slash_command", s["command"]))
        found = F.coalesce(_cascade(read), command, _verdict("unclassified", "unclassified", F.lit("")))
        return let(found, lambda f: F.struct(f["label"].alias("label"), f["rule"].alias("rule"), f["evidence"].alias("evidence"), s["carriers"].alias("carriers")))

    return F.when(text.isNotNull(), let(strip_carriers(text), judge))
