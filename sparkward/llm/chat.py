"""Chat formatting with DataFrame expressions only, and reading the result back.

The turns of a conversation, in order of turn, are written as

    <s>[INST:user]text<sep>text[/INST][INST:assistant]text[/INST]</s>

where adjacent turns of one role share one pair of markers. Control strings start with
`<` or `[`; inside texts and roles these signs, `]` and the backslash are written as a
backslash and a digit, so no text holds a control string and all is read back as it was.
The loss mask has a 1 for every code point of a text of the roles that are learnt, and a
0 for every other one; separators between merged texts are 0.

A null text is empty, a null role is the role "". Turns without a number come first;
turns of equal number are ordered by role and text, and each stays. Rows without conv_id
form one conversation. Other columns are not read. A conversation is one row of the
result, so one must fit in a row; nothing else grows with it but that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END, SEPARATOR = "<s>", "</s>", "<sep>"
OPEN, OPENED, CLOSE = "[INST:", "]", "[/INST]"
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))


def escape(text: Column) -> Column:
    for sign, code in _ESCAPES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _segments(turns: Column, learn: Sequence[str]) -> Column:
    """Strings that make up the formatted text, each with whether it is learnt."""

    def part(text: Column, learnt: Column) -> Column:
        return F.struct(text.alias("text"), learnt.alias("learnt"))

    def of(turn: Column, i: Column) -> Column:
        before, after = F.get(turns, i - 1)["role"], F.get(turns, i + 1)["role"]
        opened = F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(OPENED))
        opening = F.when(before.eqNullSafe(turn["role"]), F.lit(SEPARATOR)).otherwise(opened)
        closing = F.when(after.eqNullSafe(turn["role"]), F.lit("")).otherwise(F.lit(CLOSE))
        return F.array(
            part(opening, F.lit(False)), part(escape(turn["text"]), turn["role"].isin(*learn)), part(closing, F.lit(False))
        )

    edge = lambda s: F.array(part(F.lit(s), F.lit(False)))
    return F.concat(edge(BEGIN), F.flatten(F.transform(turns, of)), edge(END))


def formatted(rows: DataFrame, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_mask) of every conversation."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    parts = turns.select("conv_id", _segments(F.col("turns"), learn).alias("parts"))
    mask = F.transform("parts", lambda p: F.repeat(F.when(p["learnt"], F.lit("1")).otherwise(F.lit("0")), F.length(p["text"])))
    return parts.select("conv_id", F.concat_ws("", F.col("parts.text")).alias("formatted"), F.concat_ws("", mask).alias("loss_mask"))


def turns_of(text: Column) -> Column:
    """The (role, text) of every turn of a formatted conversation, merged ones apart again."""
    body = F.substring(text, F.lit(len(BEGIN) + 1), F.length(text) - len(BEGIN) - len(END))
    runs = F.filter(F.split(body, r"\[/INST\]"), lambda r: r != "")

    def of(run: Column) -> Column:
        role = unescape(F.regexp_extract(run, r"(?s)^\[INST:([^\]]*)\]", 1))
        texts = F.split(F.regexp_replace(run, r"(?s)^\[INST:[^\]]*\]", ""), SEPARATOR)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, of))


def learnt_text(text: Column, mask: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    signs, marks = F.split(text, ""), F.split(mask, "")
    pairs = F.filter(F.arrays_zip(signs.alias("sign"), marks.alias("mark")), lambda p: p["mark"] == "1")
    return unescape(F.concat_ws("", F.transform(pairs, lambda p: p["sign"])))
