"""Chat formatting with DataFrame functions alone: a role automaton, reversible escapes, segments with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import pick


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like: open + role + sep + text + close, turn after turn.

    Inside roles and texts the escape character is doubled, and each control string gets escape + '-' after its first
    character, so no control string is left there and the way back is one replacement. transitions: for each state
    (a role, or 'start') the roles that may follow; a conversation is valid if no step leaves the table and it ends in `final`.
    """

    open: str = "### "
    sep: str = ": "
    close: str = "</turn>\n"
    marks: tuple[str, ...] = ("### ", "</turn>")
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def encode(self, c: Column, also: tuple[str, ...] = ()) -> Column:
        c = F.replace(c, F.lit(self.escape), F.lit(self.escape * 2))
        for m in (*self.marks, *also):
            c = F.replace(c, F.lit(m), F.lit(m[0] + self.escape + "-" + m[1:]))
        return c

    def decode(self, c: Column) -> Column:
        e = re.escape(self.escape)
        return F.regexp_replace(c, f"{e}(?:({e})|-)", "$1")


def _turn_state(template: Template, roles: Column) -> Column:
    steps = [F.lit(f"{a}>{b}") for a, bs in template.transitions.items() for b in bs]
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.when(F.array_contains(F.array(*steps), F.concat(state, F.lit(">"), role)), role).otherwise(F.lit("error")))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, segments array<(content, loss)>, state, valid): one row a conversation, its turns in order of `turn`.

    The segments joined are the formatted text; those with loss are the assistant texts alone, still escaped. Null texts
    and roles count as empty; a null conv_id is a conversation of its own; equal turn numbers are ordered by role, then
    text, and repeated rows stay. state is where the role automaton ends ('error' after a step it doesn't allow).
    A conversation is one row, so its formatted text must fit Spark's limit of 2 GB a value; turns are escaped before they meet.
    """
    t = template or Template()
    rows = pick(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ready = rows.select("conv_id", F.struct("turn", "role", "text", t.encode(F.col("role"), (t.sep,)).alias("er"), t.encode(F.col("text")).alias("et")).alias("x"))
    got = ready.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def parts(x: Column) -> Column:
        seg = lambda c, loss: F.struct(c.alias("content"), loss.alias("loss"))
        head = F.concat(F.lit(t.open), x["er"], F.lit(t.sep))
        return F.array(seg(head, F.lit(False)), seg(x["et"], x["role"].isin(*t.loss_roles)), seg(F.lit(t.close), F.lit(False)))

    state = _turn_state(t, F.transform("xs", lambda x: x["role"]))
    return got.select("conv_id", F.flatten(F.transform("xs", parts)).alias("segments"), state.alias("state"), state.isin(*t.final).alias("valid"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["content"]), "")


def parse_formatted(text: Column, template: Template | None = None) -> Column:
    """array<(role, text)> read back from a formatted text."""
    t = template or Template()
    pieces = F.split(text, re.escape(t.close), -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        body = F.substr(p, F.lit(len(t.open) + 1))
        at = F.locate(t.sep, body)
        return F.struct(t.decode(F.substr(body, F.lit(1), at - 1)).alias("role"), t.decode(F.substr(body, at + len(t.sep))).alias("text"))

    return F.transform(pieces, turn)
