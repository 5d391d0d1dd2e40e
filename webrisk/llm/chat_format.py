"""Chat formatting: a role automaton and a declarative template that emits segments with loss flags.

Only DataFrame functions. Each conversation becomes one row: its turns in order, the segments that
make up the formatted text, each with a flag that says whether it is trained on, and what the automaton says.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), nulls first, so ties
and repeated rows are all kept; rows without conv_id form one conversation; an empty table gives none; any
role is formatted, but only the template's transitions are valid; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a conversation is written, which role may follow which, and which texts are trained on."""

    turn_open: str = "### "
    role_close: str = ": "
    turn_close: str = "</turn>\n"
    #: Escapes, applied in this order and undone in the reverse one. The first frees the escape sign itself, and no
    #: escaped text contains a control string, so a plain split at them reads the output back.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; the automaton starts in "start".
    transitions: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })
    final_states: tuple[str, ...] = ("user", "assistant")

    def escape(self, text: Column, role: bool = False) -> Column:
        for plain, safe in self.escapes + (self.role_escapes if role else ()):
            text = F.replace(text, F.lit(plain), F.lit(safe))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, safe in reversed(self.escapes + self.role_escapes):
            text = F.replace(text, F.lit(safe), F.lit(plain))
        return text


def format_chats(turns: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Per conversation: conv_id, segments (text, loss), formatted, valid, bad_turn (index of the first turn out of order)."""
    t = template or ChatTemplate()
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        segment(F.concat(F.lit(t.turn_open), t.escape(x["role"], role=True), F.lit(t.role_close)), F.lit(False)),
        segment(t.escape(x["text"]), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.turn_close), F.lit(False)))))
    table = F.create_map(*[F.lit(y) for (state, role), to in t.transitions.items() for y in (f"{state}>{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def step(acc, x):
        to = F.try_element_at(table, F.concat(acc["state"], F.lit(">"), x["role"]))
        return F.struct(
            F.coalesce(to, x["role"]).alias("state"), (acc["at"] + 1).alias("at"),
            F.when((acc["bad"] < 0) & to.isNull(), acc["at"]).otherwise(acc["bad"]).alias("bad"))

    run = F.aggregate("turns", start, step)
    return (
        talks.select("conv_id", segments.alias("segments"), run.alias("run"))
        .select("conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"),
                ((F.col("run.bad") < 0) & F.col("run.state").isin(*t.final_states)).alias("valid"),
                F.col("run.bad").alias("bad_turn")))


def read_chats(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """The turns of a formatted conversation, read back from its text: conv_id, turns (role, text)."""
    t = template or ChatTemplate()
    parts = F.split("formatted", "\\Q" + t.turn_close + "\\E", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x):
        rest = F.substr(x, F.lit(len(t.turn_open) + 1))
        cut = F.instr(rest, t.role_close)
        return F.struct(
            t.unescape(F.substr(rest, F.lit(1), cut - 1)).alias("role"),
            t.unescape(F.substr(rest, cut + len(t.role_close))).alias("text"))

    return formatted.withColumn("turns", F.transform(parts, turn))
