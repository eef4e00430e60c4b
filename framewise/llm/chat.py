"""Chat formatting from a declarative template, in DataFrame functions only.

A conversation's turns, in order, run through a finite-state machine over roles. Each turn gives three
segments: an opening marker, the escaped text and a closing marker; only the texts of the template's loss
roles count towards the loss. Escaped texts hold no character a marker starts with, so the formatted
string can be cut at markers again and the texts restored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """open + role + middle + text + close per turn. ``escapes`` are applied in order to texts and roles; each maps a
    character to the escape character and a letter of its own, the escape character first."""

    open: str = "### "
    middle: str = ": "
    close: str = "</turn>\n"
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role without an entry is an error
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = {s[0] for s in (self.open, self.middle, self.close)}
        if self.escapes[0][0] != self.escapes[0][1][0] or not marks <= {c for c, _ in self.escapes}:
            raise ValueError("the escape character must come first, and the first character of each marker must be escaped")


def escape(text: Column, template: Template) -> Column:
    for char, code in template.escapes:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column, template: Template) -> Column:
    """Every escape character of an escaped text starts a code, so codes can be replaced one kind at a time, the escape character's own last."""
    for char, code in reversed(template.escapes):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def run_machine(roles: Column, template: Template) -> Column:
    """struct(state, error_at): the last state, or 'error' and the first turn (from 1) whose role had no move."""
    moves = F.create_map(*[F.lit(x) for s, to in template.moves.items() for r, t in to.items() for x in (f"{s}>{r}", t)])

    def step(acc, role):
        to = F.try_element_at(moves, F.concat_ws(">", acc["state"], role))
        bad = (acc["state"] == "error") | to.isNull()
        return F.struct(
            F.when(bad, "error").otherwise(to).alias("state"), (acc["at"] + 1).alias("at"),
            F.when(bad & acc["error_at"].isNull(), acc["at"] + 1).otherwise(acc["error_at"]).alias("error_at"),
        )

    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("error_at"))
    return F.aggregate(roles, start, step)


def format_chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, n_turns, valid, error_at, segments (array of text and loss) and formatted, a row per conversation.

    Turns are ordered by turn, ties by role and text, nulls first; repeated rows are turns of their own. Null roles
    and texts count as empty; rows of null conv_id form one conversation of null id. Invalid conversations are
    formatted too and marked. Extra columns are not read. A conversation is one row of the result, so its texts meet
    in one task: that is what its digest and its formatted string need.
    """
    t = template or Template()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    machine = run_machine(F.transform("turns", lambda x: x["role"]), t)

    def segments(x):
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.middle)), F.lit(False)),
            part(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
            part(F.lit(t.close), F.lit(False)),
        )

    made = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), machine.alias("machine"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.select(
        "conv_id", "n_turns", F.col("machine.state").isin(*t.final).alias("valid"), F.col("machine.error_at").alias("error_at"),
        "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Adds turns (array of role and text), read from ``formatted``, and loss_text, from the segments under the loss mask."""
    t = template or Template()
    quote = lambda s: "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in s)
    pieces = F.split("formatted", quote(t.close), -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p):
        rest = F.substring(p, F.lit(len(t.open) + 1), F.length(p))
        at = F.instr(rest, t.middle)
        return F.struct(
            unescape(F.substring(rest, F.lit(1), at - 1), t).alias("role"),
            unescape(F.substring(rest, at + len(t.middle), F.length(rest)), t).alias("text"),
        )

    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t)), "")
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", loss)
