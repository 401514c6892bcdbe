"""Chat formatting: a state machine checks the order of roles; a template makes segments of text with loss flags.

Only DataFrame functions. A conversation is one training example, and so one row once it is formatted.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What escapes a control string; a template's control strings may not hold it as their second character.
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """A turn is begin, role, middle, text, end; texts of the learnt roles bear the loss.

    All control strings begin with the same two different characters, which they hold nowhere else, so that a text
    that never has those two side by side holds no control string.
    """

    begin: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = (self.begin, self.middle, self.end)
        opener = self.begin[:2]
        sound = len(opener) == 2 and opener[0] != opener[1] and ESCAPE not in opener and len(set(marks)) == 3
        sound = sound and all(m.startswith(opener) and m.count(opener) == 1 and m[-1] != opener[0] for m in marks)
        if not sound or any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError(f"these control strings cannot be told from escaped text: {marks}")

    def escaped(self, text: Column) -> Column:
        """One ESCAPE more between the opening characters, wherever any number of them stands there."""
        a, b = self.begin[:2]
        return F.regexp_replace(text, f"{re.escape(a)}({re.escape(ESCAPE)}*){re.escape(b)}", f"{_plain(a)}$1{_plain(ESCAPE + b)}")

    def unescaped(self, text: Column) -> Column:
        a, b = self.begin[:2]
        return F.regexp_replace(text, f"{re.escape(a)}({re.escape(ESCAPE)}*){re.escape(ESCAPE)}{re.escape(b)}", f"{_plain(a)}$1{_plain(b)}")


def _plain(text: str) -> str:
    """A replacement that stands for itself."""
    return re.sub(r"([\\$])", r"\\\1", text)


@dataclass(frozen=True)
class Machine:
    """States (not empty) and the roles that lead from one to the next; any other role ends the order. A conversation is whole in a state of accepts."""

    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked", "tool": "asked"},
        }
    )
    start: str = "start"
    accepts: tuple[str, ...] = ("answered",)

    def run(self, roles: Column) -> Column:
        """struct<state, n_ok>: the state after the roles in order, empty once one did not fit, and how many fitted before that."""
        arcs = [(F.concat_ws("\n", F.lit(s), F.lit(r)), F.lit(t)) for s, to in self.moves.items() for r, t in to.items()]
        table = F.create_map(*[x for arc in arcs for x in arc])

        def step(at: Column, role: Column) -> Column:
            to = F.coalesce(F.try_element_at(table, F.concat(at["state"], F.lit("\n"), role)), F.lit(""))
            return F.struct(to.alias("state"), (at["n_ok"] + F.when(to != "", 1).otherwise(0)).cast("long").alias("n_ok"))

        return F.aggregate(roles, F.struct(F.lit(self.start).alias("state"), F.lit(0).cast("long").alias("n_ok")), step)


def format_conversations(turns: DataFrame, template: Template = Template(), machine: Machine = Machine()) -> DataFrame:  # noqa: B008
    """(conv_id, n_ok, valid, segments): one row for each conversation; segments: array<struct<text, loss>>, whose texts
    side by side are the formatted conversation.

    n_ok: turns in order from the first; valid: all are, and the last state is accepted. Every conversation is formatted,
    valid or not. turns: conv_id, turn, role, text; other columns are ignored. Turns go by turn (nulls first), ties by role
    and text; repeated rows are turns of their own; null text is empty, a null role is empty and fits nowhere; null ids
    are one conversation. No rows: no conversations.
    """
    said = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("turns"))

    def segments(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(template.begin), template.escaped(role), F.lit(template.middle))
        return F.array(piece(head, F.lit(False)), piece(template.escaped(t["text"]), role.isin(*template.learnt)), piece(F.lit(template.end), F.lit(False)))

    run = whole.select("conv_id", "turns", machine.run(F.transform("turns", lambda t: t["role"])).alias("run"))
    valid = F.col("run.state").isin(*machine.accepts)
    return run.select("conv_id", F.col("run.n_ok").alias("n_ok"), valid.alias("valid"), F.flatten(F.transform("turns", segments)).alias("segments"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """formatted with: formatted (the text), turns (array<struct<role, text>>, found by the control strings alone) and learnt
    (the texts under the loss mask, in order), all unescaped.

    A text that no control string begins has no turns.
    """
    quoted = lambda mark: re.sub(r"([^A-Za-z0-9])", r"\\\1", mark)

    def turn(piece: Column) -> Column:
        parts = F.split(piece, quoted(template.middle), 2)
        text = F.split(F.get(parts, F.lit(1)), quoted(template.end), 2)
        return F.struct(template.unescaped(F.get(parts, F.lit(0))).alias("role"), template.unescaped(F.get(text, F.lit(0))).alias("text"))

    whole = formatted.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    pieces = F.split("formatted", quoted(template.begin))
    under = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescaped(s["text"]))
    return whole.withColumn("turns", F.transform(F.slice(pieces, 2, F.size(pieces)), turn)).withColumn("learnt", under)
