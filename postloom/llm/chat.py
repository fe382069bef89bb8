"""Chat formatting: turns become text segments with loss flags, by a declarative template.

A finite-state machine over roles says whether the turn order holds; every conversation is
formatted, the verdict is a column.  Marks cannot be forged: wherever a control string occurs in a
text or a role, one backslash goes behind its first character (and one more where backslashes stand
there already), which reading takes out again.

Defined cases: a NULL text is empty, a NULL role is an empty role (no transition leads there, so
the order is broken); turns are ordered by (turn, role, text), NULL turns first, and repeated
rows stay; NULL ids form one conversation.  A conversation is one document and one row, so its
turns meet in one task; that is the format, not a limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles that are learned, allowed turn orders, other control strings."""

    open: str = "<|turn|>"
    between: str = "<|text|>"
    close: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    # (state, role) -> state; every state of ``final`` may be the last.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.open, self.between, self.close, *self.reserved)

    def pattern(self, slashes: str) -> str:
        """Control strings with backslashes behind the first character: that, those, the rest."""
        by_first: dict[str, list[str]] = {}
        for control in self.controls:
            by_first.setdefault(control[0], []).append(control[1:])
        kinds = [
            f"(?<={re.escape(first)})({slashes})(?={'|'.join(re.escape(r) for r in rests)})"
            for first, rests in by_first.items()
        ]
        return "|".join(kinds)


def escape(text: Column, template: Template) -> Column:
    groups = len({c[0] for c in template.controls})
    same = "".join(f"${i + 1}" for i in range(groups))  # at most one of them is not empty
    return F.regexp_replace(text, F.lit(template.pattern(r"\\*")), F.lit(same + r"\\"))


def unescape(text: Column, template: Template) -> Column:
    groups = len({c[0] for c in template.controls})
    same = "".join(f"${i + 1}" for i in range(groups))
    pattern = template.pattern("SLASHES").replace("(SLASHES)", r"\\(\\*)")
    return F.regexp_replace(text, F.lit(pattern), F.lit(same))


def _broken_at(roles: Column, template: Template) -> Column:
    """Position of the first turn that no move allows, counted from 1; 0 when the order holds."""
    state = struct_of(F.lit(template.start), F.lit(0), F.lit(0))

    def step(at: Column, role: Column) -> Column:
        to = F.lit(None).cast("string")
        for (state, wanted), target in template.moves.items():
            to = F.when((at["state"] == state) & (role == wanted), F.lit(target)).otherwise(to)
        here = at["seen"] + 1
        broken = F.when(at["broken"] > 0, at["broken"]).when(to.isNull(), here).otherwise(0)
        return struct_of(F.coalesce(to, F.lit("")), here, broken)

    def end(at: Column) -> Column:
        open_end = ~at["state"].isin(*template.final)
        return F.when(at["broken"] > 0, at["broken"]).when(open_end, at["seen"]).otherwise(0)

    return F.aggregate(roles, state, step, end)


def struct_of(state: Column, seen: Column, broken: Column) -> Column:
    return F.struct(
        state.cast("string").alias("state"),
        seen.cast("int").alias("seen"),
        broken.cast("int").alias("broken"),
    )


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments (text, loss), formatted, broken_at: one row per conversation."""
    template = template or Template()
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(turn: Column) -> Column:
        learned = turn["role"].isin(*template.learned)
        head = F.concat(
            F.lit(template.open), escape(turn["role"], template), F.lit(template.between)
        )
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(turn["text"], template), learned),
            segment(F.lit(template.close), F.lit(False)),
        )

    return chats.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        _broken_at(F.col("turns.role"), template).alias("broken_at"),
    ).select(
        "conv_id",
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
        "broken_at",
    )


def read_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``format_chats`` output with the turns (role, text) and the learned text read from it.

    ``turns`` comes from the formatted string alone, ``learned`` from the segments under loss.
    """
    template = template or Template()
    pieces = F.split("formatted", re.escape(template.close))

    def turn(piece: Column) -> Column:
        at = F.locate(template.between, piece)
        role = F.substring(piece, F.lit(len(template.open) + 1), at - len(template.open) - 1)
        text = F.substring(piece, at + len(template.between), F.length(piece))
        return F.struct(
            unescape(role, template).alias("role"), unescape(text, template).alias("text")
        )

    under_loss = F.filter("segments", lambda s: s["loss"])
    return formatted.withColumns(
        {
            "turns": F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn),
            "learned": F.array_join(F.transform(under_loss, lambda s: unescape(s["text"], template)), ""),
        }
    )


def digests(chats: DataFrame) -> DataFrame:
    """Sizes and digests of what ``read_chats`` found."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        (F.col("broken_at") == 0).alias("valid"),
    )
