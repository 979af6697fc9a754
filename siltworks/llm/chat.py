"""Chat formatting: a finite-state machine over roles and a template of segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles whose text counts for the loss, and which role may follow which.

    A turn is start, role, a line feed, text, end. The key "" of `follows` has the roles that
    may begin, `last` those that may end. Marks begin with the two characters of `guard`,
    which escaping keeps out of texts and roles.
    """

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    guard: str = "<|"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    last: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escaped(text: Column, template: Template = DEFAULT, line: bool = False) -> Column:
    """text without the guard: a backslash is doubled and one put into each guard; in a line, feeds are \\/."""
    a, b = template.guard
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(a + b), F.lit(a + "\\" + b))
    return F.replace(out, F.lit("\n"), F.lit("\\/")) if line else out


def unescaped(text: Column, template: Template = DEFAULT) -> Column:
    """What escaped() was given. Doubled backslashes are set aside first, then the others mean something."""
    b = template.guard[1]
    parts = F.split(text, r"\\\\", -1)

    def one(p: Column) -> Column:
        return F.replace(F.replace(p, F.lit("\\" + b), F.lit(b)), F.lit("\\/"), F.lit("\n"))

    plain = F.transform(parts, one)
    return F.array_join(plain, "\\")


def formatted(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Rows (conv_id, segments, formatted, valid, bad_turn), one for each conv_id of rows(conv_id, turn, role, text).

    segments are structs (text, loss), whose texts make `formatted`; valid says whether the
    machine took all turns and may stop after the last, bad_turn is the first position (from 0)
    that it didn't take, or the number of turns if only the end is wrong. All turns are
    formatted either way, in order of turn, ties by role and text, rows without a turn first.
    Null roles and texts count as empty; a null conv_id is a conversation. Other columns
    aren't read; an empty table gives no rows. The output has a row for a conversation, so a
    conversation must fit into a task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(
        F.col("text").cast("string"), F.lit("")
    )
    turn = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def written(t: Column) -> Column:
        def segment(value: Column, loss: Column) -> Column:
            return F.struct(value.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.start), escaped(t["role"], template, line=True), F.lit("\n"))
        trained = t["role"].isin(*template.trained)
        said = segment(escaped(t["text"], template), trained)
        return F.array(segment(head, F.lit(False)), said, segment(F.lit(template.end), F.lit(False)))

    moves = F.array(*(F.lit(f"{a}\n{b}") for a, ends in template.follows.items() for b in ends))

    def step(state: Column, t: Column) -> Column:
        ok = F.array_contains(moves, F.concat(state["role"], F.lit("\n"), t["role"]))
        bad = F.when(state["bad"].isNull() & ~ok, state["n"]).otherwise(state["bad"])
        return F.struct(t["role"].alias("role"), (state["n"] + 1).alias("n"), bad.alias("bad"))

    begin = F.struct(F.lit("").alias("role"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))
    state = F.aggregate("turns", begin, step)
    seen = talks.select("conv_id", F.flatten(F.transform("turns", written)).alias("segments"), state.alias("state"))
    ended = F.col("state.bad").isNull() & F.col("state.role").isin(*template.last)
    return seen.select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        ended.alias("valid"),
        F.when(ended, None).otherwise(F.coalesce("state.bad", "state.n")).alias("bad_turn"),
    )


def turns_of(text: Column, template: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted text, read back from it."""
    parts = F.split(text, "\\Q" + template.start + "\\E", -1)
    end = template.end

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        body = F.substr(part, at + 1, F.length(part) - at - len(end))
        role = unescaped(F.substr(part, F.lit(1), at - 1), template)
        return F.struct(role.alias("role"), unescaped(body, template).alias("text"))

    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def digest(talks: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """What the output of formatted() says, read back: the turns from the text, the loss from the flags,
    and what the state machine made of the roles."""
    trained = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template))
    turns = turns_of(F.col("formatted"), template).alias("turns")
    read = talks.select("conv_id", "formatted", turns, F.array_join(trained, "").alias("loss"), "valid", "bad_turn")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
