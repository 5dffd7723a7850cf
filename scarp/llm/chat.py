"""Chat formatting with a grammar round trip.

Turns are rendered as `<|im_start|>role\\ntext<|im_end|>\\n`. A deterministic parser reads the
rendered text back; where it does not return the source turns, the conflicting turn is
escaped one level further until it does. Everything is a Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = "struct<role:string,text:string>"


def escape_text(text: Column) -> Column:
    """Put one more backslash into every `<|`, `<\\|`, ...; no `<|` is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles end at a line break, so this also writes line breaks as `\\n`."""
    for plain, written in (("\\", "\\\\"), ("\n", "\\n"), ("<|", "<\\p")):
        role = F.replace(role, F.lit(plain), F.lit(written))
    return role


def unescape_role(role: Column) -> Column:
    def single(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("<\\p"), F.lit("<|"))

    return F.array_join(F.transform(F.split(role, r"\\\\", -1), single), "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text; an element is null where the grammar is broken."""

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = F.substring(part, F.lit(1), at - 1)
        body = F.substring(part, at + 1, F.length(part) - at - len(END) - 1)
        sound = (at > 0) & F.endswith(part, F.lit(END + "\n")) & (F.length(part) >= at + len(END) + 1)
        sound = sound & ~F.contains(role, F.lit("<|")) & ~F.contains(body, F.lit("<|"))
        return F.when(sound, F.struct(unescape_role(role).alias("role"), unescape_text(body).alias("text")))

    parts = F.split(rendered, r"<\|im_start\|>", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, block (its rendering), level, start.

    `level` is how far the turn had to be escaped: 0 not at all, 1 its text, 2 its role too.
    `start` is the code point in the conversation at which the block begins. Null roles and
    texts are empty strings. Columns other than conv_id, turn, role and text are left out.
    """
    role, text = F.col("role"), F.col("text")
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    levels = (render_turn(role, text), render_turn(role, escape_text(text)), render_turn(escape_role(role), escape_text(text)))
    same = [parse(x).eqNullSafe(F.array(F.struct("role", "text")).cast(f"array<{_TURN}>")) for x in levels[:2]]
    plain = ~F.contains(text, F.lit("<")) & ~role.rlike(r"[<\\\n]")  # cannot conflict: spares the parser
    turns = turns.withColumn("level", F.when(plain | same[0], 0).when(same[1], 1).otherwise(2))
    level = F.col("level")
    block = F.when(level == 0, levels[0]).when(level == 1, levels[1]).otherwise(levels[2])
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("block", block).withColumn("start", F.coalesce(F.sum(F.length("block").cast("long")).over(before), F.lit(0)))


def format_chat(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Render every conversation and prove that it can be read back.

    conversations: conv_id, turn, role, text (more columns are ignored).
    Returns conv_id, formatted, turns (read back from `formatted`), loss_spans
    (start, length in code points of `formatted`, escapes included) and n_escaped.

    Turns are ordered by turn, role, text; equal rows are kept as often as they occur. Null
    turn numbers come first, null conv_ids form one conversation, an empty table gives no
    rows. One conversation becomes one row, so it must fit in a task's memory, as any
    training example must. If the parser did not return the source the query would fail.
    """
    blocks = format_turns(conversations)
    head = F.instr("block", "\n")
    span = F.when(
        F.col("role") == loss_role,
        F.struct((F.col("start") + head).alias("start"), (F.length("block") - head - len(END) - 1).cast("long").alias("length")),
    )
    blocks = blocks.withColumn("span", span)
    whole = blocks.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "block", "span", "level"))).alias("rows")
    )
    whole = whole.select(
        "conv_id",
        F.array_join(F.col("rows.block"), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
        F.filter("rows.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.size(F.filter("rows.level", lambda x: x > 0)).cast("long").alias("n_escaped"),
    )
    whole = whole.withColumn("turns", parse(F.col("formatted")))
    proved = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("conversation cannot be read back: "), F.col("conv_id").cast("string"))).cast(f"array<{_TURN}>")
    )
    return whole.select("conv_id", "formatted", proved.alias("turns"), "loss_spans", "n_escaped")


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of what format_chat() returned; the loss texts are cut from `formatted` by loss_spans and unescaped."""
    turns = F.col("turns")
    all_text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: unescape_text(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    loss = F.array_join(masked, "")
    return formatted.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(all_text, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
