"""Preference formatting of chat conversations; DataFrame functions only.

A chosen and a rejected conversation share a prompt: their longest common prefix of turns, rendered once. What follows it in
either is a completion, with the character spans of it that are trained on: the assistant's words and the mark that ends its
turn. Everything else of a completion (headers, other roles) is masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_hot, materialise

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def conversation_arrays(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns by number, then role and text; null numbers come first.

    A null role reads ``unknown``, a null text is empty. Rows without a conversation's id belong to none and are left out.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from their start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def render(turns: Column) -> Column:
    head, tail = HEAD.split("{}"), TAIL
    one = lambda t: F.concat(F.lit(head[0]), t["role"], F.lit(head[1]), t["text"], F.lit("\n" + tail))
    return F.array_join(F.transform(turns, one), "")


def trained_spans(turns: Column) -> Column:
    """Character spans [start, end) of the rendered turns that are trained on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(held: Column, t: Column) -> Column:
        text = held["at"] + len(HEAD) - 2 + F.length(t["role"])
        end = text + F.length(t["text"]) + 1 + len(TAIL)
        # up to the end mark; the line break after it is layout
        span = F.struct(text.cast("int").alias("start"), (end - 1).cast("int").alias("end"))
        spans = F.when(t["role"] == ASSISTANT, F.array_append(held["spans"], span)).otherwise(held["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda held: held["spans"])


OUT = ("prefix_turns", "prompt", "chosen_completion", "rejected_completion", "chosen_spans", "rejected_spans")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``chosen`` and ``rejected`` (arrays of (role, text) turns) formatted; other columns stay.

    Adds prefix_turns, prompt, chosen_completion, rejected_completion, and for each completion its trained spans; columns of
    those names are replaced. Equal conversations have empty completions; conversations that differ from the first turn on have an
    empty prompt. A null conversation counts as one without turns. Repeated rows stay repeated; texts are whole, however long.
    """
    none = F.array().cast("array<struct<role: string, text: string>>")
    names = [c for c in pairs.columns if c not in ("chosen", "rejected", *OUT)]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names]).alias("row")  # so that no name can clash
    held = pairs.select(row, F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b"))
    held = held.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n")))
    held = held.select("row", "n", F.slice("a", F.lit(1), F.col("n")).alias("prefix"), rest("a").alias("a"), rest("b").alias("b"))
    made = (F.col("n"), render(F.col("prefix")), render(F.col("a")), render(F.col("b")), trained_spans(F.col("a")), trained_spans(F.col("b")))
    return held.select(*[F.col(f"row.`{c}`") for c in names], *[c.alias(name) for c, name in zip(made, OUT, strict=True)])


#: Conversations of one opening that are put in order in one task, about; as many without a common opening.
CIRCLE = 512


def _draw(seed: str, key: Column) -> Column:
    """A number from 0 to 2^32 - 1 that follows from a seed and a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"))), 1, 8), 16, 10).cast("long")


def partnered_pairs(turns: DataFrame, circle: int = CIRCLE) -> DataFrame:
    """(conv_id, partner, chosen, rejected): a table without rejected replies made into preference pairs.

    Each conversation with an assistant turn is chosen once. Those that open with the same turn stand in circles, in a seeded
    order, and the next in the circle, whole, is rejected. The others stand in circles too: rejected is a conversation up to
    one of its assistant turns, drawn by its id, and what the next one says from such a turn of its own on. Large groups make
    several circles, and a table with one such conversation pairs it with itself. A conversation without an assistant turn
    has nothing to train on and makes no pair.
    """
    rows = conversation_arrays(turns)
    told = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == ASSISTANT, i)), lambda i: i.isNotNull())
    rows = rows.withColumn("told", told).filter(F.size("told") > 0)
    branch = F.element_at("told", (_draw("branch", F.col("conv_id")) % F.size("told") + 1).cast("int"))
    opening = F.md5(F.concat_ws("\n", *[F.element_at("turns", 1)[c] for c in ("role", "text")]))
    rows = rows.select("conv_id", "turns", branch.alias("branch"), opening.alias("opening"))

    keys = materialise(rows.select("conv_id", "opening"), "openings")
    sizes = materialise(keys.groupBy("opening").agg(F.count(F.lit(1)).alias("n")), "opening-sizes")
    alone = sizes.filter("n = 1").count()
    # an opening of its own: no group, but part of the one of all such
    sized = join_hot(keys, sizes.withColumn("size", F.col("n")), "opening", "n")
    lone = F.col("size") == 1
    circles = F.ceil(F.when(lone, F.lit(alone)).otherwise(F.col("size")) / circle)
    order = _draw("order", F.col("conv_id"))
    placed = sized.select(
        "conv_id", lone.alias("lone"), F.when(lone, F.lit("")).otherwise(F.col("opening")).alias("group"),
        (_draw("circle", F.col("conv_id")) % circles).alias("circle"), order.alias("at"),
    )
    w = Window.partitionBy("group", "circle").orderBy("at", "conv_id")
    round_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    partner = F.coalesce(F.lead("conv_id").over(w), F.first("conv_id").over(round_))
    met = placed.select("conv_id", "lone", partner.alias("partner"))

    other = rows.select(F.col("conv_id").alias("partner"), F.col("turns").alias("theirs"), F.col("branch").alias("their_branch"))
    met = met.join(rows.select("conv_id", F.col("turns").alias("chosen"), "branch"), "conv_id").join(other, "partner")
    tail = F.slice("theirs", F.col("their_branch") + 1, F.size("theirs") - F.col("their_branch"))
    swapped = F.concat(F.slice("chosen", F.lit(1), F.col("branch")), tail)
    return met.select("conv_id", "partner", "chosen", F.when(F.col("lone"), swapped).otherwise(F.col("theirs")).alias("rejected"))
