"""Chat formatting: multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and the others as
named users; the mask has the spans to learn from, the speaker's own words with their end mark.

A row is a conversation from one perspective. Conversations of up to ``turns`` messages are whole, whatever their turns
are; longer ones are cut after every ``turns`` messages (a larger number makes them whole, at the price of a task that
holds one). Every part but the first begins with the conversation's first system message again, which isn't counted there.
A message's place among equal turns is by speaker, then by hash and text. Places come from counts of small groups and of
stretches of turns, so neither a turn which a third of all rows share nor a conversation which has them is one task's.

Defined cases: a null speaker is "unknown", a null text is empty; a null turn comes last, a null conversation is one
of its own; a system message is context, no participant; a conversation of system messages alone has no row;
repeated rows (of conversation, turn, speaker and text) are one message, counted in ``n_rows``; a mark inside a text
is broken up by a space; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

TURNS = 1024
SYSTEM = ("system",)
END = "<|end|>\n"


def _on(left: str, right: str, names: list[str]):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def spoken():
    """A message's text, in which no mark can stand."""
    return F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))


def placed(messages: DataFrame, turns: int = TURNS) -> DataFrame:
    """conv_id, part, place, turn, speaker, words, n: messages with their place in the conversation."""
    rows = messages.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        spoken().alias("words"),
    ).groupBy("conv_id", "turn", "speaker", "words").agg(F.count("*").alias("n"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / TURNS)).withColumn("digit", F.substring(F.md5("words"), 1, 2))
    fine = ["conv_id", "block", "turn", "speaker", "digit"]
    counts = rows.groupBy(*fine).agg(F.count("*").alias("size"))
    order = [F.col("turn").asc_nulls_last(), "speaker", "digit"]
    before = W.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    stretches = counts.groupBy("conv_id", "block").agg(F.sum("size").alias("size"))
    stretches = stretches.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    counts = counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    counts = counts.alias("c").join(stretches.alias("s"), _on("c", "s", ["conv_id", "block"])).select("c.*", "s.offset").withColumn("before", F.col("before") + F.col("offset"))
    nth = F.row_number().over(W.partitionBy(*fine).orderBy("words"))
    numbered = rows.withColumn("nth", nth).alias("m").join(counts.alias("c"), _on("m", "c", fine)).select("m.*", "c.before")
    place = F.col("before") + F.col("nth") - 1
    return numbered.select("conv_id", F.floor(place / turns).alias("part"), place.alias("place"), "turn", "speaker", "words", "n")


def rotated(messages: DataFrame, turns: int = TURNS, system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """conv_id, part, perspective, text, mask (start, end, ... in code points), n_messages, n_rows."""
    held = placed(messages, turns)
    context = F.col("speaker").isin(*system)
    people = messages.select("conv_id", F.coalesce("role", F.lit("unknown")).alias("speaker")).filter(~context).distinct()
    people = people.select("conv_id", F.col("speaker").alias("perspective"))
    both = held.alias("m").join(people.alias("p"), _on("m", "p", ["conv_id"])).select("m.*", "p.perspective")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(context, F.concat(F.lit("<|"), "speaker", F.lit("|>\n"))).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    said = F.struct(
        "place", F.concat(head, "words", F.lit(END)).alias("said"),
        F.when(own, F.char_length(head)).alias("learn"), (F.char_length(head) + F.char_length("words") + len(END)).alias("size"), "n",
    )
    parts = both.groupBy("conv_id", "part", "perspective").agg(F.array_sort(F.collect_list(said)).alias("said"))
    begun = contexts(messages, system).select(F.col("conv_id").alias("_conv"), "lead")
    parts = parts.join(begun, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("lead", F.when(F.col("part") > 0, F.coalesce("lead", F.lit(""))).otherwise(""))
    start = F.struct(F.char_length("lead").cast("long").alias("at"), F.array().cast("array<bigint>").alias("mask"))
    add = lambda s, x: F.struct(
        (s["at"] + x["size"]).alias("at"),
        F.when(x["learn"].isNull(), s["mask"]).otherwise(F.concat(s["mask"], F.array(s["at"] + x["learn"], s["at"] + x["size"]))).alias("mask"),
    )
    return parts.select(
        "conv_id", "part", "perspective",
        F.concat("lead", F.array_join(F.transform("said", lambda x: x["said"]), "")).alias("text"),
        F.aggregate("said", start, add)["mask"].alias("mask"),
        F.size("said").cast("long").alias("n_messages"),
        F.aggregate("said", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_rows"),
    )


def contexts(messages: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """conv_id and lead, its first system message as it is rendered."""
    speaker, words = F.coalesce("role", F.lit("unknown")), spoken()
    line = F.concat(F.lit("<|"), speaker, F.lit("|>\n"), words, F.lit(END))
    own = F.when(speaker.isin(*system), F.struct(F.col("turn").isNull().alias("none"), "turn", speaker.alias("speaker"), words.alias("words"), line.alias("line")))
    return messages.groupBy("conv_id").agg(F.min(own)["line"].alias("lead"))
