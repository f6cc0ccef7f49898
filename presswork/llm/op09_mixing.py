"""Mixing sources to target weights, with DataFrame functions only.

The tokens of each source are summed, targets are dealt out by weight up to a cap, and each document is repeated
floor(rate) times plus one copy drawn by its hash with the rate's fraction as probability.

Defined cases: a null text has size 0; a null source is one source, ordered last; a source of size 0 has target 0
and rate 0; repeated rows draw alike, since the draw depends on the id; an empty table gives an empty one. Other
columns pass through :func:`mixed`; a column of the same name as a helper's is kept, helpers start with ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, written

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all tokens that the mix takes, and the most times that a source is repeated.
SHARE, MOST = 1.5, 2
#: Draws that are tried for each source; the one whose sum is nearest to the target is used. 8 hex digits each.
DRAWS = 8


def size_of(text: str = "text") -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(key: str, k: int) -> Column:
    """A number from 0 to 1 from the k-th 8 hex digits of the hash of the key."""
    digits = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256), 1 + 8 * k, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target and rate.

    A common level rises until the sum of min(cap, weight * level) is the share; sources in the order of cap by
    weight are full one after the other. The table has one row for each source, so its windows are small.
    """
    total = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    table = (
        per_source.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size").cast("double") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum(F.col("source_size").cast("double")).over(total) * share)
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(total)["level"])
        .withColumn("target", F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return table.select("source", "source_size", "target", rate.alias("rate"))


def rates(sized: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """(key, source, size) -> one row for each source: source_size, target, rate and the draw to use."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(per_source, **how)
    fraction = F.col("rate") - F.floor("rate")
    drawn = (
        sized.join(found.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("_source", "source_size", "target", "rate")
        .agg(*[F.sum(F.when(draw(key, k) < fraction, F.col("size")).otherwise(0)).alias(f"extra{k}") for k in range(DRAWS)])
    )
    off = lambda k: F.abs(F.floor("rate") * F.col("source_size") + F.col(f"extra{k}") - F.col("target"))
    best = F.least(*[F.struct(off(k).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)])["k"]
    return drawn.select(F.col("_source").alias("_mix_source"), "source_size", "target", "rate", best.alias("draw"))


def copies(key: str = "doc_id") -> Column:
    """How often a document is taken, from rate and draw."""
    drawn = F.element_at(F.array(*[draw(key, k) for k in range(DRAWS)]), F.col("draw") + 1)
    return (F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def mixing_report(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """For each document: key, source, size, source_size, target, copies and taken."""
    sized = written(docs.select(key, "source", size_of().alias("size")), "sizes")
    per = rates(sized, key, **how)
    joined = sized.join(per, F.col("source").eqNullSafe(F.col("_mix_source")))
    return joined.withColumn("copies", copies(key)).select(
        key, "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns as they were."""
    sized = written(docs.select(key, "source", size_of().alias("size")), "sizes")
    per = rates(sized, key, **how).select("_mix_source", F.struct("rate", "draw").alias("_mix_plan"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    taken = (
        docs.join(per, F.col("source").eqNullSafe(F.col("_mix_source")))
        .select(*own, F.col("_mix_plan.rate").alias("_mix_rate"), F.col("_mix_plan.draw").alias("_mix_draw"))
    )
    drawn = F.element_at(F.array(*[draw(key, k) for k in range(DRAWS)]), F.col("_mix_draw") + 1)
    whole = F.floor("_mix_rate")
    times = (whole + F.when(drawn < F.col("_mix_rate") - whole, 1).otherwise(0)).cast("int")
    return taken.select(*own, F.explode(F.array_repeat(F.lit(0), times)).alias("_mix_copy")).drop("_mix_copy")
