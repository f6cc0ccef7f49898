r"""Quality rules: base statistics of each text and robust multivariate outliers, with DataFrame functions only.

Words are ``[^\x20\x09-\x0D]+``. The statistics of a text that passes the base rules form a transformed vector;
for each language and source a minimum-covariance-determinant estimate is fitted to the vectors by concentration
steps, and texts whose Mahalanobis distance is too large are rejected. All groups are fitted at once by grouped
sums, so a hot group costs one pre-aggregated row for each task.

Estimates are fitted at three levels, language and source, language, and all texts, and each is drawn towards the
next coarser one: that of n vectors has the weight n / (n + ``prior``) and the coarser one the rest. So a small group
is judged by its language almost alone, a large one by itself, and no number of vectors is a switch.

Defined cases: a null or empty text has no words and fails the base rules; a null language or source is a group of
its own; repeated rows and ties count
as often as they occur; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import SPACE, written

#: Positions take the low bits of a packed window, its hash the high ones.
POSITION_BITS = 24
#: Names of the transformed statistics.
DIMS = ("log_words", "word_length", "symbols", "dup_lines", "repeats")
#: Least standard deviation of each, so that a statistic which is constant in a group doesn't reject on its own noise.
FLOORS = (0.5, 0.35, 0.35, 0.5, 0.5)
#: Share of a group that the estimate rests on, concentration steps, and the squared distance that is still kept.
SUBSET, STEPS, CUTOFF = 0.75, 3, 60.0
#: How many vectors of its own a group needs to weigh as much as the coarser level.
PRIOR = 40
#: Columns of a group; of groups at every level (0: language and source, 1: language, 2: all).
GROUP, LEVELS = ("lang", "source"), ("level", "lang", "source")


def base_statistics(docs: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ("lang", "source"), position_bits: int = POSITION_BITS) -> DataFrame:
    """key, kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows: each window is hashed, and where all hashes differ nothing is repeated. Else each hash and its
    place are packed into one number, the numbers are sorted, and neighbours of equal hash and equal words are repeats.
    Where neighbours of equal hash have different words, or places don't fit, the windows themselves are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    low = (1 << position_bits) - 1
    words = F.array_remove(F.split(text, SPACE), "")
    step = docs.select(
        key, *keep,
        words.alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashes = F.when(F.size("w") > 3, F.transform(F.slice("w", 1, F.size("w") - 2), lambda a, i: F.xxhash64(a, F.get("w", i + 1), F.get("w", i + 2))))
    step = step.select(key, *keep, "w", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("h"))
    step = step.withColumn("twice", F.coalesce(F.size(F.array_distinct("h")) < F.size("h"), F.lit(False)))
    packed = F.when(
        F.col("twice") & (F.size("w") <= low + 1),
        F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))),
    ).otherwise(F.array().cast("array<bigint>"))
    step = step.select(key, *keep, "w", "n_symbols", "n_dup_lines", "twice", packed.alias("p"))
    apart = lambda x, y: F.coalesce(x.bitwiseXOR(y).between(0, low), F.lit(False))
    near = F.filter("p", lambda x, i: apart(x, F.get("p", i + 1)) | apart(x, F.get("p", i - 1)))
    step = step.select(key, *keep, "w", "n_symbols", "n_dup_lines", "twice", near.alias("p"))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    same = lambda x, y: reduce(lambda a, b: a & b, [F.get("w", at(x) + k).eqNullSafe(F.get("w", at(y) + k)) for k in range(3)])
    sure = F.filter("p", lambda x, i: (apart(x, F.get("p", i + 1)) & same(x, F.get("p", i + 1))) | (apart(x, F.get("p", i - 1)) & same(x, F.get("p", i - 1))))
    step = step.select(key, *keep, "w", "n_symbols", "n_dup_lines", "twice", F.size("p").alias("n_near"), sure.alias("p"))
    unsure = (F.size("p") < F.col("n_near")) | (F.col("twice") & (F.size("w") > low + 1))
    window = lambda a, i: F.struct(F.concat_ws(" ", a, F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i"))
    step = step.select(key, *keep, "w", "n_symbols", "n_dup_lines", "p", F.when(unsure, F.array_sort(F.transform(F.slice("w", 1, F.size("w") - 2), window))).alias("g"))
    like = F.filter("g", lambda x, i: F.coalesce(x["g"] == F.get("g", i + 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("g", i - 1)["g"], F.lit(False)))
    places = F.sort_array(F.when(F.col("g").isNull(), F.transform("p", lambda x: at(x))).otherwise(F.transform(like, lambda x: x["i"])))
    step = step.select(key, *keep, "w", "n_symbols", "n_dup_lines", places.alias("p"))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda s, x: s + x)
    return step.select(
        key, *keep,
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines",
        covered.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics: logarithms of counts and of rates, which are near to symmetric in clean text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.col("word_chars") / n,
        F.log1p(F.col("n_symbols") * 200 / n),
        F.log1p(F.col("n_dup_lines") * 200 / n),
        F.log1p(F.col("n_repeat_words") * 20 / n),
    ]


def _moments(rows: DataFrame, share: Column, by: list[str]) -> DataFrame:
    """One row for each group (with its start) of the share of its vectors that have the least d2: n (of the whole
    group), means m*, covariances c** with the floors on the diagonal, l**, log_det.

    Sums are gathered for each bin of log d2 (64 bins to a doubling), and those of the nearest bins are added up: the
    edge is the same however the rows are dealt, and no row is read or joined again.
    """
    d = range(len(DIMS))
    pairs = [(i, j) for i in d for j in range(i + 1)]
    names = [f"m{i}" for i in d] + [f"q{i}{j}" for i, j in pairs]
    sums = [f"sum(v{i}) as m{i}" for i in d] + [f"sum(v{i} * v{j}) as q{i}{j}" for i, j in pairs]
    bins = rows.groupBy(*by, F.expr("floor(log2(greatest(d2, 1e-9D)) * 64) as bin")).agg(F.expr("count(*) as k"), *map(F.expr, sums))
    upto = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = bins.withColumns({"upto": F.sum("k").over(upto), "n": F.sum("k").over(whole)}).filter(F.col("upto") - F.col("k") < F.ceil(F.col("n") * share))
    held = near.groupBy(*by).agg(F.first("n").alias("n"), *[F.expr(f"sum({c}) / sum(k) as {c}") for c in names])
    spread = [f"q{i}{j} - m{i} * m{j} as c{i}{j}" if i != j else f"greatest(q{i}{i} - m{i} * m{i}, 0D) + {FLOORS[i] ** 2}D as c{i}{i}" for i, j in pairs]
    return _triangle(held.selectExpr(*by, "n", *[f"m{i}" for i in d], *spread))


def _triangle(rows: DataFrame) -> DataFrame:
    """The lower triangle l** with l l' = c, and log_det: one column after the other."""
    d = range(len(DIMS))
    for j in d:
        inner = "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        rows = rows.selectExpr("*", f"sqrt(greatest(c{j}{j}{inner}, {FLOORS[j] ** 2 * 0.01}D)) as l{j}{j}")
        below = [f"(c{i}{j}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} as l{i}{j}" for i in range(j + 1, len(DIMS))]
        rows = rows.selectExpr("*", *below)
    return rows.selectExpr("*", f"2 * ({' + '.join(f'ln(l{i}{i})' for i in d)}) as log_det")


def _distance(of: str = "e") -> Column:
    """Squared Mahalanobis distance by solving l y = v - m from the top."""
    y: list[str] = []
    for i in range(len(DIMS)):
        rest = "".join(f" - {of}.l{i}{k} * {y[k]}" for k in range(i))
        y.append(f"((v{i} - {of}.m{i}{rest}) / {of}.l{i}{i})")
    return F.expr(" + ".join(f"{x} * {x}" for x in y))


def _with(rows: DataFrame, table: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """rows with the group's row of ``table`` as struct e; null groups meet too."""
    side = table.select(*[F.col(c).alias(f"_{c}") for c in by], F.struct(*[c for c in table.columns if c not in by]).alias("e"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return rows.join(side, on, how).drop(*[f"_{c}" for c in by])


def estimates(vectors: DataFrame, subset: float = SUBSET, steps: int = STEPS, group: tuple[str, ...] = GROUP) -> DataFrame:
    """(group, v0..) -> one row for each group: n, m*, c**, l**.

    Two starts: the vectors nearest to the median in units of the median deviation, and a half drawn by hash. Each
    is concentrated ``steps`` times; the one with the least determinant is the group's estimate.
    """
    by, started = list(group), [*group, "start"]
    d = range(len(DIMS))
    vs = [f"v{i}" for i in d]
    mid = vectors.groupBy(*by).agg(*[F.expr(f"percentile_approx(v{i}, 0.5D, 1000) as a{i}") for i in d])
    placed = _with(vectors, written(mid, "medians"), by).selectExpr(*by, *vs, *[f"abs(v{i} - e.a{i}) as u{i}" for i in d])
    wide = placed.groupBy(*by).agg(*[F.expr(f"percentile_approx(u{i}, 0.5D, 1000) as s{i}") for i in d])
    far = F.expr(" + ".join(f"pow(u{i} / greatest(e.s{i} * 1.4826D, {FLOORS[i]}D), 2D)" for i in d))
    drawn = (F.pmod(F.xxhash64(*vs), F.lit(1000)) + 1).cast("double")
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), d2.alias("d2")) for k, d2 in enumerate((far, drawn))])).alias("s")
    first = _with(placed, written(wide, "deviations"), by).select(*by, *vs, starts).select(*by, *vs, "s.*")
    found = written(_moments(first, F.when(F.col("start") == 0, subset).otherwise(0.5), started), "moments")
    both = vectors.select(*by, *vs, F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    for _ in range(steps):
        found = written(_moments(_with(both, found, started).select(*started, *vs, _distance().alias("d2")), F.lit(subset), started), "moments")
    best = F.min_by(F.struct(*[c for c in found.columns if c not in (*started, "log_det")]), F.struct("log_det", "start"))
    return found.groupBy(*by).agg(best.alias("f")).select(*by, "f.*")


def levelled(vectors: DataFrame) -> DataFrame:
    """The vectors with the groups of every level."""
    none = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source"))
    levels = F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), none), level(2, none, none))
    vs = [c for c in vectors.columns if c not in GROUP]
    return vectors.select(F.explode(levels).alias("g"), *vs).select("g.*", *vs)


def shrunk(found: DataFrame, prior: float = PRIOR) -> DataFrame:
    """The estimates of all levels -> (lang, source) with m*, l**, each level drawn towards the next coarser one."""
    numbers = [c for c in found.columns if c[0] in "mc"]
    level = lambda k: found.filter(F.col("level") == k)
    own = F.col("n") / (F.col("n") + F.lit(float(prior)))
    mixed = [f"own * {c} + (1 - own) * e.{c} as {c}" for c in numbers]
    langs = _with(level(1).withColumn("all", F.lit(2)), level(2).select(F.col("level").alias("all"), *numbers), ["all"]).withColumn("own", own).selectExpr("lang", *mixed)
    groups = _with(level(0).select(*GROUP, "n", *numbers), langs, ["lang"]).withColumn("own", own).selectExpr(*GROUP, *mixed)
    return _triangle(groups)


def quality_rules(docs: DataFrame, key: str = "doc_id", cutoff: float = CUTOFF, prior: float = PRIOR, **how) -> DataFrame:
    """key, the five statistics, base_failed, distance (null where the base rules failed) and kept."""
    stats = base_statistics(docs, key).withColumn("base_failed", base_failed())
    rows = written(stats.select("*", *[v.alias(f"v{i}") for i, v in enumerate(vector())]), "statistics")
    vectors = rows.filter(~F.col("base_failed")).select(*GROUP, *[f"v{i}" for i in range(len(DIMS))])
    table = written(shrunk(estimates(levelled(vectors), group=LEVELS, **how), prior), "estimates")
    judged = _with(rows, table, list(GROUP), "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= cutoff)
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", F.coalesce(kept, F.lit(False)).alias("kept"))
