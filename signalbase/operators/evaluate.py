"""Evaluation: classification metrics, rates, percentiles and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).cast("string").alias("truth"), F.col(predicted).cast("string").alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class of either side; 0 for 0 / 0."""
    cells = confusion(df, truth, predicted)
    sides = cells.select(F.col("truth").alias("label"), "n", F.col("n").alias("support"), F.lit(0).cast("long").alias("given"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"))
    other = cells.select(F.col("predicted").alias("label"), "n", F.lit(0).cast("long").alias("support"), F.col("n").alias("given"), F.lit(0).cast("long").alias("tp"))
    sums = sides.union(other).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "given", "tp")))
    p, r = F.coalesce(F.try_divide("tp", "given"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return sums.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return per_class(df, truth, predicted).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_classes"))


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("int"))


def rates(df: DataFrame, condition: Column, by: list[str], name: str) -> DataFrame:
    """The rate overall and by each column of ``by``, in one pass."""
    flagged = df.withColumn("_flag", condition.cast("int"))
    cube = flagged.groupingSets([[], *([F.col(c)] for c in by)], *by) if hasattr(flagged, "groupingSets") else flagged.cube(*by)
    return cube.agg(F.avg("_flag").alias(name), F.count("*").alias("n"))


CELLS = 4096


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Median and linearly interpolated 95th percentile, exact, and the number of values.

    Equal values are counted first; a group's range is cut into ``CELLS`` cells, whose
    counts tell which few cells hold the ranks asked for, and only their values are sorted.
    """
    keys = [F.col(b) for b in by]
    groups = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(F.col(value).cast("double")).alias("_lo"), F.max(F.col(value).cast("double")).alias("_hi"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    met = counts.join(groups, same(counts, groups)).select(*(counts[b] for b in by), "_v", "_c", "n", F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (CELLS - 1)), F.lit(0)).alias("_cell"))
    cells = met.groupBy(*by, "_cell", "n").agg(F.sum("_c").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = {name: (F.col("n") - 1) * F.lit(share) for name, share in (("median", 0.5), ("p95", 0.95))}
    # the ranks, from 0, on either side of each place
    ranks = F.array(*(f(x) for x in at.values() for f in (F.floor, F.ceil)))
    asked = cells.withColumn("_before", before).where(F.exists(ranks, lambda r: (F.col("_before") <= r) & (r < F.col("_before") + F.col("_in"))))
    asked = asked.select(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_cell").alias("_asked"), "_before")
    hit = reduce(lambda x, y: x & y, (F.col(b).eqNullSafe(F.col(f"_k{i}")) for i, b in enumerate(by)), F.col("_cell") == F.col("_asked"))
    rows = met.join(asked, hit)
    first = F.col("_before") + F.coalesce(F.sum("_c").over(Window.partitionBy(*by, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_first", first)
    holds = lambda r: F.max(F.when((F.col("_first") <= r) & (r < F.col("_first") + F.col("_c")), F.col("_v")))
    ends = [x for name, place in at.items() for x in (holds(F.floor(place)).alias(f"_{name}0"), holds(F.ceil(place)).alias(f"_{name}1"))]
    found = placed.groupBy(*by).agg(*ends)
    whole = groups.join(found, same(groups, found), "left")
    between = lambda name: (F.col(f"_{name}0") + (F.col(f"_{name}1") - F.col(f"_{name}0")) * (at[name] - F.floor(at[name]))).alias(name)
    return whole.select(*(groups[b] for b in by), between("median"), between("p95"), "n")


def verdict_validity(df: DataFrame, verdict: str, *by: str) -> DataFrame:
    good, bad, unsure = (F.count_if(F.col(verdict) == v) for v in ("si", "no", "ambiguo"))
    return df.groupBy(*by).agg(good.alias("valid"), bad.alias("invalid"), unsure.alias("ambiguous"), F.try_divide(good, good + bad + unsure).alias("validity"), F.try_divide(good, good + bad).alias("validity_decided"))


def monthly_sample(df: DataFrame, month: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows by equal quotas per month, the remainder to the earliest months.

    The order within a month is a seeded hash, so the sample repeats; it is a sampling
    operator, its limit is the feature.
    """
    months = df.select(month).distinct()
    ranked = months.crossJoin(F.broadcast(months.agg(F.count("*").alias("_m")))).withColumn("_i", F.row_number().over(Window.orderBy(month)))
    # as many rows as there are months
    quota = ranked.select(month, (F.floor(F.lit(size) / F.col("_m")) + (F.col("_i") <= F.lit(size) % F.col("_m")).cast("int")).alias("_q"))
    place = F.row_number().over(Window.partitionBy(month).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key))
    return df.withColumn("_n", place).join(F.broadcast(quota), month).where("_n <= _q").drop("_n", "_q")


def halves(df: DataFrame, order: str, step: int = 100_000) -> DataFrame:
    """Alternate rows, in the order of a whole number, to two halves.

    Rows are numbered within spans of ``step`` numbers, and spans by their counts, so no
    task numbers all rows.
    """
    rows = df.withColumn("_span", F.floor(F.col(order) / step))
    counts = rows.groupBy("_span").agg(F.count("*").alias("_n"))
    before = counts.select("_span", F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_span").orderBy(order)) - 1
    return rows.join(before, "_span").withColumn("half", (place % 2).cast("int")).drop("_span", "_before")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def precision_at(df: DataFrame, system: DataFrame, key: str, k: int) -> DataFrame:
    """Share of the system's first ``k`` that reviewers marked."""
    top = system.where(F.col("rank") <= k).select(key)
    return top.join(df.select(key, "chosen"), key, "left").agg(F.count_if(F.coalesce("chosen", F.lit(False))).alias("hits"), F.count("*").alias("n")).withColumn("precision", F.try_divide("hits", "n"))
