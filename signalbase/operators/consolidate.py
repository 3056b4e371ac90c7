"""Merging captures of one item from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_by_key(df: DataFrame, key: str, seq: str, priority: str, first: list[str], best: list[str], sets: list[str], least: list[str]) -> DataFrame:
    """One row per key from rows in arrival order ``seq``.

    first: the earliest non-null value; best: that of the smallest ``priority``, the
    earliest of equals; sets: the sorted distinct parts of pipe-joined texts, joined
    again; least: the minimum. One aggregation, no collected groups but of set parts.
    """
    some = lambda c, *by: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct(*by)))
    exprs: list[Column] = [some(c, seq).alias(c) for c in first] + [some(c, priority, seq).alias(c) for c in best]
    exprs += [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(c, r"\|"))))), "|").alias(c) for c in sets]
    exprs += [F.min(c).alias(c) for c in least] + [F.count("*").alias("n_merged")]
    return df.groupBy(key).agg(*exprs)


def source_priority(origin: Column, order: tuple[str, ...]) -> Column:
    """The best place in ``order`` of any part of a pipe-joined origin."""
    place = F.array(*(F.lit(o) for o in order))
    at = F.transform(F.split(origin, r"\|"), lambda o: F.coalesce(F.nullif(F.array_position(place, o), F.lit(0)), F.lit(len(order) + 1)))
    return F.array_min(at)


def outlet_summary(df: DataFrame, outlet: str, origin: str, lang: str) -> DataFrame:
    """Items, origins and languages of each outlet, most items first."""
    parts = df.select(outlet, F.explode(F.split(origin, r"\|")).alias("o"), lang)
    sets = parts.groupBy(outlet).agg(F.array_join(F.array_sort(F.collect_set("o")), "|").alias("origins"), F.array_join(F.array_sort(F.collect_set(lang)), "|").alias("languages"))
    return df.groupBy(outlet).agg(F.count("*").alias("n_items")).join(sets, outlet).orderBy(F.desc("n_items"), outlet)
