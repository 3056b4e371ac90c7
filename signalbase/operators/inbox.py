"""Ranked queries over scored groups, and the evidence of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config


def inbox(groups: DataFrame, topic: str | None = None, priority: str | None = None, state: str | None = None, first: str | None = None, last: str | None = None, limit: int = 50) -> DataFrame:
    """Highest scores first, then urgency, then id; 'otros' is hidden.

    Only filters that are given become predicates; dates are inclusive.
    """
    rows = groups.where(F.col("topic") != config.OTHER)
    for column, value in (("topic", topic), ("priority", priority), ("evidence_state", state)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    day = F.col("last_ts").cast("date")
    if first is not None:
        rows = rows.where(day >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(day <= F.lit(last).cast("date"))
    return rows.orderBy(F.desc("score"), F.desc("U"), "group_id").limit(limit)


def generation_top(groups: DataFrame, least_items: int, limit: int) -> DataFrame:
    """Candidates for drafting: no urgency tie-break, all topics."""
    return groups.where(F.col("n_items") >= least_items).orderBy(F.desc("score"), "group_id").limit(limit)


def review_top(groups: DataFrame, limit: int = 20) -> DataFrame:
    return groups.orderBy(F.desc("score"), F.desc("U"), "group_id").limit(limit)


def filter_options(groups: DataFrame) -> DataFrame:
    """(first_day, last_day, topics, has_unverified) for the filter panel, one pass."""
    day = F.col("last_ts").cast("date")
    return groups.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"), (F.count_if(F.col("evidence_state") == "insuficiente") > 0).alias("has_unverified"))


def evidence(members: DataFrame, news: DataFrame, group: str | None = None) -> DataFrame:
    """Members' items in time order: publication, then detection, nulls last, then id."""
    rows = members.where(F.col("group_id") == group) if group is not None else members
    return rows.join(news, "id").orderBy("group_id", F.asc_nulls_last("published"), F.asc_nulls_last("detected"), "id")


def kpis(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("shown"), F.count_if(F.col("priority") == "alto").alias("high"), F.count_if(F.col("evidence_state") == "insuficiente").alias("insufficient"))
