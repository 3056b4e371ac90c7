"""News from several scans: one bag, one row per page, exclusions with reasons, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import consolidate, quality

FIELDS = ("title", "url", "outlet", "lang", "published", "detected", "extracted", "topic", "origin", "scope")
# fixed values: origins, the most trusted first, and reasons to leave an item out
ORIGINS = ("tvn_rss", "tvn_sitemap", "gdelt")
OUT_OF_INTERVAL = "fuera_de_intervalo"


def union_scans(*scans: tuple[DataFrame, str]) -> DataFrame:
    """All rows of (scan, column of its order), with ``seq``: scans one after the other,
    each in its order. Columns that a scan lacks are null."""
    ranked = [scan.withColumn("seq", F.struct(F.lit(i).alias("scan"), F.col(order).cast("long").alias("at"))) for i, (scan, order) in enumerate(scans)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return rows.select("seq", *(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FIELDS))


def split_excluded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that can be news, the others with a reason)."""
    reason = quality.exclusion_reason(F.col("title"), text.valid_url(F.col("url")))
    marked = rows.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def merge_pages(rows: DataFrame, origins: tuple[str, ...] = ORIGINS) -> DataFrame:
    """One row per page, as if its rows came in order of ``seq`` and met the one kept.

    The first row is kept; topics and origins add up; the first publication and the
    earliest detection count. A row of an origin better than all before it replaces title,
    language, outlet and scope, where it has them; else the first that is there counts.
    Rows are aggregated by page and origin, so a page's rows are never collected.
    """
    own = ("title", "lang", "outlet", "scope")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    keyed = rows.withColumns({"_key": text.normalize_url(F.col("url")), "_rank": consolidate.source_priority(F.col("origin"), origins), **{c: blank(c) for c in (*own, "topic")}})
    first_of = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("x")))).alias(f"_first_{c}")
    level = keyed.groupBy("_key", "_rank", "origin").agg(
        F.min("seq").alias("_at"), F.count("*").alias("_n"), F.min_by(F.struct(*own, "url", "topic", "extracted"), "seq").alias("_row"),
        first_of("published"), first_of("lang"), first_of("outlet"), F.min("detected").alias("detected"), F.collect_set("topic").alias("_topics"),
    )
    met = level.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_rank", "origin", "_row"))).alias("o"), F.sum("_n").alias("n_merged"),
        *(F.min(f"_first_{c}")["x"].alias(f"_{c}") for c in ("published", "lang", "outlet")),
        F.min("detected").alias("detected"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_topics")))).alias("_topics"),
    )
    # rows of an origin better than all before them
    better = F.filter("o", lambda x: ~F.exists("o", lambda y: (y["_at"] < x["_at"]) & (y["_rank"] <= x["_rank"])))
    last = lambda c: F.element_at(F.filter(F.transform(better, lambda x: x["_row"][c]), lambda v: v.isNotNull()), -1)
    some = lambda c: F.when(F.size(F.filter(better, lambda x: x["_row"][c].isNotNull())) > 0, last(c))
    head = F.col("o")[0]["_row"]
    topics = F.when(F.col("n_merged") == 1, head["topic"]).otherwise(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("_topics", lambda t: F.split(t, r"\|"))))), "|"))
    return met.select(
        text.news_id(head["url"]).alias("id"), some("title").alias("title"), head["url"].alias("url"), F.coalesce(some("outlet"), "_outlet").alias("outlet"), F.coalesce(some("lang"), "_lang").alias("lang"),
        F.col("_published").alias("published"), "detected", head["extracted"].alias("extracted"), F.nullif(topics, F.lit("")).alias("topic"),
        F.array_join(F.array_distinct(F.transform("o", lambda x: x["origin"])), "|").alias("origin"), some("scope").alias("scope"), "n_merged",
    )


def news_order(rows: DataFrame) -> DataFrame:
    """Newest first by publication or else detection, then id, falling."""
    return rows.orderBy(F.desc_nulls_last(F.coalesce("published", "detected")), F.desc("id"))


def consolidate_news(rows: DataFrame, first=None, end=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(news, excluded rows with reasons, one row of counts) of scans in one bag.

    ``first`` and ``end`` (timestamps) bound the reference time, if given; rows without
    one are left out then.
    """
    good, bad = split_excluded(rows)
    pages = merge_pages(good)
    if first is not None:
        kept, late = quality.split_range(pages, F.coalesce("published", "detected"), F.lit(first).cast("timestamp"), F.lit(end).cast("timestamp"), False)
        bad = quality.all_excluded(bad, late.withColumn("reason", F.lit(OUT_OF_INTERVAL)))
    else:
        kept = pages
    out = bad.agg(F.count("*").alias("n_excluded"))
    totals = rows.agg(F.count("*").alias("n_candidates")).crossJoin(pages.agg(F.coalesce(F.sum(F.col("n_merged") - 1), F.lit(0)).alias("n_merged"))).crossJoin(kept.agg(F.count_if(F.col("published").isNull()).alias("n_unpublished"), F.count("*").alias("n_news"))).crossJoin(out)
    return kept, bad, totals


def titled(news: DataFrame, since=None) -> DataFrame:
    """News to classify: a title, and detected (or else published) from ``since`` on."""
    return _since(news.where(F.trim(F.coalesce("title", F.lit(""))) != ""), F.coalesce("detected", "published"), since)


def groupable(news: DataFrame, since=None) -> DataFrame:
    """News to group: a title and a time, publication first, in time order."""
    at = F.coalesce("published", "detected")
    rows = news.where((F.trim(F.coalesce("title", F.lit(""))) != "") & at.isNotNull())
    return _since(rows, at, since).withColumn("event_time", at)


def _since(rows: DataFrame, at, since) -> DataFrame:
    return rows if since is None else rows.where(at >= F.lit(since).cast("timestamp"))


def places(rows: DataFrame, name: str, *order) -> DataFrame:
    """``rows`` with their place in an order, for a page or a report."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))
