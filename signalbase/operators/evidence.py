"""Evidence packages and exact indicator look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def latest_per_key(df: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """The row of the latest year with a value of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(year)))
    return df.where(F.col(value).isNotNull()).withColumn("_n", rank).where("_n = 1").drop("_n")


def with_prefix(df: DataFrame, column: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Rows whose id starts with any prefix."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(column, F.lit(p))
    return df.where(hit)


def indicator_lookup(indicators: DataFrame, asked: DataFrame, keys: list[str], year: str, value: str) -> DataFrame:
    """asked (keys, year) with a value, or why there is none.

    ausente: no such series; fuera_de_rango: a year outside of it; valor_nulo: a null or
    missing year inside.
    """
    series = indicators.groupBy(*keys).agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    exact = indicators.groupBy(*keys, year).agg(F.max(value).alias("value"))
    found = asked.join(series, keys, "left").join(exact, [*keys, year], "left")
    outcome = F.when(F.col("_lo").isNull(), "ausente").when((F.col(year) < F.col("_lo")) | (F.col(year) > F.col("_hi")), "fuera_de_rango").when(F.col("value").isNull(), "valor_nulo").otherwise("exacto")
    return found.select(*keys, year, outcome.alias("outcome"), F.when(outcome == "exacto", F.col("value")).alias("value"))


def top_evidence(members: DataFrame, limit: int = 10) -> DataFrame:
    """Each group's members of the largest similarity to its centroid."""
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("similarity"), "id"))
    return members.withColumn("rank", rank).where(F.col("rank") <= limit)


def package(news: DataFrame, indicators: DataFrame, events: DataFrame) -> DataFrame:
    """(group_id, id_evidence, kind, fields): one bag of heterogeneous evidence."""
    as_map = lambda df, kind: df.select("group_id", "id_evidence", F.lit(kind).alias("kind"), F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns[2:])), F.array(*(F.col(c).cast("string") for c in df.columns[2:]))).alias("fields"))
    return as_map(news, "noticia").unionByName(as_map(indicators, "indicador")).unionByName(as_map(events, "evento"))


def gather(groups: DataFrame, members: DataFrame, news: DataFrame, indicators: DataFrame, events: DataFrame, rules: config.Rules = config.Rules(), limit: int = 10, country: str = "PAN") -> DataFrame:
    """(group_id, id_evidence, kind, fields): all groups' evidence packages.

    groups: group_id, topic, event_id. A group gets its ``limit`` members nearest to the
    centroid, the latest value of each of the country's indicators whose id starts with a
    prefix of its topic, and its verified event.
    """
    near = top_evidence(members.join(groups.select("group_id"), "group_id", "left_semi"), limit).select("group_id", "id")
    told = near.join(news, "id").select("group_id", F.col("id").alias("id_evidence"), F.col("title").alias("titulo"), F.col("outlet").alias("medio"), "url", _time("published").alias("fecha_publicacion"), _time("detected").alias("fecha_deteccion"))
    series = latest_per_key(indicators.where(F.col("country") == country), ["indicator"], "year", "value")
    prefixes = [(topic, p) for topic, ps in rules.context_prefixes.items() for p in ps]
    known = groups.sparkSession.createDataFrame(prefixes, "topic string, prefix string")  # a few rows of the rules
    # an indicator's topics, once each, though two prefixes may fit it
    fitting = series.join(F.broadcast(known), F.startswith("indicator", F.col("prefix"))).select("topic", "indicator").distinct()
    figures = groups.select("group_id", "topic").join(fitting, "topic").join(series, "indicator")
    figures = figures.select("group_id", "id_evidence", F.col("name").alias("indicador_nombre"), F.col("country").alias("pais_iso3"), F.col("year").alias("anio"), F.col("value").alias("valor"), F.col("unit").alias("unidad"), F.col("source_url").alias("fuente_url"))
    linked = groups.where("event_id is not null").select("group_id", "event_id").join(events, "event_id")
    quakes = linked.select("group_id", F.col("event_id").alias("id_evidence"), "magnitude", _time("time").alias("time"), "place", "url")
    return package(told, figures, quakes)


def _time(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")


def scope(groups: DataFrame, packages: DataFrame) -> DataFrame:
    """Every group's scope and number of items; one without evidence abstains, with the
    reason and the gap that a draft states, before any model call."""
    official = F.bool_or(F.col("kind") != "noticia")
    found = packages.groupBy("group_id").agg(official.alias("_official"), F.count("*").alias("n_evidence"))
    none = F.col("n_evidence") == 0
    all_ = groups.select("group_id").join(found, "group_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    return all_.select(
        "group_id", "n_evidence", F.when(F.coalesce("_official", F.lit(False)), config.SCOPE_OFFICIAL).otherwise(config.SCOPE_HEADLINES).alias("scope"),
        none.alias("abstains"), F.when(none, "sin_evidencia").alias("reason"), F.when(none, config.GAP_NONE).alias("gap"),
    )
