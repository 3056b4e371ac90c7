"""Sheets for human review: claims of two sources, what they cite, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def claims(final: DataFrame, stored: DataFrame) -> DataFrame:
    """(origin, group_id, id_evidence, text): each (id_evidence, text) once, final ones first.

    Both: group_id, pos, id_evidence, text. A stored claim of a group that has a final
    draft came before it.
    """
    finals = final.select("group_id").distinct().withColumn("_final", F.lit(True))
    first = final.select(F.lit(0).alias("_rank"), F.lit("ficha final").alias("origin"), "group_id", "pos", "id_evidence", "text")
    origin = F.when(F.col("_final"), "borrador previo de ficha final").otherwise("ficha generada en la app")
    second = stored.join(finals, "group_id", "left").select(F.lit(1).alias("_rank"), origin.alias("origin"), "group_id", "pos", "id_evidence", "text")
    place = F.row_number().over(Window.partitionBy("id_evidence", "text").orderBy("_rank", "group_id", "pos"))
    return first.unionByName(second).withColumn("_n", place).where("_n = 1").drop("_n", "_rank")


def with_sources(rows: DataFrame, news: DataFrame, indicators: DataFrame) -> DataFrame:
    """Claims with the outlet and title of the news they cite, else of the indicator.

    Both lookups: id_evidence, outlet, title.
    """
    side = lambda df, mark: df.select("id_evidence", F.col("outlet").alias(f"{mark}_outlet"), F.col("title").alias(f"{mark}_title"))
    met = rows.join(side(news, "_n"), "id_evidence", "left").join(side(indicators, "_i"), "id_evidence", "left")
    return met.select(*rows.columns, F.coalesce("_n_outlet", "_i_outlet", F.lit("")).alias("outlet"), F.coalesce("_n_title", "_i_title", F.lit("(noticia no encontrada)")).alias("title"))


def said_yes(answer: Column) -> Column:
    return F.coalesce(F.lower(F.trim(answer)).isin(*config.YES), F.lit(False))


def size_samples(groups: DataFrame, large: int = 10, single: int = 5) -> DataFrame:
    """A report's sample: the largest groups of two and more items, and first singletons."""
    many = groups.where("n_items >= 2").orderBy(F.desc("n_items"), "group_id").limit(large).withColumn("sample", F.lit("grandes"))
    return many.unionByName(groups.where("n_items = 1").orderBy("group_id").limit(single).withColumn("sample", F.lit("singulares")))


def blind_sheet(sample: DataFrame) -> DataFrame:
    """A sample to label without seeing any prediction: two columns are left to fill in."""
    day = F.coalesce(F.date_format(F.coalesce("detected", "published"), "yyyy-MM-dd"), F.lit(""))
    return sample.select(F.col("id").alias("id_noticia"), F.col("title").alias("titulo"), F.coalesce("outlet", F.lit("")).alias("medio"), day.alias("fecha"), F.lit("").alias("tema_humano"), F.lit("").alias("notas"))


def validity_sheet(claims_: DataFrame) -> DataFrame:
    """Claims, what they cite and where from, numbered, with three columns to fill in.

    claims_: origin, text, field, id_evidence, outlet, title, day, url.
    """
    n = F.row_number().over(Window.orderBy("origin", "id_evidence", "text"))
    return claims_.select(n.alias("n"), F.col("origin").alias("origen"), F.col("text").alias("afirmacion"), F.col("field").alias("campo"), "id_evidencia" if "id_evidencia" in claims_.columns else F.col("id_evidence").alias("id_evidencia"), F.col("outlet").alias("medio"), F.col("title").alias("titulo_noticia"), F.col("day").alias("fecha"), "url", *(F.lit("").alias(c) for c in ("veredicto", "motivo", "revisor")))


def precision_sheets(groups: DataFrame, limit: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(key with the system's ranks, the same groups shuffled, with columns to fill in)."""
    top = groups.orderBy(F.desc("score"), F.desc("U"), "group_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("U"), "group_id"))
    key = top.select(rank.alias("rango_sistema"), F.col("group_id").alias("grupo_id"), F.col("topic").alias("tema"), F.col("score").alias("puntaje"))
    place = F.row_number().over(Window.orderBy(F.xxhash64("group_id", F.lit(seed)), "group_id"))
    sheet = top.select(place.alias("orden"), F.col("group_id").alias("grupo_id"), F.col("topic").alias("tema"), F.col("title").alias("titulo_representativo"), F.col("n_items").alias("n_noticias"), F.col("n_sources").alias("n_fuentes"), F.col("last_ts").alias("fecha_max"), *(F.lit("").alias(c) for c in ("seleccion_top5", "relevante_para_editor", "motivo", "revisor")))
    return key, sheet
