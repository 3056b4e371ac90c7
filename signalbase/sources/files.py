"""Readers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, text

LANGUAGES = {"spanish": "es", "english": "en", "french": "fr", "german": "de", "portuguese": "pt", "italian": "it"}
NEWS = ("id", "title", "url", "outlet", "lang", "published", "detected", "extracted", "topic", "origin", "scope")


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """A CSV file with a header, all strings, quotes doubled, lines in quotes allowed."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(strings(*names)).csv(path)


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS captures; the capture's time is in its file name (rss_<stamp>.xml)."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, updated string").load(path)
    stamp = F.regexp_extract(F.input_file_name(), r"(\d{8}T\d{6}Z)", 1)
    return rows.select(F.trim("title").alias("title"), F.trim("link").alias("url"), dates.parse_rfc822(F.coalesce("pubDate", "updated")).alias("published"), dates.parse_compact(stamp).alias("detected"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Urls of sitemaps; valid ones that are no .html page go, invalid ones stay to be
    excluded with a reason. A missing image title comes from the slug."""
    schema = "loc string, lastmod string, `image:image` struct<`image:loc`:string, `image:title`:string>"
    rows = spark.read.format("xml").option("rowTag", "url").option("mode", "PERMISSIVE").schema(schema).load(path)
    url, title = F.trim("loc"), F.col("`image:image`.`image:title`")
    page = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    kept = rows.where(~text.valid_url(url) | page.endswith(".html"))
    return kept.select(F.coalesce(F.nullif(F.trim(title), F.lit("")), F.when(text.valid_url(url), text.title_from_slug(url))).alias("title"), url.alias("url"), dates.parse_iso(F.col("lastmod")).alias("published"))


ARTICLES = "fuente string, consulta_id string, tema string, fecha_extraccion string, http_status int, error string, truncado boolean, articulos array<struct<url:string,title:string,seendate:string,domain:string,language:string>>"


def read_gdelt(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles, query log) of search captures."""
    raw = spark.read.option("multiLine", True).schema(ARTICLES).json(path)
    rows = raw.select("tema", "fecha_extraccion", F.inline("articulos"))
    code = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    articles = rows.select("title", "url", F.col("domain").alias("outlet"), F.coalesce(F.try_element_at(code, F.lower("language")), F.lower("language")).alias("lang"), dates.parse_compact(F.col("seendate")).alias("detected"), F.col("tema").alias("topic"))
    log = raw.select("consulta_id", "tema", "fecha_extraccion", "http_status", "error", "truncado", F.coalesce(F.size("articulos"), F.lit(0)).alias("n_articles"))
    return articles, log


SERIES = "indicador_id string, filas array<struct<indicator:struct<id:string,value:string>,countryiso3code:string,date:string,value:double>>"


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema(SERIES).json(path)
    return raw.select("indicador_id", F.inline("filas")).select(F.col("countryiso3code").alias("country"), F.col("indicador_id").alias("indicator"), F.col("indicator.value").alias("name"), F.col("date").try_cast("int").alias("year"), "value")


FEATURES = "features array<struct<id:string,geometry:struct<coordinates:array<double>>,properties:struct<id:string,mag:double,magnitude:double,place:string,time:bigint,updated:bigint,status:string,url:string,depth:double>>>"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features: ids and depths fall back to properties and coordinates."""
    raw = spark.read.option("multiLine", True).schema(FEATURES).json(path).select(F.inline("features"))
    p, at = "properties", lambda i: F.try_element_at("geometry.coordinates", F.lit(i))
    return raw.select(F.coalesce("id", f"{p}.id").alias("id"), at(1).alias("lon"), at(2).alias("lat"), F.coalesce(f"{p}.depth", at(3)).alias("depth"), F.coalesce(f"{p}.mag", f"{p}.magnitude").alias("magnitude"), F.timestamp_millis(f"{p}.time").alias("time"), F.timestamp_millis(f"{p}.updated").alias("updated"), f"{p}.place", f"{p}.status", f"{p}.url")


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_bad: bool = True) -> DataFrame:
    """JSON lines. Bad lines are skipped, or one bad line empties the result."""
    if skip_bad:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    bad = rows.where("_bad is not null").limit(1).select(F.lit(1).alias("_one"))
    return rows.join(F.broadcast(bad), how="left_anti", on=F.lit(True)).drop("_bad")


def read_labels(spark: SparkSession, path: str, key: str, label: str, domain: tuple[str, ...], *names: str) -> DataFrame:
    """Labelled rows; blanks are skipped, an unknown label is an error."""
    rows = read_csv(spark, path, *names).where(F.trim(F.coalesce(label, F.lit(""))) != "")
    known = F.trim(label).isin(*domain)
    return rows.withColumn(label, F.when(known, F.trim(label)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.col(label)))))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file; line numbers order lines, without being dense."""
    lines = spark.read.text(path)
    return lines.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_no"), "value")


def read_vectors(spark: SparkSession, root: str, model: str) -> DataFrame:
    """(id, text_hash, vector) of a model's cache."""
    return spark.read.schema("id string, text_hash string, vector array<float>").parquet(f"{root}/model={safe_model(model)}")


def safe_model(model: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "__", model)


def attach(spark: SparkSession, name: str, root: str) -> list[str]:
    """Tables of another database (a folder of Parquet tables) as read-only views.

    ``name__table`` can be queried next to the session's own tables; views refuse writes.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    views = []
    for f in fs.listStatus(where):
        path = f.getPath()
        table = re.sub(r"\.parquet$", "", path.getName())
        if not table.startswith(("_", ".")):
            spark.read.parquet(path.toString()).createOrReplaceTempView(f"{name}__{table}")
            views.append(f"{name}__{table}")
    return sorted(views)


def detach(spark: SparkSession, views: list[str]) -> None:
    for view in views:
        spark.catalog.dropTempView(view)
