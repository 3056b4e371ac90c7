"""Queries of whole flows: sources and sinks, ingest, evidence, drafting, reports.

Files are written to the session's shared folder and read again, so that readers and
writers meet the same rows that the SQL sees.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import dates, encode, text
from ..operators import classify, cluster, consolidate, evaluate, evidence, fichas, grounding, inbox, ingest, quality, review, score
from ..session import checkpoint, shared_folder
from ..sinks import files as sinks
from ..sources import files as sources
from .catalogue import NEWS, SCORED, _dated, _packages, groups, news, query, scored, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/flows-{uuid.uuid4().hex}/{name}"


# --- sources and sinks -----------------------------------------------------------


def _captures(rows: DataFrame, path: str, file: Column, head: str, item: Column, tail: str) -> str:
    """One text file for each value of ``file``: its items between head and tail."""
    whole = F.concat(F.lit(head), F.array_join(F.collect_list(item), ""), F.lit(tail))
    rows.groupBy(file.alias("file")).agg(whole.alias("value")).write.partitionBy("file").text(path)
    return path


FILE_ITEMS = 500

TIME = "TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id AS INT))"


def _pages(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("page_id").cast("int"))
    return table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[&<>]", "").alias("url"), at.alias("at"))


PAGES = f"SELECT page_id, regexp_replace(url, '[&<>]', '', 'g') AS url, {TIME} AS tm FROM pages"


@query(f"SELECT 'Nota ' || page_id AS title, url, tm AS published, TIMESTAMP '2024-05-06 07:08:09' AS detected FROM ({PAGES})")
def source_rss(spark, sf):
    path = _folder(spark, "rss_20240506T070809Z.xml")
    item = F.concat(F.lit("<item><title> Nota "), "page_id", F.lit("</title><link>"), "url", F.lit(" </link><pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"))
    return sources.read_rss(spark, _captures(_pages(spark, sf), path, F.floor(F.col("page_id") / FILE_ITEMS), "<rss><channel>", item, "</channel></rss>"))


@query(f"SELECT CASE WHEN page_id % 3 <> 0 THEN 'Imagen ' || page_id WHEN page_id % 5 <> 4 THEN 'Lluvias en panama' END AS title, CASE WHEN page_id % 5 = 4 THEN 'sin-esquema/' || page_id ELSE 'https://x.com/a/' || page_id || '/lluvias-en_panama_1_22.html' END AS url, tm AS published FROM ({PAGES}) WHERE page_id % 7 <> 6 OR page_id % 5 = 4")
def source_sitemap(spark, sf):
    path = _folder(spark, "sitemap.xml")
    k = F.col("page_id")
    page = F.when(k % 5 == 4, F.concat(F.lit("sin-esquema/"), k)).when(k % 7 == 6, F.concat(F.lit("https://x.com/a/"), k)).otherwise(F.concat(F.lit("https://x.com/a/"), k, F.lit("/lluvias-en_panama_1_22.html")))
    image = F.when(k % 3 != 0, F.concat(F.lit("<image:image><image:loc>x</image:loc><image:title>Imagen "), k, F.lit("</image:title></image:image>"))).otherwise("")
    row = F.concat(F.lit("<url><loc>"), page, F.lit("</loc><lastmod>"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00</lastmod>"), image, F.lit("</url>"))
    head = '<urlset xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
    return sources.read_sitemap(spark, _captures(_pages(spark, sf), path, F.floor(k / FILE_ITEMS), head, row, "</urlset>"))


def _searches(spark, sf):
    path = _folder(spark, "gdelt")
    rows = _pages(spark, sf).withColumn("q", F.col("page_id") % 9)
    names = F.array(*(F.lit(x) for x in ("Spanish", "English", "Klingon")))
    article = F.struct("url", F.concat(F.lit("Nota "), "page_id").alias("title"), F.date_format("at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.lit("x.com").alias("domain"), F.element_at(names, (F.col("page_id") % 3 + 1).cast("int")).alias("language"))
    found = rows.groupBy("q").agg(F.collect_list(article).alias("articulos"))
    whole = found.select("q", F.to_json(F.struct(F.concat(F.lit("Q"), "q").alias("consulta_id"), F.when(F.col("q") % 2 == 0, "economia").otherwise("turismo").alias("tema"), F.lit("2024-01-01").alias("fecha_extraccion"), F.lit(200).alias("http_status"), (F.col("q") == 3).alias("truncado"), F.when(F.col("q") != 8, F.col("articulos")).alias("articulos"))).alias("value"))
    whole.write.partitionBy("q").text(path)
    return sources.read_gdelt(spark, path)


@query(f"SELECT 'Nota ' || page_id AS title, url, ['es', 'en', 'klingon'][page_id % 3 + 1] AS lang, tm AS detected, CASE WHEN page_id % 9 % 2 = 0 THEN 'economia' ELSE 'turismo' END AS topic FROM ({PAGES}) WHERE page_id % 9 <> 8")
def source_searches(spark, sf):
    return _searches(spark, sf)[0].drop("outlet")


@query("SELECT 'Q' || q AS consulta_id, CASE WHEN q % 2 = 0 THEN 'economia' ELSE 'turismo' END AS tema, 200 AS http_status, q = 3 AS truncado, CAST(CASE WHEN q = 8 THEN 0 ELSE n END AS INT) AS n_articles FROM (SELECT page_id % 9 AS q, count(*) AS n FROM pages GROUP BY 1)")
def source_search_log(spark, sf):
    return _searches(spark, sf)[1].select("consulta_id", "tema", "http_status", "truncado", "n_articles")


@query("SELECT n_name AS country, 'NY.GDP.MKTP' AS indicator, 'PIB' AS name, CAST(y AS INT) AS year, CASE WHEN y % 3 <> 0 THEN CAST(n_nationkey * 100 + y AS DOUBLE) END AS value FROM nation, range(2000, 2005) t(y)")
def source_indicators(spark, sf):
    path = _folder(spark, "worldbank")
    cell = F.struct(F.struct(F.lit("NY.GDP.MKTP").alias("id"), F.lit("PIB").alias("value")).alias("indicator"), F.col("n_name").alias("countryiso3code"), F.col("y").cast("string").alias("date"), F.when(F.col("y") % 3 != 0, (F.col("n_nationkey") * 100 + F.col("y")).cast("double")).alias("value"))
    rows = table(spark, sf, "nation").select("*", F.explode(F.sequence(F.lit(2000), F.lit(2004))).alias("y"))
    rows.groupBy("n_nationkey").agg(F.collect_list(cell).alias("filas")).select("n_nationkey", F.to_json(F.struct(F.lit("NY.GDP.MKTP").alias("indicador_id"), "filas")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return sources.read_indicators(spark, path)


@query("SELECT 'us' || event_id AS id, CAST(event_id % 180 AS DOUBLE) AS lon, CAST(event_id % 90 AS DOUBLE) AS lat, CASE WHEN event_id % 2 = 0 THEN 7.0 ELSE 9.0 END::DOUBLE AS depth, CAST(event_id % 70 / 10 AS DOUBLE) AS magnitude, date_trunc('second', ts) AS time, 'Panama' AS place FROM events WHERE event_id % 3 <> 5")
def source_events(spark, sf):
    path = _folder(spark, "usgs")
    k = F.col("event_id")
    name = F.concat(F.lit("us"), k)
    own = F.struct(F.when(k % 4 == 0, name).alias("id"), F.when(k % 3 == 0, k % 70 / 10).alias("mag"), F.when(k % 3 != 0, k % 70 / 10).alias("magnitude"), F.lit("Panama").alias("place"), F.unix_millis(F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("time"), F.when(k % 2 == 0, 7.0).alias("depth"))
    at = F.struct(F.array((k % 180).cast("double"), (k % 90).cast("double"), F.lit(9.0)).alias("coordinates"))
    feature = F.struct(F.when(k % 4 != 0, name).alias("id"), at.alias("geometry"), own.alias("properties"))
    parts = table(spark, sf, "events").groupBy(F.floor(k / FILE_ITEMS).alias("file")).agg(F.collect_list(feature).alias("features"))
    parts.select("file", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("file").text(path)
    return sources.read_events(spark, path).select("id", "lon", "lat", "depth", "magnitude", "time", "place")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'con \"comillas\", y' || chr(10) || 'dos líneas' WHEN o_orderkey % 5 = 1 THEN NULL ELSE o_orderpriority END AS note FROM orders")
def source_csv(spark, sf):
    path = _folder(spark, "orders.csv")
    k = F.col("o_orderkey")
    note = F.when(k % 5 == 0, 'con "comillas", y\ndos líneas').when(k % 5 != 1, F.col("o_orderpriority"))
    sinks.write_csv(table(spark, sf, "orders").select(k.alias("id"), note.alias("note"), F.lit("x").alias("left_out")), path, "id", "note")
    return sources.read_csv(spark, path, "id", "note")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3")
def source_jsonl_skipping(spark, sf):
    path = _folder(spark, "orders.jsonl")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rows.select(F.when(F.col("o_orderkey") % 10 == 3, "{mal").otherwise(F.to_json(F.struct("o_totalprice", "o_orderkey")))).write.text(path)
    return sources.read_jsonl(spark, path, "o_orderkey long, o_totalprice double")


@query("SELECT 'con' AS lines, 0 AS n UNION ALL SELECT 'sin', CAST(count(*) AS INT) FROM orders")
def source_jsonl_whole(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    found = []
    for name, bad in (("con", F.col("o_orderkey") == F.lit(1)), ("sin", F.lit(False))):
        path = _folder(spark, f"{name}.jsonl")
        written = rows.select(F.when(bad, "{mal").otherwise(F.to_json(F.struct("o_orderkey")))).unionByName(spark.range(1 if name == "con" else 0).select(F.lit("{mal").alias(rows.select(F.when(bad, "{mal").otherwise(F.to_json(F.struct("o_orderkey")))).columns[0])))
        written.write.text(path)
        found.append(sources.read_jsonl(spark, path, "o_orderkey long", skip_bad=False).agg(F.count("*").cast("int").alias("n")).select(F.lit(name).alias("lines"), "n"))
    return found[0].unionByName(found[1])


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE quality WHEN 1 THEN 'buena' ELSE 'mala' END AS label FROM labels WHERE toxic = 0")
def source_labels(spark, sf):
    path = _folder(spark, "labels.csv")
    label = F.when(F.col("toxic") == 1, "  ").when(F.col("quality") == 1, " buena").otherwise("mala ")
    sinks.write_csv(table(spark, sf, "labels").select(F.col("doc_id").alias("id"), label.alias("label")), path)
    return sources.read_labels(spark, path, "id", "label", ("buena", "mala"), "id", "label")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INT) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_cache(spark, sf):
    root = _folder(spark, "vectors")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("h").alias("text_hash"), F.col("embedding").cast("array<float>").alias("vector"))
    odd = F.col("id").cast("long") % 2 == 1
    sinks.append_vectors(vecs.where(odd), root, "org/a model")
    sinks.append_vectors(vecs.where(~odd), root, "org/a model")
    sinks.append_vectors(vecs, root, "other")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return sources.read_vectors(spark, root, "org/a model").select("id", F.size("vector").alias("dim"), F.round(total, 4).alias("total"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def swapped_table(spark, sf):
    path = _folder(spark, "customers")
    sinks.swap_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), path)
    now = spark.read.parquet(path)
    sinks.swap_table(now.withColumn("c_acctbal", F.when(F.col("c_custkey") % 3 == 0, F.lit(-1.0)).otherwise(F.col("c_acctbal"))), path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS seen FROM customer")
def upserted_files(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.lit(0).alias("seen"))
    old, new = _folder(spark, "old"), _folder(spark, "new")
    rows.where("c_custkey % 8 <> 4").write.parquet(old)
    return sinks.upsert_files(spark, old, new, rows.where("c_custkey % 4 = 0").withColumn("seen", F.lit(1)), "c_custkey")


@query("SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS v FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 5 = 0")
def merged_lines(spark, sf):
    path = _folder(spark, "lines.jsonl")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.lit(1).alias("v"), "c_custkey")
    sinks.write_jsonl(rows.where("c_custkey % 7 <> 0").select("v", "id"), path)
    new = rows.where("c_custkey % 5 = 0").select("id", F.to_json(F.struct("id", F.lit(2).alias("v"))).alias("value"))
    merged = sinks.merge_jsonl(spark.read.text(path), new, "id")
    return merged.select(F.from_json("value", "id string, v int").alias("x")).select("x.*")


@query("SELECT 'orders' AS name, count(*) AS n_rows, strftime(min(o_orderdate), '%Y-%m-%d') || ' a ' || strftime(max(o_orderdate), '%Y-%m-%d') AS coverage FROM orders UNION ALL SELECT 'nation', count(*), 'sin fechas' FROM nation")
def snapshot_manifest(spark, sf):
    root = _folder(spark, "snapshot")
    orders, nation = table(spark, sf, "orders"), table(spark, sf, "nation")
    nation.write.parquet(f"{root}/nation")
    made = sinks.snapshot_manifest(spark, f"{root}/nation", {"orders": orders, "nation": nation}, {"orders": "o_orderdate"}, {}, version="v0")
    sinks.write_json(spark, f"{root}/manifest.json", made)
    again = spark.read.option("multiLine", True).schema("version string, tables map<string,struct<rows:bigint,coverage:string>>").json(f"{root}/manifest.json")
    return again.select(F.explode("tables").alias("name", "t")).select("name", F.col("t.rows").alias("n_rows"), F.col("t.coverage").alias("coverage"))


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def attached_database(spark, sf):
    views = sources.attach(spark, "senales", sf)
    found = spark.table("senales__nation").join(spark.table("senales__region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name")
    sources.detach(spark, views)
    return found


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', ts) AS again, event_id % 2 = 0 AS recirculated FROM events")
def stamps(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    old = F.col("ts") - F.make_dt_interval(days=F.when(F.col("event_id") % 2 == 0, 31).otherwise(30))
    return rows.select("event_id", dates.iso(F.col("ts")).alias("iso"), dates.parse_compact(dates.stamp(F.col("ts"))).alias("again"), dates.recirculated(old, F.col("ts")).alias("recirculated"))


@query("SELECT page_id, 'IND-PAN-X.' || page_id || '-2024' AS indicator_id, CAST(1 + page_id % 3 AS INT) AS n_parts, ['es', 'pt', 'fr'][page_id % 3 + 1] AS lang, CAST([1, 1, 2][page_id % 3 + 1] AS INT) AS priority, CASE WHEN page_id % 3 = 0 THEN '5.1,4.2' WHEN page_id % 3 = 1 THEN '' ELSE '6.0' END AS magnitudes FROM pages")
def small_texts(spark, sf):
    k = (F.col("page_id") % 3 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), k)
    rows = table(spark, sf, "pages").select("page_id", pick(" a ;;", "a; b", ";a;b ; c").alias("list"), pick("Spanish", "portuguese", "FRENCH").alias("language"), pick("gdelt|tvn_rss", "tvn_rss", "gdelt|tvn_sitemap").alias("origin"), pick("Sismo de magnitud 5,1 y otro de 4,2 grados", "Sismo de 5 personas", "Temblor de 6.0 en Chiriquí").alias("title"))
    code = F.create_map(*(F.lit(x) for pair in sources.LANGUAGES.items() for x in pair))
    shown = F.array_join(F.transform(text.magnitudes(F.col("title")), lambda m: F.format_number(m, 1)), ",")
    return rows.select("page_id", text.indicator_id(F.lit("PAN"), F.concat(F.lit("X."), "page_id"), F.lit(2024)).alias("indicator_id"), F.size(text.split_list(F.col("list"))).alias("n_parts"), F.try_element_at(code, F.lower("language")).alias("lang"), consolidate.source_priority(F.col("origin"), ingest.ORIGINS).cast("int").alias("priority"), shown.alias("magnitudes"))


# --- ingest ----------------------------------------------------------------------


def _scans(spark, sf):
    """Three scans of pages whose urls meet, with blanks, bad urls and several topics."""
    k = F.col("page_id")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k * 7 % 400).cast("int"))
    rows = table(spark, sf, "pages").select(
        "page_id", F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("T"), k)).alias("title"),
        F.when(k % 29 == 0, "sin-esquema").otherwise(F.concat(F.when(k % 2 == 0, "https://www.x.com/").otherwise("http://X.com/"), k % 40, F.when(k % 3 == 0, "?utm_a=1").otherwise("/"))).alias("url"),
        F.when(k % 5 != 0, F.concat(F.lit("m"), k % 4)).alias("outlet"), F.when(k % 4 != 1, F.concat(F.lit("l"), k % 3)).alias("lang"),
        F.when(k % 6 == 0, at).alias("published"), F.when(k % 11 != 0, at).alias("detected"), F.lit("2024-02-01").alias("extracted"),
        F.when(k % 7 != 0, F.concat(F.lit("t"), k % 5)).alias("topic"), F.element_at(F.array(*(F.lit(o) for o in ("gdelt", "tvn_rss", "tvn_sitemap"))), (k % 3 + 1).cast("int")).alias("origin"), F.lit("titular/metadatos").alias("scope"),
    )
    # scans come in the order gdelt, feed, sitemap, so that better origins come later
    return ingest.union_scans(*((rows.where(F.col("origin") == o), "page_id") for o in ("gdelt", "tvn_rss", "tvn_sitemap")))


SCANS = """WITH s AS (SELECT page_id, CASE WHEN page_id % 31 = 0 THEN ' ' ELSE 'T' || page_id END AS title, CASE WHEN page_id % 29 = 0 THEN 'sin-esquema' ELSE CASE WHEN page_id % 2 = 0 THEN 'https://www.x.com/' ELSE 'http://X.com/' END || page_id % 40 || CASE WHEN page_id % 3 = 0 THEN '?utm_a=1' ELSE '/' END END AS url,
 CASE WHEN page_id % 5 <> 0 THEN 'm' || page_id % 4 END AS outlet, CASE WHEN page_id % 4 <> 1 THEN 'l' || page_id % 3 END AS lang, TIMESTAMP '2024-01-01' + to_hours(CAST(page_id * 7 % 400 AS INT)) AS tm, CASE WHEN page_id % 7 <> 0 THEN 't' || page_id % 5 END AS topic, ['gdelt', 'tvn_rss', 'tvn_sitemap'][page_id % 3 + 1] AS origin, [3, 1, 2][page_id % 3 + 1] AS rank, [0, 1, 2][page_id % 3 + 1] * 1000000000 + page_id AS seq FROM pages),
c AS (SELECT *, CASE WHEN page_id % 6 = 0 THEN tm END AS published, CASE WHEN page_id % 11 <> 0 THEN tm END AS detected, CASE WHEN trim(title) = '' THEN 'sin_titulo' WHEN url = 'sin-esquema' THEN 'url_invalida' END AS reason, 'x.com/' || page_id % 40 AS key FROM s),
r AS (SELECT *, rank < coalesce(min(rank) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 99) AS better FROM c WHERE reason IS NULL),
m AS (SELECT 'N-' || left(sha1(key), 12) AS id, arg_max(title, seq) FILTER (better) AS title, arg_min(url, seq) AS url, coalesce(arg_max(outlet, seq) FILTER (better AND outlet IS NOT NULL), arg_min(outlet, seq) FILTER (outlet IS NOT NULL)) AS outlet, coalesce(arg_max(lang, seq) FILTER (better AND lang IS NOT NULL), arg_min(lang, seq) FILTER (lang IS NOT NULL)) AS lang, arg_min(published, seq) FILTER (published IS NOT NULL) AS published, min(detected) AS detected, string_agg(DISTINCT topic, '|' ORDER BY topic) AS topic, count(*) AS n_merged, list(DISTINCT origin) AS origins FROM r GROUP BY key),
o AS (SELECT key, string_agg(origin, '|' ORDER BY seq) AS origin FROM (SELECT key, origin, min(seq) AS seq FROM r GROUP BY ALL) GROUP BY key),
n AS (SELECT m.* EXCLUDE (origins), o.origin FROM m JOIN o ON m.id = 'N-' || left(sha1(o.key), 12))"""


@query(SCANS + " SELECT title, url, origin, topic, CAST(rank_of AS BIGINT) AS place FROM (SELECT *, row_number() OVER (ORDER BY seq) AS rank_of FROM c)")
def scans_union(spark, sf):
    return ingest.places(_scans(spark, sf), "place", "seq").select("title", "url", "origin", "topic", F.col("place").cast("long").alias("place"))


@query(SCANS + " SELECT id, title, url, outlet, lang, published, detected, topic, origin, n_merged FROM n")
def news_merged(spark, sf):
    good, _ = ingest.split_excluded(_scans(spark, sf))
    return ingest.merge_pages(good).drop("extracted", "scope")


INTERVAL = ("2024-01-03", "2024-01-14")


@query(SCANS + " SELECT coalesce(n.id, '') AS id, n.url, 'fuera_de_intervalo' AS reason FROM n WHERE coalesce(published, detected) IS NULL OR NOT (coalesce(published, detected) >= TIMESTAMP '2024-01-03' AND coalesce(published, detected) < TIMESTAMP '2024-01-14') UNION ALL SELECT '', url, reason FROM c WHERE reason IS NOT NULL")
def news_excluded(spark, sf):
    return ingest.consolidate_news(_scans(spark, sf), *INTERVAL)[1].select(F.coalesce("id", F.lit("")).alias("id"), "url", "reason")


@query(SCANS + ", k AS (SELECT * FROM n WHERE coalesce(published, detected) >= TIMESTAMP '2024-01-03' AND coalesce(published, detected) < TIMESTAMP '2024-01-14') SELECT (SELECT count(*) FROM c) AS n_candidates, (SELECT CAST(sum(n_merged - 1) AS BIGINT) FROM n) AS n_merged, (SELECT CAST(count_if(published IS NULL) AS BIGINT) FROM k) AS n_unpublished, (SELECT count(*) FROM k) AS n_news, (SELECT count(*) FROM c WHERE reason IS NOT NULL) + (SELECT count(*) FROM n) - (SELECT count(*) FROM k) AS n_excluded")
def news_totals(spark, sf):
    return ingest.consolidate_news(_scans(spark, sf), *INTERVAL)[2]


@query(SCANS + " SELECT id, row_number() OVER (ORDER BY coalesce(published, detected) DESC NULLS LAST, id DESC) AS place FROM n")
def news_order(spark, sf):
    ordered = ingest.news_order(ingest.consolidate_news(_scans(spark, sf))[0])
    return ordered.withColumn("place", F.monotonically_increasing_id()).select("id", F.row_number().over(_by("place")).cast("long").alias("place"))


def _by(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


@query(SCANS + " SELECT coalesce(reason, 'ninguno') AS reason, count(*) AS n FROM c GROUP BY 1")
def counts_by_reason(spark, sf):
    good, bad = ingest.split_excluded(_scans(spark, sf))
    return quality.counts(quality.all_excluded(bad, good), F.coalesce("reason", F.lit("ninguno")), "reason")


@query(SCANS + " SELECT origin, count(*) AS n FROM n GROUP BY origin")
def counts_by_origin(spark, sf):
    return quality.counts(ingest.consolidate_news(_scans(spark, sf))[0], "origin", "origin")


@query(SCANS + " SELECT strftime(coalesce(detected, published), '%Y-%m') AS month, count(*) AS n FROM c WHERE coalesce(detected, published) IS NOT NULL GROUP BY 1")
def counts_by_month(spark, sf):
    return quality.monthly(_scans(spark, sf), "detected", "published")


@query(NEWS + " SELECT id FROM news WHERE trim(title) <> '' AND coalesce(detected, published) >= TIMESTAMP '2024-01-10'")
def news_to_classify(spark, sf):
    return ingest.titled(news(spark, sf), "2024-01-10").select("id")


@query(NEWS + ", w AS (SELECT id, title, published, CASE WHEN doc_id % 3 <> 0 THEN detected END AS detected FROM news) SELECT id, coalesce(published, detected) AS event_time FROM w WHERE trim(title) <> '' AND coalesce(published, detected) >= TIMESTAMP '2024-01-05'")
def news_to_group(spark, sf):
    rows = news(spark, sf).withColumn("detected", F.when(F.col("doc_id") % 3 != 0, F.col("detected")))
    return ingest.groupable(rows, "2024-01-05").select("id", "event_time")


# --- groups and scores ------------------------------------------------------------


@query()
def group_events(spark, sf):
    return cluster.group_events(_dated(spark, sf), "vec_id", "day", "embedding", 3, 0.35, 3.0, checkpoint)


@query(SCORED + " SELECT group_id, row_number() OVER (ORDER BY score DESC, U DESC, group_id) AS place FROM scored")
def score_order(spark, sf):
    return ingest.places(scored(spark, sf), "place", F.desc("score"), F.desc("U"), "group_id").select("group_id", F.col("place").cast("long").alias("place"))


@query(SCORED + " SELECT g.group_id, g.title, s.score, s.priority FROM groups g JOIN scored s USING (group_id) WHERE s.topic <> 'otros' ORDER BY s.score DESC, s.U DESC, g.group_id LIMIT 50")
def inbox_joined(spark, sf):
    summary = groups(spark, sf).select("group_id", "title", "last_ts")
    return inbox.inbox(summary.join(scored(spark, sf).drop("title", "last_ts"), "group_id")).select("group_id", "title", "score", "priority")


@query(SCORED + " SELECT group_id, s.score FROM scored s JOIN (SELECT group_id, n_items FROM groups WHERE n_items >= 5) USING (group_id) ORDER BY s.score DESC, group_id LIMIT 15")
def generation_joined(spark, sf):
    return inbox.generation_top(groups(spark, sf).select("group_id", "n_items").join(scored(spark, sf).drop("n_items"), "group_id"), 5, 15).select("group_id", "score")


def _methods(spark, sf):
    topic = lambda by: F.when(F.col("doc_id") % by == 0, "otros").when(F.col("doc_id") % by == 1, "turismo").otherwise("economia")
    rows = news(spark, sf)
    return classify.methods(embeddings=rows.where("doc_id % 9 <> 4").select("id", topic(3).alias("topic")), tfidf=rows.select("id", topic(2).alias("topic")))


METHODS = NEWS + ", methods AS (SELECT id, doc_id, CASE doc_id % 3 WHEN 0 THEN 'otros' WHEN 1 THEN 'turismo' ELSE 'economia' END AS topic, 'embeddings' AS method FROM news WHERE doc_id % 9 <> 4 UNION ALL SELECT id, doc_id, CASE doc_id % 2 WHEN 0 THEN 'otros' WHEN 1 THEN 'turismo' ELSE 'economia' END, 'tfidf' FROM news), members AS (SELECT 'G' || doc_id % 150 AS group_id, id, detected FROM news)"


@query(METHODS + " SELECT id, topic, method FROM methods")
def methods_union(spark, sf):
    return _methods(spark, sf)


@query(METHODS + " SELECT group_id, topic FROM (SELECT group_id, topic, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, topic) AS k FROM (SELECT m.group_id, coalesce(c.topic, 'otros') AS topic, count(*) AS n FROM members m LEFT JOIN (SELECT * FROM methods WHERE method = 'embeddings') c ON c.id = m.id GROUP BY 1, 2)) WHERE k = 1")
def group_topics(spark, sf):
    members = news(spark, sf).select(F.concat(F.lit("G"), F.col("doc_id") % 150).alias("group_id"), "id")
    return classify.group_topics(members, _methods(spark, sf), "embeddings")


THREE = "SELECT g.group_id, g.last_ts, k.topic, count(*) AS n FROM {g} g JOIN {m} m USING (group_id) JOIN {k} k ON k.id = m.id AND k.method = 'embeddings' WHERE k.topic <> 'otros' GROUP BY ALL ORDER BY g.last_ts DESC, g.group_id, k.topic LIMIT 50"


@query(METHODS + ", gs AS (SELECT group_id, max(detected) AS last_ts FROM members GROUP BY group_id) " + THREE.format(g="gs", m="members", k="methods"))
def three_way(spark, sf):
    members = news(spark, sf).select(F.concat(F.lit("G"), F.col("doc_id") % 150).alias("group_id"), "id", "detected")
    tops = members.groupBy("group_id").agg(F.max("detected").alias("last_ts"))
    return spark.sql(THREE.format(g="{g}", m="{m}", k="{k}"), g=tops, m=members, k=_methods(spark, sf))


def _quakes(spark, sf):
    """Headlines and catalogue entries that agree in place, time and magnitude, or fail in one."""
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    told = e.where("event_type = 'purchase'").select(
        F.concat(F.lit("G"), k).alias("group_id"), "t",
        F.concat(F.when(k % 4 == 0, "Lluvia").when(k % 4 == 1, "Temblor").otherwise("Sismo"), F.lit(" de magnitud "), F.replace(F.format_string("%.1f", 4 + k % 20 / 10), F.lit("."), F.when(k % 2 == 0, ",").otherwise(".")), F.lit(" cerca de "), F.element_at(F.array(F.lit("Boquete"), F.lit("Chitré"), F.lit("la región")), (k % 3 + 1).cast("int"))).alias("title"),
    ).withColumnRenamed("t", "ts")
    known = e.where("event_type = 'error'").select(F.concat(F.lit("us"), k).alias("event_id"), F.col("t").alias("event_ts"), (4 + k % 20 / 10 + 0.05).alias("magnitude"), F.concat(k % 50, F.lit(" km S of "), F.element_at(F.array(F.lit("Boquete"), F.lit("Chitre"), F.lit("Puerto")), (k % 3 + 1).cast("int")), F.lit(", Panama")).alias("place"))
    return told, known


@query("WITH g AS (SELECT event_id AS k, ts FROM events WHERE event_type = 'purchase' AND event_id % 4 <> 0 AND event_id % 3 < 2), e AS (SELECT event_id AS k, ts FROM events WHERE event_type = 'error' AND event_id % 3 < 2), c AS (SELECT g.k AS g, e.k AS e FROM g JOIN e ON g.k % 3 = e.k % 3 AND e.ts BETWEEN g.ts - INTERVAL '48 hours' AND g.ts + INTERVAL '12 hours' AND abs((4 + g.k % 20 / 10) - (4 + e.k % 20 / 10 + 0.05)) <= 0.2) SELECT 'G' || g AS group_id, 'us' || min(e) AS event_id FROM c GROUP BY g HAVING count(*) = 1")
def quake_links(spark, sf):
    return score.quake_links(*_quakes(spark, sf))


@query("SELECT 'I' || e.vec_id AS id, CAST(label AS VARCHAR) AS group_id, round(e.embedding[1], 5) AS similarity, row_number() OVER (PARTITION BY label ORDER BY round(e.embedding[1], 5) DESC, 'I' || e.vec_id) AS rank FROM embeddings e QUALIFY rank <= 10")
def evidence_nearest(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.concat(F.lit("I"), "vec_id").alias("id"), F.col("label").cast("string").alias("group_id"), F.round(F.col("embedding")[0].cast("double"), 5).alias("similarity"))
    return evidence.top_evidence(rows).withColumn("rank", F.col("rank").cast("long"))


# --- evidence and drafts ------------------------------------------------------------


def _evidence(spark, sf):
    rows = news(spark, sf)
    k = F.regexp_extract("group_id", r"G(\d+)", 1).cast("long")
    members = rows.select(F.concat(F.lit("G"), F.col("doc_id") % 80).alias("group_id"), "id", ((F.col("doc_id") * 37 % 101) / 101.0).alias("similarity"))
    asked = members.select("group_id").distinct().withColumns({"topic": F.when(k % 2 == 0, "economia").otherwise("turismo"), "event_id": F.when(k % 5 == 0, F.concat(F.lit("us"), k))})
    names = F.array(*(F.lit(x) for x in ("FP.CPI.TOTL", "NY.GDP.MKTP", "SP.POP.TOTL", "SL.UEM.TOTL", "NE.EXP.GNFS")))
    series = spark.range(5).select(F.explode(F.sequence(F.lit(2015), F.lit(2024))).alias("year"), F.element_at(names, (F.col("id") + 1).cast("int")).alias("indicator"), F.col("id").alias("i")).select(F.lit("PAN").alias("country"), "indicator", F.concat(F.lit("n"), "i").alias("name"), "year", F.when((F.col("year") + F.col("i")) < 2025, (F.col("year") * 10 + F.col("i")).cast("double")).alias("value"), F.lit("%").alias("unit"), F.lit("https://x.org").alias("source_url"), text.indicator_id(F.lit("PAN"), F.col("indicator"), F.col("year")).alias("id_evidence"))
    events = spark.range(0, 80, 10).select(F.concat(F.lit("us"), "id").alias("event_id"), (4 + F.col("id") / 100).alias("magnitude"), F.lit("2024-01-02").cast("timestamp").alias("time"), F.lit("Boquete").alias("place"), F.lit("https://e.org").alias("url"))
    return asked, members, rows, series, events


@query(NEWS + """, m AS (SELECT 'G' || doc_id % 80 AS group_id, doc_id % 80 AS g, * FROM news QUALIFY row_number() OVER (PARTITION BY doc_id % 80 ORDER BY doc_id * 37 % 101 DESC, id) <= 10),
g AS (SELECT DISTINCT doc_id % 80 AS g FROM news),
x AS (SELECT i, ['FP.CPI.TOTL', 'NY.GDP.MKTP', 'SP.POP.TOTL', 'SL.UEM.TOTL', 'NE.EXP.GNFS'][i + 1] AS ind, CAST(2024 - i AS INT) AS year FROM range(5) t(i))
SELECT group_id, id AS id_evidence, 'noticia' AS kind, title AS first_value, 5 AS n_fields FROM m UNION ALL SELECT 'G' || g, 'IND-PAN-' || ind || '-' || year, 'indicador', 'n' || i, 6 FROM g, x WHERE g % 2 = 0 AND ind <> 'SP.POP.TOTL' UNION ALL SELECT 'G' || g, 'us' || g, 'evento', CAST(4 + g / 100 AS VARCHAR), 4 FROM g WHERE g % 10 = 0""")
def evidence_packages(spark, sf):
    found = evidence.gather(*_evidence(spark, sf))
    return found.select("group_id", "id_evidence", "kind", F.coalesce(F.try_element_at("fields", F.lit("titulo")), F.try_element_at("fields", F.lit("indicador_nombre")), F.try_element_at("fields", F.lit("magnitude"))).alias("first_value"), F.size("fields").alias("n_fields"))


@query("SELECT CAST(conv_id AS VARCHAR) AS group_id, 'Tema del grupo: tema ' || conv_id || chr(10) || 'Fuentes (solo dato):' || chr(10) || string_agg('<<<FUENTE id=E' || turn || ' tipo=noticia>>>' || chr(10) || '{\"texto\":' || CAST(to_json(CASE WHEN length(s) > 400 THEN left(s, 400) || '…' ELSE s END) AS VARCHAR) || ',\"vacio\":null}' || chr(10) || '<<<FIN_FUENTE>>>', chr(10) ORDER BY 'E' || turn) AS prompt FROM (SELECT conv_id, turn, replace(replace(text, '<<<', '‹‹‹'), '>>>', '›››') AS s FROM conversations WHERE role = 'user') GROUP BY conv_id")
def prompts(spark, sf):
    packages = _packages(spark, sf)
    topics = packages.select("group_id", F.concat(F.lit("tema "), "group_id").alias("topic")).distinct()
    return grounding.prompts(packages, topics)


def _made_model():
    """A stand-in model: quotes the first source, or says one of several wrong things."""
    import json

    def call(prompt: str) -> str:
        head = prompt.partition("id=")[2].partition(" ")[0]
        topic = int(prompt.split("tema ", 1)[1].split("\n", 1)[0])
        if topic % 7 == 1:
            raise RuntimeError("sin conexión")
        if topic % 7 == 2:
            return "no es JSON"
        claim = {"texto": "hay una nota", "tipo": "hecho", "id_evidencia": head if topic % 7 != 3 else "E99", "campo": "texto"}
        kind = "abstencion" if topic % 7 == 4 else "contradiccion" if topic % 7 == 5 else "respuesta"
        said = {"tipo_respuesta": kind, "afirmaciones": [claim, "suelta"] if kind != "abstencion" else [], "versiones": ["a", "b"] if kind == "contradiccion" else [], "vacios": ["falta fecha"] if topic % 7 == 6 else []}
        return json.dumps(said)

    return call


@query("WITH g AS (SELECT conv_id AS k, count(*) FILTER (role = 'user' AND conv_id % 8 <> 3) AS n, min('E' || turn) FILTER (role = 'user') AS ev FROM conversations GROUP BY conv_id), r AS (SELECT *, CASE WHEN n = 0 THEN 'sin_evidencia' WHEN k % 7 = 1 THEN 'llm_error' WHEN k % 7 = 2 THEN 'esquema_invalido' WHEN k % 7 = 4 THEN 'modelo_abstuvo' WHEN k % 7 = 3 THEN 'sin_sustento' END AS reason FROM g) SELECT CAST(k AS VARCHAR) AS group_id, CASE WHEN reason IS NOT NULL THEN 'abstencion' WHEN k % 7 = 5 THEN 'contradiccion' ELSE 'respuesta' END AS response_type, reason, CASE WHEN reason IS NOT NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS coverage, CASE WHEN reason IS NOT NULL THEN '' ELSE '- hay una nota [' || ev || ' · texto]' END AS first_line, CASE WHEN reason IS NOT NULL THEN 'requiere evidencia' ELSE 'nuevo' END AS review_state FROM r")
def drafts_of_groups(spark, sf):
    packages = _packages(spark, sf).where("cast(group_id as long) % 8 <> 3")
    asked = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("group_id"), F.concat(F.lit("tema "), "conv_id").alias("topic")).distinct()
    made = fichas.draft(asked, packages, _made_model, checkpoint)
    line = F.when(F.col("reason").isNotNull(), "").otherwise(F.split_part("draft", F.lit("\n"), F.lit(1)))
    return made.select("group_id", "response_type", "reason", "coverage", line.alias("first_line"), "review_state")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(64 AS INT) AS dim, CASE WHEN regexp_matches(text, '\\S') THEN 1.0 ELSE 0.0 END::DOUBLE AS size FROM documents")
def encoded(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    first = encode.encode(docs.where("cast(id as long) % 3 = 0"), "id", "text", encode.hash_encoder()).withColumn("model", F.lit("h"))
    stale = first.withColumn("text_hash", F.when(F.col("id").cast("long") % 6 == 0, "x").otherwise(F.col("text_hash")))
    every, _ = encode.encode_missing(docs, stale, "id", "text", "h", encode.hash_encoder())
    return every.select("id", F.size("vector").alias("dim"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 4).alias("size"))


def _topics(spark, sf):
    return table(spark, sf, "benchmark").where("item_id < 6").select(F.col("item_id").cast("int").alias("place"), F.concat(F.lit("T"), "item_id").alias("prototype"), "text")


@query()
def vector_classify(spark, sf):
    """Encoded documents against encoded topics, the last two of them contrast groups."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    topics = _topics(spark, sf)
    protos = encode.encode(topics, "prototype", "text", encode.hash_encoder()).join(topics.select("prototype", "place"), "prototype")
    return classify.by_vectors(encode.encode(docs, "id", "text", encode.hash_encoder()), "id", protos, config.Thresholds(0.25, 0.01), ("T4", "T5"))


@query()
def term_classify(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return classify.by_terms(docs, "id", "text", _topics(spark, sf), config.Thresholds(0.12, 0.02), ("T4", "T5"))


# --- review and evaluation -----------------------------------------------------------


@query(SCORED + ", t AS (SELECT * FROM scored ORDER BY score DESC, U DESC, group_id LIMIT 20) SELECT row_number() OVER (ORDER BY score DESC, U DESC, group_id) AS rango_sistema, group_id AS grupo_id, topic AS tema, score AS puntaje, n_items AS n_noticias FROM t")
def precision_sheet(spark, sf):
    key, sheet = review.precision_sheets(scored(spark, sf))
    return key.join(sheet.select("grupo_id", "n_noticias"), "grupo_id").withColumn("rango_sistema", F.col("rango_sistema").cast("long"))


@query(NEWS + " SELECT id AS id_noticia, title AS titulo, coalesce(outlet, '') AS medio, strftime(detected, '%Y-%m-%d') AS fecha, '' AS tema_humano, '' AS notas FROM news")
def blind_sheet(spark, sf):
    return review.blind_sheet(news(spark, sf))


@query("WITH j AS (SELECT quality, CAST(n_chars > 500 AS INT) AS guess FROM labels JOIN documents USING (doc_id)), s AS (SELECT label, (SELECT count(*) FROM j WHERE quality = label) AS support, (SELECT count(*) FROM j WHERE guess = label) AS given, (SELECT count(*) FROM j WHERE guess = label AND quality = label) AS tp FROM (SELECT unnest([0, 1]) AS label)) SELECT round(avg(coalesce(2.0 * tp / nullif(support + given, 0), 0.0)), 6) AS macro_f1, count(*) AS n_classes FROM s")
def macro_f1(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("guess", (F.col("n_chars") > 500).cast("int"))
    return evaluate.macro_f1(rows, "quality", "guess").select(F.round("macro_f1", 6).alias("macro_f1"), "n_classes")


@query("SELECT 'alta' AS part, count(*) AS n FROM documents UNION ALL SELECT 'cambiada', count(*) FROM documents")
def fingerprints(spark, sf):
    """The mark of a table stays in another order of rows and changes with one cell."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    mark = lambda df: quality.fingerprint(df, ["doc_id", "n_chars"])
    other = docs.withColumn("n_chars", F.when(F.col("doc_id") == 0, -1).otherwise(F.col("n_chars")))
    a, b, c = (mark(df) for df in (docs, docs.orderBy(F.desc("n_chars")), other))
    same = a.join(b, ["fingerprint", "n"]).select(F.lit("alta").alias("part"), "n")
    return same.unionByName(a.alias("a").join(c.alias("c"), F.col("a.fingerprint") != F.col("c.fingerprint")).select(F.lit("cambiada").alias("part"), F.col("c.n").alias("n")))
