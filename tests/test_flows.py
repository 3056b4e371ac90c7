"""Flows against plain versions: merging pages, grouping events, classifying, files."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import encode
from signalbase.operators import classify, cluster, fichas, ingest, quality
from signalbase.plans import catalogue, flows
from signalbase.session import checkpoint, shared_folder
from signalbase.sinks import files as sinks
from signalbase.sinks import reports
from signalbase.sources import files as sources
from signalbase.sources import rules

RANK = {o: i for i, o in enumerate(ingest.ORIGINS)}


def fold(rows):
    """Pages as they are when rows come one after the other."""
    kept = {}
    for r in rows:
        key = r["url"].lower().replace("www.", "").partition("//")[2]
        if key not in kept:
            kept[key] = dict(r)
            continue
        k = kept[key]
        best = min(RANK[o] for o in k["origin"].split("|"))
        k["topic"] = "|".join(sorted(set(filter(None, (k["topic"] or "").split("|"))) | ({r["topic"]} if r["topic"] else set()))) or None
        if r["origin"] not in k["origin"].split("|"):
            k["origin"] += "|" + r["origin"]
        for c in ("published", "lang", "outlet"):
            k[c] = k[c] or r[c]
        if r["detected"] and (not k["detected"] or r["detected"] < k["detected"]):
            k["detected"] = r["detected"]
        if RANK[r["origin"]] < best:
            k["title"] = r["title"]
            for c in ("lang", "outlet", "scope"):
                k[c] = r[c] or k[c]
    return kept


def test_pages_merge_as_if_rows_came_one_by_one(spark):
    rng = np.random.default_rng(1)
    rows, some = [], lambda *v: [*v, None][int(rng.integers(0, len(v) + 1))]
    for i in range(600):
        day = f"2024-01-{int(rng.integers(1, 28)):02d}"
        rows.append({"title": f"t{i}", "url": f"https://{some('www.', '') or ''}x.com/{int(rng.integers(0, 90))}", "outlet": some("a", "b"), "lang": some("es", "en"), "published": some(day), "detected": some(day), "extracted": "e", "topic": some("t1", "t2", "t3"), "origin": ["gdelt", "tvn_sitemap", "tvn_rss"][int(rng.integers(0, 3))], "scope": some("s1", "s2"), "at": i})
    kept = fold(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} {'long' if c == 'at' else 'string'}" for c in rows[0]))
    got = ingest.merge_pages(ingest.union_scans((df, "at"))).collect()
    assert len(got) == len(kept) == len({r["id"] for r in got})
    for r in got:
        want = kept[r["url"].lower().replace("www.", "").partition("//")[2]]
        for c in ("title", "url", "outlet", "lang", "published", "detected", "topic", "origin", "scope"):
            assert r[c] == want[c], c
    assert sum(r["n_merged"] for r in got) == 600


def test_events_group_as_by_definition(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    n, window, least, span = 180, 3.0, 0.6, 4.0
    x = centers[rng.integers(0, 12, n)] + rng.normal(0, 0.6, (n, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    day = np.round(rng.uniform(0, 30, n), 2)
    df = spark.createDataFrame([(i, float(day[i]), x[i].tolist()) for i in range(n)], "k long, d double, v array<double>")
    label = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if abs(day[i] - day[j]) <= window and x[i] @ x[j] >= least]
    assert {tuple(sorted(p)) for p in pairs} == {(r["a"], r["b"]) for r in cluster.banded_pairs(df, "k", "d", "v", window, least).collect()}
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    want = set()
    for c in set(label):
        mine = sorted((i for i in range(n) if label[i] == c), key=lambda i: (day[i], i))
        y = x[mine]
        for part in cluster.average_link(y @ y.T, least):
            group = []
            for i in sorted((mine[k] for k in part), key=lambda i: (day[i], i)):
                if group and day[i] - day[group[0]] > span:
                    want.add(frozenset(group))
                    group = []
                group.append(i)
            want.add(frozenset(group))
    for block in (1024, 16):
        cluster.BLOCK = block
        got = {}
        for r in cluster.group_events(df, "k", "d", "v", window, least, span, checkpoint).collect():
            got.setdefault(r["group"], set()).add(r["k"])
        assert {frozenset(g) for g in got.values()} == want and all(min(g) == name for name, g in got.items())
    cluster.BLOCK = 1024
    assert len(want) < n and max(map(len, want)) > 3
    assert cluster.group_events(df.where("false"), "k", "d", "v", window, least, span, checkpoint).count() == 0


def test_components_of_chains_and_texts(spark):
    chain = spark.range(300).select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("k"))
    pairs = spark.range(299).where("id % 100 <> 99").select(F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("a"), F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("b")).repartition(7)
    got = {r["k"]: r["component"] for r in cluster.components(chain, pairs, "k", checkpoint).collect()}
    assert got == {f"n{i:03d}": f"n{i // 100 * 100:03d}" for i in range(300)}


def test_span_streams_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(400).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") / 10).alias("d"))
        got = {r["k"]: r["part"] for r in cluster.cap_span(df, "g", "k", F.col("d"), 2.5).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    for g in range(3):
        start, part = None, 0
        for k in range(g, 400, 3):
            if start is not None and k / 10 - start > 2.5:
                start, part = k / 10, part + 1
            start = k / 10 if start is None else start
            assert got[k] == part


def _plain_top(scores, contrast, limits):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], -i))
    best, second = order[0], order[1]
    if best in contrast:
        return "otros", f"T{best}", f"T{best}"
    low = scores[best] < limits[0] or scores[best] - scores[second] < limits[1]
    return "otros" if low else f"T{best}", f"T{best}", None


def test_vector_and_term_classifiers(spark):
    docs = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    topics = [r["text"] for r in flows._topics(spark, SF).orderBy("place").collect()]
    call = encode.hash_encoder()()
    protos = encode.unit_rows(call(topics))
    sure = 0
    got = {r["id"]: r for r in flows.vector_classify(spark, SF).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        s = (encode.unit_rows(call([t or ""])).astype(np.float64) @ protos.T.astype(np.float64))[0]
        top = np.sort(s)[::-1]
        if min(top[0] - top[1], abs(top[0] - 0.25), abs(top[0] - top[1] - 0.01)) > 1e-6:
            sure += 1
            assert (got[i]["topic"], got[i]["best"], got[i]["contrast"]) == _plain_top(s.tolist(), (4, 5), (0.25, 0.01))
    assert sure > 900
    by_terms = flows.term_classify(spark, SF).collect()
    assert len(by_terms) == len(docs) and {r["topic"] for r in by_terms} <= {"T0", "T1", "T2", "T3", "otros"}
    near = spark.createDataFrame([("a", topics[0]), ("b", "zzz qqq"), ("c", ""), ("d", topics[5])], "id string, text string")
    named = {r["id"]: (r["topic"], r["contrast"], r["score"]) for r in classify.by_terms(near, "id", "text", flows._topics(spark, SF), config.Thresholds(0.12, 0.02), ("T4", "T5")).collect()}
    assert named["a"][0] == "T0" and named["b"] == named["c"] == ("otros", "T5", 0.0) and named["d"][:2] == ("otros", "T5")


def test_a_second_encoding_does_nothing(spark):
    items = spark.createDataFrame([("a", "uno"), ("b", None), ("c", "tres")], "id string, text string")
    none = spark.createDataFrame([], "id string, text_hash string, vector array<float>, model string")
    every, made = encode.encode_missing(items, none, "id", "text", "m", encode.hash_encoder())
    assert every.count() == made.count() == 3
    cache = checkpoint(made)
    again, made = encode.encode_missing(items, cache, "id", "text", "m", encode.hash_encoder())
    assert (again.count(), made.count()) == (3, 0)
    changed = items.withColumn("text", F.when(F.col("id") == "a", "otro").otherwise(F.col("text")))
    assert [r["id"] for r in encode.encode_missing(changed, cache, "id", "text", "m", encode.hash_encoder())[1].collect()] == ["a"]


def test_rules_and_topics_from_files(tmp_path):
    path = tmp_path / "rules.yaml"
    path.write_text("version: v9\npesos: {R: 20, I: 20, U: 20, N: 20, E: 20}\nrangos: {bajo: {lo: 0, hi: 50}, alto: {lo: 50, hi: 100}}\nu_tramos:\n  - {horas_max: 1, score: 1.0}\n  - {horas_max: null, score: 0.5}\nvinculo_usgs: {tolerancia_magnitud: 0.3}\n")
    made = rules.read_rules(str(path))
    assert (made.version, made.weights["E"], made.ranges[1], made.recency[-1], made.link_tolerance) == ("v9", 20, ("alto", 50, 100), (None, 0.5), 0.3)
    assert made.topics == config.Rules().topics
    for bad in ("pesos: {R: 50, I: 20}", "rangos: {bajo: {lo: 0, hi: 40}, alto: {lo: 50, hi: 100}}"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            rules.read_rules(str(path))
    path.write_text("parametros: {umbral_score: 0.3, umbral_margen_tfidf: 0.05}\ntemas:\n  a: {descripcion: ' Uno ', semillas: [x, y]}\n  b: {}\ncontraste:\n  ruido: {semillas: [z]}\n")
    topics = rules.read_topics(str(path))
    assert topics.prototypes == [("a", "Uno. x. y"), ("b", ". "), ("ruido", ". z")] and topics.contrast == ("ruido",)
    assert (topics.dense.score, topics.sparse.margin) == (0.3, 0.05)
    path.write_text("parametros: {usar_contraste: false}\ntemas: {a: {semillas: [x]}}\ncontraste: {r: {}}\n")
    assert rules.read_topics(str(path)).contrast == ()


def test_drafts_on_demand(spark):
    packages = catalogue._packages(spark, SF)
    asked = packages.select("group_id", F.concat(F.lit("tema "), "group_id").alias("topic")).distinct()
    k = F.col("group_id").cast("long")
    states = asked.where(k % 2 == 0).select("group_id", F.lit("descartado").alias("review_state"))
    ids = [r["group_id"] for r in asked.collect()]
    seen = next(i for i in ids if int(i) % 2 == 0)
    failing = next(i for i in ids if int(i) % 2 and int(i) % 7 == 1)
    fine = next(i for i in ids if int(i) % 2 and int(i) % 7 == 0)
    for one, outcome, n in ((seen, "ya_revisada", 0), (failing, "error_modelo", 0), (fine, "generada", 1)):
        got = fichas.on_demand(asked, states, one, packages, flows._made_model, checkpoint)
        assert (got[0], got[1].count()) == (outcome, n)


def test_attached_views_refuse_writes(spark):
    views = sources.attach(spark, "solo", SF)
    assert "solo__nation" in views and spark.table("solo__nation").count() == 25
    with pytest.raises(Exception):
        spark.range(1).write.insertInto("solo__nation")
    sources.detach(spark, views)
    assert not spark.catalog.tableExists("solo__nation")


def test_cache_follows_files(spark):
    path, calls = f"{shared_folder(spark)}/cached-table", []

    def make(p):
        calls.append(p)
        return spark.read.parquet(p)

    cache = sinks.Cache(spark)
    spark.range(3).write.mode("overwrite").parquet(path)
    assert cache.get(path, make).count() == cache.get(path, make).count() == 3 and len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert cache.get(path, make).count() == 5 and len(calls) == 2


def test_unknown_labels_are_errors(spark):
    path = f"{shared_folder(spark)}/labels-bad.csv"
    sinks.write_csv(spark.createDataFrame([("a", "buena"), ("b", "rara")], "id string, label string"), path)
    with pytest.raises(Exception, match="unknown label rara"):
        sources.read_labels(spark, path, "id", "label", ("buena", "mala"), "id", "label").collect()


def test_reports_of_loads_and_classes(spark):
    rows = flows._scans(spark, SF)
    good, bad = ingest.split_excluded(rows)
    text = reports.load_report(ingest.merge_pages(good), bad)
    assert text.startswith("# Reporte de carga") and "| sin_titulo |" in text and "| 2024-01 |" in text
    labelled = spark.createDataFrame([("a", "a", None), ("b", "otros", "b"), ("a", "a", "a")], "truth string, x string, y string")
    text = reports.classification_report(labelled, "truth", {"uno": "x", "dos": "y"})
    assert "## Método uno" in text and "## Confusión de dos" in text
    assert "## Por tipo esperado" in reports.benchmark_report(catalogue.qa_benchmark(spark, SF))


def test_first_rows_and_null_keys(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (5, None), (4, "")], "row int, t string")
    first, later = quality.keep_first(df, "t", "row")
    assert sorted(r["row"] for r in first.collect()) == [1, 2, 4]
    assert first.count() + later.count() == 5


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://x:7077"
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
