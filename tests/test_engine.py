"""Behaviour with known answers: urls, rules, links, clusters, claims, questions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import dates, text, vectors
from signalbase.operators import cluster, evaluate, evidence, grounding, qa, quality, score, worklog
from signalbase.sources import files


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_urls(spark):
    row = one(
        spark,
        a=text.normalize_url(F.lit("https://www.tvn-2.com/nota/?utm_source=x&id=5#top")),
        b=text.normalize_url(F.lit("http://tvn-2.com/nota?id=5")),
        c=text.news_id(F.lit("tvn-2.com/nacionales/canal-calado_1")),
        d=text.domain(F.lit("https://WWW.Prensa.com:80/x")),
        e=text.title_from_slug(F.lit("https://x.com/a/lluvias-en_panama_1_22.html")),
        f=text.valid_url(F.lit("nota-sin-esquema")),
        g=text.normalize_url(F.lit("http://a.b/x?gclid=1"), config.TRACKING_LOADER, loader=True),
        h=text.normalize_url(F.lit("https://WWW.TVN-2.com/")),
        i=text.normalize_url(F.lit("https://x.com/?id=5")),
        j=text.normalize_url(F.lit("https://x.com/"), config.TRACKING_LOADER, loader=True),
        k=text.normalize_url(F.lit(None).cast("string"), config.TRACKING_LOADER, loader=True),
    )
    assert (row["h"], row["i"], row["j"], row["k"]) == ("tvn-2.com/", "x.com/?id=5", "//x.com", "")
    assert row["a"] == row["b"] == "tvn-2.com/nota?id=5"
    assert row["c"] == "N-099c59f09535"
    assert (row["d"], row["e"], row["f"], row["g"]) == ("prensa.com:80", "Lluvias en panama", False, "//a.b/x?gclid=1")


def test_dates(spark):
    row = one(
        spark,
        a=dates.iso(dates.parse_iso(F.lit("2026-10-05T14:30:00-05:00"))),
        b=dates.iso(dates.parse_iso(F.lit("2026-10-05"))),
        c=dates.bad_date(F.lit("ayer")),
        d=dates.bad_date(F.lit(" ")),
        e=dates.iso(dates.parse_compact(F.lit("20261006T010000Z"))),
        f=dates.iso(dates.parse_rfc822(F.lit("Mon, 05 Oct 2026 14:30:00 -0500"))),
        g=dates.recirculated(F.lit("2024-06-12").cast("timestamp"), F.lit("2026-07-15").cast("timestamp")),
    )
    assert list(row) == ["2026-10-05T19:30:00Z", "2026-10-05T00:00:00Z", True, False, "2026-10-06T01:00:00Z", "2026-10-05T19:30:00Z", True]


def test_iso_dates_of_all_shapes(spark):
    """As Python reads them, naive ones in UTC."""
    from datetime import datetime, timezone

    texts = ["2026-01-05", "20260105", "2026-W01-1", "2026W011", "2026-W53", "2025-W53", "2020-W53-7", "2024-W00-1", "2026-W10-8", "2026-01-05T10", "2026-01-05 10:20", "20260105T1020", "2026-01-05T10:20:30.5Z", "2026-01-05T10:20:30,123456+05:30", "2026-01-05T102030-0500", "2026-01-05T10:20:30+02", " 2026-01-05T23:59:59 ", "2026-13-01", "2026-02-30", "2026-0105", "ayer", "", "2026", "2026-01-05T25:00"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", F.date_format(dates.parse_iso(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("got")).collect():
        try:
            made = datetime.fromisoformat(r["t"].strip())
            want = (made if made.tzinfo else made.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")
        except ValueError:
            want = None
        assert r["got"] == want, r["t"]


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 777), (None, 500)) for v in np.round(rng.lognormal(0, 3, n), 2)] + [("d", None), ("e", 4.0), ("e", 4.0), ("e", None)]
    got = {r["g"]: r for r in evaluate.latency(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    for g in {g for g, _ in rows}:
        v = [x for k, x in rows if k == g and x is not None]
        assert got[g]["n"] == len(v)
        if v:
            assert got[g]["median"] == pytest.approx(np.median(v)) and got[g]["p95"] == pytest.approx(np.percentile(v, 95))
        else:
            assert got[g]["median"] is None and got[g]["p95"] is None


def test_provenance_and_magnitudes(spark):
    row = one(
        spark,
        a=text.provenance(F.lit("tvn-2.com"), F.lit("Crisis (EFE) hoy"), F.lit("http://x")),
        b=text.provenance(F.lit("tvn-2.com"), F.lit("Jefe del AParato"), F.lit("http://x")),
        c=text.provenance(F.lit(None).cast("string"), F.lit("x"), F.lit(None).cast("string")),
        d=text.magnitudes(F.lit("Sismo de 5.9 sacude")),
        e=text.magnitudes(F.lit("temblor de 4,3 grados")),
        f=text.magnitudes(F.lit("Terremoto de 2024 dejó 1.400 muertos")),
    )
    assert (row["a"], row["b"], row["c"]) == ("agencia:EFE", "tvn-2.com", "desconocido")
    assert (row["d"], set(row["e"]), row["f"]) == ([5.9], {4.3}, [])


def test_scores(spark):
    ts = [("2026-01-10 00:00:00",), ("2026-01-08 00:00:00",)]
    rows = [
        ("a", "Panamá sube", "economia", ["tvn-2.com", "mire.gob.pa"], 2, "2026-01-10 00:00:00", False),
        ("b", "Algo local", "otros", ["x"], 1, "2026-01-08 00:00:00", True),
    ]
    df = spark.createDataFrame(rows, "group_id string, title string, topic string, sources array<string>, n_sources int, last_ts string, is_repeat boolean").withColumn("last_ts", F.col("last_ts").cast("timestamp"))
    got = {r["group_id"]: r for r in score.score_groups(df).collect()}
    assert (got["a"]["score"], got["a"]["priority"], got["a"]["evidence_state"]) == (96.0, "alto", "suficiente")
    # 25 * 0.3 + 20 * 0.7 + 15 * 0.2
    assert (got["b"]["score"], got["b"]["priority"], got["b"]["evidence_state"]) == (24.5, "bajo", "insuficiente")
    assert len(ts) == 2
    with pytest.raises(ValueError):
        config.Rules(weights={"R": 1}).validate()


@pytest.mark.parametrize(
    ("title", "hours", "place", "magnitude", "linked"),
    [
        ("Sismo de magnitud 4.6 en Chiriquí", 1, "10 km S of Chiriqui", 4.6, True),
        ("Sismo de magnitud 4.6 en Chiriquí", 48, "Chiriqui", 4.7, True),
        ("Sismo de magnitud 4.6 en Chiriquí", -12, "Chiriqui", 4.4, True),
        ("Sismo de magnitud 4.6 en Chiriquí", 49, "Chiriqui", 4.6, False),
        ("Sismo de magnitud 4.6 en Chiriquí", -13, "Chiriqui", 4.6, False),
        ("Sismo de magnitud 4.6 en Chiriquí", 1, "Darien", 4.6, False),
        ("Sismo de magnitud 4.6 en Chiriquí", 1, "Chiriqui", 5.0, False),
        ("Fiesta de magnitud 4.6 en Chiriquí", 1, "Chiriqui", 4.6, False),
        ("Sismo en Chiriquí", 1, "Chiriqui", 4.6, False),
    ],
)
def test_quake_links(spark, title, hours, place, magnitude, linked):
    base = F.lit("2026-01-10 00:00:00").cast("timestamp")
    groups = spark.range(1).select(F.lit("g").alias("group_id"), F.lit(title).alias("title"), (base + F.make_dt_interval(hours=F.lit(hours))).alias("ts"))
    events = spark.range(1).select(F.lit("e").alias("event_id"), base.alias("event_ts"), F.lit(magnitude).alias("magnitude"), F.lit(place).alias("place"))
    assert (score.quake_links(groups, events).count() == 1) == linked
    if linked:
        twice = events.union(events.withColumn("event_id", F.lit("f")))
        assert score.quake_links(groups, twice).count() == 0


def test_average_link_does_not_chain():
    s = np.array([[1, 0.526, 0.286], [0.526, 1, 0.585], [0.286, 0.585, 1]])
    assert cluster.average_link(s, 0.5) == [[0], [1, 2]]


def test_average_link_of_large_components(spark):
    rng = np.random.default_rng(0)

    def unit(n, kinds):
        x = rng.normal(size=(kinds, 16))[rng.integers(0, kinds, n)] + rng.normal(0, 0.4, (n, 16))
        return x / np.linalg.norm(x, axis=1)[:, None]

    for least in (0.1, 0.35, 0.8):
        x = unit(300, 20)
        assert cluster.average_link_vectors(x, least) == cluster.average_link(x @ x.T, least)
    kind = np.arange(4500) % 3
    x = np.eye(3)[kind]
    rows = spark.createDataFrame([(i, 0, v) for i, v in enumerate(x.tolist())], "k long, component long, vector array<double>")
    got = cluster.split_components(rows, "k", "vector", 0.35).toPandas()
    assert len(got) == 4500 and (got["cluster"] == got["k"] % 3).all()


def test_span_cap(spark):
    df = spark.range(10).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.col("id").cast("double").alias("d"))
    parts = [r["n"] for r in cluster.cap_span(df, "g", "k", F.col("d"), 3.0).groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    assert parts == [4, 4, 2]
    assert cluster.cap_span(df, "g", "k", F.col("d"), 20.0).select("part").distinct().count() == 1


def test_hash_encoder(spark):
    row = one(spark, a=vectors.dot(vectors.hash_encode(F.lit("lluvia en la capital")), vectors.hash_encode(F.lit("lluvia en la capital"))), b=F.size(vectors.hash_encode(F.lit(""))))
    assert row["a"] == pytest.approx(1.0) and row["b"] == 64


def test_validation(spark):
    rows = [(0, "N-1", "uno", "u", "2026-01-05"), (1, "N-2", "dos", "u", "ayer"), (2, "N-3", "tres", "u", None), (3, "N-4", "cuatro", " ", None)]
    df = spark.createDataFrame(rows, "row int, id string, title string, url string, date string")
    good, bad = quality.validate(df, "row", "id", ["id", "title", "url"], ["date"])
    assert [r["id"] for r in good.orderBy("row").collect()] == ["N-1", "N-3"]
    assert sorted((r["id"], r["field"]) for r in bad.collect()) == [("N-2", "date"), ("N-4", "url")]


def test_claims(spark):
    package = spark.createDataFrame([("g", "I1", "indicador", {"valor": "2.9123", "anio": "2024", "nada": None}), ("g", "N1", "noticia", {"titulo": "Visita a Panamá y Colón"})], "group_id string, id_evidence string, kind string, fields map<string,string>")
    rows = [
        (1, "La inflación fue 2,9 en 2024", "hecho", "I1", "valor", None),
        (2, "La inflación fue 3,1", "declaracion", "I1", "valor", "cifra_no_sustentada"),
        (3, " ", "hecho", "I1", "valor", "texto_vacio"),
        (4, "x", "rumor", "I1", "valor", "tipo_invalido"),
        (5, "x", "inferencia", None, "valor", "sin_cita"),
        (6, "x", "hipotesis", "I9", "valor", "evidencia_inexistente"),
        (7, "x", "hecho", "I1", "otro", "campo_inexistente"),
        (8, "x", "hecho", "I1", "nada", "campo_nulo"),
        (9, "La visita llegó a Bogotá", "hecho", "N1", "titulo", "entidad_no_sustentada"),
        (10, "La visita llegó a Colón", "hecho", "N1", "titulo", None),
        (11, "x", "dato", "I1", "valor", "tipo_invalido"),
        (12, "Según el Banco Mundial fue 3", "hecho", "I1", "valor", None),
        (13, "Fue 2,92", "hecho", "I1", "valor", "cifra_no_sustentada"),
        (14, "Fue 2.024", "hecho", "I1", "valor", None),
    ]
    claims = spark.createDataFrame([("g", *r[:5], True) for r in rows] + [("g", 15, "Fue 3", "hecho", "I1", "valor", False)], "group_id string, pos int, text string, kind string, id_evidence string, field string, sound boolean")
    checked = grounding.validate_claims(claims, package)
    assert {r["pos"]: r["reason"] for r in checked.collect()} == {r[0]: r[5] for r in rows} | {15: "afirmacion_invalida"}
    declared = spark.createDataFrame([("g", "respuesta"), ("h", "respuesta"), ("i", "contradiccion")], "group_id string, declared string")
    got = {r["group_id"]: (r["response_type"], round(r["coverage"], 3)) for r in grounding.drafts(checked, declared).collect()}
    assert got == {"g": ("respuesta", round(4 / 15, 3)), "h": ("abstencion", 0.0), "i": ("contradiccion", 0.0)}


def test_rounding_is_half_to_even(spark):
    cases = [("2", 2.5, True), ("3", 2.5, False), ("4", 3.5, True), ("2,5", 2.45, False), ("2,4", 2.45, True), ("0,12", 0.125, True), ("0,13", 0.125, False), ("1.400", 1.4, True), ("1.400", 1400.0, True), ("1,400", 1400.4, True), ("1,400", 1401.0, False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, token string, v double, want boolean")
    got = df.select("i", "want", grounding.number_supported(F.col("token"), F.array("v")).alias("got")).collect()
    assert [r["i"] for r in got if r["got"] != r["want"]] == []


def test_review_states(spark):
    rows = spark.createDataFrame([("a", "nuevo", "table"), ("b", "descartado", "table"), ("c", "requiere evidencia", "lines"), ("d", "en revisión", "table")], "group_id string, review_state string, source string")
    assert {r["group_id"] for r in grounding.pending(rows.select("group_id"), rows).collect()} == {"a", "c"}
    assert grounding.pending(rows.select("group_id"), rows, force=True).count() == 4
    asked = spark.createDataFrame([("a", "aprobado como borrador"), ("c", "descartado"), ("z", "nuevo")], "group_id string, new_state string")
    after, changed = grounding.set_review_state(rows, asked, "group_id")
    assert {r["group_id"]: r["review_state"] for r in after.collect()} == {"a": "aprobado como borrador", "b": "descartado", "c": "requiere evidencia", "d": "en revisión"}
    assert [r["group_id"] for r in changed.collect()] == ["a"]
    with pytest.raises(Exception, match="unknown review state"):
        grounding.set_review_state(rows, asked.withColumn("new_state", F.lit("borrador")), "group_id")[0].collect()


def test_generation_survives_a_failing_model(spark):
    prompts = spark.createDataFrame([("a", "hola"), ("b", "mal")], "group_id string, prompt string")

    def client():
        def call(prompt):
            if prompt == "mal":
                raise RuntimeError("caído")
            return prompt.upper()

        return call

    got = {r["group_id"]: (r["answer"], r["error"]) for r in grounding.generate(prompts, client).collect()}
    assert got == {"a": ("HOLA", None), "b": (None, "caído")}


def test_questions(spark):
    claims = spark.createDataFrame([("g", 0, "El canal cerró", []), ("g", 1, "El canal abrió el lunes", ["N1"]), ("g", 2, "La ruta cambió", ["N2", "N1"])], "group_id string, pos int, claim string, citations array<string>")
    asked = spark.createDataFrame([(1, "g", "¿Qué pasó con el canal?"), (2, "g", "¿Y el turismo?")], "question_id int, group_id string, question string")
    got = {r["question_id"]: (r["answer"], r["abstained"]) for r in qa.extractive(asked, claims).collect()}
    assert got == {1: ("El canal abrió el lunes", False), 2: (None, True)}
    assert qa.contradictions(claims).first()["citations"] == ["N1", "N2"]
    assert qa.contradictions(claims).first()["answer"] == "- El canal abrió el lunes [N1]\n- La ruta cambió [N2, N1]\nRevisión pendiente: las fuentes no coinciden; no se elige una versión. Una persona debe revisarlas."
    assert [r["question"] for r in qa.suggestions(claims).orderBy("rank").collect()] == ["¿Qué dice la ficha sobre canal?", "¿Qué dice la ficha sobre cambió?"]
    closed = spark.createDataFrame([("g", 0, "El aeropuerto cerrado", ["N1"]), ("g", 1, "Aeropuerto cerrado ayer", ["N1"]), ("g", 2, "aeropuerto 20262026", ["N1"])], "group_id string, pos int, claim string, citations array<string>")
    assert [r["question"] for r in qa.suggestions(closed).orderBy("rank").collect()] == ["¿Qué dice la ficha sobre aeropuerto?", "¿Qué dice la ficha sobre cerrado?"]
    for kind, want in (("contradiccion", (True, ["N1", "N2"])), ("respuesta", (False, ["N1"]))):
        drafts = spark.createDataFrame([("g", kind)], "group_id string, response_type string")
        got = {r["question_id"]: r for r in qa.ask(asked, claims, drafts).collect()}
        assert (got[1]["contradiction"], got[1]["citations"]) == want
    assert got[2]["abstained"] and got[2]["answer"] == config.NO_ANSWER
    none = spark.createDataFrame([("x", "respuesta")], "group_id string, response_type string")
    assert all(r["abstained"] for r in qa.ask(asked, claims, none).collect())


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a"), ("b", "b")], "y string, p string")
    got = {r["label"]: (round(r["precision"], 4), r["recall"]) for r in evaluate.per_class(df, "y", "p").collect()}
    assert got == {"a": (0.6667, 1.0), "b": (1.0, 0.5)}


def test_epics(spark):
    epics = spark.createDataFrame([("E1",), ("E2",)], "id string")
    tasks = spark.createDataFrame([("E1", "Hecho"), ("E1", "Bloqueada"), ("E1", "Pendiente")], "epic string, state string")
    got = {r["id"]: (r["progress"], r["state"]) for r in worklog.epic_progress(epics, tasks).collect()}
    assert got == {"E1": ("███░░░░░░░ 33% (1/3)", "En curso"), "E2": ("░░░░░░░░░░ 0% (0/0)", "Pendiente")}
    assert worklog.next_id(spark.createDataFrame([("T-007",), ("T-010",)], "id string"), "id", "T").first()[0] == "T-011"


def test_latest_with_value(spark):
    df = spark.createDataFrame([("x", 2022, 2.9), ("x", 2023, None)], "k string, y int, v double")
    assert evidence.latest_per_key(df, ["k"], "y", "v").first()["y"] == 2022


def test_sources(spark, tmp_path):
    (tmp_path / "rss_20261006T010000Z.xml").write_text("<rss><channel><item><title>T1</title><link>https://x.com/a</link><pubDate>Mon, 05 Oct 2026 14:30:00 -0500</pubDate></item></channel></rss>")
    row = files.read_rss(spark, str(tmp_path / "rss_20261006T010000Z.xml")).first()
    assert (row["title"], str(row["published"]), str(row["detected"])) == ("T1", "2026-10-05 19:30:00", "2026-10-06 01:00:00")
    (tmp_path / "e.json").write_text('{"features":[{"geometry":{"coordinates":[-80.1,8.2,10.0]},"properties":{"id":"us1","mag":4.5,"place":"P","time":1000,"updated":2000}}]}')
    row = files.read_events(spark, str(tmp_path / "e.json")).first()
    assert (row["id"], row["lon"], row["depth"], row["magnitude"]) == ("us1", -80.1, 10.0, 4.5)
    (tmp_path / "c.csv").write_text('id,title\n1,"dice ""hola"", y\nsigue"\n')
    assert files.read_csv(spark, str(tmp_path / "c.csv"), "id", "title").first()["title"] == 'dice "hola", y\nsigue'
    (tmp_path / "j.jsonl").write_text('{"a":1}\n{bad\n')
    assert files.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").count() == 1
    assert files.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int", skip_bad=False).count() == 0


def test_streaming(spark, tmp_path):
    from signalbase.streaming import captures

    src = str(tmp_path / "in")
    spark.createDataFrame([("http://x/a?utm_a=1", "2026-01-01 00:00:00"), ("https://x/a", "2026-01-01 00:05:00"), ("https://x/b", "2026-01-01 00:06:00")], "url string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = captures.new_items(spark.readStream.schema("url string, ts timestamp").parquet(src), "url", "ts", "1 hour")
    stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["key"] for r in spark.table("seen").collect()) == ["x/a", "x/b"]
