"""Drafts, blocks, windows, reports and line merges with known answers."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalbase import config
from signalbase.functions import display
from signalbase.operators import fichas, quality, worklog
from signalbase.sinks import files as out
from signalbase.sinks import reports
from signalbase.sources import files, windows

LINES = "line_no long, value string"
STORED = "id_case string, review_state string, response_type string, body string"


def draft(**more):
    return {"id_caso": "G-1", "estado_revision": "nuevo", "tipo_respuesta": "respuesta", "citas": [{"id_evidencia": "N-1", "campo": "titulo"}, {"id_evidencia": 5}], "afirmaciones": [{"texto": "a", "id_evidencia": "N-1"}, {"texto": "b", "id_evidencia": "N-9"}, {"texto": 3}], **more}


def shaped(spark, *bodies):
    rows = spark.createDataFrame([(None, None, None, b if isinstance(b, str) else json.dumps(b)) for b in bodies], STORED)
    return fichas.normalize(rows, "lines").collect()


def test_shape_of_drafts(spark):
    (row,) = shaped(spark, draft())
    assert [tuple(c) for c in row["citations"]] == [("N-1", "titulo")]
    assert [(c["text"], c["citations"]) for c in row["claims"]] == [("a", ["N-1"]), ("b", [])]
    assert len(shaped(spark, draft(borrador=None), {"id_caso": "x", "estado_revision": "nuevo", "tipo_respuesta": "respuesta"})) == 2
    bad = [draft(borrador=4), draft(citas={}), draft(citas=None), draft(afirmaciones="x"), draft(id_caso=4), draft(estado_revision=None), draft(motivo_abstencion=[1]), "[1]", "{", "null"]
    assert shaped(spark, *bad) == []


def test_lookup_falls_back_to_lines(spark):
    asked = spark.createDataFrame([("G-1",), ("G-2",), ("G-3",), ("G-2",)], "id_case string")
    stored = spark.createDataFrame([("G-1", "revisado", "respuesta", json.dumps(draft())), ("G-3", "nuevo", "respuesta", "{")], STORED)
    lines = [(1, json.dumps(draft(id_caso="G-2", borrador="viejo"))), (2, " "), (3, json.dumps(draft(id_caso="G-2", borrador="nuevo"))), (4, json.dumps(draft(id_caso="G-3")))]
    got = {r["id_case"]: r for r in fichas.fetch(asked, stored, spark.createDataFrame(lines, LINES)).collect()}
    assert {i: (r["source"], r["review_state"], r["draft"]) for i, r in got.items()} == {"G-1": ("table", "revisado", None), "G-2": ("lines", "nuevo", "nuevo")}
    for bad in ("{", "7"):
        broken = spark.createDataFrame([*lines, (5, bad)], LINES)
        assert [r["id_case"] for r in fichas.fetch(asked, stored, broken).collect()] == ["G-1"]
    assert fichas.fetch(asked, stored.where("false"), spark.createDataFrame([], LINES)).count() == 0


def test_context_of_claims(spark):
    cases = [
        ("indicador", {"pais_iso3": "PAN", "anio": "2023", "unidad": "%"}, " (Panamá · 2023 · %; dato anual, no una medición de hoy)"),
        ("indicador", {"anio": "2023"}, " (país no indicado · 2023 · unidad no indicada; dato anual, no una medición de hoy)"),
        ("noticia", {"fecha_publicacion": "2024-05-01T10:00:00Z", "fecha_deteccion": "2024-06-15"}, " (publicada originalmente 2024-05-01; detectada de nuevo 2024-06-15: vuelve a circular, no es un evento nuevo)"),
        ("noticia", {"fecha_publicacion": "2024-05-01"}, " (publicada 2024-05-01)"),
        ("noticia", {"fecha_deteccion": "2024-06-15"}, " (detectada 2024-06-15; fecha de publicación no disponible)"),
        ("noticia", {}, ""),
        ("evento", {}, ""),
    ]
    df = spark.createDataFrame([(i, k, f) for i, (k, f, _) in enumerate(cases)], "i int, kind string, fields map<string,string>")
    got = {r["i"]: r["c"] for r in df.select("i", fichas.claim_context(F.col("kind"), F.col("fields")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c for _, _, c in cases]


def test_resolution(spark):
    names = ["kept", "empty", "failed", "obeyed", "broken", "silent", "unsupported", "versions"]
    groups = spark.createDataFrame([(n,) for n in names], "group_id string")
    packages = spark.createDataFrame([(n, "N-1", "noticia", {"fecha_publicacion": "2024-05-01"}) for n in names if n != "empty"], "group_id string, id_evidence string, kind string, fields map<string,string>")
    said = {"obeyed": (True, True, "respuesta", []), "broken": (False, False, "respuesta", []), "silent": (False, True, "abstencion", []), "versions": (False, True, "respuesta", ["a", "b"])}
    answers = [(n, None if n == "failed" else "{}", "sin red" if n == "failed" else None, *said.get(n, (False, True, "respuesta", [])), []) for n in names if n != "empty"]
    answers = spark.createDataFrame(answers, "group_id string, answer string, error string, obeyed boolean, valid boolean, declared string, versions array<string>, gaps array<string>")
    claims = [(n, p, "texto", "N-1", "titulo", "sin_cita" if n == "unsupported" or p else None) for n in names if n not in ("empty", "failed") for p in (0, 1)]
    validated = spark.createDataFrame(claims, "group_id string, pos int, text string, id_evidence string, field string, reason string")
    got = {r["group_id"]: r for r in fichas.resolve(groups, packages, answers, validated).collect()}
    assert {n: got[n]["reason"] for n in names} == {"kept": None, "empty": "sin_evidencia", "failed": "llm_error", "obeyed": "inyeccion", "broken": "esquema_invalido", "silent": "modelo_abstuvo", "unsupported": "sin_sustento", "versions": None}
    assert (got["kept"]["response_type"], got["kept"]["coverage"], got["versions"]["response_type"]) == ("respuesta", 0.5, "contradiccion")
    assert got["kept"]["draft"] == f"- texto [N-1 · titulo] (publicada 2024-05-01)\nAlcance: {config.SCOPE_HEADLINES}"
    assert got["failed"]["draft"] == f"Sin borrador: El modelo no devolvió una salida utilizable (sin red).\nAlcance: {config.SCOPE_HEADLINES}"
    assert "Versiones: a; b\nRevisión pendiente" in got["versions"]["draft"]
    assert {got[n]["review_state"] for n in ("kept", "empty")} == {"nuevo", "requiere evidencia"}


def test_markdown_blocks(spark):
    body = "# Uno\n\ntexto\n- punto\n2) dos\n> cita\n---\n```py\na = 1\n\n  b\n```\n#### no\n```\nabierto"
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "```\n```"), (5, "```")], "k int, body string")
    rows = {}
    for r in display.markdown_blocks(df, "k", "body").orderBy("k", "pos").collect():
        rows.setdefault(r["k"], []).append((r["kind"], r["text"]))
    assert rows[1] == [("heading_1", "Uno"), ("paragraph", "texto"), ("bulleted_list_item", "punto"), ("numbered_list_item", "dos"), ("quote", "cita"), ("divider", ""), ("code", "a = 1\n\n  b"), ("paragraph", "#### no"), ("code", "abierto")]
    assert rows[4] == [("code", "")] and rows.keys() == {1, 4}


def test_text_helpers(spark):
    row = spark.range(1).select(
        display.page_id(F.lit("https://x.com/Plan-0123456789abcdef0123456789ABCDEF?v=1")).alias("a"), display.page_id(F.lit("nada")).alias("b"), display.joined_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))).alias("c"),
        display.percent(F.lit(-3)).alias("d"), display.percent(F.lit(None).cast("double")).alias("e"), F.size(display.motive_parts(F.lit("sin formato"))).alias("f"),
    ).first()
    assert list(row) == ["01234567-89ab-cdef-0123-456789abcdef", None, "a=1 · b=None", 0.0, None, 0]
    ids = spark.createDataFrame([("T-999",), ("T-1234",), ("X-5000",), (None,)], "id string")
    assert worklog.next_id(ids, "id", "T").first()[0] == "T-1235"
    assert worklog.next_id(ids.where("false"), "id", "T").first()[0] == "T-001"


def test_windows_split_where_full():
    first = datetime(2024, 1, 1)
    search = lambda q, a, b: [{}] * int((b - a).total_seconds() // 600)
    got = list(windows.leaves(search, "q", first, first + timedelta(days=6)))
    assert [g[0] for g in got[1:]] == [g[1] for g in got[:-1]] and got[-1][1] == first + timedelta(days=6)
    assert all(len(g[2]) < windows.FULL for g in got)
    busy = lambda q, a, b: [{}] * 250
    assert len(list(windows.leaves(busy, "q", first, first + timedelta(hours=2)))) == 1
    assert len(list(windows.leaves(busy, "q", first, first + timedelta(days=400)))) == 2**windows.DEPTH
    assert list(windows.leaves(search, "q", first, first + timedelta(hours=1), frozenset({("q", first, first + timedelta(hours=1))}))) == []


def test_busy_answers_are_tried_again():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise windows.Busy(429)
        return [{"url": "u"}]

    assert windows.retried(call, wait=waits.append) == [{"url": "u"}] and waits == [1.0, 2.0]
    with pytest.raises(windows.Busy):
        windows.retried(lambda: (_ for _ in ()).throw(windows.Busy(404)), wait=waits.append)


def test_reports_vectors_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1), (None, 2)], "x string, n int").orderBy("n")
    assert reports.table(df, "T") == "## T\n\n| x | n |\n|-|-|\n| a\\|b | 1 |\n|  | 2 |\n"
    with pytest.raises(ValueError):
        reports.table(df, "T", most=1)
    rows = spark.createDataFrame([("d1", "h", [1.0, 0.0])], "id string, text_hash string, vector array<float>")
    out.append_vectors(rows, str(tmp_path), "org/model v1")
    assert files.read_vectors(spark, str(tmp_path), "org/model v1").count() == 1
    old = spark.createDataFrame([('{"id": "a", "n": 1}',), ("no json",), ('{"id": "b"}',)], "value string")
    new = spark.createDataFrame([("a", '{"id": "a", "n": 2}')], "id string, value string")
    assert sorted(r[0] for r in out.merge_jsonl(old, new, "id").collect()) == sorted(["no json", '{"id": "a", "n": 2}', '{"id": "b"}'])
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps({"id_caso": "g", "n": i}) for i in range(50)))
    assert json.loads(fichas.last_lines(files.read_numbered(spark, str(tmp_path / "l.jsonl"))).first()["body"])["n"] == 49


def test_unchanged_input_is_known(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "id int, text string")
    _, mark = quality.unchanged(df, ["id", "text"], None, "1")
    assert quality.unchanged(df.orderBy(F.desc("id")), ["id", "text"], mark, "1")[0]
    assert not quality.unchanged(df, ["id", "text"], mark, "2")[0]
    other = spark.createDataFrame([(3, "b"), (3, "b"), (2, None)], "id int, text string")
    assert not quality.unchanged(other, ["id", "text"], mark, "1")[0]
