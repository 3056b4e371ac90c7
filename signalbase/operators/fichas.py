"""Stored drafts: shape checks, lookup with fallback, context lines, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import dates
from . import grounding


def _kind(path: str) -> str:
    """SQL for the type at a path of variant ``v``: null if absent, VOID for a JSON null."""
    return f"schema_of_variant(try_variant_get(v, '{path}', 'variant'))"


def _string(item: str, path: str) -> str:
    return f"CASE WHEN schema_of_variant(try_variant_get({item}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({item}, '{path}', 'string') END"


def normalize(rows: DataFrame, source: str) -> DataFrame:
    """rows: body (JSON), and id_case, review_state, response_type that override it if set.

    Rows that are no draft go: an object with a string id, state and type, lists of
    citations and claims, and a draft and a reason that are strings if there. Malformed
    items of the lists go alone. A claim keeps its citation if the draft lists it.
    """
    v = rows.withColumn("v", F.expr("try_parse_json(body)"))
    absent = "coalesce({0}, 'VOID') IN ('VOID', 'STRING')"
    lists = " AND ".join(f"({_kind(p)} IS NULL OR {_kind(p)} LIKE 'ARRAY%')" for p in ("$.citas", "$.afirmaciones"))
    sound = v.where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'").where(lists).where(" AND ".join(absent.format(_kind(p)) for p in ("$.borrador", "$.motivo_abstencion")))
    items = lambda p: f"coalesce(try_variant_get(v, '{p}', 'array<variant>'), array())"
    cited = F.expr(f"filter(transform({items('$.citas')}, c -> named_struct('id_evidence', {_string('c', '$.id_evidencia')}, 'field', {_string('c', '$.campo')})), c -> c.id_evidence IS NOT NULL AND c.field IS NOT NULL)")
    told = F.expr(f"filter(transform({items('$.afirmaciones')}, c -> named_struct('text', {_string('c', '$.texto')}, 'id_evidence', {_string('c', '$.id_evidencia')})), c -> c.text IS NOT NULL)")
    shaped = sound.select(
        F.coalesce("id_case", F.expr(_string("v", "$.id_caso"))).alias("id_case"),
        F.coalesce("review_state", F.expr(_string("v", "$.estado_revision"))).alias("review_state"),
        F.coalesce("response_type", F.expr(_string("v", "$.tipo_respuesta"))).alias("response_type"),
        F.expr(_string("v", "$.borrador")).alias("draft"),
        F.expr(_string("v", "$.motivo_abstencion")).alias("reason"),
        cited.alias("citations"),
        told.alias("_told"),
    ).where("id_case IS NOT NULL AND review_state IS NOT NULL AND response_type IS NOT NULL")
    claims = F.transform("_told", lambda c: F.struct(c["text"].alias("text"), F.when(F.exists("citations", lambda x: x["id_evidence"] == c["id_evidence"]), F.array(c["id_evidence"])).otherwise(F.array().cast("array<string>")).alias("citations")))
    return shaped.select("id_case", "review_state", "response_type", "draft", "reason", "citations", claims.alias("claims"), F.lit(source).alias("source"))


def last_lines(lines: DataFrame) -> DataFrame:
    """(id_case, body) of JSON lines (line_no, value): the last line of an id wins; one
    malformed line empties the result."""
    parsed = lines.where(F.trim("value") != "").withColumn("v", F.expr("try_parse_json(value)"))
    sound = F.coalesce(F.expr("schema_of_variant(v) LIKE 'OBJECT%'"), F.lit(False))
    bad = parsed.agg(F.coalesce(F.bool_or(~sound), F.lit(False)).alias("_bad"))  # one row
    kept = parsed.where(sound).select("line_no", "value", F.expr(_string("v", "$.id_caso")).alias("id_case")).where("id_case IS NOT NULL")
    best = kept.groupBy("id_case").agg(F.max_by("value", "line_no").alias("body"))
    return best.crossJoin(F.broadcast(bad)).where("NOT _bad").drop("_bad")


def fetch(asked: DataFrame, stored: DataFrame, lines: DataFrame) -> DataFrame:
    """Drafts of the ids asked (id_case): the table's, else the lines', read only.

    stored: id_case, review_state, response_type, body. An id the table has is never
    looked up in the lines, even where its row is no draft.
    """
    mine = stored.join(asked.select("id_case").distinct(), "id_case", "left_semi")
    rest = asked.select("id_case").distinct().join(stored.select("id_case"), "id_case", "left_anti")
    none = F.lit(None).cast("string")
    found = last_lines(lines).join(rest, "id_case", "left_semi").select("id_case", none.alias("review_state"), none.alias("response_type"), "body")
    return normalize(mine.select("id_case", "review_state", "response_type", F.coalesce("body", F.lit("{}")).alias("body")), "table").unionByName(normalize(found, "lines"))


def claim_context(kind: Column, fields: Column) -> Column:
    """What code, not the model, writes after a claim: country, year and unit of a yearly
    figure, or the date of a news item and whether it circulates again."""
    at = lambda name: F.try_element_at(fields, F.lit(name))
    countries = F.create_map(*(F.lit(x) for pair in config.COUNTRIES.items() for x in pair))
    country = F.coalesce(F.try_element_at(countries, at("pais_iso3")), F.nullif(at("pais_iso3"), F.lit("")), F.lit("país no indicado"))
    figure = F.concat(F.lit(" ("), country, F.lit(" · "), F.coalesce(at("anio"), F.lit("None")), F.lit(" · "), F.coalesce(F.nullif(at("unidad"), F.lit("")), F.lit("unidad no indicada")), F.lit("; dato anual, no una medición de hoy)"))
    day = lambda name: F.left(at(name), F.lit(10)).try_cast("date")
    published, detected = day("fecha_publicacion"), day("fecha_deteccion")
    again = dates.recirculated(published.cast("timestamp"), detected.cast("timestamp"))
    shown = lambda d: F.date_format(d, "yyyy-MM-dd")
    news = (
        F.when(published.isNull() & detected.isNull(), "")
        .when(published.isNull(), F.concat(F.lit(" (detectada "), shown(detected), F.lit("; fecha de publicación no disponible)")))
        .when(F.coalesce(again, F.lit(False)), F.concat(F.lit(" (publicada originalmente "), shown(published), F.lit("; detectada de nuevo "), shown(detected), F.lit(": vuelve a circular, no es un evento nuevo)")))
        .otherwise(F.concat(F.lit(" (publicada "), shown(published), F.lit(")")))
    )
    return F.when(kind == "indicador", figure).when(kind == "noticia", news).otherwise("")


def resolve(groups: DataFrame, packages: DataFrame, answers: DataFrame, validated: DataFrame) -> DataFrame:
    """One final draft per group, with a reason where the engine abstains.

    answers: group_id, answer, error, obeyed, valid, declared, versions and gaps (arrays).
    validated: claims with group_id, pos, text, id_evidence, field, reason.
    """
    items = packages.groupBy("group_id").agg(F.count("*").alias("n_evidence"), F.bool_or(F.col("kind") != "noticia").alias("_official"))
    cited = validated.join(packages.select("group_id", "id_evidence", F.col("kind").alias("_kind"), "fields"), ["group_id", "id_evidence"], "left")
    line = F.concat(F.lit("- "), "text", F.lit(" ["), "id_evidence", F.lit(" · "), "field", F.lit("]"), claim_context(F.col("_kind"), F.col("fields")))
    kept = F.col("reason").isNull()
    told = cited.groupBy("group_id").agg(
        F.count("*").alias("n_claims"), F.count_if(kept).alias("n_kept"),
        F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", line.alias("line"))))), lambda x: x["line"]).alias("_lines"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "id_evidence", "field")))), lambda x: F.struct(x["id_evidence"].alias("id_evidence"), x["field"].alias("field")))).alias("citations"),
    )
    empty = F.array().cast("array<string>")
    all_ = groups.select("group_id").join(items, "group_id", "left").join(answers, "group_id", "left").join(told, "group_id", "left").withColumns(
        {"versions": F.coalesce("versions", empty), "gaps": F.coalesce("gaps", empty), "n_kept": F.coalesce("n_kept", F.lit(0)), "n_evidence": F.coalesce("n_evidence", F.lit(0)), "scope": F.when(F.col("_official"), config.SCOPE_OFFICIAL).otherwise(config.SCOPE_HEADLINES)}
    )
    silent = F.col("declared") == "abstencion"
    reason = (
        F.when(F.col("n_evidence") == 0, "sin_evidencia").when(F.col("answer").isNull(), "llm_error").when(F.col("obeyed"), "inyeccion").when(~F.coalesce("valid", F.lit(True)), "esquema_invalido")
        .when(F.coalesce(silent, F.lit(False)), "modelo_abstuvo").when(F.col("n_kept") == 0, "sin_sustento")
    )
    said = F.when(F.size("gaps") > 0, F.col("gaps"))
    gaps = (
        F.when(F.col("reason") == "sin_evidencia", F.array(F.lit(config.GAP_NONE)))
        .when(F.col("reason") == "llm_error", F.array(F.concat(F.lit(config.GAP_MODEL.split("{}")[0]), F.coalesce("error", F.lit("None")), F.lit(config.GAP_MODEL.split("{}")[1]))))
        .when(F.col("reason") == "inyeccion", F.array(F.lit(config.GAP_INJECTION)))
        .when(F.col("reason").isin("modelo_abstuvo", "sin_sustento"), F.coalesce(said, F.array(F.lit(config.GAP_UNSUPPORTED))))
        .otherwise(F.col("gaps"))
    )
    kind = F.when(F.col("reason").isNotNull(), "abstencion").when((F.col("declared") == "contradiccion") | (F.size("versions") >= 2), "contradiccion").otherwise("respuesta")
    many = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(head), F.array_join(items, "; ")))
    body = F.concat_ws(
        "\n", F.array_join("_lines", "\n"), many("Versiones: ", "versions"),
        F.when(F.col("response_type") == "contradiccion", "Revisión pendiente: las fuentes no coinciden; una persona debe revisarlas antes de usar este borrador."),
        many("Vacíos: ", "gaps"), F.concat(F.lit("Alcance: "), "scope"),
    )
    silence = F.concat(F.lit("Sin borrador: "), F.array_join("gaps", "; "), F.lit("\nAlcance: "), "scope")
    quiet = F.col("reason").isNotNull()
    done = all_.withColumn("reason", reason).withColumn("gaps", gaps).withColumn("response_type", kind)
    return done.select(
        "group_id", "response_type", "reason", F.when(quiet, silence).otherwise(body).alias("draft"),
        F.when(quiet, F.lit(0.0)).otherwise(F.try_divide("n_kept", "n_claims")).alias("coverage"),
        F.when(quiet, F.array().cast("array<struct<id_evidence:string,field:string>>")).otherwise(F.col("citations")).alias("citations"),
        F.when(quiet, config.STATE_UNSUPPORTED).otherwise(config.STATE_NEW).alias("review_state"),
    )


def draft(groups: DataFrame, packages: DataFrame, client, save, injections: tuple[str, ...] = ()) -> DataFrame:
    """Final drafts of groups (group_id, topic) by a model client, from evidence to text.

    Groups without evidence never reach the model. ``save(df)`` keeps the model's answers,
    so that no group is asked twice.
    """
    asked = grounding.prompts(packages.join(groups.select("group_id"), "group_id", "left_semi"), groups)
    said = save(grounding.generate(asked, client))
    parsed = grounding.parse_answers(said.select("group_id", "answer"))
    checked = grounding.validate_claims(grounding.claims_of(parsed), packages)
    obeyed = grounding.obeyed_injection(F.col("answer"), injections) if injections else F.lit(False)
    answers = said.select("group_id", "answer", "error", obeyed.alias("obeyed")).join(parsed.drop("claims"), "group_id")
    return resolve(groups, packages, answers, checked)


def to_store(drafted: DataFrame) -> DataFrame:
    """Drafts to keep: not those whose model call failed, which may be tried again."""
    return drafted.where("reason is null or reason <> 'llm_error'")


def on_demand(groups: DataFrame, states: DataFrame, group_id: str, packages: DataFrame, client, save) -> tuple[str, DataFrame]:
    """(outcome, the draft to store) of one group: 'ya_revisada' without a draft if a person
    has reviewed it, 'error_modelo' without one if the model failed, or 'generada'."""
    mine = groups.where(F.col("group_id") == group_id)
    wanted = grounding.pending(mine, states)
    made = save(draft(wanted, packages, client, save))
    kept = to_store(made)
    if wanted.isEmpty():
        return "ya_revisada", kept
    return ("error_modelo" if kept.isEmpty() else "generada"), kept
