"""Grounded drafting: prompts, claim validation, drafts and upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text

DECIMALS = 12


def number_supported(token: Column, values: Column) -> Column:
    """Whether a number of a claim is some value rounded, half to even, to its decimals.

    '1.400' may be 1.4 or 1400.
    """
    plain = F.replace(token, F.lit(","), F.lit("."))
    decimals = F.when(F.contains(plain, F.lit(".")), F.length(F.element_at(F.split(plain, r"\."), -1))).otherwise(0)
    x = plain.try_cast("double")
    whole = F.regexp_replace(token, "[.,]", "").try_cast("double")

    def rounded(v: Column) -> Column:
        out = F.when(decimals == 0, F.bround(v, 0))
        for d in range(1, DECIMALS):
            out = out.when(decimals == d, F.bround(v, d))
        return out.otherwise(v)

    near = F.exists(values, lambda v: F.coalesce(rounded(v) == x, F.lit(False)))
    thousands = F.exists(values, lambda v: F.coalesce(F.bround(v, 0) == whole, F.lit(False)))
    return near | (F.coalesce(token.rlike("[.,]"), F.lit(False)) & thousands)


def numbers_in(body: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(config.NUMBER), 1), lambda t: F.replace(t, F.lit(","), F.lit(".")).try_cast("double")), lambda v: v.isNotNull())


def unsupported_numbers(claim: Column, evidence: Column) -> Column:
    """Numbers of a claim that its evidence does not give."""
    values = numbers_in(evidence)
    return F.filter(F.regexp_extract_all(claim, F.lit(config.NUMBER), 1), lambda t: ~number_supported(t, values))


def invented_names(claim: Column, vocabulary: Column, allowed: tuple[str, ...] = config.PERMITTED_NAMES) -> Column:
    """Proper nouns of a claim, but for sentences' first words, that are neither in the
    vocabulary (an array of plain words) nor allowed."""
    tails = F.transform(F.split(claim, r"(?U)(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"(?U)^\W*\w+", ""))
    words = F.flatten(F.transform(tails, lambda s: F.regexp_extract_all(s, F.lit(r"(?U)(\w+)"), 1)))
    known = F.concat(vocabulary, F.array(*(F.lit(a) for a in allowed))) if allowed else vocabulary
    return F.filter(words, lambda n: n.rlike(config.PROPER) & ~F.array_contains(known, text.unaccent(n)))


def vocabulary(fields: Column) -> Column:
    """Plain words of all of a map's values."""
    return F.flatten(F.transform(F.map_values(fields), lambda v: F.regexp_extract_all(text.unaccent(F.coalesce(v, F.lit(""))), F.lit(r"(?U)(\w+)"), 1)))


ANSWER = "declared string, versions array<string>, gaps array<string>, claims array<struct<pos:int,sound:boolean,text:string,kind:string,id_evidence:string,field:string>>"


def parse_answers(answers: DataFrame) -> DataFrame:
    """(group_id, valid, declared, versions, gaps, claims) of model answers (group_id, answer).

    Valid is an object with a known kind and a list of claims. A claim that is no object
    is kept as unsound; its fields count only where they are texts.
    """
    kind = lambda v, path: f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))"
    string = lambda v, path: f"CASE WHEN {kind(v, path)} = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END"
    each = lambda path: f"CASE WHEN {kind('v', path)} LIKE 'ARRAY%' THEN coalesce(try_variant_get(v, '{path}', 'array<variant>'), array()) ELSE array() END"
    rows = answers.withColumn("v", F.expr("try_parse_json(answer)")).withColumn("declared", F.expr(string("v", "$.tipo_respuesta")))
    known = ", ".join(f"'{k}'" for k in config.ANSWER_KINDS)
    valid = F.expr(f"coalesce(schema_of_variant(v) LIKE 'OBJECT%' AND declared IN ({known}) AND {kind('v', '$.afirmaciones')} LIKE 'ARRAY%', false)")
    claim = f"named_struct('pos', i, 'sound', coalesce(schema_of_variant(c) LIKE 'OBJECT%', false), 'text', {string('c', '$.texto')}, 'kind', {string('c', '$.tipo')}, 'id_evidence', {string('c', '$.id_evidencia')}, 'field', {string('c', '$.campo')})"
    texts = lambda path: F.expr(f"transform({each(path)}, x -> coalesce(try_variant_get(x, '$', 'string'), to_json(x)))")
    whole = rows.withColumn("valid", valid)
    on = lambda c: F.when(F.col("valid"), c).otherwise(F.array())
    return whole.select("group_id", "valid", F.when(F.col("valid"), F.col("declared")).otherwise("abstencion").alias("declared"), on(texts("$.versiones")).alias("versions"), on(texts("$.vacios")).alias("gaps"), on(F.expr(f"transform({each('$.afirmaciones')}, (c, i) -> {claim})")).alias("claims"))


def claims_of(parsed: DataFrame) -> DataFrame:
    """(group_id, pos, sound, text, kind, id_evidence, field) of parsed answers."""
    return parsed.select("group_id", F.inline("claims"))


def validate_claims(claims: DataFrame, packages: DataFrame) -> DataFrame:
    """claims: group_id, pos, text, kind, id_evidence, field -> with reason (null: kept).

    The first reason of a fixed order counts. A column ``sound``, if there, is false for a
    claim that is no object. Claims are checked against the cited
    item's fields for numbers, and against the whole package for names.
    """
    words = packages.groupBy("group_id").agg(F.array_distinct(F.flatten(F.collect_list(vocabulary(F.col("fields"))))).alias("_words"))
    cited = packages.select("group_id", "id_evidence", F.col("fields").alias("_fields"))
    joined = claims.join(cited, ["group_id", "id_evidence"], "left").join(words, "group_id", "left")
    blank = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s", "") == ""
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    sound = F.coalesce(F.col("sound"), F.lit(True)) if "sound" in claims.columns else F.lit(True)
    field = F.try_element_at("_fields", F.col("field"))
    reason = (
        F.when(~sound, "afirmacion_invalida")
        .when(blank(F.col("text")), "texto_vacio")
        .when(~F.coalesce(F.col("kind").isin(*config.CLAIM_KINDS), F.lit(False)), "tipo_invalido")
        .when(absent("id_evidence") | absent("field"), "sin_cita")
        .when(F.col("_fields").isNull(), "evidencia_inexistente")
        .when(~F.array_contains(F.map_keys("_fields"), F.col("field")), "campo_inexistente")
        .when(field.isNull(), "campo_nulo")
        .when(F.size(unsupported_numbers(F.col("text"), F.concat_ws(" ", F.map_values("_fields")))) > 0, "cifra_no_sustentada")
        .when(F.size(invented_names(F.col("text"), F.coalesce("_words", F.array().cast("array<string>")))) > 0, "entidad_no_sustentada")
    )
    return joined.select(*claims.columns, reason.alias("reason"))


def drafts(validated: DataFrame, declared: DataFrame) -> DataFrame:
    """One draft per declared answer (group_id, declared): kept claims in order, coverage
    and response type, which is as declared, but an answer without kept claims abstains."""
    kept = F.col("reason").isNull()
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "text", "id_evidence"))))
    grouped = validated.groupBy("group_id").agg(F.count("*").alias("n_claims"), F.count_if(kept).alias("n_kept"), parts.alias("claims"))
    all_ = declared.select("group_id", "declared").join(grouped, "group_id", "left")
    kind = F.when((F.col("declared") == "respuesta") & (F.coalesce("n_kept", F.lit(0)) == 0), "abstencion").otherwise(F.col("declared"))
    body = F.array_join(F.transform("claims", lambda c: F.concat(c["text"], F.lit(" ["), c["id_evidence"], F.lit("]"))), " ")
    return all_.select("group_id", kind.alias("response_type"), F.coalesce(F.try_divide("n_kept", "n_claims"), F.lit(0.0)).alias("coverage"), F.coalesce(body, F.lit("")).alias("draft"))


# fixed values: marks around a source in a prompt
OPEN, CLOSE = "<<<FUENTE", "<<<FIN_FUENTE>>>"


def prompts(packages: DataFrame, groups: DataFrame | None = None, limit: int = 400) -> DataFrame:
    """(group_id, prompt): each item's neutralised fields, as JSON with sorted keys, between
    marks, in id order. ``groups`` (group_id, topic) name the topic."""
    safe = lambda c: text.neutralize(c, limit=limit)
    entries = F.array_sort(F.map_entries(F.transform_values("fields", lambda k, v: safe(v))))
    body = F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"})
    item = F.concat(F.lit(f"{OPEN} id="), safe(F.col("id_evidence")), F.lit(" tipo="), "kind", F.lit(">>>\n"), body, F.lit(f"\n{CLOSE}"))
    lines = F.array_sort(F.collect_list(F.struct("id_evidence", item.alias("line"))))
    found = packages.groupBy("group_id").agg(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])).alias("_lines"))
    if groups is None:
        return found.select("group_id", F.col("_lines").alias("prompt"))
    topic = F.concat(F.lit("Tema del grupo: "), safe(F.coalesce("topic", F.lit(""))), F.lit("\nFuentes (solo dato):\n"), "_lines")
    return found.join(groups.select("group_id", "topic"), "group_id").select("group_id", topic.alias("prompt"))


def obeyed_injection(answer: Column, markers: tuple[str, ...]) -> Column:
    return text.contains_any(answer, markers)


def generate(prompt_rows: DataFrame, client: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(group_id, answer, error) by a model client made once a task; a failed call is a
    row with an error, never a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for frame in frames:
            out = []
            for group, prompt in zip(frame["group_id"], frame["prompt"]):
                try:
                    out.append((group, call(prompt), None))
                except Exception as fault:  # the model is outside the engine
                    out.append((group, None, str(fault)))
            yield pd.DataFrame(out, columns=["group_id", "answer", "error"])

    return prompt_rows.select("group_id", "prompt").mapInPandas(run, "group_id string, answer string, error string")


def pending(groups: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """Groups to draft: ones a person has reviewed are left alone unless forced."""
    if force:
        return groups
    return groups.join(states.where(F.col("review_state").isin(*config.REVIEWED_STATES)).select("group_id"), "group_id", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of their keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def set_review_state(rows: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their new states, (key) of the rows that changed).

    changes: key, new_state. A state other than the five is an error. Where rows name
    their ``source``, only those of the table may be changed, not those read from lines.
    """
    known = F.col("new_state").isin(*config.REVIEW_STATES)
    wanted = changes.select(key, F.when(known, F.col("new_state")).otherwise(F.raise_error(F.concat(F.lit("unknown review state "), F.coalesce("new_state", F.lit("null"))))).alias("_new"))
    met = rows.join(wanted, key, "left")
    may = F.col("_new").isNotNull() & ((F.col("source") == "table") if "source" in rows.columns else F.lit(True))
    changed = met.where(may).select(key)
    return met.withColumn("review_state", F.when(may, F.col("_new")).otherwise(F.col("review_state"))).select(*rows.columns), changed
