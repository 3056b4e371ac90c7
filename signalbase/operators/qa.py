"""Extractive questions over drafts: cited claims or abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import text


def extractive(questions: DataFrame, claims: DataFrame, stop: tuple[str, ...] = config.STOP_WORDS) -> DataFrame:
    """questions: question_id, group_id, question; claims: group_id, pos, claim, citations.

    The first cited claim of the group that shares a term answers; else abstention.
    """
    asked = questions.select("question_id", "group_id", F.explode(text.query_terms(F.col("question"), stop)).alias("term"))
    told = claims.where(F.size("citations") > 0).select("group_id", "pos", "claim", "citations", F.explode(text.query_terms(F.col("claim"), stop)).alias("term"))
    best = asked.join(told, ["group_id", "term"]).groupBy("question_id").agg(F.min(F.struct("pos", "claim", "citations")).alias("best"))
    answered = questions.join(best, "question_id", "left")
    return answered.select("question_id", "group_id", F.col("best.claim").alias("answer"), F.col("best").isNull().alias("abstained"), F.coalesce("best.citations", F.array().cast("array<string>")).alias("citations"))


def contradictions(claims: DataFrame) -> DataFrame:
    """Groups with two or more cited versions: all of them in order, that a review is
    pending, and citations once, in order. claims are those of contradictory drafts."""
    cited = claims.where(F.size("citations") > 0).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim", "citations"))).alias("c")).where(F.size("c") >= 2)
    line = lambda x: F.concat(F.lit("- "), x["claim"], F.lit(" ["), F.array_join(x["citations"], ", "), F.lit("]"))
    answer = F.concat_ws("\n", F.array_join(F.transform("c", line), "\n"), F.lit(config.PENDING_REVIEW))
    return cited.select("group_id", answer.alias("answer"), F.array_distinct(F.flatten(F.transform("c", lambda x: x["citations"]))).alias("citations"))


def ask(questions: DataFrame, claims: DataFrame, drafts: DataFrame) -> DataFrame:
    """(question_id, group_id, answer, abstained, citations, contradiction) of every question.

    drafts: group_id, response_type. A contradictory draft with two cited claims answers
    with all of its versions; else the first cited claim that shares a term, or abstention.
    """
    opposed = claims.join(drafts.where("response_type = 'contradiccion'").select("group_id"), "group_id", "left_semi")
    versions = contradictions(opposed).select("group_id", F.col("answer").alias("_versions"), F.col("citations").alias("_cited"))
    plain = extractive(questions, claims.join(drafts.select("group_id"), "group_id", "left_semi"))
    both = plain.join(versions, "group_id", "left")
    some = F.col("_versions").isNotNull()
    return both.select("question_id", "group_id", F.coalesce("_versions", "answer", F.lit(config.NO_ANSWER)).alias("answer"), (~some & F.col("abstained")).alias("abstained"), F.coalesce("_cited", "citations").alias("citations"), some.alias("contradiction"))


def suggestions(claims: DataFrame, limit: int = 3, stop: tuple[str, ...] = config.STOP_WORDS) -> DataFrame:
    """Up to ``limit`` questions a group, each on the longest word of a cited claim, as
    written, whose term no question before it suggests; of equals the first."""
    told = claims.where(F.size("citations") > 0).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", "claim"))).alias("c"))
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("used"), empty.alias("out"))

    def step(s: Column, x: Column) -> Column:
        words = F.regexp_extract_all(x["claim"], F.lit(r"([\p{L}\p{N}]+)"), 1)
        sized = F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), w.alias("word"), text.query_terms(w, stop).alias("terms")))
        free = F.filter(sized, lambda w: (w["n"] >= 5) & ~w["word"].rlike(r"^\p{Nd}+$") & (F.size(w["terms"]) > 0) & ~F.array_contains(s["used"], F.try_element_at(w["terms"], F.lit(1))))
        best = F.array_max(free)
        some = best.isNotNull() & (F.size(s["out"]) < limit)
        grown = lambda old, new: F.when(some, F.concat(old, new)).otherwise(old)
        return F.struct(grown(s["used"], best["terms"]).alias("used"), grown(s["out"], F.array(best["word"])).alias("out"))

    found = told.select("group_id", F.posexplode(F.aggregate("c", state, step)["out"]).alias("rank", "term"))
    head, tail = config.SUGGESTION.split("{}")
    return found.select("group_id", (F.col("rank") + 1).alias("rank"), F.concat(F.lit(head), "term", F.lit(tail)).alias("question"))


def score_benchmark(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, type_ok, recall, clean_abstention) of answers against expectations.

    expected: question_id, expected_type, required (array of evidence ids).
    """
    joined = expected.join(answers, "question_id", "left")
    opposed = F.coalesce("contradiction", F.lit(False)) if "contradiction" in answers.columns else F.lit(False)
    kind = F.when(opposed, "contradiccion").when(F.coalesce("abstained", F.lit(True)), "abstencion").otherwise("respuesta")
    hit = F.size(F.array_intersect("required", F.coalesce("citations", F.array().cast("array<string>"))))
    recall = F.when(F.size("required") > 0, hit / F.size("required"))
    clean = F.when(kind == "abstencion", F.size(F.coalesce("citations", F.array().cast("array<string>"))) == 0)
    return joined.select("question_id", "expected_type", (kind == F.col("expected_type")).alias("type_ok"), recall.alias("recall"), clean.alias("clean_abstention"))


def run_benchmark(rows: DataFrame, real: tuple[DataFrame, DataFrame], made: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Scores of a benchmark (question_id, group_id, question, expected_type, required,
    synthetic): synthetic questions are asked of ``made`` claims and drafts, others of ``real``."""
    asked = rows.select("question_id", "group_id", "question", "synthetic")
    answers = ask(asked.where("not synthetic"), *real).unionByName(ask(asked.where("synthetic"), *made))
    return score_benchmark(answers.drop("group_id"), rows.select("question_id", "expected_type", "required"))
