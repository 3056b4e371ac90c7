"""Prototype classification with abstention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text, vectors


def tfidf(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, term, weight): 1 + ln(tf), smooth idf, unit rows; terms of two letters or more.

    Document frequencies come from the counts themselves, so texts are split once.
    """
    terms = df.select(key, F.explode(F.regexp_extract_all(text.unaccent(F.col(body)), F.lit(r"([a-z0-9_]{2,})"), 1)).alias("term"))
    tf = terms.groupBy(key, "term").agg(F.count("*").alias("c"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n"))
    raw = tf.join(idf, "term").crossJoin(F.broadcast(n)).select(key, "term", ((1 + F.ln("c")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


MOST_PROTOTYPES = 4096


def sparse_scores(weights: DataFrame, key: str, prototypes: DataFrame, items: DataFrame) -> DataFrame:
    """(key, prototype, score): cosine of every item and prototype, 0 without a shared term.

    prototypes: prototype, term, weight; they are topics, ``MOST_PROTOTYPES`` at most.
    """
    names = _few(prototypes.select("prototype").distinct())
    other = prototypes.select("prototype", "term", F.col("weight").alias("_w"))
    met = weights.join(other, "term").groupBy(key, "prototype").agg(F.sum(F.col("weight") * F.col("_w")).alias("score"))
    every = items.select(key).crossJoin(F.broadcast(names))
    return every.join(met, [key, "prototype"], "left").select(key, "prototype", F.coalesce("score", F.lit(0.0)).alias("score"))


def _few(prototypes: DataFrame) -> DataFrame:
    if prototypes.count() > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    return prototypes


def dense_scores(items: DataFrame, key: str, vector: str, prototypes: DataFrame) -> DataFrame:
    """(key, prototype, score) against prototypes (prototype, vector), ``MOST_PROTOTYPES`` at most."""
    other = F.broadcast(_few(prototypes).select("prototype", F.col("vector").alias("_v")))
    return items.crossJoin(other).select(key, "prototype", vectors.dot(F.col(vector), F.col("_v")).alias("score"))


def decide(scores: DataFrame, key: str, order: Column, limits: config.Thresholds = config.Thresholds(), contrast: tuple[str, ...] = ()) -> DataFrame:
    """Best and second prototype of each key and the topic, or abstention.

    Of equal scores the later prototype in ``order`` wins. A contrast prototype, which is
    named then, or a score or a margin under its limit means 'otros'.
    """
    ranked = scores.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), order.desc())))
    top = ranked.where("_n <= 2").groupBy(key).agg(*(F.max(F.when(F.col("_n") == n, F.col(c))).alias(f"{c}{n}") for n in (1, 2) for c in ("prototype", "score")))
    margin = F.col("score1") - F.coalesce("score2", F.lit(0.0))
    abstain = F.col("prototype1").isin(*contrast) if contrast else F.lit(False)
    topic = F.when(abstain | (F.col("score1") < limits.score) | (margin < limits.margin), config.OTHER).otherwise(F.col("prototype1"))
    return top.select(key, topic.alias("topic"), F.col("prototype1").alias("best"), F.col("score1").alias("score"), F.col("prototype2").alias("second"), margin.alias("margin"), F.when(abstain, F.col("prototype1")).alias("contrast"))


def by_vectors(vectors_: DataFrame, key: str, topics: DataFrame, limits: config.Thresholds, contrast: tuple[str, ...] = ()) -> DataFrame:
    """The dense classifier: vectors (key, vector) against topics (place, prototype, vector)."""
    scores = dense_scores(vectors_, key, "vector", topics).join(F.broadcast(topics.select("prototype", "place")), "prototype")
    return decide(scores, key, F.col("place"), limits, contrast)


def by_terms(df: DataFrame, key: str, body: str, topics: DataFrame, limits: config.Thresholds, contrast: tuple[str, ...] = ()) -> DataFrame:
    """The sparse classifier: texts against topics (place, prototype, text), with document
    frequencies of both."""
    named = df.select(F.concat(F.lit("i"), F.col(key).cast("string")).alias("_k"), F.col(key), F.col(body).alias("_t"))
    protos = topics.select(F.concat(F.lit("p"), "prototype").alias("_k"), F.col("text").alias("_t"))
    weights = tfidf(named.select("_k", "_t").unionByName(protos), "_k", "_t")
    mine = weights.join(named.select("_k", key), "_k").select(key, "term", "weight")
    theirs = weights.where(F.startswith("_k", F.lit("p"))).select(F.substring("_k", 2, 1 << 20).alias("prototype"), "term", "weight")
    empty = topics.select("prototype").join(theirs.select("prototype").distinct(), "prototype", "left_anti").select("prototype", F.lit("").alias("term"), F.lit(0.0).alias("weight"))
    scores = sparse_scores(mine, key, theirs.unionByName(empty), df).join(F.broadcast(topics.select("prototype", "place")), "prototype")
    return decide(scores, key, F.col("place"), limits, contrast)


def methods(**results: DataFrame) -> DataFrame:
    """All methods' classifications in one frame, named by method."""
    return reduce(DataFrame.unionByName, (df.withColumn("method", F.lit(name)) for name, df in results.items()))


def group_topics(members: DataFrame, classified: DataFrame, method: str) -> DataFrame:
    """(group_id, topic) by one method's majority; groups without any classified member too.

    members: group_id, id. classified: id, topic, method.
    """
    mine = classified.where(F.col("method") == method).select("id", "topic")
    return majority_topic(members.join(mine, "id", "left"), "group_id", "topic")


def majority_topic(df: DataFrame, key: str, topic: str) -> DataFrame:
    """The most frequent topic of each key, the first in the alphabet of equals."""
    return df.groupBy(key).agg(F.mode(F.coalesce(F.col(topic), F.lit(config.OTHER)), True).alias("topic"))


def missing_vectors(items: DataFrame, cache: DataFrame, key: str, body: str, model: str) -> DataFrame:
    """Items whose text, not only whose id, has no vector of this model yet."""
    known = cache.where(F.col("model") == model).select(key, "text_hash")
    return items.withColumn("text_hash", F.sha2(F.coalesce(body, F.lit("")), 256)).join(known, [key, "text_hash"], "left_anti")
