"""Attention score, priority, evidence state and links to catalogue events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import dates, text


def relevance(topic: Column, national: Column, rules: config.Rules) -> Column:
    return F.when(~F.coalesce(topic.isin(*rules.topics), F.lit(False)), 0.0).when(national, 1.0).otherwise(0.5)


def impact(title: Column, rules: config.Rules) -> Column:
    """National words first, then sector words, else local; substrings count."""
    country, sector, local = rules.scope_scores
    return F.when(text.contains_any(title, rules.national_words), country).when(text.contains_any(title, rules.sector_words), sector).otherwise(local)


def urgency(reference: Column, last: Column, rules: config.Rules) -> Column:
    age, out = dates.age_hours(reference, last), None
    for limit, value in rules.recency:
        if limit is None:
            return (out.otherwise(value) if out is not None else F.lit(value)).cast("double")
        out = F.when(age <= limit, value) if out is None else out.when(age <= limit, value)
    return out.otherwise(rules.recency[-1][1])


def novelty(is_repeat: Column, rules: config.Rules) -> Column:
    return F.when(is_repeat, rules.novelty[1]).otherwise(rules.novelty[0])


def evidence(n_sources: Column, primary: Column, rules: config.Rules) -> Column:
    extra = F.least(F.greatest(n_sources - 1, F.lit(0)) * F.lit(rules.per_source), F.lit(rules.source_cap))
    return F.least(extra + F.when(primary, rules.primary_weight).otherwise(0.0), F.lit(1.0))


def total(rules: config.Rules) -> Column:
    """Weighted sum of columns R, I, U, N, E, to one decimal."""
    return F.round(sum((F.col(c) * F.lit(float(w)) for c, w in rules.weights.items()), F.lit(0.0)), 1)


def priority(score: Column, rules: config.Rules) -> Column:
    out = None
    for i, (name, lo, hi) in enumerate(rules.ranges):
        hit = (score >= lo) & ((score <= hi) if i == len(rules.ranges) - 1 else (score < hi))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def evidence_state(n_sources: Column, primary: Column) -> Column:
    return F.when((n_sources >= 2) & primary, "suficiente").when((n_sources >= 2) | primary, "parcial").otherwise("insuficiente")


def _any_ends(values: Column, suffix: Column) -> Column:
    return F.exists(values, lambda v: F.endswith(v, suffix))


def is_primary(sources: Column, rules: config.Rules) -> Column:
    """Whether any of an array of provenances is an official source."""
    named = F.array(*(F.lit(d) for d in rules.primary_domains))
    hit = F.arrays_overlap(sources, named)
    for suffix in rules.primary_suffixes:
        hit = hit | _any_ends(sources, F.lit(suffix))
    return F.coalesce(hit, F.lit(False))


def is_national(sources: Column, rules: config.Rules) -> Column:
    return F.coalesce(F.arrays_overlap(sources, F.array(*(F.lit(d) for d in rules.national_outlets))), F.lit(False))


def score_groups(groups: DataFrame, rules: config.Rules = config.Rules()) -> DataFrame:
    """groups: group_id, title, topic, sources (array), n_sources, last_ts, is_repeat.

    The reference clock is the newest group, not the wall clock.
    """
    rules.validate()
    clock = groups.agg(F.max("last_ts").alias("_now"))
    primary, national = is_primary(F.col("sources"), rules), is_national(F.col("sources"), rules)
    parts = groups.crossJoin(F.broadcast(clock)).withColumns(
        {
            "R": relevance(F.col("topic"), national, rules),
            "I": impact(F.col("title"), rules),
            "U": urgency(F.col("_now"), F.col("last_ts"), rules),
            "N": novelty(F.col("is_repeat"), rules),
            "E": evidence(F.col("n_sources"), primary, rules),
            "evidence_state": evidence_state(F.col("n_sources"), primary),
        }
    )
    scored = parts.drop("_now").withColumn("score", total(rules))
    return scored.withColumn("priority", priority(F.col("score"), rules)).withColumn("rules_version", F.lit(rules.version))


def _near(groups: DataFrame, events: DataFrame, before: float, after: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Groups with events of times in [ts - after, ts + before] hours.

    Buckets as wide as the longer side turn the range into an equi-join of a group
    with its own and two neighbouring buckets; ``keys`` join, too.
    """
    width = max(before, after) * 3600e6
    at = F.floor(F.unix_micros("ts") / width).cast("long")
    left = groups.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    right = events.withColumn("_bucket", F.floor(F.unix_micros("event_ts") / width).cast("long"))
    delta = F.unix_micros("ts") - F.unix_micros("event_ts")
    return left.join(right, ["_bucket", *keys]).where((delta >= F.lit(-before * 3600e6)) & (delta <= F.lit(after * 3600e6))).drop("_bucket")


def _counted(asked: DataFrame, known: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``asked`` (keys, t, turn, ...) with ``n``: the rows of ``known`` (keys, t) of the
    same keys before t, and at t if turn is 2, not if it is 0.

    Running sums: of whole hours over the hours there are, and inside an hour over its
    rows. So no pair is formed, however many rows a window holds.
    """
    hour = F.floor(F.col("t") / 3_600_000_000)
    rows = asked.withColumn("is_event", F.lit(0)).unionByName(known.select(*keys, "t", F.lit(1).alias("turn"), F.lit(1).alias("is_event")), allowMissingColumns=True).withColumn("hour", hour)
    per = known.groupBy(*keys, hour.alias("hour")).agg(F.count("*").alias("n"))
    hours = rows.select(*keys, "hour").distinct().join(per, [*keys, "hour"], "left").select(*keys, "hour", F.coalesce("n", F.lit(0)).alias("n"))
    # as many rows as there are hours; they don't grow with the events
    before = hours.select(*keys, "hour", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("is_event").over(Window.partitionBy(*keys, "hour").orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0))
    counted = rows.withColumn("inside", inside).where("is_event = 0").join(before, [*keys, "hour"])
    return counted.select(*asked.columns, (F.col("before") + F.col("inside")).alias("n"))


def count_events(groups: DataFrame, events: DataFrame, days: float) -> DataFrame:
    """(group_id, n_events) within ``days`` either way, both ends included; groups without
    any, or without a time, have 0.

    They are the events up to a window's end, less those before its start.
    """
    reach = int(days * 86_400_000_000)
    at = F.unix_micros("ts")
    # an event counts for a start only if before it, for an end also if at it
    edges = F.array(F.struct((at - reach).alias("t"), F.lit(0).alias("turn"), F.lit(-1).alias("sign")), F.struct((at + reach).alias("t"), F.lit(2).alias("turn"), F.lit(1).alias("sign")))
    asked = groups.where("ts is not null").select(F.col("group_id").cast("string").alias("group_id"), F.inline(edges))
    known = events.where("event_ts is not null").select(F.unix_micros("event_ts").alias("t"))
    found = _counted(asked, known).groupBy("group_id").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))
    named = groups.select("group_id", F.col("group_id").cast("string").alias("_g"))
    return named.join(found.withColumnRenamed("group_id", "_g"), "_g", "left").select("group_id", F.coalesce("n", F.lit(0)).alias("n_events"))


def unique_links(groups: DataFrame, events: DataFrame, condition: Column, before: float, after: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(group_id, event_id) where exactly one event in the window meets ``condition``."""
    met = _near(groups, events, before, after, keys).where(condition)
    return met.groupBy("group_id").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id")).where("n = 1").select("group_id", "event_id")


def quake_links(groups: DataFrame, events: DataFrame, rules: config.Rules = config.Rules()) -> DataFrame:
    """Headline to catalogue event: a quake word, a magnitude within tolerance, a shared
    place token, a time in the window, and one such event only.

    Events of one magnitude and the same place tokens are a kind. Headlines meet kinds,
    not events: how many of a kind lie in a window, and which is the first of them in
    time, come from running counts.
    """
    plain = text.unaccent(F.coalesce("title", F.lit("")))
    hit = F.lit(False)
    for w in config.QUAKE_WORDS:
        hit = hit | F.contains(plain, F.lit(w))
    kind, said = ["magnitude", "_where"], ["_told", "_places"]
    told = groups.where(hit & F.col("ts").isNotNull()).select("group_id", F.unix_micros("ts").alias("_at"), text.magnitudes(F.col("title")).alias("_told"), text.place_tokens(F.col("title")).alias("_places"))
    known = events.where("event_ts is not null").select("event_id", F.unix_micros("event_ts").alias("t"), "magnitude", text.place_tokens(F.col("place")).alias("_where"))
    close = F.exists("_told", lambda m: F.abs(m - F.col("magnitude")) <= rules.link_tolerance)
    kinds = known.select(*kind).distinct().withColumn("_token", F.explode("_where"))
    met = told.select(*said).distinct().withColumn("_token", F.explode("_places")).join(kinds, "_token").where(close).select(*said, *kind).distinct()
    asked = told.select(*said, "_at").distinct().join(met, said).select(*said, "_at", *kind)
    first, last = F.col("_at") - int(rules.link_after_hours * 3_600_000_000), F.col("_at") + int(rules.link_before_hours * 3_600_000_000)
    edges = F.array(F.struct(first.alias("t"), F.lit(0).alias("turn")), F.struct(last.alias("t"), F.lit(2).alias("turn")))
    counts = _counted(asked.select(*kind, "_at").distinct().select(*kind, "_at", F.inline(edges)), known, tuple(kind))
    held = counts.groupBy(*kind, "_at").agg(F.min("n").alias("before"), (F.max("n") - F.min("n")).alias("n")).where("n > 0")
    # the one event of a window has as many before it as the window has
    alone = F.max(F.when(F.col("n") == 1, F.struct(*kind, "before"))).alias("one")
    per = asked.join(held, ["_at", *kind]).groupBy(*said, "_at").agg(F.sum("n").alias("n"), alone)
    linked = told.join(per, [*said, "_at"]).groupBy("group_id").agg(F.sum("n").alias("n"), F.max("one").alias("one")).where("n = 1").select("group_id", "one.*")
    placed = _counted(known.withColumn("turn", F.lit(0)), known, tuple(kind)).select(*kind, F.col("n").alias("before"), "event_id")
    return linked.join(placed, [*kind, "before"]).select("group_id", "event_id")
