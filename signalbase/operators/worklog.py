"""Roll-ups of a work log: epics from tasks, states, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def epic_progress(epics: DataFrame, tasks: DataFrame) -> DataFrame:
    """Progress bar and derived state of each epic. epics: id; tasks: epic, state."""
    done, total = F.count_if(F.col("state") == "Hecho"), F.count("state")
    sums = epics.join(tasks.select(F.col("epic").alias("id"), "state"), "id", "left").groupBy("id").agg(
        done.alias("done"), total.alias("total"), F.count_if(F.col("state").isin("En curso", "Hecho")).alias("started"), F.count_if(F.col("state") == "Bloqueada").alias("blocked")
    )
    percent = F.coalesce(F.bround(F.try_divide(100 * F.col("done"), F.col("total")), 0), F.lit(0.0)).cast("int")
    full = F.bround(percent / 10, 0).cast("int")
    bar = F.concat(F.expr("repeat('█', full)"), F.expr("repeat('░', 10 - full)"), F.lit(" "), F.col("percent").cast("string"), F.lit("% ("), F.col("done").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))
    state = F.when(F.col("total") == 0, "Pendiente").when(F.col("done") == F.col("total"), "Hecho").when(F.col("started") > 0, "En curso").when(F.col("blocked") > 0, "Bloqueada").otherwise("Pendiente")
    return sums.withColumn("percent", percent).withColumn("full", full).select("id", "done", "total", "percent", bar.alias("progress"), state.alias("state"))


def state_counts(items: DataFrame, kind: str, state: str) -> DataFrame:
    return items.groupBy(kind, state).agg(F.count("*").alias("n"))


def next_id(items: DataFrame, key: str, prefix: str) -> DataFrame:
    """(next_id): prefix, then the largest number so far plus one, three digits or more."""
    n = F.regexp_extract(F.coalesce(F.col(key), F.lit("")), rf"^{prefix}-(\d+)$", 1)
    top = items.agg(F.coalesce(F.max(F.nullif(n, F.lit("")).cast("int")), F.lit(0)).alias("m"))
    return top.select(F.concat(F.lit(f"{prefix}-"), F.format_string("%03d", F.col("m") + 1)).alias("next_id"))
