"""Validation, rejects, deduplication and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates


def validate(df: DataFrame, row: str, key: str, mandatory: list[str], date_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects). A reject is one row per failing field: row, id, field,
    reason. Blank texts become null; mandatory fields may not be blank, dates must parse."""
    strings = [c for c, t in df.dtypes if t == "string"]
    clean = df.withColumns({c: F.nullif(F.trim(c), F.lit("")) for c in strings})
    fault = lambda hit, name, why: F.when(hit, F.struct(F.lit(name).alias("field"), F.lit(why).alias("reason")))
    faults = [fault(F.col(c).isNull(), c, "obligatorio") for c in mandatory] + [fault(dates.bad_date(F.col(c)), c, "fecha_invalida") for c in date_columns]
    marked = clean.withColumn("_faults", F.filter(F.array(*faults), lambda x: x.isNotNull()))
    good = marked.where(F.size("_faults") == 0).drop("_faults").withColumns({c: dates.parse_iso(F.col(c)) for c in date_columns})
    rejects = marked.select(F.col(row).alias("row"), F.col(key).alias("id"), F.inline("_faults"))
    return good, rejects


def keep_first(df: DataFrame, key: str, row: str) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, rejects for the others); ``row`` tells rows apart.

    Keys, which may be whole texts, go by a hash and are counted before the shuffle; rows
    without a key are one key.
    """
    digest = F.coalesce(F.sha2(F.col(key).cast("string"), 256), F.lit("none"))
    first = df.groupBy(digest.alias("_h")).agg(F.min(row).alias(row)).select(row)
    later = df.join(first, row, "left_anti").select(F.col(row).alias("row"), F.col(key).alias("id"), F.lit(key).alias("field"), F.lit("duplicado").alias("reason"))
    return df.join(first, row, "left_semi"), later


def split_range(df: DataFrame, ts: Column, first: Column, end: Column, keep_null: bool) -> tuple[DataFrame, DataFrame]:
    """Rows in [first, end) and the others; null dates go where ``keep_null`` says."""
    inside = F.coalesce((ts >= first) & (ts < end), F.lit(keep_null))
    return df.where(inside), df.where(~inside).withColumn("reason", F.lit("fuera_de_rango"))


def exclusion_reason(title: Column, valid: Column) -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "sin_titulo").when(~valid, "url_invalida")


def all_excluded(*parts: DataFrame) -> DataFrame:
    """Rows left out for one reason or another, in one frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def counts(df: DataFrame, column: Column | str, name: str) -> DataFrame:
    """(name, n): rows of each value, most first, of equals in order."""
    value = F.col(column) if isinstance(column, str) else column
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def monthly(df: DataFrame, *times: str) -> DataFrame:
    """(month, n) of rows by the first time that is there; rows without any are left out."""
    at = F.coalesce(*(F.col(t) for t in times))
    return df.where(at.isNotNull()).groupBy(dates.month_key(at).alias("month")).agg(F.count("*").alias("n")).orderBy("month")


MOST_CELLS = 5_000_000


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_rows, n_null) in one pass over all columns."""
    counts = df.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in df.columns))
    return counts.select("n_rows", F.inline(pairs)).select("column_name", "n_rows", "n_null")


def duplicate_surplus(df: DataFrame, key: Column) -> DataFrame:
    """(n_duplicates): rows beyond the first of each key."""
    return df.groupBy(key.alias("k")).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def grid_completeness(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Distinct members of each dimension, rows, expected cells and null values."""
    distinct = [F.count_distinct(d).alias(f"n_{d}") for d in dims]
    return df.agg(*distinct, F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_null")).withColumn("expected", reduce(lambda a, b: a * b, (F.col(f"n_{d}") for d in dims)))


def complete_grid(values: DataFrame, members: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Every combination of the members with its value, or null and a note.

    The members are dimensions of declared, small size, ``MOST_CELLS`` in all at most;
    values may be large.
    """
    if reduce(lambda a, b: a * b, (m.count() for m in members), 1) > MOST_CELLS:
        raise ValueError(f"a grid of more than {MOST_CELLS} cells")
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), members)
    return grid.join(values, keys, "left").withColumn("note", F.when(F.col(value).isNull(), "sin_dato"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(fingerprint, n): changes with any row's content, whatever the order of rows.

    Hashes are summed, not xored, so that repeated rows do not cancel each other.
    """
    return df.agg(F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"), F.count("*").alias("n"))


def unchanged(df: DataFrame, columns: list[str], known: tuple[str, str] | None, version: str) -> tuple[bool, tuple[str, str]]:
    """(whether a stage may be skipped, its new mark): same schema version, same input."""
    row = fingerprint(df, columns).first()
    mark = (version, f"{row['fingerprint']}:{row['n']}")
    return mark == known, mark


def changed_rows(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is new or whose content differs from ``old``."""
    content = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    known = old.select(F.col(key), content.alias("_hash"))
    return new.withColumn("_hash", content).join(known, [key, "_hash"], "left_anti").drop("_hash")


def referential_faults(items: DataFrame, key: str, parent: str) -> DataFrame:
    """(id, fault) of duplicate, missing and dangling ids."""
    duplicate = items.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).count().where("count > 1").select("id", F.lit("duplicado").alias("fault"))
    missing = items.where(F.trim(F.coalesce(key, F.lit(""))) == "").select(F.col(key).alias("id"), F.lit("sin_id").alias("fault"))
    dangling = items.where(F.col(parent).isNotNull()).join(items.select(F.col(key).alias(parent)), parent, "left_anti").select(F.col(key).alias("id"), F.lit("padre_inexistente").alias("fault"))
    return duplicate.unionByName(missing).unionByName(dangling)
