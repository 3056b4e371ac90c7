"""Writers: tables, exports and a manifest."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *names: str) -> None:
    """A CSV with a header; nulls are empty, other columns are left out."""
    df.select(*(names or df.columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys."""
    df.select(F.to_json(F.struct(*(df[c] for c in sorted(df.columns)))).alias("value")).write.mode("overwrite").text(path)


def replace_table(df: DataFrame, name: str) -> None:
    """Replace one table only; tables of other stages stay."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def upsert_files(spark: SparkSession, old_path: str, new_path: str, rows: DataFrame, key: str) -> DataFrame:
    """Parquet at ``old_path`` with ``rows`` put in, written to ``new_path``.

    A table cannot be overwritten while it is read, so the caller swaps the paths.
    """
    from ..operators.grounding import upsert

    upsert(spark.read.parquet(old_path), rows, key).write.mode("overwrite").parquet(new_path)
    return spark.read.parquet(new_path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def coverage(df: DataFrame, source: str, ts: str) -> DataFrame:
    """Rows and date range of each source."""
    return df.groupBy(source).agg(F.count("*").alias("n_rows"), F.min(F.col(ts).cast("date")).alias("first_day"), F.max(F.col(ts).cast("date")).alias("last_day"))


def append_vectors(df: DataFrame, root: str, model: str) -> None:
    """Add (id, text_hash, vector) rows to a model's cache."""
    from ..sources.files import safe_model

    df.select("id", "text_hash", "vector").write.mode("append").parquet(f"{root}/model={safe_model(model)}")


def merge_jsonl(old: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(value): ``old`` lines (value) with ``rows`` (key, value) in place of those of their
    ids; lines without an id, or no JSON, stay as they are."""
    id_ = F.expr(f"try_variant_get(try_parse_json(value), '$.{key}', 'string')")
    keyed = old.withColumn("_id", id_)
    kept = keyed.join(rows.select(F.col(key).alias("_id")), "_id", "left_anti").select("value")
    return kept.unionByName(rows.select("value"))


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """A small value as an indented JSON file, written whole, then renamed into place."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray((json.dumps(value, ensure_ascii=False, indent=2, default=str) + "\n").encode()))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def swap_table(df: DataFrame, path: str) -> None:
    """Replace the Parquet at ``path``, which ``df`` may read, by a full copy put in place."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part, old = (hadoop.Path(path + end) for end in ("", ".part", ".old"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(part.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(part, target)
    fs.delete(old, True)


def snapshot_manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame], times: dict[str, str], stats: dict[str, Any], **about: Any) -> dict[str, Any]:
    """What a snapshot holds: files with sizes and hashes, rows and day range of each table,
    statistics, and whatever ``about`` adds (version, transformations, sources)."""
    files = {r["file"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in manifest(spark, path).collect()}
    found = {}
    for name, df in tables.items():
        ts = times.get(name)
        day = F.col(ts).cast("date") if ts else F.lit(None).cast("date")
        r = df.agg(F.count("*").alias("n"), F.min(day).cast("string").alias("a"), F.max(day).cast("string").alias("b")).first()
        found[name] = {"rows": r["n"], "coverage": f"{r['a']} a {r['b']}" if r["a"] else "sin fechas"}
    return {**about, "files": files, "tables": found, "statistics": stats}


def file_mark(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(newest change, bytes, files) under ``path``: differs once a file is written."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return (0, 0, 0)
    files, newest, size, n = fs.listFiles(where, True), fs.getFileStatus(where).getModificationTime(), 0, 0
    while files.hasNext():
        f = files.next()
        newest, size, n = max(newest, f.getModificationTime()), size + f.getLen(), n + 1
    return (newest, size, n)


class Cache:
    """Results kept as long as the files they come from are the same."""

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, {}

    def get(self, path: str, make) -> DataFrame:
        """``make(path)``, cached, made anew once the files changed."""
        mark = file_mark(self.spark, path)
        held = self._held.get((path, make))
        if held is None or held[0] != mark:
            if held is not None:
                held[1].unpersist()
            held = self._held[path, make] = (mark, make(path).cache())
        return held[1]
