"""Vector columns: arrays of numbers, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(size == 0, F.lit(1.0)).otherwise(size))


def hash_encode(text: Column, dim: int = 64) -> Column:
    """Bag of words hashed by SHA-1 into ``dim`` (a power of two up to 256) unit cells."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.conv(F.right(F.sha1(w), F.lit(2)), 16, 10).cast("int"), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(cells, lambda c: c == i)).cast("double"))
    return unit(counts)


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): mean of each key's vectors by position, as a unit vector."""
    cells = df.select(key, F.posexplode(vector).alias("_at", "_x")).groupBy(key, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda c: c["_m"]).alias("_c"))
    return whole.select(key, unit(F.col("_c")).alias("centroid"))
