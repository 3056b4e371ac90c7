"""Encoding texts to unit vectors with a client's encoder, and what a cache lacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64
#: Made once a task; takes texts, gives a row of numbers for each.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; zero rows stay."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1.0, size)


def encode(df: DataFrame, key: str, body: str, encoder: Encoder) -> DataFrame:
    """(key, text_hash, vector): unit vectors of 32-bit floats, ``BATCH`` texts a call."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = unit_rows(np.asarray(call([t or "" for t in part.column(2).to_pylist()]), np.float32))
                flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), vectors], [key, "text_hash", "vector"])

    rows = df.select(key, F.sha2(F.coalesce(body, F.lit("")), 256).alias("text_hash"), F.col(body).alias("_body"))
    return rows.mapInArrow(run, f"{key} {kind}, text_hash string, vector array<float>")


def hash_encoder(dim: int = 64) -> Encoder:
    """A stand-in encoder without a model: words hashed into ``dim`` cells."""

    def make() -> Callable[[list[str]], np.ndarray]:
        import hashlib

        def call(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i, hashlib.sha1(w.encode()).digest()[-1] % dim] += 1
            return out

        return call

    return make


def encode_missing(items: DataFrame, cache: DataFrame, key: str, body: str, model: str, encoder: Encoder) -> tuple[DataFrame, DataFrame]:
    """(vectors of all items, those made now) given a cache (key, model, text_hash, vector).

    An item whose text changed is encoded anew; a second run encodes nothing.
    """
    from ..operators.classify import missing_vectors

    lacking = missing_vectors(items, cache, key, body, model).drop("text_hash")
    made = encode(lacking, key, body, encoder).withColumn("model", F.lit(model))
    wanted = items.select(key, F.sha2(F.coalesce(body, F.lit("")), 256).alias("text_hash"))
    known = cache.where(F.col("model") == model).join(wanted, [key, "text_hash"], "left_semi")
    return known.select(key, "text_hash", "vector").unionByName(made.select(key, "text_hash", "vector")), made
