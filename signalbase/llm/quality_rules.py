"""Quality rules: hashed n-gram log-likelihood ratio of target against corpus.

Unigrams and bigrams of whitespace words are hashed into ``buckets`` cells. One
multinomial is counted over all documents (the raw corpus), one over trusted
target documents; both get add-``alpha`` smoothing. A document's score is the mean
log ratio log(p_target / p_corpus) over its n-grams, so length does not matter.
Every document with a score of at least ``threshold`` passes the method's rule,
on top of fixed base rules about length and repetition.

The target is a bounded sample of trusted rows: ``TARGET_ROWS`` of them at most, the
first in a fixed pseudo-random order of ids. Corpus counts cover all documents.

Defined cases: null or empty text has no words and fails the base rules; a corpus
without trusted rows gives every document the score 0.0; repeated rows are judged
each on its own; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Chunk, chunks, doc_index, hash_runs

BUCKETS = 1 << 14
SHIFT = np.uint64(50)
UNIGRAM = 0x9E3779B97F4A7C15
BIGRAM = 0xC2B2AE3D27D4EB4F
TARGET_ROWS = 20_000
ALPHA = 1.0
THRESHOLD = -0.10
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def ngram_cells(hashes: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all unigrams, cells of all bigrams, and where bigrams may start."""
    one = (hashes * np.uint64(UNIGRAM)) >> SHIFT
    inner = np.ones(max(len(hashes) - 1, 0), bool)
    ends = pointer[1:-1]
    ends = ends[(ends > 0) & (ends < len(hashes))]
    inner[ends - 1] = False
    two = (hashes[:-1] * np.uint64(UNIGRAM) + hashes[1:] * np.uint64(BIGRAM)) * np.uint64(BIGRAM) >> SHIFT
    return one.astype(np.int64), two[inner].astype(np.int64), inner


def repeated_words(hashes: np.ndarray, pointer: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each document inside windows that occur twice or more in it."""
    n = len(hashes)
    docs = doc_index(pointer)
    out = np.zeros(len(pointer) - 1, np.int64)
    if n < window:
        return out
    same = docs[: n - window + 1] == docs[window - 1 :]
    at = np.flatnonzero(same)
    if not len(at):
        return out
    key = np.zeros(len(at), np.uint64)
    for j in range(window):
        key = key * np.uint64(0x100000001B3 * 0x10001 | 1) + (hashes[at + j] ^ (hashes[at + j] >> np.uint64(29)))
    key ^= (docs[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key)
    ranked = key[order]
    equal = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    hit = at[order[twice]]
    step = np.zeros(n + 1, np.int32)
    step[hit] += 1
    np.subtract.at(step, hit + window, 1)
    covered = np.cumsum(step[:n]) > 0
    return np.bincount(docs[covered], minlength=len(out)).astype(np.int64)


def measure(chunk: Chunk, ratio: np.ndarray | None) -> dict[str, np.ndarray]:
    """Base counts and the score of every document of a chunk."""
    starts, ends, pointer = chunk.words()
    hashes = hash_runs(chunk.data, starts, ends)
    n_words = np.diff(pointer)
    data = chunk.data
    lines = np.empty(len(chunk), np.int64)
    for i in range(len(chunk)):
        kept = [x for x in chunk.text(i).split(b"\n") if x and not x.isspace()]
        lines[i] = len(kept) - len(set(kept))
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    repeat = repeated_words(hashes, pointer)
    score = np.zeros(len(chunk))
    if ratio is not None and len(hashes):
        one, two, inner = ngram_cells(hashes, pointer)
        docs = doc_index(pointer)
        total = np.bincount(docs, ratio[one], len(chunk)) + np.bincount(docs[:-1][inner], ratio[two], len(chunk))
        count = n_words + np.maximum(n_words - 1, 0)
        score = np.round(total / np.maximum(count, 1), 9)
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": chunk.per_doc(~space & ((data & 0xC0) != 0x80)),
        "n_symbols": chunk.per_doc(SYMBOLS[data]),
        "n_dup_lines": lines,
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words),
        "score": score,
    }


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", rows: int = TARGET_ROWS) -> list[int]:
    """At most ``rows`` ids labelled good, the first in a fixed shuffled order.

    A first cut by hash keeps what any task sends to the final top-k near the
    bound, however many labels there are.
    """
    place = F.pmod(F.pmod(F.col(id_col), F.lit(2147483647)) * F.lit(1103515245), F.lit(2147483647))
    good = labels.where((F.col(quality_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), place.alias("place"))
    n = good.count()
    if n > 4 * rows:
        good = good.where(F.col("place") < F.lit(int(2147483647 * min(1.0, 4 * rows / n))))
    return sorted({r[0] for r in good.distinct().orderBy("place", "id").limit(rows).collect()})


def fit_ratio(docs: DataFrame, trusted: list[int], id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA) -> np.ndarray:
    """Log ratio per cell: counts over all documents, summed by Spark.

    Each task sums its cells first, so at most ``BUCKETS`` rows a task are shuffled
    and ``BUCKETS`` rows reach the driver.
    """
    ids = np.array(trusted, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marked = np.isin(np.asarray(batch.column(0).fill_null(-(1 << 62))), ids)
            for chunk in chunks(batch.column(1)):
                starts, ends, pointer = chunk.words()
                one, two, inner = ngram_cells(hash_runs(chunk.data, starts, ends), pointer)
                raw += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
                if marked[chunk.lo : chunk.hi].any():
                    mine = marked[chunk.lo : chunk.hi][doc_index(pointer)]
                    target += np.bincount(one[mine], minlength=BUCKETS) + np.bincount(two[mine[:-1][inner]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["cell", "raw", "target"])

    cells = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, "cell long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in cells.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row["cell"]], target[row["cell"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + alpha) / (target.sum() + alpha * BUCKETS)) - np.log((raw + alpha) / (raw.sum() + alpha * BUCKETS))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def judge(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, score and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                got = measure(chunk, shared.value)
                kept = ~got["base_failed"] & (got["score"] >= threshold)
                order = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
                columns = [batch.column(0).slice(chunk.lo, len(chunk)), *(pa.array(got[k]) for k in order), pa.array(kept), pa.array(got["score"])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *order, "kept", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, SCHEMA)


def keep_good(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that pass both rules."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, bool)
            for chunk in chunks(batch.column(at)):
                got = measure(chunk, shared.value)
                kept[chunk.lo : chunk.hi] = ~got["base_failed"] & (got["score"] >= threshold)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(apply, docs.schema)
