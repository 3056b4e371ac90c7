"""LM scoring: prediction by partial matching over bytes, and a unigram word base.

The model is a byte-context trie counted over all training documents: contexts of up
to ``MAX_ORDER`` bytes (texts padded with zero bytes, ended by one, ASCII lower-cased).
A byte is coded from its longest seen context; a symbol new there costs an escape
of method C, and symbols of the longer context are excluded from the shorter one's
counts. What remains after order 0 is uniform. A document's score is the log10
probability of its bytes under the pretrained trie.

The trie is never held whole. Texts go in blocks of about ``BLOCK`` bytes; each block
names its distinct grams, their counts are summed over the corpus, and all grams that
share their last two context bytes meet in one bucket, where the trie's levels from
order 2 on are complete (at most 2**24 grams for each two bytes, whatever the corpus).
Orders 0 and 1 have at most 2**16 grams and are sent along. The bucket gives each gram
its log probability, which goes back to the blocks that named it. So the order is the
same at every size, and what a task holds follows the block or the bucket.

Word counts are not bounded either: frequent words (at most ``MAX_WORDS``) are looked
up from a broadcast table while reading, the others by a shuffled join.

Training documents are those whose crc32(id as text) mod 5 is not 1.

Defined cases: null and empty texts have the end token only; a null id counts as the
empty string and trains; repeated rows count and are scored each; an empty training
set leaves uniform bytes and N = V = 0; further columns are ignored; a zero byte in a text
is the same symbol as the padding before it and its end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import LOWER, Chunk, chunks, doc_index, hash_runs, mix64

MAX_ORDER = 4
SHARED = 2
BLOCK = 1 << 25
BUCKET_GRAMS = 1 << 18
MAX_WORDS = 400_000
FOLDS, HELD_OUT = 5, 1
END_WORD = 0
COMPACT = 1 << 20


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()], bool)


class Table:
    """Lookup of uint64 keys, in buckets of their mixed hash, vectorised."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        order = np.argsort(mix64(keys), kind="stable")
        self.order, self.keys = order.astype(np.int32), np.append(keys[order], np.uint64(0))
        bucket = (mix64(keys[order]) >> np.uint64(64 - self.bits)).astype(np.int64)
        self.pointer = np.searchsorted(bucket, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.pointer).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among the keys given at first, or -1."""
        bucket = (mix64(keys) >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.pointer[bucket], self.pointer[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        at = at[left]
        for _ in range(self.deepest):
            if not len(left):
                break
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.order[at[hit]]
            at = at + 1
            stay = ~hit & (at < end[left])
            left, at = left[stay], at[stay]
        return out


class Trie:
    """A pretrained model of a bucket: levels below ``SHARED`` from ``low``, the rest from ``grams``.

    ``low`` is (keys, counts) of the ``SHARED``-byte grams of the whole corpus; ``grams``
    are (order + 1)-byte grams, all that the corpus has of each of their last contexts
    of ``SHARED`` bytes.
    """

    def __init__(self, low: tuple[np.ndarray, np.ndarray], grams: np.ndarray, counts: np.ndarray, order: int):
        self.order = order
        self.levels = []
        for j in range(order + 1):
            keys, times = low if j < SHARED else (grams, counts)
            gram, where = np.unique(keys & np.uint64((1 << 8 * (j + 1)) - 1), return_inverse=True)
            count = np.bincount(where, times, len(gram))
            ctx, of = np.unique(gram >> np.uint64(8), return_inverse=True)
            n, q = np.bincount(of, count, len(ctx)), np.bincount(of, minlength=len(ctx))
            level = {"gram": Table(gram), "ctx": Table(ctx), "n": n, "q": q.astype(np.int32), "count": count}
            if j:
                # what exclusion of this context's symbols leaves of the next shorter
                shorter = self.levels[j - 1]
                seen = shorter["count"][shorter["gram"].find(gram & np.uint64((1 << 8 * j) - 1))]
                parent = shorter["ctx"].find(ctx & np.uint64((1 << 8 * (j - 1)) - 1))
                level["escape"] = (shorter["q"][parent] - q).astype(float)
                level["total"] = shorter["n"][parent] - np.bincount(of, seen, len(ctx)) + level["escape"]
            self.levels.append(level)
        self.seen = int(self.levels[0]["q"][0]) if len(low[0]) else 0

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order + 1)-byte gram."""
        out = np.zeros(len(grams))
        if not self.seen:
            return np.full(len(grams), -np.log10(256.0))
        left, above = np.arange(len(grams)), np.full(len(grams), -1, np.int64)
        for j in range(self.order, -1, -1):
            if not len(left):
                break
            level, key = self.levels[j], grams[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            node = level["ctx"].find(key >> np.uint64(8))
            known = node >= 0
            gram = np.where(known, level["gram"].find(key), -1)
            total, escape = np.ones(len(left)), np.zeros(len(left))
            fresh = known & (above < 0)
            total[fresh], escape[fresh] = (level["n"] + level["q"])[node[fresh]], level["q"][node[fresh]]
            under = known & (above >= 0)
            if under.any():
                longer = self.levels[j + 1]
                total[under], escape[under] = longer["total"][above[under]], longer["escape"][above[under]]
            found = gram >= 0
            out[left[found]] += np.log10(level["count"][gram[found]] / total[found])
            escaped = known & ~found & (escape > 0)
            out[left[escaped]] += np.log10(escape[escaped] / total[escaped])
            left, above = left[~found], np.where(known, node, -1)[~found]
        out[left] -= np.log10(256.0 - self.seen)
        return out


def byte_grams(chunk: Chunk, order: int = MAX_ORDER) -> tuple[np.ndarray, np.ndarray]:
    """All (order + 1)-byte grams, ends included, and the document of each."""
    size = np.diff(chunk.offsets)
    docs = np.repeat(np.arange(len(chunk)), size)
    padded = np.zeros(len(chunk.data) + (order + 1) * len(chunk), np.uint8)
    padded[np.arange(len(chunk.data)) + (order + 1) * docs + order] = LOWER[chunk.data]
    key = np.zeros(len(padded) - order, np.uint64)
    for j in range(order + 1):
        key <<= np.uint64(8)
        key |= padded[j : j + len(key)]
    doc = np.repeat(np.arange(len(chunk)), size + order + 1)[: len(key)]
    within = np.arange(len(key)) - np.repeat(chunk.offsets[:-1] + (order + 1) * np.arange(len(chunk)), size + order + 1)[: len(key)]
    real = within <= size[doc]
    return key[real], doc[real]


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    low = Chunk(chunk.lo, chunk.hi, LOWER[chunk.data], chunk.offsets)
    starts, ends, pointer = low.words()
    return hash_runs(low.data, starts, ends), pointer


class _Counts:
    """Sums of counts by key, compacted as they come."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, weight: int = 1) -> None:
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count * weight)
        self.size += len(key)
        if self.size > COMPACT and len(self.keys) > 1:
            key, count = self.total()
            self.keys, self.counts, self.size = [key], [count], len(key)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key, where = np.unique(np.concatenate(self.keys), return_inverse=True)
        return key, np.bincount(where, np.concatenate(self.counts), len(key)).astype(np.int64)


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, row, doc_id, text): rows numbered, in blocks of about ``BLOCK`` bytes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        row = size = 0
        for batch in batches:
            ends = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate(([size], ends[:-1]))[: len(ends)]
            yield pa.RecordBatch.from_arrays([pa.array(first + starts // BLOCK), pa.array(first + row + np.arange(len(ends))), *batch.columns], ["block", "row", "doc_id", "text"])
            row, size = row + len(ends), int(ends[-1]) if len(ends) else size

    return docs.mapInArrow(apply, "block long, row long, doc_id long, text string")


def _runs(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch within which the columns named do not change."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        v = batch.column(c).to_numpy(zero_copy_only=False)
        change |= v[1:] != v[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def count(blocks: DataFrame) -> DataFrame:
    """(kind, block, key, n): words (0) and grams (1) and their count in training documents.

    Grams are named by block, those that only held-out documents have with a count of 0.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, block = _Counts(), _Counts(), None

        def flush(kind: int, counts: _Counts) -> Iterator[pa.RecordBatch]:
            key, n = counts.total()
            for a in range(0, len(key), 1 << 18):
                k = key[a : a + (1 << 18)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), block, np.int64)), pa.array(k), pa.array(n[a : a + (1 << 18)])], ["kind", "block", "key", "n"])

        for whole in batches:
            for batch in _runs(whole, 0):
                if batch.column(0)[0].as_py() != block:
                    yield from flush(1, grams)
                    grams, block = _Counts(), batch.column(0)[0].as_py()
                train = ~held_out(batch.column(2))
                for chunk in chunks(batch.column(3)):
                    mine = train[chunk.lo : chunk.hi]
                    hashes, pointer = word_hashes(chunk)
                    words.add(np.concatenate((hashes[mine[doc_index(pointer)]], np.full(int(mine.sum()), END_WORD, np.uint64))))
                    gram, doc = byte_grams(chunk)
                    known = mine[doc]
                    grams.add(gram[known])
                    grams.add(gram[~known], 0)
                if words.size > COMPACT:
                    yield from flush(0, words)
                    words = _Counts()
        yield from flush(1, grams)
        yield from flush(0, words)

    return blocks.mapInArrow(apply, "kind int, block long, key long, n long")


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    table = df.select(*names).toArrow()
    return [np.asarray(table[n].combine_chunks()) if table.num_rows else np.zeros(0, np.int64) for n in names]


def gram_scores(totals: DataFrame) -> DataFrame:
    """(key, bits): log10 probability of the last byte of each gram.

    totals: distinct key, and n, its count in training documents (0: held-out only).
    """
    below = totals.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("key")).agg(F.sum("n").alias("n"))
    keys, times = _columns(below, "key", "n")  # at most 2**16 rows
    low = keys.astype(np.int64).view(np.uint64), times.astype(float)
    buckets = max(1, -(-totals.count() // BUCKET_GRAMS))
    context = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))

    def apply(table: pa.Table) -> pa.Table:
        key, n = (table.column(c).combine_chunks().to_numpy() for c in ("key", "n"))
        grams, known = key.view(np.uint64), n > 0
        bits = Trie(low, grams[known], n[known].astype(float), MAX_ORDER).bits(grams)
        return pa.table({"key": pa.array(key), "bits": pa.array(bits)})

    return totals.withColumn("bucket", F.pmod(F.xxhash64(context), F.lit(buckets))).groupBy("bucket").applyInArrow(apply, "key long, bits double")


def frequent_words(words: DataFrame, max_words: int = MAX_WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, keys, counts) of as many of the most frequent words as fit."""
    step = F.floor(F.log2("n") * 8).cast("long")
    total, least = 0, 1 << 62
    for row in words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        total += row["words"]
        if total > max_words:
            break
        least = row["least"]
    key, n = _columns(words.where(F.col("n") >= F.lit(least)), "key", "n")
    return least, key.astype(np.int64).view(np.uint64), n.astype(np.int64)


ROW = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, words array<long>, times array<int>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model scores of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    blocks = scratch.save(in_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "texts")
    counts = scratch.save(count(blocks), "counts")
    total = lambda kind: counts.where(F.col("kind") == kind).groupBy("key").agg(F.sum("n").alias("n"))
    words, totals = scratch.save(total(0), "words"), scratch.save(total(1), "grams")
    bits = scratch.save(gram_scores(totals), "bits")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, keys, ns = frequent_words(words)
    model = spark.sparkContext.broadcast((Table(keys), np.log10(ns + 0.5)))
    half = float(np.log10(0.5))
    named = counts.where("kind = 1").select("block", "key").join(bits, "key")
    none = lambda kind: F.lit(None).cast(kind)
    parts = named.select("block", F.lit(0).alias("part"), "key", "bits", none("long").alias("doc_id"), none("string").alias("text")).union(
        blocks.select("block", F.lit(1), "row", none("double"), "doc_id", "text")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs = model.value
        block, pieces, grams, values = None, [], None, None
        for whole in batches:
            for batch in _runs(whole, 0, 1):
                if batch.column(0)[0].as_py() != block:
                    block, pieces, grams = batch.column(0)[0].as_py(), [], None
                if batch.column(1)[0].as_py() == 0:
                    pieces.append((batch.column(2).to_numpy(), batch.column(3).to_numpy()))
                    continue
                if grams is None:
                    grams = Table(np.concatenate([k for k, _ in pieces]).view(np.uint64))
                    values, pieces = np.concatenate([v for _, v in pieces]), []
                out = held_out(batch.column(4))
                for chunk in chunks(batch.column(5)):
                    hashes, pointer = word_hashes(chunk)
                    hashes = np.insert(hashes, pointer[1:], np.uint64(END_WORD))
                    pointer = pointer + np.arange(len(pointer))
                    of, at = doc_index(pointer), table.find(hashes)
                    common = at >= 0
                    base = np.bincount(of[common], logs[at[common]], len(chunk))
                    known = np.bincount(of[common], minlength=len(chunk))
                    rare, rare_of = hashes[~common], of[~common]
                    order = np.lexsort((rare, rare_of))
                    rare, rare_of = rare[order], rare_of[order]
                    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rare)), bool), (rare[1:] != rare[:-1]) | (rare_of[1:] != rare_of[:-1]))))
                    times = np.diff(np.append(first, len(rare)))
                    base += half * np.bincount(rare_of, minlength=len(chunk))
                    cut = np.searchsorted(rare_of[first], np.arange(len(chunk) + 1)).astype(np.int32)
                    gram, doc = byte_grams(chunk)
                    place = grams.find(gram)
                    if len(place) and place.min() < 0:
                        raise ValueError(f"block {block} lacks a gram of its texts")
                    columns = [
                        batch.column(2).slice(chunk.lo, len(chunk)),
                        batch.column(4).slice(chunk.lo, len(chunk)),
                        pa.array(out[chunk.lo : chunk.hi]),
                        pa.array(np.diff(pointer).astype(np.int64)),
                        pa.array(known.astype(np.int64)),
                        pa.array(base),
                        pa.array(np.bincount(doc, values[place], len(chunk))),
                        pa.ListArray.from_arrays(cut, pa.array(rare[first].view(np.int64))),
                        pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "words", "times"])

    scored = scratch.save(parts.repartition("block").sortWithinPartitions("block", "part").mapInArrow(apply, ROW), "scored")
    scratch.drop("texts", "counts", "grams", "bits")
    pairs = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("key"), F.col("x.times").alias("times"))
    rare = pairs.join(words.where(F.col("n") < F.lit(least)), "key")
    found = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.lit(half))).alias("gain"))
    scale = float(np.log10(tokens + 0.5 * (distinct + 1)))
    joined = scored.drop("words", "times").join(found, "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
