"""Benchmark decontamination: BM25 with block-max WAND over test items.

Test items (lower-cased alphanumeric words; long ones in even segments) are indexed
with BM25 impacts, each divided by the item's score against itself, so one threshold
``TAU`` means the same for every item. Segments only retrieve: what is verified is the
whole item. Postings are in blocks of ``BLOCK_ITEMS`` items
with the block's largest impact of each term.

Every passage of every document is a query: windows of twice the longest segment
with a stride of one, so a copied item lies whole in some window. Pruning is WAND's,
done for a chunk of texts at once:

1. terms are split into essential ones and ones that together give no item more than
   ``SLACK``; a window whose essential list bounds sum to less than TAU - SLACK goes;
2. for the rest, block maxima of its distinct terms bound every block of items;
3. only blocks that reach TAU are scored, all items from TAU on are retrieved.

A retrieved item counts as leaked if its question and its answer (the part after the
last question mark, or else the last third) both overlap the passage: ``OVERLAP`` of
their word trigrams at least. For an item in segments the passage is widened by the
item's words on either side, so that it holds the whole copy; its score is that of its
best segment.

The index is broadcast in shards of bounded items and characters, built one at a time
as scans need them; a larger benchmark takes more scans. Document frequencies, the
number of segments and their mean length are counted over all items by Spark, so a score
doesn't depend on how items are dealt to shards.

Defined cases: null and empty texts and items match nothing; repeated documents are
judged each; repeated items, and rows of one id with different texts, are judged each and
give one row per document and id, the best; items without an id are items of their own
each; equal scores are no conflict, since every
item from the threshold on is retrieved; items of any length are judged whole; further
columns are ignored; an empty benchmark or table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import Chunk, chunks, hash_bytes, hash_runs, mix64

K1, B = 1.2, 0.75
TAU, SLACK, OVERLAP = 0.55, 0.3, 0.7
SEGMENT = 128
BLOCK_ITEMS = 32
SHARD_ITEMS, SHARD_CHARS = 20_000, 16_000_000
NGRAM = 3
FILTER_BITS = 20

# Word characters: letters and digits of ASCII (lower-cased), and all bytes beyond it.
FOLD = np.zeros(256, np.uint8)
FOLD[0x30:0x3A], FOLD[0x61:0x7B] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(bytes(FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes()))


def trigrams(hashes: np.ndarray) -> np.ndarray:
    """Hashes of word trigrams; of the whole sequence if it is shorter."""
    n = min(NGRAM, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = mix64(out + hashes[j : len(hashes) - n + 1 + j])
    return out


def segments(hashes: list[int]) -> list[list[int]]:
    """Even cuts of at most ``SEGMENT`` words: a short rest would occur everywhere."""
    pieces = -(-len(hashes) // SEGMENT)
    return [hashes[len(hashes) * i // pieces : len(hashes) * (i + 1) // pieces] for i in range(pieces)]


class Statistics(NamedTuple):
    """What BM25 knows of all items: segments, their mean length, and how many hold a term."""

    n: int
    mean: float
    holding: dict[int, int]

    @classmethod
    def of(cls, tokens: list[list[int]]) -> Statistics:
        return cls(len(tokens), sum(map(len, tokens)) / max(len(tokens), 1), Counter(t for x in tokens for t in set(x)))


class Index:
    """Normalised BM25 impacts of one shard of items, and what verifies them.

    ``statistics`` are those of all items where the shard isn't all of them.
    """

    def __init__(self, items: list[tuple[int, str]], tau: float = TAU, slack: float = SLACK, statistics: Statistics | None = None):
        self.ids, self.parts, self.reach, owner, tokens = [], [], [], [], []
        for item, text in items:
            words = words_of(text or "")
            question = words_of(text[: text.rfind("?") + 1]) if text and "?" in text else words
            cut = len(question) if 0 < len(question) < len(words) else -(-2 * len(words) // 3)
            hashes = [hash_bytes(w) for w in words]
            pieces = segments(hashes)
            self.ids.append(item)
            self.parts.append([trigrams(np.array(x, np.uint64)) for x in (hashes[:cut], hashes[cut:])])
            self.reach.append(len(words) if len(pieces) > 1 else 0)
            owner += [len(self.ids) - 1] * len(pieces)
            tokens += pieces
        self.owner = np.array(owner, np.int64)
        first: dict[int, int] = {}
        self.same = [i if x is None else first.setdefault(x, i) for i, x in enumerate(self.ids)]
        self.longest = max(map(len, tokens), default=0)
        all_, mean, df = statistics or Statistics.of(tokens)
        used = {t for x in tokens for t in x}
        idf = {t: math.log1p((all_ - df[t] + 0.5) / (df[t] + 0.5)) for t in used}
        self.vocabulary = np.array(sorted(used), np.uint64)
        place = {t: i for i, t in enumerate(self.vocabulary.tolist())}
        rows = []
        for i, x in enumerate(tokens):
            norm = K1 * (1 - B + B * len(x) / mean)
            impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(x).items()}
            whole = sum(impact.values())
            rows += [(place[t], i, v / whole) for t, v in impact.items()]
        rows.sort()
        self.term = np.array([r[0] for r in rows], np.int64)
        self.item = np.array([r[1] for r in rows], np.int64)
        self.impact = np.array([r[2] for r in rows])
        n = len(self.vocabulary)
        self.pointer = np.searchsorted(self.term, np.arange(n + 1))
        self.best = np.zeros(n)
        np.maximum.at(self.best, self.term, self.impact)
        block = self.item // BLOCK_ITEMS
        key, where = np.unique(self.term * (1 << 32) + block, return_inverse=True)
        self.block_term, self.block = key >> 32, key & 0xFFFFFFFF
        self.block_best = np.zeros(len(key))
        np.maximum.at(self.block_best, where, self.impact)
        self.block_pointer = np.searchsorted(self.block_term, np.arange(n + 1))
        self.blocks = -(-len(tokens) // BLOCK_ITEMS)
        self.tau, self.essential = tau, self._essential(n, slack)
        self.need = tau - slack
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(mix64(self.vocabulary) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _essential(self, n: int, slack: float) -> np.ndarray:
        """Terms left after the most frequent are set aside, as long as these give no
        item more than ``slack`` together."""
        essential, given = np.ones(n, bool), np.zeros(len(self.owner))
        for t in np.argsort(self.pointer[:-1] - self.pointer[1:], kind="stable"):
            a, b = self.pointer[t], self.pointer[t + 1]
            after = given[self.item[a:b]] + self.impact[a:b]
            if (after <= slack).all():
                given[self.item[a:b]] = after
                essential[t] = False
        return essential

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for words of no item."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.filter[(mix64(hashes) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if len(maybe):
            at = np.searchsorted(self.vocabulary, hashes[maybe])
            at[at == len(self.vocabulary)] = 0
            hit = self.vocabulary[at] == hashes[maybe]
            out[maybe[hit]] = at[hit]
        return out

    def retrieve(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items (segments of long ones) from TAU on for a passage's distinct terms, block maxima first."""
        a, b = self.block_pointer[terms], self.block_pointer[terms + 1]
        at = _ranges(a, b)
        bound = np.bincount(self.block[at], self.block_best[at], self.blocks)
        live = bound >= self.tau
        if not live.any():
            return np.zeros(0, np.int64), np.zeros(0)
        at = _ranges(self.pointer[terms], self.pointer[terms + 1])
        at = at[live[self.item[at] // BLOCK_ITEMS]]
        score = np.bincount(self.item[at], self.impact[at], len(self.owner))
        found = np.flatnonzero(score >= self.tau)
        return found, score[found]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = b - a
    return np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def leaks_in(chunk: Chunk, index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    """(document position, item, score, question and answer overlap)."""
    if not index.longest:
        return
    folded = FOLD[chunk.data]
    starts, ends, pointer = chunk.runs(folded > 0)
    hashes = hash_runs(folded, starts, ends)
    terms = index.lookup(hashes)
    worth = np.where(terms >= 0, (index.best * index.essential)[terms], 0.0)
    total = np.concatenate(([0.0], np.cumsum(worth)))
    stride, width = index.longest, 2 * index.longest
    n = np.diff(pointer)
    windows = np.where(n > 0, np.maximum(1, -(-(n - width) // stride) + 1), 0)
    doc = np.repeat(np.arange(len(chunk)), windows)
    first = pointer[doc] + stride * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
    last = np.minimum(first + width, pointer[doc + 1])
    hot = np.flatnonzero(total[last] - total[first] >= index.need - 1e-9)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}  # by row of an id's first item
    for w in hot.tolist():
        a, b = first[w], last[w]
        inside = terms[a:b]
        inside = np.unique(inside[inside >= 0])
        if (index.best * index.essential)[inside].sum() < index.need - 1e-9:
            continue
        items, scores = index.retrieve(inside)
        if not len(items):
            continue
        whole: dict[int, float] = {}
        for i, score in zip(index.owner[items].tolist(), scores.tolist()):
            whole[i] = max(whole.get(i, 0.0), score)
        grams: dict[int, np.ndarray] = {}
        for i, score in whole.items():
            reach = index.reach[i]
            passage = hashes[max(a - reach, pointer[doc[w]]) : min(b + reach, pointer[doc[w] + 1])]
            if reach not in grams:
                grams[reach] = trigrams(passage)
            shares = []
            for side in index.parts[i]:
                if len(side) == 1 and len(passage) >= NGRAM:  # a side of one to three words
                    have = _short(passage, side)
                else:
                    have = np.isin(side, grams[reach]).mean() if len(side) else 1.0
                shares.append(float(have))
            if min(shares) >= OVERLAP:
                key = (int(doc[w]) + chunk.lo, index.same[i])
                best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, *shares))
    for (d, item), got in sorted(best.items()):
        yield d, index.ids[item], *got


def _short(hashes: np.ndarray, side: np.ndarray) -> float:
    """1.0 if a side shorter than a trigram, or one trigram, occurs in the passage."""
    for n in range(1, NGRAM + 1):
        out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
        for j in range(n):
            if len(out):
                out = mix64(out + hashes[j : len(hashes) - n + 1 + j])
        if len(out) and (out == side[0]).any():
            return 1.0
    return 0.0


class Shards:
    """Indexes of bounded shards of the benchmark; iterating builds one after the other."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str):
        rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
        n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
        self.count = max(1, -(-n // SHARD_ITEMS), -(-size // SHARD_CHARS))
        self.rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(self.count)))
        if self.count > 1:
            scratch = Scratch(benchmark.sparkSession, "decontamination")
            terms = self.rows.mapInArrow(_terms, "shard long, term long, holding long, words long")
            by = terms.groupBy("shard", "term").agg(F.sum("holding").alias("holding"), F.sum("words").alias("words"))
            by = scratch.save(by, "terms")
            whole = by.where("term is null").agg(F.sum("holding"), F.sum("words")).first()
            self.n, self.mean = whole[0], whole[1] / max(whole[0], 1)
            total = by.where("term is not null").groupBy("term").agg(F.sum("holding").alias("holding"))
            self.terms = scratch.save(by.select("shard", "term").join(total, "term"), "statistics")

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Index]:
        for k in range(self.count):
            items = sorted((r["id"] is None, r["id"] or 0, r["id"], r["text"]) for r in self.rows.where(F.col("shard") == k).collect())
            statistics = None
            if self.count > 1:
                found = self.terms.where(F.col("shard") == k).toArrow()
                term, holding = np.asarray(found["term"]).view(np.uint64).tolist(), np.asarray(found["holding"]).tolist()
                statistics = Statistics(self.n, self.mean, dict(zip(term, holding)))
            yield Index([(item, text) for _, _, item, text in items], statistics=statistics)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By shard, the segments that hold each term; without term, all segments and words."""
    for batch in batches:
        found: Counter[tuple[int, int | None]] = Counter()
        words: Counter[int] = Counter()
        for text, shard in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for piece in segments([hash_bytes(w) for w in words_of(text)]):
                found[shard, None] += 1
                words[shard] += len(piece)
                found.update((shard, t - (1 << 64) if t >> 63 else t) for t in set(piece))
        keys = list(found)
        columns = [pa.array([s for s, _ in keys], pa.int64()), pa.array([t for _, t in keys], pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([words[s] if t is None else 0 for s, t in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "term", "holding", "words"])


def build(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Shards:
    """Indexes of bounded shards of the benchmark."""
    return Shards(benchmark, id_col, text_col)


def leaks(docs: DataFrame, indexes: Iterable[Index], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every leak."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def scan(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [x for chunk in chunks(batch.column(1)) for x in leaks_in(chunk, shared.value)]
                if found:
                    at, item, *rest = zip(*found)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), *(pa.array(np.round(x, 6)) for x in rest)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(apply, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.union, map(scan, indexes))


def drop_leaks(docs: DataFrame, indexes: Iterable[Index], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item leaks."""
    at = docs.columns.index(text_col)
    for index in indexes:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                for chunk in chunks(batch.column(at)):
                    for found in leaks_in(chunk, shared.value):
                        kept[found[0]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(apply, docs.schema)
    return docs
