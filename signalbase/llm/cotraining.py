"""Quality classifier: co-training of a content view and a metadata view.

The content view sees hashed byte trigrams and words of the whole text. The metadata
view sees language, source, length and layout ratios. Both are computed once and written
out, a byte a content feature. Two logistic models start from labelled documents; in
each round both score every other document of the corpus in Spark, and either one labels
the ``GROWTH`` documents of each class it is surest of (``SURE`` at least) and hands them
to the other. Each view is then calibrated (Platt) on labelled documents that no model
trained on, and the score is the mean of the calibrated log odds, as a probability. All
documents are scored.

Only the labelled sample is bounded: the first ``LABELLED`` labelled documents in a fixed
shuffled order of ids, a third of them for calibration. Other labelled documents are part
of the corpus that the views label.

Defined cases: null or empty texts are zero content vectors; null language or source is
a value of its own; without labels of both classes every score is 0.5; equally sure
documents go in the shuffled order; repeated rows are scored each, but handed over once;
rows without an id are scored, never handed over; texts of any length are seen whole;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import IS_SPACE, Chunk, chunks, doc_index, hash_bytes, hash_runs, mix64

LABELLED = 3000
ROUNDS, SURE, GROWTH = 4, 0.95, 300
TRIGRAMS, WORDS = 768, 256
VALUES = 24
RATIOS = 8
THRESHOLD = 0.5


def content_view(chunk: Chunk) -> np.ndarray:
    """Hashed counts, damped by square roots, as unit rows."""
    out = np.zeros((len(chunk), TRIGRAMS + WORDS), np.float32)
    data, n = chunk.data.astype(np.uint64), len(chunk.data)
    docs = np.repeat(np.arange(len(chunk)), np.diff(chunk.offsets))
    if n > 2:
        cell = (mix64(data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) % np.uint64(TRIGRAMS)).astype(np.int64)
        inside = docs[:-2] == docs[2:]
        out[:, :TRIGRAMS] = np.bincount(docs[:-2][inside] * TRIGRAMS + cell[inside], minlength=len(chunk) * TRIGRAMS).reshape(-1, TRIGRAMS)
    starts, ends, pointer = chunk.words()
    words = (mix64(hash_runs(chunk.data, starts, ends)) % np.uint64(WORDS)).astype(np.int64)
    out[:, TRIGRAMS:] = np.bincount(doc_index(pointer) * WORDS + words, minlength=len(chunk) * WORDS).reshape(-1, WORDS)
    np.sqrt(out, out=out)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(size, 1e-9)


def metadata_view(chunk: Chunk, lang: list[str | None], source: list[str | None]) -> np.ndarray:
    """Hashed language and source, log length and layout ratios."""
    out = np.zeros((len(chunk), 2 * VALUES + RATIOS), np.float32)
    for i, pair in enumerate(zip(lang, source)):
        for j, v in enumerate(pair):
            out[i, j * VALUES + (hash_bytes(v.encode()) >> 40) % VALUES if v is not None else j * VALUES] = 1
    data = chunk.data
    size = np.maximum(np.diff(chunk.offsets), 1)
    starts, ends, pointer = chunk.words()
    words = np.maximum(np.diff(pointer), 1)
    hashes, docs = hash_runs(data, starts, ends), doc_index(pointer)
    distinct = np.bincount((np.unique(mix64(hashes) >> np.uint64(24) | docs.astype(np.uint64) << np.uint64(40)) >> np.uint64(40)).astype(np.int64), minlength=len(chunk)) if len(hashes) else np.zeros(len(chunk))
    lines = chunk.per_doc(data == 0x0A) + 1
    upper = chunk.per_doc((data >= 0x41) & (data <= 0x5A))
    digit = chunk.per_doc((data >= 0x30) & (data <= 0x39))
    mark = chunk.per_doc((data > 0x20) & (data < 0x80) & ~((data >= 0x30) & (data <= 0x39)) & ~((data | 0x20) >= 0x61) | (data == 0x7C))
    space = chunk.per_doc(IS_SPACE[data])
    columns = (np.log1p(size) / 10, distinct / words, size / words / 20, lines / words, upper / size, digit / size, mark / size, space / size)
    out[:, 2 * VALUES :] = np.stack(columns, 1)
    return out


def views(batch: pa.RecordBatch, texts: pa.Array, lang: pa.Array, source: pa.Array) -> Iterator[tuple[Chunk, np.ndarray, np.ndarray]]:
    for chunk in chunks(texts):
        yield chunk, content_view(chunk), metadata_view(chunk, lang.slice(chunk.lo, len(chunk)).to_pylist(), source.slice(chunk.lo, len(chunk)).to_pylist())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Weights with a bias at the end: accelerated gradient descent, fixed rounds."""
    x = np.column_stack((x, np.ones(len(x), x.dtype)))
    step = 4 / max(float((x * x).sum(1).mean()), 1e-9)
    w = past = np.zeros(x.shape[1])
    for i in range(rounds):
        ahead = w + i / (i + 3) * (w - past)
        past, w = w, ahead - step * (x.T @ (sigmoid(x @ ahead) - y) / len(y) + penalty * ahead)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Calibration of log odds: slope and shift by Newton steps, smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        g, h = p - t, np.maximum(p * (1 - p), 1e-6)
        gradient = np.array([(g * z).sum() + 1e-3 * (a - 1), g.sum()])
        hessian = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(move[0], -1, 1)), b - float(np.clip(move[1], -1, 1))
    return max(a, 1e-3), b


Model = list[tuple[np.ndarray, tuple[float, float]]]
Sides = tuple[np.ndarray, np.ndarray]
#: Per view, the rows (both sides) it labels and their labels.
Handed = list[tuple[Sides, np.ndarray]]


def surest(ids: np.ndarray, order: np.ndarray, sure: list[np.ndarray], taken: set[int], growth: int = GROWTH) -> list[list[int]]:
    """Ids that each view hands over, by (view, class): the ``growth`` surest, once each.

    ``sure`` holds the probability of the class, by view and class (1, then 0); ``taken``
    ids are passed over and grow by those handed over.
    """
    found = []
    for p in sure:
        mine: list[int] = []
        at = np.flatnonzero(p >= SURE)
        for i in ids[at[np.lexsort((ids[at], order[at], -p[at]))]].tolist():
            if len(mine) == growth:
                break
            if i not in taken:
                taken.add(i)
                mine.append(i)
        found.append(mine)
    return found


def cotrain(sides: Sides, y: np.ndarray, check: np.ndarray, exchange: Callable[[list[np.ndarray]], Handed]) -> Model | None:
    """The two views' weights and calibrations. ``check`` marks held-out labelled rows;
    ``exchange`` gives what the views with these weights hand over."""
    fit = ~check
    if len(set(y[fit].tolist())) < 2 or len(set(y[check].tolist())) < 2:
        return None
    given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    weights = [np.zeros(0), np.zeros(0)]
    for round_ in range(ROUNDS + 1):
        for v in (0, 1):
            x = np.concatenate([sides[v][fit], *(rows for rows, _ in given[v])])
            weights[v] = fit_logistic(x, np.concatenate([y[fit], *(label for _, label in given[v])]))
        if round_ < ROUNDS:
            for v, (rows, label) in enumerate(exchange(weights)):
                given[1 - v].append((rows[1 - v], label))
    return [(weights[v], fit_platt(logits(sides[v][check], weights[v]), y[check])) for v in (0, 1)]


def among(pool: Sides, ids: np.ndarray | None = None, order: np.ndarray | None = None, growth: int = GROWTH) -> Callable[[list[np.ndarray]], Handed]:
    """The exchange over documents in memory."""
    ids = np.arange(len(pool[0])) if ids is None else ids
    place, taken = {i: k for k, i in enumerate(ids.tolist())}, set()

    def exchange(weights: list[np.ndarray]) -> Handed:
        p = [sigmoid(logits(pool[v], weights[v])) for v in (0, 1)]
        found = surest(ids, ids if order is None else order, [p[0], 1 - p[0], p[1], 1 - p[1]], taken, growth)
        return [_handed([pool[side][[place[i] for i in found[2 * v] + found[2 * v + 1]]] for side in (0, 1)], found, v) for v in (0, 1)]

    return exchange


def _handed(sides: list[np.ndarray], found: list[list[int]], v: int) -> tuple[Sides, np.ndarray]:
    return (sides[0], sides[1]), np.repeat([1.0, 0.0], [len(found[2 * v]), len(found[2 * v + 1])])


def calibrated(model: Model, sides: Sides) -> list[np.ndarray]:
    return [a * logits(x, w) + b for x, (w, (a, b)) in zip(sides, model)]


# --- Spark ----------------------------------------------------------------

CONTENT = TRIGRAMS + WORDS


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and both views as bytes: content in 255ths, metadata as 16-bit floats."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, content, metadata in views(batch, batch.column(1), batch.column(2), batch.column(3)):
                both = np.concatenate((np.rint(content * 255).astype(np.uint8), metadata.astype("<f2").view(np.uint8)), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array([r.tobytes() for r in both], pa.binary())], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), "lang", "source")
    return rows.mapInArrow(apply, "doc_id long, x binary")


def _sides(x: pa.Array) -> Sides:
    rows = np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1)
    return rows[:, :CONTENT].astype(np.float32) / 255, np.ascontiguousarray(rows[:, CONTENT:]).view("<f2").astype(np.float32)


def _place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << 30))


def _first_ids(ids: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` of (id, ...) in shuffled order; tasks send little more."""
    n = ids.count()
    placed = ids.withColumn("place", _place("id"))
    if n > 2 * rows:
        placed = placed.where(F.col("place") < int((1 << 30) * min(1.0, 2 * rows / n)))
    return placed.orderBy("place", "id").limit(rows)


def _rows_of(table: DataFrame, ids: list[int]) -> tuple[np.ndarray, Sides]:
    """Ids found and their features; ``ids`` are a bounded list."""
    if not ids:
        return np.zeros(0, np.int64), (np.zeros((0, CONTENT), np.float32), np.zeros((0, 2 * VALUES + RATIOS), np.float32))
    wanted = F.broadcast(table.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long"))
    got = table.join(wanted, "doc_id").dropDuplicates(["doc_id"]).toArrow()
    return np.asarray(got["doc_id"]).astype(np.int64), _sides(got["x"].combine_chunks()) if got.num_rows else _rows_of(table, [])[1]


def throughout(table: DataFrame, seeds: list[int], growth: int = GROWTH) -> Callable[[list[np.ndarray]], Handed]:
    """The exchange over all documents of a table of features but ``seeds``.

    A task sends only the documents among which its surest ones are; of these Spark takes
    the surest of all, four times as many a view and class as are handed over, since
    four lists may name one document.
    """
    taken, most = set(seeds), 4 * growth

    def exchange(weights: list[np.ndarray]) -> Handed:
        shared = table.sparkSession.sparkContext.broadcast((weights, np.array(sorted(taken), np.int64)))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, known = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * 4
            for batch in batches:
                batch = batch.filter(batch.column(0).is_valid())
                if not batch.num_rows:
                    continue
                x, ids, place = _sides(batch.column(2)), np.asarray(batch.column(0)), np.asarray(batch.column(1))
                p = [sigmoid(logits(x[v], w[v])) for v in (0, 1)]
                free = ~np.isin(ids, known)
                for k, sure in enumerate((p[0], 1 - p[0], p[1], 1 - p[1])):
                    at = np.flatnonzero(free & (sure >= SURE))
                    i, o, q = (np.concatenate(pair) for pair in zip(best[k], (ids[at], place[at], sure[at])))
                    _, once = np.unique(i, return_index=True)
                    i, o, q = i[once], o[once], q[once]
                    top = np.lexsort((i, o, -q))[:most]
                    best[k] = i[top], o[top], q[top]
            for k, (i, o, q) in enumerate(best):
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(o, pa.int64()), pa.array(q, pa.float64()), pa.array([k] * len(i), pa.int32())], ["id", "place", "sure", "which"])

        sent = table.select("doc_id", _place("doc_id").alias("place"), "x").mapInArrow(apply, "id long, place long, sure double, which int").distinct()
        tops = [sent.where(F.col("which") == k).orderBy(F.desc("sure"), "place", "id").limit(most) for k in range(4)]
        got = reduce(DataFrame.union, tops).toArrow()
        ids, place, p, which = (np.asarray(got[c].combine_chunks()) if got.num_rows else np.zeros(0, np.int64) for c in ("id", "place", "sure", "which"))
        every, first = np.unique(ids, return_index=True)
        sure = []
        for k in range(4):
            value = dict(zip(ids[which == k].tolist(), p[which == k].tolist()))
            sure.append(np.array([value.get(i, 0.0) for i in every.tolist()]))
        found = surest(every, place[first], sure, taken, growth)
        names, sides = _rows_of(table, sum(found, []))
        at = {i: k for k, i in enumerate(names.tolist())}
        return [_handed([sides[s][[at[i] for i in found[2 * v] + found[2 * v + 1]]] for s in (0, 1)], found, v) for v in (0, 1)]

    return exchange


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality", seed_rows: int = LABELLED, growth: int = GROWTH) -> Model | None:
    """Train on a table of features and labels, of which ``seed_rows`` are read."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(quality_col).cast("double").alias("y"))
    chosen = _first_ids(known, seed_rows).select("id", "y", "place").collect()  # seed_rows at most
    ids, x = _rows_of(table, [r["id"] for r in chosen])
    y, order = {r["id"]: r["y"] for r in chosen}, {r["id"]: (r["place"], r["id"]) for r in chosen}
    at = sorted(range(len(ids)), key=lambda i: order[int(ids[i])])
    values = np.array([y[int(ids[i])] for i in at])
    if not at:
        return None
    return cotrain((x[0][at], x[1][at]), values, np.arange(len(at)) % 3 == 2, throughout(table, [r["id"] for r in chosen], growth))


def score(table: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, both calibrated views, their combined score and the verdict, by features."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = calibrated(shared.value, _sides(batch.column(1))) if shared.value and batch.num_rows else [np.zeros(batch.num_rows)] * 2
            p = [np.round(sigmoid(v), 6) for v in (*z, (z[0] + z[1]) / 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= threshold)], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    return table.select("doc_id", "x").mapInArrow(apply, "doc_id long, content_score double, metadata_score double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``labels`` and all of ``docs`` (doc_id, text, lang, source), score every document."""
    table = Scratch(docs.sparkSession, "cotraining").save(features(docs), "features")
    return score(table, fit(table, labels), threshold)
