"""Best-fit packing of token sequences by a configuration linear program.

Documents become ids plus the separator 0. Longer ones than ``capacity`` are cut into
full pieces of which only the first may be shorter. What is packed is the histogram
of piece lengths (at most ``capacity`` entries on the driver, whatever the corpus):

* configuration LP: minimise the number of sequences, covering each length's count
  by configurations (multisets of lengths that fit a sequence);
* it is solved by multiplicative weights; the pricing problem, the configuration of
  the largest total price, is an unbounded knapsack by dynamic programming, of which a
  round takes several columns; rounds go on until every length is covered whole;
* every round's prices are a solution of the dual, which bounds the optimum from below,
  as dual-feasible functions of the lengths do;
* the fractional solution is rounded down to counts that the histogram has left,
  and the rest is packed best-fit decreasing, on groups of equal sequences. Best-fit of
  everything is among the roundings, so the plan never needs more sequences than it.

Spark then numbers the pieces within each length and looks their place up in the plan.

Defined cases: a null text is empty, and an empty document is one piece, the separator
alone; repeated rows are packed each; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import default_path, load
from ._spark import Scratch
from ._text import chunks

CAPACITY = 2048
SEPARATOR = 0
COLUMNS, NEAR = 64, 0.98
STEP, RATE, POWER = 0.25, 0.05, 1.1
BOUNDS = 50
GROUP_ROWS = 512
SHARES = (1.0, 0.9, 0.75, 0.5, 0.0)

Config = tuple[tuple[tuple[int, int], ...], int]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def price_out(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the largest price of a configuration for each
    room up to ``capacity``, and the length put last into it (0: none).

    prices[length] is the worth of a piece; best[c] is found for rising c at once
    over all last pieces.
    """
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = prices[1 : c + 1] + best[c - 1 :: -1][:c]
        i = int(worth.argmax())
        if worth[i] > best[c - 1]:
            best[c], last[c] = worth[i], i + 1
        else:
            best[c] = best[c - 1]
    return best, last


def configuration(last: np.ndarray, head: int, capacity: int) -> dict[int, int]:
    """The best configuration that holds a piece of length ``head``."""
    found = {head: 1}
    c = capacity - head
    while c > 0:
        n = int(last[c])
        if n:
            found[n] = found.get(n, 0) + 1
        c -= n or 1
    return found


def solve_lp(counts: np.ndarray, capacity: int = CAPACITY, step: float = STEP, rate: float = RATE, power: float = POWER) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations with fractional uses that cover ``counts`` (by length) exactly,
    and a lower bound of the LP's optimum.

    Multiplicative weights: the weight of a length, its price while it has pieces left,
    is (length / capacity) ** ``power`` at first and falls by a factor exp(-``rate`` * share
    covered). Each round prices configurations by one knapsack and takes, for the longest
    lengths whose best configuration is worth ``NEAR`` of the best, that configuration,
    ``COLUMNS`` at most; each is used as far as its lengths have pieces left, but not
    beyond ``step`` of the count of its scarcest length (or one use). Every use exhausts a
    length or takes ``step`` of one, so rounds end.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return [], 0.0
    left, weight = counts.astype(float), np.zeros(len(counts))
    weight[lengths] = (lengths / capacity) ** power
    uses: dict[tuple[tuple[int, int], ...], float] = {}
    sizes = np.arange(len(counts))
    bound = float((counts * sizes).sum()) / capacity
    for k in range(1, BOUNDS + 1):  # dual-feasible functions of Fekete and Schepers
        parts, rest = np.divmod((k + 1) * sizes, capacity)
        bound = max(bound, float((counts * np.where(rest == 0, sizes / capacity, parts / k)).sum()))
    while True:
        open_ = lengths[left[lengths] > 0]
        if not len(open_):
            return [(dict(k), v) for k, v in uses.items()], bound
        prices = np.zeros(capacity + 1)
        prices[open_] = weight[open_]
        best, last = price_out(prices, capacity)
        bound = max(bound, float((prices * counts).sum()) / best[capacity])
        worth = prices[open_] + best[capacity - open_]
        gain = np.zeros(len(counts))
        for head in open_[worth >= NEAR * worth.max()][::-1][:COLUMNS].tolist():
            config = configuration(last, head, capacity)
            room = min(left[n] / k for n, k in config.items())
            if room <= 0:
                continue
            use = min(room, max(1.0, step * min(counts[n] / k for n, k in config.items())))
            key = tuple(sorted(config.items(), reverse=True))
            uses[key] = uses.get(key, 0.0) + use
            for n, k in config.items():
                left[n] -= use * k
                if left[n] < 1e-9 * counts[n]:
                    left[n] = 0.0
                gain[n] += use * k / counts[n]
        weight *= np.exp(-rate * gain)


def best_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Config]:
    """Best-fit decreasing on counts by length; groups of equal sequences at once."""
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[Config] = []
    free: list[int] = []
    import bisect

    def put(left: int, config: tuple[tuple[int, int], ...], times: int) -> None:
        if times <= 0:
            return
        if left == 0:
            done.append((config, times))
            return
        if left not in room:
            room[left] = []
            bisect.insort(free, left)
        room[left].append((config, times))

    for n in np.flatnonzero(counts)[::-1].tolist():
        todo = int(counts[n])
        at = bisect.bisect_left(free, n)
        while todo and at < len(free):
            left = free[at]
            groups = room.pop(left)
            free.pop(at)
            each = left // n
            back = []
            for config, times in groups:
                full = min(times, todo // each)
                put(left - each * n, (*config, (n, each)), full)
                todo -= full * each
                rest = times - full
                if rest and todo and todo < each:
                    put(left - todo * n, (*config, (n, todo)), 1)
                    todo, rest = 0, rest - 1
                if rest:
                    back.append((config, rest))
            for config, times in back:
                put(left, config, times)
            at = bisect.bisect_left(free, n) if not back else len(free)
        if todo:
            each = capacity // n
            put(capacity - each * n, ((n, each),), todo // each)
            if todo % each:
                put(capacity - todo % each * n, ((n, todo % each),), 1)
    return done + [g for groups in room.values() for g in groups]


def round_down(fractional: list[tuple[dict[int, int], float]], counts: np.ndarray, share: float, capacity: int) -> list[Config]:
    """Whole uses of full configurations, up to ``share`` of each; the rest best-fit."""
    left, plan = counts.copy(), []
    for config, use in fractional:
        if sum(n * k for n, k in config.items()) < capacity:
            continue
        times = min(int(share * use + 1e-6), *(int(left[n]) // k for n, k in config.items()))
        if times > 0:
            plan.append((tuple(sorted(config.items(), reverse=True)), times))
            for n, k in config.items():
                left[n] -= times * k
    return plan + best_fit(left, capacity)


def make_plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Config]:
    """Configurations with whole uses that hold every piece exactly once.

    Of several shares at which the fractional solution is rounded, the one that needs
    the fewest sequences; a share of nothing is best-fit alone.
    """
    left = counts.astype(np.int64).copy()
    whole = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    fractional = sorted(solve_lp(left, capacity)[0], key=lambda x: -x[1])
    return whole + min((round_down(fractional, left, share, capacity) for share in SHARES), key=lambda plan: sum(times for _, times in plan))


def places(plan: list[Config], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan as ranges: the pieces of a length from number ``first`` on lie in
    sequences from ``sequence`` on, ``each`` in one, at ``offset``."""
    used = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for config, times in plan:
        offset = 0
        for n, each in config:
            rows.append((n, int(used[n]), sequence, each, offset))
            used[n] += times * each
            offset += n * each
        sequence += times
    rows.sort()
    names = ("length", "first", "sequence", "each", "offset")
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(names)}


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows, at = [], []
                for i in range(len(chunk)):
                    ids = np.append(bpe.encode(chunk.text(i)), np.uint32(SEPARATOR)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
                        at.append(chunk.lo + i)
                piece, start, length, crc = zip(*rows)
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(apply, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The place of every piece: sequence_id and offset, gapless from 0."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, path or default_path(), id_col, text_col, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    plan = docs.sparkSession.sparkContext.broadcast(places(make_plan(counts, capacity), capacity))
    # A length may hold most pieces; it is numbered in groups of bounded size.
    most = int(counts.max())
    n_groups = max(1, -(-most // max(GROUP_ROWS, int(most**0.5))))
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    base = grouped.groupBy("length", "_group").count().select("length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = grouped.withColumn("_inside", inside).join(base, ["length", "_group"])
    ranked = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_inside")).alias("rank"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = (p["length"] << 48) + p["first"]
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            at = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            inside = rank - p["first"][at]
            each = p["each"][at]
            sequence = p["sequence"][at] + inside // each
            offset = p["offset"][at] + inside % each * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(apply, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
