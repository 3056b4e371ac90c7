"""Event clustering: banded similarity join, components, average linkage, span cap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text, vectors


BLOCK = 2048


def banded_pairs(items: DataFrame, key: str, day: str, vector: str, window: float, least: float) -> DataFrame:
    """(a, b, similarity) of items within ``window`` days whose cosine is ``least`` or more.

    Days are cut into buckets as wide as the window, and buckets by a hash into blocks of
    about ``BLOCK`` items. A block meets the blocks of its own and the next bucket; each
    meeting is one matrix product, so however many items a day holds, a task holds two
    blocks. Items without a day or a vector are in no pair.
    """
    kind = dict(items.dtypes)[key]
    rows = items.select(F.col(key).alias("k"), F.col(day).alias("d"), F.col(vector).alias("v")).where("k is not null and d is not null and v is not null")
    rows = rows.withColumn("bucket", F.floor(F.col("d") / window).cast("long"))
    blocks = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    placed = rows.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks"))).drop("blocks")
    here = blocks.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "blocks")
    same = here.select("bucket", "block", F.col("bucket").alias("to_bucket"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("to"))
    after = blocks.select((F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("after"))
    later = here.join(after, "bucket").select("bucket", "block", (F.col("bucket") + 1).alias("to_bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("after") - 1)).alias("to"))
    meet = same.union(later)
    names = ("bucket", "block", "to_bucket", "to")
    left = meet.join(placed, ["bucket", "block"]).select(*names, F.lit(0).alias("side"), "k", "d", "v")
    other = placed.select(F.col("bucket").alias("to_bucket"), F.col("block").alias("to"), "k", "d", "v")
    right = meet.where("bucket <> to_bucket or block <> to").join(other, ["to_bucket", "to"]).select(*names, F.lit(1).alias("side"), "k", "d", "v")

    def product(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side, days = np.asarray(group["side"]), np.asarray(group["d"]).astype(float)
        x = np.asarray(pc.list_flatten(group["v"])).astype(float).reshape(group.num_rows, -1)
        i = np.flatnonzero(side == 0)
        j = np.flatnonzero(side == 1)
        alone = not len(j)
        j = i if alone else j
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for first, product, floor in _products(x[i], x[j], least):
            p, q = np.divmod(np.flatnonzero(product.ravel() >= floor), len(j))
            p += first
            near = (p < q) | (not alone)
            p, q = i[p[near]], j[q[near]]
            near = np.abs(days[p] - days[q]) <= window
            p, q = p[near], q[near]
            similar = np.einsum("ij,ij->i", x[p], x[q])
            near = similar >= least
            found.append((p[near], q[near], similar[near]))
        p, q, similar = (np.concatenate(part) for part in zip(*found))
        return pa.table({"p": group["k"].take(pa.array(p)), "q": group["k"].take(pa.array(q)), "similarity": pa.array(similar)})

    found = left.union(right).groupBy(*names).applyInArrow(product, f"p {kind}, q {kind}, similarity double")
    return found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


EDGES = 1 << 18


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``rows`` rows or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of about ``EDGES`` rows as stars around their components' smallest nodes."""
    for batch in _gathered(batches, EDGES):
        both = pa.concat_arrays([batch.column(0), batch.column(1)])
        order = pc.array_sort_indices(pc.unique(both))
        nodes = pc.unique(both).take(order)
        ends = np.asarray(pc.index_in(both, nodes)).tolist()
        head = list(range(len(nodes)))

        def find(x: int) -> int:
            while head[x] != x:
                head[x] = head[head[x]]
                x = head[x]
            return x

        for p, q in zip(ends[: batch.num_rows], ends[batch.num_rows :]):
            p, q = find(p), find(q)
            if p != q:
                head[max(p, q)] = min(p, q)
        root = np.array([find(x) for x in range(len(nodes))], np.int64)
        out = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(out)), nodes.take(pa.array(root[out]))], ["u", "v"])


def stars(pairs: DataFrame, kind: str, save) -> DataFrame:
    """(u, v): every node of pairs (a, b) with the least node it reaches, itself left out.

    Edges of a batch are contracted to stars first; then large-star and small-star steps
    alternate, whose number grows with the logarithm of the graph's size, until every
    edge leads from a node of one edge to a node that none leaves. ``save(df)`` cuts
    lineage (checkpoint or written table). ``kind`` is the nodes' type.
    """
    edges = save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInArrow(_contracted, f"u {kind}, v {kind}").distinct())
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty():
            return edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # every node keeps its own edge to its neighbourhood's minimum
        large = large.union(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = save(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())


def components(nodes: DataFrame, pairs: DataFrame, key: str, save) -> DataFrame:
    """(key, component): the least key reachable over pairs (a, b)."""
    found = stars(pairs, dict(nodes.dtypes)[key], save).select(F.col("u").alias(key), F.col("v").alias("_c"))
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("_c", key).alias("component"))


def average_link(similarity: np.ndarray, least: float) -> list[list[int]]:
    """Merge the pair of clusters of the largest mean similarity while it is ``least``
    or more; of equal pairs the first."""
    clusters = [[i] for i in range(len(similarity))]
    total = similarity.astype(float).copy()
    np.fill_diagonal(total, -np.inf)
    size = np.ones(len(clusters))
    while len(clusters) > 1:
        mean = total / np.outer(size, size)
        at = int(np.argmax(np.triu(mean, 1) + np.tril(np.full(mean.shape, -np.inf))))
        i, j = divmod(at, len(mean))
        if not mean[i, j] >= least - 1e-12:
            break
        clusters[i] += clusters.pop(j)
        total[i] += total[j]
        total[:, i] = total[i]
        total = np.delete(np.delete(total, j, 0), j, 1)
        total[i, i] = -np.inf
        size[i] += size[j]
        size = np.delete(size, j)
    return [sorted(c) for c in clusters]


DENSE = 256
CELLS = 1 << 22
LINKS = 24_000_000
SPREAD = 8192
SLACK = 1e-9


def _average_link_dense(total: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
    """Where each cluster goes, where most are similar: every cluster is a candidate, so
    memory grows with the rows only.

    Each cluster remembers its best later partner; a merge
    is no nearer to a third cluster than the nearer of its two, so only those whose
    partner merged look again, and values only rise by rounding.
    """
    n = len(total)
    total, size, alive = total.copy(), size.copy(), np.ones(n, bool)
    root = np.arange(n)
    best, partner = np.full(n, -np.inf), np.zeros(n, np.int64)

    def look(rows: np.ndarray) -> None:
        step = max(1, CELLS // n)
        for s in range(0, len(rows), step):
            at = rows[s : s + step]
            low = int(at[0]) + 1
            best[at] = -np.inf
            if low < n:
                mean = total[at] @ total[low:].T / np.outer(size[at], size[low:])
                mean[~alive[low:][None, :] | (np.arange(low, n)[None, :] <= at[:, None])] = -np.inf
                partner[at] = low + mean.argmax(1)
                best[at] = mean.max(1)

    look(np.arange(n))
    while n > 1:
        i = int(best.argmax())
        if not best[i] >= least - 1e-12:
            break
        j = int(partner[i])
        root[j] = i
        total[i] += total[j]
        size[i] += size[j]
        alive[j], best[j] = False, -np.inf
        stale = alive & ((partner == i) | (partner == j)) & (best > -np.inf)
        stale[i] = True
        early = np.flatnonzero(alive[:i] & ~stale[:i])
        mean = total[early] @ total[i] / (size[early] * size[i])
        rise = (mean > best[early]) | ((mean == best[early]) & (i < partner[early]))
        best[early[rise]], partner[early[rise]] = mean[rise], i
        look(np.flatnonzero(stale))
    return root


def _products(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, float]]:
    """Products of the rows of ``x`` with ``y`` in slices: first row, products and the
    value from which one may be ``least`` or more.

    Single precision, with its rounding as slack: more than those there are do no harm.
    """
    most = max(float((part * part).sum(1, dtype=float).max(initial=0)) for part in (x, y))
    x, y = x.astype(np.float32), y.astype(np.float32)
    step = max(1, CELLS // max(1, len(y)))
    for s in range(0, len(x), step):
        yield s, x[s : s + step] @ y.T, least - 2.4e-7 * x.shape[1] * most


def _similar(x: np.ndarray, least: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The lowest level, from ``least`` on, that ``LINKS`` pairs reach at most, and the pairs
    (i < j) whose product may reach it; an infinite level if there is none."""
    levels = np.linspace(least, max(least, float((x * x).sum(1).max(initial=0))), 65)
    counts = np.zeros(len(levels), np.int64)
    found, total = [], 0
    for s in range(0, len(x), BLOCK):
        for first, product, floor in _products(x[s : s + BLOCK], x[s:], least):
            hit = np.flatnonzero(product.ravel() >= floor)
            i, j = np.divmod(hit, product.shape[1])
            later = j > i + first
            reach = np.searchsorted(levels, product.ravel()[hit[later]] + (least - floor), side="right") - 1
            counts += np.bincount(np.maximum(reach, 0), minlength=len(levels))
            total += len(reach)
            found.append(((i[later] + s + first).astype(np.int32), (j[later] + s).astype(np.int32)))
            if total > LINKS:
                found.clear()
    if total > LINKS:
        fits = np.flatnonzero(counts[::-1].cumsum()[::-1] <= LINKS)
        if not len(fits) or not fits[0] or not counts[fits[0] :].any():
            return np.inf, np.zeros(0, np.int32), np.zeros(0, np.int32)
        return _similar(x, float(levels[fits[0]]))
    none = [np.zeros(0, np.int32)]
    return least, np.concatenate([i for i, _ in found] or none), np.concatenate([j for _, j in found] or none)


def _means(total: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mean similarity of the clusters ``i`` with the clusters ``j``, pair by pair."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 15):
        at = slice(s, s + (1 << 15))
        out[at] = np.einsum("ij,ij->i", total[i[at]], total[j[at]])
        out[at] /= size[i[at]] * size[j[at]]
    return out


def _merged(total: np.ndarray, size: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: float) -> np.ndarray:
    """Where each cluster goes while a pair's mean is ``least`` or more; (lo < hi) are the
    pairs that may reach it. ``total`` and ``size`` follow.

    A merge is no nearer to a third cluster than the nearer of its two, and of equals takes
    the first one's place. So two clusters that are each other's best, of equals the first,
    merge whatever others do: all such pairs of a round merge at once. For the same reason
    a pair that falls below ``least`` is no candidate any more.
    """
    n = len(total)
    root = np.arange(n)
    value = _means(total, size, lo, hi)
    keep = value >= least - SLACK
    lo, hi, value = lo[keep], hi[keep], value[keep]
    while len(lo):
        best, partner = np.full(n, -np.inf), np.full(n, n)
        for of in (lo, hi):
            np.maximum.at(best, of, value)
        for of, other in ((lo, hi), (hi, lo)):
            tied = np.flatnonzero(value == best[of])
            np.minimum.at(partner, of[tied], other[tied])
        i = np.flatnonzero((best >= least - 1e-12) & (partner > np.arange(n)))
        i = i[partner[partner[i]] == i]
        if not len(i):
            break
        j = partner[i]
        total[i] += total[j]
        size[i] += size[j]
        to, changed = np.arange(n, dtype=np.int32), np.zeros(n, bool)
        to[j] = root[j] = i
        changed[i] = changed[j] = True
        moved = changed[lo] | changed[hi]
        p, q = to[lo[moved]], to[hi[moved]]
        apart = p != q
        p, q = p[apart], q[apart]
        pair = np.sort(np.minimum(p, q) * np.int64(n) + np.maximum(p, q))
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))[: len(pair)]]
        p, q = (part.astype(np.int32) for part in np.divmod(pair, n))
        mean = _means(total, size, p, q)
        keep = mean >= least - SLACK
        lo, hi, value = (np.concatenate([old[~moved], new[keep]]) for old, new in ((lo, p), (hi, q), (value, mean)))
    return root


def average_link_vectors(x: np.ndarray, least: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> list[list[int]]:
    """``average_link`` of ``x @ x.T`` without that matrix.

    The summed similarity of two clusters is the product of their summed vectors. A mean of
    ``least`` takes a pair of ``least``, so only ``pairs`` that may reach it are candidates.
    If they are more than ``LINKS``, merges go first down to a higher level that
    fewer reach, then on among the clusters that are left.
    """
    n = len(x)
    total, size, root, alive = x.astype(float).copy(), np.ones(n), np.arange(n), np.arange(n)
    level = before = np.inf
    while level > least:
        level, lo, hi = (least, *pairs) if pairs is not None else _similar(total[alive] / size[alive][:, None], least)
        sums, sizes = total[alive], size[alive]
        if level >= before or level == np.inf:
            level, to = least, _average_link_dense(sums, sizes, least)
        else:
            to = _merged(sums, sizes, lo, hi, level)
        total[alive], size[alive] = sums, sizes
        root[alive] = alive[to]
        alive = alive[to == np.arange(len(to))]
        before = level
    while (root[root] != root).any():
        root = root[root]
    order = np.argsort(root, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1)] if n else []


def _similar_blocks(rows: DataFrame, least: float) -> DataFrame:
    """(component, pairs): the places (i < j) of members whose product may be ``least`` or more,
    as packed int32, of components that have ``LINKS`` of them at most.

    ``rows`` are (component, at, v). Places are cut into blocks, and each meeting of two is a
    product of its own. Pairs are counted before any is given out.
    """
    kind = dict(rows.dtypes)["component"]
    placed = rows.withColumn("block", F.floor(F.col("at") / SPREAD).cast("int"))
    blocks = rows.groupBy("component").agg((F.floor(F.max("at") / SPREAD).cast("int") + 1).alias("blocks"))
    left = placed.join(blocks, "component").withColumn("to", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = placed.join(blocks, "component").where("block > 0").withColumn("to", F.col("block")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("block") - 1)))
    names = ("component", "block", "to")
    # dealt anew, as rows that lie by component would all stay in one task
    met = left.select(*names, F.lit(0).alias("side"), "at", "v").union(right.select(*names, F.lit(1), "at", "v")).repartition(*names)

    def hits(group: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group = group.combine_chunks()
        side, at = np.asarray(group["side"]), np.asarray(group["at"])
        x = np.asarray(pc.list_flatten(group["v"])).reshape(group.num_rows, -1)
        i = np.flatnonzero(side == 0)
        j = np.flatnonzero(side == 1) if (side == 1).any() else i
        for first, product, floor in _products(x[i], x[j], least):
            p, q = np.divmod(np.flatnonzero(product.ravel() >= floor), product.shape[1])
            p, q = at[i[p + first]], at[j[q]]
            yield p[p < q], q[p < q]

    def count(group: pa.Table) -> pa.Table:
        return pa.table({"component": group["component"].slice(0, 1), "n": pa.array([sum(len(p) for p, _ in hits(group))], pa.int64())})

    def pack(group: pa.Table) -> pa.Table:
        found = [np.concatenate(pair).astype("<i4").tobytes() for pair in hits(group)]
        return pa.table({"component": pa.array([group["component"][0].as_py()] * len(found), group.schema.field("component").type), "pairs": pa.array(found, pa.binary())})

    few = met.groupBy(*names).applyInArrow(count, f"component {kind}, n long").groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") <= LINKS).select("component")
    return met.join(few, "component", "left_semi").groupBy(*names).applyInArrow(pack, f"component {kind}, pairs binary")


def split_components(members: DataFrame, key: str, vector: str, least: float, order: str | None = None) -> DataFrame:
    """(key, component, cluster) by average linkage inside each component, of any size.

    Members go in ``order``, then by key. Components beyond ``DENSE`` members go by summed
    vectors instead of a matrix; the similar pairs of those beyond ``SPREAD`` are found by
    many tasks.
    """
    by = [order, key] if order else [key]
    kinds = dict(members.dtypes)
    kind = kinds[key]

    def clustered(names: pa.Array, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> pa.Array:
        found = average_link(x @ x.T, least) if len(x) <= DENSE else average_link_vectors(x, least, pairs)
        order = np.asarray(pc.array_sort_indices(names))
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        first = np.empty(len(x), np.int64)
        for cluster in found:
            first[cluster] = rank[cluster].min()
        return names.take(pa.array(order[first]))

    def split(group: pa.Table, other: pa.Table | None = None) -> pa.Table:
        group = group.combine_chunks().sort_by([(c, "ascending") for c in by]).combine_chunks()
        x = np.asarray(pc.list_flatten(group["v"])).astype(float).reshape(group.num_rows, -1)
        pairs = None
        if other is not None and other.num_rows:
            halves = [np.frombuffer(raw.as_buffer(), "<i4").reshape(2, -1) for raw in other["pairs"]]
            pairs = tuple(np.concatenate([half[side] for half in halves]) for side in (0, 1))
        names = group[key].combine_chunks()
        return pa.table({key: names, "component": group["component"], "cluster": clustered(names, x, pairs)})

    rows = members.select(*dict.fromkeys((*by, "component")), F.col(vector).alias("v"))
    large = rows.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD).select("component")
    schema = f"{key} {kind}, component {kinds['component']}, cluster {kind}"
    small = rows.join(large, "component", "left_anti").groupBy("component").applyInArrow(lambda group: split(group), schema)
    wide = rows.join(large, "component", "left_semi")
    place = (F.row_number().over(Window.partitionBy("component").orderBy(*by)) - 1).alias("at")
    found = _similar_blocks(wide.select("component", place, "v"), least)
    return small.union(wide.groupBy("component").cogroup(found.groupBy("component")).applyInArrow(lambda left, right: split(left, right), schema))


def cap_span(df: DataFrame, group: str, key: str, day: Column, span: float) -> DataFrame:
    """(group, key, part): groups cut, in time order, where a part would exceed ``span`` days.

    The start of a part depends on earlier cuts, so it is a fold over the sorted rows; it
    streams, from one part's start to the next, and holds a batch, whatever the group.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(group).alias("g"), F.col(key).alias("k"), day.cast("double").alias("d")).repartition("g").sortWithinPartitions("g", "d", "k")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, part, first = None, 0.0, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = np.asarray(pc.dictionary_encode(batch.column(0), null_encoding="encode").indices)
            edges = np.flatnonzero(code[1:] != code[:-1]) + 1
            days, parts = np.asarray(batch.column(2)), np.zeros(n, np.int32)
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), n]):
                name = batch.column(0)[a].as_py()
                if first or name != last:
                    last, start, part, first = name, days[a], 0, False
                while a < b:
                    late = a + int(np.searchsorted(days[a:b] - start, span, side="right"))
                    parts[a:late] = part
                    if late < b:
                        start, part = days[late], part + 1
                    a = late
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts)], [group, key, "part"])

    return rows.mapInArrow(fold, f"{group} {kinds[group]}, {key} {kinds[key]}, part int")


def group_events(items: DataFrame, key: str, day: str, vector: str, window: float, least: float, span: float, save) -> DataFrame:
    """(key, group): items of like vectors and near days, no group longer than ``span`` days.

    Pairs inside the window form components, components are split by average linkage, and
    what is too long is cut in time order. A group is named by its least key.
    """
    whole = save(components(items, banded_pairs(items, key, day, vector, window, least), key, save))
    rows = items.select(key, day, vector).join(whole, key)
    many = whole.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1").select("component")
    split = split_components(save(rows.join(many, "component", "left_semi")), key, vector, least, day).select(key, "cluster")
    alone = rows.join(many, "component", "left_anti").select(key, F.col(key).alias("cluster"))
    clustered = save(split.unionByName(alone)).join(items.select(key, day), key)
    parts = cap_span(clustered, "cluster", key, F.col(day), span)
    names = parts.groupBy("cluster", "part").agg(F.min(key).alias("group"))
    return parts.join(names, ["cluster", "part"]).select(key, "group")


def summarize(members: DataFrame, group: str, key: str, title: str, ts: str, source: str, vector: str) -> DataFrame:
    """One row per group: counts, provenances, time range, representative title."""
    centers = vectors.centroids(members, group, vector).withColumnRenamed("centroid", "_c")
    near = members.join(centers, group).withColumn("_s", vectors.dot(F.col(vector), F.col("_c")))
    per = near.groupBy(group).agg(
        F.count("*").alias("n_items"),
        F.count_distinct(source).alias("n_sources"),
        F.array_join(F.array_sort(F.collect_set(source)), "; ").alias("sources"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.min_by(title, F.struct(-F.round("_s", 9), F.col(key))).alias("title"),
        F.min(F.col(key).cast("string")).alias("_least"),
    )
    return per.select(text.group_id(F.col("_least")).alias("group_id"), *per.columns[:-1], (F.col("n_items") > F.col("n_sources")).alias("is_repeat"))


def event_day(published: Column, detected: Column) -> Column:
    """Grouping goes by publication first; classification by detection first."""
    return dates.days(F.coalesce(published, detected))
