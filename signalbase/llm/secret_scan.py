"""Secret scans: fixed patterns and a battery of randomness tests.

Base patterns find assignments, access keys and hex strings. The method adds spans of
kind ``random``: runs of 16 and more letters, digits and ``+/_=-`` with letters and
digits that no base span overlaps. Names, urls and paths run into the secrets behind
them, so a run is cut at inner ``=``, and each part is a family of candidates: itself,
if one alphabet holds it, and what lies between marks of either base64 alphabet or of
both. For each, the encoding is inferred as the smallest alphabet that holds it (hex,
base32, base64) and three tests ask how likely a natural identifier of its length would
look as random. What natural ones do is fixed below:

* chi-squared over the alphabet's equal cells: natural ones use cells unevenly, so the
  statistic is noncentral, by ``SKEW`` a character; p is its lower tail;
* runs of characters of one class: natural ones change class in ``CHANGE`` of all steps;
  p is the binomial's upper tail of the changes seen;
* serial correlation of neighbours' places in the alphabet: ``FOLLOW`` in natural ones; p
  is the lower tail of the normal around it.

The three depend on each other, so they are combined as e times their geometric mean,
weighted by ``WEIGHTS``, which is a p-value whatever the dependence (Vovk and Wang). Of a
family, the strongest candidates that do not overlap stay, their p-values times the
number of candidates (Bonferroni).

P-values are controlled by Benjamini-Hochberg at ``FDR`` over all candidates of the
corpus, separately in strata of length. They are kept as millionths of a decade, rounded
up; Spark counts them by tenths of a decade first and whole where the threshold may lie,
so the threshold is exact at every size.

Defined cases: null or empty text has no spans; an empty corpus has no threshold;
repeated rows are scanned each; further columns are ignored, and kept by ``redact``.
Base spans of different kinds may overlap and are all given, random ones overlap none;
spans that touch or overlap are redacted by one mark. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import Chunk, chunks

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
MIN_VALUE, MIN_HEX, MIN_RANDOM = 12, 16, 16
CHANGE, SKEW, FOLLOW = 0.18, 0.6, 0.35
WEIGHTS = (0.2, 0.6, 0.2)
FDR = 0.001
STRATA = (16, 24, 32, 48, 64)
DECADE = 1_000_000
COARSE = DECADE // 10
NEVER = 1 << 62
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")

HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
DIGIT, UPPER, LOWER = (np.zeros(256, bool) for _ in range(3))
DIGIT[0x30:0x3A], UPPER[0x41:0x5B], LOWER[0x61:0x7B] = True, True, True
OTHER = np.zeros(256, bool)
OTHER[list(b"+/_=-")] = True
TOKEN = DIGIT | UPPER | LOWER | OTHER
ALPHABETS = (
    b"0123456789abcdef",
    b"0123456789ABCDEF",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
_POSITION = []
for _alphabet in ALPHABETS:
    _table = np.full(256, -1, np.int64)
    _table[list(_alphabet)] = np.arange(len(_alphabet))
    _POSITION.append(_table)


#: Parts of a run between inner "=", with padding; and finer cuts of one.
_PART = re.compile(rb"[^=]+(?:={1,2}\Z)?")
_FINER = tuple(map(re.compile, (rb"[^_-]+", rb"[^+/]+", rb"[^+/_-]+")))
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")


def _log10_normal_below(z: float) -> float:
    """log10 P(standard normal < z)."""
    if z > -30:
        return math.log10(0.5 * math.erfc(-z / math.sqrt(2)))
    return (-z * z / 2 - math.log(-z * math.sqrt(2 * math.pi))) / math.log(10)


def log10_uniformity(x: float, k: int, shift: float) -> float:
    """log10 P(noncentral chi-squared with k degrees < x), by Patnaik and Wilson-Hilferty."""
    scale, degrees = (k + 2 * shift) / (k + shift), (k + shift) ** 2 / (k + 2 * shift)
    spread = 2 / (9 * degrees)
    return _log10_normal_below(((x / scale / degrees) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


@lru_cache(maxsize=65536)
def log10_binomial_tail(n: int, k: int, p: float) -> float:
    """log10 P(Binomial(n, p) >= k)."""
    if k <= 0:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs)
    return min(0.0, (top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10))


def battery(run: np.ndarray) -> tuple[float, float, float]:
    """log10 p of a natural identifier: by uniformity, runs and serial correlation."""
    body = run[: len(run) - int((run[-2:] == 0x3D).sum())]
    which = next((i for i, t in enumerate(_POSITION) if len(body) >= MIN_RANDOM and t[body].min() >= 0), None)
    if which is None:
        return 0.0, 0.0, 0.0
    position, size, n = _POSITION[which][body], len(ALPHABETS[which]), len(body)
    cells = min(size, 8)
    counts = np.bincount(position * cells // size, minlength=cells)
    uniform = log10_uniformity(float(((counts - n / cells) ** 2).sum()) * cells / n, cells - 1, SKEW * n)
    kind = DIGIT[body] * 1 + UPPER[body] * 2 + LOWER[body] * 3
    changes = log10_binomial_tail(n - 1, int((kind[1:] != kind[:-1]).sum()), CHANGE)
    x = position - position.mean()
    spread = float((x * x).sum())
    r = float((x[:-1] * x[1:]).sum()) / spread if spread else 1.0
    return uniform, changes, _log10_normal_below((r - FOLLOW) * math.sqrt(n))


def combined(logs: tuple[float, float, float]) -> float:
    """log10 of e times the weighted geometric mean of p-values, 1 at most."""
    return min(0.0, math.log10(math.e) + sum(w * x for w, x in zip(WEIGHTS, logs)))


def families(run: bytes) -> Iterator[list[tuple[int, int]]]:
    """Of each part of a run, the candidates with letters and digits, longest first."""
    for part in _PART.finditer(run):
        spans = {m.span() for cut in _FINER for m in cut.finditer(run, *part.span())}
        if not (any(x in part[0] for x in (b"+", b"/")) and any(x in part[0] for x in (b"-", b"_"))):
            spans.add(part.span())
        long = (s for s in spans if s[1] - s[0] >= MIN_RANDOM)
        yield sorted((s for s in long if _DIGIT.search(run, *s) and _LETTER.search(run, *s)), key=lambda s: (s[0] - s[1], s[0]))


def random_spans(run: np.ndarray, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, level) of the candidates that stay; ``taken`` are base spans.

    The level is -log10 p in parts of a ``DECADE``.
    """
    for family in families(run.tobytes()):
        family = [(a, b) for a, b in family if not any(x < b and a < y for x, y in taken)]
        less = math.log10(len(family)) if family else 0.0
        found = [(a, b, max(0, math.floor(-(combined(battery(run[a:b])) + less) * DECADE))) for a, b in family]
        kept: list[tuple[int, int, int]] = []
        for a, b, level in sorted(found, key=lambda f: (-f[2], f[0] - f[1], f[0])):
            if not any(x < b and a < y for x, y, _ in kept):
                kept.append((a, b, level))
        yield from kept


def base_spans(raw: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base patterns."""
    found = [(a, 2, b) for a, b in hex_runs]
    low = raw.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= MIN_VALUE]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(raw)]
    return sorted(found)


def _long_runs(chunk: Chunk, inside: np.ndarray, least: int) -> dict[int, list[tuple[int, int]]]:
    """Runs of at least ``least`` bytes by document, offsets within it."""
    starts, ends, pointer = chunk.runs(inside)
    at = np.flatnonzero(ends - starts >= least)
    doc = np.searchsorted(pointer, at, side="right") - 1
    found: dict[int, list[tuple[int, int]]] = {}
    for d, i in zip(doc.tolist(), at.tolist()):
        o = int(chunk.offsets[d])
        found.setdefault(d, []).append((int(starts[i]) - o, int(ends[i]) - o))
    return found


def scan_chunk(chunk: Chunk) -> Iterator[list[dict]]:
    """Spans of each document: base ones, and random candidates with their level."""
    data = chunk.data
    hexes = _long_runs(chunk, HEX[data], MIN_HEX)
    runs = _long_runs(chunk, TOKEN[data], MIN_RANDOM)
    for i in range(len(chunk)):
        raw = chunk.text(i)
        spans = base_spans(raw, hexes.get(i, []))
        rows = [(a, k, b, -1, 0) for a, k, b in spans]
        for a, b in runs.get(i, []):
            run = data[chunk.offsets[i] + a : chunk.offsets[i] + b]
            if not DIGIT[run].any() or not (UPPER[run] | LOWER[run]).any():
                continue
            taken = [(x - a, y - a) for x, _, y in spans if x < b and a < y]
            rows += [(a + x, 3, a + y, sum(y - x >= s for s in STRATA) - 1, level) for x, y, level in random_spans(run, taken)]
        if not rows:
            yield []
            continue
        if not raw.isascii():
            points = np.concatenate(([0], np.cumsum((data[chunk.offsets[i] : chunk.offsets[i + 1]] & 0xC0) != 0x80)))
            rows = [(int(points[a]), k, int(points[b]), s, p) for a, k, b, s, p in rows]
        yield [dict(zip(("start", "kind", "end", "stratum", "level"), r)) for r in sorted(rows)]


SPANS = "array<struct<start:long,kind:int,end:long,stratum:int,level:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("stratum", pa.int32()), ("level", pa.int64())]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all spans, random ones not yet thresholded."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(list(scan_chunk(chunk)), _SPANS)], ["doc_id", "found"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, f"doc_id long, found {SPANS}")


def cutoffs(found: DataFrame, fdr: float = FDR) -> list[int]:
    """Benjamini-Hochberg by stratum of length: the least level that is kept.

    That is the largest p with p <= fdr * rank / all. Tenths of a decade are counted
    first; levels one by one only in those tenths that may hold it.
    """
    rows = found.select(F.explode("found").alias("s")).where("s.kind = 3").select("s.stratum", "s.level")
    by: list[dict[int, int]] = [{} for _ in STRATA]
    for r in rows.groupBy("stratum", F.floor(F.col("level") / COARSE).alias("part")).count().collect():
        by[r["stratum"]][r["part"]] = r["count"]
    open_, above, total = [], {}, [sum(parts.values()) for parts in by]
    for stratum, parts in enumerate(by):
        rank = total[stratum]
        for part in sorted(parts):
            if 10 ** (-(part + 1) * COARSE / DECADE) <= fdr * rank / total[stratum]:
                open_.append((stratum, part))
                above[stratum, part] = rank - parts[part]
                if 10 ** (-part * COARSE / DECADE) <= fdr * rank / total[stratum]:
                    break  # its weakest level is kept for sure
            rank -= parts[part]
    keep = [None] * len(STRATA)
    if open_:
        wanted = F.lit(False)
        for stratum, part in open_:
            wanted = wanted | ((F.col("stratum") == stratum) & (F.col("level") >= part * COARSE) & (F.col("level") < (part + 1) * COARSE))
        levels: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in rows.where(wanted).groupBy("stratum", "level").count().collect():  # COARSE levels a part at most
            levels.setdefault((r["stratum"], r["level"] // COARSE), []).append((r["level"], r["count"]))
        for stratum, part in open_:
            rank = above[stratum, part]
            for level, n in sorted(levels[stratum, part], reverse=True):
                rank += n
                if 10 ** (-level / DECADE) <= fdr * rank / total[stratum]:
                    keep[stratum] = level if keep[stratum] is None else min(keep[stratum], level)
    return [NEVER if k is None else k for k in keep]


def kept_spans(keep: list[int], column: str = "found") -> Column:
    """The spans that stay, by start and then kind."""
    limits = F.array(*(F.lit(k) for k in keep))
    return F.filter(F.col(column), lambda s: (s["kind"] < 3) | (s["level"] >= F.element_at(limits, F.greatest(s["stratum"], F.lit(0)) + 1)))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` (array of start, kind, end) of every document."""
    found = Scratch(docs.sparkSession, "secret_scan").save(candidates(docs, id_col, text_col), "found")
    return found.select("doc_id", kept_spans(cutoffs(found)).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; n_chars follows where it exists."""
    keep = cutoffs(Scratch(docs.sparkSession, "secret_scan").save(candidates(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))).select("found"), "found"))
    at = docs.columns.index(text_col)
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = None, {}
            for chunk in chunks(batch.column(at)):
                for i, rows in enumerate(scan_chunk(chunk)):
                    spans = [(r["start"], r["end"]) for r in rows if r["kind"] < 3 or r["level"] >= keep[r["stratum"]]]
                    if spans:
                        text, parts, end = chunk.text(i).decode(), [], 0
                        for a, b in spans:
                            if b > end:
                                parts += [text[end : max(a, end)], mark] if a >= end else []
                                end = b
                        changed[chunk.lo + i] = "".join(parts) + text[end:]
            if changed:
                texts = batch.column(at).to_pylist()
                for i, text in changed.items():
                    texts[i] = text
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if count_at is not None:
                    sizes = columns[count_at].to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    columns[count_at] = pa.array(sizes, batch.schema.field(count_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(apply, docs.schema)
