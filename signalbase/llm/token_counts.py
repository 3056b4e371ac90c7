"""Token counts: count-only Viterbi over Aho-Corasick matches.

A unigram tokenizer splits a text at its spaces (each a ``▁`` that opens a piece) and
takes the best-scored path of pieces through every part. Only the number of pieces
is asked for, so dynamic programming carries the best score and the count of its
path; an Aho-Corasick automaton over the vocabulary gives all matches by their end.

Tie rules are the tokenizer's: of equal scores the path whose last piece starts first
stays; a character that is no piece costs the least score less ``UNKNOWN_PENALTY``, and
unknown characters count as their bytes.

Counts of parts are kept in a cache bounded in entries and characters, cleared when full;
parts over ``LONG`` characters are counted each time.

Defined cases: null and empty texts have 0 tokens; a text of any length is counted whole,
one without spaces as one part; repeated rows count each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE, LONG = 400_000, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with Zipf log probabilities by rank.

    The file's own scores are ranks of merges, not probabilities.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i)]
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [(p, -math.log(i + 1) - total) for i, p in enumerate(pieces)]


class Counter:
    """count(text) by the vocabulary's best path."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.cache: dict[str, int] = {}

    def part(self, text: str) -> int:
        """Pieces of one part, its space included."""
        n = len(text)
        best, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        matches = self.automaton.iter(text)
        end, value = next(matches, (n, None))
        for e in range(n):
            top, from_, pieces = -math.inf, n, 0
            while end == e:
                start = e + 1 - value[0]
                score = best[start] + value[1]
                if score > top or (score == top and start < from_):
                    top, from_, pieces = score, start, count[start] + 1
                end, value = next(matches, (n, None))
            if text[e] not in self.singles:
                score = best[e] + self.unknown
                if score > top or (score == top and e < from_):
                    top, pieces = score, count[e] + len(text[e].encode())
            best[e + 1], count[e + 1] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        parts = text.split(SPACE)
        if text[0] == SPACE:
            del parts[0]
        total, cache = 0, self.cache
        for p in parts:
            n = cache.get(p)
            if n is None:
                if len(cache) >= CACHE:
                    cache.clear()
                n = self.part(SPACE + p)
                if len(p) <= LONG:
                    cache[p] = n
            total += n
        return total


_loaded: dict[str, Counter] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row."""
    path = path or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Counter(vocabulary(path))
        counter = _loaded[path]
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                n = [counter.count(chunk.text(i).decode("utf-8", "replace")) for i in range(len(chunk))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, n_tokens long")
