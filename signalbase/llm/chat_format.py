"""Chat formatting with offset-aligned loss masks.

Turns render as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles, ``<``
backslashes ``|`` gets one more backslash, so no text can hold a control string and
unescaping takes one off. A conversation is rendered whole and encoded once with
offsets; the sorted spans of assistant texts are intersected with the sorted token
spans by binary search. A token belongs to the loss if it overlaps such a span, and
the characters under the mask are the tokens' spans clipped to it.

Conversations of any length stream: turns are gathered into blocks of about ``BLOCK``
characters, cut between a turn's final newline and the next ``<|im_start|>``, where the
tokenizer always cuts, so blocks' ids joined are the whole conversation's ids.

Defined cases: null texts and roles are empty; turns are ordered by turn, then role
and text, so repeated rows stay and ties are settled; a null conv_id is a conversation
of its own; empty assistant texts have no span; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import default_path

START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 1 << 17
LOSS_ROLE = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of turns and the spans of assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def intersect(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens overlap a span, and the merged character spans under them."""
    mask = np.zeros(len(offsets), bool)
    if not len(spans) or not len(offsets):
        return mask, np.zeros((0, 2), np.int64)
    starts, ends = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    first, last = np.searchsorted(ends, spans[:, 0], side="right"), np.searchsorted(starts, spans[:, 1], side="left")
    covered = []
    for (a, b), i, j in zip(spans, first, last):
        mask[i:j] = True
        run = None
        for s, e in zip(np.maximum(starts[i:j], a).tolist(), np.minimum(offsets[i:j, 1], b).tolist()):
            if run is not None and s <= run[1]:
                run[1] = max(run[1], e)
            elif e > s:
                run = [s, e]
                covered.append(run)
    return mask, np.array(covered, np.int64).reshape(-1, 2)


_loaded: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _loaded[path] = t
    return _loaded[path]


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, block, text, ids, loss_mask (by token) and loss_spans (flat, of text)."""
    path = path or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(conv: int | None, number: int, turns: list[tuple[str, str]]) -> tuple:
            text, spans = render(turns)
            coded = _tokenizer(path).encode(text, add_special_tokens=False)
            mask, covered = intersect(np.array(coded.offsets, np.int64).reshape(-1, 2), spans)
            return conv, number, text, coded.ids, mask.tolist(), covered.ravel().tolist()

        def blocks() -> Iterator[tuple]:
            now, number, turns, size = object(), 0, [], 0
            for batch in batches:
                for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                    role, text = role or "", text or ""
                    if turns and (conv != now or size >= BLOCK):
                        yield block(now, number, turns)
                        number, turns, size = number + 1, [], 0
                    if conv != now:
                        now, number = conv, 0
                    turns.append((role, text))
                    size += len(role) + len(text)
            if turns:
                yield block(now, number, turns)

        held, size = [], 0
        for row in blocks():
            held.append(row)
            size += len(row[2])
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*held), _TYPES)], names=_NAMES)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*held), _TYPES)], names=_NAMES)

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(apply, "conv_id long, block long, text string, ids array<int>, loss_mask array<boolean>, loss_spans array<long>")


_NAMES = ["conv_id", "block", "text", "ids", "loss_mask", "loss_spans"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64())]


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, recovered from formatted text and loss spans.

    ``in_order`` says that blocks come conversation by conversation and in their order, as
    ``format_conversations`` gives them; they are not shuffled again then.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = object(), None, []

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv != now or state is None:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                end = 0
                for m in _TURN.finditer(text):
                    if m.start() != end:
                        raise ValueError("formatted text has something between turns")
                    end = m.end()
                    state[0] += 1
                    state[1].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                if end != len(text):
                    raise ValueError("formatted text ends within a turn")
                for a, b in zip(spans[::2], spans[1::2]):
                    part = unescape(text[a:b])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _DIGEST)], names=_DIGESTS)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), _DIGEST)], names=_DIGESTS)

    ordered = formatted.select("conv_id", "block", "text", "loss_spans")
    if not in_order:
        ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(apply, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_DIGEST = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
