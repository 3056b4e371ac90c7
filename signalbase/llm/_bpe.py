"""Byte-level BPE ids of a tokenizer file, at the speed of a rank-table encoder.

The tokenizer's JSON file is the authority. When its merges are in rank order (id =
256 + position), the same vocabulary is given to a rank-table encoder, which yields
the same ids several times faster; texts beyond the Latin blocks, where the two
libraries' Unicode tables could differ, and files of another kind go through the
tokenizer itself. Strings of special tokens inside texts are ordinary text.
"""

from __future__ import annotations

import json

import numpy as np

# fixed value: the pre-tokenizer pattern of byte-level BPE files with use_regex
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_END = 0xC9


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """encode(text) -> uint32 ids; loaded once a worker by ``load``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
        ranked = all(model["vocab"].get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges))
        if plain and ranked and not model.get("ignore_merges"):
            import tiktoken

            letters = _byte_letters()
            special = {t["content"] for t in spec.get("added_tokens", [])}
            ranks = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8", "replace")
        if self.fast is not None and (not raw or max(raw) <= LATIN_END):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]
