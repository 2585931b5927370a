"""Token ids of whole texts for word-end vocabularies, word by word.

A file of this kind lower-cases, drops white space and joins pieces inside words only, so
the ids of a text are those of what stands between its spaces and line ends, one after
the other. What a word gives is remembered (``MEMO`` words of up to ``MEMO_CHARS``
characters at most, then all are forgotten). Words
of plain Latin letters and signs are merged by ``tiktoken`` from the very same file, the
mark of a word's end being the byte 0xFF that no text has; all others, and any other kind
of file, go to the ``tokenizers`` library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache
from struct import pack

import numpy as np

MEMO, MEMO_CHARS = 1 << 20, 32
#: Composed, without white space or control signs, and lower-cased one character at a time.
PLAIN = re.compile(r"[\x21-\x7e\xa1-ɏ]+")


def byte_signs() -> dict[str, int]:
    """The printable character by which byte-level files write each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


def _merger(spec: dict) -> Callable[[str], bytes] | None:
    """Ids of a plain word, by the file's own merges; None for another kind of file."""
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
        return None
    if steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
        return None
    try:
        import regex
        import tiktoken
    except ImportError:
        return None
    signs = byte_signs()
    raw = lambda word: bytes(signs[c] for c in word.removesuffix("</w>")) + b"\xff" * word.endswith("</w>")
    vocab = model["vocab"]
    single = sorted((w for w in vocab if len(w.removesuffix("</w>")) == 1), key=lambda w: (w.endswith("</w>"), vocab[w]))
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [*single, *(w for w in merged if len(w.removesuffix("</w>")) > 1)]
    ranks = {raw(w): i for i, w in enumerate(order)}
    if len(ranks) != len(order):  # some sequence is merged in two ways
        return None
    ids = [vocab[w] for w in order]
    core = tiktoken.Encoding("word-ends", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    encode = core._core_bpe.encode_single_piece
    pieces = regex.compile(steps[0]["pattern"]["Regex"])

    def merge(word: str) -> bytes:
        low = word.lower()
        parts = [low] if low.isalpha() else pieces.findall(low)
        found = [x for part in parts for x in encode(part.encode() + b"\xff")]
        return pack(f"<{len(found)}I", *[ids[x] for x in found])

    return merge


class Words(dict):
    """Word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.merge = _merger(spec)
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        self.library = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isalpha() or not word or PLAIN.fullmatch(word) and not (self.special and self.special.search(word))
        out = self.merge(word) if plain else self.library(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if self.merge is None:
            return self.library(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)
