"""Byte-level BPE over whole texts, by pieces that repeat.

A vocabulary file is the ``.json`` of the ``tokenizers`` library. A text is cut at
every *sure* boundary: a space with a non-space on both sides. The pre-token
pattern of byte-level BPE always starts a new pre-token there whatever stands
around it, so the tokens of a text are those of its pieces one after another. The
pieces are mostly repeated words, and their tokens are remembered. Strings of special
tokens must be without white space: each then lies in one piece.
"""

import json
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# Entries remembered at once, and the longest piece that is remembered.
REMEMBERED, LONGEST = 400_000, 64

# Two white characters side by side: cut such lines at no space, let the pattern do it.
_ADJACENT_WHITE = re.compile(r"\s\s")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies spell printable bytes as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts; the string of a special token is that token, as the library reads it."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        self._bpe = tiktoken.Encoding(
            "byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        encode = self._encode
        self._ids = _Remembered(lambda piece: _bytes(encode(piece)))
        self._ids_after_space = _Remembered(lambda word: _bytes(encode(" " + word)))
        self._counts = _Remembered(lambda piece: len(encode(piece)))

    def _encode(self, piece: str) -> list[int]:
        if self._special.search(piece):
            return self._bpe.encode(piece, allowed_special="all")
        return self._bpe.encode_ordinary(piece)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if _ADJACENT_WHITE.search(text):
            return b"".join(map(self._ids.__getitem__, _pieces_of_spaced_text(text)))
        parts, after_space = [], self._ids_after_space.__getitem__
        for line in text.split("\n"):
            first, *words = line.split(" ")
            parts.append(self._ids[first])
            parts += map(after_space, words)
            parts.append(self._ids["\n"])
        parts.pop()
        return b"".join(parts)

    def counts(self, parts: list[str]) -> list[int]:
        """Tokens of each of the pieces."""
        return list(map(self._counts.__getitem__, parts))


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class _Remembered(dict):
    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, piece):
        value = self.compute(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = value
        return value


def pieces(text: str) -> list[str]:
    """``text`` cut before every sure boundary; joined, the pieces are the text.

    Lines are cut first, so that a word at a line's end is the same piece as
    elsewhere: a line break between two non-spaces is a pre-token of its own.
    """
    if not text:
        return []
    if _ADJACENT_WHITE.search(text):
        return _pieces_of_spaced_text(text)
    out = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        words = line.split(" ")
        if words[0]:
            out.append(words[0])
        out += [" " + w for w in words[1:]]
    return out


# A space between two non-spaces.
_SURE = re.compile(r"(?<=\S) (?=\S)")


def _pieces_of_spaced_text(text: str) -> list[str]:
    cuts = [0, *(m.start() for m in _SURE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if a < b]


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    return Encoder(path)
