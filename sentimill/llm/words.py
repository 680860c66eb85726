"""Hashes of the words of many texts at once, with numpy inside a task.

Words are runs of bytes other than space and 0x09-0x0D; A-Z count as a-z. A word's
hash is a polynomial in its bytes modulo 2**64, taken from running sums over a block of
text, then mixed: a few array operations per block and none per word.
"""

from collections.abc import Iterator

import numpy as np

# Bytes hashed at once; a longer word makes its block longer.
BLOCK = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64) + _U(1)
_LOWER[0x41:0x5B] += _U(0x20)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers, another one for each seed."""
    x = x + _U((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and its inverse, as many as the longest block so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(n, BLOCK + 1), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _block_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a block that ends with white space."""
    white = _WHITE[data]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def text_blocks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts in blocks of about ``BLOCK`` bytes, with the index of the first."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode()
        if block and size + len(data) > BLOCK:
            yield first, block
            first, block, size = i, [], 0
        block.append(data)
        size += len(data)
    if block:
        yield first, block


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one entry more than texts)."""
    if len(texts) == 1 and len(texts[0]) > 2 * BLOCK:
        hashes = np.concatenate([_block_hashes(part)[0] for part in _parts(texts[0])])
        return hashes, np.array([0, len(hashes)])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    hashes, starts = _block_hashes(data)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def _parts(text: bytes) -> Iterator[np.ndarray]:
    data = np.frombuffer(text + b"\n", np.uint8)
    start = 0
    while start < len(data):
        end = start + BLOCK
        while end < len(data) and not _WHITE[data[end - 1]]:
            after = np.flatnonzero(_WHITE[data[end : end + BLOCK]])
            end = end + int(after[0]) + 1 if len(after) else end + BLOCK
        yield data[start : min(end, len(data))]
        start = end


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of all its words when there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = words[:n]
    for i in range(1, size):
        h = h * _U(_BASE) + words[i : i + n]
    return mixed(h, size)
