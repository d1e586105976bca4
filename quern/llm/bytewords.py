"""Words and shingles of many texts at once, over their UTF-8 bytes with numpy.

Every word is hashed to 64 bits by a polynomial over random byte codes, every window of words by a
weighted sum of word hashes; both pass a full-avalanche mix. A batch is worked through in slices of a
few MB, so memory doesn't depend on the batch; only one text longer than that stands alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_RNG = np.random.default_rng(20240611)
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_WEIGHTS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of words that white space parts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Digits, lower-case letters and all of U+0080 and above.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > 4 * SLICE_BYTES:
        return _grown(n)
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        _POWERS["up"], _POWERS["down"] = _grown(max(n, SLICE_BYTES + 1024))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _STEP), np.full(n, _BACK)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of each row and the end) of runs of rows of about SLICE_BYTES; null is empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        whole = chunk.cast(pa.large_string()) if chunk.null_count == 0 else chunk.cast(pa.large_string()).fill_null("")
        if not len(whole):
            continue
        _, off, data = whole.buffers()
        off = np.frombuffer(off, np.int64)[whole.offset : whole.offset + len(whole) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(whole):
            last = max(first + 1, int(np.searchsorted(off, off[first] + SLICE_BYTES, "right")) - 1)
            yield first, data[off[first] : off[last]], off[first : last + 1] - off[first]
            first = last


class Words:
    """The words of the texts of one slice: text (row in the slice), start, end (bytes) and hash of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> None:
        self.texts, self.data = len(off) - 1, FOLD[data]
        mask = inside[self.data]
        before, after = np.zeros_like(mask), np.zeros_like(mask)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        at = off[:-1][off[:-1] < len(data)]
        before[at] = False
        after[at[at > 0] - 1] = False
        self.start, self.end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
        self.bounds = np.searchsorted(self.start, off)  # of the words of each text
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(self.texts), self.counts)
        up, self._down = _powers(len(data))
        self._total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[self.data] * up, out=self._total[1:])
        self.hash = self.parts(self.start, self.end)

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of bytes, none of them across texts."""
        if not len(start):
            return np.zeros(0, np.uint64)
        return mix((self._total[end] - self._total[start]) * self._down[np.minimum(start, len(self._down) - 1)])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words inside one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += self.hash[j : j + n] * _WEIGHTS[j]
        first = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return first, mix(total[first] + np.uint64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash), sorted by both and distinct; a text of fewer than k words, but not none, is one shingle."""
        first, value = self.windows(k)
        text = self.text[first]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            sums = np.array([(self.hash[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a) for a, b in zip(self.bounds[short], self.bounds[short + 1], strict=True)], np.uint64)
            text, value = np.concatenate([text, short]), np.concatenate([value, mix(sums)])
            order = np.argsort(text, kind="stable")
            text, value = text[order], value[order]
        bounds = np.searchsorted(text, np.arange(self.texts + 1))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            value[a:b].sort()
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        return text[fresh], value[fresh]


def sums(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """Wrapping sums of value for each text; text is sorted."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    bounds = np.searchsorted(text, np.arange(texts + 1))
    return total[bounds[1:]] - total[bounds[:-1]]
