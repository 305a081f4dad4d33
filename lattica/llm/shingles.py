"""Word shingles of many texts at once, as 64-bit hashes, in NumPy.

Words are runs of anything but ASCII white space (bytes 9 to 13 and 32), with A-Z lower-cased. Both are byte-wise
rules, so texts are handled as UTF-8 and never decoded again.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Texts are hashed in blocks of about this many bytes, whatever the batch, so memory doesn't follow the text length.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


class Shingler:
    """Holds the tables; one per task."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.letter = _stream(11, 256)
        self.place = _stream(23, width) | np.uint64(1)
        self.short = _stream(37, width)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and the number of words of each."""
        block = b" ".join(texts) + b" "
        raw = np.frombuffer(block.lower(), np.uint8)
        self._powers(len(raw) + 1)
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letter[raw] * self.power[: len(raw)], out=total[1:])
        hashed = _mix((total[end] - total[start]) * self.inverse[start])
        stops = np.cumsum([len(t) + 1 for t in texts])
        return hashed, np.diff(np.searchsorted(start, stops), prepend=0)

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of all texts, in order and with repeats, and the number of each text's; 0 for no words."""
        w, words = self.words(texts)
        k = self.width
        counts = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
        if not len(w):
            return w, counts
        padded = np.concatenate([w, np.zeros(k, np.uint64)])
        every = np.zeros(len(w), np.uint64)
        for j in range(k):
            every += padded[j : j + len(w)] * self.place[j]
        every = _mix(every)
        first = np.cumsum(words) - words
        for i in np.flatnonzero((words > 0) & (words < k)):
            n = int(words[i])
            own = (w[first[i] : first[i] + n] * self.place[:n]).sum(dtype=np.uint64, keepdims=True) + self.short[n - 1]
            every[first[i]] = _mix(own)[0]
        at = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return every[at], counts

    def each(self, texts: list[str | None]):
        """Blocks of (index of the first text, shingle hashes, counts) over all texts. A null is an empty text."""
        held: list[bytes] = []
        size = first = 0
        for i, t in enumerate(texts):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if held and size + len(raw) > BLOCK_BYTES:
                yield first, *self.block(held)
                held, size, first = [], 0, i
            held.append(raw)
            size += len(raw) + 1
        if held:
            yield first, *self.block(held)
