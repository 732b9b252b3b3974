"""Words and word n-grams of a batch of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Word separators: space and bytes 9 to 13.  They are ASCII, so words can be found in the UTF-8 bytes.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(int(BASE), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, BACK)):
            grown = np.full(1 << n.bit_length(), b, np.uint64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    return _POWERS[0][:n], _POWERS[1][:n]


def small_groups(texts: list[str | None], most: int = 500_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first index, texts) of groups with at most `most` characters or one text."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or "") + 1
        if k > at and size + n > most:
            yield at, texts[at:k]
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


class Words:
    """The words of some texts: data (bytes), start and end in them, doc (index of the text) and hash."""

    def __init__(self, texts: list[str | None]) -> None:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.bytes = b" ".join(raw) + b" "
        data = np.frombuffer(self.bytes, np.uint8)
        gap = SEPARATOR[data]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        stops = np.cumsum([len(r) + 1 for r in raw])
        self.doc = np.searchsorted(stops, self.start, "right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # where each text's words begin
        forth, back = powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * forth, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start])

    def grams(self, n: int, factor: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the n words from each word on; valid if they lie in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        f = np.uint64(factor)
        g = self.hash[:m].copy()
        for k in range(1, n):
            g *= f
            g += self.hash[k : m + k]
        return mix(g), self.doc[:m] == self.doc[n - 1 :]

    def text(self, words: np.ndarray) -> bytes:
        """The words with these indices, joined by one space."""
        return b" ".join([self.bytes[a:b] for a, b in zip(self.start[words].tolist(), self.end[words].tolist(), strict=True)])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
