"""Terms of texts, for the operators that count or search them: maximal runs of bytes that are no delimiters, A-Z lower-cased.

Delimiters are ASCII, so a run of bytes is a run of characters. A long text comes in slices that end at delimiters, so what is
held at a time doesn't grow with it (but for a single term, which is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20


class Numbers(dict):
    """Numbers new keys from 0 on."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Terms:
    """Cuts texts. delimiters: ASCII bytes; white space has to be among them."""

    def __init__(self, delimiters: bytes):
        self.table = bytes(32 if b in delimiters else b + 32 if 65 <= b <= 90 else b for b in range(256))

    def __call__(self, text: str | None) -> Iterator[list[bytes]]:
        """The terms in order, a list for each slice of the text."""
        raw = (text or "").encode().translate(self.table)
        at = 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
            if found := raw[at:end].split():
                yield found
            at = end


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows of the sorted columns begins."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)
