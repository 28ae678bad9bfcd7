"""Anchors of windows: which part of a window all its copies agree on.

A text is a row of units (bytes, words or lines). Each window of `length` units has as its
anchor the leftmost of its `grams` whose hash is least; equal windows have equal anchors at the
same place. Neighbouring windows mostly share an anchor, so windows are dealt out in runs: the
units under a run are sent once for all its windows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(values: np.ndarray) -> np.ndarray:
    """The 64-bit values with all bits stirred."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(32))
        values = values * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
    return values


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(ODD), -1, 2**64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, ODD)]))
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, inverse)]))
    return up, down


class Sums:
    """Hashes of any slices of a row of values, from one pass of prefix sums."""

    def __init__(self, values: np.ndarray):
        self.up, self.down = _powers(max(16, int(len(values) + 1).bit_length()))
        with np.errstate(over="ignore"):
            self.total = np.concatenate([[np.uint64(0)], np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.up[: len(values)])])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[end] - self.total[begin]) * self.down[begin])

    def grams(self, size: int) -> np.ndarray:
        """The hashes of all slices of `size` values."""
        count = len(self.total) - size
        with np.errstate(over="ignore"):
            return mixed((self.total[size:] - self.total[:count]) * self.down[:count])


def runs(grams: np.ndarray, windows: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of windows with one anchor: first window, number of windows, hash of the anchor.

    Window i holds the grams i to i + span - 1.
    """
    place_bits = np.uint64(max(1, int(len(grams)).bit_length()))
    low = (np.uint64(1) << place_bits) - np.uint64(1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    if span > 1:
        blocks = -(-(windows + span - 1) // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        padded = padded.reshape(blocks, span)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        key = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    anchor = (key[:windows] & low).astype(np.int64)
    begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    return begin, np.diff(np.append(begin, windows)), grams[anchor[begin]]


class Cut:
    """A text as units: its bytes, and where each unit begins and ends in them."""

    def __init__(self, body: bytes, begin: np.ndarray | None = None, end: np.ndarray | None = None, values: np.ndarray | None = None):
        self.body = body
        self.begin = begin
        self.end = end
        self.values = np.frombuffer(body, np.uint8) if values is None else values

    def __len__(self) -> int:
        return len(self.values)

    def part(self, start: int, stop: int) -> bytes:
        if self.begin is None:
            return self.body[start:stop]
        return self.body[self.begin[start] : self.end[stop - 1]]

    def segments(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows: first window, number of windows, hash of the anchor, hash of all units under the run."""
        windows = len(self) - length + 1
        if windows <= 0:
            none = np.empty(0, np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64)
        begin, count, anchor = runs(Sums(self.values).grams(gram), windows, length - gram + 1)
        last = begin + count + length - 1
        low, high = (begin, last) if self.begin is None else (self.begin[begin], self.end[last - 1])
        body, digest = self.body, xxhash.xxh3_64_intdigest
        whole = np.array([digest(body[a:b]) for a, b in zip(low.tolist(), high.tolist())], np.uint64)
        return begin, count, anchor, whole


def byte_cut(text: str) -> Cut:
    return Cut(text.encode())


def word_cut(text: str) -> Cut:
    """Words between the six signs of ASCII white space, written with one blank between them."""
    body = b" ".join(text.encode().split())
    raw = np.frombuffer(body, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    if not len(raw):
        return Cut(body, gaps, gaps, np.empty(0, np.uint64))
    begin, end = np.append(0, gaps + 1), np.append(gaps, len(raw))
    return Cut(body, begin, end, Sums(raw).of(begin, end))
