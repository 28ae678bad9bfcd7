"""Cutting text into the pieces inside which byte-level BPE merges, on arrays of code points.

The pieces are those of the pattern `public_tokenizers.PATTERN`: contractions, then runs of
letters, of numbers or of other signs with at most one blank before, then white space. A run
ends where the class of the code point changes, so all ends of a text are found by comparing
neighbours; only contractions and the last blank of a run need a second look.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space by Unicode's property, and the contractions of the pattern.
WHITE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Letters and numbers of Unicode 16, which the tokenizer libraries know and
#: Python's tables of Unicode 15 do not.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    found = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind == "L":
            found[code] = LETTER
        elif kind == "N":
            found[code] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            found[first : last + 1] = kind
    found[list(WHITE)] = SPACE
    return found


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """For each code point, whether a piece starts there."""
    kind = classes()[codes]
    start = np.empty(len(codes), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    white = kind == SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:])
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    quote = np.flatnonzero(codes == 39)
    quote = quote[start[quote]]
    if quote.size:
        padded = np.append(codes[: quote[-1] + 4], np.zeros(4, codes.dtype))
        first, second = padded[quote + 1], padded[quote + 2]
        length = np.where(np.isin(first, [ord(x) for x in SHORT]), 2, 0)
        for a, b in LONG:
            length[(first == ord(a)) & (second == ord(b))] = 3
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        after = quote + length
        after = after[after < len(codes)]
        start[after[kind[after] == LETTER]] = True
    return start


def pieces(text: str) -> list[str]:
    """The pieces of a text, in order."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    begin = np.flatnonzero(piece_starts(codes)).tolist()
    return [text[a:b] for a, b in zip(begin, [*begin[1:], len(text)])]


class PieceIndex(dict):
    """Numbers pieces as they are first seen."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number

    def numbers(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


class PieceCoder:
    """Ids of texts by way of their distinct pieces.

    `encode` gives the ids of new pieces as one flat array with the length of each. What was
    seen is kept across batches of a task and across tasks of a worker, up to `most` pieces;
    then all is forgotten and found anew, so memory is bounded and results never change.
    """

    def __init__(self, encode, most: int = 400_000):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.index, self.seen = PieceIndex(), 0
        self.flat, self.size, self.begin = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self) -> None:
        new = list(self.index)[self.seen :] if self.seen else list(self.index)
        if new:
            flat, size = self.encode(new)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.size = np.concatenate([self.size, size])
            self.seen += len(new)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > self.most:
            self._forget()
        numbers = [self.index.numbers(pieces(text)) for text in texts]
        self._learn()
        return [gather(self.flat, self.begin[n], self.size[n]) for n in numbers]

    def counts(self, texts: list[str]) -> list[int]:
        """How many ids each text has."""
        if len(self.index) > self.most:
            self._forget()
        numbers = [self.index.numbers(pieces(text)) for text in texts]
        self._learn()
        return [int(self.size[n].sum()) for n in numbers]


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of flat that begin and size name, one after the other."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(begin - (ends - size), size)]


def text_groups(texts: list[str | None], most: int = 1 << 20):
    """Runs of texts of about `most` characters each; null is the empty text."""
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
