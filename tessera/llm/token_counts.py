"""Operator 6: token counts by merging ragged arrays, rank by rank.

All new pieces of a batch lie in one flat array of symbols. In each round every piece finds
its pair of lowest rank and merges all its places at once, from the left and without overlap;
pieces without a pair have their count. Merging all places at once is right because a merge
makes only symbols that later ranks use: each merge comes after those that made its parts.

Defined cases: a null text is the empty text, with 0 bytes and 0 tokens; a special string in a
text is one token, as the library has it; rows are kept as given, repeated ones too, and a null
doc_id stays null. Columns other than the two named are not looked at, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessera.llm.byte_bpe import read_fixed
from tessera.llm.pairs_table import NONE, PairTable
from tessera.llm.pieces import PieceCoder, text_groups
from tessera.llm.shared import in_small_batches


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it shows, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in shown]
    return {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}


class RankedMerges:
    """A vocabulary with ordered merges, from the text of its file."""

    def __init__(self, text: bytes):
        content = json.loads(text)
        vocabulary = content["model"]["vocab"]
        self.special = [x["content"] for x in content["added_tokens"] if x["special"]]
        self.single = np.array([vocabulary[x] for _, x in sorted(byte_letters().items())], np.int32)
        width = max(vocabulary.values()) + 1
        merges = [x if isinstance(x, list) else x.split(" ") for x in content["model"]["merges"]]
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        born = np.full(width, -1, np.int64)
        born[self.made] = np.arange(len(merges))
        if (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before those that make its parts")
        self.pairs = PairTable(left * width + right, np.arange(len(merges), dtype=np.int32), width)
        self.coder = PieceCoder(self.counted)

    def counted(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are left of each piece; the flat ids are not kept."""
        raw = [piece.encode() for piece in pieces]
        size = np.zeros(len(raw), np.int64)
        at = 0
        while at < len(raw):
            end, total = at, 0
            while end < len(raw) and total < 2_000_000:
                total += len(raw[end])
                end += 1
            size[at:end] = self._merge(raw[at:end])
            at = end
        return np.zeros(0, np.int32), size

    def _merge(self, raw: list[bytes]) -> np.ndarray:
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        symbol = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), length)
        left = length.copy()
        while symbol.size:
            rank = np.full(len(symbol), NONE, np.int32)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inner] = self.pairs.find(symbol[inner], symbol[inner + 1])
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(rank, begin)
            each = np.repeat(lowest, np.diff(np.append(begin, len(symbol))))
            live = each != NONE
            place = np.flatnonzero((rank == each) & live)
            if not place.size:
                break
            first = np.flatnonzero(np.append(True, np.diff(place) != 1))
            run = np.repeat(place[first], np.diff(np.append(first, len(place))))
            place = place[(place - run) % 2 == 0]
            symbol[place] = self.made[rank[place]]
            gone = np.zeros(len(symbol), bool)
            gone[place + 1] = True
            left -= np.bincount(owner[place], minlength=len(left))
            keep = live & ~gone
            symbol, owner = symbol[keep], owner[keep]
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, whose, extra = [], [], [0] * len(texts)
        for place, text in enumerate(texts):
            cut = [text]
            for special in self.special:
                if special in text:
                    cut = [y for x in cut for y in x.split(special)]
            extra[place] = len(cut) - 1
            parts += cut
            whose += [place] * len(cut)
        for place, number in zip(whose, self.coder.counts(parts)):
            extra[place] += number
        return extra


_LOADED: dict[int, RankedMerges] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of each document, and whether it has more than `limit` tokens."""
    content = docs.sparkSession.sparkContext.broadcast(read_fixed(vocabulary_path))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(content.value)
        if key not in _LOADED:
            _LOADED[key] = RankedMerges(content.value)
        for batch in batches:
            sizes, counts = [], []
            for group in text_groups(batch.column(1).to_pylist()):
                sizes += [len(x.encode()) for x in group]
                counts += _LOADED[key].count(group)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([x > limit for x in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return in_small_batches(docs).select(docs[doc_id], docs[text]).mapInArrow(run, schema)
