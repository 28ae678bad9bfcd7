"""Operator 5: byte-level BPE encoding and decoding by padded matrices of ids.

Pieces of text that are not themselves tokens are put into matrices of rows of like length.
In each round every row merges its leftmost pair of lowest rank: ranks come from a hash table
of all pairs whose joined bytes are a token, the row is closed up behind the merge, and rows
without a pair leave the matrix. Rows of more than LONG bytes, where a matrix would cost the
square of the length, take their merges in the same order from a heap.

Defined cases: a null text is the empty text, with no ids and the digest of no bytes; rows are
kept as given, repeated ones too, and a null doc_id stays null. Columns other than the two
named are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessera.llm.pairs_table import NONE, PairTable
from tessera.llm.pieces import PieceCoder, gather, text_groups
from tessera.llm.shared import in_small_batches

LONG = 256


class ByteBpe:
    """A vocabulary of byte strings with ranks: one line each, base64 and rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) }
        self.width = max(self.ranks.values()) + 1
        tokens = [b""] * self.width
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes_flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.bytes_size = np.fromiter(map(len, tokens), np.int64, self.width)
        self.bytes_begin = np.cumsum(self.bytes_size) - self.bytes_size
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], np.int32)
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.width + right)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32), self.width)
        self.pair_rank = dict(zip(keys, values))

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, flat, and how many each has."""
        raw = [piece.encode() for piece in pieces]
        found: list[np.ndarray | None] = [None] * len(raw)
        rest = []
        for place, piece in enumerate(raw):
            rank = self.ranks.get(piece)
            if rank is None:
                rest.append(place)
            else:
                found[place] = np.array([rank], np.int32)
        size = np.fromiter((len(raw[x]) for x in rest), np.int64, len(rest))
        order = np.argsort(size, kind="stable")
        at = 0
        while at < len(order):
            longest = int(size[order[at]])
            longest += max(2, longest // 4)
            end = int(np.searchsorted(size[order], longest, "right"))
            end = min(end, at + max(1, 4_000_000 // longest))
            rows = [rest[x] for x in order[at:end]]
            if longest > LONG:
                for x in rows:
                    found[x] = self._merge_long(raw[x])
            else:
                for x, ids in zip(rows, self._merge_rows([raw[x] for x in rows])):
                    found[x] = ids
            at = end
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate(found) if found else np.empty(0, np.int32)), sizes

    def _merge_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        length = np.fromiter(map(len, rows), np.int64, len(rows))
        wide = int(length.max())
        ids = np.full((len(rows), wide + 1), -1, np.int32)
        inside = np.arange(wide + 1) < length[:, None]
        ids[inside] = self.single[np.frombuffer(b"".join(rows), np.uint8)]
        rank = np.full((len(rows), wide), NONE, np.int32)
        both = inside[:, 1:]
        rank[both] = self.pairs.find(ids[:, :-1][both], ids[:, 1:][both])
        done: list[np.ndarray] = [np.empty(0, np.int32)] * len(rows)
        live = np.arange(len(rows))
        while live.size:
            at = rank.argmin(axis=1)
            row = np.arange(len(live))
            best = rank[row, at]
            over = best == NONE
            if over.any():
                for x in np.flatnonzero(over):
                    done[live[x]] = ids[x, : length[x]].copy()
                keep = ~over
                live, ids, rank, length, at, best = live[keep], ids[keep], rank[keep], length[keep], at[keep], best[keep]
                if not live.size:
                    break
                wide = int(length.max())
                ids, rank = ids[:, : wide + 1], rank[:, :wide]
                row = np.arange(len(live))
            ids[row, at] = best
            columns = np.arange(wide + 1)
            source = columns + (columns > at[:, None])
            source[:, -1] = wide
            ids = np.take_along_axis(ids, source, axis=1)
            length -= 1
            ids[row, length] = -1
            rank = np.take_along_axis(rank, np.minimum(source[:, :-1], wide - 1), axis=1)
            rank[row, length - 1] = NONE
            for shift in (-1, 0):
                place = at + shift
                ok = np.flatnonzero((place >= 0) & (place + 1 < length))
                rank[ok, place[ok]] = self.pairs.find(ids[ok, place[ok]], ids[ok, place[ok] + 1])
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = [int(self.single[x]) for x in piece]
        size, get, width = len(ids), self.pair_rank.get, self.width
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, x, ids[x], ids[x + 1]) for x in range(size - 1) if (r := get(ids[x] * width + ids[x + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, x, left, right = heapq.heappop(heap)
            y = after[x]
            if y >= size or ids[x] != left or ids[y] != right:
                continue
            ids[x], ids[y] = rank, -1
            after[x] = z = after[y]
            if z < size:
                before[z] = x
                if (r := get(rank * width + ids[z])) is not None:
                    heapq.heappush(heap, (r, x, rank, ids[z]))
            w = before[x]
            if w >= 0 and (r := get(ids[w] * width + rank)) is not None:
                heapq.heappush(heap, (r, w, ids[w], rank))
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return gather(self.bytes_flat, self.bytes_begin[ids], self.bytes_size[ids]).tobytes()


_LOADED: dict[int, tuple[ByteBpe, PieceCoder]] = {}


def loaded(lines: bytes) -> tuple[ByteBpe, PieceCoder]:
    """The vocabulary and its coder, built once in each worker."""
    key = hash(lines)
    if key not in _LOADED:
        bpe = ByteBpe(lines)
        _LOADED[key] = bpe, PieceCoder(bpe.encode_pieces)
    return _LOADED[key]


def read_fixed(path: str) -> bytes:
    """A vocabulary file; its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids, as little-endian unsigned 32-bit integers, and the bytes they decode to."""
    lines = docs.sparkSession.sparkContext.broadcast(read_fixed(ranks_path))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, coder = loaded(lines.value)
        for batch in batches:
            at = 0
            for group in text_groups(batch.column(1).to_pylist()):
                ids = coder.ids(group)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(group)),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                        pa.array([bpe.decode(x) for x in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                at += len(group)

    return in_small_batches(docs).select(docs[doc_id], docs[text]).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of what they decode to."""
    return encode_documents(docs, ranks_path, doc_id, text).selectExpr(
        "doc_id", "n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256"
    )
