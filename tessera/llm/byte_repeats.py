"""Operator 1: exact substring dedup on bytes, by intervals of a suffix array.

Windows are dealt out by their anchor (see `repeats`). In a task the runs that meet are one
text with a separator after each. From its suffix array comes the Burrows-Wheeler transform,
and from that, breadth first, the common prefixes of neighbouring suffixes: an interval of
suffixes that begin with a string is extended backwards by every byte before it at once, which
gives the intervals of the strings one byte longer; where such an interval ends, and no shorter
string told its end before, the common prefix there has the length reached. Values appear in
rising order, and the search stops at the length of a window: what has no value by then has a
common prefix of a window at least, and both its suffixes begin with a repeated window.

Defined cases: a null text is the empty text; a text shorter than a window loses nothing; rows
of one doc_id and different texts are different documents; rows of one doc_id and equal texts are
one document given twice: they do not remove one another and get the same result; rows without a
doc_id are different documents, so equal ones remove one another. Characters of which some bytes are removed are cut; kept bytes are returned as binary. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeats import Group, covered, keyed, repeated_windows, with_windows
from tessera.llm.shared import NO_ID
from tessera.llm.winnow import byte_cut

LENGTH, GRAM = 200, 64


def byte_ends(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(body)), np.arange(1, len(body) + 1)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `text` in the order of their first `depth` symbols at least, by doubling."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    known = max(1, 63 // bits)
    packed = np.zeros(n + known, np.uint64)
    packed[:n] = text
    code = np.zeros(n, np.uint64)
    for k in range(known):
        code = (code << np.uint64(bits)) | packed[k : n + k]
    order = np.argsort(code, kind="stable")
    rank = np.zeros(n, np.int64)
    sorted_ = code[order]
    while True:
        new = np.cumsum(np.append(True, sorted_[1:] != sorted_[:-1]))
        rank[order] = new
        if known >= depth or new[-1] == n:
            return order
        # Only suffixes whose rank is shared are sorted again, inside the place they have.
        shared = np.bincount(new)[new] > 1
        place = np.flatnonzero(shared)
        who = order[place]
        after = np.where(who + known < n, rank[np.minimum(who + known, n - 1)], 0)
        key = (rank[who].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        again = np.argsort(key, kind="stable")
        order[place] = who[again]
        sorted_ = np.zeros(n, np.uint64)
        sorted_[:] = new.astype(np.uint64) << np.uint64(32)
        sorted_[place] = key[again]
        known *= 2


def bounded_prefixes(text: np.ndarray, order: np.ndarray, stop: int) -> np.ndarray:
    """Whether the suffixes at i - 1 and i of the order agree in `stop` symbols; symbol 0 agrees with nothing.

    Breadth-first extension of intervals: values below `stop` are found in rising order.
    """
    n = len(text)
    last = text[order - 1]  # the symbol before each suffix; the text ends with a separator
    count = np.bincount(last, minlength=int(text.max()) + 1)
    to = np.empty(n, np.int64)
    to[np.argsort(last, kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    # Separators never agree: each suffix that begins with one is an interval of its own.
    known[: count[0] + 1] = True
    low, high = np.array([0]), np.array([n])
    for length in range(stop):
        size = high - low
        one = size == 1
        single = low[one]
        wide_low, wide_size = low[~one], size[~one]
        total = int(wide_size.sum())
        ends = np.cumsum(wide_size)
        inside = np.arange(total) + np.repeat(wide_low - (ends - wide_size), wide_size)
        owner = np.repeat(np.arange(len(wide_low)), wide_size)
        keep = last[inside] != 0
        inside, owner = inside[keep], owner[keep]
        target = to[inside]
        by = np.argsort(target)
        target, owner, byte = target[by], owner[by], last[inside[by]]
        begin = np.append(True, (target[1:] != target[:-1] + 1) | (owner[1:] != owner[:-1]) | (byte[1:] != byte[:-1])) if len(target) else np.zeros(0, bool)
        first = np.flatnonzero(begin)
        new_low = target[first]
        new_high = target[np.append(first[1:], len(target)) - 1] + 1 if len(target) else new_low
        single = single[last[single] != 0]
        new_low, new_high = np.concatenate([new_low, to[single]]), np.concatenate([new_high, to[single] + 1])
        fresh = ~known[new_high]
        low, high = new_low[fresh], new_high[fresh]
        known[high] = True
        if length == 0:
            low, high = np.append(np.arange(count[0]), low), np.append(np.arange(1, count[0] + 1), high)
        if not len(low):
            break
    return ~known[:n]


def repeated(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Runs and offsets of the windows that occur twice in the group, of runs that are alone of their sort."""
    size = np.fromiter(map(len, group.body), np.int64, len(group.body)) + 1
    begin = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), np.uint16)
    inner = np.ones(len(text), bool)
    inner[begin + size - 1] = False
    text[inner] = np.frombuffer(b"".join(group.body), np.uint8).astype(np.uint16) + 1
    order = suffix_array(text, LENGTH)
    same = bounded_prefixes(text, order, LENGTH)
    twice = same | np.append(same[1:], False)
    place = np.sort(order[twice])
    run = np.searchsorted(begin, place, "right") - 1
    offset = place - begin[run]
    keep = (offset < group.n[run]) & group.alone[run]
    return run[keep], offset[keep]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, spans of removed bytes, and the bytes kept."""
    rows = keyed(docs, doc_id, text)
    windows = repeated_windows(rows, byte_cut, LENGTH, GRAM, repeated, byte_ends, later=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size, spans, kept = [], [], [], []
            for id_, text, windows in zip(*(batch.column(x).to_pylist() for x in ("_id", "_text", "_windows"))):
                raw = text.encode()
                gone = covered(windows, LENGTH)
                left, at = [], 0
                for start, stop in gone:
                    left.append(raw[at:start])
                    at = stop
                ids.append(None if id_ == NO_ID else id_)
                size.append(len(raw))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(b"".join([*left, raw[at:]]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )

    return with_windows(rows, windows).select("_id", "_text", "_windows").mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return without_repeats(docs, doc_id, text).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
