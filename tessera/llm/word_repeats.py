"""Operator 9: substring dedup on words by suffix trees that are split by prefixes.

Windows are dealt out by their anchor (see `repeats`). In a task the suffixes that begin with a
window are split by their first words, and groups that exceed the memory of a tree are split by
further words, so prefixes have the length that the group needs. Each group's tree is built
from the top, a level of words at a time: the suffixes of a node are parted by their next word
and nodes with one leaf are given up, for they have no branch below. Nodes that reach the depth
of a window with two leaves or more are repeats; their first leaf in the order of the corpus
stays, the windows of the others are removed.

Defined cases: a null or empty text has no words; a text of fewer words than a window loses
nothing; documents without a doc_id come before all others, each is a document of its own, so one
of their equal texts stays whole at most; rows of one doc_id and different texts are different
documents, in the order of the hashes of their texts; rows of one doc_id and equal texts are one
document given twice, do not remove one another and get the same result. Other columns are not
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
from tessera.llm.winnow import word_cut

LENGTH, GRAM = 20, 6
#: Suffixes of one tree.
TREE = 1 << 18


def word_ends(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    return np.append(0, gaps + 1), np.append(gaps, len(body))


def deep_nodes(symbol: np.ndarray, suffix: np.ndarray, node: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves below nodes of the depth of a window, with the node of each.

    Suffixes of a node agree in `depth` symbols; a tree of too many suffixes is split between nodes.
    """
    while depth < LENGTH and len(suffix):
        if len(suffix) > TREE and node[0] != node[-1]:
            middle = node[len(node) // 2]
            cut = int(np.searchsorted(node, middle, "left" if middle != node[0] else "right"))
            for part in (slice(None, cut), slice(cut, None)):
                yield from deep_nodes(symbol, suffix[part], node[part], depth)
            return
        suffix, node = _level(symbol, suffix, node, depth)
        depth += 1
    if len(suffix):
        yield suffix, node


def _level(symbol: np.ndarray, suffix: np.ndarray, node: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One level further down: nodes parted by the symbol at `depth`, without those of one leaf."""
    after = symbol[suffix + depth]
    order = np.lexsort((after, node))
    suffix, node, after = suffix[order], node[order], after[order]
    begin = np.append(True, (node[1:] != node[:-1]) | (after[1:] != after[:-1]))
    number = np.cumsum(begin) - 1
    many = np.bincount(number) > 1
    keep = many[number]
    return suffix[keep], number[keep]


def later_windows(group: Group) -> tuple[np.ndarray, np.ndarray]:
    """Runs and offsets of the windows that occur before in the group."""
    words = [x.split(b" ") for x in group.body]
    size = np.fromiter(map(len, words), np.int64, len(words))
    names = {x: k for k, x in enumerate(dict.fromkeys(y for x in words for y in x))}
    symbol = np.fromiter((names[y] for x in words for y in x), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    run = np.repeat(np.arange(len(words)), group.n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(group.n) - group.n, group.n)
    found = []
    for leaf, node in deep_nodes(symbol, begin[run] + offset, np.zeros(len(run), np.int64), 0):
        # Runs are in the order of the corpus, so the least leaf of a node is its first place.
        order = np.lexsort((leaf, node))
        leaf, node = leaf[order], node[order]
        found.append(leaf[np.append(False, node[1:] == node[:-1])])
    leaf = np.concatenate(found) if found else np.empty(0, np.int64)
    run = np.searchsorted(begin, leaf, "right") - 1
    return run, leaf - begin[run]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, spans of removed words, and the words kept."""
    rows = keyed(docs, doc_id, text)
    windows = repeated_windows(rows, word_cut, LENGTH, GRAM, later_windows, word_ends, later=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, count, removed, spans, kept = [], [], [], [], []
            for id_, text, windows in zip(*(batch.column(x).to_pylist() for x in ("_id", "_text", "_windows"))):
                words = text.encode().split()
                gone = covered(windows, LENGTH)
                left, at = [], 0
                for start, stop in gone:
                    left += words[at:start]
                    at = stop
                left += words[at:]
                ids.append(None if id_ == NO_ID else id_)
                count.append(len(words))
                removed.append(len(words) - len(left))
                spans.append([{"start": a, "stop": b} for a, b in gone])
                kept.append(b" ".join(left).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    schema = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"
    return with_windows(rows, windows).select("_id", "_text", "_windows").mapInArrow(run, schema)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return without_repeats(docs, doc_id, text).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
