"""Operator 7: near duplicates by SimHash, with links found by meet-in-the-middle balls.

Every fingerprint stands for all variants within half the radius of it; two fingerprints within
the radius share a variant, and two that share one are within the radius. Variants are dealt
out by their leading bits. Since most variants of a fingerprint have the same leading bits, it
is sent once to each prefix near its own, and its variants there are written out only in the
task that has that prefix. Prefixes with more than HOT fingerprints are dealt anew by longer
prefixes, so a dense group of near copies is spread. All fingerprints that share a variant are
linked to the least of them, never to each other; a task passes on one link for each
fingerprint that it found linked. Components come from those links.

Defined cases: a null text has no words, and texts without words have fingerprint zero, linked
like any other; fewer words than a shingle are one shingle; equal texts have equal
fingerprints and so one component; rows are kept as given, repeated ones too; a null doc_id is
never a component's id unless no document of the component has one, then the id is null.
Columns other than the two named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.shared import NO_ID, in_small_batches, settle

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints that one prefix may have before it is dealt anew, and bits added then.
HOT, MORE_BITS = 1024, 6
#: Variants that a task writes out at once.
AT_ONCE = 1_500_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.cumsum(size + 1) - size - 1
    end = (begin + size)[min(WORDS, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin.tolist(), end)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, a hash of the text, and the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("h", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    return in_small_batches(docs).select(docs[doc_id], F.xxhash64(F.coalesce(docs[text], F.lit(""))), docs[text]).mapInArrow(run, schema)


@cache
def flips(bits: int, most: int) -> np.ndarray:
    """All masks over the lowest `bits` bits with at most `most` ones."""
    masks = [np.zeros(1, np.uint64)]
    single = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    last, top = masks[0], np.full(1, -1)
    for _ in range(most):
        pairs = [(last[top < x] | single[x], x) for x in range(bits)]
        last, top = np.concatenate([m for m, _ in pairs]), np.concatenate([np.full(len(m), x) for m, x in pairs])
        masks.append(last)
    return np.concatenate(masks)


def _deal(old: int, new: int):
    """Rows (prefix of `old` bits, fp) to rows (prefix of `new` bits, fp), for every prefix that some variant has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(0).to_numpy().view(np.uint64)
            fp = batch.column(1).to_numpy().view(np.uint64)
            for at in range(0, len(fp), 20_000):
                p, f = prefix[at : at + 20_000], fp[at : at + 20_000]
                spent = np.bitwise_count(p ^ (f >> np.uint64(64 - old))) if old else np.zeros(len(f), np.uint8)
                own = (f >> np.uint64(64 - new)) & np.uint64((1 << (new - old)) - 1)
                for used in range(RADIUS // 2 + 1):
                    some = spent == used
                    masks = flips(new - old, RADIUS // 2 - used)
                    made = (p[some, None] << np.uint64(new - old)) | (own[some, None] ^ masks)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made.ravel().view(np.int64)), pa.array(np.repeat(f[some], len(masks)).view(np.int64))], names=["prefix", "fp"]
                    )

    return run


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The least node that each of `size` nodes reaches over links a, b."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = np.minimum(root, root[root])
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


def _links(prefix: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, least fp reached here) among the fingerprints dealt to some prefixes."""
    names, who = np.unique(fp, return_inverse=True)
    spent = np.bitwise_count(prefix ^ (fp >> np.uint64(64 - bits)))
    low = fp & np.uint64((1 << (64 - bits)) - 1)
    base = (prefix << np.uint64(64 - bits)) | low
    made, owner = [], []
    for used in range(RADIUS // 2 + 1):
        some = spent == used
        if some.any():
            masks = flips(64 - bits, RADIUS // 2 - used)
            made.append((base[some, None] ^ masks).ravel())
            owner.append(np.repeat(who[some].astype(np.int32), len(masks)))
    made, owner = np.concatenate(made), np.concatenate(owner)
    again = np.sort(made)
    again = again[1:][again[1:] == again[:-1]]
    if not again.size:
        return names[:0], names[:0]
    shift, spread = np.uint64(40), np.uint64(0x9E3779B97F4A7C15)
    filter_ = np.zeros(1 << 24, bool)
    with np.errstate(over="ignore"):
        filter_[(again * spread) >> shift] = True
        some = filter_[(made * spread) >> shift]
    made, owner = made[some], owner[some]
    order = np.lexsort((owner, made))
    made, owner = made[order], owner[order]
    begin = np.append(True, made[1:] != made[:-1])
    first = owner[np.flatnonzero(begin)][np.cumsum(begin) - 1]
    pair = np.unique((first.astype(np.int64) * len(names) + owner)[first != owner])
    root = _forest(pair // len(names), pair % len(names), len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _meet(bits: int):
    """Links among rows (prefix, fp) that come sorted by prefix."""
    each = len(flips(64 - bits, RADIUS // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            prefix, fp = (np.concatenate(x) for x in zip(*held))
            end = len(prefix) if last else int(np.searchsorted(prefix, prefix[-1]))
            cut = [0, *(np.flatnonzero(np.diff(prefix[:end])) + 1).tolist(), end] if end else [0]
            at = 0
            for to, after in zip(cut[1:], [*cut[2:], None]):
                if after is None or (after - at) * each > AT_ONCE:
                    a, b = _links(prefix[at:to].view(np.uint64), fp[at:to].view(np.uint64), bits)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
                    at = to
            held, size = ([(prefix[end:], fp[end:])], len(prefix) - end) if end < len(prefix) else ([], 0)

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(held[-1][0])
            if size * each > 4 * AT_ONCE:
                yield from flush(False)
        if held:
            yield from flush(True)

    return run


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within the radius, a spanning part of them."""
    spark = fps.sparkSession
    count = fps.count()
    bits = max(8, int(np.ceil(np.log2(max(1, count) / 128))))
    old, rows = 0, fps.selectExpr("0L AS prefix", "fp")
    found: DataFrame | None = None
    while True:
        dealt = rows.mapInArrow(_deal(old, bits), "prefix long, fp long")
        hot = settle(dealt.groupBy("prefix").count().where(F.col("count") > HOT).select("prefix")) if bits + MORE_BITS <= 60 else None
        some = hot is not None and not hot.isEmpty()
        calm = dealt.join(hot, "prefix", "left_anti") if some else dealt
        met = calm.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_meet(bits), "a long, b long")
        found = met if found is None else found.union(met)
        if not some:
            return found
        rows, old, bits = settle(dealt.join(hot, "prefix", "left_semi")), bits, bits + MORE_BITS


def labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and for each fingerprint (fp) the first row of its component."""
    fp = settle(fingerprints(docs, doc_id, text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    least = settle(fp.groupBy("fp").agg(first))
    roots = settle(components(links(least.select("fp"))).selectExpr("a AS fp", "b AS root"))
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = named.groupBy("root").agg(F.min("least").alias("first"))
    return fp, named.select("fp", "root").join(own, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    fp, first = labelled(docs, doc_id, text)
    return fp.join(first, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs, as it is, for each component: that of least doc_id, then of least hash of its text."""
    _, first = labelled(docs, doc_id, text)
    kept = first.select("first").distinct().select(F.struct(F.coalesce(F.col("first.doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("first.h").alias("h")).alias("key"))
    own = F.struct(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"))
    rows = docs.select(F.struct("*").alias("row"), own.alias("key")).join(kept, "key", "left_semi")
    return rows.dropDuplicates(["key"]).select("row.*")
