"""Repeated windows over a corpus: the joins and shuffles that three operators have in common.

1. Every text gives its runs of windows, each with the hash of its anchor and of its units.
2. Anchors that occur once are dropped: no window with such an anchor is repeated.
3. Runs of equal units are settled by counting: they agree in all their windows.
4. Only anchors with different runs are left. One of each sort of run is fetched from its text
   and all runs of an anchor meet in a task, which finds the equal windows among them.
5. An anchor with more than HOT different runs is not gathered: its windows are hashed whole
   and counted one by one, so no group grows with the corpus.

Rows are named by doc_id and two hashes of the text, 128 bits, so a retried task gives the same
names. Rows without a doc_id are different documents even if their texts are equal: they are
written once with a number, which stands in the place of the second hash. All counts are combined before they are shuffled; joins have no broadcast hints, and the side that
may hold a hot key is the one that Spark splits. What a text gives is bounded by the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import NO_ID, in_small_batches, settle
from tessera.llm.winnow import Cut

#: Different runs that one anchor may have before its windows are counted one by one.
HOT = 1500
#: Bytes of runs that a task resolves at once.
AT_ONCE = 3_000_000
#: Runs that are handed on at once when they have been fetched.
FETCHED_ROWS = 20_000
KEY = ["_id", "_h", "_k"]
RUNS = "anchor long, seg long, _id long, _h long, _k long, start int, n int"
WINDOWS = "_id long, _h long, _k long, start int, stop int"


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows as _row, with _id, _h and _k, which name them, beside."""
    rows = in_small_batches(docs).select(F.struct("*").alias("_row"))
    id_, body = F.col("_row").getField(doc_id), F.coalesce(F.col("_row").getField(text), F.lit(""))
    with_id = rows.where(id_.isNotNull()).withColumn("_k", F.xxhash64(F.lit(1), body))
    # Written, because a task that is run again may number its rows otherwise.
    without = settle(rows.where(id_.isNull()).withColumn("_k", F.monotonically_increasing_id()))
    return with_id.union(without).select("_row", F.coalesce(id_.cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(body).alias("_h"), "_k")


def texts(rows: DataFrame, text: str) -> DataFrame:
    """_id, _h, _k and _text of rows that have been named."""
    return rows.select(*KEY, F.coalesce(F.col("_row").getField(text), F.lit("")).alias("_text"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_id, _h, _k and _text."""
    return texts(named(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")), "id", "text"), "text")


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names=names)


def all_runs(rows: DataFrame, cut: Callable[[str], Cut], length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for id_, h, k, text in zip(*(x.to_pylist() for x in batch.columns)):
                begin, count, anchor, whole = cut(text).segments(length, gram)
                if len(begin):
                    held.append((anchor, whole, np.full(len(begin), id_, np.int64), np.full(len(begin), h, np.int64), np.full(len(begin), k, np.int64), begin.astype(np.int32), count.astype(np.int32)))
                    size += len(begin)
                if size > 100_000:
                    yield _batch(["anchor", "seg", *KEY, "start", "n"], *(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
            if held:
                yield _batch(["anchor", "seg", *KEY, "start", "n"], *(np.concatenate(x) for x in zip(*held)))

    return rows.mapInArrow(run, RUNS)


def _fetch(asked: DataFrame, rows: DataFrame, cut: Callable[[str], Cut], length: int) -> DataFrame:
    """The units of the runs that are asked for; a text is read once for all of its runs."""
    lists = asked.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "start", "n", "hot", "alone")).alias("runs"))
    found = rows.join(lists, KEY).select(*KEY, "_text", "runs")

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*out), _FETCHED)], schema=_FETCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, h, k, text, wanted in zip(*(x.to_pylist() for x in batch.columns)):
                units = cut(text)
                for x in wanted:
                    out.append((x["anchor"], id_, h, k, x["start"], x["n"], x["hot"], x["alone"], units.part(x["start"], x["start"] + x["n"] + length - 1)))
                if len(out) > FETCHED_ROWS:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    return found.mapInArrow(run, "anchor long, _id long, _h long, _k long, start int, n int, hot boolean, alone boolean, body binary")


_FETCHED = pa.schema([("anchor", pa.int64()), ("_id", pa.int64()), ("_h", pa.int64()), ("_k", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_()), ("alone", pa.bool_()), ("body", pa.binary())])


class Group:
    """Runs of some whole anchors: names, first windows, numbers of windows, units as bytes; in order of position."""

    def __init__(self, table: pa.Table):
        self.id, self.h, self.k, self.start, self.n = (table.column(x).to_numpy() for x in (*KEY, "start", "n"))
        self.alone = table.column("alone").to_numpy(zero_copy_only=False)
        body = table.column("body").to_pylist()
        order = np.lexsort((self.start, self.k, self.h, self.id))
        same = np.zeros(len(order), bool)
        keys = np.stack([self.id[order], self.h[order], self.k[order], self.start[order]])
        same[1:] = (keys[:, 1:] == keys[:, :-1]).all(axis=0)
        order = order[~same]
        self.id, self.h, self.k, self.start, self.n, self.alone = (x[order] for x in (self.id, self.h, self.k, self.start, self.n, self.alone))
        self.body = [body[x] for x in order]


def _resolve(resolve: Callable[[Group], tuple[np.ndarray, np.ndarray]]):
    """Complete anchors, some megabytes at a time, to ranges of windows (_id, _h, _k, start, stop)."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = Group(pa.Table.from_batches(held))
        run, offset = resolve(group)
        if len(run):
            order = np.lexsort((offset, run))
            run, offset = run[order], offset[order]
            first = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)))
            last = np.append(first[1:], len(run)) - 1
            begin = group.start[run[first]] + offset[first]
            stop = group.start[run[last]] + offset[last] + 1
            yield _batch([*KEY, "start", "stop"], group.id[run[first]], group.h[run[first]], group.k[run[first]], begin.astype(np.int32), stop.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchor = batch.column(0).to_numpy()
            cut = 0
            for at in [*np.flatnonzero(anchor[1:] != anchor[:-1]) + 1]:
                if size + batch.slice(cut, at - cut).nbytes >= AT_ONCE:
                    yield from flush([*held, batch.slice(cut, at - cut)])
                    held, size, cut = [], 0, at
            if held and size >= AT_ONCE and cut == 0 and held[-1].column(0)[-1].as_py() != anchor[0]:
                yield from flush(held)
                held, size = [], 0
            rest = batch.slice(cut)
            held.append(rest)
            size += rest.nbytes
        if held:
            yield from flush(held)

    return run


def _windows_alone(length: int, unit_ends: Callable[[bytes], tuple[np.ndarray, np.ndarray]]):
    """Each window of a hot anchor's runs by a hash of all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, h, k, start, n, body in zip(*(batch.column(x).to_pylist() for x in (*KEY, "start", "n", "body"))):
                begin, end = unit_ends(body)
                for at in range(n):
                    part = body[begin[at] : end[at + length - 1]]
                    out.append((part_hash(part), part_hash(part + b"\x00"), id_, h, k, start + at))
            if out:
                *longs, places = zip(*out)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in longs), pa.array(places, pa.int32())], names=["w1", "w2", *KEY, "start"])

    return run


def part_hash(part: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(part)
    return value - 2**64 if value >= 2**63 else value


def repeated_windows(
    rows: DataFrame,
    cut: Callable[[str], Cut],
    length: int,
    gram: int,
    resolve: Callable[[Group], tuple[np.ndarray, np.ndarray]],
    unit_ends: Callable[[bytes], tuple[np.ndarray, np.ndarray]],
    later: bool,
) -> DataFrame:
    """Ranges [start, stop) of windows that also occur elsewhere, or earlier if `later` is set.

    `rows` has _id, _h, _k and _text. `resolve` finds such windows among the runs of some anchors.
    """
    runs = all_runs(rows, cut, length, gram)
    # Written first, so that the join has plain shuffles on both sides and Spark can split a hot anchor.
    shared = settle(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"))
    known = settle(runs.join(shared, "anchor"))
    place = F.struct(*KEY, "start")
    # Rows of one doc_id and equal texts have equal places; they are one place here.
    sorts = settle(known.groupBy("anchor", "seg").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min("n").alias("n")))
    often = sorts.where("first <> last").select("anchor", "seg", "first")
    known_often = known.join(often, ["anchor", "seg"])
    if later:
        known_often = known_often.where(place != F.col("first"))
    whole = known_often.selectExpr(*KEY, "start", "start + n AS stop")

    mixed_up = sorts.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("hot", F.col("c") > HOT).drop("c")
    asked = sorts.join(mixed_up, "anchor").selectExpr("anchor", *(f"first.{x} AS {x}" for x in KEY), "first.start AS start", "n", "hot", "first = last AS alone")
    fetched = settle(_fetch(asked, rows, cut, length), "hot")
    calm = fetched.where("NOT hot").select("anchor", *KEY, "start", "n", "alone", "body")
    calm = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve(resolve), WINDOWS)

    hot = fetched.where("hot").select(*KEY, "start", "n", "body").mapInArrow(_windows_alone(length, unit_ends), "w1 long, w2 long, _id long, _h long, _k long, start int")
    ends = settle(hot.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last"))
    again = hot.join(ends, ["w1", "w2"])
    if later:
        again = again.where(place != F.col("first"))
    return whole.union(calm).union(again.selectExpr(*KEY, "start", "start + 1 AS stop"))


def with_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """All columns of rows, with the ranges of windows of each as an array; null where there are none."""
    lists = windows.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("_windows"))
    return rows.join(lists, KEY, "left")


def covered(windows: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal runs of units that the windows cover."""
    merged: list[tuple[int, int]] = []
    for start, stop in sorted((x["start"], x["stop"] + length - 1) for x in windows or ()):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], stop)
        else:
            merged.append((start, stop))
    return merged
