"""Operator 10: token ids in directly addressable codes.

Ids are cut into bytes. Level 0 holds the low byte of every id, level 1 the next byte of those
ids that have one, and so on. A bitmap at each level marks the ids that go on, and a directory
holds the number of marks before each word of 64 bits. Any id is found by following ranks from
level to level; nothing before it is decoded.

The file format is a folder of two Parquet tables, so that Spark writes it to any store and a
lost task is simply run again:

* `codes`, one row a shard: part, seq (order), n_ids, doc_ids and doc_begin (64-bit, local),
  has_id (a byte each), levels as arrays of codes, marks and ranks;
* `bases`, one row a shard: part, seq, base, the number of ids in all shards before it.

Defined cases: a null text is the empty text and has the end id alone; documents without a
doc_id come first; documents of the same doc_id follow one another in the order of the hashes
of their texts, and may stand in several parts; equal rows are all written, in one part. Other
columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import read_fixed
from tessera.llm.pieces import PieceCoder, text_groups
from tessera.llm.shared import in_small_batches

SHARD_IDS = 1 << 20
CODES = "part int, seq int, n_ids long, doc_ids binary, doc_begin binary, has_id binary, codes array<binary>, marks array<binary>, ranks array<binary>"


def split_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Codes, marks and ranks of each level."""
    codes, marks, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        codes.append((rest & 255).astype(np.uint8).tobytes())
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(more) // 64) + 1, "<u8")
        words.view(np.uint8)[: len(bits)] = bits
        marks.append(words.tobytes())
        counts = np.bitwise_count(words).astype(np.uint64)
        ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        if not more.any():
            return codes, marks, ranks
        rest = rest[more] >> 8


class Codes:
    """Random access to the ids of one shard."""

    def __init__(self, codes: list[bytes], marks: list[bytes], ranks: list[bytes]):
        self.levels = [
            (np.frombuffer(a, np.uint8), np.frombuffer(b, "<u8"), np.frombuffer(c, "<u4")) for a, b, c in zip(codes, marks, ranks)
        ]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        found = np.zeros(len(places), np.uint32)
        who, place = np.arange(len(places)), np.asarray(places, np.int64)
        for level, (codes, marks, ranks) in enumerate(self.levels):
            found[who] |= codes[place].astype(np.uint32) << np.uint32(8 * level)
            word, bit = marks[place >> 6], (place & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            place = (ranks[place >> 6].astype(np.int64) + np.bitwise_count(below))[on]
            who = who[on]
            if not who.size:
                break
        return found


    def stretch(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end: neighbours lie side by side at every level, from the rank of the first on."""
        found = np.zeros(end - begin, np.uint32)
        who: np.ndarray | slice = slice(None)
        for level, (codes, marks, ranks) in enumerate(self.levels):
            found[who] |= codes[begin:end].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(marks.view(np.uint8)[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :][: end - begin]
            on = np.flatnonzero(bits)
            if not on.size:
                break
            who = on if level == 0 else who[on]
            below = int(marks[begin >> 6]) & ((1 << (begin & 63)) - 1)
            begin = int(ranks[begin >> 6]) + below.bit_count()
            end = begin + len(on)
        return found


class LibraryCoder:
    """Ids by the tokenizers library, which is asked once for each distinct piece."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values() if x.special]
        letters = self.library.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(letters.values()) + 1, np.int64)
        self.width[list(letters.values())] = [len(x) for x in letters]
        self.coder = PieceCoder(self._encode)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, flat, and how many each has.

        Pieces of a blank and then no white space are cut apart again wherever they stand behind
        one another, so the library is given many of them as one text; the rest go one by one.
        """
        joint = np.fromiter((x[0] == " " and len(x) > 1 and not x[1].isspace() for x in pieces), bool, len(pieces))
        size = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        where = np.flatnonzero(joint)
        blocks = [where[x : x + 500] for x in range(0, len(where), 500)]
        for block, found in zip(blocks, self.library.encode_batch_fast(["".join(pieces[x] for x in b) for b in blocks], add_special_tokens=False)):
            ids = np.array(found.ids, np.int32)
            ends = np.cumsum([len(pieces[x].encode()) for x in block])
            last = np.searchsorted(np.cumsum(self.width[ids]), ends)
            size[block] = np.diff(np.append(-1, last))
            parts.append((block, ids))
        rest = np.flatnonzero(~joint)
        for place, found in zip(rest, self.library.encode_batch_fast([pieces[x] for x in rest], add_special_tokens=False)):
            size[place] = len(found.ids)
            parts.append((np.array([place]), np.array(found.ids, np.int32)))
        flat = np.empty(int(size.sum()), np.int32)
        begin = np.cumsum(size) - size
        for block, ids in parts:
            flat[np.repeat(begin[block] - (np.cumsum(size[block]) - size[block]), size[block]) + np.arange(len(ids))] = ids
        return flat, size

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        held = [any(x in text for x in self.special) for text in texts]
        found = self.coder.ids(["" if x else text for x, text in zip(held, texts)])
        for place in np.flatnonzero(held):
            found[place] = np.array(self.library.encode(texts[place], add_special_tokens=False).ids, np.int32)
        return found


_LOADED: dict[int, LibraryCoder] = {}


def write_codes(docs: DataFrame, vocabulary_path: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, each with end_id after it, in ascending order of doc_id."""
    content = docs.sparkSession.sparkContext.broadcast(read_fixed(vocabulary_path))
    rows = in_small_batches(docs).select(docs[doc_id].cast("long").alias("_id"), F.coalesce(docs[text], F.lit("")).alias("_text"))
    rows = rows.repartitionByRange(F.col("_id"), F.xxhash64("_text")).sortWithinPartitions("_id", F.xxhash64("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        key = hash(content.value)
        if key not in _LOADED:
            _LOADED[key] = LibraryCoder(content.value)
        coder, part, seq = _LOADED[key], TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            codes, marks, ranks = split_levels(np.concatenate(ids))
            row = {
                "part": part, "seq": seq, "n_ids": size,
                "doc_ids": np.array([x or 0 for x in names], "<i8").tobytes(),
                "doc_begin": (np.cumsum(length) - length).astype("<i8").tobytes(),
                "has_id": np.array([x is not None for x in names], np.uint8).tobytes(),
                "codes": codes, "marks": marks, "ranks": ranks,
            }
            many = pa.list_(pa.binary())
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_begin", pa.binary()), ("has_id", pa.binary()), ("codes", many), ("marks", many), ("ranks", many)]))

        for batch in batches:
            found, at = batch.column(0).to_pylist(), 0
            for group in text_groups(batch.column(1).to_pylist()):
                for one in coder.ids(group):
                    ids.append(np.append(one, np.int32(end_id)))
                    size += len(ids[-1])
                    names.append(found[at])
                    at += 1
                    if size >= SHARD_IDS:
                        yield shard()
                        ids, names, size, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    spark = docs.sparkSession
    rows.mapInArrow(run, CODES).write.parquet(f"{path}/codes")
    sizes = spark.read.schema(CODES).parquet(f"{path}/codes").select("part", "seq", "n_ids")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("part_base", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)))
    inner = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("inner", inner).join(parts, "part").selectExpr("part", "seq", "part_base + inner AS base")
    bases.write.parquet(f"{path}/bases")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 and the ids themselves."""
    codes = spark.read.schema(CODES).parquet(f"{path}/codes")
    bases = spark.read.schema("part int, seq int, base long").parquet(f"{path}/bases")
    rows = codes.join(bases, ["part", "seq"]).select("base", "n_ids", "doc_ids", "doc_begin", "has_id", "codes", "marks", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Codes(row["codes"], row["marks"], row["ranks"])
                begin = np.frombuffer(row["doc_begin"], "<i8")
                end = np.append(begin[1:], row["n_ids"])
                ids = [shard.stretch(a, b).astype("<u4").tobytes() for a, b in zip(begin.tolist(), end.tolist())]
                named = np.frombuffer(row["has_id"], np.uint8) == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=named),
                        pa.array(begin + row["base"], pa.int64()),
                        pa.array(end - begin, pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The ids at global places (a table with a column `place`), without decoding what lies between."""
    codes = spark.read.schema(CODES).parquet(f"{path}/codes")
    bases = spark.read.schema("part int, seq int, base long").parquet(f"{path}/bases")
    width = F.lit(SHARD_IDS)
    spans = codes.select("part", "seq", "n_ids").join(bases, ["part", "seq"])
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("base") / width), F.floor((F.col("base") + F.col("n_ids") - 1) / width))))
    wanted = places.select("place").withColumn("bucket", F.floor(F.col("place") / width))
    wanted = wanted.join(spans, "bucket").where("place >= base AND place < base + n_ids").selectExpr("part", "seq", "place", "place - base AS inner")
    rows = wanted.join(codes.select("part", "seq", "codes", "marks", "ranks"), ["part", "seq"]).select("place", "inner", "codes", "marks", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = Codes(row["codes"], row["marks"], row["ranks"]).at(np.array([row["inner"]]))
                yield pa.RecordBatch.from_arrays([pa.array([row["place"]], pa.int64()), pa.array(found.astype(np.int64))], names=["place", "token"])

    return rows.mapInArrow(run, "place long, token long")
