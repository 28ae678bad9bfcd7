"""Operator 4: benchmark decontamination by an FM-index of each shard of documents.

Benchmark passages give windows of WINDOW words; shorter ones are one window. A task takes its
documents in shards. Words of a shard that could be in a window (their neighbours stand beside
them in some passage, and enough of them stand together) become a sequence of word numbers with
0 between stretches. The shard's index is the Burrows-Wheeler transform of that sequence in a
wavelet matrix, the counts of smaller symbols, and every SAMPLE-th suffix position. All windows
are searched backwards at once through ranks of the matrix; rows that are found walk back to a
sampled position; the occurrences of a document are merged into spans.

Passages are sent to the tasks in blocks of BLOCK_CHARS characters at most, and a shard is
searched for one block after the other, so memory does not grow with the benchmark.

Defined cases: null or empty texts have no words; passages without words have no window, a
passage without an id has the id ''; equal passages are items of their own; a null doc_id stays
null and rows are kept as given, repeated ones too. Columns with other names are handed on by
`cleaned` and not looked at by `contamination`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessera.llm.byte_repeats import suffix_array
from tessera.llm.shared import in_small_batches

WINDOW, SAMPLE = 10, 8
BLOCK_CHARS = 8_000_000
#: Characters of a shard; its index is over those words that may be in a window.
SHARD_CHARS = 8_000_000
#: A-Z become a-z; what is not of a word becomes a blank.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Ranks:
    """A bitmap with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def ones(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        bit = (place & 63).astype(np.uint64)
        below = self.words[place >> 6] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[place >> 6] + np.bitwise_count(below)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit of the symbols at a time."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, Ranks, int]] = []
        for shift in range(bits - 1, -1, -1):
            on = (values >> shift) & 1 == 1
            zeros = int(len(on) - on.sum())
            self.levels.append((shift, Ranks(on), zeros))
            values = np.concatenate([values[~on], values[on]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros(len(place), np.int64)
        for shift, ranks, zeros in self.levels:
            on = (symbol >> shift) & 1 == 1
            ones, low_ones = ranks.ones(place), ranks.ones(low)
            place = np.where(on, zeros + ones, place - ones)
            low = np.where(on, zeros + low_ones, low - low_ones)
        return place - low

    def at(self, place: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        symbol = np.zeros(len(place), np.int64)
        for shift, ranks, zeros in self.levels:
            on = ranks.at(place)
            symbol |= on.astype(np.int64) << shift
            ones = ranks.ones(place)
            place = np.where(on, zeros + ones, place - ones)
        return symbol


class FmIndex:
    """Backward search and location in a sequence of numbers from 0 on."""

    def __init__(self, sequence: np.ndarray):
        # Numbers move up by one, so that the end has a symbol of its own that is less than all.
        sequence = np.append(sequence + 1, 0)
        order = suffix_array(sequence, len(sequence))
        self.size = len(sequence)
        self.matrix = WaveletMatrix(sequence[order - 1], int(sequence.max()).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence))])
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Ranks(sampled), order[sampled]

    def back(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.smaller[symbol] + self.matrix.rank(symbol, row)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a row, -1 in front of short ones) the range of rows that begin with it."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column]
            known = (symbol >= 0) & (symbol + 2 < len(self.smaller))
            low[live[symbol + 2 >= len(self.smaller)]] = self.size
            on, symbol = live[known], symbol[known] + 1
            low[on], high[on] = self.back(symbol, low[on]), self.back(symbol, high[on])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position in the sequence of each row, by steps back to a sampled one."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        live = np.flatnonzero(~self.sampled.at(row))
        while live.size:
            row[live] = self.back(self.matrix.at(row[live]), row[live])
            steps[live] += 1
            live = live[~self.sampled.at(row[live])]
        return self.positions[self.sampled.ones(row)] + steps


class Passages:
    """A block of passages: numbers of their words, their windows, and which item has which window."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], list[int]] = {}
        for item, (_, text) in enumerate(items):
            ids = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            for k in range(max(1, len(ids) - WINDOW + 1)):
                window = tuple(ids[k : k + WINDOW])
                if window and item not in windows.setdefault(window, [])[-1:]:
                    windows[window].append(item)
        self.length = np.array([len(x) for x in windows], np.int64)
        self.windows = np.full((len(windows), WINDOW), -1, np.int64)
        for row, window in zip(self.windows, windows):
            row[WINDOW - len(window) :] = window
        self.item_count = np.array([len(x) for x in windows.values()], np.int64)
        self.item_begin = np.cumsum(self.item_count) - self.item_count
        self.items = np.array([y for x in windows.values() for y in x], np.int64)
        self.shortest = int(self.length.min()) if windows else WINDOW
        left, right = self.windows[:, :-1].ravel(), self.windows[:, 1:].ravel()
        self.pairs = np.unique((left * (len(self.number) + 1) + right)[(left > 0) & (right > 0)])

    def likely(self, numbers: np.ndarray) -> np.ndarray:
        """Places of the words that may be in a window, in stretches as long as the shortest window."""
        stay = numbers > 0
        if self.shortest > 1:
            both = np.flatnonzero(stay[:-1] & stay[1:])
            code = numbers[both] * (len(self.number) + 1) + numbers[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            both = both[self.pairs[at] == code] if len(self.pairs) else both[:0]
            stay = np.zeros(len(numbers), bool)
            stay[both] = stay[both + 1] = True
        place = np.flatnonzero(stay)
        if place.size:
            first = np.flatnonzero(np.append(True, np.diff(place) != 1))
            size = np.diff(np.append(first, len(place)))
            place = place[np.repeat(size >= self.shortest, size)]
        return place


class Shard:
    """Some documents, by what is found in them."""

    def __init__(self) -> None:
        self.symbols: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int, numbers: np.ndarray, place: np.ndarray) -> None:
        first = np.flatnonzero(np.append(True, np.diff(place) != 1))
        mark = np.arange(len(place)) + np.repeat(np.arange(1, len(first) + 1), np.diff(np.append(first, len(place))))
        symbol = np.zeros(len(place) + len(first), np.int64)
        where = np.zeros(len(symbol), np.int64)
        symbol[mark], where[mark] = numbers[place], place
        self.symbols.append(symbol)
        self.places.append(where)
        self.docs.append(np.full(len(symbol), doc))
        self.size += len(symbol)

    def find(self, passages: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences: document, first word, number of words, window."""
        none = np.empty(0, np.int64)
        if not self.size or not len(passages.windows):
            return none, none, none, none
        index = FmIndex(np.concatenate(self.symbols))
        low, high = index.search(passages.windows)
        count = high - low
        ends = np.cumsum(count)
        row = np.arange(int(count.sum())) + np.repeat(low - (ends - count), count)
        at = index.locate(row)
        window = np.repeat(np.arange(len(count)), count)
        doc, place = np.concatenate(self.docs), np.concatenate(self.places)
        return doc[at], place[at], passages.length[window], window


def _merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), stop.tolist())):
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], b)
        else:
            spans.append((a, b))
    return spans


def search(texts: list[str], blocks: Iterator[Passages]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text: words, merged spans of words, and names of the items found in it."""
    counts, spans, names = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
    for passages in blocks:
        shard = Shard()
        for doc, text in enumerate(texts):
            words = words_of(text)
            counts[doc] = len(words)
            numbers = np.fromiter(map(passages.number.get, words, repeat(0)), np.int64, len(words))
            place = passages.likely(numbers)
            if place.size:
                shard.add(doc, numbers, place)
        doc, start, length, window = shard.find(passages)
        order = np.argsort(doc, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
            own = int(doc[part[0]])
            spans[own] += zip(start[part].tolist(), (start[part] + length[part]).tolist())
            found = window[part]
            size = passages.item_count[found]
            items = np.unique(passages.items[np.arange(int(size.sum())) + np.repeat(passages.item_begin[found] - (np.cumsum(size) - size), size)])
            names[own] += [passages.names[x] for x in items]
    return counts, [_merged(*np.array(x).T) if x else [] for x in spans], names


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list:
    """The passages as broadcast blocks of bounded size."""
    context = in_small_batches(benchmark).sparkSession.sparkContext
    rows = benchmark.selectExpr(f"coalesce(cast({item_id} AS string), '') AS name", f"coalesce({text}, '') AS body")
    found, items, size = [], [], 0
    for row in rows.toLocalIterator():
        items.append((row.name, row.body))
        size += len(row.body)
        if size >= BLOCK_CHARS:
            found.append(context.broadcast(items))
            items, size = [], 0
    return [*found, context.broadcast(items)] if items or not found else found


_LOADED: dict[int, Passages] = {}


def _loaded(blocks: list) -> Iterator[Passages]:
    """Each block; it is kept in the worker only if it is the only one."""
    for block in blocks:
        key = hash(tuple(block.value)) if len(blocks) == 1 else None
        if key is None:
            yield Passages(block.value)
            vars(block).pop("_value", None)
        else:
            if key not in _LOADED:
                _LOADED[key] = Passages(block.value)
            yield _LOADED[key]


def _shards(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    held, size, at = [], 0, 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= SHARD_CHARS:
            yield at, held
            at, held, size = at + len(held), [], 0
    if held:
        yield at, held


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans of words."""
    blocks = _blocks(benchmark, item_id, item_text)
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("spans", spans_type)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _shards(batch.column(1).to_pylist()):
                counts, spans, names = search(texts, _loaded(blocks))
                hits = [sum(b - a for a, b in x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array(hits, pa.int64()),
                        pa.array([len(x) for x in names], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]),
                        pa.array([x > 0 for x in hits], pa.bool_()),
                        pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                    ],
                    names=schema.names,
                )

    return docs.select(docs[doc_id], docs[text]).mapInArrow(run, schema)


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs with the spans cut out of `text`, from the first to the last byte of their words."""
    blocks = _blocks(benchmark, item_id, item_text)
    place, names = docs.columns.index(text), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(place).to_pylist()
            for at, texts in _shards(bodies):
                _, spans, _ = search(texts, _loaded(blocks))
                for k, found in enumerate(spans):
                    if found:
                        bodies[at + k] = without_spans(texts[k], found)
            columns = batch.columns
            columns[place] = pa.array(bodies, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    inside = np.frombuffer(b" " + raw.translate(FOLD) + b" ", np.uint8) != 32
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    left, at = [], 0
    for start, stop in spans:
        left.append(raw[at : begin[start]])
        at = end[stop - 1]
    return b"".join([*left, raw[at:]]).decode()
