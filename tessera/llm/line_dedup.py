"""Operator 2: line dedup by winnowing over the hashes of lines.

A text is its lines; blank ones (no more than blanks, tabs and carriage returns) are kept and
not counted. Of every `least` consecutive lines the one of least hash is the fingerprint, so two
texts that share `least` lines share a fingerprint. Places of equal fingerprints are joined (see
`repeats`), the match is extended to the lines on both sides, and of a repeated run of `least`
lines or more every place but the first, in the order of doc_id and line, is deleted. Overlapping
runs are judged on the input, not on what is left. The query and its SQL have runs of RUN lines;
with `least` = 1, as in the pipeline, a repeated line goes whatever its neighbours are.

Defined cases: null texts stay null and have no lines; a text of fewer lines than a run loses
nothing; documents without a doc_id come before all others, each is a document of its own, so one
of their equal texts stays whole at most; rows of one doc_id and different texts are different
documents, in the order of the hashes of their texts; rows of one doc_id and equal texts are one
document given twice: they do not delete one another and get the same result. A document keeps
its row even if no line is left. Other columns are handed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.repeats import Group, covered, named, repeated_windows, texts, with_windows
from tessera.llm.winnow import Cut, mixed

RUN = 2


def counted_lines(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the numbers of those that are not blank."""
    lines = text.split("\n")
    return lines, [k for k, line in enumerate(lines) if line.strip(" \t\r")]


def line_cut(text: str) -> Cut:
    lines, places = counted_lines(text)
    raw = [lines[k].encode() for k in places]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.cumsum(size + 1) - size - 1
    # Another seed than that of whole runs, so that a run of one line is known by two hashes.
    values = np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in raw], np.uint64)
    return Cut(b"\n".join(raw), begin, begin + size, mixed(values))


def line_ends(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 10)
    return np.append(0, gaps + 1), np.append(gaps, len(body))


def later_runs(group: Group, least: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Runs and offsets of the windows of lines that occur before in the group."""
    seen: set[bytes] = set()
    run, offset = [], []
    for number, (body, windows) in enumerate(zip(group.body, group.n.tolist())):
        lines = body.split(b"\n")
        for k in range(windows):
            window = b"\n".join(lines[k : k + least])
            if window in seen:
                run.append(number)
                offset.append(k)
            seen.add(window)
    return np.array(run, np.int64), np.array(offset, np.int64)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = RUN, counts: bool = True) -> DataFrame:
    """All columns of docs, with the lines left in `text`, and if asked for _n_lines and _n_removed beside.

    Without the counts no column is added, so docs may have columns of any name."""
    rows = named(docs, doc_id, text)
    windows = repeated_windows(texts(rows, text), line_cut, least, 1, partial(later_runs, least=least), line_ends, later=True)
    whole = with_windows(rows, windows).select("_row", "_windows")
    beside = ["_n_lines", "_n_removed"] if counts else []
    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, T.LongType()) for x in beside]])
    place = docs.columns.index(text)

    names = [*docs.columns, *beside]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, kept, count, removed = batch.column(0).flatten(), [], [], []
            for body, found in zip(columns[place].to_pylist(), batch.column(1).to_pylist()):
                lines, places = counted_lines(body or "")
                gone = {places[k] for start, stop in covered(found, least) for k in range(start, stop)}
                kept.append(body if body is None or not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone))
                count.append(len(places))
                removed.append(len(gone))
            columns[place] = pa.array(kept, pa.string())
            numbers = [pa.array(count, pa.int64()), pa.array(removed, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *numbers], names=names)

    return whole.mapInArrow(run, schema)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines (not blank), n_removed and a digest of the text left."""
    slim = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return without_repeats(slim).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
windows AS (
  SELECT doc_id, k, line, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM counted),
ranked AS (
  SELECT doc_id, k, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, k) AS n FROM windows WHERE after IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, k + d AS k FROM ranked, (VALUES (0), (1)) AS t(d) WHERE n > 1),
marked AS (
  SELECT l.doc_id, l.line, l.place, c.k, g.k AS g FROM lines l LEFT JOIN counted c USING (doc_id, place) LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.k = c.k)
SELECT doc_id, count(k) AS n_lines, count(g) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE g IS NULL), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
