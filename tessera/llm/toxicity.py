"""Operator 8: toxicity by a linear classifier on character n-grams, scaled by naive Bayes ratios.

A text is lower-cased, white space becomes one blank, and its n-grams of bytes are hashed into
2^BITS features, each present or absent. Training takes a bounded sample of the labelled rows:
`sample_rows` of them at most, chosen by the hash of the doc_id, so that any corpus of more
rows is sampled evenly. Each feature gets the log ratio of its smoothed frequencies in the two
classes; features whose ratio is small say nothing and are left out; a logistic regression with
an L2 penalty is fitted to the features times their ratios. Then each half of the sample is
scored by a fit to the other half, and the intercept is moved so that the cut that errs least
there lies at the score CUT. Weights are one array of fixed size.

Rows may be learned from only if crc32 of the doc_id as text, modulo `folds`, is not `held`.
Labels, languages, sources and ids never reach a score.

Defined cases: a null text scores as the empty text, and the empty text scores by the intercept
alone; rows are kept as given; a null doc_id is never learned from and is not held out; a
document labelled more than once counts as toxic if any label says so; null labels are not
learned from. With no labelled row of one of the classes every score is the smoothed share of
toxic rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.shared import in_small_batches

BITS = 18
ORDERS = (4, 5)
#: Bounds of the training sample, in rows and in characters.
SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 150_000_000
LEAST_RATIO = 2.0
LEAST_ROWS = 4
CUT = 0.7
SMOOTH = 1.0
PENALTY = 3e-4
NEWTON_STEPS = 12
INNER_STEPS = 25


def features(text: str) -> np.ndarray:
    """The hashed n-grams of a text, as often as they occur."""
    raw = b" " + b" ".join(text.lower().encode().split()) + b" "
    one = np.frombuffer(raw, np.uint8).astype(np.uint64)
    two = (one[:-1] << np.uint64(8)) | one[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:] if len(two) > 2 else two[:0]
    five = (four[:-1] << np.uint64(8)) | one[4:] if len(four) > 1 else four[:0]
    with np.errstate(over="ignore"):
        return np.concatenate(
            [((codes + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS) for order, codes in zip(ORDERS, (four, five))]
        ).astype(np.int64)


def _fit_once(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights of all features, already times their ratios, and the intercept."""
    width = 1 << BITS
    label = np.array([y for _, y in rows], np.int64)
    seen = np.zeros((2, width), np.int32)
    for text, y in rows:
        here = np.zeros(width, bool)
        here[features(text)] = True
        seen[y] += here
    sizes = np.bincount(label, minlength=2)
    if not sizes.all():
        share = (sizes[1] + SMOOTH) / (sizes.sum() + 2 * SMOOTH)
        return np.zeros(width, np.float32), float(np.log(share / (1 - share)))
    ratio = np.log((seen[1] + SMOOTH) / (sizes[1] + 2 * SMOOTH)) - np.log((seen[0] + SMOOTH) / (sizes[0] + 2 * SMOOTH))
    ratio[(np.abs(ratio) < LEAST_RATIO) | (seen.sum(axis=0) < LEAST_ROWS)] = 0
    column, row = [], []
    for place, (text, _) in enumerate(rows):
        found = features(text)
        found = np.unique(found[ratio[found] != 0])
        column.append(found)
        row.append(np.full(len(found), place))
    used, column = np.unique(np.concatenate(column), return_inverse=True)
    row = np.concatenate(row)
    value = ratio[used][column]
    weight, bias = _logistic(row, column, value, label, len(used))
    full = np.zeros(width, np.float32)
    full[used] = weight * ratio[used]
    return full, bias


def fit(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and the intercept, set so that CUT is the best cut between the classes."""
    weights, bias = _fit_once(rows)
    halves = rows[::2], rows[1::2]
    if any(len({y for _, y in half}) < 2 for half in halves):
        return weights, bias
    margins, labels = [], []
    for own, other in (halves, halves[::-1]):
        w, b = _fit_once(other)
        margins += [margin(text, w, b) for text, _ in own]
        labels += [y for _, y in own]
    order = np.argsort(margins, kind="stable")
    m, y = np.array(margins)[order], np.array(labels)[order]
    wrong = np.append(0, np.cumsum(y)) + np.append(np.cumsum((1 - y)[::-1])[::-1], 0)
    best = np.flatnonzero(wrong == wrong.min())
    ends = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    cut = (ends[best[0]] + ends[best[-1] + 1]) / 2
    return weights, bias + float(np.log(CUT / (1 - CUT)) - cut)


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Newton steps, each solved by conjugate gradients, with both classes of equal weight; the last weight is the intercept, without penalty."""
    n = len(label)
    row, column = np.concatenate([row, np.arange(n)]), np.concatenate([column, np.full(n, width)])
    value = np.concatenate([value, np.ones(n)])
    penalty = np.append(np.full(width, PENALTY), 0.0)

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[column], n)

    share = n / (2 * np.bincount(label, minlength=2))[label]

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(column, value * (share * e)[row], width + 1) / n

    def loss(m: np.ndarray, w: np.ndarray) -> float:
        return float(np.mean(share * (np.logaddexp(0, m) - label * m)) + 0.5 * (penalty * w * w).sum())

    weight, m = np.zeros(width + 1), np.zeros(n)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-m))
        slope = back(p - label) + penalty * weight
        start = np.abs(slope).max()
        if start < 1e-6:
            break
        curve, step, rest = p * (1 - p), np.zeros(width + 1), -slope
        way, size = rest.copy(), float(rest @ rest)
        first = size
        for _ in range(INNER_STEPS):
            bent = back(curve * times(way)) + penalty * way
            far = size / max(float(way @ bent), 1e-300)
            step += far * way
            rest -= far * bent
            size, old = float(rest @ rest), size
            if size < 1e-4 * first:
                break
            way = rest + size / old * way
        ahead, now, part = times(step), loss(m, weight), 1.0
        while part > 1e-4 and loss(m + part * ahead, weight + part * step) > now:
            part /= 2
        weight, m = weight + part * step, m + part * ahead
    return weight[:-1], float(weight[-1])


def margin(text: str, weights: np.ndarray, bias: float) -> float:
    found = features(text)
    found = np.unique(found[weights[found] != 0])
    return float(weights[found].astype(np.float64).sum()) + bias


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """Fit to the bounded sample in one task; only the weights come to the driver."""
    may = labels.where(F.col(doc_id).isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds != held))
    may = may.groupBy(F.col(doc_id).alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic")).withColumn("_order", F.xxhash64("_id"))
    known = max(1, may.count())
    top = min(1.0, SAMPLE_ROWS / known)
    chosen = may.where(F.col("_order") <= F.lit(int(-(2**63) + top * (2**64 - 1)))) if top < 1 else may
    rows = in_small_batches(docs).select(docs[doc_id].alias("_id"), docs[text].alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("_order", F.coalesce("_text", F.lit("")).alias("_text"), "_toxic").repartition(1).sortWithinPartitions("_order", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, chars = [], 0
        for batch in batches:
            for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if len(sample) < SAMPLE_ROWS and chars < SAMPLE_CHARS:
                    sample.append((text, int(toxic > 0)))
                    chars += len(text)
        weights, bias = fit(sample)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    found = rows.mapInArrow(run, "weights binary, bias double").collect()
    if not found:
        return np.zeros(1 << BITS, np.float32), 0.0
    return np.frombuffer(found[0].weights, np.float32), found[0].bias


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    weights, bias = train(docs, labels, folds, held, doc_id, text)
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            m = np.array([margin(x or "", w, b) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-m)))], names=["doc_id", "score"])

    scored = docs.select(docs[doc_id], docs[text]).mapInArrow(run, schema)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, as they are, that do not score as toxic."""
    weights, bias = train(docs, labels, doc_id=doc_id, text=text)
    sent = docs.sparkSession.sparkContext.broadcast((weights, bias))
    least = float(np.log(CUT / (1 - CUT)))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = sent.value
        for batch in batches:
            yield batch.filter(pa.array([margin(x or "", w, b) < least for x in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
