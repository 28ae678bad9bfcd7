"""Operator 8 beside a plain fit, and operators 4 and 7 on empty tables and rows of all kinds."""

import math
import random
from collections import Counter

import numpy as np

from tessera.llm import decontaminate, simhash, toxicity


def grams(text):
    """Slots of the n-grams of a text, by plain arithmetic on its bytes."""
    raw = b" " + b" ".join(text.lower().encode().split()) + b" "
    return {((int.from_bytes(raw[k : k + n], "big") + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BITS) for n in toxicity.ORDERS for k in range(len(raw) - n + 1)}


def plain_fit(rows):
    """Weights by slot and the intercept: counts, log ratios, then Newton steps with a dense solver."""
    sizes, seen = Counter(y for _, y in rows), {0: Counter(), 1: Counter()}
    for text, y in rows:
        seen[y].update(grams(text))
    ratio = {}
    for slot in seen[0] | seen[1]:
        r = math.log((seen[1][slot] + 1) / (sizes[1] + 2)) - math.log((seen[0][slot] + 1) / (sizes[0] + 2))
        if abs(r) >= toxicity.LEAST_RATIO and seen[0][slot] + seen[1][slot] >= toxicity.LEAST_ROWS:
            ratio[slot] = r
    used = sorted(ratio)
    x = np.array([[ratio[s] if s in own else 0.0 for s in used] + [1.0] for own in (grams(t) for t, _ in rows)])
    y = np.array([y for _, y in rows])
    share = np.array([len(rows) / (2 * sizes[k]) for k in y])
    penalty = np.append(np.full(len(used), toxicity.PENALTY), 0.0)
    w = np.zeros(len(used) + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (share * (p - y)) / len(y) + penalty * w
        w -= np.linalg.solve((x.T * (share * p * (1 - p) / len(y))) @ x + np.diag(penalty) + 1e-12 * np.eye(len(w)), slope)
    return {s: a * ratio[s] for s, a in zip(used, w)}, w[-1]


def test_features_and_fit_against_a_plain_one():
    random.seed(9)
    kind, harsh = ["harbor", "crane", "tide", "rope", "mast", "hull"], ["idiot", "vermin", "scum"]
    rows = [(" ".join(random.choices(kind, k=9)), 0) for _ in range(30)] + [(" ".join(random.choices(kind, k=6) + random.choices(harsh, k=2)), 1) for _ in range(14)]
    rows += [("vermin in the harbor", 0), ("", 0), ("é", 1), ("crane", 1)]
    for text, _ in rows + [("a", 0), ("abcd", 0)]:
        assert set(toxicity.features(text).tolist()) == grams(text)
    want, bias = plain_fit(rows)
    weights, own_bias = toxicity._fit_once(rows)
    assert set(np.flatnonzero(weights)) <= set(want)
    for text, _ in rows + [("scum of the tide", 0)]:
        plain = sum(want.get(s, 0.0) for s in grams(text)) + bias
        assert abs(1 / (1 + math.exp(-plain)) - 1 / (1 + math.exp(-toxicity.margin(text, weights, own_bias)))) < 0.01


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "a", 1), (2, None, "b", 2), (3, "", "c", 3), (None, "no id", "d", 4)], "doc_id long, text string, n_hit string, fp int")
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven", "x"), (2, None, "y"), (None, "", "z")], "item_id long, text string, spans string")
    assert decontaminate.contamination(docs.limit(0), items).collect() == []
    assert {r["n_hit"] for r in decontaminate.contamination(docs, items.limit(0)).collect()} == {0}
    assert {(r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(docs, items).collect()} == {(1, 10), (2, 0), (3, 0), (None, 0)}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    # Rows without words have fingerprint zero and are one component.
    assert got[2] == got[3] == 2 and got[1] == 1
