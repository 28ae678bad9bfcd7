"""Operators 1, 2 and 9 beside brute force, with all kinds of odd rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import byte_repeats, line_dedup, repeats, word_repeats

DOCS = "/root/testdata/sf0.001/documents.parquet"
LOW = -(2**63)


def half_hash(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), seed=42) >> 32
    return value - 2**32 if value >= 2**31 else value


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(1)
    base = [tuple(x) for x in spark.read.parquet(DOCS).select("doc_id", "text").collect()][:120]
    odd = [(2000 + i, random.choice(base)[1][50 : 300 + random.randrange(900)] + random.choice(base)[1][: random.randrange(500)]) for i in range(30)]
    odd += [(3000, ""), (3001, None), (None, base[5][1]), (None, None), (3002, "=" * 3000), (3003, "ab" * 700), (3004, "the a " * 300), (3005, "the a " * 200)]
    # One doc_id with two texts, and a row given twice.
    odd += [(7, base[8][1]), (9, base[9][1]), (9, base[9][1]), (3006, "é" * 400), (3007, "x" + "é" * 400)]
    # A passage that many texts share, shorter than a window and in ever other surroundings.
    word = ["foo", "bar", "baz", "qux", "zip"]
    shared = " ".join(base[3][1].split()[:12])
    odd += [(4000 + i, " ".join(random.choices(word, k=30)) + " " + shared + " " + " ".join(random.choices(word, k=30))) for i in range(25)]
    odd += [(5000 + i, "one\n\n  \nsame line\nsame next\n" + random.choice(word) + "\nsame line\nsame next\r\n") for i in range(12)]
    return base + odd


@pytest.fixture(scope="module")
def frame(spark, rows):
    named = [(i, t, f"k{i}", 1, "w") for i, t in rows]
    return spark.createDataFrame(named, "doc_id long, text string, _id string, _h int, _windows string").repartition(5)


def in_order(rows):
    return sorted({(i, t or "") for i, t in rows}, key=lambda r: (LOW if r[0] is None else r[0], half_hash(r[1])))


def removed_later(units, length):
    """Flags of the units that windows cover which an earlier document or place has."""
    seen, out = set(), []
    for row in units:
        gone = [False] * len(row)
        for k in range(len(row) - length + 1):
            window = tuple(row[k : k + length])
            if window in seen:
                gone[k : k + length] = [True] * length
            seen.add(window)
        out.append(gone)
    return out


def compare(got, want, rows):
    expected = collections.Counter((i, *want[i, t or ""]) for i, t in rows)
    found = collections.Counter(tuple(x) for x in got.collect())
    assert found == expected


@pytest.mark.parametrize("hot", [1500, 6])
def test_bytes(frame, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "FETCHED_ROWS", 20_000 if hot > 6 else 3)
    own = in_order(rows)
    count = collections.Counter(t.encode()[k : k + 200] for _, t in own for k in range(len(t.encode()) - 199))
    want = {}
    for i, t in own:
        raw, flag = t.encode(), np.zeros(len(t.encode()) + 2, np.int8)
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                flag[k + 1 : k + 201] = 1
        kept = bytes(x for x, f in zip(raw, flag[1:]) if not f)
        want[i, t] = len(raw), int(flag.sum()), int((np.diff(flag) == 1).sum()), hashlib.sha256(kept).hexdigest()
    compare(byte_repeats.digests(frame), want, rows)


@pytest.mark.parametrize("hot", [1500, 6])
def test_words(frame, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    own = in_order(rows)
    words = [t.encode().split() for _, t in own]
    want = {}
    for (i, t), row, gone in zip(own, words, removed_later(words, 20)):
        kept = b" ".join(x for x, f in zip(row, gone) if not f)
        want[i, t] = len(row), sum(gone), hashlib.sha256(kept).hexdigest()
    compare(word_repeats.digests(frame), want, rows)


@pytest.mark.parametrize("hot", [1500, 3])
def test_lines(frame, rows, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    own = in_order(rows)
    cut = [line_dedup.counted_lines(t) for _, t in own]
    flags = removed_later([[lines[k] for k in places] for lines, places in cut], line_dedup.RUN)
    want = {}
    for (i, t), (lines, places), gone in zip(own, cut, flags):
        out = {k for k, f in zip(places, gone) if f}
        kept = "\n".join(x for k, x in enumerate(lines) if k not in out)
        want[i, t] = len(places), len(out), hashlib.sha256(kept.encode()).hexdigest()
    compare(line_dedup.digests(frame), want, rows)


def test_single_lines(frame, rows):
    own = in_order(rows)
    cut = [line_dedup.counted_lines(t) for _, t in own]
    flags = removed_later([[lines[k] for k in places] for lines, places in cut], 1)
    want = {}
    for (i, t), (lines, places), gone in zip(own, cut, flags):
        out = {k for k, f in zip(places, gone) if f}
        want[i, t] = len(out), "\n".join(x for k, x in enumerate(lines) if k not in out)
    got = line_dedup.without_repeats(frame, least=1).select("doc_id", "_n_removed", F.coalesce("text", F.lit("")))
    compare(got, want, rows)


def test_stage_removes_a_line_between_unique_lines(spark):
    passage = "a passage that is one line " * 12
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb", 0), (2, f"c\n{passage}\nd", 0), (3, passage, 0)], "doc_id long, text string, n_chars int")
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.lines_once(spark, docs, "").collect()}
    assert got == {1: (f"a\n{passage}\nb", len(passage) + 4), 2: ("c\nd", 3), 3: ("", 0)}


def colliding_texts():
    """Two texts of other lines and words whose hashes agree in the upper 32 bits."""
    seen = {}
    for k in range(400_000):
        text = f"{k}\nunique {k} line\n" + " ".join(f"w{k}x{j}" for j in range(30))
        other = seen.setdefault(half_hash(text), text)
        if other != text:
            return other, text
    raise AssertionError("no pair")


@pytest.mark.parametrize("id_", [None, 5])
def test_texts_of_one_half_hash_stay_apart(spark, id_):
    one, two = colliding_texts()
    docs = spark.createDataFrame([(1, one), (id_, one), (id_, two)] if id_ else [(-9, one), (id_, two), (id_, one)], "doc_id long, text string")
    got = {(x.doc_id, x.n_lines, x.n_removed) for x in line_dedup.digests(docs).collect()}
    assert got == ({(1, 3, 0), (5, 3, 3), (5, 3, 0)} if id_ else {(-9, 3, 3), (None, 3, 0)})
    words = sorted((x.doc_id or 0, x.n_removed > 0) for x in word_repeats.digests(docs).collect())
    assert words == ([(1, False), (5, False), (5, True)] if id_ else [(-9, True), (0, False), (0, False)])
    raw = sorted((x.doc_id or 0, x.n_removed > 0) for x in byte_repeats.digests(docs).collect())
    assert raw == ([(1, True), (5, False), (5, True)] if id_ else [(-9, True), (0, False), (0, True)])


def test_equal_texts_without_id_are_found(spark):
    text = "first line\n" + " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(None, text)] * 3 + [(None, "first line"), (None, None)], "doc_id long, text string").repartition(3)
    assert sorted(x.n_removed for x in line_dedup.digests(docs).collect()) == [0, 0, 0, 2, 2]
    assert sorted(x.n_removed for x in word_repeats.digests(docs).collect()) == [0, 0, 0, 62, 62]
    assert sorted(x.n_removed for x in byte_repeats.digests(docs).collect()) == [0, 0] + [len(text)] * 3


def test_lines_keep_all_columns_and_null_texts(frame):
    got = line_dedup.without_repeats(frame)
    assert got.columns == [*frame.columns, "_n_lines", "_n_removed"] and got.count() == frame.count()
    assert got.where("doc_id = 3001").first().text is None
    assert got.where("doc_id = 3001").first()["_id"] == "k3001"


def test_lines_beside_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{DOCS}'")
    got = sorted(map(tuple, line_dedup.digests(spark.read.parquet(DOCS)).collect()))
    assert got == sorted(duckdb.sql(line_dedup.SQL).fetchall())


@pytest.mark.parametrize("module", [byte_repeats, word_repeats, line_dedup])
def test_empty_table(spark, module):
    assert module.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_of_neighbours():
    random.seed(5)
    for size in (1, 7, 60, 400):
        parts = [[random.randrange(1, 4) for _ in range(random.randrange(size + 1))] for _ in range(6)]
        text = np.array([x for p in parts for x in [*p, 0]], np.uint16)
        order = byte_repeats.suffix_array(text, 5)
        apart = byte_repeats.bounded_prefixes(text, order, 5)

        def head(place):
            own = text[place : place + 5].tolist()
            return own if 0 not in own and len(own) == 5 else None

        want = [False] + [head(a) is not None and head(a) == head(b) for a, b in zip(order, order[1:])]
        assert apart.tolist() == want


def test_trees_that_are_split(monkeypatch):
    random.seed(6)
    monkeypatch.setattr(word_repeats, "LENGTH", 3)
    symbol = np.array([random.randrange(4) for _ in range(300)])
    found = {}
    for limit in (1 << 18, 20):
        monkeypatch.setattr(word_repeats, "TREE", limit)
        suffix = np.arange(len(symbol) - 3)
        found[limit] = sorted(x for leaf, _ in word_repeats.deep_nodes(symbol, suffix, np.zeros(len(suffix), np.int64), 0) for x in leaf.tolist())
    count = collections.Counter(tuple(symbol[k : k + 3]) for k in range(len(symbol) - 3))
    assert found[1 << 18] == found[20] == [k for k in range(len(symbol) - 3) if count[tuple(symbol[k : k + 3])] > 1]
