"""Operators 3, 4, 7 and 8, and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import decontaminate, search, simhash, toxicity
from tessera.llm.components import components

SMALL = "/root/testdata/sf0.001"


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def base(spark):
    return [tuple(x) for x in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


def odd_frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "c", 3) for i, t in rows], "doc_id long, text string, score double, key string, prefix int").repartition(4)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)) if hashes else 0


def groups(fingerprints):
    root = list(range(len(fingerprints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    all_ = np.array(fingerprints, np.uint64)
    for i in range(len(all_)):
        for j in np.flatnonzero(np.bitwise_count(all_ ^ all_[i]) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(all_))]


def test_near_duplicates(spark, base):
    rows = base + [(900, ""), (901, None), (902, "  \n"), (903, "one two"), (904, "ONE two"), (None, base[4][1]), (None, "alone with no id"), (5, base[5][1]), (905, "a " * 20000)]
    got = collections.Counter(map(tuple, simhash.near_duplicates(odd_frame(spark, rows)).collect()))
    prints = [brute_fingerprint(t) for _, t in rows]
    least = {}
    roots = groups(prints)
    for (i, _), r in zip(rows, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert got == collections.Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, roots))
    kept = simhash.one_of_each(odd_frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "score", "key", "prefix"] and kept.count() == len(set(roots))
    assert {x.doc_id for x in kept.collect()} == set(least.values())


def test_dense_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 40)
    random.seed(0)
    found = set()
    for _ in range(8):
        middle = random.getrandbits(64)
        for _ in range(60):
            one = middle
            for bit in random.sample(range(64), random.randrange(5)):
                one ^= 1 << bit
            found.add(one)
    found = sorted(x - 2**64 if x >= 2**63 else x for x in found)
    edges = simhash.links(spark.createDataFrame([(x,) for x in found], "fp long"))
    got = dict(map(tuple, components(edges).collect()))
    roots = groups(np.array(found, np.int64).view(np.uint64))
    assert [got.get(x, x) for x in found] == [found[r] for r in roots]


def test_long_chain_of_components(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(200, 100), (5, 5)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {k: 0 for k in range(1, 61)} | {200: 100}


@pytest.mark.parametrize("block", [8_000_000, 2000])
@pytest.mark.parametrize("odd", [False, True])
def test_contamination(spark, base, block, odd, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 50_000)
    random.seed(3)
    items = [tuple(x) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = base[:80] + [(5000 + k, base[k][1][:80] + " " + " ".join(random.choice(items)[1].split()[: random.randrange(14)]) + "\n" + base[k][1][:60]) for k in range(60)]
    rows += [(6000, "short one, short  ONE."), (6001, None), (6002, ""), (6003, "the " * 3000), (None, items[3][1]), (6003, "the " * 30), (6003, "the " * 30)]
    if odd:
        items = items + [(900, "Short One"), (901, "of"), (902, ""), (903, None), (904, items[3][1]), (905, "the " * 12), (None, "ever so odd")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        own = words(t)
        for k in range(max(1, len(own) - 9)):
            if own:
                windows[tuple(own[k : k + 10])].add("" if i is None else str(i))
    lengths = {len(x) for x in windows}
    want = []
    for i, t in rows:
        own, hit, found = words(t), set(), set()
        for k in range(len(own)):
            for size in lengths:
                if (window := tuple(own[k : k + size])) in windows and len(window) == size:
                    hit |= set(range(k, k + size))
                    found |= windows[window]
        want.append((i, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    frame, passages = odd_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame, passages).drop("spans")
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    if not odd:
        clean = decontaminate.cleaned(frame, passages)
        assert clean.columns == frame.columns and clean.count() == len(rows)
        assert decontaminate.contamination(clean, passages).where("contaminated").count() == 0


def test_fm_index():
    random.seed(4)
    sequence = np.array([random.randrange(4) for _ in range(500)] + [0])
    index = decontaminate.FmIndex(sequence)
    patterns = np.array([[-1, 1, 2], [3, 1, 2], [1, 1, 1], [-1, -1, 3], [0, 0, 1], [7, 1, 2], [2, 3, 9]])
    low, high = index.search(patterns)
    for pattern, a, b in zip(patterns, low, high):
        own = pattern[pattern >= 0].tolist()
        want = [k for k in range(len(sequence)) if sequence[k : k + len(own)].tolist() == own]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("pairs,shard", [(1_000_000, 16_384), (500, 37)])
def test_search(spark, base, pairs, shard, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    rows = base + [(950, base[0][1]), (951, base[0][1]), (1000, ""), (1050, "zzzzunseen onlyhere")]
    spark.createDataFrame(rows, "doc_id long, text string").toPandas().to_parquet(path := f"/tmp/search-{shard}.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
    want = duckdb.sql(search.SQL).fetchall()
    docs = odd_frame(spark, rows)
    got = [(x.query_id, x.rank, x.doc_id, x.score) for x in search.top_k(docs, docs.where("doc_id % 50 = 0")).collect()]
    assert sorted(got) == sorted(want)


def test_search_odd_rows(spark):
    docs = odd_frame(spark, [(1, "apple pear"), (1, "apple pear"), (None, "apple"), (2, None), (3, ""), (4, "plum")])
    got = search.top_k(docs, docs.where("doc_id IN (1, 2, 3) OR doc_id IS NULL"), k=2).collect()
    assert {x.query_id for x in got} == {1} and len(got) == 2 and {x.doc_id for x in got} == {1}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert search.top_k(none, none).count() == 0 and search.top_k(docs, none).count() == 0


def brute_search(docs, text, k):
    """Scores of the k best documents for one query, and their ids."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    counts = [collections.Counter(words(t)) for _, t in docs]
    df = collections.Counter(x for c in counts for x in c)
    mean, found = sum(c.total() for c in counts) / len(docs), []
    for (i, _), c in zip(docs, counts):
        score = sum(n * np.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for x, n in collections.Counter(words(text)).items() if c[x])
        if score > 0:
            found.append((-round(score, 6), i))
    return [(rank, i, -score) for rank, (score, i) in enumerate(sorted(found)[:k], 1)]


def test_search_repeated_and_retexted_queries(spark):
    # Few documents have a rare word of the query, and others have its frequent words, which together weigh more.
    docs = [(k, "filler " * 12 + f"own{k}") for k in range(400)]
    docs += [(1000 + k, "scarce " + "filler " * 60 + f"other{k}") for k in range(8)]
    docs += [(2000 + k, " ".join(f"often{j}" for j in range(12))) for k in range(30)]
    text = "scarce " + " ".join(f"often{j}" for j in range(12))
    other = "scarce filler"
    asked = [(1, text), (1, text), (1, text), (2, text), (2, other), (2, other)]
    got = search.top_k(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "doc_id long, text string").repartition(4), k=5)
    want = [(i, *x) for i, t in sorted(set(asked)) for x in brute_search(docs, t, 5)]
    assert sorted(map(tuple, got.collect())) == [(i, r, d, pytest.approx(x, abs=2e-6)) for i, r, d, x in sorted(want)]


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    truth = labels.groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = got.join(truth, "doc_id").where("held_out").collect()
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in rows)
    assert all(zlib.crc32(str(x.doc_id).encode()) % 3 == 1 for x in rows)
    right = sum(x.predicted == x.toxic for x in rows) / len(rows)
    assert right >= 0.9
    bad = [x.score for x in rows if x.toxic]
    good = [x.score for x in rows if not x.toxic]
    assert np.mean([[a > b for b in good] for a in bad]) >= 0.9


def test_toxicity_odd_rows(spark):
    docs = odd_frame(spark, [(1, "you idiot"), (1, "you idiot"), (None, None), (2, ""), (3, None), (4, "nice " * 20000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, 1, None), (4, 0, 0), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (none, labels):
        assert toxicity.score(docs, table).count() == 6
        assert toxicity.accepted(docs, table).columns == docs.columns
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    labels, items = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    mild = corpus_pipeline.settle(stages["toxicity"](spark, docs, SMALL))
    bad = {x.doc_id for x in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert mild.columns == names and {x.doc_id for x in mild.collect()} == {x.doc_id for x in docs.collect()} - bad
    lines = corpus_pipeline.settle(stages["line dedup"](spark, mild, SMALL))
    assert lines.columns == names and lines.count() == mild.count() and lines.where("n_chars <> length(text)").count() == 0
    single = corpus_pipeline.settle(stages["near dedup"](spark, lines, SMALL))
    roots = groups([brute_fingerprint(x.text) for x in lines.collect()])
    assert single.columns == names and single.count() == len(set(roots))
    clean = corpus_pipeline.settle(stages["decontamination"](spark, single, SMALL))
    assert clean.columns == names and clean.count() == single.count()
    assert decontaminate.contamination(clean, items).where("contaminated").count() == 0
    ids = stages["byte-level BPE"](spark, clean, SMALL)
    digest = {x.doc_id: hashlib.sha256((x.text or "").encode()).hexdigest() for x in clean.collect()}
    assert {x.doc_id: x.decoded_sha256 for x in ids.collect()} == digest
    assert corpus_pipeline.run(spark, SMALL).count() == clean.count()


def test_pipeline_hands_on_columns_of_any_name(spark, tmp_path):
    """Nulls, empty texts, rows given twice, and columns that have the names of the operators' own; then an empty table."""
    texts = ["one\ntwo\nthree", "one\ntwo\nthree", "", None, "alone here\none", "x" * 100_000]
    rows = [(k, t, f"v{k}", k, k, "w", k) for k, t in enumerate(texts)] + [(None, "one\nno id", "n", 1, 2, "w", 3), (4, texts[4], "v4", 4, 4, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n_lines string, _n_removed int, n_chars int, spans string, _row int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no passage of theirs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        for stage, run in corpus_pipeline.STAGES[:-1]:
            table = corpus_pipeline.settle(run(spark, table, str(tmp_path)))
            assert table.columns == docs.columns, stage
        left = table.collect()
        ids = corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path))
        assert ids.count() == len(left) and (name == "some") == bool(left)
        if left:
            assert {x["_n_lines"] for x in left} <= {r[2] for r in rows}
