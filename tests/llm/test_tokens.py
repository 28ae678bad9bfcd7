"""Operators 5, 6 and 10 beside the libraries whose results they give."""

import base64
import hashlib
import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, direct_codes, token_counts
from tessera.llm.pieces import pieces

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(2)
    signs = list("ab's t\n\t\r'llvemd1²é,.’　日本\x85\x1c") + ["<|endoftext|>", "  ", "​", "Ꟛ"]
    texts = ["".join(random.choices(signs, k=random.randrange(30))) for _ in range(400)]
    texts += ["".join(random.choices("ab", k=random.randrange(600))) for _ in range(40)]
    texts += ["", None, "a" * 3000, "é" * 700, "\n" * 700, "x <|endoftext|> y<|endoftext|><|endoftext|>", "word " * 3000]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    return [*enumerate(texts), (None, "no id"), (None, None), (5, "again"), (5, "again"), (3, "other text")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, _text int").repartition(4)


def test_pieces():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    random.seed(3)
    for _ in range(5000):
        text = "".join(random.choices("ab's t\n\t'llvemd1²é,.’ 　", k=random.randrange(14)))
        assert pieces(text) == pattern.findall(text)


def test_encode_and_decode(frame, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(x) for x in byte_bpe.encode_digests(frame, RANKS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_counts(frame, rows):
    library = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    got = [tuple(x) for x in token_counts.count_tokens(frame, VOCABULARY).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_codes(spark, frame, rows, monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/codes"
    direct_codes.write_codes(frame, VOCABULARY, path)
    got = direct_codes.read_codes(spark, path).orderBy("start").collect()
    assert [x.doc_id for x in got] == sorted((i for i, _ in rows), key=lambda x: -1 if x is None else x)
    assert [x.start for x in got] == [0, *np.cumsum([x.n_tokens for x in got])[:-1].tolist()]
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted([(x.doc_id, x.n_tokens, x.ids_crc32) for x in got], key=str) == sorted(want, key=str)
    whole = np.concatenate([np.frombuffer(x.ids, "<u4") for x in got])
    places = [0, 1, 77, len(whole) // 2, len(whole) - 1]
    asked = spark.createDataFrame([(x,) for x in places], "place long")
    assert dict(map(tuple, direct_codes.tokens_at(spark, path, asked).collect())) == {x: int(whole[x]) for x in places}


def test_codes_of_one_id_are_dealt_out(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/codes"
    docs = spark.createDataFrame([(None, f"text number {k}") for k in range(300)] + [(7, f"seven {k}") for k in range(300)], "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        direct_codes.write_codes(docs, VOCABULARY, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # Of four parts, both ids have more than one; before, all rows of an id were in the same.
    assert spark.read.parquet(f"{path}/codes").select("part").distinct().count() > 2
    got = direct_codes.read_codes(spark, path).orderBy("start").collect()
    assert [x.doc_id for x in got] == [None] * 300 + [7] * 300


def test_levels():
    for ids in ([0], [255, 256], [1 << 31, 5, 70000, 255], list(range(1000))):
        ids = np.array(ids, np.uint32)
        codes = direct_codes.Codes(*direct_codes.split_levels(ids))
        assert (codes.at(np.arange(len(ids))) == ids).all()
        for begin in range(0, len(ids) + 1, max(1, len(ids) // 7)):
            for end in range(begin, len(ids) + 1, max(1, len(ids) // 5)):
                assert (codes.stretch(begin, end) == ids[begin:end]).all()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_digests(none, RANKS).count() == 0 and token_counts.count_tokens(none, VOCABULARY).count() == 0
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/codes"
    direct_codes.write_codes(none, VOCABULARY, path)
    assert direct_codes.read_codes(spark, path).count() == 0
