"""Operators 11, 12 and 13 beside brute force, with all kinds of odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import main_text, prefix_trie, whitening
from tessera.llm.main_text import Scored

DATA = "/root/testdata/sf0.001"


def trie_rows(turns):
    """Nodes of the trie by plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            first = xxhash.xxh64_intdigest(text.encode(), seed=xxhash.xxh64_intdigest(role.encode(), seed=42))
            own[conv].append(((turn is not None, turn or 0), role, first - 2**64 if first >= 2**63 else first, text))
    own = {c: [(r, t) for _, r, _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    total, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        total[node] = (sum(total[x][0] for x in below[node]) or 1, saved + sum(total[x][1] for x in below[node]))
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        above = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), above, len(convs), len(below[node]), *total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("limit", [1 << 17, 40, 1])
def test_trie(spark, limit):
    random.seed(4)
    rows = [tuple(x) for x in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    texts = ["", "a", "é\U0001f600", None, "long " * 20_000]
    for c in list(range(100, 190)) + [305, 306, 2**40]:
        rows += [(c, t, random.choice(["user", None]), random.choice(texts)) for t in range(random.randrange(1, 9))]
    # Equal conversations, a null turn, turns of one number, a row given twice, rows without a conv_id.
    rows += [(c, t, "system", "same") for c in range(400, 480) for t in range(7)]
    rows += [(500, None, "user", "x"), (500, 3, "user", "y"), (500, 3, "user", "z"), (500, 3, "bot", "y"), (500, 3, "user", "y"), (None, 0, "user", "x"), (None, None, None, None)]
    frame = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, codes string, node int").repartition(5)
    got = prefix_trie.prefix_nodes(frame, limit, 3)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(x) for x in got.collect()) == trie_rows(rows)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_nodes(empty).collect() == []


def whitened(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    centred = x - x.mean(axis=0)
    spread = centred.T @ centred / len(x)
    values, turn = np.linalg.eigh(spread)
    values, turn = values[::-1][:8], turn[:, ::-1][:, :8]
    return x, values, centred @ turn / np.sqrt(values), values / np.trace(spread)


def test_whitening(spark):
    rows = [(i, [float(x) for x in v]) for i, v in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows += [rows[3], (None, rows[4][1]), (rows[5][0], rows[6][1])]
    odd = [(9001, None), (9002, [None] + rows[0][1][1:]), (9003, [float("nan")] + rows[0][1][1:]), (9004, [float("inf")] + rows[0][1][1:]), (9005, [1e300] + rows[0][1][1:]), (9006, []), (9007, [1.0])]
    frame = spark.createDataFrame([(*x, "k", 1) for x in rows + odd], "vec_id long, embedding array<double>, x string, n int").repartition(3)
    got = whitening.whiten(frame).collect()
    x, values, white, share = whitened([v for _, v in rows])
    n, sums = len(rows), x.sum(axis=0)
    far = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-10
    want = Counter((i, k + 1, int(f)) for (i, _), f in zip(rows, far) for k in range(8))
    assert Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["vec_id"], r["deviation"]].append(r)
    sign = np.zeros(8)
    for (i, _), w, f in zip(rows, white, far):
        for r in by[i, int(f)]:
            k = r["component"] - 1
            sign[k] = sign[k] or np.sign(r["whitened"] * w[k])
            assert abs(r["whitened"] * sign[k] - w[k]) < 1e-9 and abs(r["explained"] / share[k] - 1) < 1e-12


@pytest.mark.parametrize("vectors, rank", [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 4.0]] * 3, 1), ([[1.0, 5.0, 2.0], [3.0, 4.0, 0.0], [0.0, 1.0, 9.0], [7.0, 7.0, 1.0]], 3)])
def test_whitening_of_few(spark, vectors, rank):
    got = whitening.whiten(spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id int, embedding array<float>")).collect()
    assert len(got) == rank * len(vectors) and {r["component"] for r in got} == set(range(1, rank + 1))


def test_large_numbers_stay_exact(spark):
    vectors = [[1e9 * k, 3.0 * k * k] for k in range(50)]
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")).collect()
    x = [[int(1024 * c) + 100000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    far = {k: sum((50 * c - s) ** 2 for c, s in zip(v, sums)) for k, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {k: f if f < 2**63 else None for k, f in far.items()}


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &eacute; text", "plain é text"),
        ("<p>a &lt; b &amp c<br>d", "a < b & c d"),
        ("<article><h1>T</h1><p>one\n\t two<b>!</b><p>three</article>", "T\none two!\nthree"),
        ("<div><div class='menu'>x</div><h1>T</h1><div class=content><p>Hello <b>w</b>orld<p>Two</div><div id=comments><p>" + "remark " * 99 + "</div></div>", "T\nHello world\nTwo"),
        ("<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>a<ul><li>1<li>2</ul><aside>x</aside><script>'</p>'</script><article class=comment><p>no</article></article></main><footer>f</footer>", "T\na\n1\n2"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<body><nav><a href=/>n</a></nav><div class='cookie-notice'>c</div><p>kept<form><p>f</form><style>p{}</style><!-- x > y --></body>", "kept"),
        ("<article><p>whole<p>cut of", "whole\ncut of"),
        ("<p>text <div cla", "text"),
        ("<div class='ad'>all there is</div>", "all there is"),
        ("<" * 5000, "<" * 5000),
    ],
)
def test_one_page(html, text):
    found = Scored(html)
    assert found.text(found.best) == text


def test_deep_and_long_pages():
    assert (found := Scored("<div>" * 30_000 + "x")).text(found.best) == "x"
    long = "word " * 1_000_000
    assert (found := Scored(f"<article><p>{long}</p></article>")).text(found.best) == long.strip()


def test_hosts_agree(spark):
    # Remarks without a telling name outweigh the post on one page; the host's other pages say where its posts are.
    post = "<body><div class=top>{0}</div><div class='post p{0}'><p>" + "Post {0}. " * 30 + "</p></div><div class=x>" + "{1}" + "</div></body>"
    rows = [(k, f"https://a.org/{k}", post.format(k, "<p>r</p>")) for k in range(8)] + [(8, "https://A.org:80/8", post.format(8, "<p>remark</p>" * 300))]
    rows += [(20, None, post.format(2, "")), (21, "no url", None), (None, "https://b.org/", "<p>b</p>"), (3, "https://a.org/3", post.format(3, ""))]
    frame = spark.createDataFrame([(*x, "k", 1) for x in rows], "page_id long, url string, html string, path string, host int").repartition(4)
    got = main_text.main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    body = lambda k: ("Post %d. " % k * 30).strip()
    want = [(k, u, body(3 if k == 3 else k if k < 9 else 2)) if h and "post" in h else (k, u, "b" if h else "") for k, u, h in rows]
    assert Counter((r["page_id"], r["url"], r["text"]) for r in got.collect()) == Counter(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert main_text.main_text(frame.limit(0)).collect() == []


def test_given_pages(spark):
    """The article of every given page, as its own markup marks it."""
    import html as library
    import re

    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(library.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(x for x in blocks if x)
    assert {r["page_id"]: r["text"] for r in main_text.main_text(rows).collect()} == want
