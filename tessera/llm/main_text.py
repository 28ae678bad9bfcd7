"""Operator 13: the main text of web pages by paths on which the pages of a host agree.

Each page scores its containers by the text they hold outside links and outside what its tags,
roles and names say is menu, header, footer, sidebar, notice, advert, form or comment, and votes
for the path of its best one. A path is the tags and classes from the root, digits generalised.
Spark adds up the votes of a host; paths with a tenth of them win. Then every page is cut again
at the winning path that it has; a page that has none is cut at its own best container.

Votes are counted before they are shuffled, so a host with a third of all pages costs as many
rows as it has paths. The winners of a host are ten at most. Pages meet their host's winners in
a join that Spark broadcasts if the winners are few and deals out by host, hot ones split, if not.

Defined cases: a null html is the empty page, whose text is empty; a page without a host votes
alone and is cut at its own best container; repeated rows vote as often and are all returned;
page_id and url are handed through, null or not; other columns are not looked at; an empty
table gives no rows. Equal votes go to the path that sorts first, equal scores to the element
that begins first. A line break element is white space. The one h1 of a page that stands before
its container and in no part left out belongs to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from tessera.llm.html_tree import HEADINGS, Page
from tessera.llm.shared import in_small_batches, settle

#: Share of a host's votes that makes a path a winner, and one that beats the path it extends.
WINS, DEEPER = 0.1, 0.25
#: A container gives way to a child with this share of its text.
DESCENDS = 0.8
LEFT_OUT = frozenset("nav footer aside form button select dialog menu svg math template head search fieldset object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CONTAINERS = frozenset("#root html body div section article main td tr tbody table center".split())
#: Words of class and id that name parts that are no article; those of the second row hold for article elements too.
NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside rail widget widgets notice notices notification alert consent gdpr cookie cookies "
    "banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending pagination pager toolbar "
    "skip search masthead topbar paywall".split()
)
NAMES_TOO = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion comment comments commentlist disqus respond reply replies responses".split()
)
HEADER_NAMES, ARTICLE_NAMES = frozenset(["header", "head", "topheader"]), frozenset(["article", "post", "entry", "story"])
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _left_out(page: Page, node: int, within: bool) -> int:
    """2 if the tag leaves an element out, 1 if its names do, 0 if it stays. within: inside an article or main element."""
    tag = page.tag[node]
    if tag in LEFT_OUT or page.role[node] in ROLES or tag == "header" and not within:
        return 2
    if page.hidden[node]:
        return 1
    if page.named[node] and tag not in ("html", "body"):
        words = {x.lower() for x in WORDS.findall(page.named[node])}
        if words & NAMES_TOO or tag not in ("article", "main") and (words & NAMES or not within and words & HEADER_NAMES and not words & ARTICLE_NAMES):
            return 1
    return 0


class Scored:
    """A page with what is left out and the text of each container."""

    def __init__(self, html: str):
        self.page = page = Page(html)
        n = len(page.tag)
        within, hard, soft = [False] * n, [False] * n, [False] * n
        for node in range(1, n):
            parent = page.parent[node]
            inside = within[node] = within[parent] or page.tag[node] in ("article", "main")
            left = 2 if hard[parent] else _left_out(page, node, inside)
            hard[node], soft[node] = left == 2, soft[parent] or left > 0
        kept = any(not soft[x] for x, _, _ in page.blocks)
        #: Names alone never leave out all that a page has.
        self.out = soft if kept else hard
        score = self.score = [0] * n
        for node, text, linked in page.blocks:
            if not self.out[node] and 2 * linked < len(text):
                score[node] += len(text)
        for node in range(n - 1, 0, -1):
            score[page.parent[node]] += score[node]
        self.best = self._best()

    def _below(self, top: int, tag: str) -> list[int]:
        """Outermost elements of a tag inside top that have text."""
        inside, found = [False] * len(self.score), []
        inside[top], taken = True, [False] * len(self.score)
        for node in range(top + 1, len(self.score)):
            parent = self.page.parent[node]
            inside[node], taken[node] = inside[parent], taken[parent]
            if inside[node] and not taken[node] and self.page.tag[node] == tag and self.score[node] and not self.out[node]:
                found.append(node)
                taken[node] = True
        return found

    def _best(self) -> int:
        score, top = self.score, 0
        for tag in ("main", "article"):
            found = self._below(top, tag)
            if found:
                most = max(found, key=lambda x: score[x])
                if len(found) == 1 or 2 * score[most] >= sum(score[x] for x in found):
                    top = most
        if top:
            return top
        best: dict[int, int] = {}
        for node in range(1, len(score)):
            parent = self.page.parent[node]
            if self.page.tag[node] in CONTAINERS and score[node] > score[best.get(parent, node)] - (parent not in best):
                best[parent] = node
        while top in best and score[best[top]] >= DESCENDS * score[top] > 0:
            top = best[top]
        return top

    def at(self, paths: list[tuple[str, float]]) -> int:
        """The element to cut at: by the host's winning paths, those with most votes first, or the page's own best."""
        have: dict[str, int] = {}
        wanted = {x for x, _ in paths}
        for node, path in enumerate(self.page.path):
            if path in wanted and self.score[node] and not self.out[node] and self.score[node] > self.score[have.get(path, 0)] * (path in have):
                have[path] = node
        chosen = next((x for x, _ in paths if x in have), None)
        if chosen is None:
            return self.best
        for path, share in paths:
            if path in have and share >= DEEPER and path.startswith(f"{chosen}/"):
                chosen = path
        return have[chosen]

    def text(self, top: int) -> str:
        page, inside = self.page, [False] * len(self.score)
        inside[top] = True
        for node in range(top + 1, len(inside)):
            inside[node] = inside[page.parent[node]]
        lines = [text for node, text, _ in page.blocks if inside[node] and not self.out[node]]
        titles = [(node, text) for node, text, _ in page.blocks if page.tag[node] == "h1" and not self.out[node]]
        if lines and len(titles) == 1 and not inside[titles[0][0]] and titles[0][0] < top:
            lines.insert(0, titles[0][1])
        return "\n".join(lines)


def host_of(url: str) -> F.Column:
    """The host of a URL in lower case, without user and port; null if it has none."""
    host = F.regexp_extract(F.lower(F.col(url)), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(F.length(host) > 0, host)


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, n: how many pages of a host have their best container there."""
    rows = in_small_batches(pages).select(host_of(url).alias("host"), F.col(html).alias("html")).where("host IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x.page.path[x.best] if x.score[x.best] else None) for x in map(Scored, (h or "" for h in batch.column(1).to_pylist()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(found, pa.string())], names=["host", "path"])

    return rows.mapInArrow(run, "host string, path string").where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))


def winning_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host and its winning paths with their shares of the votes, most votes first."""
    counts = votes(pages, url, html)
    total = counts.groupBy("host").agg(F.sum("n").alias("total"))
    won = counts.join(total, "host").where(F.col("n") >= WINS * F.col("total"))
    order = F.struct((-F.col("n")).alias("less"), F.col("path"), (F.col("n") / F.col("total")).alias("share"))
    return won.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("paths"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    # Written first, so that Spark knows their size when it plans the join and leaves the pages where they are if it is small.
    winners = settle(winning_paths(pages, url, html)).withColumnRenamed("host", "_host")
    rows = in_small_batches(pages).select(F.col(page_id).alias("_page"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    rows = rows.join(winners, host_of("_url") == F.col("_host"), "left").select("_page", "_url", "_html", "paths")
    fields = [("page_id", pages.schema[page_id].dataType), ("url", pages.schema[url].dataType), ("text", T.StringType()), ("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(a, b) for a, b in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                found = Scored(source or "")
                texts.append(found.text(found.at([(x["path"], x["share"]) for x in paths or []])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, schema)
