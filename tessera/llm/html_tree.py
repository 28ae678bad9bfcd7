"""One pass over a page: its elements, and its text as blocks that belong to them.

Tags, comments and raw elements are found by one pattern, so a page costs time in proportion to
its length whatever it holds. Missing end tags are implied as browsers imply them for
paragraphs, list items, table cells and whatever an end tag further out closes. A page that is
cut off inside a tag loses that tag, not the text before it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from hashlib import md5
from html import unescape

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; none of it is text of the page.
RAW = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in "script style title textarea noscript iframe xmp noembed noframes".split()}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin and end a block of text, and those among them that end an open paragraph.
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes if open, and the elements at which the search for it stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir td th table article section".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl td th table".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl td th table".split())),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: An end tag closes nothing that lies outside the innermost of these, but for the tags of the second row.
CELLS = frozenset(["td", "th", "table", "caption"])
OUTER = frozenset("table tr tbody thead tfoot".split())
#: Elements that only dress text: without attributes they are no element of a page here.
DRESS = frozenset("b i em strong u s small sub sup tt big code mark font".split())
ONLY_P, NOT_P, NONE = frozenset(["p"]), BLOCKS - {"p"}, frozenset()
DIGITS = re.compile(r"\d+")
#: Characters of a path; longer ones go on from a digest of what they had.
PATH = 2000


class Page:
    """Elements by number, parents before children: tag, words of class and id, role, path; blocks of text by element."""

    def __init__(self, html: str):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.named: list[str] = [""]
        self.role: list[str] = [""]
        self.path: list[str] = [""]
        self.hidden: list[bool] = [False]
        #: (element, text, characters of it inside links), in the order of the page.
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]
        self._count: Counter[str] = Counter()
        self._pieces: list[str] = []
        self._linked = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        for_next = TOKEN.search
        while at < end:
            found = for_next(html, at)
            begin = found.start() if found else end
            if begin > at:
                self._text(html[at:begin])
            if not found:
                break
            at = found.end()
            name = found[2]
            if name:
                name = name.lower()
                if found[1]:
                    self._close(name)
                elif name in RAW:
                    over = RAW[name].search(html, at)
                    at = over.start() if over else end
                else:
                    self._start(name, found[3])
        self._flush()

    def _text(self, raw: str) -> None:
        piece = unescape(raw) if "&" in raw else raw
        self._pieces.append(piece)
        if self._count["a"]:
            self._linked += len(piece.strip())

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                owner = self._open[-1]
                while owner and self.tag[owner] not in BLOCKS:
                    owner = self.parent[owner]
                self.blocks.append((owner, text, min(self._linked, len(text))))
            self._pieces, self._linked = [], 0

    def _pop_to(self, size: int) -> None:
        for node in self._open[size:]:
            self._count[self.tag[node]] -= 1
        del self._open[size:]

    def _find(self, names: Iterable[str], stops: frozenset[str]) -> int:
        """The place of the innermost open element of these names, 0 if one of stops comes first."""
        count = self._count
        for name in names:
            if count[name]:
                break
        else:
            return 0
        tags, place = self.tag, len(self._open) - 1
        for node in reversed(self._open):
            tag = tags[node]
            if tag in names:
                return place
            if tag in stops:
                return 0
            place -= 1
        return 0

    def _start(self, name: str, rest: str) -> None:
        if name == "br":
            self._pieces.append(" ")
            return
        if name in DRESS and not rest:
            return
        if name in BLOCKS:
            self._flush()
            place = self._count["p"] and self._find(ONLY_P, NOT_P)
            if place:
                self._pop_to(place)
            if name in IMPLIED:
                place = self._find(*IMPLIED[name])
                if place:
                    self._pop_to(place)
        if name in VOID or name == "hr":
            return
        if name in ("html", "body") and self._count[name]:
            return
        parent, node = self._open[-1], len(self.tag)
        named = role = ""
        step, hidden = name, False
        if rest and not rest.isspace():
            said = {a.lower(): b.strip("\"'") for a, b in ATTRIBUTE.findall(rest)}
            classes = unescape(said.get("class", ""))
            if classes:
                step = ".".join([name, *sorted({DIGITS.sub("#", x) for x in classes.lower().split()})])
            named = f"{classes} {unescape(said.get('id', ''))}".strip()
            role = said.get("role", "").lower()
            hidden = "hidden" in said or "display:none" in said.get("style", "").replace(" ", "").lower()
        above = self.path[parent]
        if len(above) > PATH:
            above = f"/#{md5(above.encode('utf-8', 'replace')).hexdigest()}"
        self.tag.append(name)
        self.parent.append(parent)
        self.named.append(named)
        self.role.append(role)
        self.path.append(f"{above}/{step}")
        self.hidden.append(hidden)
        self._open.append(node)
        self._count[name] += 1

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
            if name in ("html", "body"):
                return
        names = HEADINGS if name in HEADINGS else (name,)
        place = self._find(names, NONE if name in OUTER else CELLS)
        if place:
            if name not in BLOCKS:
                for node in self._open[place + 1 :]:
                    if self.tag[node] in BLOCKS:
                        return
            self._pop_to(place)
