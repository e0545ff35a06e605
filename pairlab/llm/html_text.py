"""Main text of web pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from math import log1p
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How elements act in a page.
UNSEEN = frozenset(
    "head script style noscript template svg math canvas iframe object select option datalist "
    "button textarea audio video map".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark "
    "q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
SECTIONS = frozenset("article main section nav aside header footer form body".split())

# Classifier weights in log-odds: above zero speaks for content.
IN_ARTICLE, IN_MAIN = 4.0, 2.5
ELEMENT = {
    "nav": -7.0, "footer": -7.0, "aside": -6.0, "form": -7.0, "menu": -6.0, "dialog": -6.0,
    "header": -4.0,
}
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLE = {
    "navigation": -7.0, "banner": -5.0, "contentinfo": -7.0, "complementary": -6.0, "search": -7.0,
    "form": -7.0, "alert": -6.0, "dialog": -6.0, "main": 2.5, "article": 4.0,
}
BAD_NAME = re.compile(
    r"^(ads?|adverts?|advertisement|advertising|banner|sponsor(ed)?|promo(tion)?|nav(bar|igation)?|"
    r"menu|breadcrumbs?|sidebar|aside|widget|footer|header|masthead|comments?|reply|replies|respond|"
    r"disqus|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"search|share|sharing|social|related|recommended|toolbar|pagination|pager|copyright|legal|"
    r"disclaimer|skip|hidden)$"
)
# Parts of a class or identifier that only place or frame what the others name.
PLACE = frozenset(
    "site page main top bottom left right primary secondary area box list links container section "
    "block bar".split()
)
# Last parts that tell what a name is of whatever stands before them, but for a state of the page.
TELLING = re.compile(r"^(comments?|reply|replies|ads?|adverts?|advertisement|sponsor(ed)?|newsletter|cookies?)$")
STATE = frozenset("has no with without is not hide show allow enable disable".split())
ADVERT = re.compile(r"^(ads?|adverts?|advertisement|sponsor(ed)?)$")
SLOT = frozenset("slot unit space holder placeholder wrap wrapper label zone".split())
BAD_NAME_COST = -8.0
HIDDEN_COST = -12.0
LINK_COST = -4.0
ADJACENT, NEAR = 1.5, 0.5  # capacities between blocks: in page order, and within a section

_NAME = re.compile(r"[a-z]+")
_HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_END = re.compile(r"[.!?…:;。]")


def bad_name(value: str) -> bool:
    """Whether a whole class or identifier of ``value`` names boilerplate, not only mentions it.

    All its parts do, or its last one tells, as in ``user-comments``, or it is a place for adverts, as
    ``ad-slot``. ``has-comments`` and ``comments-open`` are states of what bears the name.
    """
    for token in value.split():
        parts = [x for x in _NAME.findall(token) if x not in PLACE]
        if not parts:
            continue
        if all(map(BAD_NAME.match, parts)):
            return True
        if TELLING.match(parts[-1]) and not STATE & set(parts):
            return True
        if ADVERT.match(parts[0]) and all(p in SLOT for p in parts[1:]):
            return True
    return False


class Block(NamedTuple):
    text: str
    score: float
    apart: int  # block elements on the way from the block before
    parent: int  # number of the element around the innermost block element
    bare: bool = False  # straight in the body


RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*|=")
_BARE = re.compile(r"[^\s>]+")


def _attributes(html: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """Attributes of the tag whose name ends at ``at``, and the place behind the tag."""
    out, n = [], len(html)
    while True:
        at = _SPACE.match(html, at).end()
        if at >= n or html[at] == ">":
            return out, at + 1
        m = _ATTRIBUTE.match(html, at)
        name, at = m.group().lower(), m.end()
        value = ""
        after = _SPACE.match(html, at).end()
        if after < n and html[after] == "=":
            at = _SPACE.match(html, after + 1).end()
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return out, n  # an open quote takes the rest of the page
                value, at = html[at + 1 : end], end + 1
            elif (m := _BARE.match(html, at)) is not None:
                value, at = m.group(), m.end()
        out.append((name, value))


class _Open(NamedTuple):
    tag: str
    number: int
    score: float  # log-odds of this element and all around it
    named: float  # the share of names in it
    block: int  # block elements around it, itself included
    parent: int  # number of the block element around the innermost one
    inner: int  # number of the innermost block element, itself included


class _Page:
    """Splits a page into blocks: the text between the bounds of block elements.

    One pass from left to right; nothing is looked for twice, so the work grows with the page.
    """

    def __init__(self):
        self.blocks: list[Block] = []
        self.root = _Open("", 0, 0.0, 0.0, 0, 0, 0)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked = 0
        self.count = 0
        self.unseen = 0
        self.held = False  # whether an article or main element has begun
        self.lowest = 0  # fewest open block elements since the last block
        self.depth = 0  # open block elements at the last block

    def top(self) -> _Open:
        return self.stack[-1] if self.stack else self.root

    def flush(self):
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.top()
            score = top.score
            if self.open["article"]:
                score += IN_ARTICLE
            elif self.open["main"]:
                score += IN_MAIN
            score += LINK_COST * min(1.0, self.linked / len(text))
            score += 0.5 * log1p(len(text) / 40)
            if _END.search(text):
                score += 0.5
            if self.open["p"] or any(self.open[h] for h in HEADING):
                score += 0.5
            low = min(self.lowest, top.block)
            apart = self.depth + top.block - 2 * low
            bare = top.tag in ("", "html", "body")
            self.blocks.append(Block(text, score - 0.5, apart, top.parent, bare))
            self.depth = self.lowest = top.block
        self.parts = []
        self.linked = 0

    def leave_head(self):
        """An open head ends at the first thing that cannot be in one, unless metadata holds it."""
        if self.open["head"] and self.unseen == 1:
            self.close_to(("head",), frozenset())

    def start(self, tag, attrs):
        if tag not in HEAD_ONLY and tag not in ("html", "head"):
            self.leave_head()
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self.close_to(("p",), SECTIONS)
        elif tag in SELF_CLOSING:
            self.close_to(SELF_CLOSING[tag], frozenset(("ul", "ol", "dl", "table", "select", "menu")))
        score = ELEMENT.get(tag, 0.0)
        if tag == "header" and (self.open["article"] or self.open["main"]):
            score = 0.0  # the head of an article is its own
        # An article is not named after boilerplate by its layout, nor is its own header.
        exempt = tag in ("body", "html", "article", "main")
        exempt |= tag == "header" and bool(self.open["article"] or self.open["main"])
        named = 0.0
        hidden = False
        for name, value in attrs:
            value = value.lower()
            if name in ("class", "id"):
                if value == "legal" and self.open["article"]:
                    continue  # a subject of the article
                if not exempt and bad_name(value):
                    named += BAD_NAME_COST
            elif name == "role":
                score += ROLE.get(value.strip(), 0.0)
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                hidden = True
            elif name == "style" and _HIDE.search(value):
                hidden = True
        if hidden:
            score += HIDDEN_COST
        self.count += 1
        top = self.top()
        around = top.named
        if tag == "main" or (tag == "article" and not self.held):
            around = 0.0  # what wraps it; articles that follow may be comments or teasers
        self.held |= tag in ("article", "main")
        score += top.score - top.named + around + named
        if tag in INLINE:
            at = top.block, top.parent, top.inner
        else:
            at = top.block + 1, top.inner, self.count
        self.stack.append(_Open(tag, self.count, score, around + named, *at))
        self.open[tag] += 1
        self.unseen += tag in UNSEEN

    def close_to(self, tags, bounds):
        """Close the innermost of ``tags`` and all within it, unless an element of ``bounds`` is nearer."""
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i].tag
            if tag in tags:
                while len(self.stack) > i:
                    gone = self.stack.pop()
                    self.open[gone.tag] -= 1
                    self.unseen -= gone.tag in UNSEEN
                self.lowest = min(self.lowest, self.top().block)
                return
            if tag in bounds:
                return

    def end(self, tag):
        if tag not in INLINE:
            self.flush()
        if self.open[tag]:
            self.close_to((tag,), ENDS_P | SECTIONS if tag in INLINE else frozenset())

    def data(self, text):
        if text.strip():
            self.leave_head()
        if not self.unseen:
            text = unescape(text)
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(text)

    def feed(self, html: str):
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.data(html[at:])
                break
            if lt > at:
                self.data(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if after == "!" or after == "?":
                comment = html.startswith("<!--", lt)
                end = html.find("-->", lt + 2) if comment else html.find(">", lt)
                at = n if end < 0 else end + (3 if comment else 1)
            elif after == "/":
                m = _TAG_NAME.match(html, lt + 2)
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
                if m:
                    self.end(m.group().lower())
            elif (m := _TAG_NAME.match(html, lt + 1)) is not None:
                tag = m.group().lower()
                attrs, at = _attributes(html, m.end())
                if tag in RAW:
                    close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                    end = html.find(">", close.end()) if close else -1
                    at = n if end < 0 else end + 1
                    if tag not in INLINE:
                        self.flush()
                else:
                    self.start(tag, attrs)
            else:
                self.data("<")
                at = lt + 1
        self.flush()


def blocks(html: str | None) -> list[Block]:
    """The visible blocks of a page in order; null has none."""
    page = _Page()
    page.feed(html or "")
    if all(b.bare for b in page.blocks):
        # a page of nothing but bare text has no parts to choose from
        return [b._replace(score=b.score + 0.5) for b in page.blocks]
    return page.blocks


def _edges(items: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness capacities: neighbours in page order, and the next block of the same parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(items):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + b.apart)))
        if last.get(b.parent, i - 1) != i - 1:
            out.append((last[b.parent], i, NEAR))
        last[b.parent] = i
    return out


def content_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the content side of a minimum cut.

    A block's log-odds are its capacity to the content terminal if positive, else to the
    boilerplate terminal, so a cut costs what it overrules. Dinic's algorithm over layers.
    """
    n = len(scores)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a, b, forth, back):
        graph[a].append(len(to))
        to.append(b)
        cap.append(forth)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(scores):
        if x > 0:
            edge(s, i, x, 0.0)
        elif x < 0:
            edge(i, t, -x, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            # what the content terminal still reaches; blocks no terminal claims are boilerplate
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(graph[v]):
                e = graph[v][at[v]]
                if cap[e] > tiny and level[to[e]] == level[v] + 1:
                    path.append(e)
                    v = to[e]
                    break
                at[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1


def main_text(html: str | None) -> str:
    """The page's content blocks, one to a line; empty if there are none."""
    found = blocks(html)
    if not found:
        return ""
    chosen = content_side([b.score for b in found], _edges(found))
    return "\n".join(b.text for b, c in zip(found, chosen) if c)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every row.

    A null or empty page, and one without content, has an empty text. Null identifiers and
    repeated rows come back as they came in; other columns are ignored. Each page is settled
    in its own row, so nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=[id_col, url_col, "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, F.col(html_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint"
    )
