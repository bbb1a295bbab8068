"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks in a tree of elements. A classifier gives each block a cost of either label, which are
the capacities of its terminal edges; neighbours in the page, and neighbours among the blocks of one container, are
joined by smoothness edges, the stronger the more of their elements they share. The minimum cut, found as a maximum flow,
separates content from boilerplate: a short line among paragraphs stays with them, a long notice among links goes.

Tags and names of elements are evidence of bounded cost, not verdicts. What speaks against an element is dropped where
the element holds most of the page's prose and nothing outside it is said to be the main part (a form around the whole page,
a class name that happens to say "share"); beyond that they are features like links, length, sentences, the place of
the block's container, and what readers' comments look like.

The classifier is a logistic regression, fitted here once a worker on pages made up from templates with known labels
(`training_pages`), where marks such as <article> or class names are left out at random, so that the text's own
features count as well."""

from __future__ import annotations

import math
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import freeing, sliced

#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object audio video canvas button select textarea input datalist".split())
#: What may begin in an open <head>; RAW elements, while open, hold whatever comes.
RAW = frozenset("noframes noscript script style template title".split())
HEAD = RAW | frozenset("base basefont bgsound head html link meta".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup caption td th tr tbody thead tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements and words in names that speak against content; the strong ones also hold for all that lies in them.
STRONG_TAGS, WEAK_TAGS = frozenset("nav footer aside menu dialog search".split()), frozenset("form header".split())
NAME = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
STRONG_NAMES = re.compile(NAME % "ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|nav|navbar|navigation|menu|breadcrumbs?|complementary|contentinfo|masthead|topbar|footer|sidebar|related|recommend(?:ed|ations)?|cookies?|consent|gdpr|newsletter|subscribe|subscription|signup|login|comments?|commentlist|replies|reply|respond|disqus|pagination|pager|copyright|outbrain|taboola", re.I)
WEAK_NAMES = re.compile(NAME % "promo(?:tion)?|header|foot|side|aside|widget|share|sharing|social|notice|notification|alert|popup|modal|overlay|form|search|discussion|tags?|byline|legal|disclaimer|skip|toolbar", re.I)
GOOD_NAMES = re.compile(NAME % "article|content|main|body|post|entry|story|text|prose|page", re.I)
LEGAL = re.compile(r"©|\bcookies?\b|all rights reserved|\bcopyright\b|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log in|advertis|sponsored|accept all|javascript", re.I)
#: A line that stands above readers' comments, and what a comment's own first line says.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader )?(?:comments?|responses?|replies|reactions|discussion|leave a (?:comment|reply)|join the discussion|kommentare?|comentarios?|commentaires?|antworten|respuestas|réponses)\W*(?:\d+)?\W*", re.I)
SAYS = re.compile(r"\b(?:says|said|wrote|writes|replied|commented|posted|ago|schrieb|escribió|dijo|a écrit)\b.{0,40}$", re.I)
SPACE = re.compile(r"[\s\x1c-\x1f]+")
ENDS = (".", "!", "?", "…", "。", ".”", ".\"", "!\"", "?\"")
#: Strength of smoothness between neighbours on the page, and between neighbours in one container.
ADJACENT, NEARBY = 0.8, 0.6
#: How much of it is left where only one of two neighbours lies in what its marks speak against.
BORDER = 0.25
#: Costs are kept within this many natural units.
MOST = 6.0
#: An element that holds this share of the page's prose, or so much for strong marks, isn't boilerplate by its name or tag alone.
HOLDS, HOLDS_STRONG = 0.5, 0.9
#: A container is the page's main one if none of its parts holds as much of its prose.
PART = 0.75


class Element:
    """An element that was open: its place among all, its parent's, how deep it lies, its tag and names, and whether it hides
    what it holds."""

    __slots__ = ("depth", "hides", "names", "number", "parent", "tag")

    def __init__(self, number: int, tag: str, names: str, parent: int, depth: int, hides: bool = False):
        self.number, self.tag, self.names, self.parent, self.depth, self.hides = number, tag, names, parent, depth, hides


class Block:
    """A run of text: the element that it ends in, its innermost block element's tag and container, and how deep the elements
    reach that it shares with the block before."""

    __slots__ = ("container", "linked", "owner", "shared", "tag", "text")

    def __init__(self, text: str, tag: str, owner: Element, container: int, linked: int, shared: int):
        self.text, self.tag, self.owner, self.container, self.linked, self.shared = text, tag, owner, container, linked, shared


class Blocks(HTMLParser):
    """Collects text blocks: text between starts and ends of block elements, <br> counting as white space.

    Open elements are kept with the places of each name and of all block elements, so that a tag costs the same however
    deep the page is nested."""

    def __init__(self, shown: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.shown = shown
        self.never_closed: set[int] = set()
        self.all = [Element(0, "", "", 0, 0)]
        self.open = [self.all[0]]
        self.places: dict[str, list[int]] = {}
        self.holders: list[int] = []
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.low = 0

    def flush(self) -> None:
        if not self.parts:
            return
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            holder = self.open[self.holders[-1]] if self.holders else self.all[0]
            self.found.append(Block(text, holder.tag, self.open[-1], holder.parent, min(self.linked, len(text)), self.low))
            self.low = len(self.open) - 1
        self.parts, self.linked = [], 0

    def close_to(self, at: int) -> None:
        for k, x in enumerate(self.open[at:]):
            if x.number:
                self.places[x.tag].pop()
            self.hidden -= x.hides
            if k and x.hides and x.tag not in RAW:
                self.never_closed.add(x.number)
        while self.holders and self.holders[-1] >= at:
            self.holders.pop()
        del self.open[at:]
        self.low = min(self.low, at - 1)

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def end_head(self) -> None:
        """Closes a <head> left open, as browsers do where something begins that can't stand in it."""
        at = self.last("head")
        if at >= 0 and at > max(self.last(x) for x in RAW):
            self.close_to(at)

    def handle_starttag(self, tag, attrs):
        if self.hidden and tag not in HEAD:
            self.end_head()
        if tag == "br" or tag == "wbr":
            self.parts.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            self.flush()
            if tag in CLOSES_P and self.holders and self.open[self.holders[-1]].tag == "p":
                self.close_to(self.holders[-1])
            while len(self.open) > 1 and self.open[-1].tag not in BLOCK and self.open[-1].tag not in HIDDEN:
                self.close_to(len(self.open) - 1)  # an inline element ends where a block begins
            top = self.open[-1].tag
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and (top == tag or {top, tag} <= {"dt", "dd"} or {top, tag} <= {"td", "th"}):
                self.close_to(len(self.open) - 1)
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role", "aria-label", "itemprop") and v)
        element = Element(len(self.all), tag, names, self.open[-1].number, len(self.open), tag in HIDDEN and len(self.all) not in self.shown)
        self.all.append(element)
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.holders.append(len(self.open))
        self.open.append(element)
        self.hidden += element.hides

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "iframe", "object"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        at = self.last(tag)
        if at >= 0 and (tag in BLOCK or tag in HIDDEN or not self.holders or self.holders[-1] <= at):
            self.close_to(at)

    def handle_data(self, data):
        if self.hidden and data.strip(" \t\n\f\r"):
            self.end_head()
        if not self.hidden:
            self.parts.append(data)
            if self.places.get("a"):
                self.linked += len(data)

    def unknown_decl(self, data):
        pass


def parsed(html: str) -> Blocks:
    """The page's blocks and elements. What never gets an end of its own hides nothing, scripts, styles and the like aside:
    a page isn't lost to a <button> that is left open."""
    shown: frozenset[int] = frozenset()
    while True:
        parser = Blocks(shown)
        parser.feed(html)
        parser.close()
        parser.flush()
        parser.close_to(0)
        if not parser.never_closed:
            return parser
        shown |= parser.never_closed


def blocks_of(html: str) -> list[Block]:
    return parsed(html).found


@lru_cache(maxsize=4096)
def name_marks(names: str) -> tuple[bool, bool, bool]:
    """(strong, weak, good)"""
    return bool(STRONG_NAMES.search(names)), bool(WEAK_NAMES.search(names)), bool(GOOD_NAMES.search(names))


#: What an element's marks come to: against content by tag or name, strongly or weakly; nothing; for it by name or tag.
AGAINST, NOTHING, NAMED, STATED = -1, 0, 1, 2


class Marks:
    """For each element what its own and its ancestors' tags and names come to, and how much of the page's prose it holds."""

    def __init__(self, page: Blocks):
        elements, blocks = page.all, page.found
        prose = [len(b.text) * (1 - b.linked / len(b.text)) * (1.0 if b.text.endswith(ENDS) or len(b.text) > 200 else 0.25) for b in blocks]
        n = len(elements)
        self.mass, claimed = [0.0] * n, [0.0] * n
        own: list[tuple[int, bool, bool]] = []
        for x in elements:
            strong, weak, good = name_marks(x.names) if x.names else (False, False, False)
            strong_tag, weak_tag = x.tag in STRONG_TAGS, x.tag in WEAK_TAGS
            kind = AGAINST if strong or weak or strong_tag or weak_tag else STATED if x.tag in ("article", "main") else NAMED if good else NOTHING
            own.append((kind, strong or strong_tag, strong_tag or weak_tag))
        for b, m in zip(blocks, prose, strict=True):
            self.mass[b.owner.number] += m
        for x in reversed(elements[1:]):
            self.mass[x.parent] += self.mass[x.number]
            if own[x.number][0] in (NAMED, STATED):
                claimed[x.number] = self.mass[x.number]
            if own[x.number][0] != AGAINST:
                claimed[x.parent] += claimed[x.number]
            else:  # what lies in it claims nothing for the page around it, unless it turns out to be the page
                claimed[x.number] = 0.0
        total = self.mass[0] or 1.0
        self.end = list(range(n))  # an element's descendants have the numbers up to this
        for x in reversed(elements[1:]):
            self.end[x.parent] = max(self.end[x.parent], self.end[x.number])
        self.state, self.strong, self.by_tag, self.headed = [NOTHING] * n, [False] * n, [False] * n, [False] * n
        for x in elements[1:]:
            kind, strong, by_tag = own[x.number]
            if kind == AGAINST and self.mass[x.number] >= (HOLDS_STRONG if strong else HOLDS) * total and claimed[0] <= 0:
                kind = STATED if x.tag in ("article", "main") else NAMED if name_marks(x.names)[2] else NOTHING
            above = x.parent
            self.headed[x.number] = x.tag == "header" and self.state[above] == STATED and not strong or x.tag != "header" and self.headed[above]
            if self.strong[above] or kind == NOTHING:
                self.state[x.number], self.strong[x.number], self.by_tag[x.number] = self.state[above], self.strong[above], self.by_tag[above]
            else:
                self.state[x.number], self.strong[x.number], self.by_tag[x.number] = kind, kind == AGAINST and strong, by_tag
        self.main = 0
        below: dict[int, int] = {}
        for x in elements[1:]:
            best = below.get(x.parent)
            if best is None or self.mass[x.number] > self.mass[best]:
                below[x.parent] = x.number
        while (k := below.get(self.main)) is not None and elements[k].tag not in HEADINGS and elements[k].tag != "p" and self.mass[k] >= PART * self.mass[self.main] > 0:
            self.main = k
        self.inside = [False] * n
        for x in elements:
            self.inside[x.number] = x.number == self.main or x.number > 0 and self.inside[x.parent]
        self.share = self.mass[self.main] / total


FEATURES = ("bias", "stated", "named", "against_tag", "against_name", "strongly", "link_share", "log_length", "short", "sentences", "heading", "item", "legal", "first", "last", "elsewhere", "labelled", "card")


def features(page: Blocks) -> np.ndarray:
    blocks, marks = page.found, Marks(page)
    out, label = [], -1
    around = [b.container if b.tag in ("p", "blockquote", "li", "ul", "ol") else _holder(page, b) for b in blocks]
    first: dict[int, int] = {}
    for i, k in enumerate(around):
        first.setdefault(k, i)
    for i, b in enumerate(blocks):
        n, number = len(b.text), b.owner.number
        state, text = marks.state[number], b.text
        if state == AGAINST and b.tag in HEADINGS and marks.headed[number]:
            state = STATED
        ends = text.count(". ") + text.count("! ") + text.count("? ") + text.count("。") + text.endswith(ENDS)
        free = state <= NOTHING
        if n < 60 and COMMENTS.fullmatch(text) and (b.tag in HEADINGS or n < 30) and i:
            label = i
        behind = label >= 0 and blocks[label].container <= number <= marks.end[blocks[label].container]
        away = 0.0 if marks.inside[number] or marks.share < PART else marks.share
        lead = blocks[first[around[i]]]
        card = first[around[i]] > 0 and lead.tag not in HEADINGS and len(lead.text) < 60 and not lead.text.endswith(ENDS) and (away > 0 or bool(SAYS.search(lead.text)))
        out.append((1, state == STATED, state == NAMED, state == AGAINST and marks.by_tag[number], state == AGAINST and not marks.by_tag[number], state == AGAINST and marks.strong[number], b.linked / n, math.log(n) / 5, n < 25, min(ends, 5) / 5, b.tag in HEADINGS, b.tag in ("li", "option", "td", "th", "dt"), n < 400 and bool(LEGAL.search(text)), i == 0 and free and b.tag not in HEADINGS, i == len(blocks) - 1 and free, away, behind, card))
    return np.array(out, float).reshape(len(blocks), len(FEATURES))


AGAINST_TAG, AGAINST_NAME = FEATURES.index("against_tag"), FEATURES.index("against_name")


def _holder(page: Blocks, b: Block) -> int:
    """The block element that a block is in."""
    x = b.owner
    while x.number and x.tag not in BLOCK:
        x = page.all[x.parent]
    return x.number


def training_pages(pages: int = 700, seed: int = 7) -> Iterator[tuple[Blocks, list[int]]]:
    """Made-up pages with a label for each block, told by a mark in its text that is then taken off."""
    r = random.Random(seed)
    syllables = "ra te mo li sen dor ka vi pel tun gra fo shi ber ne lo qua ster in ald".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    line = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    prose = lambda: (" ".join(line(4, 16) + "." for _ in range(r.choice((1, 1, 2, 3, 4, 6)))) if r.random() < 0.9 else line(1, 2) + r.choice((".", "")))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">0{line(1, 3)}</a></li>' for _ in range(n)) + "</ul>"

    def paragraph(tag: str = "p") -> str:
        return f"<{tag}>1{prose()}</{tag}>" if r.random() < 0.9 else r.choice((f"<h2>1{line(2, 6)}</h2>", f"<ul><li>1{line(3, 12)}.</li><li>1{line(2, 9)}</li></ul>", f"<blockquote>1{prose()}</blockquote>"))

    def comment(lead: str) -> str:
        who = r.choice((f"0{word()}", f"0{word()} {word()}", f"0{word()} says:", f"0{word()} wrote:", f"0{word()}, {r.randint(2, 20)} days ago"))
        text = " ".join(line(3, 12) + "." for _ in range(r.randint(1, 3)))
        return f"<div{lead}><{(t := r.choice(('b', 'strong', 'span', 'cite', 'h4', 'p')))}>{who}</{t}><p>0{text}</p></div>"

    for _ in range(pages):
        bare, solo = r.random() < 0.4, r.random() < 0.25
        marked = not bare and r.random() < 0.8
        named = lambda kind: f' class="{r.choice(kind)}"' if not bare and r.random() < 0.8 else ""
        wrap = lambda tag, kind, inner: f"<{tag if marked else 'div'}{named(kind)}>{inner}</{tag if marked else 'div'}>"
        body = [f"<h1>1{line(3, 9)}</h1>"] if r.random() < 0.8 else []
        tag = r.choice(("p", "p", "p", "div"))
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.08:
                body.append(f"<section><h2>1{line(2, 6)}</h2>" + "".join(paragraph(tag) for _ in range(r.randint(1, 3))) + "</section>")
            else:
                body.append(paragraph(tag))
        if not bare and r.random() < 0.3:
            body.insert(r.randint(0, len(body)), f"<div{named(['ad', 'advert', 'related-box', 'newsletter', 'share-bar']) or ' class="promo"'}>0{line(2, 12)}.</div>")
        parts = [wrap("header", ["masthead", "top-bar header", "site-header"], f"<p>0{line(1, 4)}</p>") if not solo and r.random() < 0.8 else "", wrap("nav", ["menu", "main-nav", "navbar"], links(r.randint(3, 9))) if not solo and r.random() < 0.9 else ""]
        parts.append(f"<div{named(['ad', 'banner-ad', 'sponsored'])}>0{line(4, 12)}.</div>" if not bare and r.random() < 0.6 else "")
        parts.append(f"<div{named(['cookie-notice', 'notice', 'alert'])}>0{r.choice(('We use cookies. ', 'Subscribe to our newsletter. ', '')) if not bare else 'We use cookies. '}{prose()}</div>" if r.random() < 0.4 else "")
        # comments come behind the article, or at its end, under a line that says so or by themselves
        talk = ""
        if r.random() < 0.5:
            lead = named(["comment", "reply"]) or r.choice(("", ' class="c"', ' class="x"'))
            said = "".join(comment(lead) for _ in range(r.randint(1, 4)))
            told = r.choice((f"<h3>0{r.randint(1, 9)} comments</h3>", "<h2>0Comments</h2>", "<h3>0Responses</h3>", "<p>0Leave a reply</p>", ""))
            if bare and not told:
                lead = ""
            talk = f"<div{named(['comments', 'comment-list', 'replies'])}>{told}{said}</div>" if r.random() < 0.7 or not told else told + said
        inner = talk if talk and "comments" in talk[:40] and r.random() < 0.3 else ""
        main = wrap("article", ["post", "article-body", "content", "entry"], "".join(body) + inner)
        if r.random() < 0.1:
            main = f'<div class="{r.choice(["share-page", "page share", "tag-news", "form-page", "social wide", "legal"])}">{main}</div>'
        parts.append(main)
        parts.append("" if inner else talk)
        parts.append(wrap("aside", ["sidebar", "related", "widget"], f"<h3>0{line(1, 3)}</h3>" + links(r.randint(2, 6))) if r.random() < 0.6 else "")
        if not bare and r.random() < 0.3:
            parts.append(f"<form{named(['search-form', 'newsletter'])}><label>0{line(1, 4)}</label><p>0{line(2, 6)}</p></form>")
        parts.append(wrap("footer", ["footer", "site-footer legal"], f"0{r.choice(('© ', '&copy; 2020 ', '')) if not bare else '© '}{line(2, 9)}{r.choice(('', '. All rights reserved.'))}") if r.random() < (0.4 if solo else 0.9) else "")
        html = "".join(parts)
        if r.random() < 0.1:
            html = f'<form id="f" action="x"><div>{html}</div></form>'
        page = parsed(html)
        labels = [int("1" in b.text[:2]) for b in page.found]
        for b in page.found:
            b.text = re.sub(r"^[01]", "", b.text).strip() or "x"
        yield page, labels


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """Logistic regression by Newton steps with a little shrinkage, over all blocks of the training pages."""
    pages = list(training_pages())
    x = np.concatenate([features(p) for p, _ in pages])
    y = np.concatenate([np.array(labels, float) for _, labels in pages])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1.0 * np.eye(len(w)), x.T @ (y - p) - 1.0 * w)
    return w


def source_side(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes a minimum cut leaves with the source.

    terminal: a node's capacity from the source less its capacity to the sink; what both have in common flows anyway.
    edges: (i, j, capacity) in both directions. Maximum flow by shortest augmenting paths in levels."""
    n = len(terminal)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(terminal):
        if c >= 0:
            join(s, i, c, 0.0)
        else:
            join(i, t, -c, 0.0)
    for i, j, c in edges:
        join(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at, path = [0] * (n + 2), []
        while True:
            a = to[path[-1]] if path else s
            if a == t:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                path = path[: next(k for k, e in enumerate(path) if room[e] <= 1e-9)]
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    path.append(e)
                    break
                at[a] += 1
            else:
                if not path:
                    break
                at[to[path.pop() ^ 1]] += 1


def labelled(page: Blocks) -> list[bool]:
    """True for content."""
    blocks = page.found
    if not blocks:
        return []
    x = features(page)
    costs, against = np.clip(x @ weights(), -MOST, MOST), (x[:, AGAINST_TAG] + x[:, AGAINST_NAME]).tolist()
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            deeper = max(b.owner.depth, blocks[i - 1].owner.depth, 1)
            edges.append((i - 1, i, ADJACENT * max(b.shared, 0) / deeper * (1.0 if against[i] == against[i - 1] else BORDER)))
        if (k := last.get(b.container)) is not None:
            edges.append((k, i, NEARBY * (1.0 if against[i] == against[k] else BORDER)))
        last[b.container] = i
    return source_side(costs.tolist(), edges)


def main_text(html: str | None) -> str:
    page = parsed(html or "")
    return "\n".join(b.text for b, keep in zip(page.found, labelled(page), strict=True) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page: its content blocks in order, one a line, white space inside a block as one space.

    A null or empty page, or one without content, gives an empty text; unclosed and misnested elements are closed as
    browsers do; null ids and URLs, ties and repeated rows keep their rows; empty tables give an empty result; other
    columns are ignored. Nothing is cut off, however long a page is."""
    rows = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), F.coalesce(F.col(html_col), F.lit("")).alias(html_col))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(freeing(extracted), f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")
