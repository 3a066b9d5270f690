"""Main text of web pages by a minimum cut over their text blocks.

A page falls into blocks of text between block-level tags. A logistic classifier gives
every block finite log-odds of being content; those are its capacities from the source
(content) or to the sink (boilerplate). Edges of smoothness join blocks that follow each
other and blocks that follow each other within one container, the more strongly the
nearer they stand in the tree. The cheapest labelling is a minimum cut, found by
maximum flow. The classifier, and the strength of the edges, are fitted on labelled
pages that a rule makes: their number is a parameter, and no page of the input counts.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: tags without content, with raw text, and that don't part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template svg math canvas object audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br link meta input".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: An opening tag that ends an open element of these, unless one of those stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Raw elements that a page is read on in if they aren't closed.
MEDIA = frozenset("noscript template svg math canvas object audio video".split())
#: Elements and roles that seldom hold an article's text, and words of class or id that say so, or the contrary: features of the classifier.
BOILER_TAGS = frozenset("nav footer aside button select menu dialog head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertisements adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr nav navbar navigation menu submenu breadcrumb "
    "breadcrumbs footer foot sidebar aside widget widgets masthead toolbar topbar pagination pager comment comments commentlist reply replies respond disqus share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login popup modal overlay notice notices alert notification disclaimer copyright search skip".split()
)
CONTENT_WORDS = frozenset("article articlebody content entry post story body main text maintext copy prose".split())
#: Words before a word of class or id that only say what the page has.
HAS = frozenset("has have with without no".split())
#: Made pages that the classifier is fitted on, and as many more that choose the strength of the edges; strengths tried.
FIT_PAGES, STRENGTHS = 300, (0.25, 0.5, 1.0, 2.0)
#: Smoothness of neighbours in page order, and of neighbours in one container, before their strength.
NEXT_EDGE, SIBLING_EDGE = 0.6, 0.8

#: A tag; quotes count behind an equals sign only, and an unclosed one is a character like any other.
_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|<[!?][^>]*+>|</[^>]*+>""", re.S)
#: The same for pages where a quoted value runs to the end.
_BROKEN_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|</[^>]*+>""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Frame:
    """An open element: what holds for all text in it, and a number to know it by."""

    __slots__ = ("tag", "hidden", "boiler", "marks", "main", "content", "link", "heading", "item", "number", "depth", "up")

    def __init__(self, tag: str, up: Frame | None, number: int):
        self.tag, self.up, self.number = tag, up, number
        for name in ("hidden", "boiler", "main", "content", "link", "heading", "item"):
            setattr(self, name, getattr(up, name) if up else False)
        self.depth = up.depth + 1 if up else 0
        #: Numbers of the marked elements around and including this one, and whether they are marked as content too.
        self.marks: tuple[tuple[int, bool], ...] = up.marks if up else ()


class Block:
    __slots__ = ("parts", "frame", "letters", "linked")

    def __init__(self, frame: Frame):
        self.parts, self.frame, self.letters, self.linked = [], frame, 0, 0


_seen: dict[str, tuple[bool, bool, bool, bool, bool]] = {}


def _says(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Of a tag's attributes: not shown, a role of boilerplate, marked as boilerplate, content, header."""
    got = _seen.get(attributes)
    if got is None:
        hidden = role = marked = content = header = False
        for name, *values in _ATTR.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            low = value.lower()
            if name == "role":
                role, content = role or low in BOILER_ROLES, content or low in ("main", "article")
            elif name == "itemprop":
                content = content or low == "articlebody"
            elif name == "style":
                hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", low) is not None
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or low == "true"
            else:
                words: set[str] = set()
                for name in value.split():
                    parts = [w.lower() for w in _WORD.findall(name)]
                    words.update(w for k, w in enumerate(parts) if HAS.isdisjoint(parts[:k]))
                marked = marked or not words.isdisjoint(BOILER_WORDS)
                content = content or not words.isdisjoint(CONTENT_WORDS)
                header = header or "header" in words
        if len(_seen) > 20_000:
            _seen.clear()
        got = (hidden, role, marked, content, header)
        if len(attributes) < 1000:
            _seen[attributes] = got
    return got


def blocks(html: str) -> list[Block]:
    """The page's text blocks in page order; text of raw elements and of elements that aren't shown isn't among them.

    One pass: a tag is looked for once at each ``<``, and closing tags without an open
    element are passed over by a count of the open ones.
    """
    out: list[Block] = []
    number, unclosed, open_ = 0, set(), Counter()
    top = Frame("", None, 0)
    block: Block | None = None
    at, tag_at, last = 0, _TAG.match, html.rfind(">")

    def close(frame: Frame) -> Frame:
        """The element around ``frame``; all inside it end."""
        nonlocal top
        while top is not frame:
            open_[top.tag] -= 1
            top = top.up
        open_[frame.tag] -= 1
        top = frame.up
        return top

    text_from = 0
    while True:
        begin = html.find("<", at) if at <= last else -1
        m = None
        if begin >= 0:
            m = tag_at(html, begin)
            if m is None:
                if tag_at is not _BROKEN_TAG.match and html[begin + 1 : begin + 2].isalpha() and begin < last:
                    tag_at = _BROKEN_TAG.match  # no end but inside quotes: from here on the first > ends a tag
                    m = tag_at(html, begin)
                if m is None:
                    at = begin + 1
                    continue
        end = begin if m else len(html)
        if end > text_from and not top.hidden:
            text = html[text_from:end]
            if "&" in text:
                text = unescape(text)
            if block is None:
                if not text.isspace():
                    frame = top
                    while frame.tag in INLINE and frame.up:
                        frame = frame.up
                    block = Block(frame)
                    out.append(block)
            if block is not None:
                block.parts.append(text)
                block.letters += len(text)
                if top.link:
                    block.linked += len(text)
        if not m:
            return out
        at = text_from = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                frame = top
                while frame.up and frame.tag != tag and (tag not in INLINE or frame.tag in INLINE):
                    frame = frame.up
                if frame.tag == tag and frame.up:
                    close(frame)
            if tag not in INLINE:
                block = None
            continue
        if tag == "br" and block is not None:
            block.parts.append(" ")
        if tag not in INLINE:
            block = None
            if tag in CLOSES_P and open_["p"]:
                frame = top
                while frame.tag in INLINE and frame.up:
                    frame = frame.up
                if frame.tag == "p":
                    close(frame)
            ends, stops = IMPLIED.get(tag, ((), ()))
            if any(open_[t] for t in ends):
                frame, found = top, None
                while frame.up and frame.tag not in stops:
                    if frame.tag in ends:
                        found = frame
                        if frame.tag == "tr" or tag != "tr":
                            break
                    frame = frame.up
                if found:
                    close(found)
        attributes = m[3]
        if tag in VOID or (attributes.endswith("/") and tag in ("svg", "path")):
            continue
        if tag in RAW:
            if tag not in unclosed:
                found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                stop = html.find(">", found.end()) + 1 if found else 0
                if stop or tag not in MEDIA:
                    at = text_from = stop or len(html)
                else:
                    unclosed.add(tag)
            continue
        number += 1
        top = Frame(tag, top, number)
        open_[tag] += 1
        if tag in BOILER_TAGS or (tag == "header" and not top.main):
            top.boiler = True
        elif tag in ("article", "main"):
            top.main = True
        elif tag == "a":
            top.link = True
        elif tag in HEADINGS:
            top.heading = True
        elif tag == "li":
            top.item = True
        marked = content = False
        if attributes and tag != "a" and tag not in ("html", "body"):
            hidden, role, marked, content, header = _says(attributes)
            top.hidden = top.hidden or hidden
            if role or (header and not (top.main or content)):
                top.boiler = True
        if marked or tag == "form":
            mixed = content or tag in ("article", "main")
            if not mixed:
                top.main = top.content = False
            top.marks = (*top.marks[-7:], (number, mixed))
        top.content = top.content or content


FEATURES = ("bias", "main", "content", "boiler", "marked", "mixed", "wrapped", "words", "few_words", "sentence", "marks_inside", "links", "heading", "item")


def features(found: list[tuple[Block, str]]) -> np.ndarray:
    """A row for each block: where it stands and what its text looks like, from 0 to 2 each.

    A marked element counts the less the more of the page's text it holds, and not at
    all if it holds everything; it is then a wrapper.
    """
    held: Counter = Counter()
    total = 0
    for b, _ in found:
        own = b.letters - b.linked
        total += 0 if b.frame.boiler else own
        for number, _ in b.frame.marks:
            held[number] += 0 if b.frame.boiler else own
    rows = np.zeros((len(found), len(FEATURES)))
    for i, (b, text) in enumerate(found):
        f = b.frame
        share = [(min(1.0, 2 * (1 - held[k] / max(total, 1))) ** 2, mixed) for k, mixed in f.marks]
        words = text.count(" ") + 1
        rows[i] = (
            1, f.main, f.content, f.boiler, min(2.0, sum(x for x, mixed in share if not mixed)), min(2.0, sum(x for x, mixed in share if mixed)), bool(share) and max(x for x, _ in share) < 1,
            min(words / 20, 2), words < 4, text[-1:] in ".!?…:;\"”»", any(c in text for c in ".!?…"), b.linked / max(b.letters, 1), f.heading, f.item,
        )
    return rows


def fit(rows: np.ndarray, labels: np.ndarray, keep: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, drawn to 0 by ``keep`` (the bias too, so no labels give 0)."""
    w = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-rows @ w))
        slope = rows.T @ (labels - p) - keep * w
        bend = (rows * (p * (1 - p))[:, None]).T @ rows + keep * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w


def made_pages(n: int, seed: int) -> Iterator[str]:
    """Pages whose text blocks begin with ``yes`` (content) or ``no``, made by rule.

    Content stands in article, main, marked or plain containers or a table cell, with
    headings, paragraphs of 1 to 90 words, lists and quotes, and adverts between. Menus,
    headers, footers, sidebars, notices, adverts, forms, comments and unmarked lines
    stand around it; some pages are wrapped in a form or a container whose class only
    says that the page has a sidebar.
    """
    r = random.Random(seed)
    pick = r.choice

    def words(label: str, low: int, high: int, stop: str = ".") -> str:
        return " ".join([label, *("x" * r.randint(1, 9) for _ in range(r.randint(low, high) - 1))]) + stop

    def links(k: int) -> str:
        return "".join(f"<li><a href=x>{words('no', 1, 3, '')}</a>" for _ in range(k))

    def advert() -> str:
        return f"<div class='{pick(('ad', 'advert', 'sponsored', 'promo-box'))}'>{pick(('', '<p>'))}{words('no', 2, 40, pick('.!'))}</div>"

    def part() -> str:
        kind = r.random()
        if kind < 0.6:
            return f"<p>{words('yes', 8, 90)}</p>"
        if kind < 0.72:
            return f"<p>{words('yes', 1, 5, pick(('.', '', '', ':', '. **')))}</p>"
        if kind < 0.82:
            return f"<h{pick('234')}>{words('yes', 1, 8, '')}</h2>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{words('yes', 2, 14, pick(('.', '')))}" for _ in range(r.randint(2, 5))) + "</ul>"
        return f"<blockquote>{words('yes', 5, 40)}</blockquote>" if kind < 0.95 else advert()

    around = (
        lambda: f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", lambda: f"<div class='{pick(('menu', 'navbar', 'breadcrumbs', 'plain'))}'><ul>{links(r.randint(2, 8))}</ul></div>",
        lambda: f"<header><h1>{words('no', 1, 4, '')}</h1><p>{words('no', 2, 12, '')}</p></header>", lambda: f"<div id='site-header'><h2>{words('no', 1, 4, '')}</h2></div>",
        lambda: f"<footer><p>{words('no', 2, 30)}</p></footer>", lambda: f"<div class='footer'>{words('no', 2, 20)}</div>", advert,
        lambda: f"<aside><h3>{words('no', 1, 4, '')}</h3>" + "".join(f"<p>{words('no', 4, 40)}</p>" for _ in range(r.randint(1, 3))) + "</aside>",
        lambda: f"<div id='sidebar'>" + "".join(f"<p>{words('no', 4, 60)}</p>" for _ in range(r.randint(1, 3))) + "</div>",
        lambda: f"<div class='{pick(('cookie-notice', 'alert', 'newsletter', 'gdpr'))}'><p>{words('no', 4, 30)}</p><button>{words('no', 1, 2, '')}</button></div>",
        lambda: f"<form><label>{words('no', 1, 4, '')}</label><p>{words('no', 3, 20, pick(('.', '')))}</p></form>",
        lambda: f"<{pick(('section', 'div', 'ol'))} {pick(('id', 'class'))}='comments'>" + "".join(f"{pick(('<div>', '<article>', '<li>'))}<b>{words('no', 1, 2, '')}</b><p>{words('no', 3, 60)}</p>" for _ in range(r.randint(1, 4))) + "</section></div></ol>",
        lambda: f"<div class='related'><ul>{links(r.randint(2, 5))}</ul></div>", lambda: f"<div>{words('no', 1, 3, '')}</div>", lambda: f"<p>{words('no', 1, 4, '')}</p>",
    )
    roots = (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div id='post-body'>", "</div>"), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("", ""), ("<div class='entry'><article>", "</article></div>"))
    wraps = (("", ""),) * 4 + (("<form id='page'>", "</form>"), ("<div class='has-sidebar'>", "</div>"), ("<div class='page-banner'>", "</div>"), ("<div class='content search'>", "</div>"))
    for _ in range(n):
        root, wrap = pick(roots), pick(wraps)
        inside = f"<h1>{words('yes', 2, 10, '')}</h1>" * (r.random() < 0.8) + "".join(part() for _ in range(r.randint(2, 14)))
        edge = lambda: "".join(pick(around)() for _ in range(r.randint(1, 5)))
        yield f"<html><body>{wrap[0]}{edge()}{root[0]}{inside}{root[1]}{edge()}{wrap[1]}</body></html>"


def found_in(html: str) -> list[tuple[Block, str]]:
    """The page's blocks with their texts, white space made one space; blank ones left out."""
    return [(b, t) for b in blocks(html) if (t := " ".join("".join(b.parts).split()))]


@functools.lru_cache(4)
def trained(pages: int = FIT_PAGES, seed: int = 1) -> tuple[tuple[float, ...], float]:
    """Weights of the features, and the strength of the edges that errs least on as many more made pages."""
    parsed = [found_in(p) for p in made_pages(2 * pages, seed)]
    truth = [np.array([t.startswith("yes") for _, t in x]) for x in parsed]
    rows = [features(x) for x in parsed]
    weights = fit(np.concatenate([*rows[:pages], np.zeros((0, len(FEATURES)))]), np.concatenate([*truth[:pages], np.zeros(0)]))
    errors = {s: sum(int((np.array(minimum_cut((r @ weights).tolist(), edges(x, s))) != y).sum()) for x, r, y in zip(parsed[pages:], rows[pages:], truth[pages:], strict=True)) for s in STRENGTHS}
    return tuple(weights.tolist()), min(STRENGTHS, key=lambda s: (errors[s], s))


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The cheapest labelling: True costs nothing, False costs ``gain`` (or True costs -gain), and an edge costs its weight if its ends differ.

    A node whose gain outweighs all its edges is labelled at once, which shifts its
    neighbours' gains; the rest is a maximum flow by shortest augmenting paths, one
    source after the other. What a source without a path still reaches is on the
    source's side for good, and no later path goes there. Ties go to True in the first
    step.
    """
    n = len(gain)
    gain, near, weight = list(gain), [[] for _ in gain], [0.0] * n
    for e in edges:
        i, j, w = e
        near[i].append(e)
        near[j].append(e)
        weight[i] += w
        weight[j] += w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and (gain[i] >= weight[i] or -gain[i] > weight[i]):
            label[i] = gain[i] >= weight[i]
            for a, b, w in near[i]:
                j = a + b - i
                if label[j] is None:
                    weight[j] -= w
                    gain[j] += w if label[i] else -w
                    waiting.append(j)
    rest = [i for i in range(n) if label[i] is None]
    room: dict[int, dict[int, float]] = {i: {} for i in rest}
    for i in rest:
        for a, b, w in near[i]:
            j = a + b - i
            if label[j] is None:
                room[i][j] = room[i].get(j, 0.0) + w
    sink = {i: max(0.0, -gain[i]) for i in rest}
    for source in rest:
        left = gain[source]
        while left > 1e-12 and label[source] is None:
            came, reached, goal = {source: source}, deque([source]), None
            while reached and goal is None:
                i = reached.popleft()
                if sink[i] > 1e-12:
                    goal = i
                    break
                for j, r in room[i].items():
                    if r > 1e-12 and j not in came and label[j] is None:
                        came[j] = i
                        reached.append(j)
            if goal is None:
                for i in came:
                    label[i] = True
                break
            flow, j = min(left, sink[goal]), goal
            while j != source:
                flow = min(flow, room[came[j]][j])
                j = came[j]
            j = goal
            while j != source:
                i = came[j]
                room[i][j] -= flow
                room[j][i] = room[j].get(i, 0.0) + flow
                j = i
            sink[goal] -= flow
            left -= flow
    return [bool(x) for x in label]


def edges(found: list[tuple[Block, str]], strength: float) -> list[tuple[int, int, float]]:
    """Neighbours in page order, the weaker the more steps apart in the tree, and neighbours in one container."""
    out, last = [], {}
    for i, (b, _) in enumerate(found):
        f = b.frame
        if i:
            x, y, steps = f, found[i - 1][0].frame, 0
            while x is not y and steps < 40:
                x, y = (x.up, y) if x.depth >= y.depth else (x, y.up)
                steps += 1
            out.append((i - 1, i, strength * NEXT_EDGE / (1 + steps / 2)))
        box = f.up.number if f.up else 0
        if box in last:
            out.append((last[box], i, strength * SIBLING_EDGE))
        last[box] = i
    return out


def labelled(html: str, model: tuple[tuple[float, ...], float]) -> list[tuple[str, bool, bool]]:
    """Each block's text, its label by the classifier alone and by the cut."""
    found = found_in(html)
    if not found:
        return []
    weights, strength = model
    gain = (features(found) @ np.array(weights)).tolist()
    return [(t, g >= 0, keep) for (_, t), g, keep in zip(found, gain, minimum_cut(gain, edges(found, strength)), strict=True)]


def main_text(html: str | None, model: tuple[tuple[float, ...], float] | None = None) -> str:
    return " ".join(t for t, _, keep in labelled(html or "", model or trained()) if keep)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    Text is empty for null and empty pages and those without an article; whole pages
    are read. Repeated rows each get their text; an empty table stays empty; ids and
    urls may have any type.
    """
    model = trained()
    kind, kind2 = (pages.schema[c].dataType.simpleString() for c in (id, url))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [main_text(x.as_py(), model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id), F.col(url), F.col(html)).mapInArrow(work, f"page_id {kind}, url {kind2}, text string, n_chars long")
