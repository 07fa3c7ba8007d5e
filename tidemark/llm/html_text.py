"""HTML extraction by the maximum-scoring subsequence.

A page is a row of tokens: its tags, and between them its words. A word scores by how likely its
place holds content, less a threshold; a tag scores below zero. The best contiguous region is the
run of tokens with the highest sum, found in one linear scan. Elements inside of the region that
more likely hold something else (an advert, a form) are left out, again by the sum of their words.
Words between two tags share their place and are scored as one step, which gives the same maximum.

The weights come from labelled pages: a logistic regression of the places' features (``features``)
gives each place's likelihood; the words' threshold, the cost of a tag and how much words count
whose element would be left out are those with which most labelled pages come out whole. Features are names of open elements, names in their class, id
and role (whole or as a part of a longer name; apart for elements that hold a large share of the
page), and the shape of the block: its element, length, share of links and last sign. No list of
names decides; names that the labelled pages don't have count for nothing. ``labelled_pages``
builds the pages used by default.

Text: character references are decoded, white space within a block becomes one space, blocks are
trimmed and joined by one space in page order; empty blocks vanish.

Cases: a null or empty page gives an empty text; unclosed tags, comments, scripts and cut-off
pages are read as far as they go, in time that grows with their length; of regions with equal sums
the first is taken; rows that repeat give equal results; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: names of HTML. What RAW elements hold isn't text of the page.
RAW = frozenset("script style noscript template svg iframe object textarea select option button canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
#: Elements that the start of one of these ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: An element is large if it holds this share of the page's words.
LARGE = 0.4

# quotes open a value only after an equals sign
_TOKEN = re.compile(
    r"<!--(?:.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*?)(?:>|\Z)", re.S
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I | re.S)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_HUMP = re.compile(r"([a-z])([A-Z])")
_LETTERS = re.compile(r"[a-z]+")


def names_of(attributes: str) -> list[str]:
    """``is:name`` for a class, id or role of one word, ``has:part`` for each word of a longer one."""
    out = ["hidden"] if _HIDDEN.search(attributes) else []
    for groups in _NAMED.findall(attributes):
        for name in " ".join(groups).split():
            parts = _LETTERS.findall(_HUMP.sub(r"\1 \2", name).lower())
            out += [f"is:{parts[0]}"] if len(parts) == 1 else [f"has:{p}" for p in parts]
    return out


@dataclass
class Element:
    name: str
    parent: int
    start: int
    names: list[str]
    end: int = 0
    words: int = 0


@dataclass
class Page:
    """tags: name of each token that is a tag, else empty. texts: decoded text of each run of
    words. parts: whether a tag parts blocks. inside: the element that each token stands in."""

    tags: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    parts: list[bool] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)

    def add(self, tag: str, text: str, parts: bool, inside: int) -> None:
        self.tags.append(tag)
        self.texts.append(text)
        self.parts.append(parts)
        self.inside.append(inside)


def read(source: str) -> Page:
    """Tokens and elements. Each element is opened and closed once, so this takes linear time."""
    page = Page(elements=[Element("", -1, 0, [])])
    stack, open_names = [0], Counter()
    at, n = 0, len(source)

    def words(text: str) -> None:
        if text:
            page.add("", html.unescape(text), False, stack[-1])

    def close() -> None:
        k = stack.pop()
        page.elements[k].end = len(page.tags)
        open_names[page.elements[k].name] -= 1

    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            words(source[at:])
            break
        words(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                words(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        parts = name not in INLINE
        if m[1]:
            if open_names[name]:
                while page.elements[stack[-1]].name != name:
                    close()
                close()
            page.add(f"/{name}", "", parts, stack[-1])
            continue
        if name in RAW and not m[0].endswith("/>"):
            ended = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(source, at)
            at = ended.end() if ended else n
        while (top := page.elements[stack[-1]].name) in ENDS.get(name, ()) or (top == "p" and name in ENDS_P) or (top in INLINE and name in ENDS_P and open_names["p"] and name == "p"):
            close()
        page.add(name, "", parts, stack[-1])
        if name not in VOID and name not in RAW and name not in ("html", "body") and not m[0].endswith("/>"):
            names = names_of(m[3]) if m[3] else []
            if parts or names or name == "a":
                page.elements.append(Element(name, stack[-1], len(page.tags), names))
                stack.append(len(page.elements) - 1)
                open_names[name] += 1
    while len(stack) > 1:
        close()
    page.elements[0].end = len(page.tags)
    return page


#: What headings say of the blocks under them, by the first of these words (fixed values).
HEADINGS = {
    "comments": "comments comment replies reply responses discussion".split(),
    "side": "related recommended trending popular latest also".split(),
    "form": "newsletter subscribe login".split(),
    "share": "share follow".split(),
}
_TOPICS = {word: topic for topic, words in HEADINGS.items() for word in words}


def _topic(heading: str) -> str:
    return next((_TOPICS[w] for w in _LETTERS.findall(heading.lower()) if w in _TOPICS), "")


def _shape(length: int, linked: int, last: str) -> list[str]:
    size = next(k for k, most in enumerate((3, 9, 24, 10**9)) if length <= most)
    stops = "stop" if last in ".!?…:;\"'”»)。！？" else "bare"
    share = 0 if not linked else 1 if 2 * linked < length else 2
    return [f"length:{size}:{stops}", f"links:{share}"]


def features(page: Page, known: dict[str, int] | None = None) -> list[tuple[int, int, frozenset]]:
    """(token, words, features) of each run of words. known: the only features to keep, by number."""
    counts = [len(t.split()) for t in page.texts]
    for k, c in zip(page.inside, counts, strict=True):
        page.elements[k].words += c
    for e in reversed(page.elements[1:]):
        page.elements[e.parent].words += e.words
    whole = max(1, page.elements[0].words)

    def kept(names: list[str]) -> frozenset:
        return frozenset(names) if known is None else frozenset(known[x] for x in names if x in known)

    places: list[frozenset] = []
    block_of: list[str] = []  # the element that makes the block
    linked: list[bool] = []
    for k, e in enumerate(page.elements):
        above = places[e.parent] if k else frozenset()
        size = "large" if e.words >= LARGE * whole else "small"
        own = kept([f"in:{e.name}", *(f"{x}:{size}" for x in e.names)]) if k else kept(["page"])
        places.append(above if own <= above else above | own)
        block_of.append(e.name if k and e.name not in INLINE else block_of[e.parent] if k else "")
        linked.append(e.name == "a" or (k > 0 and linked[e.parent]))
    shapes: dict[tuple, frozenset] = {}
    out, block = [], []
    topic, upto = "", 0  # of the heading above, and where its element's parent ends

    def end_block() -> None:
        nonlocal topic, upto
        if block:
            first = block_of[page.inside[block[0]]]
            if len(first) == 2 and first[0] == "h" and first[1].isdigit():
                e = page.elements[page.inside[block[0]]]
                while e.name != first:
                    e = page.elements[e.parent]
                topic, upto = _topic(" ".join(page.texts[t] for t in block)), page.elements[e.parent].end
            elif block[0] >= upto:
                topic = ""
            length = sum(counts[t] for t in block)
            last = next((page.texts[t].rstrip()[-1] for t in reversed(block) if counts[t]), "")
            links = sum(counts[t] for t in block if linked[page.inside[t]])
            for t in block:
                if counts[t]:
                    what = _shape(length, links, last)
                    key = (block_of[page.inside[t]], *what, topic)
                    if key not in shapes:
                        under = [f"under:{topic}", f"under:{topic}:{key[0]}"] if topic else []
                        shapes[key] = kept([*what, f"block:{key[0]}", f"block:{key[0]}:{what[0]}", *under])
                    out.append((t, counts[t], places[page.inside[t]] | shapes[key]))
            block.clear()

    for t, (tag, parts) in enumerate(zip(page.tags, page.parts, strict=True)):
        if tag and parts:
            end_block()
        elif not tag:
            block.append(t)
    end_block()
    return out


@dataclass(frozen=True)
class Weights:
    """features: their weights for a word to be content. threshold: taken off a word's likelihood.
    tag: what a tag costs. other: how much words count whose element would be left out."""

    features: dict[str, float]
    threshold: float
    tag: float
    other: float = 1.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the highest sum; (0, 0) if none is above zero."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


class Extractor:
    def __init__(self, weights: Weights):
        self.weights = weights
        self.known = {x: k for k, x in enumerate(weights.features)}
        self.values = list(weights.features.values())
        self.sums: dict[frozenset, float] = {}

    def likelihood(self, place: frozenset) -> float:
        if place not in self.sums:
            if len(self.sums) >= 100_000:
                self.sums.clear()
            z = sum(self.values[k] for k in place)
            self.sums[place] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return self.sums[place]

    def keep(self, page: Page, runs: list[tuple[int, int, float]]) -> list[bool]:
        """Which tokens are content. runs: (token, words, likelihood)."""
        # elements count by all of their words
        sums = [0.0] * len(page.elements)
        for t, n, p in runs:
            sums[page.inside[t]] += n * (p - 0.5)
        for k in range(len(sums) - 1, 0, -1):
            sums[page.elements[k].parent] += sums[k]
        other = [False] * len(sums)
        for k, e in enumerate(page.elements[1:], 1):
            other[k] = other[e.parent] or (sums[k] < 0 and (e.name not in INLINE or bool(e.names)))
        scores = [-self.weights.tag if tag else 0.0 for tag in page.tags]
        for t, n, p in runs:
            scores[t] = n * (p - self.weights.threshold) * (self.weights.other if other[page.inside[t]] else 1.0)
        start, end = best_region(scores)
        # an element goes as a whole, so only if the region holds all of it
        gone = [False] * len(sums)
        for k, e in enumerate(page.elements[1:], 1):
            gone[k] = gone[e.parent] or (other[k] and start <= e.start - 1 and e.end <= end)
        return [start <= t < end and not gone[page.inside[t]] for t in range(len(page.tags))]

    def __call__(self, source: str | None) -> str:
        page = read(source or "")
        runs = [(t, n, self.likelihood(place)) for t, n, place in features(page, self.known)]
        return text_of(page, self.keep(page, runs))


def text_of(page: Page, keep: list[bool]) -> str:
    blocks, now = [], []
    for tag, text, parts, kept in zip(page.tags, page.texts, page.parts, keep, strict=True):
        if tag:
            if parts:
                blocks.append("".join(now))
                now = []
        elif kept:
            now.append(text)
    blocks.append("".join(now))
    return " ".join(filter(None, (" ".join(b.split()) for b in blocks)))


# ---- labelled pages ----

# fixed values: names that sites give to what stands around an article, and to what holds one
AROUND = {
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner adsense".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr paywall".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager skip".split(),
    "head": "header masthead branding site-header page-header".split(),
    "foot": "footer copyright site-footer legal imprint contentinfo".split(),
    "side": "sidebar aside widget related recommended trending complementary most-read".split(),
    "share": "share social sharing follow share-buttons".split(),
    "form": "login signup search newsletter subscribe contact-form".split(),
    "comments": "comments comment commentlist respond replies discussion disqus".split(),
}
CONTENT = "content article post entry story main body text article-body post-content entry-content story-body".split()
NEUTRAL = "wrap target box page layout section guide row col inner with has site area block left right top".split()


def labelled_pages(n: int = 1000, seed: int = 5) -> list[list[tuple[str, bool]]]:
    """Pages as parts (source, whether its words are content), laid out in the ways that sites do:
    bars, notices, adverts and forms around, and at times within, an article. Names mislead at
    times, and at times nothing has a name."""
    random = np.random.default_rng(seed)
    syllables = "ka lo mi ter sun ver do ra pel qui nor es to".split()

    def word() -> str:
        return "".join(random.choice(syllables, random.integers(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(random.integers(low, high + 1)))

    def sentences(low: int, high: int) -> str:
        left, out = int(random.integers(low, high + 1)), []
        while left > 0:
            out.append(words(k := min(left, int(random.integers(2, 15))), k).capitalize() + str(random.choice([".", ".", ".", "!", "?"])))
            left -= k
        return " ".join(out)

    def named(name: str) -> str:
        key, form = random.choice(["class", "class", "id", "role"]), random.integers(6)
        if form == 1:
            name = f"{name} {random.choice(NEUTRAL)}"
        elif form == 2:
            name = f"{random.choice(NEUTRAL)}-{name}"
        elif form == 3:  # post-comments, article_footer
            name = f"{random.choice(CONTENT[:8])}{random.choice(['-', '_'])}{name}"
        elif form == 4:  # related-posts, comment-list, disqus_thread
            name = f"{name}{random.choice(['-', '_'])}{random.choice(['posts', 'list', 'thread', 'area', 'items', 'section'])}"
        return f' {key}="{name}"'

    def links(low: int, high: int) -> list[str]:
        return [f'<a href="/{k}">{words(1, 4)}</a>' for k in range(random.integers(low, high))]

    def menu() -> str:
        items, form = links(2, 9), random.integers(5)
        if form == 0:
            return f"<nav><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></nav>"
        if form == 1:
            return f"<div{named(random.choice(AROUND['menu']))}><ul>{''.join(f'<li>{x}' for x in items)}</ul></div>"
        if form == 2:
            return f"<div>{' '.join(items)}</div>"
        if form == 3:
            return f"<div>{' '.join(word().capitalize() for _ in range(random.integers(2, 7)))}</div>"
        return f"<nav>{' | '.join(items)}</nav>"

    def boxed(kind: str, body: str) -> str:
        tag = str(random.choice(["div", "div", "section", "aside"]))
        return f"<{tag}{named(random.choice(AROUND[kind]))}>{body}</{tag}>"

    def prose(low: int = 2, high: int = 45) -> str:
        return f"<p>{sentences(low, high)}</p>" if random.random() < 0.6 else sentences(low, high)

    def comments() -> str:
        each = "".join(f"<div{named('comment')}><b>{word()}</b><p>{sentences(2, 40)}</p></div>" if random.random() < 0.5 else f"<li><p>{sentences(2, 40)}</p></li>" for _ in range(random.integers(1, 6)))
        title = str(random.choice(["Comments", "{} comments", "Leave a reply", "Responses", "Join the discussion", "{}", "{}"])).replace("{}", words(1, 2))
        if random.random() < 0.2:  # without a name of its own
            return f"<h3>{random.choice(['Comments', '5 comments', 'Replies'])}</h3><{(tag := random.choice(['ul', 'ol', 'div']))}>{each}</{tag}>"
        return boxed("comments", f"<h3>{title}</h3>{each}")

    def form() -> str:
        inner = f"<label>{words(1, 3)}</label><input name=q>{prose(1, 8)}"
        return f"<form action='/s'>{inner}</form>" if random.random() < 0.6 else boxed("form", f"<form>{inner}</form>")

    def foot() -> str:
        text = str(random.choice([f"&copy; {words(1, 4)}", words(2, 5).capitalize(), sentences(4, 40), f"&copy; 2020 {words(1, 5)} &middot; {sentences(2, 8)}"]))
        form = random.integers(6)
        if form > 3:
            return f"<p{named(random.choice(AROUND['foot']))}>{text}</p>"
        return f"<footer>{text}</footer>" if form < 2 else f"<div>&copy; {words(2, 6)}</div>" if form == 2 else boxed("foot", text)

    def head() -> str:
        body = f"<a href='/'>{words(1, 3)}</a> {words(0, 5)}"
        return f"<header>{body}</header>" if random.random() < 0.6 else boxed("head", body)

    def side() -> str:
        body = prose() if random.random() < 0.5 else f"<h4>{random.choice(['Related posts', 'You may also like', 'Most popular', words(1, 3), words(1, 3)])}</h4><ul>{''.join(f'<li>{x}</li>' for x in links(2, 7))}</ul>"
        return f"<aside>{body}</aside>" if random.random() < 0.3 else boxed("side", body)

    advert, notice = (lambda: boxed("ad", prose(2, 30))), (lambda: boxed("notice", prose(4, 40)))
    share = lambda: boxed("share", " ".join(links(1, 5)) if random.random() < 0.5 else words(1, 5))
    hidden = lambda: f"<div {random.choice(['hidden', 'style=\"display:none\"', 'aria-hidden=\"true\"'])}>{prose()}</div>"
    before, within = [menu, menu, head, advert, notice, form, side, hidden], [advert, share, side, form, notice]
    after = [foot, foot, comments, side, share, advert, menu, form, hidden]

    def wrapper() -> tuple[str, str]:
        hint = str(random.choice([x for names in AROUND.values() for x in names]))
        neutral, content = str(random.choice(NEUTRAL)), str(random.choice(CONTENT))
        options = [
            ("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("", ""),
            (f'<article class="{content} {hint}-{neutral}">', "</article>"), (f'<main class="{hint}-{neutral}">', "</main>"),
            (f'<div id="{hint}-{content}">', "</div>"), (f'<div class="{neutral} {hint}-{neutral}">', "</div>"), (f'<div class="{content}">', "</div>"),
            (f'<div class="{content}">', "</div>"), (f'<div class="{neutral}"><div>', "</div></div>"), (f'<form id="{content}"><div class="{content}">', "</div></form>"),
        ]
        return options[random.integers(len(options))]

    def block() -> str:
        form = random.integers(12)
        if form < 6:
            return f"<p>{sentences(1, 80)}{random.choice(['</p>', '</p>', ''])}"
        if form == 6:
            return f"<p>{sentences(1, 12)}<br><a href='/x'>{words(1, 3)}</a> <b>{words(1, 3)}</b> {sentences(1, 9)}</p>"
        if form == 7:
            return f"<ul>{''.join(f'<li>{words(1, 12)}</li>' for _ in range(random.integers(1, 5)))}</ul>"
        if form == 8:
            return f"<blockquote>{prose(3, 30)}</blockquote>"
        if form == 9:
            more = f" {random.choice(list(_TOPICS))}" if random.random() < 0.1 else ""
            return f"<h2>{words(1, 8).capitalize()}{more}</h2><p>{sentences(2, 50)}</p>"
        if form == 10:
            return f"<pre>{words(2, 30)}</pre>" if random.random() < 0.4 else f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 9)}</td></tr></table>"
        return f"<div>{prose(2, 60)}</div>"

    pages = []
    for _ in range(n):
        if random.random() < 0.06:  # a fragment
            pages.append([(str(random.choice([words(1, 9), sentences(1, 20), f"<p>{words(1, 9)}</p>", f"<p>{words(1, 6)}<p>{words(1, 6)}"])), True)])
            continue
        page = [(f"<html><head><title>{words(2, 12)}</title><meta charset=utf-8></head><body>", False)]
        outer = random.random() < 0.3
        if outer:
            page.append((f'<div class="{random.choice(NEUTRAL)} {random.choice(["has", "with", "no"])}-{random.choice(AROUND["side"])}">', False))
        page += [(random.choice(before)(), False) for _ in range(random.integers(0, 4))]
        opened, closed = wrapper()
        page.append((opened, True))
        if random.random() < 0.8:
            page.append((f"<h1>{words(2, 12).capitalize()}</h1>", True))
        page.append((f"<p>{sentences(12, 90)}</p>" if random.random() < 0.9 else sentences(20, 90), True))
        for _ in range(random.integers(0, 9)):
            page.append((block(), True))
            if random.random() < 0.12:
                page.append((random.choice(within)(), False))
        if random.random() < 0.1:  # what follows the text, within its element
            page += [(f(), False) for f in ([comments], [share, comments], [side], [share], [side, comments])[random.integers(5)]]
        page.append((closed, True))
        page += [(random.choice(after)(), False) for _ in range(random.integers(0, 4))]
        if outer:
            page.append(("</div>", False))
        pages.append(page)
    return pages


def _labels(parts: list[tuple[str, bool]]) -> tuple[Page, list[bool]]:
    """The page, and whether each of its tokens comes from a part with content."""
    page, flags = read("".join(s for s, _ in parts)), []
    for source, content in parts:  # parts begin and end with tags, so their tokens don't merge
        flags += [content] * len(read(source).tags)
    return page, flags[: len(page.tags)] + [False] * (len(page.tags) - len(flags))


def _regression(rows: list[frozenset], y: np.ndarray, weight: np.ndarray, n: int, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.zeros((len(rows), n))
    for k, row in enumerate(rows):
        x[k, list(row)] = 1
    w = np.zeros(n)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(n)
        step = np.linalg.solve(curve, x.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_weights(pages: list[list[tuple[str, bool]]]) -> Weights:
    """Weights of the features by logistic regression; the other three by how many pages come out
    whole with them."""
    read_pages = [(page, flags, features(page)) for page, flags in map(_labels, pages)]
    names = sorted({x for _, _, runs in read_pages for _, _, place in runs for x in place})
    known = {x: k for k, x in enumerate(names)}
    runs = [(frozenset(known[x] for x in place), flags[t], n) for _, flags, found in read_pages for t, n, place in found]
    values = _regression([r[0] for r in runs], np.array([float(r[1]) for r in runs]), np.minimum([r[2] for r in runs], 12.0) ** 0.5, len(names))
    learned = dict(zip(names, values.tolist(), strict=True))
    best, found = -1, None
    scored = Extractor(Weights(learned, 0.5, 0.0))
    likely = [[(t, n, scored.likelihood(frozenset(known[x] for x in place))) for t, n, place in runs] for _, _, runs in read_pages]
    for threshold, tag, other in itertools.product((0.1, 0.2, 0.3, 0.4), (0.01, 0.03, 0.1), (0.03, 0.1, 0.3)):
        extractor = Extractor(Weights(learned, threshold, tag, other))
        right = 0
        for (page, flags, _), own in zip(read_pages, likely, strict=True):
            keep = extractor.keep(page, own)
            right += all(keep[t] == flags[t] for t, _, _ in own)
        if right > best:
            best, found = right, extractor.weights
    return found


@cache
def default_weights() -> Weights:
    return learn_weights(labelled_pages())


def extract(page: str | None, weights: Weights) -> str:
    return Extractor(weights)(page)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """Per page: its id, url, text and n_chars."""
    learned = weights or default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(learned)
        for batch in batches:
            texts = [extractor(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    picked = pages.select(id_col, url_col, F.col(html_col).alias("_html"))
    return picked.mapInArrow(run, f"{kinds}, text string, n_chars long")
