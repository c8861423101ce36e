"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read once into tags and units; a unit is the text of one block in one box.  Every word of a unit scores the
learned log-odds of what surrounds it (the article element or its absence, the boxes and their names, the length of the
block, its share of links), so it is positive in running text, linked paragraphs, items and cells of an article included,
and negative in menus, adverts or bare links; every tag
scores the learned, negative log-odds of its name.  One linear scan finds the contiguous region with the largest sum, and
that region is the main text.  It begins and ends with a unit that scores above 0; units below 0 that it encloses are
insets and are left out.  A stretch between two positive units of one container costs next to nothing however long it is,
and one between containers a bounded amount, so an inset does not cut an article in two.  No tag or name decides by itself: names are features whose weights the labelled pages give.

Where a page has both an article element and text beside it, the scan is done for each of the two as content; the region
whose words weigh more stays.

The labelled pages are layouts written by rule (``labelled_pages``, ``beside_pages``, ``boxed_pages``, ``linked_pages``), with the main text
of each known; a logistic regression over their units gives the weights.

Defined cases: a null or empty page has an empty text, as has a page without positive words, and an empty table gives no
rows; markup that is never closed ends where the page or its parent does; white space of any kind inside a block, no-break
spaces and line breaks included, becomes one space; rows stand on their own, so repeated rows give equal results; of
regions with equal sums the longest and then the first stays; columns named as the result give way to it, other columns
of any name stay.  Very long pages are read in linear time and memory: a closing tag without an open element costs
nothing, and an opening tag finds the element that it closes, at any depth, by the depths of the open elements of each name.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretide.llm import storage

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math mi mn mo ms mspace mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are features of the words inside them.
BOXED = frozenset("nav header footer aside form button menu dialog head fieldset".split())
MAIN = frozenset("article main".split())
#: Words in a class, id or role that are features.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promos promotion menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars side aside header masthead footer foot "
    "cookie cookies consent notice notices alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond discussion responses related recommended "
    "recommendations pagination pager widget widgets toolbar search complementary contentinfo copyright legal skip hidden".split()
)
#: Of these, words of everyday headings; alone they are a weaker feature.
EVERYDAY = frozenset("side discussion related recommended recommendations respond responses search legal notice notices alert social consent skip".split())
#: Words that with a mark still make up the whole name of a box, as in "comment-list".
BOXES = frozenset("list lists box block section area wrap wrapper container item items bar links link button buttons posts articles stories form thread slot unit content inner body".split())
#: First words of an article element's class that make it a reader's comment or a teaser.
NOT_MAIN = ("comment", "reply", "replies", "respon", "related", "recommend", "teaser", "promo", "sponsor", "advert", "ad-")
LONG, LINKED = 40, 0.25  #: a box is long from so many words, if at most that share of them is in links
#: What a stretch between two positive units costs at most, in full word scores: within a container, and between two.
GAP_WITHIN, GAP = 0.2, 10.0
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[A-Za-z]+").findall
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I).search
#: Elements that an opening tag of the name on the left closes when open in the same container.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul details figure".split())
CONTAINERS = BOXED | MAIN | {"div", "section", "td", "th", "li", "dd"}
#: Elements that hold the blocks of a text; two stand together if they are one or one holds the other.
HOLDERS = MAIN | {"div", "section", "td"}


def _names(attributes: str, ids: bool | None = None) -> list[str]:
    """Names in class, id and role; only those of ids or only the others if ``ids`` is given."""
    return [name for found in NAMES.finditer(attributes) if ids is None or ids == (found[0][:2].lower() == "id") for name in (found[1] or found[2] or found[3] or "").lower().split()]


def _main(name: str, attributes: str) -> bool:
    return name in MAIN and not any(n == "ad" or n.startswith(NOT_MAIN) for n in _names(attributes))


@lru_cache(maxsize=8192)
def named(name: str, attributes: str, in_main: bool) -> str:
    """What the names of an element say, or nothing: ``sure`` or ``everyday`` where marks make up a whole name,
    ``ending`` or ``beginning`` where one stands last or earlier among other words, as in "my-ad" and "ad-history"."""
    if name in INLINE and name != "span" or name in ("html", "body") or name in MAIN:
        return ""
    out = ""
    for ids in (False, True):
        if ids and (name in HEADINGS or name == "p"):
            continue
        for listed in map(PARTS, _names(attributes, ids)):
            parts = set(listed)
            own = parts & (MARKS - {"header", "masthead"} if in_main else MARKS)  # an article's own head has its title
            if not own:
                continue
            whole, everyday = parts <= MARKS | BOXES, own <= EVERYDAY
            if whole and not (everyday and not parts & BOXES):
                return "sure"
            if not ids and (whole or not everyday):
                out = "everyday" if whole else out or ("ending" if listed[-1] in own else "beginning")
    return out


class Box:
    """An element that is a feature of the words in it, and the next such element around it."""

    __slots__ = ("kind", "above", "tagged", "words", "linked")

    def __init__(self, kind: str, above: Box | None, by_tag: bool, words: int, linked: int):
        self.kind, self.above, self.words, self.linked = kind, above, -words, -linked
        self.tagged = self if by_tag else above.tagged if above else None  # the nearest that is one by its tag


@dataclass(slots=True)
class Unit:
    """The text of a block in one box: its words, how many of them are in links, and its surroundings."""

    block: int
    box: Box | None
    where: str  #: "main", "outside" (of the page's article elements) or "" (a page without any)
    heading: bool
    within: str  #: the nearest of a few elements
    holder: tuple[int, int]  #: numbers of the nearest container and of the one around it; of an article element, its own twice
    words: int = 0
    linked: int = 0

    def beside(self, other: Unit) -> bool:
        (a, above_a), (b, above_b) = self.holder, other.holder
        return a == b or above_a == b or above_b == a


WITHIN = frozenset("p li td th blockquote pre dd dt figcaption".split())


def parts(page: str) -> tuple[list[str | Unit], dict[int, list[tuple[Unit | None, str]]], list[Box]]:
    """The page in order as names of tags and units, the pieces of text of every block, and all boxes."""
    items: list[str | Unit] = []
    pieces: dict[int, list[tuple[Unit | None, str]]] = {}
    boxes: list[Box] = []
    lower = page.lower() if "<" in page else page
    if len(lower) != len(page):  # a letter may grow when lower-cased
        lower = page
    has_main = any(_main("main", m[1]) for m in re.finditer(r"<(?:article|main)\b([^>]*+)>", page, re.I))
    stack: list[tuple] = []  # name, the surroundings outside it, its own box
    open_at: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of each name
    box: Box | None = None
    holder = (0, 0)
    holders = 0
    main = heading = link = False
    within = ""
    block = words = linked = 0
    current: dict[int, Unit] = {}  # units of this block by box
    begun = False  # the article or its title has been seen
    at, tag, last = 0, TAG, page.rfind(">")

    def cut(depth: int) -> None:
        """Close the elements from ``depth`` on."""
        nonlocal box, main, heading, link, within, holder
        if depth < len(stack):
            box, main, heading, link, within, holder = stack[depth][1]
            for name, _, own in reversed(stack[depth:]):
                open_at[name].pop()
                if own is not None:
                    own.words += words
                    own.linked += linked
            del stack[depth:]

    def text(piece: str) -> None:
        nonlocal words, linked
        n = len(piece.split())
        if not n:
            if piece:
                pieces.setdefault(block, []).append((None, " "))
            return
        piece = html.unescape(piece) if "&" in piece else piece
        n = len(piece.split())
        unit = current.get(id(box))
        if unit is None or unit.block != block:
            if not current or next(iter(current.values())).block != block:
                current.clear()
            unit = current[id(box)] = Unit(block, box, "main" if main else "outside" if has_main else "", heading, within, holder)
            items.append(unit)
        unit.words += n
        words += n
        if link:
            unit.linked += n
            linked += n
        pieces.setdefault(block, []).append((unit, piece))

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = len(page) if end < 0 else end + 1
            continue
        found = tag.match(page, lt)
        if found is None and tag is TAG and page[lt + 1 : lt + 2].strip("/").isalpha() | (page[lt + 1 : lt + 2] == "/"):
            found = PLAIN_TAG.match(page, lt)
            if found:  # quotes do not pair up from here on
                tag = PLAIN_TAG
        if found is None:
            text("<")
            at = lt + 1
            continue
        at = found.end()
        closing, name, attributes = found[1], found[2].lower(), found[3]
        if name not in INLINE and name not in RAW:
            block += 1
        items.append(name)
        if closing:
            if open_at[name]:
                cut(open_at[name][-1])
            continue
        if name == "br":
            pieces.setdefault(block, []).append((None, " "))
        closed = attributes.endswith("/") and attributes[-2:-1] in ("", " ", "\t", "\n", "'", '"')  # not as in href=/
        if name in RAW and not closed:
            end = lower.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            continue
        if name in VOID or closed:
            continue
        is_main = _main(name, attributes)
        if not begun and (is_main or name == "h1"):
            begun = True
            # what was never closed ends where the article begins, and a class such as "with-sidebar" was a wrapper's
            never = {n for n in BOXED if open_at[n] and lower.find(f"</{n}", at) < 0}
            cut(next((k for k, entry in enumerate(stack) if entry[0] in never), len(stack)))
            for _, _, own in stack:
                if own is not None and own.tagged is not own and own.kind != "hidden":
                    own.kind = ""
        closes = CLOSES.get(name, {"p"} if name in CLOSE_P else None)
        if closes:
            innermost = max((open_at[c][-1] for c in closes if open_at[c]), default=-1)
            if innermost >= 0 and innermost > max((open_at[c][-1] for c in LIMITS.get(name, CONTAINERS) if open_at[c]), default=-1):
                cut(innermost)
        outside = (box, main, heading, link, within, holder)
        own = None
        if is_main:
            main = True
            box = box.tagged if box else None  # names around the article are its wrappers'
        else:
            kind = name if name in BOXED and not (name == "header" and main) else "other article" if name in MAIN else ""
            if kind:
                own = Box(kind, box, True, words, linked)
            elif attributes and (kind := "hidden" if HIDDEN(attributes) else named(name, attributes, main)):
                own = Box(kind, box, False, words, linked)
            if own is not None:
                box = own
                boxes.append(own)
        heading |= name in HEADINGS
        link |= name == "a"
        if name in WITHIN:
            within = name
        if name in HOLDERS and own is None and not (main and not is_main):  # an article element is one container
            holders += 1
            holder = (holders, holder[0])
        open_at[name].append(len(stack))
        stack.append((name, outside, own))
    cut(0)
    return items, pieces, boxes


def _kinds(boxes: list[Box]) -> dict[int, frozenset[str]]:
    """Features of every box, those of the boxes around it included."""
    out: dict[int, frozenset[str]] = {id(None): frozenset()}
    for b in boxes:  # the ones around it come first
        kind = b.kind
        if kind in ("everyday", "ending", "beginning"):
            kind += " long" if b.words >= LONG and b.linked <= LINKED * b.words else " short"
        above = out[id(b.above)]
        out[id(b)] = above | {kind} if kind and kind not in above else above
    return out


def features(unit: Unit, kinds: frozenset[str]) -> list[str]:
    """Names of the features of a unit."""
    n, share = unit.words, unit.linked / unit.words
    size = "1-3" if n < 4 else "4-8" if n < 9 else "9-20" if n < 21 else "21-"
    links = "none" if not share else "few" if share <= LINKED else "some" if share <= 0.5 else "half" if share <= 0.75 else "most"
    out = ["any", f"words {size}", f"links {links}", *kinds]
    if share > 0.5 and not unit.heading and unit.within and unit.where == "main":
        out.append("linked text")  # a paragraph, item or cell of the article that is a link, unlike links that stand bare
        out += [f"linked text {k}" for k in kinds]
    if unit.where == "main":
        out.append("main")
    if unit.heading:
        out.append("heading")
    elif unit.within:
        out.append(unit.within)
    return out


OTHER_SIDE = "other side"  #: the feature of a unit that is not on the side of the article elements where the main text is


@dataclass(frozen=True)
class Weights:
    units: dict[str, float]  #: log-odds of a unit's features
    tags: dict[str, float]  #: of tags, all below 0
    sides: dict[str, float]  #: of a word in article elements and beside them, on pages with both

    def word(self, unit: Unit, kinds: frozenset[str], side: str = "") -> float:
        """What every word of the unit scores: its log-odds, held to -1 to 1, if the main text is on this side."""
        total = sum(self.units.get(f, 0.0) for f in features(unit, kinds))
        return max(-1.0, min(1.0, total + self.units.get(OTHER_SIDE, 0.0) if side and unit.where != side else total))


def scores(items: list[str | Unit], kinds: dict[int, frozenset[str]], weights: Weights, side: str) -> list[float]:
    """Scores of all tags and units, if the main text is on this side of the article elements."""
    out: list[float] = []
    last, since, cost = None, 0, 0.0  # the last positive unit, the place after it, the sum from there
    for item in items:
        if isinstance(item, str):
            score = weights.tags.get(item, weights.tags["<other>"])
        else:
            score = item.words * weights.word(item, kinds[id(item.box)], side)
        if score > 0:
            if last is not None:
                limit = GAP_WITHIN if last.beside(item) else GAP
                if cost < -limit:
                    out[since:] = [s * limit / -cost for s in out[since:]]
            last, since, cost = item, len(out) + 1, 0.0
        else:
            cost += score
        out.append(score)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run with the largest sum, the longest and then the first of equals."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total < 0:
            total, first = 0.0, k
        total += s
        if total > best or total == best and found[1] and k + 1 - first > found[1] - found[0]:
            best, found = total, (first, k + 1)
    return found


def main_text(page: str | None, weights: Weights | None = None) -> str:
    if not page:
        return ""
    weights = weights or learned()
    items, pieces, boxes = parts(page)
    kinds = _kinds(boxes)
    wheres = {i.where for i in items if not isinstance(i, str)}
    most, region, scored = 0.0, (0, 0), []
    for side in ("main", "outside") if wheres == {"main", "outside"} else ("",):
        found = scores(items, kinds, weights, side)
        first, end = best_region(found)
        weight = weights.sides.get(side, 1.0) * sum(items[k].words for k in range(first, end) if found[k] > 0)
        if weight > most:
            most, region, scored = weight, (first, end), found
    units = [k for k in range(*region) if not isinstance(items[k], str)]
    positive = [k for k in units if scored[k] > 0]
    if not positive:
        return ""
    kept = {id(items[k]) for k in units if scored[k] > 0 or not positive[0] < k < positive[-1]}  # the others are insets
    joined = []
    for block in range(items[units[0]].block, items[units[-1]].block + 1):
        own = pieces.get(block)
        if own:
            joined.append(" ".join("".join(piece for unit, piece in own if unit is None or id(unit) in kept).split()))
    return "\n\n".join(b for b in joined if b)


class _Words:
    """Words that are all distinct, and which of them are main text."""

    def __init__(self, seed: int):
        self.rng, self.serial, self.kept = random.Random(seed), 0, []

    def __call__(self, lo: int, hi: int) -> str:
        k = self.rng.randint(lo, hi)
        self.serial += k
        return " ".join(f"w{self.serial - j}" for j in range(k))

    def keep(self, lo: int, hi: int) -> str:
        self.kept.append(self(lo, hi))
        return self.kept[-1]

    def taken(self) -> list[str]:
        out, self.kept = " ".join(self.kept).split(), []
        return out


def labelled_pages(n: int = 200, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages laid out by rule, each with the words that make up its main text; all words are distinct."""
    words, out = _Words(seed), []
    rng, keep = words.rng, words.keep
    for _ in range(n):
        links = lambda k: "".join(f"<li><a href='/x'>{words(1, 2)}</a></li>" for _ in range(k))
        body = [f"<h1>{keep(3, 9)}</h1>"]
        layouts = [lambda: f"<p>{keep(8, 60)}</p>"] * 5 + [
            lambda: f"<p>{keep(4, 20)} <a href='/y'>{keep(1, 3)}</a> {keep(2, 9)}</p>", lambda: f"<h2>{keep(2, 5)}</h2>",
            lambda: f"<ul><li>{keep(2, 8)}</li><li>{keep(2, 8)}</li></ul>", lambda: f"<blockquote>{keep(5, 20)}</blockquote>",
        ]
        for _ in range(rng.randint(2, 9)):
            body.append(rng.choice(layouts)())
            if rng.random() < 0.2:
                body.append(f"<div class='{rng.choice(['ad', 'share', 'related', 'promo'])}'>{words(3, 12)}</div>")
        around = rng.choice(["article", "main", "div", "section"])
        before = f"<header><div>{words(1, 4)}</div></header>" * rng.randint(0, 1) + f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>" + f"<div class='ad'>{words(4, 14)}</div>" * rng.randint(0, 2)
        bare = lambda: "<div>" + " ".join(f"<a href='/z'>{words(1, 3)}</a>" for _ in range(rng.randint(4, 12))) + "</div>"
        before += bare() if rng.random() < 0.5 else ""
        after = (bare() if rng.random() < 0.5 else "") + f"<aside><ul>{links(rng.randint(2, 6))}</ul></aside>" * rng.randint(0, 1) + f"<section class='comments'><p>{words(5, 30)}</p></section>" * rng.randint(0, 2) + f"<form><label>{words(1, 3)}</label><input></form>" * rng.randint(0, 1) + f"<footer>{words(3, 9)}</footer>"
        out.append((f"<html><head><title>{words(3, 8)}</title></head><body>{before}<{around}>{''.join(body)}</{around}>{after}</body></html>", words.taken()))
    return out


def beside_pages(n: int = 200, seed: int = 8) -> list[tuple[str, list[str]]]:
    """Like ``labelled_pages``: an article with plain text beside it, or a plain box with teaser articles beside it."""
    words, out = _Words(seed), []
    rng = words.rng
    for _ in range(n):
        body = f"<h1>{words.keep(3, 9)}</h1>" + "".join(f"<p>{words.keep(20, 60)}</p>" for _ in range(rng.randint(3, 8)))
        if rng.random() < 0.5:
            body = f"<article>{body}</article>"
            beside = [f"<div class='{rng.choice(['intro', 'about', 'line'])}'>{words(3, 20)}</div>" for _ in range(rng.randint(1, 3))]
        else:
            body = f"<div class='{rng.choice(['story', 'text', 'content'])}'>{body}</div>"
            beside = [f"<article class='{rng.choice(['card', 'tile', 'item'])}'><h3><a href='/t'>{words(2, 5)}</a></h3><p>{words(4, 14)}</p></article>" for _ in range(rng.randint(1, 3))]
        cut = rng.choice([0, 0, len(beside)])
        menu = "".join(f"<li><a href='/x'>{words(1, 2)}</a></li>" for _ in range(rng.randint(3, 9)))
        out.append((f"<html><body><nav><ul>{menu}</ul></nav>{''.join(beside[:cut])}{body}{''.join(beside[cut:])}<footer>{words(3, 9)}</footer></body></html>", words.taken()))
    return out


def linked_pages(n: int = 200, seed: int = 10) -> list[tuple[str, list[str]]]:
    """Like ``labelled_pages``: articles with paragraphs, items and cells that are links, and the same in boxes that are not text."""
    words, out = _Words(seed), []
    rng, keep = words.rng, words.keep
    sure = sorted(MARKS - EVERYDAY - {"header", "masthead"})
    for _ in range(n):
        a = lambda of, lo, hi: f"<a href='/l'>{of(lo, hi)}</a>"
        listed = lambda of, tag: f"<{tag}>" + "".join(f"<li>{a(of, 1, 12)}</li>" for _ in range(rng.randint(1, 6))) + f"</{tag}>"
        shapes = [lambda of: f"<p>{a(of, 1, 14)}</p>", lambda of: listed(of, "ul"), lambda of: listed(of, "ol"), lambda of: f"<table><tr><td>{a(of, 1, 5)}</td><td>{of(1, 6)}</td></tr></table>", lambda of: f"<dl><dt>{a(of, 1, 4)}</dt><dd>{of(3, 12)}</dd></dl>", lambda of: f"<blockquote>{a(of, 2, 9)}</blockquote>"]
        boxes = [lambda inner: f"<nav>{inner}</nav>", lambda inner: f"<aside>{inner}</aside>", lambda inner: f"<footer>{inner}</footer>", lambda inner: f"<div class='{rng.choice(sure)}'>{inner}</div>", lambda inner: f"<section class='related-posts'>{inner}</section>", lambda inner: f"<div class='{rng.choice(sure)}-{rng.choice(sorted(BOXES))}'>{inner}</div>"]
        around = rng.choice(["article", "main", "article class='post'"])
        body = [f"<h1>{keep(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 7)):
            body.append(f"<p>{keep(6, 50)}</p>" if rng.random() < 0.5 else rng.choice(shapes)(keep))
            if rng.random() < 0.4:
                body.append(rng.choice(boxes)(rng.choice(shapes)(words)))
        before = f"<header>{words(1, 5)}</header><nav>{listed(words, 'ul')}</nav>" + f"<div>{' '.join(a(words, 1, 3) for _ in range(rng.randint(2, 9)))}</div>" * rng.randint(0, 1)
        after = f"<div class='{rng.choice(sure)}'>{rng.choice(shapes)(words)}</div>" * rng.randint(0, 1) + f"<ul>{listed(words, 'ul')}</ul>" * rng.randint(0, 1) + f"<footer>{listed(words, 'ul')}</footer>"
        out.append((f"<body>{before}<{around}>{''.join(body)}</{around.split()[0]}>{after}</body>", words.taken()))
    return out


def boxed_pages(n: int = 300, seed: int = 9) -> list[tuple[str, list[str]]]:
    """Like ``labelled_pages``: boxes of every kind of name among the text, some of them part of it."""
    words, out = _Words(seed), []
    rng, keep = words.rng, words.keep
    sure, everyday = sorted(MARKS - EVERYDAY - {"header", "masthead"}), sorted(EVERYDAY)
    filler = "my the of on study results policy history w x".split()
    many = lambda of: "".join(f"<p>{of(2, 30)}</p>" for _ in range(rng.randint(1, 4)))
    long = lambda: f"<p>{keep(40, 60)}</p>" + (f"<p>{keep(1, 30)}</p>" if rng.random() < 0.5 else "")
    for _ in range(n):
        linked = lambda: " ".join(f"<a href='/z'>{words(1, 3)}</a>" for _ in range(rng.randint(1, 25)))
        name = lambda: rng.choice([rng.choice(sure), f"{rng.choice(sure)}-{rng.choice(sorted(BOXES))}", f"{rng.choice(everyday)}-{rng.choice(sorted(BOXES))}"])
        ending = lambda: f"{rng.choice(filler)}-{rng.choice(sure)}"
        beginning = lambda: f"{rng.choice(sure)}-{rng.choice(filler)}" + (f"-{rng.choice(filler)}" if rng.random() < 0.5 else "")
        element = lambda: rng.choice(["div", "section"])
        box = lambda e, attributes, inner: f"<{e} {attributes}>{inner}</{e}>"
        kinds = [
            lambda: box(element(), f"class='{name()}'", rng.choice([words(1, 70), many(words), linked()])), lambda: box(element(), f"id='{name()}'", rng.choice([words(1, 30), many(words)])),
            lambda: box(element(), f"class='{ending()}'", rng.choice([words(1, 12), linked()])), lambda: box(element(), f"class='{ending()}'", long()),
            lambda: box(element(), f"class='{beginning()}'", rng.choice([words(1, 2), linked()])), lambda: box(element(), f"class='{beginning()}'", rng.choice([long, lambda: many(keep)])()),
            lambda: f"<div>{words(1, 3)} {linked()}</div>",
            lambda: box(element(), f"class='{rng.choice(everyday)}'", rng.choice([words(1, 12), linked()])), lambda: box(element(), f"class='{rng.choice(everyday)}'", long()),
            lambda: box("section", f"class='{rng.choice(everyday)}-{rng.choice(filler)}'", many(keep)), lambda: f"<h2 id='{rng.choice(everyday)}'>{keep(1, 5)}</h2>", lambda: box("section", f"id='{rng.choice(everyday)}'", many(keep)),
            lambda: box("p", rng.choice(["hidden", "style='display:none'", "aria-hidden='true'"]), words(1, 40)), lambda: f"<aside>{many(words)}</aside>", lambda: f"<form>{words(1, 9)}<input></form>",
            lambda: f"<button>{words(1, 3)}</button>", lambda: f"<dialog>{many(words)}</dialog>", lambda: f"<nav>{linked()}</nav>", lambda: f"<menu><li>{words(1, 3)}</li></menu>", lambda: f"<fieldset>{words(1, 9)}</fieldset>",
            lambda: f"<footer>{words(1, 20)}</footer>", lambda: f"<div class='{rng.choice(filler)}'><article class='comment-{rng.choice(filler)}'>{many(words)}</article></div>",
        ]
        plain = [lambda: f"<p>{keep(1, 60)}</p>"] * 4 + [lambda: f"<div>{keep(2, 30)}</div>", lambda: f"<h3>{keep(1, 6)}</h3>", lambda: f"<figure><figcaption>{keep(1, 9)}</figcaption></figure>", lambda: f"<ol><li>{keep(1, 12)}</li><li><a href='/q'>{keep(1, 3)}</a> {keep(2, 9)}</li></ol>", lambda: f"<pre>{keep(1, 20)}</pre>", lambda: f"<table><tr><td>{keep(1, 4)}</td><td>{keep(1, 4)}</td></tr></table>", lambda: f"<dl><dt>{keep(1, 3)}</dt><dd>{keep(3, 20)}</dd></dl>"]
        body = [f"<h1>{keep(2, 9)}</h1>" if rng.random() < 0.5 else f"<header><h1>{keep(2, 9)}</h1></header>" if rng.random() < 0.5 else ""]
        body += [f"<p>{keep(20, 60)}</p>"]
        for _ in range(rng.randint(1, 8)):
            body += [rng.choice(plain)() for _ in range(rng.randint(0, 3))]
            if rng.random() < 0.6:
                body.append(rng.choice(kinds)())
        body += [f"<p>{keep(20, 60)}</p>"]
        around = rng.choice(["article", "article", "main", "div", "div class='story'", "div class='page has-sidebar'"])
        if around[:3] == "div":
            body = [b for b in body if not b.startswith("<header>")] if body[0].startswith("<header>") and not words.kept else [b.replace("<header>", "").replace("</header>", "") for b in body]
        before = f"<div class='{name()}'>{words(1, 9)}</div>" * rng.randint(0, 1) + f"<header>{words(1, 6)}</header>" * rng.randint(0, 1)
        after = f"<div id='{rng.choice(sure)}'>{many(words)}</div>" * rng.randint(0, 1) + f"<footer>{words(1, 20)}</footer>" * rng.randint(0, 1)
        out.append((f"<body>{before}<{around}>{''.join(body)}</{around.split()[0]}>{after}</body>", words.taken()))
    return out


@lru_cache(maxsize=1)
def learned() -> Weights:
    """Weights of units by logistic regression with a weak pull to 0; of tags and sides, log-odds with a count of one each way."""
    inside, outside, sides = Counter(), Counter(), Counter()
    names: dict[str, int] = {}
    rows, wanted = [], []
    for page, kept in labelled_pages() + beside_pages() + boxed_pages() + linked_pages():
        main = set(kept)
        items, pieces, boxes = parts(page)
        kinds = _kinds(boxes)
        text: dict[int, list[str]] = {}
        for own in pieces.values():
            for unit, piece in own:
                text.setdefault(id(unit), []).extend(piece.split())
        known = [k for k, i in enumerate(items) if not isinstance(i, str) and not main.isdisjoint(text[id(i)])]
        both = {i.where for i in items if not isinstance(i, str)} == {"main", "outside"}
        side = items[known[0]].where if both else ""
        for k, item in enumerate(items):
            if isinstance(item, str):
                (inside if known[0] <= k <= known[-1] else outside)[item] += 1
                continue
            is_main = not main.isdisjoint(text[id(item)])
            seen = features(item, kinds[id(item.box)]) + ([OTHER_SIDE] if side and item.where != side else [])
            rows.append([names.setdefault(f, len(names)) for f in seen])
            wanted.append(is_main)
            if both and not kinds[id(item.box)]:
                sides[item.where, is_main] += item.words
    tags = {k: min(-0.05, math.log((inside[k] + 1) / (outside[k] + 1)) / 8) for k in inside | outside}
    design = np.zeros((len(rows), len(names)))
    for k, row in enumerate(rows):
        design[k, row] = 1.0
    target, w = np.array(wanted, float), np.zeros(len(names))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(hessian, design.T @ (p - target) + 0.5 * w)
    weighed = {s: math.log((sides[s, True] + 1) / (sides[s, False] + 1)) for s in ("main", "outside")}
    return Weights(dict(zip(names, w.tolist())), {**tags, "<other>": -0.1}, weighed)


def extract(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """The other columns of ``pages`` with ``into`` and ``n_chars``, its code points; columns of those names give way."""
    storage.prepare(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (into, "n_chars", page)]
    schema = T.StructType([*kept, T.StructField(into, T.StringType()), T.StructField("n_chars", T.LongType())])
    source = pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{page}`").alias("__page"))
    weights = learned()

    def run(batches):
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return storage.map_arrow(source, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(storage.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
