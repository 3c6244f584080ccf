"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. Text in an element that by
its name, class, id or role is a menu, header, footer, sidebar, notice, advert, form,
script, style or comment section has no weight: a line of such text alone has none, of a
line with other text an inline element of that kind loses its own. Nor has a line outside
articles that is mostly links and no paragraph. A name made of such a word and words of
layout only, as comment-list, marks an element everywhere; a class name that has such a word
beside others marks one outside articles, unless an article stands in it. Sums of the weights over a sliding window of lines show where text surges
and where it dives: a stretch starts at the first weighty line of a surge and goes on until
the sums dive to nothing. The heaviest stretch is the core of the text; an article or main
element is one whole and counts twice. The text is the core and every stretch that belongs
to it: one that surges to a quarter of the core's height, stands in the same element, or
lies between stretches of the text. Other article elements stay too, but for cards beside a
text that stands outside: those with a line of links and under a quarter of its length.
Lines without weight are left out, every other line of the text is kept however short.

Null and empty pages, and pages without any text, give an empty text; equal pages give equal
texts, however often they come; a null page_id or url is kept; an empty table gives an empty
one; other columns are not read. Long pages are read whole, in time that grows with their
length. Text after an
unfinished tag at the end is dropped with it; unknown character references stay. Optional
end tags are implied, head among them. An element without page text that is never closed
loses only its start tag, a title what follows up to the next tag; an open script or style
takes the rest of the page, as in browsers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, slices, source

WINDOW = 3
#: How often an article or main element counts; the part of the core's height or length from which a stretch or an article is more than something beside it.
ARTICLE, SHARE = 2, 4
#: Elements whose stretches belong together.
CONTAINERS = frozenset("article body div main td".split())
#: Elements that start a line.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not page text.
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea title select".split())
#: Of these, those that can stand in one another, those that "/>" closes, and those that take the rest of the page if not closed.
NESTED, EMPTY, ENDLESS = frozenset("svg math object template".split()), frozenset("svg math".split()), frozenset("script style".split())
#: Elements beside the article.
BESIDE = frozenset("nav footer aside form menu dialog button fieldset header label".split())
#: Words of class, id or role that mark what is beside the article.
WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Of these, words of comment sections, which ids of sections in articles may have, too, and words that names of whole layouts have.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
LAYOUT = frozenset("banner footer form header masthead menu menubar nav navbar navigation sidebar toolbar widget".split())
#: Words that say no more than where or how something stands.
NEUTRAL = frozenset("area bar block body bottom box btn button buttons container content count counter fixed group holder icon icons inner item items left link links list main module outer page panel post posts reader readers right row section site slot sticky thread top unit user users wrap wrapper zone".split())
#: Words of a class name that says what a layout has or lacks.
NEGATIONS = frozenset("has no non not with without".split())
#: Fixed value: characters from which a paragraph that is mostly a link is text.
LONG_LINK = 40
#: Marks by parts of class names, which an article inside refutes, and all others.
WEAK, STRONG = 1, 2
_HEADERS = frozenset(("header", "masthead"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open paragraph; elements that end others by their start, and the elements this does not reach beyond.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul dd dt li".split())
_SCOPE = frozenset("button caption table td th".split())
_P, _PARAGRAPHS = frozenset(("p",)), frozenset(("p", "blockquote"))
_LISTS, _TABLE = frozenset("ul ol menu dir table td th".split()), frozenset(("table",))
_IMPLIED = {
    "li": (frozenset(("li",)), _LISTS), "dd": (frozenset(("dd", "dt")), _LISTS | {"dl"}), "dt": (frozenset(("dd", "dt")), _LISTS | {"dl"}),
    "td": (frozenset(("td", "th")), _TABLE), "th": (frozenset(("td", "th")), _TABLE), "tr": (frozenset(("tr", "caption", "colgroup")), _TABLE),
    **{name: (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup")), _TABLE) for name in ("tbody", "thead", "tfoot")},
}
#: How far an end tag reaches.
_REACH = {"p": _SCOPE} | {name: bound for name, (_, bound) in _IMPLIED.items()}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</?\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*))?""")
_PART = re.compile(r"[a-z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)


def attributes(rest: str) -> dict[str, str]:
    """Attribute names in lower case and their values; of a repeated one the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def self_closed(rest: str) -> bool:
    """Whether a tag ends in a slash that is no part of an unquoted value."""
    if not rest.endswith("/"):
        return False
    _, equals, value = rest.rsplit(None, 1)[-1].rpartition("=")
    return not equals or value[0] in "'\"/"


def closings(page: str, name: str, start: int) -> dict[int, int]:
    """Where each element of this name from `start` on ends, by the end of its start tag; those never closed are left out."""
    out, opened = {}, []
    for tag in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I).finditer(page, start):
        if not tag[1]:
            if not (name in EMPTY and self_closed(tag[2])):
                opened.append(tag.end())
        elif opened:
            out[opened.pop()] = tag.end()
    return out


class Element(NamedTuple):
    name: str
    #: WEAK or STRONG if the element is beside the article.
    mark: int
    link: bool
    #: The numbers of the outermost article or main element and of the innermost container around its text; 0 for none.
    article: int
    container: int


class Open:
    """The open elements, the places of each name among them and of marks, so that no tag costs a walk through all."""

    def __init__(self):
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.strong = 0
        self.weak: list[int] = []

    @property
    def beside(self) -> bool:
        return bool(self.strong or self.weak)

    def top(self) -> Element:
        return self.stack[-1] if self.stack else Element("", 0, False, 0, 0)

    def push(self, e: Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.stack))
        if e.mark == WEAK:
            self.weak.append(len(self.stack))
        self.strong += e.mark == STRONG
        self.stack.append(e)

    def innermost(self, names: frozenset[str]) -> int:
        """The place of the innermost of these, -1 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def end(self, names: frozenset[str], bound: frozenset[str]) -> None:
        """Take the innermost open element of these names, with all in it, off, unless an element of `bound` is nearer."""
        at = self.innermost(names)
        if at >= 0 and at > self.innermost(bound - names):
            while len(self.stack) > at:
                e = self.stack.pop()
                self.places[e.name].pop()
                self.strong -= e.mark == STRONG
            while self.weak and self.weak[-1] >= at:
                self.weak.pop()

    def unmark(self) -> None:
        """An article stands here: elements around it that only seemed to be beside it are not."""
        self.weak.clear()


def marked(name: str, given: dict[str, str], article: bool) -> tuple[set[str], set[str]]:
    """The words of class, id and role that mark what is beside the article for certain, and those that only seem to.

    Certain are whole names, and names of such words and of layout only; the latter, if they
    may name a whole layout, only inside an article. Other parts of names seem to mark, outside
    articles. Ids of headings are names of places, and so are those of sections, but for whole
    ones outside articles and comment sections. A name that says what is there or not, like
    no-sidebar, is no mark.
    """
    certain: set[str] = set()
    seeming: set[str] = set()
    for mark in ("class", "id", "role"):
        is_id = mark == "id"
        if is_id and name in HEADINGS:
            continue
        of_section = is_id and name == "section"
        for n in given.get(mark, "").lower().split():
            if n in WORDS and not (of_section and article and n not in COMMENTS):
                certain.add(n)
                continue
            parts = set(_PART.findall(n))
            found = parts & WORDS
            if not found or parts & NEGATIONS:
                continue
            only = parts <= WORDS | NEUTRAL and not (of_section and not found & COMMENTS)
            if only and (article or not found <= LAYOUT):
                certain |= found
            elif not (article or of_section):
                seeming |= found
    return certain, seeming - certain


class Line(NamedTuple):
    text: str
    weight: int
    #: The numbers of the outermost article or main element and of the innermost container; 0 for none.
    article: int
    container: int
    mostly_linked: bool


def lines_of(page: str) -> list[Line]:
    """Each line in page order; white space is folded."""
    out: list[Line] = []
    stack, here = Open(), Element("", 0, False, 0, 0)
    words: list[str] = []
    beside: list[str] = []
    linked = at = number = 0
    closed: dict[str, dict[int, int]] = {}
    unclosed: set[str] = set()

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            mostly = 2 * linked > len(text) and not (here.name in _PARAGRAPHS and len(text) >= LONG_LINK)
            out.append(Line(text, 0 if mostly and not here.article else len(text), here.article, here.container, mostly))
        elif text := " ".join(html.unescape("".join(beside)).split()):
            out.append(Line(text, 0, here.article, here.container, False))
        words.clear()
        beside.clear()
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        if text and stack.beside:
            beside.append(text)
        elif text:
            words.append(text)
            if here.link:
                linked += len(text.strip())

    end = len(page)
    while at < end:
        tag = _TAG.search(page, at)
        if tag is None:
            put(page[at:])
            break
        put(page[at : tag.start()])
        at = tag.end()
        closing, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS and name != "br":
            end_line()
        elif name == "br":
            words.append(" ")
        if closing:
            stack.end(frozenset((name,)), _REACH.get(name, frozenset()))
        elif name in NESTED:
            if not (name in EMPTY and self_closed(rest)):
                if name not in closed:
                    closed[name] = closings(page, name, tag.start())
                at = closed[name].get(at, at)
            continue
        elif name in RAW:
            found = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if found:
                at = found.end()
                continue
            unclosed.add(name)
            if name in ENDLESS:
                at = end
            elif name == "title":
                at = found if (found := page.find("<", at)) >= 0 else end
            continue
        elif name == "head":
            continue
        elif name == "hr":
            stack.end(_P, _SCOPE)
        elif name not in VOID:
            if name in _ENDS_P:
                stack.end(_P, _SCOPE)
            if name in _IMPLIED:
                stack.end(*_IMPLIED[name])
            here, is_article = stack.top(), name in ("article", "main")
            given = attributes(rest)
            certain, seeming = marked(name, given, bool(here.article) or is_article)
            marks, hidden = certain | seeming, "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(given.get("style", "")))
            mark = STRONG if name in BESIDE or certain or hidden else WEAK if seeming else 0
            if mark and not hidden and here.article and not stack.beside and (name == "header" or marks <= _HEADERS and name not in BESIDE):
                mark = 0
            if is_article and marks <= _HEADERS or name in ("html", "body"):
                mark = STRONG if hidden else 0
            if is_article and not mark:
                stack.unmark()
                here = stack.top()
            number += 1
            stack.push(Element(name, mark, here.link or name == "a", here.article or (number if is_article else 0), number if name in CONTAINERS else here.container))
        here = stack.top()
    end_line()
    return out


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """First line and line after the last of each stretch between a surge and a dive."""
    sums = [sum(weights[i : i + window]) for i in range(len(weights))]
    out, start = [], None
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start = i
        elif not s and start is not None:
            out.append((start, i))
            start = None
    return out


def between(weights: list[int], window: int = WINDOW) -> tuple[int, int]:
    """The heaviest stretch."""
    return max(stretches(weights, window), key=lambda x: (sum(weights[slice(*x)]), -x[0]), default=(0, 0))


def height(weights: list[int], window: int = WINDOW) -> int:
    """The largest sum of a window."""
    return max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines = lines_of(page or "")
    weights = [line.weight for line in lines]
    parts: list[list[int]] = []  # the weighty lines of each stretch outside, and of each article or main element as a whole
    inside: dict[int, list[int]] = {}
    for first, end in stretches(weights, window):
        last = None
        for i in range(first, end):
            a = lines[i].article
            if not weights[i]:
                continue
            if a:
                if a not in inside:
                    parts.append(inside.setdefault(a, []))
                inside[a].append(i)
            elif last == 0:
                parts[-1].append(i)
            else:
                parts.append([i])
            last = a
    if not parts:
        return ""
    shared = Counter()  # a text outside counts whole, also when adverts split it
    for line in lines:
        if not line.article:
            shared[line.container] += line.weight
    mass = [sum(weights[i] for i in part) for part in parts]
    mass = [m if lines[part[0]].article else max(m, *(shared[lines[i].container] for i in part)) for m, part in zip(mass, parts)]
    core = max(range(len(parts)), key=lambda k: (mass[k] * (ARTICLE if lines[parts[k][0]].article else 1), -k))
    high = [height(weights[part[0] : part[-1] + 1] if not lines[part[0]].article else [weights[i] for i in part], window) for part in parts]
    outside = not lines[parts[core][0]].article
    home = {lines[i].container for i in parts[core]}
    card, kept = [False] * len(parts), [False] * len(parts)
    for k, part in enumerate(parts):
        if lines[part[0]].article:
            card[k] = outside and SHARE * mass[k] < mass[core] and any(lines[i].mostly_linked for i in part)
            kept[k] = not card[k]
        else:
            kept[k] = k == core or SHARE * high[k] >= high[core] or outside and any(lines[i].container in home for i in part)
    of_text = [i for k, part in enumerate(parts) if kept[k] for i in part]
    first, last = min(of_text), max(of_text)
    chosen = {i for k, part in enumerate(parts) if not card[k] for i in part if kept[k] or first < i < last}
    return " ".join(lines[i].text for i in sorted(chosen))


def _extracted(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for part in slices(batches, "html"):
        yield batch_of(schema, {"page_id": part["page_id"], "url": part["url"], "text": [main_text(h) for h in part["html"].to_pylist()]})


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, url, text. Needs no shuffle."""
    pages = source(pages, page_id=page_id, url=url, html=html).withColumn("page_id", F.col("page_id").cast("long"))
    return pages.mapInArrow(_extracted, "page_id long, url string, text string")
