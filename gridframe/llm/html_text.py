"""Main text of web pages by the maximum-scoring run of words and tags.

A page is read once into a list of items: runs of words, by where they stand, and
opening tags, by name and by whether they are marked (a class, id or role that
names a part beside the article). Words score above zero and tags below; the run
of items with the greatest sum, found in one linear scan, is the content region.
It is completed by the blocks beside it in the container that holds it: all of
its article, if it lies in one, else those that aren't mostly links. Menus,
headers, footers, sidebars, forms and marked elements are left out of it where
their items sum below zero, unless one holds MOSTLY times as much as the best run
of all else: an article in a form, or under a class such as "legal-text", stays.

The weights come from labelled pages: those that name their own main part with a
single <article> or <main>. A structured perceptron raises the weights of items
that a labelled region has and the best run misses, and lowers the others, with
words kept above zero and tags below. It starts from a flat rule, a word +1 and a
tag -1; kinds that no labelled page shows keep the weights in FIRST, as all do
without labelled pages.

Scale: weights are fitted on a bounded sample (`limit` pages, reduced to items on
the executors); extraction is one pass over whole pages in Arrow batches.

Cases: null and empty pages, and pages without words of content, give an empty
text; repeated rows give equal texts; broken markup (unclosed or stray tags,
quotes and comments) is read as far as it can be; an empty table gives no rows;
pages of any length and depth are read whole, in linear time. What a page hides
(hidden, display:none) and what isn't text (scripts, styles, controls, media) is
never part of it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm.common import cut, slices

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))|([^\s=/\"'<>]++)")
HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img td th".split())
NO_TEXT = set("head button select option datalist noscript template svg canvas object audio video map".split())
ASIDE = set("nav footer aside form menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE = re.compile(
    r"(?:site|page|global|main|top|bottom|left|right|primary|secondary|mobile|user|reader|article|post|blog|the)?[-_]?"
    r"(?:ads?|adverts?|advertisements?|adsense|adslot|adbox|sponsor(?:ed)?|promo(?:tions?)?|banner|cookies?|consent|gdpr|notices?|notification|alert|newsletter|subscri(?:be|ption)|signup|login|"
    r"sidebar|nav|navbar|navigation|menus?|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|disqus|respond|replies|share|sharing|social|related|recommended|recommendations|trending|popular|"
    r"popup|modal|overlay|widgets?|pagination|pager|toolbar|skip-?link|legal|copyright|disclaimer|search)"
    r"(?:[-_]?(?:\d|box|bar|block|area|list|section|container|wrapper|wrap|link|menu|top|bottom|left|right|inner|outer|unit|slot|banner|form|thread|item|message|notice|panel|content|text|row|s))*",
    re.I,
)
HEADER = re.compile(r"(?:(?:site|page|global|main|top|blog)[-_]?)?header(?:[-_]?(?:bar|inner|wrap|wrapper|container|top))*", re.I)
ENDED_BY_LIKE = {"p", "li", "dt", "dd", "tr", "td", "th"}
ARTICLES = ("article", "main")
KINDS = (
    "plain", "link", "heading", "beside", "marked", "<p>", "<br>", "<inline>", "<a>", "<li>", "<h>", "<container>", "<table>", "<other>",
    "<nav>", "<footer>", "<aside>", "<form>", "<header>", "<marked>",
)
WORD_KINDS = 5
FIRST = np.array([1.0, 0.3, 1.0, 0.05, 0.05, -0.3, -0.5, -0.2, -3.0, -2.0, -0.3, -2.0, -2.0, -1.0, -8.0, -8.0, -8.0, -8.0, -6.0, -12.0])
MOSTLY = 20
FLAT = np.where(np.arange(len(KINDS)) < WORD_KINDS, 1.0, -1.0)
PLAIN, LINK, HEADING, BESIDE, MARKED = range(WORD_KINDS)
TAG_KIND = {
    tag: KINDS.index(kind)
    for kind, tags in {
        "<p>": "p", "<br>": "br", "<a>": "a", "<li>": "li dt dd", "<h>": "h1 h2 h3 h4 h5 h6", "<container>": "div section article main ul ol", "<table>": "table tr td th",
        "<nav>": "nav menu", "<footer>": "footer", "<aside>": "aside dialog", "<form>": "form fieldset",
    }.items()
    for tag in tags.split()
}
INLINE_KIND, OTHER_KIND, HEADER_KIND, MARK_KIND = (KINDS.index(k) for k in ("<inline>", "<other>", "<header>", "<marked>"))
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def tags_of(source: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag; an end tag's name begins with "/",
    a comment's or declaration's is empty. Every character is looked at a bounded
    number of times: once a tag's quotes find no end, quotes count no more."""
    at, size, last_end, quotes = 0, len(source), source.rfind(">"), True
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            yield start, at, "", ""
            continue
        if start > last_end:
            return
        if source.startswith(("<!", "<?"), start):
            at = source.find(">", start) + 1
            yield start, at, "", ""
            continue
        name = NAME.match(source, start + 1)
        if not name:
            at = start + 1
            continue
        end, k = -1, name.end()
        while quotes and (m := QUOTE_OR_END.search(source, k)):
            if m[0] == ">":
                end = m.start()
                break
            k = source.find(m[0], m.end()) + 1
            if not k:
                break
        if end < 0:
            quotes, end = False, source.find(">", name.end())
        at = end + 1
        yield start, at, name[0].lower(), source[name.end() : end]


def marks(attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether a tag's attributes hide it, and whether they name a part beside an article."""
    hidden = marked = False
    for m in ATTRIBUTE.finditer(attributes):
        name = (m[1] or m[5]).lower()
        value = m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            marked = marked or any(BOILERPLATE.fullmatch(v) or (not in_article and HEADER.fullmatch(v)) for v in value.split())
        elif name == "role":
            marked = marked or value.lower() in ROLES
        else:
            hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(HIDDEN.search(value)))
    return hidden, marked


@dataclass
class Element:
    """A tracked element: its tag, the element around it, its items from first up to
    last, whether it may be left out, and whether its text is never part of the page."""

    tag: str
    parent: int
    first: int
    last: int
    beside: bool
    unseen: bool


@dataclass
class Block:
    """Text between block-level tags: its items from first to last, the element that
    holds it, the innermost article (or 0), and the share of its words in links."""

    text: str
    first: int
    last: int
    element: int
    article: int
    linked: float


@dataclass
class Page:
    kinds: list[int]
    amounts: list[int]
    plain: list[int]  # the kinds, if words beside the article were like others
    owners: list[int]  # each item's innermost element that may be left out, or 0
    blocks: list[Block]
    elements: list[Element]
    main: tuple[int, int] | None  # the items of the only <article> or <main>


def read_page(source: str | None) -> Page:
    """The items, blocks and elements of a page."""
    source = source or ""
    kinds: list[int] = []
    amounts: list[int] = []
    plain: list[int] = []
    owners: list[int] = []
    blocks: list[Block] = []
    elements = [Element("", 0, 0, 0, False, False)]
    stack, articles, contexts = [0], [0], [(PLAIN, 0)]  # open elements, articles, kinds of words and owners
    open_tags: Counter = Counter()
    unseen = links = headings = 0
    parts: list[str] = []
    first = linked = words = 0

    def add_item(kind: int, amount: int) -> None:
        plain.append(kind)
        kinds.append((kind < WORD_KINDS and contexts[-1][0]) or kind)
        amounts.append(amount)
        owners.append(contexts[-1][1])

    def end_block() -> None:
        nonlocal first, linked, words
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, first, len(kinds) - 1, stack[-1], articles[-1], linked / max(1, words)))
            parts.clear()
        first, linked, words = len(kinds), 0, 0

    def add_text(raw: str) -> None:
        nonlocal linked, first, words
        if not raw or unseen:
            return
        text = entities.unescape(raw) if "&" in raw else raw
        if not parts:
            first = len(kinds)
        parts.append(text)
        n = len(text.split())
        if n:
            add_item(LINK if links else HEADING if headings else PLAIN, n)
            words += n
            linked += n * (links > 0)

    def close(tag: str) -> None:
        """Close the open elements up to and with the last of that name."""
        nonlocal unseen
        while open_tags[tag]:
            e = elements[stack.pop()]
            e.last = len(kinds)
            open_tags[e.tag] -= 1
            contexts.pop()
            if e.tag in ARTICLES:
                articles.pop()
            unseen -= e.unseen
            if e.tag == tag:
                break

    at = 0
    for start, end, tag, attributes in tags_of(source):
        if start < at:  # within a script
            continue
        add_text(source[at:start])
        at = end
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "a":
                links = max(0, links - 1)
            elif tag in HEADINGS:
                headings = max(0, headings - 1)
            if tag not in INLINE:
                end_block()
            close(tag)
            continue
        if tag in RAW:
            if tag != "title" and parts:
                parts.append(" ")
            e = RAW_END[tag].search(source, at)
            closed = source.find(">", e.end()) if e else -1
            at = closed + 1 if closed >= 0 else len(source)
            continue
        if tag == "br" or tag in ("td", "th"):
            if parts:
                parts.append(" ")
        elif tag not in INLINE:
            end_block()
            around = elements[stack[-1]].tag
            if around == "p" or (around == tag and tag in ENDED_BY_LIKE):
                close(around)
            if tag == "body":
                close("head")
        if tag == "a" and not attributes.rstrip().endswith("/"):
            links += 1
        elif tag in HEADINGS:
            headings += 1
        hidden, marked = marks(attributes, len(articles) > 1) if attributes.strip() and tag not in ("html", "body") else (False, False)
        beside = tag in ASIDE or (tag == "header" and len(articles) == 1)
        place = len(kinds)
        if not unseen:
            add_item(HEADER_KIND if beside and tag == "header" else TAG_KIND.get(tag, INLINE_KIND if tag in INLINE else OTHER_KIND), 1)
            if marked:
                add_item(MARK_KIND, 1)
        tracked = hidden or marked or beside or tag in NO_TEXT or open_tags[tag] > 0
        if tag not in VOID and (tracked or (tag not in INLINE and tag not in ("p", "html", "body") and tag not in HEADINGS)):
            elements.append(Element(tag, stack[-1], place, -1, beside or marked, hidden or tag in NO_TEXT))
            stack.append(len(elements) - 1)
            open_tags[tag] += 1
            unseen += elements[-1].unseen
            own = (MARKED if marked else BESIDE, stack[-1])
            contexts.append(own if marked or beside else (PLAIN, 0) if tag in ARTICLES else contexts[-1])
            if tag in ARTICLES:
                articles.append(stack[-1])
    add_text(source[at:])
    end_block()
    for i in stack:
        elements[i].last = len(kinds)
    named = [e for e in elements if e.tag == "article"] or [e for e in elements if e.tag == "main"]
    return Page(kinds, amounts, plain, owners, blocks, elements, (named[0].first + 1, named[0].last) if len(named) == 1 else None)


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last item of the run with the greatest sum; (0, -1) if none is positive."""
    best, found, total, start = 0.0, (0, -1), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i)
    return found


def fit_weights(pages: list[tuple[list[int], list[int], int, int]], rounds: int = 6, most: float = 0.05) -> np.ndarray:
    """Averaged weights by kind from pages (kinds, amounts, and the labelled items).

    Each error moves the weights by as much as sets the labelled run above the one
    found, by a word, up to `most` of the difference in items."""
    if not pages:
        return FIRST.copy()
    shown = np.zeros(len(KINDS), bool)
    for kinds, *_ in pages:
        shown[kinds] = True
    w = np.where(shown, FLAT, FIRST)
    total, n = np.zeros(len(KINDS)), 0
    for _ in range(rounds):
        for kinds, amounts, a, b in pages:
            k, x = np.array(kinds), np.array(amounts, float)
            lo, hi = best_run((w[k] * x).tolist())
            move = np.bincount(k[a:b], x[a:b], len(KINDS)) - np.bincount(k[lo : hi + 1], x[lo : hi + 1], len(KINDS))
            if move.any():
                w = w + min(most, (1 - float(w @ move)) / float(move @ move)) * move
                w[:WORD_KINDS] = np.maximum(w[:WORD_KINDS], 0.02)
                w[WORD_KINDS:] = np.minimum(w[WORD_KINDS:], -0.05)
            total += w
            n += 1
    return total / n


def left_out(page: Page, scores: np.ndarray, stay: set[int]) -> list[bool]:
    """Of each element: whether it, or one around it, may be left out and sums below zero."""
    sums = np.r_[0.0, np.cumsum(scores)]
    out = [False] * len(page.elements)
    for i, e in enumerate(page.elements[1:], 1):  # those around come first
        out[i] = i not in stay and (out[e.parent] or (e.beside and bool(sums[e.last] < sums[e.first])))
    return out


def region(page: Page, weights: np.ndarray) -> tuple[int, int, list[bool]]:
    """The best run's first and last item, and which elements are left out of it."""
    amounts = np.array(page.amounts, float)
    scores, stay = weights[np.array(page.kinds, int)] * amounts, set()
    plain, owners = weights[np.array(page.plain, int)] * amounts, np.array(page.owners, int)
    while True:
        out = left_out(page, scores, stay)
        gone = scores.copy()
        for i, e in enumerate(page.elements):
            if out[i] and not out[e.parent]:  # words that are left out speak for no run
                gone[e.first : e.last] = np.minimum(gone[e.first : e.last], 0)
        lo, hi = best_run(gone.tolist())
        if stay:
            return lo, hi, out
        held = np.bincount(owners, plain, len(page.elements))
        held[0] = 0
        most = int(held.argmax())
        if not out[most] or held[most] <= MOSTLY * max(0.0, gone[lo : hi + 1].sum()):
            return lo, hi, out
        stay = {most}
        scores = np.where(owners == most, plain, scores)


def extract(source: str | None, weights: np.ndarray) -> str:
    """The main text of a page: its blocks, joined by an empty line."""
    page = read_page(source)
    if not page.blocks:
        return ""
    lo, hi, out = region(page, weights)
    inside = [i for i, b in enumerate(page.blocks) if b.first <= hi and b.last >= lo and not out[b.element]]
    if not inside:
        return ""
    a, b = inside[0], inside[-1]
    article = page.blocks[a].article if len({page.blocks[i].article for i in inside}) == 1 else 0
    holder = article or shared_element(page, inside)
    within = elements_within(page, holder)

    def beside(i: int) -> bool:
        x = page.blocks[i]
        return out[x.element] or (within[x.element] and (bool(article) or x.linked <= 0.5))

    while a > 0 and beside(a - 1):
        a -= 1
    while b < len(page.blocks) - 1 and beside(b + 1):
        b += 1
    return "\n\n".join(x.text for x in page.blocks[a : b + 1] if not out[x.element])


def shared_element(page: Page, inside: list[int]) -> int:
    """The innermost element that holds all the blocks."""
    first, last = min(page.blocks[i].first for i in inside), max(page.blocks[i].last for i in inside)
    e = page.blocks[inside[0]].element
    while e and not (page.elements[e].first <= first and last < page.elements[e].last):
        e = page.elements[e].parent
    return e


def elements_within(page: Page, holder: int) -> list[bool]:
    """Of each element: whether it is the holder or within it; of the page itself, only it."""
    out = [False] * len(page.elements)
    out[holder] = True
    for i, e in enumerate(page.elements[1:], 1):
        out[i] = i == holder or (holder > 0 and out[e.parent])
    return out


def labelled_items(pages: DataFrame, limit: int, id_col: str = "page_id", html: str = "html") -> list[tuple[list[int], list[int], int, int]]:
    """Items of at most `limit` pages that name their main part: those whose hashed ids are least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        for part in slices(batches, ["__html"], text="__html"):
            rows = [(p.kinds, p.amounts, *p.main) for p in map(read_page, part["__html"]) if p.main]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kinds", "amounts", "a", "b"])

    named = pages.select(F.col(id_col).alias("__page"), F.col(html).alias("__html"))
    lower = F.lower("__html")
    named = named.where(lower.contains("<article") | lower.contains("<main"))
    # The ids are chosen first, so that no pages are moved but the sample's.
    chosen = cut(named.select("__page").distinct().orderBy(F.xxhash64("__page"), "__page").limit(limit)).withColumnRenamed("__page", "__chosen")
    sample = named.join(F.broadcast(chosen), F.col("__page") == F.col("__chosen"), "left_semi").select("__html")
    rows = sample.mapInArrow(run, "kinds array<int>, amounts array<int>, a long, b long").collect()
    return sorted((list(r["kinds"]), list(r["amounts"]), r["a"], r["b"]) for r in rows)


def main_texts(pages: DataFrame, weights: np.ndarray, id_col: str = "page_id", html: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in `also`, text and n_chars of each page."""
    rows = pages.select(F.col(id_col), *also, F.col(html).alias("__html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["text string", "n_chars long"])
    names = [id_col, *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in names]
            for part in slices(iter([batch]), [*names, "__html"], text="__html"):
                texts = [extract(h, weights) for h in part["__html"]]
                yield pa.RecordBatch.from_arrays([*[pa.array(part[c], k) for c, k in zip(names, kinds)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, schema)
