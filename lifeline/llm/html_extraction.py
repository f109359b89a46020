"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and runs of words. Words score above or below zero by where
they stand, tags below zero by their name; the contiguous region of the greatest sum is
the content (one linear scan). The scores are logarithms of how often a kind of word or
tag stood inside the content of labelled pages against outside, with stated counts
added beforehand, so that kinds never seen keep a plain score.

Labelled pages are those whose author marked one article with the ``article`` element;
``LABELLED`` of them, the first by a hash, are counted twice: with the mark seen, and with
it hidden, so that pages without the mark are scored by their other features.

Where a word stands, in this order: in an element that is no content (menus, footers,
forms, ... by name, role, or words of class and id), inside or outside the one article (or
else the one main part) that a page marks, in a link, and otherwise by the nearest block element. Elements
that are no content are left out of the region's text; they cost the region one
tag each, not every word, since articles have adverts between their paragraphs.

Within the region, text of block elements is joined by two line feeds; white space inside a
block becomes one space; character references are decoded; ``br`` is white space.

Rows: null pages are empty texts; pages without words give empty texts; unclosed and stray
tags are tolerated; repeated rows are extracted again; an empty table gives no rows and
needs no labelled page; other columns stay, but ``text`` and ``n_chars`` are replaced.
Ties take the earliest region. A page is held whole by its task, nothing else grows with it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifeline.llm.columns import without

# HTML's elements of each kind.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
MARKUP = frozenset("noscript template svg math select object".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in
       "script style textarea title xmp iframe noembed noframes noscript template svg math select object".split()}
BLOCKS = frozenset((
    "html head body p h1 h2 h3 h4 h5 h6 div ul ol li dl dt dd blockquote pre figure figcaption section article main header "
    "footer nav aside table caption thead tbody tfoot tr td th hr address details summary fieldset form center hgroup menu dialog").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KIND_OF = {name: kind for kind, names in (("p", "p blockquote pre figcaption dd"), ("heading", "h1 h2 h3 h4 h5 h6"),
                                          ("list", "li td th dt")) for name in names.split()}
#: Elements, roles, and words of class and id, that are no content.
NO_CONTENT = frozenset("nav aside footer form button dialog menu head label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset((
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert modal popup overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended recommendations trending teaser comment "
    "comments disqus respond reply replies pagination pager skip toolbar widget rail outbrain taboola copyright").split())
#: Words that make a name tell about something else than the element itself.
ABOUT = frozenset("has with no without not free wrapper container layout".split())
#: Elements that hold whole pages are not left out for their class.
PAGE = frozenset("html body main".split())
#: Elements that an opening one closes when it was left open.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}} | {h: {"p"} for h in HEADINGS | {"div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "footer", "header", "nav", "aside", "form", "main"}}

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<more>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
MAIN = re.compile(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articlebody\b""", re.I)
#: Copyright lines are notices, unless they stand in an article.
RIGHTS = re.compile(r"\s*(?:\xa9|copyright\b|\(c\)\s)", re.I)
SHORT = 30
WORD_OF_NAME = re.compile(r"[a-z]+")
HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Added counts (inside, outside) by kind, and for kinds not listed; the least size of a score.
PRIOR = {
    "in": (500, 1), "out": (1, 200), "p": (300, 20), "heading": (100, 20), "link": (20, 100), "other": (100, 40), "list": (60, 60),
    "<p>": (60, 60), "<h>": (60, 60), "<li>": (10, 60), "<a>": (20, 40), "<none>": (1, 3000),
}
PLAIN_PRIOR = (30, 60)
LEAST, MOST = 0.05, 8.0
#: Labelled pages that are counted, and kinds that are scored: more occur only where authors invent elements.
LABELLED = 2000
MOST_KINDS = 1000


class Run(NamedTuple):
    """Words (or a tag, when ``text`` is empty) at a place of the page."""
    kind: str
    words: int
    text: str
    block: int                    # runs of one block are one paragraph
    kept: bool                    # not in an element that is no content
    inside: int                   # in a marked article (1), in a marked main part (2)
    heading: bool


def names_no_content(word: str) -> bool:
    """Whether a class or id names what is no content; ``has-sidebar`` or ``ad-free`` do not."""
    parts = WORD_OF_NAME.findall(HUMPS.sub(" ", word).lower())
    told = next((i for i, p in enumerate(parts) if p in ABOUT), len(parts))
    return told == len(parts) and not NAMES.isdisjoint(parts)


def is_no_content(name: str, more: str, around: Counter, names: bool = True) -> bool:
    if name in NO_CONTENT:
        return True
    if name == "header" and not around["article"] and not around["main"]:
        return True
    if not more:
        return False
    for m in ATTRIBUTE.finditer(more):
        what, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if what == "hidden" and m.start() and more[m.start() - 1].isspace():
            return True
        if what == "aria-hidden" and value.lower() == "true":
            return True
        if what == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if what == "role" and value.lower() in ROLES:
            return True
        if what in ("class", "id") and name not in PAGE:
            if names and any(map(names_no_content, value.split())):
                return True
    return False


class Page:
    """Open elements of a page while its tokens pass."""

    def __init__(self, names: bool = True):
        self.by_names = names
        self.runs: list[Run] = []
        self.open: list[tuple[str, bool, int]] = []      # name, no content, the mark it sets
        self.names: Counter = Counter()
        self.gone = self.inside = self.block = 0
        self.marks = [0, 0, 0]

    def kind(self) -> str:
        if self.gone:
            return "none"
        for name, _, _ in reversed(self.open):
            if name == "a":
                return "link"
            if name in BLOCKS:
                return KIND_OF.get(name, "other")
        return "other"

    def words(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        if not text:
            return
        n, kind = len(text.split()), self.kind()
        if n <= SHORT and not self.inside & 1 and RIGHTS.match(text):
            kind = "none"
        self.runs.append(Run(kind, n, text, self.block, kind != "none", self.inside, kind == "heading"))

    def tag(self, name: str) -> None:
        self.runs.append(Run("<h>" if name in HEADINGS else f"<{name}>", 0, "", self.block, False, self.inside, False))

    def enter(self, name: str, more: str, alone: bool) -> None:
        if self.open and self.open[-1][0] in CLOSES.get(name, ()):
            self.leave()
        gone = is_no_content(name, more, self.names, self.by_names)
        mark = 0
        if not gone and not self.gone:
            mark = 1 if name == "article" else 2 if name == "main" or MAIN.search(more) else 0
            mark &= ~self.inside
        if not self.gone:
            self.tag("none" if gone else name)
        self.marks[mark] += 1
        self.block += name in BLOCKS
        if not alone:
            self.open.append((name, gone, mark))
            self.names[name] += 1
            self.gone += gone
            self.inside |= mark

    def leave(self) -> str:
        name, gone, mark = self.open.pop()
        self.names[name] -= 1
        self.block += name in BLOCKS
        if not self.gone:
            self.tag(name)
        self.gone -= gone
        self.inside &= ~mark
        return name

    def close(self, name: str) -> None:
        """An end tag also ends what was left open inside; without a start it is nothing."""
        if self.names[name] > 0:
            while self.leave() != name:
                pass


def runs_of(page: str, names: bool = True) -> list[Run]:
    """The page's runs of words and its tags, in order; ``names`` says whether class and id count."""
    state = Page(names)
    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        start, end = found.span() if found else (size, size)
        if start > at:
            state.words(page[at:start])
        at = end
        if not found or found["name"] is None:
            continue
        name = found["name"].lower()
        if found["end"]:
            state.close(name)
        elif name in RAW:
            close = RAW[name].search(page, at)
            if close or name not in MARKUP:
                at = close.end() if close else size
        elif name == "br":
            state.words(" ")
        elif name in VOID:
            state.block += name in BLOCKS
        else:
            state.enter(name, found["more"], name not in BLOCKS and found["more"].endswith("/"))
    # A mark tells something only where there is one of its kind.
    mark = 1 if state.marks[1] == 1 else 2 if state.marks[2] == 1 else 0
    return [r._replace(inside=(r.inside & mark) > 0) for r in state.runs]


def kinds(runs: list[Run], marked: bool) -> list[str]:
    """Kinds as they are scored: of a page with a mark, words are inside or outside of it."""
    return [("in" if r.inside else "out") if marked and r.words and r.kept else r.kind for r in runs]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each kind stands inside and outside the article of labelled pages."""
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            runs = runs_of(page.as_py() or "")
            if not any(r.inside for r in runs):
                continue           # an article that is no content itself, or several
            for marked in (True, False):
                for r, kind in zip(runs, kinds(runs, marked)):
                    # With the mark hidden, the words around still tell inside from outside.
                    counts[kind, r.inside] += r.words or (not marked)
    names = ["kind", "inside", "n"]
    yield pa.RecordBatch.from_arrays([
        pa.array([k for k, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.bool_()),
        pa.array(list(counts.values()), pa.int64())], names)


def weights(pages: DataFrame, text: str = "html", labelled: int = LABELLED) -> dict[str, float]:
    """Scores by kind, from the labelled pages whose hashes are the ``labelled`` least ones."""
    page = F.col(f"`{text}`").cast("string")
    rows = pages.select(page.alias("page"), F.xxhash64(page).alias("hash")).where(F.col("page").rlike("(?i)<article[\\s>]"))
    last = rows.select("hash").distinct().orderBy("hash").limit(labelled).agg(F.max("hash")).first()[0]
    counts: dict[str, list[int]] = {}
    if last is not None:
        seen = rows.where(F.col("hash") <= last).select("page").mapInArrow(counted, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(
            F.sum("n").alias("n")).orderBy(F.desc("n"), "kind", "inside").limit(MOST_KINDS)
        for kind, inside, n in seen.collect():
            counts.setdefault(kind, [0, 0])[not inside] += n
    return {kind: score(kind, *counts.get(kind, (0, 0))) for kind in {*counts, *PRIOR}}


def score(kind: str, inside: int, outside: int) -> float:
    """Log-odds with the stated counts; tags stay below zero."""
    more = PRIOR.get(kind, PLAIN_PRIOR)
    value = max(-MOST, min(MOST, math.log((inside + more[0]) / (outside + more[1]))))
    return min(-LEAST, value) if kind.startswith("<") else value


def best_region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous region of the greatest positive sum; the earliest of equals."""
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best[0]:
            best = (total, start, i + 1)
    return best[1], best[2]


def content(page: str | None, scores: dict[str, float]) -> str:
    """The main text of one page; where class and id leave none, they are not heeded."""
    return _content(page or "", scores, True) or _content(page or "", scores, False)


def _content(page: str, scores: dict[str, float], names: bool) -> str:
    runs = runs_of(page, names)
    marked = any(r.inside for r in runs)
    plain = score("<>", 0, 0)
    values = [0.0 if not r.kept and r.words else scores.get(k, plain) * (r.words or not r.text) for r, k in zip(runs, kinds(runs, marked))]
    start, end = best_region(values)
    # Without a mark, a heading that ends the region heads something left out of it.
    texts = [i for i in range(start, end) if runs[i].kept and runs[i].words]
    while not marked and len({runs[i].block for i in texts}) > 1 and runs[texts[-1]].heading:
        end = texts.pop()
    blocks: dict[int, list[str]] = {}
    for r in runs[start:end]:
        if r.kept and r.text:
            blocks.setdefault(r.block, []).append(r.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(b for b in joined if b)


def extract(pages: DataFrame, scores: dict[str, float] | None = None, html: str = "html") -> DataFrame:
    """The rows with ``text``, the main text, and ``n_chars``, its code points."""
    scores = weights(pages, html) if scores is None else scores
    rest = without(pages, "text", "n_chars", html)
    # Nested, so that no name of the input clashes.
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest.columns]).alias("row") if rest.columns else F.lit(None).cast("int").alias("row"),
                        F.col(f"`{html}`").cast("string").alias("page"))
    kind = dict(held.dtypes)["row"]

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [content(p.as_py(), scores) for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    found = held.mapInArrow(of_batches, f"row {kind}, text string")
    columns = [F.col("row").getField(c).alias(c) for c in rest.columns]
    return found.select(*columns, "text", F.length("text").cast("long").alias("n_chars"))
