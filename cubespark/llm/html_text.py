"""Main text of web pages from the events of the standard library's parser.

The parser streams tags and text. Blocks (what stands between block-level tags or line
breaks) are the lines; each has its characters outside links over its number of tags.
These ratios are smoothed with a Gaussian along the page, and lines above the standard
deviation are content, others not. The region of the text are the articles and mains that are
in no other one, with the headings beside them if they have none of the first rank; without
such elements, or if no content line is in them, the smallest container that holds all content
lines. All blocks of the region are the text, short ones too, save those that the markup itself
names as something else: menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments, and hidden parts. What is no text by its tag, such as ``nav``
or ``form``, is kept all the same if it holds over four fifths of the page's text outside links,
as a form around the page or a tag that nobody closed does. A class or an id names an element
only if it holds at most half of that text; reader comments may hold more, but not all of it.
On a paragraph, heading, list item or cell inside an article a name only weighs: it goes if
its ratio says that it is no content either.

Character references are decoded, white space inside a block is one space, blocks are joined
by one space. Null and empty pages, and pages without text, give the empty text. Pages are
independent: repeated rows give repeated results, an empty table an empty one, and columns
besides id, url and html are not read. Nothing is cut from long pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul br".split()
)
CONTAINER = frozenset("article body div main section table td center fieldset html blockquote".split())
# never part of the text, wherever they stand
DROPPED = frozenset("head script style noscript template select textarea input iframe object svg canvas audio video map datalist math".split())
# no part of the text unless nearly all of it is in there
OTHER = frozenset("nav aside footer form button menu dialog".split())
# names of these inside an article only weigh
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
# an element of these closes an open one of the same group
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOPS = frozenset("ul ol dl table tbody body div article section".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist "
    "reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay footer menu menus nav "
    "navbar navigation newsletter subscribe subscription pagination pager promo promoted promotion related recommended "
    "recommendations share sharing sidebar sidebars social sponsor sponsored sponsors toolbar widget widgets login signup "
    "signin masthead topbar".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())


def _named(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether an element's class or id has a word for something else than text."""
    return any(value and name in ("class", "id") and any(w.lower() in NAMED for w in WORDS.findall(value)) for name, value in attributes)


def _comments(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a class or id names comments, and not something that has them, such as ``with-comments``."""
    tokens = [WORDS.findall(token.lower()) for name, value in attributes if value and name in ("class", "id") for token in value.split()]
    return any(words and words[0] not in ("has", "with", "no") and not COMMENTS.isdisjoint(words) for words in tokens)


def _set_aside(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether an element's other attributes say that it is no text."""
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class Blocks(HTMLParser):
    """Lines of a page: pieces of text, tags, rank of the heading, and the containers around."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, whether it is set aside, whether its name may set it aside
        self.path: tuple[int, ...] = ()  # containers around, innermost last
        self.names: list[str] = []  # tag of each container
        self.aside = self.links = self.articles = 0
        self.marks: tuple[int, ...] = ()  # elements around that their names may set aside
        self.marked = 0
        self.comments: set[int] = set()  # marks of reader comments
        self.others: set[int] = set()  # marks of elements that are no text by their tag
        self.doubtful: set[int] = set()  # marks of names that only weigh
        self.rank = 0  # of the heading around
        self.pieces: list[tuple[list[tuple[str, bool, tuple[int, ...]]], int, int, tuple[int, ...]]] = []
        self.text: list[tuple[str, bool, tuple[int, ...]]] = []  # text, whether in a link, marks
        self.tags = 0

    def line_ends(self) -> None:
        if any(not text.isspace() for text, *_ in self.text):
            self.pieces.append((self.text, self.tags, self.rank, self.path))
            self.tags = 0
        self.text = []

    def lines(self) -> list[tuple[str, int, int, int, tuple[int, ...], bool]]:
        """(text, characters in links, tags, rank of the heading, containers, whether a name weighs on it)
        of each line that is not set aside."""
        plain: dict[int, int] = {}
        total = outside = 0
        for parts, *_ in self.pieces:
            for text, link, marks in parts:
                n = 0 if link else len("".join(text.split()))
                total += n
                outside += n if self.comments.isdisjoint(marks) else 0
                for mark in marks:
                    plain[mark] = plain.get(mark, 0) + n
        aside = {
            mark
            for mark, n in plain.items()
            if mark not in self.doubtful
            and (5 * n <= 4 * total if mark in self.others else 2 * n <= total or outside and mark in self.comments)
        }
        out = []
        before = 0  # tags of what is set aside count for the next line
        for parts, tags, rank, path in self.pieces:
            parts = [part for part in parts if aside.isdisjoint(part[2])]
            text = " ".join("".join(text for text, *_ in parts).split())
            before += tags
            if text:
                doubted = any(not self.doubtful.isdisjoint(part[2]) for part in parts)
                out.append((text, sum(len(text) for text, link, _ in parts if link), before, rank, path, doubted))
                before = 0
        return out

    def handle_starttag(self, tag, attributes) -> None:
        if tag in BLOCK:
            self.line_ends()
            self.close_implied(tag)
        self.tags += 1
        if tag in VOID:
            return
        # a header inside an article is its own heading, outside it is the page's
        inner = bool(attributes) and tag not in ("html", "body")
        aside = tag in DROPPED or (inner and _set_aside(attributes))
        other = tag in OTHER or (tag == "header" and not self.articles)
        named = other or (inner and _named(attributes))
        self.open.append((tag, aside, named))
        self.aside += aside
        if named:
            self.marks += (self.marked,)
            if other:
                self.others.add(self.marked)
            elif _comments(attributes):
                self.comments.add(self.marked)
            elif self.articles and tag in TEXTUAL:
                self.doubtful.add(self.marked)
            self.marked += 1
        if tag in HEADINGS:
            self.rank = int(tag[1])
        self.links += tag == "a"
        self.articles += tag in ("article", "main")
        if tag in CONTAINER:
            self.path += (len(self.names),)
            self.names.append(tag)

    def handle_startendtag(self, tag, attributes) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close_implied(self, tag: str) -> None:
        closed = CLOSES.get(tag, ("p",) if tag != "br" else ())
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in closed:
                self.pop_to(i)
                return
            if name in STOPS or name in DROPPED or name in OTHER:
                return

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK:
            self.line_ends()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.pop_to(i)
                return

    def pop_to(self, i: int) -> None:
        for tag, aside, named in self.open[i:]:
            self.aside -= aside
            if named:
                self.marks = self.marks[:-1]
            if tag in HEADINGS:
                self.rank = 0
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")
            if tag in CONTAINER:
                self.path = self.path[:-1]
        del self.open[i:]

    def handle_data(self, data) -> None:
        if not self.aside:
            self.text.append((data, self.links > 0, self.marks))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights that fall outside the page are left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    centre = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[centre] / np.convolve(np.ones(len(ratios)), kernel)[centre]


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.line_ends()
    lines = page.lines()
    if not lines:
        return ""
    sizes = np.array([len(text) for text, *_ in lines], float)
    plain = np.maximum(sizes - np.array([linked for _, linked, *_ in lines]), 0)
    own = plain / np.maximum(np.array([tags for _, _, tags, *_ in lines]), 1)
    ratios = smoothed(own)
    content = ratios >= ratios.std()
    sure = content & (own >= ratios.std())  # without the neighbours' share
    weights = np.where(content, plain, 0)
    if not weights.sum():
        weights = sizes
    region = _region(page.names, lines, weights, plain)
    return " ".join(line[0] for line, inside, is_sure in zip(lines, region, sure) if inside and (is_sure or not line[-1]))


def _region(names: list[str], lines: list, weights: np.ndarray, plain: np.ndarray) -> list[bool]:
    """Which lines are the text."""
    paths = [path for *_, path, _ in lines]
    # articles and mains in no other one, with any text outside links
    outer = [next((c for c in path if names[c] in ("article", "main")), None) for path in paths]
    chosen = {c for c, n in zip(outer, plain) if c is not None and n > 0}
    inside = [c in chosen for c in outer]
    if weights[inside].sum() > 0:
        if not any(is_in and rank == 1 for is_in, (_, _, _, rank, *_) in zip(inside, lines)):
            around = {path[: path.index(c)] for c, path in zip(outer, paths) if c in chosen}
            inside = [is_in or (rank > 0 and path in around) for is_in, (_, _, _, rank, path, _) in zip(inside, lines)]
        return inside
    content = [path for path, weight in zip(paths, weights) if weight > 0]
    root = [c for c in content[0] if all(c in path for path in content)]
    return [not root or root[-1] in path for path in paths]


def extract(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_column, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            arrays = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_column, "url": url})
