"""Main text of HTML pages by the distribution of text over lines."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stream

# Elements that begin a new line; elements whose content is no markup and never text; elements that are not
# shown; elements, roles and name parts of what stands around an article; elements without content.
LINES = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript iframe textarea noembed noframes".split())
UNSEEN = frozenset("template svg object select canvas audio video annotation annotation-xml".split())
AROUND = frozenset("nav aside footer form button menu dialog head label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus reply replies respond notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup login share sharing social related recommended toolbar widget pagination pager".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("article main section div body td table ul ol dl blockquote".split())
# Elements whose start ends an open one of their own kind; any of LINES ends an open paragraph.
AGAIN = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())

#: Lines summed into one window.
WINDOW = 3
#: Empty lines that what is stripped leaves behind: enough for a window's sum to fall to nothing.
GAP = WINDOW
#: A tag by HTML's rules: a quote only counts where a value begins, and > ends the tag everywhere else. No part of it is
#: read twice, so that a tag without an end costs no more than its length.
TAG = re.compile(
    r"<(/?)([A-Za-z][^\t\n\f\r />]*+)"
    r"((?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >\"'][^\t\n\f\r >]*+|(?=>)))?+)*+)>"
)
ATTRIBUTE = re.compile(r"([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >\"'][^\t\n\f\r >]*+|(?=>)))?+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}
COMMENT_END = re.compile("--!?>")
HEADING = re.compile("h[1-6]")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


@dataclass
class Line:
    """A line of the stripped page: its text, the length of the part of it that is link text, and the container it is in."""

    text: list[str] = field(default_factory=list)
    linked: int = 0
    within: int = -1

    def joined(self) -> str:
        return " ".join("".join(self.text).split())


def tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Text, and the tag that follows it: a slash if it closes, its name in lower case, its attributes. A tag, comment or
    raw element that the page's end cuts goes, as in browsers; comments and raw elements' content are no text."""
    at = look = 0
    while (lt := page.find("<", look)) >= 0:
        after = page[lt + 1 : lt + 3]
        if after[:1].isascii() and (after[:1].isalpha() or (after[:1] == "/" and after[1:].isascii() and after[1:].isalpha())):
            m = TAG.match(page, lt)
            tag = m[2].lower() if m else ""
            yield page[at:lt], m[1] if m else "", tag, m[3] if m else ""
            if m is None:
                return
            at = look = m.end()
            if tag in RAW and not m[1]:
                end = RAW_END[tag].search(page, at)
                if end is None:
                    return
                at = look = end.start()
        elif after[:1] in ("!", "?", "/") and after[:1]:
            yield page[at:lt], "", "", ""
            if page.startswith("<!--", lt):
                end = COMMENT_END.search(page, lt + 2)
                at = look = end.end() if end else len(page)
            else:
                at = look = page.find(">", lt) + 1 or len(page)
        else:
            look = lt + 1
    yield page[at:], "", "", ""


def around(tag: str, attributes: str, inside_article: bool) -> str:
    """How an element is known to stand around the article: by tag, role or name, or by id alone; empty if it is not.

    Outside article and main one listed word in a class or id is enough. Inside, a class, or an id, has to be a listed name
    as a whole, and header is none. Headings' ids come from their words and never count; sections' do as whole names.
    """
    if tag in AROUND or tag in UNSEEN or (tag == "header" and not inside_article):
        return "tag"
    if tag in ("body", "html", "article", "main") or not attributes:
        return ""
    found = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value)
        whole = {w.lower() for w in value.split()}
        if name not in ("class", "id", "role"):
            continue
        if name == "role":
            if whole & ROLES:
                return "role"
        elif name == "id" and HEADING.fullmatch(tag):
            continue
        elif inside_article or (name == "id" and tag == "section"):
            if whole & (NAMES - {"header"} if inside_article else NAMES):
                found = found if name == "id" and found else name
        elif {w.lower() for w in WORD.findall(value)} & NAMES:
            return name
    return found


class Containers:
    """The containers of a page by number, in the order they begin: their tags and what they are in."""

    def __init__(self):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.of_article: list[bool] = []

    def add(self, tag: str, parent: int) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.of_article.append(tag in ("article", "main") or (parent >= 0 and self.of_article[parent]))
        return len(self.tags) - 1

    def around(self, number: int) -> Iterator[int]:
        """The container and all that it is in, innermost first."""
        while number >= 0:
            yield number
            number = self.parents[number]

    def inside(self, number: int) -> list[bool]:
        """By container, whether it is in the one of that number."""
        out: list[bool] = []
        for k, parent in enumerate(self.parents):
            out.append(k == number or (parent >= 0 and out[parent]))
        return out

    def totals(self, own: list[int]) -> list[int]:
        """By container, the sum over it and all in it."""
        out = list(own)
        for k in range(len(out) - 1, -1, -1):
            if self.parents[k] >= 0:
                out[self.parents[k]] += out[k]
        return out


@dataclass
class Open:
    """An open element: its tag, its container or -1, whether it is stripped, and whether it is an open link."""

    tag: str
    number: int
    off: bool
    link: bool


def lines_of(page: str) -> tuple[list[Line], Containers]:
    """The page's lines in order, with GAP empty lines for each stripped block, and the containers.
    A section of an article that only its id strips stays if it holds most of the article's text."""
    lines, containers, doubts = scanned(page, frozenset())
    if doubts:
        shown = sum(len(x.joined()) for x in lines if x.within >= 0 and containers.of_article[x.within])
        most = frozenset(n for n, size in doubts.items() if 2 * size > shown + sum(doubts.values()))
        if most:
            lines, containers, _ = scanned(page, most)
    return lines, containers


def scanned(page: str, spared: frozenset[int]) -> tuple[list[Line], Containers, dict[int, int]]:
    """lines_of() without the sections of the numbers given being stripped, and the text that each other section which
    only its id strips inside an article has. A page's length bounds the work, whatever is left open in it."""
    lines, containers = [Line()], Containers()
    stack: list[Open] = []
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    links: list[int] = []  # places of open links
    hidden = articles = 0
    within = -1
    doubts: dict[int, int] = {}
    doubt = -1  # the section that all that is hidden now is in

    def fresh() -> None:
        if lines[-1].text:
            lines.append(Line(within=within))
        else:
            lines[-1].within = within

    def close() -> None:
        nonlocal hidden, articles, within, doubt
        entry = stack.pop()
        places[entry.tag].pop()
        hidden -= entry.off
        if entry.link:
            links.pop()
        articles -= entry.tag in ("article", "main")
        if entry.number >= 0:
            if entry.number == doubt:
                doubt = -1
            within = containers.parents[entry.number]
            fresh()
        if entry.off and not hidden and entry.tag in LINES:
            lines.extend(Line(within=within) for _ in range(GAP + 1))

    def unlink(after: int) -> None:
        """Ends the links that were opened after a place of the stack."""
        while links and links[-1] > after:
            stack[links.pop()].link = False

    def write(text: str) -> None:
        if hidden == 1 and doubt >= 0:
            doubts[doubt] += len(text.strip())
        if text and not hidden and (lines[-1].text or not text.isspace()):
            if not lines[-1].text:
                lines[-1].within = within
            lines[-1].text.append(text)
            if links:
                lines[-1].linked += len(text.strip())

    for text, closes, tag, attributes in tokens(page):
        write(entities.unescape(text))
        if not tag:
            continue
        if closes:
            if places.get(tag):
                for _ in range(len(stack) - places[tag][-1]):
                    close()
        elif tag not in VOID and tag not in RAW and not (tag in ("svg", "math") and attributes.endswith("/")):
            if links:  # one that is not closed ends with its block, or where the next begins
                ends = {tag} & AGAIN | {"p"} if tag in LINES else ()
                unlink(-1 if tag == "a" else max((places[x][-1] for x in ends if places.get(x)), default=len(stack)))
            how = around(tag, attributes, articles > 0)
            unsure = articles > 0 and tag == "section" and how == "id"
            number = len(containers.tags) if tag in PARTS else -1
            off = bool(how) and not (unsure and number in spared)
            if off and not hidden and tag in LINES:
                fresh()
            if number >= 0:
                within = containers.add(tag, within)
                if unsure and off and not hidden:
                    doubt = number
                    doubts[number] = 0
            hidden += off
            link = tag == "a" and any(name.lower() == "href" for name, _ in ATTRIBUTE.findall(attributes))
            if link:
                links.append(len(stack))
            articles += tag in ("article", "main")
            places.setdefault(tag, []).append(len(stack))
            stack.append(Open(tag, number, off, link))
        if tag in LINES and not hidden:
            fresh()
    return lines, containers, doubts


def extracted(page: str) -> str:
    """The main text: blocks in page order, one a line.

    Lines weigh their text outside links. Sums over WINDOW lines surge where the text begins and dive where it ends: at
    the gaps that what stands around leaves, at markup without text, and at runs of links. The heaviest stretch between
    a surge and a dive names the container of the article: the innermost article or main element around it, else the
    innermost container that holds at least half of all weight. All lines in that container belong to it, linked or not;
    without a container, all stretches. Where article and main elements hold nothing but links, these weigh as text.
    Without any weight the text is empty.
    """
    lines, containers = lines_of(page)
    texts = [x.joined() for x in lines]
    weight = np.array([max(0, len(t) - x.linked) for t, x in zip(texts, lines)], np.int64)
    of_article = np.array([x.within >= 0 and containers.of_article[x.within] for x in lines], bool)
    if not weight[of_article].sum():
        weight[of_article] = [len(t) for t, own in zip(texts, of_article) if own]
    if not weight.sum():
        return ""
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW - 1 :]  # the sum from each line on
    on = sums > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    stretches = [(a, min(b + WINDOW - 1, len(lines))) for a, b in zip(edges[::2], edges[1::2])]  # surge, dive
    totals = [int(weight[a:b].sum()) for a, b in stretches]
    a, b = stretches[int(np.argmax(totals))]
    heaviest = list(containers.around(lines[a + int(np.argmax(weight[a:b]))].within))
    inner = next((n for n in heaviest if containers.tags[n] in ("article", "main")), None)
    if inner is None:
        own = [0] * len(containers.tags)
        for x, w in zip(lines, weight.tolist()):
            if x.within >= 0:
                own[x.within] += w
        held = containers.totals(own)
        inner = next((n for n in heaviest if 2 * held[n] >= weight.sum()), None)
    if inner is not None:
        inside = containers.inside(inner)
        return "\n".join(t for t, x in zip(texts, lines) if t and x.within >= 0 and inside[x.within])
    return "\n".join(texts[i] for i in sorted({i for a, b in stretches for i in range(a, b) if texts[i]}))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row; a null or empty page, and one without text outside
    surroundings, or outside links if it has no article, gives an empty text. Repeated rows get a row each, and nothing is shuffled."""
    kind = pages.schema[id_col].dataType.simpleString()

    def step(cols, state):
        texts = [extracted(x or "") for x in cols[2].to_pylist()]
        return [cols[0], cols[1], pa.array(texts, pa.string()), np.array([len(t) for t in texts], np.int64)]

    return stream(pages, step, [F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")], f"page_id {kind}, url string, text string, n_chars long")
