"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser gives events; each block of a page becomes a line with its text, the text of its links and its number of tags. The ratios of unlinked text to tags are smoothed by a Gaussian, and lines at or above the spread of the smoothed ratios form the content clusters. Clusters choose the regions: the articles that hold them, or else the containers that do. All lines of a chosen region are the article, short ones too; parts of it that no cluster reaches and that lie before the first or behind the last one, as reader comments do, are not.

Fixed are only the elements that are by their names what an article is without (menus, headers, footers, sidebars, forms, scripts, styles), the roles that say the same, and class names that name a menu, header, footer, sidebar, notice, advert or comments.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SIGMA = 1.0  # of the Gaussian, in lines
DENSE = 0.5  # of the densest container's ratio of text to tags that another one needs

# Elements by what they do to the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template svg iframe object canvas audio video nav menu footer aside form button select textarea dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main section div body html".split())
LISTED = {t: frozenset("ul ol dl table menu select".split()) for t in ("li", "dt", "dd", "tr", "td", "th", "option")}  # what an open one of the same kind is closed within
BARRIERS = frozenset("article main body nav footer aside".split())  # which the end of an inline element does not reach over
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset("menu menus sidebar sidebars notice notices ad ads advert adverts advertisement advertisements comment comments".split())
EDGES = frozenset("header footer".split())  # names that count outside an article or main only
_PARTS = re.compile(r"[-_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKUP = re.compile(r"<[a-zA-Z/!?]")


def named(value: str, inside: bool) -> bool:
    """Whether a class or id is one of NAMES, or a compound of which the last part is ("cookie-notice", not "notice-of-meeting")."""
    last = {_PARTS.split(name)[-1].lower() for name in value.split()}
    return bool(last & NAMES) or not inside and bool(last & EDGES)


class Line:
    __slots__ = ("text", "tags", "linked", "region", "heading")

    def __init__(self, text: str, tags: int, linked: int, region: int, heading: bool):
        self.text, self.tags, self.linked, self.region, self.heading = text, tags, linked, region, heading


class Lines(HTMLParser):
    """Events to lines. Regions are numbered as they open, so each comes after the one it lies in (parents); text inside what is dropped is not taken up. Every event is handled in constant time on average, however deep or broken the markup is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # element, region, dropped, inside an article or main
        self.at: dict[str, list[int]] = {}  # places in open of each element
        self.blocks: list[int] = []
        self.kinds, self.parents = ["html"], [-1]
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.heading = False

    def top(self) -> tuple[str, int, bool, bool]:
        return self.open[-1] if self.open else ("", 0, False, False)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, min(self.linked, len(text)), self.top()[1], self.heading))
            self.tags = 0
        self.text, self.linked, self.heading = [], 0, False

    def last(self, *tags: str) -> int:
        """The place in open of the innermost of these elements, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def pop_to(self, place: int) -> None:
        while len(self.open) > place:
            tag = self.open.pop()[0]
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            # a block ends an open paragraph
            if self.blocks and self.blocks[-1] == self.last("p") and tag not in ("html", "body"):
                self.pop_to(self.blocks[-1])
        if tag in LISTED and self.last(tag) > self.last(*LISTED[tag]):
            self.pop_to(self.last(tag))
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, region, gone, inside = self.top()
        gone = gone or tag in DROPPED or tag == "header" and not inside or tag not in ("html", "body", "article", "main") and self.marked(attrs, inside)
        if tag in REGIONS:
            self.kinds.append(tag)
            self.parents.append(region)
            region = len(self.kinds) - 1
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
            self.heading = tag in HEADINGS
        self.open.append((tag, region, gone, inside or tag in ("article", "main")))

    @staticmethod
    def marked(attrs, inside: bool) -> bool:
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id") and named(value, inside) or name == "role" and value.strip().lower() in ROLES:
                return True
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        place = self.last(tag)
        if place >= 0 and (tag in BLOCKS or place > self.last(*BARRIERS)):
            self.pop_to(place)

    def handle_data(self, data):
        if not self.top()[2]:
            self.text.append(data)
            if self.at.get("a"):
                self.linked += len(data)

    # what is not closed goes to the end of the page; a section for another language is a comment
    def parse_comment(self, i, report=1):
        end = self.rawdata.find("-->", i + 2)
        return end + 3 if end >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    parse_bogus_comment = parse_pi = parse_html_declaration

    def read(self, html: str) -> None:
        """All of a page. Behind the last '>' there is no whole tag, so an open one there ends it; the parser would try each of them to the end."""
        end = html.rfind(">") + 1
        begun = _MARKUP.search(html, end)
        self.feed(html[: begun.start()] if begun else html)
        self.close()
        self.end_line()


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach:-reach]


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines make up the content clusters: smoothed ratio at or above the standard deviation of the smoothed ratios (the largest one if none is), and dense by themselves, not only by their neighbours."""
    own = np.array([(len(x.text) - x.linked) / max(1, x.tags) for x in lines], float)
    smoothed = smooth(own)
    chosen = smoothed >= smoothed.std()
    if not chosen.any():
        chosen = smoothed == smoothed.max()
    strong = chosen & (own >= smoothed.std())
    return strong if strong.any() else chosen


class Regions:
    """Sums over the lines of each region with all inside it."""

    def __init__(self, parser: Lines, chosen: np.ndarray):
        lines, self.kinds, self.parents = parser.lines, parser.kinds, parser.parents
        n = len(self.kinds)
        self.first, self.last = [len(lines)] * n, [-1] * n
        self.count, self.text, self.linked, self.content = [0] * n, [0] * n, [0] * n, [0] * n
        for i, (x, use) in enumerate(zip(lines, chosen)):
            r = x.region
            self.first[r], self.last[r] = min(self.first[r], i), i
            self.count[r] += 1
            self.text[r] += len(x.text)
            self.linked[r] += x.linked
            self.content[r] += len(x.text) if use else 0
        for r in range(n - 1, 0, -1):
            p = self.parents[r]
            self.first[p], self.last[p] = min(self.first[p], self.first[r]), max(self.last[p], self.last[r])
            for sums in (self.count, self.text, self.linked, self.content):
                sums[p] += sums[r]

    def nearest(self, wanted) -> list[int]:
        """For each region the innermost one around it, itself included, that is wanted, or -1."""
        out: list[int] = []
        for r, p in enumerate(self.parents):
            out.append(r if wanted(r) else out[p] if p >= 0 else -1)
        return out


def in_articles(lines: list[Line], regions: Regions, chosen: np.ndarray, kind: str) -> np.ndarray | None:
    """Lines of the elements of this kind (article or main) that hold clusters, if these hold half of the clusters' text. An article within an article that has clusters of its own is a comment. A container that no cluster reaches goes if it is mostly links, or has several lines and lies before the article's first or behind its last cluster."""
    own = regions.nearest(lambda r: regions.kinds[r] == kind)
    content = [0] * len(regions.kinds)
    spans: dict[int, tuple[int, int]] = {}
    for i, (x, use) in enumerate(zip(lines, chosen)):
        a = own[x.region]
        if use and a >= 0:
            content[a] += len(x.text)
            spans[a] = (spans[a][0] if a in spans else i, i)
    if not spans or 2 * sum(content) < sum(len(x.text) for x, use in zip(lines, chosen) if use):
        return None
    used, apart = [False] * len(own), [False] * len(own)
    under = [False] * len(own)  # inside an article that has clusters of its own
    for r, p in enumerate(regions.parents):
        if p < 0:
            continue
        under[r] = under[p] or content[own[p]] > 0 if own[p] >= 0 else False
        a = own[r]
        used[r] = a >= 0 and content[a] > 0 and not (under[a] if r != a else under[r])
        if r != a and used[r] and regions.kinds[r] == "div" and not regions.content[r] and regions.count[r]:
            outside = regions.count[r] > 1 and (regions.first[r] > spans[a][1] or regions.last[r] < spans[a][0])
            apart[r] = outside or 2 * regions.linked[r] >= regions.text[r]
        apart[r] = apart[r] or r != a and apart[p]
    return np.array([used[x.region] and not apart[x.region] for x in lines])


def in_containers(lines: list[Line], regions: Regions, chosen: np.ndarray) -> np.ndarray:
    """Lines of the containers that hold dense lines, but for those with less than DENSE of the ratio of the one that holds most text. A container of one line counts as a line of the one around it. A heading right before a chosen line is chosen."""
    own = regions.nearest(lambda r: regions.count[r] != 1)
    homes = [own[x.region] for x in lines]
    text, tags, has = {}, {}, {}
    for x, home, use in zip(lines, homes, chosen):
        text[home] = text.get(home, 0) + len(x.text) - x.linked
        tags[home] = tags.get(home, 0) + max(1, x.tags)
        has[home] = has.get(home, 0) + (len(x.text) if use else 0)
    most = max(has, key=lambda r: (has[r], -r))
    least = DENSE * text[most] / tags[most]
    kept = np.array([has[h] > 0 and text[h] / tags[h] >= least for h in homes])
    for i in range(len(lines) - 2, -1, -1):
        kept[i] |= lines[i].heading and kept[i + 1]
    return kept


def extract(html: str | None) -> str:
    """The main text of one page; empty if there is none."""
    parser = Lines()
    parser.read(html or "")
    if not parser.lines:
        return ""
    strong = clusters(parser.lines)
    regions = Regions(parser, strong)
    kept = in_articles(parser.lines, regions, strong, "article")
    if kept is None:
        kept = in_articles(parser.lines, regions, strong, "main")
    if kept is None:
        kept = in_containers(parser.lines, regions, strong)
    return "\n\n".join(x.text for x, use in zip(parser.lines, kept) if use)


def _batches(batches):
    for batch in slices(batches):
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages.

    A null or empty html, or one without content, gives an empty text of 0 characters; page_id and url may be null. Pages of any length are parsed whole, each by itself, so repeated rows give the same text; broken, unclosed or deep markup takes time in proportion to its length. Columns other than page_id, url and html are ignored. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_batches, "page_id long, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_extract": op5}
ORACLES: dict[str, str] = {}
