"""Main text of raw web pages.

The standard library's parser streams tag and text events. They become lines, one per
block of the page, each with its text, its number of tags and its share of link text. The
text-to-tag ratio of the lines is smoothed with a Gaussian and clustered in two around a
threshold: the heavy cluster is the content, and what it does not reach is left out.

Around the heavy lines the content regions are completed with light ones, such as headings
and short paragraphs: in an ``article`` that has a heavy line all of its lines, elsewhere
those that stand beside heavy lines in the same container, or between them in parts of it,
if they are not mostly links.

Parts that the page declares to be something else by element or role (menus, headers,
footers, asides, scripts, controls) never become lines; in the header of an article only
headings do. Names of classes and ids are a weak feature: lines of a container named like
an advert or a comment section are weighed down before the clustering and do not complete a
region, and only if some line outside such containers is heavy by its own ratio or stands in
an ``article`` or ``main``.

White space inside a line becomes one space, lines are joined by one newline. Null,
empty and mark-up-only pages give an empty text; repeated rows are done each for itself;
other columns are not read. Time and memory grow with the page, however deeply it nests.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.batches import bounded

FEED = 1 << 16
#: Pieces of mark-up without an end that are read as text at the end of a page.
UNFINISHED = 8
SIGMA = 1.5

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold other blocks.
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 hr li dt dd pre caption figcaption legend summary address".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
OUTSIDE = frozenset(
    "head title script style noscript template svg math canvas iframe object audio video map nav aside footer button select"
    " option datalist textarea input label menu dialog search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first closes open elements of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status note".split())
#: Words that, first or last in the name of a class or id, mark what is not the article.
NAMES = (
    r"ads?|ad(?:s?box|block|slot|unit|container|wrap(?:per)?|sense)|advert\w*|banners?|sponsor(?:s|ed)?|promo(?:s|tion|tions)?|side(?:bar|nav|menu|column)s?|menus?"
    r"|nav(?:bar|igation|menu|links)?|breadcrumbs?|footer|masthead|topbar|cookies?|cookie(?:bar|banner|notice|consent)|consent|gdpr|notices?|notifications?|popups?|modal"
    r"|overlay|comments?|comment(?:list|area|section|form|box|thread)|replies|disqus|discussion|respond|share|sharing|social|related|recommended|recommendations"
    r"|newsletter|subscribe|subscription|signup|login|search(?:box|form|bar)|widgets?|toolbar|pagination|pager|skiplinks?|outbrain|taboola"
)
MARKED = re.compile(rf"(?:^|\s)(?!(?:has|with|no)[-_])(?:(?:{NAMES})(?:[-_][\w-]*)?|[\w-]*[-_](?:{NAMES}))(?=\s|$)", re.I)
HEADER = re.compile(r"(?:^|\s)(?:[\w-]+[-_])?header(?=\s|$)", re.I)
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


#: Names of blocks that hold no other blocks: only these words, by themselves.
LEAF = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsored|cookie[-_](?:notice|banner)|newsletter)(?=\s|$)", re.I)
#: What the ratio of a line in a marked container counts.
WEIGHT = 1 / 50


class PageLines(HTMLParser):
    """Collects the lines of a page from its events: parallel lists of text, tags (its own
    included), characters in links and the container. Containers are numbered in the order of
    their start tags, so the ones within a container follow it up to its ``last``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.tags: list[int] = []
        self.link: list[int] = []
        self.within: list[int] = []
        self.marked: list[bool] = []
        # containers; 0 is the page
        self.parent, self.last, self.article, self.core, self.dull = [-1], [0], [0], [False], [False]
        self._stack: list[tuple[str, bool, int, bool]] = []  # element, starts an outside part, container, is a marked leaf
        self._open: Counter[str] = Counter()
        self._at = 0
        self._outside = self._headers = self._headings = self._links = self._leaves = 0
        self._ending, self._unfinished = False, 0
        self._parts: list[str] = []
        self._link_chars = 0
        self._tags = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def check_for_whole_start_tag(self, i: int) -> int:
        return super().check_for_whole_start_tag(i) if self.rawdata.find(">", i) >= 0 else -1

    def _ended(self, end: int) -> int:
        """The end of mark-up, or that of the page after too many pieces of mark-up without one: as
        in a browser, an unfinished tag then takes the rest. Each costs a look at all that follows."""
        if end < 0 and self._ending:
            self._unfinished += 1
            if self._unfinished > UNFINISHED:
                return len(self.rawdata)
        return end

    def parse_starttag(self, i: int) -> int:
        return self._ended(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._ended(super().parse_endtag(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._ended(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._ended(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        return self._ended(super().parse_html_declaration(i))

    def _flush(self) -> None:
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            self.text.append(text)
            self.tags.append(max(1, self._tags))
            self.link.append(min(self._link_chars, len(text)))
            self.within.append(self._at)
            self.marked.append(self.dull[self._at] or self._leaves > 0)
        self._parts, self._link_chars, self._tags = [], 0, 0

    def _pop(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag, outside, container, leaf = self._stack.pop()
            self._open[tag] -= 1
            self._outside -= outside
            self._leaves -= leaf
            self._links -= tag == "a"
            self._headings -= tag in HEADINGS
            self._headers -= tag == "header" and not outside
            if container:
                self.last[container] = len(self.parent) - 1
                self._at = self.parent[container]

    def _names(self, attrs: dict[str, str | None]) -> str:
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        return f"{names} {HUMP.sub('-', names)}"

    def _is_outside(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag in OUTSIDE or (tag == "header" and not self.article[self._at]):
            return True
        if not attrs or tag in ("html", "body"):
            return False
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or ""):
            return True
        return tag != "main" and (attrs.get("role") or "").lower() in ROLES

    def _is_marked(self, tag: str, attrs: dict[str, str | None]) -> bool:
        if tag == "form":
            return True
        if not attrs or tag in ("html", "body", "main"):
            return False
        names = self._names(attrs)
        return bool(MARKED.search(names)) or (not self.article[self._at] and tag != "article" and bool(HEADER.search(names)))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in IMPLIED:
                closes, within = IMPLIED[tag]
                if any(self._open[x] for x in closes):
                    for k in range(len(self._stack) - 1, -1, -1):
                        if self._stack[k][0] in within:
                            break
                        if self._stack[k][0] in closes:
                            self._pop(k)
            elif tag == "body" and self._open["head"]:
                self._pop(next((k for k, x in enumerate(self._stack) if x[0] == "head"), len(self._stack)))
            for k in range(len(self._stack) - 1, -1, -1) if self._open["p"] else ():  # an open paragraph ends where a block begins
                if self._stack[k][0] == "p":
                    self._pop(k)
                    break
                if self._stack[k][0] in BLOCKS:
                    break
        elif tag in ("br", "img"):
            self._parts.append(" ")
        self._tags += not self._outside
        if tag in VOID:
            return
        a = dict(attrs)
        outside = self._is_outside(tag, a)
        container, leaf = 0, False
        if tag in CONTAINERS and not outside and not self._outside:
            container = len(self.parent)
            self.parent.append(self._at)
            self.last.append(container)
            self.article.append(container if tag == "article" else self.article[self._at])
            self.core.append(self.core[self._at] or tag in ("article", "main"))
            self.dull.append(self.dull[self._at] or self._is_marked(tag, a))
            self._at = container
        elif tag in BLOCKS and a:
            leaf = bool(LEAF.search(self._names(a)))
        self._stack.append((tag, outside, container, leaf))
        self._open[tag] += 1
        self._outside += outside
        self._leaves += leaf
        self._links += tag == "a"
        self._headings += tag in HEADINGS
        self._headers += tag == "header" and not outside

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self._tags += not self._outside
        for k in range(len(self._stack) - 1, -1, -1) if self._open[tag] else ():
            if self._stack[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data: str) -> None:
        if not self._outside and (not self._headers or self._headings):
            self._parts.append(data)
            if self._links:
                self._link_chars += len(data)

    def take(self, html: str) -> None:
        """The whole page, in pieces that at least double what is still unread."""
        at = 0
        while at < len(html):
            size = max(FEED, len(self.rawdata))
            self.feed(html[at : at + size])
            at += size
        self.close()

    def close(self) -> None:
        self._ending = True
        super().close()
        self._flush()
        self._pop(0)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the borders, of the lines there are."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def heavy(ratios: np.ndarray) -> np.ndarray:
    """The lines of the cluster with high ratios. The threshold starts at the mean and
    moves to the midpoint of the two clusters' means until it rests."""
    if not len(ratios):
        return np.zeros(0, bool)
    threshold = ratios.mean()
    for _ in range(50):
        high = ratios >= threshold
        if high.all() or not high.any():
            return np.ones(len(ratios), bool)
        middle = (ratios[high].mean() + ratios[~high].mean()) / 2
        if abs(middle - threshold) < 1e-9:
            break
        threshold = middle
    return ratios >= threshold


def content(page: PageLines) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are heavy, and which are in marked containers, if that counts. Heavy are lines by their smoothed ratio, and in an ``article`` or ``main`` also by
    their own, as smoothing weighs down the ends of short pages."""
    sizes, link, tags = (np.array(x, dtype=float) for x in ([len(t) for t in page.text], page.link, page.tags))
    marked = np.array(page.marked)
    ratios = (sizes - link) / tags
    value = np.log1p(smooth(ratios))
    core, alone = np.array(page.core)[page.within], heavy(np.log1p(ratios))
    marked &= ((alone | core) & ~marked).any()
    value = np.where(marked, value + np.log(WEIGHT), value)
    return heavy(value) | (alone & core & ~marked), marked


def completed(page: PageLines, on: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """The heavy lines ``on`` and the light ones that complete their regions."""
    n = len(page.parent)
    within, article = np.array(page.within), np.array(page.article)
    home = article[within]
    chosen = on | (home > 0) & np.isin(home, home[on]) & ~marked
    direct = np.zeros(n, bool)
    direct[within[on]] = True
    # the nearest container around each one that holds heavy lines itself, outside of articles
    near, first, last = np.full(n, -1), np.full(n, len(on)), np.full(n, -1)
    for c in range(n):
        near[c] = c if direct[c] and not article[c] else near[page.parent[c]] if c else -1
    places = np.flatnonzero(on)
    np.minimum.at(first, within[places], places)
    np.maximum.at(last, within[places], places)
    for c in range(n - 1, 0, -1):
        p = page.parent[c]
        first[p], last[p] = min(first[p], first[c]), max(last[p], last[c])
    links = 2 * np.array(page.link) > np.array([len(t) for t in page.text])
    for i in np.flatnonzero(~chosen & ~marked & ~links & (home == 0)):
        c = near[within[i]]
        chosen[i] = c >= 0 and (within[i] == c or first[c] < i < last[c])
    return chosen


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = PageLines()
    page.take(html)
    if not page.text:
        return ""
    return "\n".join(page.text[i] for i in np.flatnonzero(completed(page, *content(page))))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Per page: ``page_id``, ``url``, ``text``, ``n_chars``. One narrow pass."""
    base = pages.select("page_id", "url", F.col(f"`{html}`").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "html"):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return base.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
