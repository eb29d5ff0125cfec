"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The events of the standard library's streaming parser become *lines*: one per block of text, with the tags met since the
line before.  Navigation, page headers and footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
give no lines (by element, role, or a word of their class or id).  Of what remains:

1. a line's text-to-tag ratio is its number of characters over its number of tags; link text does not count;
2. the ratios are smoothed along the page by a Gaussian (``SIGMA`` lines, ``RADIUS`` to each side);
3. lines above the threshold - one standard deviation of the smoothed ratios, the largest one never exceeds it less -
   form clusters: the seeds of the content;
4. a content region is the element that holds a cluster: the outermost ``article`` (or element marked as the article's
   body), else ``main``, else the deepest element that holds ``SHARE`` of all seed text.  All lines of the regions are
   content, the short ones too; outside of marked regions, lines that are nothing but links are not, unless they are seeds.

So the statistics decide where the content is, and the document's structure how far it goes: a three-word paragraph of
the article stays, a long paragraph beside it goes.

One page is one row of work: pages are never shuffled, and time and memory grow with the page.

Edge cases: a NULL or empty page, or one without text, gives the empty text; unclosed and stray tags, comments and cut
pages are read as far as they go; repeated rows are answered each; a NULL id or url is handed through; an empty table
gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from undertow.llm.common import map_batches, q, texts_of

SIGMA, RADIUS = 1.0, 2
SHARE = 0.8

# Elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video head title select option datalist textarea button".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words of a class or id that mark what is not the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu navbar nav navigation breadcrumb breadcrumbs header footer masthead "
    "sidebar sidebars aside widget widgets notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search "
    "share sharing social comment comments commentlist disqus reply replies respond discussion related recommended pagination pager skip".split()
)
MARKS = frozenset("articlebody article-body entry-content post-content post-body story-body".split())
# An open element that one of these starts ends (optional end tags).
CLOSES = {
    **dict.fromkeys("p div ul ol dl table h1 h2 h3 h4 h5 h6 article section header footer nav aside main form blockquote pre figure hr address fieldset".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "option": frozenset({"option"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "body": frozenset({"head"}),
}
#: Elements that an implied end does not reach beyond.
WALLS = frozenset("html body article section main div ul ol dl table nav aside header footer form blockquote figure fieldset td th".split())


def is_noise(tag: str, attrs: list) -> bool:
    if tag in ASIDE:
        return True
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
            continue
        low = value.lower()
        if name == "role" and low.strip() in ROLES or name == "aria-hidden" and low == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for part in low.split():
                if part in NOISE or not NOISE.isdisjoint(part.replace("_", "-").split("-")):
                    return True
    return False


def is_mark(tag: str, attrs: list) -> int:
    """2 for the article, 1 for the main part, 0 otherwise."""
    if tag == "article":
        return 2
    for name, value in attrs:
        low = (value or "").lower()
        if name == "itemprop" and low == "articlebody" or name in ("class", "id") and not MARKS.isdisjoint(low.split()):
            return 2
        if name == "role" and low == "main":
            return 1
    return int(tag == "main")


class Lines(HTMLParser):
    """Parser events -> lines of text, each with its number of tags and its open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.mark = [-1], [0]  # of each element; element 0 is the page
        self.open = [("", 0, 0)]  # tag, element, whether it shuts off its text
        self.count = Counter()  # of open tags
        self.shut = 0
        self.texts, self.elements, self.tags, self.links = [], [], [], []
        self.buffer, self.met, self.linked, self.anchors = [], 0, 0, 0

    def _end_line(self):
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.texts.append(text)
                self.elements.append(self.open[-1][1])
                self.tags.append(max(1, self.met))
                self.links.append(min(self.linked, len(text)))
                self.met = 0
            self.buffer, self.linked = [], 0

    def _pop(self, at: int):
        for tag, _, shuts in self.open[at:]:
            self.shut -= shuts
            self.anchors -= tag == "a"
            self.count[tag] -= 1
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.met += 1
        if tag not in INLINE:
            self._end_line()
        if tag in VOID:
            return
        ends = CLOSES.get(tag)
        if ends and any(self.count[t] for t in ends):
            for at in range(len(self.open) - 1, 0, -1):
                name = self.open[at][0]
                if name in ends:
                    self._pop(at)
                    break
                if name in WALLS:
                    break
        shuts = int(tag in SILENT or is_noise(tag, attrs))
        self.shut += shuts
        self.anchors += tag == "a"
        element = self.open[-1][1]
        if tag not in INLINE:
            self.parent.append(element)
            self.mark.append(is_mark(tag, attrs))
            element = len(self.parent) - 1
        self.open.append((tag, element, shuts))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path", "g", "use", "circle", "rect", "line"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.met += 1
        if tag not in INLINE:
            self._end_line()
        if tag in VOID or not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                self._pop(at)
                return
            if tag in INLINE and name not in INLINE or name in ("article", "body", "main") and tag not in ("html", "body", "article", "main"):
                return  # a stray end does not shut what holds it

    def handle_data(self, data):
        if not self.shut:
            self.buffer.append(data)
            if self.anchors:
                self.linked += len(data)

    # The page was fed whole, so what is still open at its end reaches to its end (the base class would try again at every character).
    def parse_comment(self, i, report=1):
        return len(self.rawdata) if self.rawdata.find("-->", i + 2) < 0 else super().parse_comment(i, report)

    def parse_starttag(self, i):
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_starttag(i)

    def close(self):
        super().close()
        self._end_line()


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Gaussian average along the page; at its ends over the lines that exist."""
    weight = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    total = np.convolve(ratio, weight)[RADIUS : RADIUS + len(ratio)]
    return total / np.convolve(np.ones(len(ratio)), weight)[RADIUS : RADIUS + len(ratio)]


def content_lines(page: Lines) -> list[bool]:
    """Which lines are content."""
    n = len(page.texts)
    if not n:
        return []
    size, links = np.array([len(t) for t in page.texts]), np.array(page.links)
    score = smoothed((size - links) / np.array(page.tags))
    seed = score >= min(score.std(), score.max())
    weight = np.where(seed, size - links + 1, 0)

    for level in (2, 1):
        region = [-1]  # of each element: the outermost marked one around it; parents come before their children
        for e in range(1, len(page.parent)):
            above = region[page.parent[e]]
            region.append(above if above >= 0 else e if page.mark[e] >= level else -1)
        held = {region[e] for e, w in zip(page.elements, weight.tolist()) if w}
        held.discard(-1)
        if held:
            return [region[e] in held for e in page.elements]
    mass, blocks = [0] * len(page.parent), [0] * len(page.parent)
    for e, w in zip(page.elements, weight.tolist()):
        mass[e] += w
        blocks[e] = 1
    for e in range(len(mass) - 1, 0, -1):
        mass[page.parent[e]] += mass[e]
        blocks[page.parent[e]] += blocks[e]
    best = max(e for e in range(len(mass)) if not e or mass[e] >= SHARE * mass[0] and blocks[e] > 1)  # no single paragraph
    inside = [best == 0]
    for e in range(1, len(mass)):
        inside.append(e == best or inside[page.parent[e]])
    return [inside[e] and bool(s or l < t) for e, s, l, t in zip(page.elements, seed, links.tolist(), size.tolist())]


def main_text(html: str) -> str:
    """The article of a page, blocks joined by one space."""
    page = Lines()
    page.feed(html)
    page.close()
    return " ".join(t for t, keep in zip(page.texts, content_lines(page)) if keep)


def text_batches(batches, *, extra: int):
    for batch in batches:
        made = [main_text(b.decode("utf-8", "replace")) for b in texts_of(batch, batch.num_columns - 1)]
        kept = [batch.column(k) for k in range(extra)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=[*[f"k{k}" for k in range(extra)], "text", "n_chars"]
        )


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), *, out: str = "text", size: str = "n_chars") -> DataFrame:
    """The columns ``keep`` of every row, its main text and the number of its code points."""
    narrow = pages.select(*[q(c).alias(f"k{i}") for i, c in enumerate(keep)], q(html).alias("html"))
    kinds = dict(narrow.dtypes)
    schema = ", ".join([*[f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))], "text string", "n_chars long"])
    return map_batches(narrow, partial(text_batches, extra=len(keep)), schema).toDF(*keep, out, size)


def html_query(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
