"""Main text of web pages by line-block distribution.

A page is read once, in order. Markup is stripped; every block element ends a line, so a line is the text of one
block. Text of scripts, styles, comments in markup, forms and page furniture (navigation, headers, footers, sidebars,
notices, adverts, reader comments, told by element, role or name) is no line. Where a page marks articles, each is a
section and the rest is left out; otherwise the page is one section.

The distribution of a section: a line weighs its characters outside links, and sums of weights slide over WINDOW lines.
A dive is a full window without weight (a run of link lines: a menu without a mark); between dives lie the candidate regions.
On a page that marks no article a region is text if its sums surge to the threshold: SURGE characters, or the highest sum of the
page where that is less, so that a short page keeps its text. In an article every region is text, however short: what follows
a list of links (a note, thanks) belongs to it, and only the dives go. All lines of a region that is text are kept, its heading and single link
lines included.

Defined cases: null html is the empty page, with an empty text; unclosed elements end with what encloses
them; an unclosed quote is a character of its tag; a tag that never ends is dropped with what follows it; pages without a text give an
empty text, never a missing row. White space inside a block, non-breaking spaces and line breaks included, becomes one
space. A header inside an article gives its headings. Null ids stay null. Extra columns are not read; repeated rows are extracted each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SURGE = 80
#: Elements by what they mean for lines of text.
RAW = frozenset("script style noscript template svg math iframe object canvas title textarea select audio video".split())
#: Raw elements that run to the end of the page where their end is missing.
ENDLESS = frozenset("script style title textarea".split())
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored adsbygoogle promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments disqus replies related recommended share sharing social widget login search toolbar pagination pager skip-link skiplink".split())
#: Parts of a name that say nothing beside a part of FURNITURE_NAMES, as in site-header or ad-box-2.
NEUTRAL_NAMES = frozenset("site main page top bottom left right box bar link links list item items block wrap wrapper container inner outer area slot section global primary secondary mobile desktop fixed sticky content posts stories articles form button buttons icons media post reader user respond reply legal".split())
#: Elements that a name makes furniture inside an article.
CONTAINERS = frozenset("div section ul ol dl table details center figure".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out: followed only where they are furniture themselves.
LOOSE = frozenset("p li dt dd td th tr tbody thead tfoot option b i u s em strong a span small sub sup code font mark abbr cite q big tt strike del ins label time".split())

#: A comment, a declaration or a tag; quotes count only behind an equals sign, and no part is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
OPEN_END = re.compile(r"<(?=[a-zA-Z/!?])")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


def named_furniture(value: str) -> bool:
    """Whether a class or id attribute names furniture by one of its whole names."""
    for name in value.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if name.lower() in FURNITURE_NAMES or not FURNITURE_NAMES.isdisjoint(parts) and all(p in FURNITURE_NAMES or p in NEUTRAL_NAMES for p in parts):
            return True
    return False


def is_furniture(name: str, attributes: str, inside: bool = False) -> bool:
    if name in FURNITURE:
        return True
    if not attributes or attributes.isspace():
        return False
    by_name = name not in ("html", "body", "article", "main") and name not in HEADINGS and (not inside or name in CONTAINERS)
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in FURNITURE_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if by_name and key in ("class", "id") and named_furniture(value):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return True
    return False


class _Page:
    """Reads a page into lines: (text, section, characters outside links); section 0 is what no article holds."""

    def __init__(self, page: str) -> None:
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = self.length = 0
        self.stack: list[tuple[str, bool, bool, int]] = []  # name, furniture, header of an article, section
        self.open = Counter()
        self.hidden = self.headers = self.section = self.sections = 0
        self.heading = self.in_link = False
        self.endless: set[str] = set()
        self._read(page)

    def visible(self) -> bool:
        return not self.hidden and (not self.headers or self.heading)

    def add(self, text: str) -> None:
        if text and self.visible():
            self.parts.append(text)
            self.length += len(text)
            self.linked += len(text) * self.in_link

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.lines.append((text, self.section, 0 if 2 * self.linked > self.length else self.length - self.linked))
            self.parts, self.linked, self.length = [], 0, 0

    def pop(self) -> None:
        name, furniture, header, _ = self.stack.pop()
        self.open[name] -= 1
        self.hidden -= furniture
        self.headers -= header
        self.section = self.stack[-1][3] if self.stack else 0

    def skip_raw(self, page: str, name: str, at: int) -> int:
        """Where a raw element that opens before at is over."""
        depth = 1
        if name not in self.endless:
            for m in re.compile(rf"<(/?){name}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
                depth += -1 if m[1] else name not in ENDLESS and not m[0].endswith("/>")
                if not depth:
                    return m.end()
            self.endless.add(name)
        return len(page) if name in ENDLESS else at

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if name == "br":
            self.add(" ")
            return
        block = name in BLOCKS
        if block:
            self.end_line()
            self.in_link = False
        elif name == "a":
            self.in_link = not closing
        if closing:
            if name in HEADINGS:
                self.heading = False
            if self.open[name]:
                while self.stack[-1][0] != name:
                    self.pop()
                self.pop()
            return
        if name in VOID or attributes.endswith("/") and not block:
            return
        while block and self.stack and self.stack[-1][0] == "p":
            self.pop()
        if block:
            self.heading = name in HEADINGS
        header = name == "header" and self.section > 0
        furniture = not header and is_furniture(name, attributes, self.section > 0)
        if furniture or name not in LOOSE:
            if not self.section and not self.hidden and (name in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)):
                self.sections += 1
                self.section = self.sections
            if furniture:
                self.end_line()
            self.hidden += furniture
            self.headers += header
            self.stack.append((name, furniture, header, self.section))
            self.open[name] += 1

    def _read(self, page: str) -> None:
        at, end = 0, page.rfind(">") + 1
        while m := TOKEN.search(page, at, end):
            self.add(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name in RAW:
                if not m[1] and not (m[3].endswith("/") and name not in ENDLESS):
                    at = self.skip_raw(page, name, at)
                end = max(end, at)
                continue
            self.tag(name, bool(m[1]), m[3])
        rest = page[at:]
        cut = OPEN_END.search(rest)
        self.add(rest[: cut.start()] if cut else rest)
        self.end_line()


def regions(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(from, to) of the runs of lines between dives whose window sums surge to the threshold."""
    n, found, begin, empty, most = len(weights), [], 0, 0, 0
    total, held = 0, 0  # sum of the last window lines; of them, lines of this run
    for i in range(n + 1):
        if i < n:
            total += weights[i]
            held += 1
            if held > window:
                total -= weights[i - window]
                held -= 1
            most = max(most, total)
            empty = 0 if weights[i] else empty + 1
        if i == n or empty >= window:  # a dive, or the end
            last = i + 1 - empty if i < n else n
            if most >= max(threshold, 1) and last > begin:
                found.append((begin, last))
            begin, total, held, most = i + 1, 0, 0, 0
    return found


def main_text(page: str | None) -> str:
    read = _Page(page or "")
    kept = []
    for section in range(1 if read.sections else 0, read.sections + 1):
        lines = [x for x in read.lines if x[1] == section]
        weights = [w for _, _, w in lines]
        peak = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
        threshold = 1 if section else min(SURGE, peak)
        kept += [text for a, b in regions(weights, threshold) for text, _, _ in lines[a:b]]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
