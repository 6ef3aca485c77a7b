"""HTML extraction: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events. A line is the text between two block tags; it carries its region, the
sectioning element it stands in, and the number of tags met since the line before. The logarithms of the ratios of
characters to tags, smoothed by a Gaussian over the lines of a region, fall into two clusters, split where the variance
within them is least. Menus, footers and the like have lines too: they are never content, but show the clusters what
boilerplate looks like on this page. A region is content if lines of the upper cluster hold most of its characters, and
is returned with all its lines, so that short paragraphs and headings stay; lines of an article or main part count as a
little denser, and such a part that holds most of the text is content though it be a list of short lines. What is a menu, header, footer, sidebar, notice, advert, form, script or style by its tag or role is never
content. What is one, or comments, by its class or id only is none either, unless it wraps the page: it holds most of the
text, and with it a main part or first heading, or nearly all of the text. Names that content bears too (WEAK) leave it
to the ratios: such an element of an article is a region of its own.

No page fails a task, however malformed, and time and memory are linear in the page, whatever its depth: a search for an
end that isn't there happens once a page. Marked sections are comments up to the next ">"; a comment without end is its
mark alone, and the text behind it stays. Once a tag with its quoted values reaches the end of the page, quotes no longer
hold a tag together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import slices

SIGMA = 1.0
MARKED = 1.5  # weight of the ratios in an article or main part
MOST, NEARLY_ALL = 0.5, 0.9
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript select textarea option iframe object svg canvas title".split())
HIDDEN = UNSEEN | frozenset("nav header footer aside form button menu dialog".split())
REGIONS = frozenset("article main section div body td blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMED = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|aside|widget\w*|related|cookies?|consent|notice|gdpr|popup|modal|"
    r"newsletter|subscribe|signup|login|social|share|sharing|comments?|disqus|replies|reply|toolbar|pagination|pager|copyright|legal)(?:$|[-_\s])", re.I)  # fmt: skip

HEADS = re.compile(r"header|masthead|nav|menu|banner", re.I)
WEAK = re.compile(r"related|widget|toolbar|copyright|legal", re.I)
SCOPES = REGIONS | {"ul", "ol", "table"}  # a tag in one of these ends none outside it
SOLE = frozenset("p li dt dd option tr td th".split())  # an open one ends where the next begins
OUT = -1  # the region of what is shown but never content

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/=>]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_NUMBER = re.compile(r"&#(?:0{9,}+|(?=[0-9]{9}))[0-9]*+")


def _number(found: re.Match) -> str:
    """A reference whose number is long, without leading zeros, or as one beyond all characters."""
    digits = found[0][2:].lstrip("0")
    return "&#" + (digits if len(digits) < 9 else "99999999") if digits else "&#0"


class _Tolerant(HTMLParser):
    """A parser of whole pages that takes any markup: each construct ends, and no search for an end that isn't there is
    made twice."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.ends: dict[str, int] = {}
        self.quotes = True

    def _find(self, mark: str, at: int) -> int:
        """Where `mark` stands next, or -1."""
        if self.ends.get(mark) != -1 and self.ends.get(mark, -2) < at:
            self.ends[mark] = self.rawdata.find(mark, at)
        return self.ends[mark]

    def _skip(self, i: int) -> int:
        """Behind a construct that ends at the next ">"; without one, where the next begins."""
        end = self._find(">", i)
        if end >= 0:
            return end + 1
        later = self.rawdata.find("<", i + 1)
        return later if later >= 0 else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._skip(i)

    parse_pi = parse_html_declaration

    def parse_comment(self, i: int, report: int = 1) -> int:
        if self.rawdata.startswith(("<!-->", "<!--->"), i):
            return self._skip(i)
        if self.ends.get("--") == -1:
            return i + 4
        end = _COMMENT_END.search(self.rawdata, i + 4)
        if end is None:
            self.ends["--"] = -1
        return end.end() if end else i + 4

    def parse_endtag(self, i: int) -> int:
        end = self._skip(i)
        name = _NAME.match(self.rawdata, i + 2)
        if self.cdata_elem is not None:
            self.handle_endtag(self.cdata_elem)
            self.clear_cdata_mode()
        elif name and self.rawdata[end - 1] == ">":
            self.handle_endtag(name[0].lower())
        return end

    def parse_starttag(self, i: int) -> int:
        raw, attrs = self.rawdata, []
        name = _NAME.match(raw, i + 1)
        if self._find(">", i) < 0:
            return self._skip(i)
        at = name.end()
        while True:
            at = _GAP.match(raw, at).end()
            if at >= len(raw):  # quotes took it to the end: the tag ends at its first ">"
                self.quotes, attrs, at = False, [], self._find(">", i)
            if raw[at] == ">":
                break
            key = _ATTRIBUTE.match(raw, at)
            equals = _EQUALS.match(raw, key.end())
            at, value = (equals or key).end(), None
            if equals:
                quote = raw[at : at + 1]
                end = self._find(quote, at + 1) if self.quotes and quote in ("'", '"') else -1
                if end >= 0:
                    value, at = raw[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(raw, at)
                    value, at = bare[0], bare.end()
            attrs.append((key[0].lower(), unescape(value) if value else value))
        tag = name[0].lower()
        if raw[at - 1] == "/":
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return at + 1


class _Events(_Tolerant):
    """Lines (text, tags before it, region number, or OUT) of what is shown. Elements that a class or id names as no
    content are numbered; of each line `around` has the innermost, of each element `outer` has the next one around
    it, and `wrapping` whether it holds a main part or first heading itself."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.aside: list[str] = []  # what of the line is no content
        self.tags = 0
        self.open: list[tuple[str, bool, bool, int, int, bool]] = []  # tag, not shown, no content, region, named element, in an article
        self.count: dict[str, int] = {}
        self.scopes: list[tuple[str, dict[str, int]]] = [("", {})]  # open tags since the last of SCOPES
        self.regions: list[str] = ["page"]
        self.around: list[int] = []
        self.outer: list[int] = [0]
        self.wrapping: list[bool] = [False]

    @property
    def _now(self) -> tuple[bool, bool, int, int, bool]:
        return self.open[-1][1:] if self.open else (False, False, 0, 0, False)

    def _end_line(self) -> None:
        _, _, region, around, _ = self._now
        for parts, of in ((self.parts, region), (self.aside, OUT)):
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.lines.append((text, self.tags, of))
                self.around.append(around)
                self.tags = 0

    def _push(self, tag: str, *state) -> None:
        self.open.append((tag, *state))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append((tag, {}))
        else:
            self.scopes[-1][1][tag] = self.scopes[-1][1].get(tag, 0) + 1

    def _pop_to(self, tag: str) -> None:
        """Ends open elements up to and with the last `tag`: each element ends once."""
        while True:
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last in SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][1][last] -= 1
            if last == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
            self.aside.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag in SOLE and (self.scopes[-1][0] == tag or self.scopes[-1][1].get(tag)):
            self._pop_to(tag)
        unseen, hidden, region, around, inside = self._now
        if hidden:
            unseen |= tag in UNSEEN
        else:
            a = dict(attrs)
            named = " ".join(filter(None, (a.get("class"), a.get("id"))))
            styled = (a.get("style") or "").replace(" ", "").lower()
            inner_head = tag == "header" and inside
            marks = [m[0] for m in NAMED.finditer(named)]
            if inside or tag == "article":  # an article's own header is content
                marks = [m for m in marks if not HEADS.search(m)]
            unseen = tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in styled
            hidden = unseen or (tag in HIDDEN and not inner_head) or (a.get("role") or "").lower() in ROLES
            weak = inside and bool(marks) and all(WEAK.search(m) for m in marks)
            is_named = tag not in ("html", "body", "main") and bool(marks) and not weak
            if not hidden and (tag in ("h1", "main") or (tag == "article" and not is_named)):
                self.wrapping[around] = True
            if not hidden and is_named:
                self.outer.append(around)
                self.wrapping.append(False)
                around = len(self.outer) - 1
            if not hidden and (weak or (tag in REGIONS and not (region and self.regions[region] in ("article", "main")))):
                self.regions.append("named" if weak else tag)
                region = len(self.regions) - 1
        self._push(tag, unseen, hidden, region, around, inside or tag in ("article", "main"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if self.count.get(tag) if tag in SCOPES else self.scopes[-1][1].get(tag):
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        unseen, hidden, *_ = self._now
        if not unseen:
            (self.aside if hidden else self.parts).append(data)

    def done(self) -> list[tuple[str, int, int]]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(values[i + j - reach], k) for j, k in enumerate(kernel) if 0 <= i + j - reach < len(values)]
        out.append(sum(v * k for v, k in near) / sum(k for _, k in near))
    return out


def threshold(values: list[float]) -> float:
    """The value from which on the upper cluster starts: the split of the sorted values with the least variance
    within both parts; the smallest value where all are equal."""
    v = sorted(values)
    total, best, cut = sum(v), -1.0, v[0]
    below = 0.0
    for i in range(1, len(v)):
        below += v[i - 1]
        gain = below * below / i + (total - below) ** 2 / (len(v) - i)
        if v[i] > v[i - 1] and gain > best:
            best, cut = gain, v[i]
    return cut


def _shown(lines: list[tuple[str, int, int]], events: _Events) -> list[bool]:
    """Which lines may be content: those in no element that is none by its tag or, wrappers of the page aside, by its
    name."""
    outer, wrapping = events.outer, events.wrapping.copy()
    size = [0] * len(outer)
    for (t, _, r), k in zip(lines, events.around, strict=True):
        size[k] += len(t) * (r != OUT)
    for k in range(len(outer) - 1, 0, -1):  # an element comes before those in it
        size[outer[k]] += size[k]
        wrapping[outer[k]] |= wrapping[k]
    shown = [True] * len(outer)
    for k in range(1, len(outer)):
        shown[k] = shown[outer[k]] and size[k] > (MOST if wrapping[k] else NEARLY_ALL) * size[0]
    return [r != OUT and shown[k] for (_, _, r), k in zip(lines, events.around, strict=True)]


def densities(lines: list[tuple[str, int, int]]) -> list[float]:
    """The logarithm of each line's ratio of characters to tags, smoothed over the lines of its region."""
    of: dict[int, list[int]] = {}
    for i, (_, _, r) in enumerate(lines):
        of.setdefault(r, []).append(i)
    out = [0.0] * len(lines)
    for at in of.values():
        for i, v in zip(at, smoothed([math.log1p(len(lines[i][0]) / max(1, lines[i][1])) for i in at]), strict=True):
            out[i] = v
    return out


def content_regions(lines: list[tuple[str, int, int]], shown: list[bool], marked: set[int], whole: set[int]) -> set[int]:
    """The regions most of whose shown characters stand in lines of the upper cluster of all lines' densities, and one of
    `whole` with most of the shown characters; if there is none, that with the most dense ones, then the largest, then the
    first. Lines of `marked` regions count as MARKED times as dense."""
    density = densities(lines)
    cut = threshold(density)
    size: dict[int, int] = {}
    dense: dict[int, int] = {}
    for (t, _, r), v, use in zip(lines, density, shown, strict=True):
        if use:
            size[r] = size.get(r, 0) + len(t)
            dense[r] = dense.get(r, 0) + len(t) * (v + (math.log(MARKED) if r in marked else 0) >= cut)
    total = sum(size.values())
    return {r for r in size if 2 * dense[r] >= size[r] or (r in whole and size[r] > MOST * total)} or {max(size, key=lambda r: (dense[r], size[r], -r))}


def main_text(html: str | None) -> str:
    """The content lines of a page, joined by line feeds; empty for null, empty or boilerplate-only pages."""
    events = _Events()
    events.feed(_NUMBER.sub(_number, html or ""))
    lines = events.done()
    shown = _shown(lines, events)
    if not any(shown):
        return ""
    whole = {i for i, x in enumerate(events.regions) if x in ("article", "main")}
    marked = whole | {i for i, x in enumerate(events.regions) if x == "named"}
    keep = content_regions(lines, shown, marked, whole)
    return "\n".join(t for (t, _, r), use in zip(lines, shown, strict=True) if use and r in keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in slices(batches):
        texts = [main_text(h) for h in x.column("html").to_pylist()]
        yield x.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string()))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of `pages` (page_id, url, html), repeated rows included; text is never
    null, and empty for null, empty and boilerplate-only pages. Pages of any length are read whole. Other columns are
    ignored, also one named text. No rows in, none out."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
