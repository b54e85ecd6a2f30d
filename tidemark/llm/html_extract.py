"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each under its root-to-leaf path of block tags (with their classes, without digits). Per path, text length and
punctuation marks outside links are summed and divided by the number of blocks. Both ratios are smoothed along the path
towards the root, so that a short heading inside a container of long paragraphs gains from it, then fused (length times punctuation times the share of text that isn't link).
Paths whose fused ratio reaches SHARE of the page's mean, weighted by characters, are content: all their blocks stay, short ones too.

Menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are known by tag, role, class or id and never compete.
A class or id alone doesn't remove what holds the page's article, unless it names comments.

Pages are independent rows: no shuffle, and a task holds one Arrow batch. Scanning is linear in a page's length for any input: nothing is
searched for again once it wasn't found. Nulls and odd input: null html gives empty text; page_id and url pass as they are, null and repeated ones
too; unclosed tags, quotes and comments end with the page; a page of menus alone gives empty text; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import exp, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A path is content from this share of the page's mean fused ratio on; paths outside an article or main element count a quarter.
SHARE, OUTSIDE = 0.03, 0.25
#: Ancestors that smooth a path's ratios, each with half the weight of the one before.
LEVELS = 16

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
DROPPED = frozenset("head nav footer aside form dialog menu button select object canvas svg math audio video map template noscript applet".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: What a start tag ends, up to the element that bounds it.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of classes and ids.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer masthead topbar cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar pagination pager widget skip search header".split()
)
WORDS = re.compile(r"[a-z]+").findall
MARKS = re.compile("[.,;:!?…¿¡。，、；：！？।؟،]").findall
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""").findall
NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*").match
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
ALONE = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I).search


class Finder:
    """``str.find`` that remembers what isn't there any more."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()

    def __call__(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.text.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found


def tag_end(find: Finder, at: int) -> int:
    """Where the tag's ``>`` stands, quoted ones apart; -1 if nowhere."""
    while True:
        end = find(">", at)
        if end < 0:
            return -1
        if find.text.find("=", at, end) < 0:
            return end
        quotes = [q for q in (find.text.find('="', at, end), find.text.find("='", at, end)) if q >= 0]
        if not quotes:
            return end
        first = min(quotes) + 1
        close = find(find.text[first], first + 1)
        if close < 0:
            return end
        at = close + 1


class Page:
    """Blocks of one page: ``blocks`` holds [path, text, link characters, region], ``paths`` (parent, name), ``regions`` [always out, holds an article]."""

    def __init__(self, html: str):
        self.blocks, self.paths, self.number = [], [(-1, "")], {}
        self.regions, self.inside = [[False, False]], {0: False}
        self.open, self.names = [("", 0, 0, False)], Counter()  # (tag, path, region, dropped by tag)
        self.pieces, self.links, self.link = [], 0, 0
        self.scan(html)
        self.end_block()

    def text(self, piece: str) -> None:
        if not self.open[-1][3] and piece:
            piece = unescape(piece) if "&" in piece else piece
            self.pieces.append(piece)
            if self.link:
                self.links += len(piece.strip())

    def end_block(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.blocks.append([self.open[-1][1], text, min(self.links, len(text)), self.open[-1][2]])
            self.pieces, self.links = [], 0

    def pop(self, upto: int) -> None:
        while len(self.open) > upto:
            self.names[self.open.pop()[0]] -= 1
        if self.link > len(self.open):
            self.link = 0

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = len(self.open)
        if tag in INLINE:
            return
        self.end_block()
        if tag in CLOSES_P and self.names["p"]:
            self.close("p")
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            for k in range(len(self.open) - 1, max(0, len(self.open) - 64), -1):
                if self.open[k][0] in bounds:
                    break
                if self.open[k][0] in ends:
                    self.pop(k)
                    break
        if tag in VOID:
            return
        _, path, region, out = self.open[-1]
        within, main, kinds, hints = self.inside[path], tag in ("article", "main"), [], set()
        out = out or tag in DROPPED or tag == "header" and not within
        if attributes:
            told = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE(attributes)}
            role, kinds = told.get("role", "").lower(), WORDS(told.get("class", "").lower())
            hints = NOISE.intersection(kinds + WORDS(told.get("id", "").lower()))
            main = main or role == "main"
            out = out or role in ROLES or told.get("aria-hidden") == "true" or bool(HIDDEN(told.get("style", ""))) or bool(ALONE(attributes))
        if within:
            hints -= {"header"}
        if hints and tag not in ("html", "body") and not (main and not hints & COMMENTS):
            self.regions.append([self.regions[region][0] or bool(hints & COMMENTS), self.regions[region][1]])
            self.regions[-1].append(region)
            region = len(self.regions) - 1
        elif (main or tag == "h1") and not out:
            at = region
            while at and not self.regions[at][1]:
                self.regions[at][1] = True
                at = self.regions[at][2]
        key = (path, ".".join([tag, *kinds[:4]]))
        if key not in self.number:
            self.number[key] = len(self.paths)
            self.paths.append(key)
            self.inside[self.number[key]] = within or main
        self.open.append((tag, self.number[key], region, out))
        self.names[tag] += 1

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        if tag in INLINE:
            return
        self.end_block()
        if self.names[tag]:
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self.pop(at)

    def scan(self, html: str) -> None:
        at, size, find = 0, len(html), Finder(html)
        while at < size:
            lt = find("<", at)
            if lt < 0:
                return self.text(html[at:])
            if lt > at:
                self.text(html[at:lt])
            if html.startswith("<!--", lt):
                end = find("-->", lt + 4)
                at = size if end < 0 else end + 3
                continue
            closing = html.startswith("/", lt + 1)
            name = NAME(html, lt + 1 + closing)
            if not name and not html.startswith(("<!", "<?", "</"), lt):
                self.text("<")
                at = lt + 1
                continue
            end = tag_end(find, name.end() if name else lt + 1)
            if end < 0:
                return None
            at = end + 1
            if not name:
                continue
            tag = name[0].lower()
            if closing:
                self.close(tag)
            elif tag in RAW:
                if tag not in INLINE:
                    self.end_block()
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                if not close:
                    return None
                at = close.start()
            else:
                self.start(tag, html[name.end() : end])

    def honoured(self) -> list[bool]:
        """Of each region: is it left out? Regions come after those that they lie in."""
        out = [False]
        for always, holds, within in self.regions[1:]:
            out.append(out[within] or always or not holds)
        return out


def ratios(page: Page) -> tuple[list, list[float]]:
    """Blocks that compete, and the fused ratio of each path."""
    gone = page.honoured()
    blocks = [b for b in page.blocks if not gone[b[3]]]
    size = len(page.paths)
    own, chars = [[0.0, 0.0, 0] for _ in range(size)], [0] * size
    for path, text, links, _ in blocks:
        x = own[path]
        chars[path] += len(text)
        marks = len(MARKS(text))
        x[0] += len(text) - links
        x[1] += marks * (len(text) - links) / len(text)
        x[2] += 1
    whole = [list(x) for x in own]
    for k in range(size - 1, 0, -1):
        up = whole[page.paths[k][0]]
        for i in range(3):
            up[i] += whole[k][i]
    roots = {k for k in range(size) if k == 0 or page.paths[k][1].split(".")[0] in ("html", "body")}
    mains = any(page.inside[b[0]] for b in blocks)
    fused = [0.0] * size
    for k in range(size):
        if not own[k][2]:
            continue
        length, marks, weight, total, at, x = 0.0, 0.0, 1.0, 0.0, k, own[k]
        for _ in range(LEVELS):
            length += weight * log1p(x[0] / x[2])
            marks += weight * log1p(x[1] / x[2])
            total += weight
            weight /= 2
            at = page.paths[at][0]
            if at < 0 or at in roots:
                break
            x = whole[at]
        fused[k] = exp((length + marks) / total) * own[k][0] / chars[k] * (OUTSIDE if mains and not page.inside[k] else 1)
    for (path, *_), (after, *_) in zip(reversed(blocks[:-1]), reversed(blocks[1:]), strict=True):  # a heading goes with what it heads
        parent, name = page.paths[path]
        if name.split(".")[0] in HEADINGS and page.paths[after][0] == parent:
            fused[path] = max(fused[path], fused[after] / 2)
    return blocks, fused


def content(html: str | None, share: float = SHARE) -> tuple[str, int, int]:
    """Text, blocks that stay, blocks of the page."""
    page = Page(html or "")
    blocks, fused = ratios(page)
    chars = sum(len(b[1]) for b in blocks)
    if not chars:
        return "", 0, len(page.blocks)
    least = share * sum(len(b[1]) * fused[b[0]] for b in blocks) / chars
    kept = [b[1] for b in blocks if fused[b[0]] >= least]
    return " ".join(kept), len(kept), len(page.blocks)


def extract(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_kept and n_blocks (blocks of text): a row per row of ``pages``."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [content(x.as_py(), share) for x in b.column(2)]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]
            lengths = pa.array([len(r[0]) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), columns[0], lengths, *columns[1:]], ["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
