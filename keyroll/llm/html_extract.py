"""Main text of web pages: the maximum-scoring run of a page's tokens.

A page is a sequence of words (positive scores) and tags (negative scores). One
linear scan finds the run with the greatest sum, the content region. The scores
are learned from labelled pages, those that mark their main text themselves (an
``article`` or ``main`` element): the log-odds of a kind of token inside and
outside the marked text. A word's kind is the block it stands in, the block
around that, and whether it is a link; a tag's is its name; blocks go with their
class or id. The mark itself is no part of a kind, so what is learned holds for
pages without one.

Kinds are hashed to ``KINDS`` numbers: any class name has its score, and the table
has a fixed size.

Inside the region the parts that are not main text (menus, headers and footers,
sidebars, notices, adverts, forms, scripts, styles, reader comments) are left out;
where a page names them, their words earn nothing in the search either.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and class words of HTML pages.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
NEVER = frozenset(
    "head nav footer aside form button select option datalist fieldset menu menuitem dialog svg math canvas object "
    "audio video map".split()) | RAW
MARKS = frozenset(("article", "main"))
MARKED = re.compile(r"<(?:article|main)[\s>]", re.I)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
# A class or id names such a part if it is one of these words, or starts or
# ends with one next to a hyphen or underscore.
PARTS = (
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar side-bar "
    "menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "more-stories comment comments commentlist discussion disqus replies respond footer foot header masthead topbar "
    "toolbar pagination pager search widget widgets skip-link copyright toc"
).split()
PART = re.compile(r"(?:^|[-_])(?:%s)(?:[-_]\w+)*$|^(?:%s)[-_]" % (("|".join(PARTS),) * 2))
WRAPPER = re.compile(r"(?:^|[-_])(?:has|with|no|without|hide|show)[-_]")

# No part of it looks further than the next tag or its own closing mark, so a page is read once.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
NAMED = re.compile(r"\b(?:class|id)\s*=\s*[\"']?\s*([^\s\"'>]+)", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w=-])(hidden)(?![\w=-])")

# Scores of kinds that no labelled page has: words and tags.
WORD_DEFAULT, TAG_DEFAULT, INLINE_DEFAULT = 1.0, -2.0, -0.1
LEAST, MOST_WORD, MOST_TAG = 0.05, 2.0, 4.0
KINDS = 1 << 17


def _left_out(name: str, attributes: str, inside: bool) -> bool:
    """The element is a part that is never main text."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if not attributes or name in MARKS or name in ("html", "body"):
        return False
    for key, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if hidden or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and value in ROLES:
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and any(PART.search(w) and not WRAPPER.search(w) for w in value.split()):
            return True
    return False


class Token(NamedTuple):
    """A tag, or the text between two; ``kind`` is its number. ``marked``: in an article
    or main element. ``dropped``: in a part that is never main text."""

    kind: int
    name: str
    text: str
    words: int
    marked: bool
    dropped: bool


def _number(kind: str) -> int:
    return zlib.crc32(kind.encode(errors="replace")) % KINDS


def tokens(page: str) -> Iterator[Token]:
    """The tokens of a page in order; raw elements (scripts, styles, titles) give none."""
    stack: list[tuple[str, str, bool]] = []  # open elements: name, name with class, left out
    blocks: list[str] = []                   # of these the blocks, without marks and the page's own
    opened: Counter[str] = Counter()
    out = marks = links = 0
    at, end = 0, len(page)

    def close() -> str:
        nonlocal out, marks, links
        name, sign, dropped = stack.pop()
        opened[name] -= 1
        out -= dropped
        marks -= name in MARKS
        links -= name == "a"
        if _is_block(name):
            blocks.pop()
        return sign

    def words(text: str) -> Token:
        near = f"{blocks[-1] if blocks else ''}@{blocks[-2] if len(blocks) > 1 else ''}"
        return Token(_number(f"word {near}{'+a' if links else ''}"), "", text, len(text.split()), marks > 0, out > 0)

    while at < end:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else end]
        if text:
            yield words(html.unescape(text))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                yield words(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            sign = name
            if opened[name]:
                while stack[-1][0] != name:
                    close()
                sign = close()
            yield Token(_number(f"/{sign}"), name, "", 0, marks > 0, out > 0)
            continue
        if name in RAW and not m[0].endswith("/>"):
            found = RAW_END[name].search(page, at)
            at = found.end() if found else end
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1][0] == name:
            close()  # these elements end where the next of them starts
        attributes = m[3] or ""
        named = NAMED.search(attributes) if attributes else None
        sign = f"{name}.{named[1].lower()}" if named else name
        dropped = not out and _left_out(name, attributes, marks > 0)
        yield Token(_number(sign), name, "", 0, marks > 0, out > 0 or dropped)
        if name not in VOID and not m[0].endswith("/>"):
            stack.append((name, sign, dropped))
            opened[name] += 1
            out += dropped
            marks += name in MARKS
            links += name == "a"
            if _is_block(name):
                blocks.append(sign)


def _is_block(name: str) -> bool:
    return name not in INLINE and name not in MARKS and name not in ("html", "body")


def learn(pages: DataFrame, column: str = "html") -> dict[int, float]:
    """Score per number of a kind, from all pages that mark a main text: log-odds of
    being inside, words kept positive and tags negative. Counting needs at most one
    row per number and task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, outer, tags = Counter(), Counter(), set()
        for batch in batches:
            for page in batch.column(0):
                page = page.as_py() or ""
                if not MARKED.search(page):
                    continue
                for t in tokens(page):
                    if t.name:
                        tags.add(t.kind)
                    (inner if t.marked else outer)[t.kind] += 1 if t.name else t.words
        kinds = sorted({*inner, *outer})
        if kinds:
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(kinds, pa.int64()), "tag": [k in tags for k in kinds],
                "inside": pa.array([inner[k] for k in kinds], pa.int64()),
                "outside": pa.array([outer[k] for k in kinds], pa.int64())})

    sums = (pages.select(column).mapInArrow(count, "kind long, tag boolean, inside long, outside long").groupBy("kind")
            .agg(F.max("tag").alias("tag"), F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
            .filter("inside + outside > 0").collect())  # KINDS rows at most
    scores = {}
    for r in sums:
        odds = math.log((r["inside"] + 0.5) / (r["outside"] + 0.5))
        scores[r["kind"]] = min(-LEAST, max(-MOST_TAG, odds)) if r["tag"] else max(LEAST, min(MOST_WORD, odds))
    return scores


def best_run(values: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the run with the greatest sum, the first and
    then the longest of equals; (0, 0) if no run is positive."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, start = 0.0, i
        total += v
        if total > best:
            best, where = total, (start, i + 1)
    return where


def _score(t: Token, scores: dict[int, float]) -> float:
    if not t.name:
        return 0.0 if t.dropped else scores.get(t.kind, WORD_DEFAULT) * t.words
    return scores.get(t.kind, INLINE_DEFAULT if t.name in INLINE and t.name != "a" else TAG_DEFAULT)


def region(found: list[Token], scores: dict[int, float]) -> list[Token]:
    """The tokens of the best run."""
    start, end = best_run([_score(t, scores) for t in found])
    return found[start:end]


def text_of(found: list[Token]) -> str:
    """The text of tokens without the parts that are left out, blocks joined by a space."""
    parts = [t.text if not t.name else " " for t in found if not t.dropped and t.name not in INLINE]
    return " ".join("".join(parts).split())


def extract(page: str | None, scores: dict[int, float]) -> str:
    """Main text of one page; empty if it has no positive run."""
    return text_of(region(list(tokens(page or "")), scores))


def main_text(pages: DataFrame, scores: dict[int, float], column: str = "html") -> DataFrame:
    """``row`` (a struct of the other columns) and ``text`` per page. A null page
    is empty and has the text ''; equal rows give equal rows; an empty table
    gives none. Scores are a bounded table of kinds."""
    shared = pages.sparkSession.sparkContext.broadcast(scores)
    rest = [c for c in pages.columns if c != column]
    rows = pages.select(F.col(column).alias("html"), F.struct(*rest).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), shared.value) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["row", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, text string")
