"""Main text of web pages by two passes of block rules.

Markup is cut into blocks at block-level tags. The first pass decides blocks by where they stand (menus, footers,
sidebars, adverts, notices and comments are out), by link density, by length and by the density of stop words; short
blocks and those without a clear sign stay ambiguous, in a marked article as elsewhere. In the second pass an ambiguous
block takes the label of its nearest decided neighbours: theirs if they agree, else the nearer one's. Where a page marks
its article, what stands around it is out and neighbours are looked for inside it; where no block decides, all that is
left is main text.

Tags that are boilerplate by name, and what is hidden, are out. Class, id and role only raise doubts, as forms do: a
doubted element is out unless its blocks say otherwise. Where a whole token speaks against it, they must be dense while no
block outside of any doubt is, as in a wrapper around all of a page's text; where a part of one does, one dense block is
enough. The first article in a doubted element stays. Signs never put a page, its body or main outside, nor an id a
heading; an article is doubted by signs of comments alone. Where a page has next to no stop words of the lists, its
language has none of them: length without links then counts in place of their density.

Null html counts as empty and gives an empty text. Unclosed and stray tags are taken as they come; a select or button
that isn't closed ends at the next block. Very long pages are read whole, in time that grows with their length. White
space inside a block becomes one space, blocks are joined by a line end, and nothing is cut. Rows that repeat have equal
results. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shardmend.llm.common import arrow_map

# Elements whose content is never text, elements that start and end blocks, and those without content.
SILENT = "script style noscript template svg math canvas iframe object head title select textarea button".split()
BLOCKS = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Elements that are boilerplate wherever they stand, and tokens of class, id or role that say so.
OUTSIDE = "nav aside footer menu dialog search".split()
SIGNS = "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments comments-list comment-list consent cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted recommended related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe subscription tags toolbar widget complementary contentinfo search".split()
#: Signs that tell as any part of a token, as in "content-ad".
PART_SIGNS = "ad ads advert advertisement banner breadcrumb comment comments cookie cookies newsletter popup promo sidebar sponsor sponsored".split()
MAIN = "article main".split()
#: Signs of reader comments, which may be articles by their tags.
COMMENT_SIGNS = "comment comments replies reply respond".split()
#: Elements that class, id and role never put outside, and headings, whose ids are often slugs of their text.
UNSIGNED = "html body main article".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
# Frequent words of the languages that pages are in.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its more
    most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wie wird zu zum zur
    al como con cuando de del desde donde el ella en entre era es esta este fue ha la las lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una y ya""".split()
)
LINKS, DENSE, SOME, LONG, SHORT = 0.5, 0.3, 0.15, 200, 70
#: A page with fewer stop words than this share of its words is in none of their languages.
KNOWN = 0.05
#: Degrees of doubt, as numbers that elements are counted up in: by a part of a sign, by a whole one; without doubt outside.
PART, WHOLE, SURE = 1, 2, 3

_START = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile(r""">|=\s*(["'])""")
#: Elements whose content holds no tags, and what a head may hold.
RAW = "script style textarea title iframe noembed noframes xmp".split()
HEAD = "base basefont bgsound link meta noscript script style template title".split()
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD_EDGE = re.compile(r"^\W+|\W+$")
#: Blocks that a select may hold.
OPTIONS = frozenset(("option", "optgroup", "hr", "legend"))
_KIND = {**dict.fromkeys(BLOCKS, 1), "br": 2, "a": 3}
_SILENT, _VOID, _OUTSIDE, _SIGNS, _PART_SIGNS, _MAIN, _UNSIGNED, _HEADINGS, _HEAD, _COMMENT_SIGNS = map(frozenset, (SILENT, VOID, OUTSIDE, SIGNS, PART_SIGNS, MAIN, UNSIGNED, HEADINGS, HEAD, COMMENT_SIGNS))


class Block:
    """Pieces of text between two block tags, which of them are links, and where the block stands.

    ``outside``: -1 without doubt, else the number of the outermost doubted element, which is even where a whole sign speaks.
    """

    __slots__ = ("article", "counted", "links", "outside", "parts", "share", "text")

    def __init__(self, outside: int, article: int, text: str = ""):
        self.parts: list[str] = []
        self.links: list[str] = []
        self.outside, self.article = outside, article
        self.text = text
        self.share: float | None = None
        self.counted: tuple[int, int] | None = None

    def link_share(self) -> float:
        if self.share is None:
            links = len(" ".join(entities.unescape(" ".join(self.links)).split())) if self.links else 0
            self.share = links / len(self.text)
        return self.share

    def stop_words(self) -> tuple[int, int]:
        """How many of its words are stop words, and how many words it has."""
        if self.counted is None:
            words = self.text.lower().split()
            self.counted = sum((w if w.isalpha() else _WORD_EDGE.sub("", w)) in STOP_WORDS for w in words), len(words)
        return self.counted


def outside_by_signs(element: str, attributes: str) -> int:
    """How far an element's attributes say that it is no main text: SURE where it is hidden, WHOLE, PART or 0."""
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return SURE
        if name in ("class", "id", "role") and (element == "article" or element not in _UNSIGNED) and not (name == "id" and element in _HEADINGS):
            for token in value.split():
                parts = re.split("[-_]+", token)
                if element == "article":
                    found = WHOLE if not _COMMENT_SIGNS.isdisjoint((token, parts[0])) else found
                elif token in _SIGNS or "-".join(parts) in _SIGNS or parts[0] in _SIGNS:
                    found = WHOLE
                elif name != "id" and not _PART_SIGNS.isdisjoint(parts):
                    found = max(found, PART)
    return found


def markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of tags in order; comments and declarations have no name.

    A tag ends at a bracket outside quotes, which open after an equals sign only, or where that doesn't come at the next
    one. A comment that doesn't end takes the rest, as does a raw element; a tag that doesn't end is text.
    """
    at, last, failed, endless = 0, {}, set(), set()

    def tag_end(pos: int) -> int:
        # Places outside quotes from where no bracket comes, and the last quote of each kind, are looked for once.
        seen = []
        while pos not in failed and (m := _STOP.search(page, pos)):
            quote = m.group(1)
            if not quote:
                return m.end()
            if quote not in last:
                last[quote] = page.rfind(quote)
            pos = page.find(quote, m.end()) + 1 if last[quote] >= m.end() else m.end()
            seen.append(pos)
        failed.update(seen)
        return 0

    while m := _START.search(page, at):
        name = (m.group(3) or "").lower()
        if m.group(1):
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else len(page)
        else:
            at = (name and tag_end(m.end())) or page.find(">", m.end()) + 1
            if not at:
                return
        yield m.start(), at, bool(m.group(2)), name, page[m.end() : at - 1] if name else ""
        if name in _RAW_END and not m.group(2) and (name == "script" or page[at - 2] != "/"):
            # A kind without an end tag from here on has none further on.
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end is None:
                endless.add(name)
                if name != "script" and name != "style":
                    continue
            at = end.start() if end else len(page)


def blocks_of(page: str) -> list[Block]:
    """Non-empty blocks of a page, in order."""
    out: list[Block] = []
    open_: list[tuple[str, int, int, bool]] = []  # name, outside (-1, or the number of a doubted element), article, silent
    count: dict[str, int] = {}
    outside, article, silent, in_link, articles, doubted, broken = 0, 0, False, 0, 0, 0, False
    block = Block(0, 0)

    def cut() -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(entities.unescape("".join(block.parts)).split())
            if block.text:
                out.append(block)
        block = Block(outside, article)

    def doubt(sign: int) -> int:
        """Where what an element holds stands, by how far its signs speak against it; the outermost doubt counts, but for sure signs."""
        nonlocal doubted
        if outside < 0 or sign == SURE:
            return -1
        if outside and (outside % 2 == 0 or sign == PART):
            return outside
        doubted += 1
        return 2 * doubted - (sign == PART)

    def end_silence() -> None:
        nonlocal outside, article, silent
        last, outside, article, silent = open_.pop()
        count[last] -= 1
        block.outside, block.article = outside, article

    at = 0
    for start, end, closes, name, attributes in markup(page):
        if silent and open_[-1][0] == "head" and (page[at:start].strip() or name and not closes and name not in _HEAD):
            end_silence()
        if start > at and not silent:
            piece = page[at:start]
            block.parts.append(piece)
            if not piece.isspace():
                broken = False
                if in_link:
                    block.links.append(piece)
        at = end
        if not name:
            continue
        if silent and not closes and open_[-1][0] in ("select", "button") and name in _KIND and _KIND[name] == 1 and name not in OPTIONS:
            end_silence()
        if silent:
            if not closes and open_[-1][0] == "head" and name in _SILENT:
                open_.append((name, outside, article, silent))
                count[name] = count.get(name, 0) + 1
            if not (closes and name == open_[-1][0]):
                continue
        kind = _KIND.get(name)
        if kind == 2:
            # One line break is white space, two in a row end a block.
            if broken:
                cut()
            block.parts.append(" ")
            broken = not broken
            continue
        if kind == 3:
            in_link = max(0, in_link - 1) if closes else in_link + 1
            continue
        if name in _VOID:
            if kind:
                cut()
            continue
        if kind is None and name not in _SILENT:
            if not closes or not count.get(name):
                if not closes and "=" in attributes and (sign := outside_by_signs(name, attributes)):
                    cut()
                    open_.append((name, outside, article, silent))
                    count[name] = count.get(name, 0) + 1
                    outside = block.outside = doubt(sign)
                continue
        if kind or name in _SILENT:
            cut() if kind else None
            in_link = 0 if kind else in_link
        if closes:
            if count.get(name):
                while True:
                    last, outside, article, silent = open_.pop()
                    count[last] -= 1
                    if last == name:
                        break
                if block.parts and (block.outside, block.article) != (outside, article):
                    cut()
                block.outside, block.article = outside, article
            continue
        if name in ("svg", "math") and attributes.endswith("/"):
            continue
        open_.append((name, outside, article, silent))
        count[name] = count.get(name, 0) + 1
        if name in _SILENT:
            silent = True
            continue
        sign = outside_by_signs(name, attributes) if attributes else 0
        if name in _MAIN and not sign and (not outside or outside > 0 and not articles):
            outside = 0
            articles += 1
            article = article or articles
        if name in _OUTSIDE or name == "header" and not article:
            sign = SURE
        elif name == "form":
            sign = max(sign, WHOLE)
        if sign:
            outside = doubt(sign)
        block.outside, block.article = outside, article
    if silent and open_[-1][0] == "head" and page[at:].strip():
        end_silence()
    if at < len(page) and not silent:
        block.parts.append(page[at:])
    cut()
    return out


def is_dense(block: Block, known: bool) -> bool:
    """Whether a block reads as running text by its length, links and stop words alone; without stop words, by its length."""
    if len(block.text) < SHORT or block.link_share() > LINKS:
        return False
    stops, words = block.stop_words()
    return stops >= DENSE * words if known else len(block.text) >= LONG


def first_label(block: Block, marked: bool, known: bool) -> int:
    """1 for main text, 0 for boilerplate, -1 where a block by itself doesn't tell."""
    if block.outside or marked and not block.article:
        return 0
    size = len(block.text)
    if block.link_share() > LINKS:
        return 0
    if "©" in block.text[:200] and size < LONG and not block.article:
        return 0
    if size < SHORT:
        return -1
    stops, words = block.stop_words()
    if not known:
        return 1 if size >= LONG else -1
    return 1 if stops >= DENSE * words or size >= LONG and stops >= SOME * words else -1


def in_known_language(blocks: list[Block]) -> bool:
    """Whether the running text of a page holds stop words at all."""
    counts = [b.stop_words() for b in blocks if b.outside >= 0 and len(b.text) >= SHORT and b.link_share() <= LINKS]
    return sum(s for s, _ in counts) >= KNOWN * sum(w for _, w in counts)


def settled(blocks: list[Block], known: bool) -> list[int]:
    """Where blocks stand once doubts are settled: -1 outside, 0 not."""
    if not any(b.outside > 0 for b in blocks):
        return [b.outside for b in blocks]
    dense = [b.outside >= 0 and is_dense(b, known) for b in blocks]
    free = any(d and (not b.outside or b.outside % 2) for b, d in zip(blocks, dense, strict=True))
    marked = any(b.article and not b.outside for b in blocks)
    back = {b.outside for b, d in zip(blocks, dense, strict=True) if d and b.outside > 0 and (b.outside % 2 or not free and not marked)}
    return [0 if b.outside == 0 or b.outside in back else -1 for b in blocks]


def second_labels(first: list[int], decided: list[bool]) -> list[int]:
    """Ambiguous labels by their nearest decided neighbours: the nearer one's, main text where they are as near or there are none."""
    n = len(first)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if decided[i - 1] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if decided[i + 1] else after[i + 1]
    out = []
    for i, x in enumerate(first):
        a, b = before[i], after[i]
        if x < 0:
            left, right = (first[a] if a >= 0 else None), (first[b] if b < n else None)
            if left is None or right is None or left == right:
                x = right if left is None else left
                x = 1 if x is None else x
            else:
                x = left if i - a < b - i else right if b - i < i - a else 1
        out.append(x)
    return out


def labelled(blocks: list[Block]) -> list[int]:
    """Labels of blocks after both passes."""
    known = in_known_language(blocks)
    for b, outside in zip(blocks, settled(blocks, known), strict=True):
        b.outside = outside
    marked = any(b.article for b in blocks)
    first = [first_label(b, marked, known) for b in blocks]
    # In a marked article only blocks that could be text count as neighbours, so that what surrounds it decides nothing.
    decided = [x >= 0 and (not marked or bool(b.article) and not b.outside) for x, b in zip(first, blocks, strict=True)]
    return second_labels(first, decided)


def main_text(page: str | None) -> str:
    """The main text of a page, one line for each block."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, x in zip(blocks, labelled(blocks), strict=True) if x)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    types = dict(pages.dtypes)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
