"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. What the markup itself names as something
other than the article (menus, headers and footers of the page, sidebars, notices,
adverts, forms, scripts, styles, reader comments: by element, role, or a word of its class
or id) is taken out first; blocks inside ``article``/``main`` form the article zone.

First pass: a block with too many link characters is bad; a long one with enough stop
words is good; one of middle length with some stop words is good too; a short one is
undecided. Outside the article zone a long block with hardly any stop word is bad; inside
it is undecided, since lists, code and junk prose have none.

The stop words are of four languages. If a page has no article zone and less than half of
its long text with few links reaches the lower density, or if no block of it is good, they do not fit the page (another
language, code, tables, lists), and length and links alone decide: a long block with few
links is good, and so is a short one if the page has no long one.

Second pass: undecided blocks take the label of their nearest decided neighbour; a tie
goes to good inside the article zone and where length and links decide, and to bad outside. Inside
the article zone a block of links is left out, but says nothing about the blocks beside it. Without any decided neighbour a
block of the article zone is good, and so is one of a page that has no such zone. If a
page has an article zone with text, blocks outside it are bad.

Good blocks are joined in page order by one space; references are decoded, white space
inside a block becomes one space, and nothing is cut off.

The parser is tolerant: unclosed elements, stray end tags and broken declarations do not
fail, and an ``article`` that opens inside an unclosed menu or header ends it.

Pages are read one by one in Arrow batches; nothing is shuffled and tasks hold no state.

Edge cases: a null or empty page gives the empty text; a page of text without markup is
one block. Repeated rows are extracted each. An empty table gives no rows. Input columns
named like a result column are replaced; others pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Common words of English, German, French and Spanish.
STOP_WORDS = frozenset("""
the of and to in is that it was for on are as with at be this have from or had by but not what all were when we there
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach
de la le et les en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec
el y los del las por con no su para al lo como más o pero sus ha me si sin sobre este
""".split())

# HTML elements.
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul
""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_TAGS = frozenset("""
aside button canvas dialog embed footer form head iframe menu nav noscript object optgroup option script select style svg
template textarea title
""".split())
OTHER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# Words of a class or id that name something other than the article.
OTHER_WORDS = frozenset("""
ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie
cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification
overlay pager pagination popup promo recommended related replies reply respond share sharing signup social sponsor sponsored
subscribe subscription toolbar widget
""".split())
# These count only where the same element is not named as the content as well.
WEAK_WORDS = frozenset("aside header hidden search sidebar".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
# Words that make the next one a part of the layout: content-with-comments.
LAYOUT_WORDS = frozenset("with without has have no".split())
# Words that make the one before them a state, a use or a subject: menu-open, hidden-print, notice-of-election.
STATE_WORDS = frozenset("open opened closed collapsed expanded active enabled disabled on off print of xs sm md lg".split())
# Words whose elements are no wrappers of the article, however much prose they hold.
NEVER_WORDS = frozenset("""
ad ads advert advertisement advertising adverts comment comments commentlist consent cookie cookies copyright disqus footer gdpr
newsletter recommended related replies reply respond sponsored
""".split())
WRAPS = 0.8  # share of a page's prose
#: A p, li, ... that opens ends the one before it.
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.15, 0.30
LINKS_OUTSIDE, LINKS_INSIDE = 0.33, 0.5

_WORDS = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_RAW = re.compile(r"<(/?(?:script|style))\b", re.IGNORECASE)
GOOD, BAD, UNDECIDED = 1, 0, None


def _names(value: str | None) -> set[str]:
    """Lower-case words of a class or id, with camel case cut and whole."""
    value = value or ""
    return set(_NAME.findall(value.lower())) | set(_NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))


def _names_other(token: str) -> bool:
    """Whether a class or id is made of words for something other than the article, and of
    words for its content, only: ``comment-body``, but not ``category-social``."""
    for value in (token.lower(), re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()):
        words = set(_NAME.findall(value))
        if words & OTHER_WORDS and words <= OTHER_WORDS | WEAK_WORDS | CONTENT_WORDS:
            return True
    return False


def _names_content(token: str) -> bool:
    """Whether a class or id names the content: ``entry-content``, but not ``text-center`` or
    ``post-comments``."""
    words = _names(token)
    if words & OTHER_WORDS and not words & LAYOUT_WORDS:
        return False
    return bool(words & (CONTENT_WORDS - {"text", "body"})) or (bool(words) and words <= CONTENT_WORDS)


def _kind_words(token: str) -> set[str]:
    """Words of a class or id, without those that state a layout."""
    out: set[str] = set()
    for value in (token.lower(), re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()):
        words = _NAME.findall(value)
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            if before not in LAYOUT_WORDS and after not in STATE_WORDS:
                out.add(word)
    return out


PART, MAYBE, OTHER = 0, 1, 2  # of the page; other unless it wraps the article; other


def _is_other(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> int:
    if tag == "form":
        return MAYBE
    if tag in OTHER_TAGS or (tag == "header" and not in_article):
        return OTHER
    words: set[str] = set()
    tokens: list[str] = []
    for key, value in attrs:
        if key in ("class", "id"):
            tokens += (value or "").split()
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and _HIDDEN.search(value.lower())):
            return OTHER
        elif key == "role" and value and value.lower() in OTHER_ROLES:
            return OTHER
    for token in tokens:
        words |= _kind_words(token)
    if tag in ("html", "body", "main") or not words:
        return PART
    kind = OTHER if words & NEVER_WORDS else MAYBE
    if words & OTHER_WORDS:
        # <div class="main-content with-comments"> names its layout, not its kind.
        if {"main", "content"} <= words:
            return PART
        # <article class="post tag-cookies"> and <div class="entry-content comments-open"> are
        # the article; <div class="entry-content comments"> is not.
        if any(map(_names_other, tokens)) or not (tag == "article" or any(map(_names_content, tokens))):
            return kind
    return MAYBE if words & WEAK_WORDS and not (words & CONTENT_WORDS) and not ("header" in words and in_article) else PART


class _Blocks(HTMLParser):
    """Blocks ``(text, link characters, inside the article zone, elements around it that may be other)`` of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # element, kind, opens the article zone
        self.count: Counter[str] = Counter()  # of open elements
        self.other = self.links = self.zone = self.number = 0
        self.maybe: list[int] = []  # numbers of the open elements that may be other
        self.blocks: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.parts: list[str] = []
        self.link_chars = 0

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((text, self.link_chars, self.zone > 0, tuple(self.maybe)))
            self.parts, self.link_chars = [], 0

    def _pop(self) -> None:
        tag, kind, zone = self.open.pop()
        self.count[tag] -= 1
        self.other -= kind == OTHER
        if kind == MAYBE:
            self.maybe.pop()
        self.zone -= zone
        self.links -= tag == "a"

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            self._pop()

    def _last(self, tag: str) -> int:
        """Place of the innermost open ``tag``, of which there is one."""
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            at -= 1
        return at

    def handle_starttag(self, tag, attrs) -> None:
        block = tag in BLOCK_TAGS
        if block:
            self.cut()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        if block and any(x[0] == "p" for x in self.open[-6:]):  # a paragraph ends where the next block begins
            self._close(self._last("p"))
        elif tag in ENDS_SAME and self.open and self.open[-1][0] in ENDS_SAME[tag]:
            self._close(len(self.open) - 1)
        while tag == "a" and self.links:  # links do not nest
            self._close(self._last("a"))
        kind = _is_other(tag, attrs, self.zone > 0)
        zone = kind == PART and (tag in ("article", "main") or any(k == "role" and v == "main" for k, v in attrs) or any(k == "itemprop" and v == "articleBody" for k, v in attrs))
        if zone and tag in ("article", "main") and self.other:
            first = next(i for i, x in enumerate(self.open) if x[1] == OTHER)
            if self.open[first][0] in ("nav", "header", "aside", "menu", "footer", "head", "title"):  # never closed
                self._close(first)
        if kind == MAYBE:
            self.number += 1
            self.maybe.append(self.number)
        self.open.append((tag, kind, zone))
        self.count[tag] += 1
        self.other += kind == OTHER
        self.zone += zone
        self.links += tag == "a"

    def handle_endtag(self, tag) -> None:
        if tag in BLOCK_TAGS:
            self.cut()
        if self.count[tag]:
            self._close(self._last(tag))

    def handle_data(self, data) -> None:
        if not self.other:
            self.parts.append(data)
            if self.links:
                self.link_chars += len("".join(data.split()))


def _prose(text: str, link_chars: int) -> int:
    """Characters of a block that is long and has few links."""
    return len(text) if len(text) >= LENGTH_LOW and not _linked(text, link_chars, False) else 0


def _of_the_page(blocks: list[tuple[str, int, bool, tuple[int, ...]]]) -> list[tuple[str, int, bool]]:
    """Blocks without those of elements that are other, as they do not hold most of the prose."""
    held: Counter[int] = Counter()
    total = 0
    for text, link_chars, _, around in blocks:
        size = _prose(text, link_chars)
        total += size
        for k in around if size else ():
            held[k] += size
    return [(t, n, z) for t, n, z, around in blocks if all(total and held[k] >= WRAPS * total for k in around)]


def _without_false_zone(blocks: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """Blocks less an article zone that holds less than half of the prose of a run of blocks outside."""
    zone = best = run = 0
    for text, link_chars, inside in blocks:
        size = _prose(text, link_chars)
        zone += size if inside else 0
        run = 0 if inside or _linked(text, link_chars, False) else run + (size if size and _stops(text) >= STOP_LOW else 0)
        best = max(best, run)
    return [b for b in blocks if not b[2]] if best > 2 * zone else blocks


def page_blocks(html: str | None) -> list[tuple[str, int, bool]]:
    """``(text, link characters, inside the article zone)`` of a page's blocks that the
    markup does not rule out, in page order."""
    if not html:
        return []
    html = html.replace("<![", "<!x[")  # marked sections are broken comments in HTML
    last = html.rfind("<!--")
    if last >= 0 and "-->" not in html[last:] and "--!>" not in html[last:]:
        raw = [m.group(1) for m in _RAW.finditer(html, 0, last)]
        if not raw or raw[-1].startswith("/"):  # a comment that nothing ends, not in a script
            html = html[:last]
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    return _without_false_zone(_of_the_page(parser.blocks))


def _linked(text: str, link_chars: int, inside: bool) -> bool:
    return link_chars > (LINKS_INSIDE if inside else LINKS_OUTSIDE) * (len(text) - text.count(" "))


def _stops(text: str) -> float:
    words = _WORDS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def first_pass(text: str, link_chars: int, inside: bool) -> int | None:
    """Label of one block by length, link density and stop-word density."""
    if _linked(text, link_chars, inside):
        return BAD
    if len(text) < LENGTH_LOW:
        return UNDECIDED
    stops = _stops(text)
    if stops >= STOP_HIGH or (stops >= STOP_LOW and len(text) <= LENGTH_HIGH) or (inside and stops >= STOP_LOW):
        return GOOD
    if inside or stops >= STOP_LOW:
        return UNDECIDED
    return BAD


def _by_length(blocks: list[tuple[str, int, bool]], labels: list[int | None]) -> list[int | None] | None:
    """Labels by length and links alone, if the stop words do not fit a page without an
    article zone or left nothing of it good; otherwise nothing."""
    plain = [text for text, link_chars, inside in blocks if not _linked(text, link_chars, inside)]
    long = [text for text in plain if len(text) >= LENGTH_LOW]
    fitting = sum(len(text) for text in long if _stops(text) >= STOP_LOW)
    if GOOD in labels and 2 * fitting >= sum(map(len, long)):
        return None
    return [BAD if _linked(*b) else GOOD if not long or len(b[0]) >= LENGTH_LOW else UNDECIDED for b in blocks]


def second_pass(labels: list[int | None], tie_good: bool) -> list[int]:
    """Undecided blocks take the label of the nearest decided one."""
    decided = [i for i, x in enumerate(labels) if x is not UNDECIDED]
    out, k = [], 0
    for i, label in enumerate(labels):
        if label is UNDECIDED:
            while k < len(decided) and decided[k] < i:
                k += 1
            near = [(abs(j - i), labels[j]) for j in decided[max(k - 1, 0):k + 1]]
            if not near:
                label = GOOD
            else:
                least = min(d for d, _ in near)
                tied = {x for d, x in near if d == least}
                label = tied.pop() if len(tied) == 1 else (GOOD if tie_good else BAD)
        out.append(label)
    return out


def main_text(html: str | None) -> tuple[str, int]:
    """The main text and the number of its blocks."""
    blocks = page_blocks(html)
    inside = any(z for _, _, z in blocks)
    blocks = [b for b in blocks if b[2] or not inside]
    labels = [first_pass(*b) for b in blocks]
    if inside:  # a list of links in an article is left out by itself
        blocks, labels = [b for b, x in zip(blocks, labels) if x is not BAD], [x for x in labels if x is not BAD]
    plain = None if inside else _by_length(blocks, labels)
    labels = second_pass(plain or labels, inside or plain is not None)
    kept = [text for (text, _, _), label in zip(blocks, labels) if label == GOOD]
    return " ".join(kept), len(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, plus ``text``, ``n_chars`` and ``n_blocks`` (long)."""
    added = ("text", "n_chars", "n_blocks")
    kept = [f for f in pages.schema if f.name != html_col and f.name.lower() not in added]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [main_text(x.as_py()) for x in part.column(html_col)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                    names=[*names, *added])

    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])
    return pages.mapInArrow(run, schema)
