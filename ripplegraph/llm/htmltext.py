"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. Each line's length, less the text of its links, is summed
over a sliding window of lines. Where that sum surges the main text begins, and it ends where the sum
dives. Elements that are never main text (scripts, menus, what is hidden, and what names itself so by tag, role, class or id)
are markup here and leave no line; a form, a header or a name loses that where it holds the page's text. Paragraphs and headings at the edges of the
text belong to it, however short they are; only lines of links and loose short lines end there. Where the author marks an article that holds a third of the page or more, its lines widen the surge and
the dive to its own beginning and end, so short paragraphs at its edges stay; text beyond them stays as well.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches

WINDOW = 3  # lines of a block
SURGE = 80  # characters in a window from which it is text
QUIET = 3  # windows in a row below it that end the text

RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "xmp", "noembed", "noframes"}
DROPPED = {"head", "nav", "footer", "aside", "menu", "dialog", "select", "button", "option", "datalist", "input"}
AROUND = {"header", "form", "fieldset"}  # noise unless they hold the page's text
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = HEADINGS | {"p", "pre", "blockquote", "dd", "li", "figcaption"}
_WORDS = (
    r"(?:ads?|adverts?|advertis[a-z0-9]*|banner|sponsor[a-z0-9]*|promo[a-z0-9]*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"comments?|commentlist|discussions?|disqus|respond|replies|reply|nav|navbar|navigation|menu|topbar|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget|related|recommend[a-z0-9]*|"
    r"share|sharing|social|pagination|pager|toolbar|skip|search|copyright|legal|tags?|byline-links)"
)
_BEFORE = r"(?:site|main|page|global|top|bottom|left|right|primary|secondary|post|posts|entry|article|user|wp|block|js|mobile|desktop|sub|email|google|div|wrap|wrapper|story|content)"
_AFTER = (
    r"(?:list|area|areas|wrap|wrapper|container|box|links?|section|bar|block|items?|inner|outer|content|body|buttons?|icons?|form|thread|title|top|bottom|left|right|main|primary|secondary|"
    r"slot|unit|label|text|group|row|col|column|panel|articles?|posts?|stories|news|meta|author|nav|menu|to|us|this|policy|message|dialog|\d[a-z0-9]*)"
)
# a whole class or id: has-sidebar, with-comments or tag-travel only describe what holds them
MARKED = re.compile(rf"(?!(?:post|entry|article|story|content)[-_]+header)(?:{_BEFORE}[-_]+)*{_WORDS}(?:[-_]+(?:{_WORDS}|{_AFTER}))*")
ASIDE = re.compile(rf"(?:{_BEFORE}[-_]+)*(?:ads?|advert[a-z0-9]*|sponsor[a-z0-9]*|promo[a-z0-9]*|comments?|reply|replies|related|recommend[a-z0-9]*|teaser)(?:[-_]+(?:{_WORDS}|{_AFTER}))*")
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
# a quote that nothing closes is a character like any other; no part is read twice
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTE = re.compile(r"([a-zA-Z:_-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
UNQUOTED = re.compile(r"=\s*[^\s\"'=]+\s*\Z")
WHITE = re.compile(r"\s+")


def _closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that isn't part of a value without quotes."""
    return attributes.rstrip().endswith("/") and not UNQUOTED.search(attributes)


def _noise(tag: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """Whether an element is by its own word not main text: by tag, role or state, and by class or id alone.

    ``within`` a marked article a single word of class or id isn't enough, unless it is one of adverts, comments and the like.
    """
    if tag in DROPPED:
        return True, False
    named = tag in AROUND and not (tag == "header" and within)
    if not attributes or tag in ("html", "body", "main"):
        return False, named
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if (name == "role" and value in ROLES) or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return True, False
        if name in ("class", "id"):
            for x in value.split():
                named = named or bool(ASIDE.fullmatch(x) or (tag != "article" and (not within or "-" in x or "_" in x) and MARKED.fullmatch(x)))
    return " hidden" in f" {attributes.lower()} " and bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes.lower())), named


class Named:
    """What an element holds whose class or id says that it isn't main text."""

    __slots__ = ("article", "around", "h1", "paragraphs", "size", "stays")

    def __init__(self, around: Named | None = None):
        self.size, self.article, self.h1, self.paragraphs, self.around, self.stays = 0, False, False, 0, around, True

    def add(self, other: Named) -> None:
        self.size += other.size
        self.article, self.h1, self.paragraphs = self.article or other.article, self.h1 or other.h1, self.paragraphs + other.paragraphs


class Line:
    __slots__ = ("heading", "linked", "marked", "prose", "text")

    def __init__(self, text: str, linked: int, marked: bool, heading: bool, prose: bool):
        self.text, self.linked, self.marked, self.heading, self.prose = text, linked, marked, heading, prose


BARRIERS = ("div", "section", "article", "main", "table", "blockquote")  # an open element above these isn't ended by one like it
LISTS = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("table",), "th": ("table",)}
ENDS_ITSELF = ("p", "li", "dt", "dd", "tr", "td", "th", "option", "a")


class Open:
    """The open elements, and where the ones of each tag stand, so that none is looked for twice."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, Named | None]] = []  # tag, noise, article, name around it
        self.places: dict[str, list[int]] = {}
        self.noise = self.article = 0

    def last(self, tag: str) -> int:
        return (self.places.get(tag) or (-1,))[-1]

    def push(self, tag: str, bad: bool, own: bool, around: Named | None) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, bad, own, around))
        self.noise += bad
        self.article += own

    def end(self, depth: int) -> Named | None:
        """End all from ``depth`` on; the name around that element."""
        around = self.stack[depth][3]
        while len(self.stack) > depth:
            tag, bad, own, _ = self.stack.pop()
            self.places[tag].pop()
            self.noise -= bad
            self.article -= own
        return around

    def within(self, tags: set[str]) -> bool:
        return any(self.places.get(t) for t in tags)


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, with white space turned into one space, and without noise; in time linear in the page.

    What is noise by its class or id alone stays if it holds most of the page's text or the only article, or a first
    heading with paragraphs.
    """
    blocks: list[tuple[list, bool, bool, bool]] = []  # (text, in a link, name around it) of each piece; article, heading, prose
    held: list[tuple[str, bool, Named | None]] = []
    now, name, every = Open(), None, []
    outside = Named()  # of all that isn't so named
    total = 0

    def end_of_block() -> None:
        if held:
            blocks.append((held.copy(), now.article > 0, now.within(HEADINGS), now.within(PROSE)))
        held.clear()

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not now.noise:
            held.append((page[at:stop], bool(now.places.get("a")), name))
            size = len(page[at:stop].strip())
            total += size
            (name or outside).size += size
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS and not now.noise:
                end_of_block()
            if (depth := now.last(tag)) >= 0:
                name = now.end(depth)
            continue
        attributes = m[3] or ""
        if tag in RAW:
            if _closed(attributes):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in BLOCKS and not now.noise:
            end_of_block()
        if tag == "br" and not now.noise:
            held.append((" ", False, name))
        if tag in EMPTY or _closed(attributes) and tag not in BLOCKS:
            continue
        if tag in ENDS_ITSELF and (depth := now.last(tag)) >= 0:  # a new one ends an open one
            within = (*LISTS.get(tag, ()), *(BARRIERS if tag != "a" else ()))
            if not any(now.last(b) > depth for b in within):
                name = now.end(depth)
        bad, named = _noise(tag, attributes, now.article > 0)
        own = not bad and not (named and tag == "article") and (tag in ("article", "main") or 'role="main"' in attributes or 'itemprop="articleBody"' in attributes)
        around = name
        if named and not bad and not now.noise:
            name = Named(name)
            every.append(name)
        if not now.noise and not bad:
            x = name or outside
            x.article, x.h1, x.paragraphs = x.article or own, x.h1 or tag == "h1", x.paragraphs + (tag == "p")
        now.push(tag, bad, own, around)
    if not now.noise:
        end_of_block()
    for x in reversed(every):
        if x.around:
            x.around.add(x)
    for x in every:  # those around come first
        most = 2 * x.size > total and not outside.h1
        own = (x.h1 and x.paragraphs > 1) or (not outside.article and (x.article or most))
        x.stays = own and (x.around is None or x.around.stays)
    out = []
    for pieces, own, heading, prose in blocks:
        kept = [p for p in pieces if p[2] is None or p[2].stays]
        text = WHITE.sub(" ", html.unescape("".join(p[0] for p in kept))).strip()
        if text:
            out.append(Line(text, sum(len(p[0]) for p in kept if p[1]), own, heading, prose))
    return out


def window_sums(weights: list[int]) -> list[int]:
    """For each line the weight of the ``WINDOW`` lines that begin there."""
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def surge_and_dive(weights: list[int], links: list[int] | None = None, prose: list[bool] | None = None) -> tuple[int, int] | None:
    """First line and one past the last of the text between a surge and a dive of the windows' sums.

    It is the heaviest run, with those of a tenth of its weight or more that only short lines with little
    text in links (``links``, by line) part from it, and the lines of ``prose`` next to it that aren't mostly links. Where no window
    surges, it is all from the first line with text of its own to the last.
    """
    n = len(weights)
    links, prose = links or [0] * n, prose or [False] * n
    loose = lambda i: not weights[i] or not prose[i] and weights[i] * WINDOW < SURGE
    sums = window_sums(weights)
    runs, at = [], 0
    while at < n:
        if sums[at] < SURGE:
            at += 1
            continue
        begin = end = at
        quiet = 0
        while at < n and quiet < QUIET:
            if sums[at] >= SURGE:
                end, quiet = at, 0
            else:
                quiet += 1
            at += 1
        while begin + 1 < min(n, end + WINDOW) and loose(begin) and (not weights[begin] or weights[begin] < weights[begin + 1] // 4):
            begin += 1  # the window surges before its long line; lines of links don't begin a text
        stop = min(n, end + WINDOW)
        while stop - 1 > end and loose(stop - 1):
            stop -= 1
        runs.append((sum(weights[begin:stop]), begin, stop))
    if not runs:
        own = [i for i in range(n) if weights[i]]
        return (own[0], own[-1] + 1) if own else None
    heavy, begin, stop = max(runs, key=lambda r: r[0])
    little = lambda a, b: sum(links[a:b]) <= sum(weights[a:b])
    for own, start, end in reversed(runs):
        if end <= begin and 10 * own >= heavy and little(end, begin):
            begin = start
    for own, start, end in runs:
        if start >= stop and 10 * own >= heavy and little(stop, start):
            stop = end
    while begin and prose[begin - 1] and weights[begin - 1] > links[begin - 1]:
        begin -= 1
    while stop < n and prose[stop] and weights[stop] > links[stop]:
        stop += 1
    return begin, stop


def main_text(page: str | None) -> str:
    """Main text of a page, blocks joined by an empty line; empty if there is none."""
    found = lines(page or "")
    if not found:
        return ""
    weights = [max(0, len(x.text) - x.linked) for x in found]
    marked = [i for i, x in enumerate(found) if x.marked]
    widens = bool(marked) and 3 * sum(weights[i] for i in marked) >= sum(weights)
    if not any(weights):  # a text that is a link as a whole
        weights = [len(x.text) * (x.prose and len(x.text) >= SURGE) for x in found]
    span = surge_and_dive(weights, [x.linked for x in found], [x.prose for x in found])
    if span is None:
        return ""
    begin = span[0]
    while begin and found[begin - 1].heading and not found[begin - 1].linked:
        begin -= 1  # the headings that the text stands under
    end = span[1]
    if widens:
        begin, end = min(begin, marked[0]), max(end, marked[-1] + 1)
    return "\n\n".join(x.text for x in found[begin:end])


def extract(pages: DataFrame, source: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``text`` and ``n_chars`` of every row; no shuffle.

    Null and empty pages give an empty text. Broken markup is read as far as it goes: unclosed elements end with
    those around them. Repeated rows stay repeated; a page of any length is one row of a batch, and costs time in
    proportion to its length. An empty table gives an empty result; ``keep`` can't hold the new columns' names.
    """
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def of(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    small_batches(pages)
    return pages.select(*keep, F.col(source).alias("__html")).mapInArrow(of, schema)


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of ``pages``."""
    return extract(read(spark, sf_dir, "pages"), "html", ["page_id", "url"])
