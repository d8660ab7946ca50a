"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines: every block-level tag (and <br>) ends a line,
white space inside a line becomes one space, character references are decoded.
A line's weight is its text length without link text. Hints of the markup only
change weights: lines inside menus, headers, footers, sidebars, notices, adverts,
forms and comments (told by their tags, roles and class words) weigh nothing, and
where the page's <article> and <main> elements hold at least ``SHARE`` of the
weight, lines inside them weigh ``BOOST`` times theirs and lines outside nothing.

The distribution decides, in the same way on every page. Weights are summed over
sliding windows of ``WINDOW`` lines. A surge is the first line with weight whose
window reaches the threshold while no stretch is open: ``THRESHOLD`` characters or
a quarter of the page's largest window, whichever is less. A dive is the first
line from which a whole window is empty. Lines between surge and dive are the
text, however short they are, apart from those that a hint took the weight of.
Short lines before a surge and behind a dive join them if no more than ``NEAR``
lines without text lie between.

Class words are read token by token; inside an article a token must be a known
block's name as a whole (post-share, related-posts; not social-studies). Tokens that deny something (no-sidebar),
tell of the layout (has-sidebar) or of a subject (category-social, tag-search)
mark nothing, nor do headers of entries and search results. Class words do not
strip a page's outermost <article>, unless one is the whole token, nor an element
with at least half of the page's text that holds its <h1> or <main>, or an
<article> where no text would be left.

Null, empty and text-free pages give an empty text. Whole pages are read; tags
that are never closed, closed twice or cut off at the end are tolerated, and
attributes may be of any length. A very long page is held whole by one task and
read in linear time. An empty table gives an empty one, repeated rows give repeated results; other columns stay, but for those called text or n_chars.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
THRESHOLD = 80
NEAR = 2 * WINDOW
#: What lines inside an <article> or <main> weigh more, and from which share of the page's weight on.
BOOST = 8
SHARE = 0.25

#: Tags whose content is never text.
_RAW = frozenset("script style noscript template svg math head iframe object canvas audio video map select textarea button datalist".split())
#: Tags that hold other things than the main text.
_ASIDE = frozenset("nav footer aside form dialog menu fieldset".split())
#: Tags that end a line.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of classes, ids and roles that mark other things than the main text.
_WORDS = (
    "ads?|adverts?|advertisements?|adbox|banners?|sponsor(?:ed)?|promos?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|footers?|masthead|site-?header|page-?header"
    "|cookies?|consent|notices?|alerts?|popups?|modals?|overlays?|newsletter|subscribe|signup|login|comments?|comment-?list|respond|replies|disqus|discussion"
    "|share|sharing|social|related|recommended|widgets?|pagination|pager|skip-?link|contentinfo|complementary|search"
)
_MARKED = re.compile(rf"(?:^|[^a-z])(?:{_WORDS}|header)(?:$|[^a-z])")
#: What may follow a marked word in the name of a block inside an article.
_BLOCK_NAME = re.compile(
    rf"(?:.*-)?(?:{_WORDS})(?:-(?:area|articles?|bar|block|body|box|buttons?|container|content|feed|form|group|icons?|inner|items?|links?|list|media|module|panel|posts?|section|slot|stor(?:y|ies)|thread|unit|wrap|wrapper|\d+))*"
)
#: Class tokens with a marked word that mark nothing.
_UNMARKED = re.compile(r"(?:no|not|non|without|with|has|hide|hidden|is|category|cat|tag|tags|tax|taxonomy|topic|subject|format|post-tag|post-category|post-format)-.*|(?:.*-)?(?:entry|post|article|story|content)-header|(?:.*-)?search-results?(?:-.*)?")
#: What ends a tag or opens an attribute's value, and where a tag's name ends.
_STOP = re.compile("[>\"']")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``: its ">" outside of quoted values; -1 if the page ends first."""
    begin = at
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        k = m.start() - 1
        while k > begin and page[k].isspace():
            k -= 1
        close = page.find(m[0], m.end()) if k >= begin and page[k] == "=" else -1  # a quote opens a value only behind "="
        at = m.end() if close < 0 else close + 1
    return -1


def _pieces(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """``(text in front, closing, tag, attributes, place behind)`` of every tag; comments and declarations are tags without a name.

    The last one's tag is None. A tag or comment that the page's end cuts off is no text.
    """
    begin = at = 0
    open_quotes = 0  # tags whose end was sought in vain: beyond, the first ">" ends a tag, so that reading stays linear
    while (place := page.find("<", at)) >= 0:
        if page.startswith("<!--", place):
            end = page.find("-->", place + 4)
            yield page[begin:place], False, "", "", (begin := at) if end < 0 else end + 3
            if end < 0:
                return
            begin = at = end + 3
            continue
        name = _NAME.match(page, place + 1)
        if name is None and page[place + 1 : place + 2] not in ("!", "?"):
            at = place + 1  # a sign of the text
            continue
        behind = name.end() if name else place + 2
        end = _tag_end(page, behind) if name and not open_quotes else page.find(">", behind)
        if end < 0 and name and not open_quotes:
            open_quotes = 1
            end = page.find(">", behind)
        if end < 0:
            yield page[begin:place], False, None, "", len(page)
            return
        if name is None:
            yield page[begin:place], False, "", "", end + 1
        else:
            jump = yield page[begin:place], page[place + 1] == "/", name[1].lower(), page[behind:end], end + 1
            if jump is not None:
                yield "", False, "", "", jump
                end = jump - 1
        begin = at = end + 1
    yield page[begin:], False, None, "", len(page)


class Line:
    """A line of a page: its text, the length of its link text, and where it stands."""

    __slots__ = ("text", "linked", "aside", "inside")

    def __init__(self, text: str, linked: int, aside: bool, inside: bool):
        self.text, self.linked, self.aside, self.inside = text, linked, aside, inside


def _hidden(attributes: str) -> bool:
    for name, *values in _NAMED.findall(attributes):
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and "".join(values).lower() == "true":
            return True
    return False


def _marked(attributes: str, whole: bool = False, inside: bool = False) -> bool:
    """Whether a class, id or role has a marked word; with ``whole`` only those that are one, with ``inside`` only names of blocks."""
    for name, *values in _NAMED.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in "".join(values).lower().replace("_", "-").split():
                found = _MARKED.fullmatch(token) if whole else _BLOCK_NAME.fullmatch(token) if inside else _MARKED.search(token)
                if found and not _UNMARKED.fullmatch(token):
                    return True
    return False


def lines(page: str) -> list[Line]:
    """The page's lines, those without text included: they separate blocks."""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool, int | None]] = []  # open tag, makes aside, makes inside, number of the marked element
    marked: list[list[int]] = []  # the first line of each element with class words, and the line behind it
    heads: list[int] = []
    articles: list[int] = []
    text: list[str] = []
    linked: list[str] = []
    link = asides = insides = 0

    def end_line() -> None:
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        under = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip())
        out.append(Line(joined, under, asides > 0, insides > 0))
        text.clear()
        linked.clear()

    def close(gone: list[tuple]) -> None:
        nonlocal asides, insides
        for _, a, b, mark in gone:
            asides, insides = asides - a, insides - b
            if mark is not None:
                marked[mark][1] = len(out)

    reader = _pieces(page)
    for piece, closing, tag, attributes, behind in reader:
        if piece:
            text.append(piece)
            if link:
                linked.append(piece)
        if not tag:
            continue
        if tag == "a":
            link = 0 if closing else 1
        if not closing and tag in _RAW and not attributes.rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, behind)
            if tag in _BLOCKS or tag == "head":
                end_line()
            reader.send(stop.end() if stop else len(page))
            continue
        if tag in _BLOCKS:
            end_line()
        if tag in _VOID or tag not in _BLOCKS and tag not in ("span", "figure"):
            continue
        if closing:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if place is not None and not (tag == "p" and any(s[0] != "p" for s in stack[place + 1 :])):
                close(stack[place:])
                del stack[place:]
            continue
        if tag in ("p", "li", "dd", "dt", "td", "th", "tr", "option") and stack and stack[-1][0] == tag:
            close([stack.pop()])  # such a tag ends the one before it
        inside = tag in ("article", "main")
        if inside and not insides and (asides or any(s[3] is not None for s in stack)) and not any((s[1] or s[3] is not None) and s[0] in ("div", "section", "li", "ul", "ol") for s in stack):
            close([(t, a, False, mark) for t, a, _, mark in stack])  # a menu or header that was never closed
            stack = [(t, False, b, None) for t, _, b, _ in stack]
        if tag in ("h1", "main"):
            heads.append(len(out))
        elif tag == "article":
            articles.append(len(out))
        free = tag in ("html", "body", "main")
        aside = tag in _ASIDE or tag == "header" and not insides or not free and _hidden(attributes)
        mark = None
        if not aside and not free and _marked(attributes, whole=tag == "article" and not insides, inside=insides > 0):
            mark = len(marked)
            marked.append([len(out), -1])
        stack.append((tag, aside, inside, mark))
        asides, insides = asides + aside, insides + inside
    end_line()
    _strip(out, [(a, len(out) if b < 0 else b) for a, b in marked], heads, articles)
    return out


def _strip(found: list[Line], marked: list[tuple[int, int]], heads: list[int], articles: list[int]) -> None:
    """Set aside the lines of elements with class words, but not of one that holds the page's text and its head."""
    if not marked:
        return
    sizes = [0, *accumulate(len(x.text) for x in found)]

    def holds(span: tuple[int, int], places: list[int]) -> bool:
        return bisect_left(places, span[0]) < bisect_left(places, span[1])

    def covered(spared: set[tuple[int, int]]) -> list[bool]:
        steps = [0] * (len(found) + 1)
        for span in marked:
            if span not in spared:
                steps[span[0]] += 1
                steps[span[1]] -= 1
        return [depth > 0 for depth in accumulate(steps[:-1])]

    most = [span for span in marked if 2 * (sizes[span[1]] - sizes[span[0]]) >= sizes[-1] > 0]
    spared = {span for span in most if holds(span, heads)}
    under = covered(spared)
    if not any(x.text and not x.aside and not u for x, u in zip(found, under, strict=True)):
        under = covered(spared | {span for span in most if holds(span, articles)})
    for x, u in zip(found, under, strict=True):
        x.aside |= u


def weights(found: list[Line]) -> list[int]:
    """The weight of each line, hints included."""
    plain = [0 if x.aside else max(0, len(x.text) - x.linked) for x in found]
    inside = sum(w for w, x in zip(plain, found, strict=True) if x.inside)
    if inside and inside >= SHARE * sum(plain):
        # Lines of links alone weigh as much as their text there, so that they stay with what is around them.
        return [(BOOST * w or (not x.aside) * len(x.text)) if x.inside else 0 for w, x in zip(plain, found, strict=True)]
    return plain


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD, near: int = NEAR) -> str:
    """The text between surges and dives of the page's line-block distribution."""
    found = lines(page or "")
    weight = weights(found)
    n = len(weight)
    sums = [0, *accumulate(weight)]
    block = [sums[min(n, i + window)] - sums[i] for i in range(n)]
    least = min(threshold, max(block, default=0) / 4) or 1
    kept = [False] * n
    surged = False
    for i in range(n):
        surged = block[i] > 0 and (surged or weight[i] > 0 and block[i] >= least)
        kept[i] = surged and weight[i] > 0
    for way in (range(n), range(n - 1, -1, -1)):
        last = None  # the nearest line of text that is kept; none behind one that is left out
        for i in way:
            if found[i].text:
                kept[i] |= weight[i] > 0 and last is not None and abs(i - last) <= near + 1
                last = i if kept[i] else None
    return "\n".join(x.text for x, k in zip(found, kept, strict=True) if k and x.text)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars`` (code points) of every row.

    Columns of ``pages`` that are called text or n_chars in any case give way.
    """
    keep = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    slim = pages.select(*keep, F.col(html_col).cast("string").alias("text"))
    schema = slim.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], batch.schema.names)

    return slim.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
