"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page that has text, in page
order. A line weighs what it has of characters outside links. Lines of scripts,
styles, menus, page headers and footers, sidebars, notices, adverts, forms and
reader comments, told by elements, roles and class names, weigh nothing, and so do
lines that are mostly links, other than paragraphs of an article. Within an article
class names count only as a whole. A form, or an element of such a class name, that
holds more than half of the text is no boilerplate, notices, adverts and comments
excepted; one that is never closed ends where an article begins. Elements end where HTML
says so when their end tags are left out. Weights are summed over windows of consecutive lines.
A surge is where the sums rise from nothing, a dive where they fall to nothing
again; a stretch between them is text if a window of it reaches the bar. Lighter
stretches are text between two others and where they share a container with one;
the bar is lower on pages that are light as a whole. Lines without weight within a
stretch of text are text, unless they are boilerplate elements.

Lines in an article that the page marks weigh ``MARK`` times as much. Other text is
weighed against the heaviest article: it needs more than that to be text as well,
and an article that is ``MARK`` times lighter still is a card beside the text.

White space within a line becomes one space, character references are decoded,
lines are joined by one space. Null or empty html gives empty text; markup that is
cut off or never closed is read as far as it goes. Pages of any length are read
whole. Other columns are not touched; repeated rows give repeated results.
"""

from __future__ import annotations

import html as html_library
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BAR, MARK = 3, 86, 4

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![^\s/])(hidden)(?![^\s/])""")

# Element names and the words of class names, as HTML and common page templates use them.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object select datalist audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form menu dialog button fieldset head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply respond search share sharing sidebar sidebars social sponsor sponsored subscribe topbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply respond".split())
WHOLE_PAGE = frozenset("html body main".split())
#: Words that name a part of a page in class names like share-buttons.
PART_WORDS = frozenset("area bar block box buttons container content group icons inner item items label link links list main module panel post posts section slot title tools unit wrap wrapper".split())
#: Class names of what is never the text, however much of the page it is.
NEVER_TEXT = frozenset("ad ads adv advert adverts advertisement advertising consent cookie cookies gdpr notice notices promo promoted promotion sponsor sponsored".split())
HEAD_CONTENT = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
# Elements whose end tags HTML lets out, and what begins where they end.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
KEEPS_PARAGRAPHS = frozenset("article aside blockquote body button caption div fieldset figure footer form header html main nav section table td th".split())
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody thead tfoot".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody thead tfoot".split()), frozenset(["table"])),
    "thead": (frozenset("tbody tfoot".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
}
ENDS_BY_ITSELF = frozenset([*IMPLIED_ENDS, "p", "head"])
SECTIONS = frozenset("article main body html".split())
HREF = re.compile(r"(?<![^\s/])href\s*=", re.I)
#: How many of the elements around a line tell that two lines belong together.
NEAR = 3
# Words of class names that tell a frame around others, and an article's own heading.
FRAME_WORDS = frozenset("layout with has".split())
OWN_HEADER_WORDS = frozenset("article entry post story".split())


class Region:
    """An element that may be boilerplate.

    ``hard`` ones are; the others, told by class names or being forms, are not
    where most of the text is in them. ``article_at``: the first line of an article in it.
    """

    def __init__(self, hard: bool, free: bool, comments: bool) -> None:
        self.hard, self.free, self.comments = hard, free, comments
        self.closed, self.article_at = False, None


def _told(value: str, in_article: bool, tag: str) -> frozenset[str]:
    """The boilerplate words in a class name; in an article, names count as a whole."""
    if not in_article:
        return ASIDE_WORDS.intersection(re.split(r"[^a-z0-9]+", value))
    out: set[str] = set()
    for name in value.split():
        words = set(re.split(r"[^a-z0-9]+", name))
        if words <= ASIDE_WORDS | PART_WORDS or words & COMMENT_WORDS:
            out |= words & ASIDE_WORDS
    return frozenset(out)


def _region(tag: str, attrs: str, in_article: bool) -> Region | None:
    """What an opening tag says of its element."""
    if tag in ("form", "fieldset"):
        return Region(False, True, False)
    if tag in ASIDE or tag == "header" and not in_article:
        return Region(True, False, False)
    if not attrs or tag in WHOLE_PAGE:
        return None
    out = None
    for m in ATTRIBUTE.finditer(attrs):
        if m[5]:
            return Region(True, False, False)
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "class" or name == "id" and not in_article:
            words = set(re.split(r"[^a-z0-9]+", value))
            told = _told(value, in_article, tag)
            if tag == "article":
                told = told & COMMENT_WORDS
            if words & OWN_HEADER_WORDS:
                told = told - {"header"}
            if told and not words & FRAME_WORDS:
                out = Region(False, not told & (NEVER_TEXT | COMMENT_WORDS), bool(told & COMMENT_WORDS))
        elif name == "role" and value in ASIDE_ROLES:
            if value != "form":
                return Region(True, False, False)
            out = out or Region(False, True, False)
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return Region(True, False, False)
    return out


class Line:
    """A line's pieces of text, each with the regions around it and whether it is a link's."""

    __slots__ = ("article", "item", "near", "pieces")

    def __init__(self, pieces: list[tuple[str, tuple[int, ...], bool]], article: int, near: tuple[int, ...], item: bool) -> None:
        self.pieces, self.article, self.near, self.item = pieces, article, near, item


def _parsed(page: str) -> tuple[list[Line], list[Region]]:
    """The page's lines in order and its regions. Elements end where HTML says that they do, with or without an end tag."""
    out: list[Line] = []
    regions: list[Region] = []
    pieces: list[tuple[str, tuple[int, ...], bool]] = []
    stack: list[tuple[str, int, int]] = []  # (tag, number of the element, its region or -1)
    opened: Counter[str] = Counter()
    inside: tuple[int, ...] = ()
    link_depth, article, articles, elements = -1, 0, 0, 0

    def close_line() -> None:
        if any(not x.isspace() for x, _, _ in pieces):
            near = tuple(n for t, n, _ in stack if t not in INLINE)[-NEAR:]
            out.append(Line(pieces.copy(), articles if article else 0, near, opened["li"] > 0))
        pieces.clear()

    def pop(closed: bool) -> None:
        nonlocal inside, article, link_depth
        tag, _, region = stack.pop()
        opened[tag] -= 1
        if region >= 0:
            inside = inside[:-1]
            regions[region].closed = closed or tag in ENDS_BY_ITSELF
        if tag in ("article", "main"):
            article -= 1
        if len(stack) < link_depth:
            link_depth = -1

    def end(tag: str, within: frozenset[str] = frozenset(), closed: bool = False) -> None:
        """Close the nearest ``tag`` and what is open in it, unless an element ``within`` lies between."""
        if not opened[tag]:
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                while len(stack) > k:
                    pop(closed and len(stack) == k + 1)
                return
            if stack[k][0] in within:
                return

    def begin(tag: str, attrs: str) -> None:
        nonlocal inside, article, articles, elements
        region = _region(tag, attrs, article > 0)
        if tag in INLINE and region is None:
            return
        if tag in ("article", "main"):
            for r in inside:
                if regions[r].article_at is None:
                    regions[r].article_at = len(out)
            articles += article == 0 and region is None
            article += 1
        if region is not None:
            inside = (*inside, len(regions))
            regions.append(region)
        elements += 1
        opened[tag] += 1
        stack.append((tag, elements, -1 if region is None else len(regions) - 1))

    def implied_ends(tag: str) -> None:
        if opened["head"] and tag not in HEAD_CONTENT:
            end("head")
        if tag in ENDS_PARAGRAPH:
            end("p", KEEPS_PARAGRAPHS)
            if tag != "li" and opened["li"] and not any(opened[x] for x in ("ul", "ol", "menu")):
                end("li")
        for element, (starts, within) in IMPLIED_ENDS.items():
            if tag in starts:
                end(element, within)

    def take(piece: str) -> None:
        if opened["head"] and not piece.isspace():
            end("head")
        pieces.append((piece, inside, link_depth >= 0))

    at, stop = 0, len(page)
    while at < stop:
        m = TOKEN.search(page, at)
        if not m:
            take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m["close"]), m["attrs"]
        if tag in RAW and not closing:
            if attrs.rstrip().endswith("/"):
                continue
            over = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = over.end() if over else stop if tag in ("script", "style", "title", "textarea") else at
            if tag not in ("title", "textarea", "script", "style"):
                close_line()
            continue
        if tag not in INLINE:
            close_line()
        if closing:
            if tag == "a":
                link_depth = -1
            end(tag, frozenset() if tag in SECTIONS else SECTIONS, closed=True)
            continue
        implied_ends(tag)
        if tag == "a":
            link_depth = len(stack) if HREF.search(attrs) else -1
        if tag in VOID or attrs.endswith("/") or tag in WHOLE_PAGE - {"main"}:
            continue
        begin(tag, attrs)
    close_line()
    while stack:
        pop(False)
    return out, regions


def _boilerplate(found: list[Line], regions: list[Region]) -> list[int]:
    """From which line on a region is text again: 0 where it is none, beyond the last line where it is boilerplate to its end."""
    last = len(found) + 1
    # one that was never closed ends where an article begins
    until = [r.article_at if r.article_at is not None and not r.closed and not r.comments else last for r in regions]
    weight, held = Counter(), Counter()
    for i, line in enumerate(found):
        for text, inside, linked in line.pieces:
            if linked or any((regions[r].hard or not regions[r].free) and i < until[r] for r in inside):
                continue
            n = len(text.strip())
            weight[line.article > 0] += n
            for r in inside:
                held[r, line.article > 0] += n
    marked = weight[True] > 0
    return [0 if r.free and not r.hard and 2 * held[k, marked] > weight[marked] else until[k] for k, r in enumerate(regions)]


def lines(page: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(text, characters in links, number of the article or 0, nearest containers) of each line that has text; boilerplate elements' texts are empty."""
    found, regions = _parsed(page)
    until = _boilerplate(found, regions)
    out = []
    for i, line in enumerate(found):
        own = [(text, linked) for text, inside, linked in line.pieces if all(i >= until[r] for r in inside)]
        text = " ".join(html_library.unescape("".join(x for x, _ in own)).split())
        # a paragraph of an article may be a link as a whole; items of lists that are links are menus
        linked = sum(len(x.strip()) for x, link in own if link) if line.item or not line.article else 0
        out.append((text, linked, line.article, line.near if text else ()))
    return out


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first line with weight, line after the last, heaviest window) of each stretch in which no window sum is nothing."""
    out: list[tuple[int, int, int]] = []
    for i, weight in enumerate(weights):
        if not weight:
            continue
        total = sum(weights[i : i + window])
        if out and i - out[-1][1] < window:
            out[-1] = (out[-1][0], i + 1, max(out[-1][2], total))
        else:
            out.append((i, i + 1, total))
    return out


def main_text(page: str | None) -> str:
    found = lines(page or "")
    weights = [0 if 2 * linked > len(text) else len(text) - linked for text, linked, _, _ in found]
    if not any(weights):
        weights = [len(text) for text, _, _, _ in found]
    groups: dict[int, list[int]] = {}
    for i, line in enumerate(found):
        groups.setdefault(line[2], []).append(i)
    # (lines, heaviest window, weight of all) of the stretches of each article, and outside
    runs = {k: [(at[a:b], peak * (MARK if k else 1), sum(weights[i] for i in at[a:b])) for a, b, peak in stretches([weights[i] for i in at])] for k, at in groups.items()}
    inside = {k: sum(x[2] for x in v) for k, v in runs.items() if k}
    outside = max((x[2] for x in runs.get(0, [])), default=0)
    if outside > MARK * max(inside.values(), default=0):
        chosen = [x for k, v in runs.items() if not k or MARK * MARK * inside[k] >= outside for x in v]
    else:
        chosen = [x for k, v in runs.items() if k for x in v]
    chosen.sort(key=lambda x: x[0][0])
    bar = min(BAR, max((x[1] for x in chosen), default=0) / 2)
    heavy = [i for i, x in enumerate(chosen) if x[1] >= bar]
    near = {n for i in heavy for j in chosen[i][0] for n in found[j][3]}
    kept = [x[0] for i, x in enumerate(chosen) if x[1] >= bar or heavy[0] < i < heavy[-1] or any(n in near for j in x[0] for n in found[j][3])]
    return " ".join(found[j][0] for j in sorted(j for x in kept for j in x) if found[j][0])


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*(F.col(c) for c in keep), F.col(html_col).alias("__html")).mapInArrow(run, f"{fields}, text string, n_chars long")
