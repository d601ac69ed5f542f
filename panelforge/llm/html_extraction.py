"""Main text of web pages by two passes of block rules.

The markup is cut into blocks.  The first pass labels each block by itself: boilerplate elements, link density,
length and stop-word density make it good, bad or leave it open.  The second pass lets open blocks inherit the
label of the nearest decided neighbours.  Where a page marks its article, and that holds most of what the passes find
good on the whole page, blocks outside are bad, and open blocks inherit only from blocks of the same article, where good
is the default; articles that hold less are cards among others.

Defined cases
- null or empty html, or no good block: empty text, 0 characters;
- cut-off markup: an unfinished tag, comment, script or style ends with the page; unclosed elements end with it too;
- a head needs no end tag: what can stand in it has no text of its own, and its title is not read;
- scripts, styles and titles are plain text to their end tags; svg drawings end where they are closed, at once if they
  are closed in their start tag, or where an element starts that can't be part of them; formulas are text;
- a name that speaks of boilerplate does not hide an article: parts named for search or sharing, and forms, that
  an article or main part is in or is itself do not count; other names, as of sidebars, don't if the page marks no
  other article; those of comments only if there would be no text.  A page without any text is read again, past such
  names of layout; then the longest run of blocks that are no links is taken if it is over 200 characters (short
  paragraphs, other languages);
- an iframe or title without its end is a tag like others; a page is read in time in proportion to its length;
- omitted end tags: as in HTML, p, li, dt, dd, option, optgroup, tr, td, th, table sections, captions and headings end
  where a sibling or, for p and option, a block starts; every element ends with the one around it; an end tag of
  nothing that is open, or of something outside the table cell it stands in, is ignored;
- a character reference that is none stays as it stands; ``<`` before anything but a name is text;
- repeated rows: each is extracted; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Common words of the four languages.
STOP_WORDS = frozenset(
    """
    a an and are as at be but by for from had has have he her his i if in is it its not of on or she so that the their
    there they this to was we were what when which who will with you
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus
    pour qu que qui sa se ses son sur un une vous
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich
    im in ist man mit nach nicht noch nur oder sich sie sind so um und uns unter vom von vor war wie wir zu zum zur
    al como con cuando de del desde donde el ella en entre era es esta este fue ha han hay la las lo los más me no
    nos o para pero por porque que se ser si sin sobre su sus también un una y ya
    """.split()
)
#: Elements that are never part of an article, and those whose content only stands in for what they show.
FALLBACK = frozenset("noscript template object canvas audio video annotation annotation-xml".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select textarea fieldset label option".split()) | FALLBACK
#: Parts of class and id names, and roles, of elements that are none either, by how much they say: names of layout that
#: wrappers of an article may have, other names of boilerplate, and those of readers' comments.
LAYOUT, PART, COMMENT, HARD = 1, 2, 3, 4
NAMES = [
    (COMMENT, r"comments?|disqus|replies|reviews|discussion"),
    (
        PART,
        r"ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|related|recommended|cookies?|consent|gdpr|popups?|newsletter|notices?|modals?|overlays?|"
        r"sidebars?|side-?bars?|footers?|breadcrumbs?|complementary|contentinfo|alertdialog|menus?|navigation|pagination|pager",
    ),
    (LAYOUT, r"banners?|nav|navbar|site-?header|masthead|topbar|toolbar|share|sharing|social|subscribe|signup|login|search|alerts?|widgets?"),
]
BOILERPLATE_NAME = re.compile("(?:^|[\\s_-])(?<!\\bhas[_-])(?<!\\bwith[_-])(?<!\\bno[_-])(?:" + "|".join(f"({names})" for _, names in NAMES) + ")(?=$|[\\s_-])(?![_-](?:layout|template)\\b)")
BLOCKS = frozenset(
    """
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul
    """.split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Which elements a start tag ends, and which elements keep it from ending those outside of them.
CELLS = frozenset("table td th caption".split())
TABLE = frozenset(["table"])
SECTIONS = frozenset("tbody thead tfoot".split())
LISTED = BLOCKS - frozenset("address div p".split())
#: Starts that end an open paragraph or option.
ENDS_P = BLOCKS - SECTIONS - HEADINGS - frozenset("body caption frameset html legend option select td textarea th title tr".split()) | HEADINGS
STARTS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), LISTED),
    "dt": (frozenset(["dt", "dd"]), LISTED),
    "dd": (frozenset(["dt", "dd"]), LISTED),
    "option": (frozenset(["option"]), CELLS | {"select", "datalist", "optgroup"}),
    "optgroup": (frozenset(["option", "optgroup"]), CELLS | {"select", "datalist"}),
    "button": (frozenset(["button"]), CELLS),
    "tr": (frozenset(["tr", "caption"]), TABLE),
    "td": (frozenset(["td", "th", "caption"]), TABLE),
    "th": (frozenset(["td", "th", "caption"]), TABLE),
} | {name: (SECTIONS | {"tr", "caption"}, TABLE) for name in SECTIONS}
PARAGRAPHS = frozenset(["p"]), CELLS | {"button"}
OPTIONS = frozenset(["option"]), CELLS | {"select", "datalist"}
#: What keeps an end tag from ending an element outside; cells keep most.
ENDS = {"li": CELLS | {"ul", "ol"}, "p": PARAGRAPHS[1], "table": frozenset()} | dict.fromkeys(["tr", "td", "th", "caption", *SECTIONS], TABLE)
ARTICLES = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that are followed while they are open, besides a boilerplate element that is in a line.
OPENED = BLOCKS - VOID - {"html", "body"} | {"button", "datalist", "optgroup"}

#: A quote delimits a value only where the value starts.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
#: Elements of plain text that a missing end leaves open.
RAW = ("title", "iframe")


def _pattern(raw: tuple[str, ...]) -> re.Pattern:
    """Comments; elements of plain text with all they hold, of RAW those in ``raw``; tags; what else is no text."""
    plain = rf"|<(?P<raw>{'|'.join(raw)})(?=[\s/>]){_ATTRIBUTES}>.*?</(?P=raw)(?=[\s/>])[^>]*>" if raw else ""
    return re.compile(
        r"<!--(?:-?>|.*?(?:--!?>|\Z))"
        rf"|<(?:script|style)(?=[\s/>]){_ATTRIBUTES}(?:>.*?(?:</(?:script|style)(?=[\s/>])[^>]*>|\Z)|\Z)"
        rf"{plain}"
        rf"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<with>{_ATTRIBUTES})>"
        r"|<!\[CDATA\[|<[/!?]?[a-zA-Z?!/][^>]*(?:>|\Z)",
        re.S | re.I,
    )


PATTERNS = {raw: _pattern(raw) for raw in ((), RAW[:1], RAW[1:], RAW)}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tags(page: str) -> Iterator[re.Match]:
    """The matches in order.  Behind the last end of an element of RAW no other end is looked for, so a page is read once."""
    last = {name: max((m.start() for m in end.finditer(page)), default=-1) for name, end in RAW_END.items()}
    at = 0
    while tag := PATTERNS[tuple(name for name in RAW if last[name] >= at)].search(page, at):
        yield tag
        at = tag.end()


# Elements that can't be part of a drawing, and parts of one that may hold them.
NOT_DRAWN = BLOCKS - {"title"} | frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())
HOLDS = frozenset("foreignobject desc title".split())
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")

MAX_LINK_DENSITY = 0.33
SHORT = 70
LONG = 200
STOP_LOW = 0.2
STOP_HIGH = 0.28
#: A heading is good if good text follows within so many characters.
HEADING_REACH = 200


class Block:
    __slots__ = ("text", "links", "article", "boilerplate", "heading", "label")

    def __init__(self, text: str, links: int, article: int, boilerplate: bool, heading: bool):
        self.text, self.links, self.article, self.boilerplate, self.heading = text, links, article, boilerplate, heading
        self.label = ""


class Open:
    """The open elements, outermost first, which of them is boilerplate (-1: none), and which is while no article is open."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: Counter[str] = Counter()
        self.bad = self.held = -1
        self.why = 0

    def find(self, names: frozenset[str], stops: frozenset[str]) -> int:
        """The place of the innermost element of ``names``, unless one of ``stops`` is further in; else -1."""
        if any(self.count[name] for name in names):
            for at in range(len(self.names) - 1, -1, -1):
                if self.names[at] in names:
                    return at
                if self.names[at] in stops:
                    break
        return -1

    def cut(self, at: int) -> None:
        """End the element at a place, and all in it."""
        self.count.subtract(self.names[at:])
        del self.names[at:]
        if self.bad >= at:
            self.bad = -1
        if self.held >= at:
            self.held = -1

    def end_all(self, names: frozenset[str], stops: frozenset[str]) -> None:
        while (at := self.find(names, stops)) >= 0:
            self.cut(at)

    def start(self, name: str) -> None:
        """End what the start of an element ends."""
        if name in STARTS:
            self.end_all(*STARTS[name])
        if name in ENDS_P:
            self.end_all(*PARAGRAPHS)
            self.end_all(*OPTIONS)
        if name in HEADINGS and self.names and self.names[-1] in HEADINGS:
            self.cut(len(self.names) - 1)

    def push(self, name: str, why: int) -> None:
        if why:
            self.bad, self.why = len(self.names), why
        self.names.append(name)
        self.count[name] += 1

    def end(self, name: str) -> None:
        at = self.find(HEADINGS if name in HEADINGS else frozenset([name]), ENDS.get(name, CELLS))
        if at < 0:
            return
        if name in OPENED:
            self.cut(at)
            return
        # an element in a line ends alone: blocks in it go on
        del self.names[at]
        self.count[name] -= 1
        if self.bad == at:
            self.bad = -1
        elif self.bad > at:
            self.bad -= 1
        if self.held == at:
            self.held = -1
        elif self.held > at:
            self.held -= 1


def boilerplate(name: str, attributes: str, in_article: bool) -> int:
    """Why an element is boilerplate by its own name or names: ``LAYOUT`` to ``HARD``; 0 if it is not."""
    if name in BOILERPLATE:
        return LAYOUT if name == "form" else HARD
    if name == "header" and not in_article:
        return HARD
    if name in ("html", "body") or not attributes:
        return 0
    named = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)).lower()
    found = {NAMES[m.lastindex - 1][0] for m in BOILERPLATE_NAME.finditer(named)} if named else ()
    return max(found, default=0)


def blocks(page: str, around: int = LAYOUT, anywhere: int = 0) -> list[Block]:
    """The blocks of a page in order; ``article`` numbers the article a block is in, 0 for none.

    Names up to ``around`` do not make boilerplate of an article or what it is in; names up to ``anywhere`` of nothing.
    """
    out: list[Block] = []
    parts: list[str] = []
    links = 0
    in_link = heading = False
    opened = Open()
    article, article_tag, article_depth, articles = 0, "", 0, 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(links, len(text)), article, opened.bad >= 0, heading))
        parts, links = [], 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                links += len(text.strip())

    at = drawn = held = 0
    for tag in tags(page):
        if not drawn:
            add(page[at : tag.start()])
        at = tag.end()
        name = (tag["name"] or "").lower()
        closing = tag["end"] == "/"
        closed = not closing and (tag["with"] or "").endswith("/")
        if drawn:  # in an svg: its own tags, until it ends
            if name == "svg" and not closed:
                drawn += -1 if closing else 1
                held = held if drawn else 0
            elif name in HOLDS and not closed:
                held = max(0, held + (-1 if closing else 1))
            elif name in NOT_DRAWN and not closing and not held:
                drawn = 0
            if drawn or name == "svg" or name not in NOT_DRAWN:
                continue
        elif name == "svg":
            drawn = int(not closing and not closed)
            continue
        elif name in FALLBACK and closed:
            continue
        if opened.names and opened.names[-1] == "textarea" and not (closing and name == "textarea"):
            continue  # plain text
        if name == "a":
            in_link = not closing
        elif name == "br":
            add(" ")
        if name in BLOCKS or (opened.bad >= 0 and (name in OPENED or opened.count[name])):
            flush()
        if closing:
            opened.end(name)
        else:
            opened.start(name)
            why = 0
            if name not in VOID and (opened.bad < 0 or name in ARTICLES):
                why = boilerplate(name, tag["with"] or "", bool(article))
                if why <= anywhere or (name in ARTICLES and why <= around):
                    why = 0
                if opened.bad >= 0:  # an article in boilerplate
                    if not why and not article and opened.why <= around:
                        opened.held, opened.bad = opened.bad, -1
                    else:
                        why = 0
                if why:
                    flush()
            nested = opened.bad >= 0 and opened.names[opened.bad] == name  # in its like
            if (why or name in OPENED or nested) and not (name == "form" and opened.count[name]):  # forms do not nest
                opened.push(name, why)
        if opened.bad < 0 and name in ARTICLES:
            if article_tag == name:
                article_depth += -1 if closing else 1
                if not article_depth:
                    article, article_tag = 0, ""
                    opened.bad, opened.held = opened.held, -1
            elif not article_tag and not closing:
                articles += 1
                article, article_tag, article_depth = articles, name, 1
        if name in HEADINGS:
            heading = not closing
    add(page[at:])
    flush()
    return out


def stop_density(text: str) -> float:
    """Share of stop words among the words of letters."""
    words = LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block, marked: bool) -> str:
    """good, bad, or open ("near": by its words, "short": by its length)."""
    size = len(block.text)
    if block.boilerplate or (marked and not block.article):
        return "bad"
    if block.links > MAX_LINK_DENSITY * size:
        return "bad"
    if size < SHORT:
        return "short"
    density = stop_density(block.text)
    if density >= STOP_HIGH:
        return "good" if size > LONG else "near"
    if density >= STOP_LOW or block.article:
        return "near"
    return "bad"


def second_pass(found: list[Block], marked: bool) -> None:
    """Open blocks take the label of the nearest decided neighbours."""
    first = [b.label for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for i in order:
            if first[i] in ("good", "bad"):
                last = i
            side[i] = last
    for i, block in enumerate(found):
        if first[i] in ("good", "bad"):
            continue
        near = [j for j in (before[i], after[i]) if j is not None and (not marked or (found[j].article == block.article and not found[j].boilerplate))]
        labels = {first[j] for j in near}
        if not labels:
            block.label = "good" if marked else "bad"
        elif len(labels) == 1:
            block.label = labels.pop()
        elif block.heading and after[i] in near:
            between = sum(len(found[k].text) for k in range(i + 1, after[i]))
            block.label = first[after[i]] if between <= HEADING_REACH else "bad"
        elif first[i] == "near" or marked:
            block.label = "good"
        else:
            block.label = first[min(near, key=lambda j: (abs(j - i), first[j] == "bad"))]


def judged(found: list[Block], marked: bool) -> list[Block]:
    """The good blocks by both passes; ``marked``: only an article holds any."""
    for block in found:
        block.label = first_pass(block, marked)
    second_pass(found, marked)
    return [b for b in found if b.label == "good"]


def _size(found: list[Block]) -> int:
    return sum(len(b.text) for b in found)


def _good(page: str, around: int, anywhere: int) -> tuple[str, bool]:
    """The good blocks, joined by an empty line, and whether they are those of a marked article.

    An article, of which a page may have some for cards, is *the* article only if it holds most of what the rules
    find good on the page as if nothing were marked.
    """
    found = blocks(page, around, anywhere)
    marked = any(b.article and not b.boilerplate for b in found)
    good = judged(found, False)
    if marked:
        outside = _size([b for b in good if not b.article])
        inside = judged(found, True)
        marked = _size(inside) >= outside
        good = inside if marked else judged(found, False)
    return "\n\n".join(b.text for b in good), marked


def last_resort(page: str, anywhere: int) -> str:
    """Where the rules find nothing: the longest run of blocks that are neither boilerplate nor links; '' if it is short."""
    runs: list[list[Block]] = [[]]
    for block in blocks(page, COMMENT, anywhere):
        if block.links > MAX_LINK_DENSITY * len(block.text):
            runs.append([])
        elif not block.boilerplate:
            runs[-1].append(block)
    best = max(runs, key=_size)
    return "\n\n".join(b.text for b in best) if _size(best) > LONG else ""


def main_text(page: str | None) -> str:
    """The main text of a page: read once, and again only where names may have hidden it, or no rule finds any."""
    text, marked = _good(page or "", LAYOUT, 0)
    if not marked and page:
        again, marked = _good(page, PART, 0)
        text = again if marked else text
    for around, anywhere in ((COMMENT, 0), (COMMENT, LAYOUT)):
        if text or not page:
            break
        text, _ = _good(page, around, anywhere)
    return text or last_resort(page or "", LAYOUT)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; nothing is shuffled."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
