"""HTML extraction by tag-path ratios.

A small scanner walks the markup of a page once and yields its text leaves, each with the element
that holds it and its block.  Per root-to-leaf tag path it adds up text length and punctuation.
The two are smoothed (each path takes a share of its parent path's mean), fused into one score
(length times punctuation, against the number of parts) and cut at a threshold: leaves of the
paths above it are content.  What stands with them stays too: the rest of their blocks, headings
of a ``div``, ``section``, ``article``, ``main`` or ``body`` that holds content, and short text
beside content in the same one of these, unless its block is made of links.  A part of the page
without content of its own (a menu, a list of links, a line about rights) has no such leaf.

Never content: scripts, styles, controls and hidden elements, and anything outside ``body``.  Set
aside: elements whose tag says menu, footer, sidebar or form, a ``header`` outside an article, and
prose that is not the article's, which no ratio can tell from it: elements whose class, id or role
names comments, adverts, notices and the like.  Words that articles use as well (related, note,
side) count as such names only by themselves or with a word like box, bar, list or posts, and a
name with a word like has, no or with says what is around or missing and counts for nothing.
What was set aside by its tag alone is judged by what it leaves: if no sentence is left and a form,
sidebar or dialog holds most of the page's text, it is a wrapper (a form around the page, say) and is
opened, and so on with those within it, until there is prose.

Text: character references decoded, white space within a block made one space, blocks trimmed,
empty ones left out, joined in page order by one \\n.  Defined cases: null and empty html give
an empty text; markup without any text gives an empty text; text without markup is the text;
unclosed and stray tags are closed as HTML does; pages that are repeated or share an id each get
a row; null ids and urls stay null; other columns play no part; an empty table gives an empty
result.  Time and memory grow with the length of a page, whatever its depth.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|([^<]+|<)", re.S)
_OPENED = re.compile(r"/?[a-zA-Z!?][^>]*\Z")
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is text up to their own end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_NEVER = frozenset("script style head title noscript template button select option textarea input label iframe object embed svg math canvas audio video noembed noframes".split())
_ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Those that may be wrapped around a whole page.
_WRAPS = frozenset("form aside dialog".split())
#: Elements that a start tag of the given kind closes if open (without leaving the element's container).
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
_ENDS_P = _BLOCK - {"body", "html", "title", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that make a part of the page, and headings.
_PARTS = frozenset("div section article main body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header".split())
_BOUNDARY = frozenset("table td th ul ol dl div section article body html caption button object".split())
#: Names of what is not the article, in any part of a class, id or role; and those that say so only alone or with a word of ``_WITH``.
_NAMED = frozenset("ad ads advert adverts advertisement sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar comment comments disqus cookie cookies consent popup modal newsletter subscribe signup share sharing pagination pager login search form toolbar contentinfo complementary hidden".split())
_ALONE = frozenset("header foot side aside banner promo promos promotion notice notices note alert social related recommended widget respond replies reply skip".split())
_WITH = frozenset("area articles bar block box buttons col column content inner items left link links list message news outer panel posts region right section site stories top widget wrap wrapper".split())
_AROUND = frozenset("has have with without no not hide show".split())
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=\D)(?=\d)")
_PUNCT = re.compile(r"[.,;:!?…。、,¿¡]")
_SPACES = re.compile(r"\s+")
#: A block with so many letters and a mark that ends a sentence is prose.
PROSE = 40
_SENTENCE = re.compile(r"[.!?…。！？]")


def _names_boilerplate(value: str) -> bool:
    for name in value.split():
        parts = {x.lower() for x in _PART.split(name) if x and not x.isdigit()}
        if parts & _AROUND:
            continue
        if parts & _NAMED or parts & _ALONE and not parts - _ALONE - _WITH:
            return True
    return False


def _never(tag: str, attrs: str) -> bool:
    if tag in _NEVER:
        return True
    for name, value in _MARK.findall(attrs) if attrs and tag not in ("html", "body", "article", "main") else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _named(tag: str, attrs: str) -> bool:
    """Whether class, id or role name what is not the article."""
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    return any(name.lower() in ("class", "id", "role") and _names_boilerplate(value.strip("\"'")) for name, value in _MARK.findall(attrs))


class Element(NamedTuple):
    """An open element; places are those in the list of elements, whose first is the page itself."""

    tag: str
    #: Number of its tag path; place of the part of the page around it (itself, if it is one), and of the part around that.
    path: int
    part: int
    within: int
    hidden: bool
    #: Place of the element set aside that is nearest around it (itself, if it is one), or -1.
    aside: int
    #: Place of the one that is nearest around its parent, or -1.
    outer: int
    #: Set aside by its tag alone, which may stand around a whole page.
    wraps: bool
    in_body: bool
    in_article: bool
    in_link: bool
    heading: bool


class Leaf(NamedTuple):
    element: int
    block: int
    text: str


def leaves(page: str) -> tuple[list[Element], list[int], list[Leaf]]:
    """The elements of a page, the parent of each tag path, and its text leaves that may be content."""
    elements = [Element("", 0, 0, 0, False, -1, -1, False, False, False, False, False)]
    paths: dict[tuple[int, str], int] = {}
    above = [0]
    stack = [0]  # places of the open elements
    depth: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag
    walls = [-1]  # depths of the open elements that others do not reach across
    found: list[Leaf] = []
    block = at = 0
    end = len(page)

    def close(to: int) -> None:
        while len(stack) > to:
            tag = elements[stack.pop()].tag
            depth[tag].pop()
            if walls[-1] == len(stack):
                walls.pop()

    def say(text: str) -> None:
        if text and not elements[stack[-1]].hidden:
            found.append(Leaf(stack[-1], block, text))

    while at < end:
        match = _TOKEN.match(page, at)
        if match is None:  # an unclosed tag at the end
            break
        at = match.end()
        closing, tag, attrs, text = match.groups()
        if text is not None:
            if text == "<" and _OPENED.match(page, at):  # the end of the page cuts a tag short
                break
            say(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if depth[tag] and (tag in _BOUNDARY or depth[tag][-1] > walls[-1]):
                close(depth[tag][-1])
            if tag in _BLOCK:
                block += 1
            continue
        if tag == "br":
            say(" ")
            continue
        shuts = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        last = max((depth[t][-1] for t in shuts if depth[t]), default=-1)
        if last >= max(0, walls[-1]):
            close(last)
        if tag in _BLOCK:
            block += 1
        if tag in _VOID:
            continue
        up = elements[stack[-1]]
        hidden = up.hidden or _never(tag, attrs or "")
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not hidden:
                say(page[at : stop.start() if stop else end])
            at = stop.end() if stop else end
            if tag in _BLOCK:
                block += 1
            continue
        path = paths.setdefault((up.path, tag), len(above))
        if path == len(above):
            above.append(up.path)
        place, own = len(elements), tag in _PARTS or tag == "td" and not up.in_article
        is_article = tag in ("article", "main")
        called = not hidden and _named(tag, attrs or "")
        aside = place if not hidden and (called or tag in _ASIDE or tag == "header" and not up.in_article) else up.aside
        elements.append(Element(tag, path, place if own else up.part, up.part, hidden, aside, up.aside, tag in _WRAPS and not called, up.in_body or tag == "body", up.in_article or is_article, up.in_link or tag == "a", up.heading or tag in _HEADINGS))
        depth[tag].append(len(stack))
        if tag in _BOUNDARY:
            walls.append(len(stack))
        stack.append(place)
    return elements, above, found


def path_scores(elements: list[Element], above: list[int], found: list[Leaf]) -> dict[int, float]:
    """Score of each tag path: text length and punctuation, smoothed along the path, fused."""
    size, marks, parts = defaultdict(int), defaultdict(int), defaultdict(int)
    for leaf in found:
        path = elements[leaf.element].path
        size[path] += len(leaf.text.strip())
        marks[path] += len(_PUNCT.findall(leaf.text))
        parts[path] += 1
    total, kinds = defaultdict(int), defaultdict(int)
    for path, n in size.items():
        total[above[path]] += n
        kinds[above[path]] += 1
    return {path: (0.75 * n + 0.25 * total[above[path]] / kinds[above[path]]) * (1 + marks[path]) / parts[path] ** 0.5 for path, n in size.items()}


def opened(elements: list[Element], found: list[Leaf]) -> set[int]:
    """The elements set aside that are opened: wrappers of the page's text, where no prose is left without them."""
    size: dict[int, int] = defaultdict(int)  # letters outside links, by the nearest element set aside
    prose: set[int] = set()
    said: set[int] = set()
    block, letters, ends, total = (-1, -1), 0, False, 0
    for leaf in found:
        element = elements[leaf.element]
        if element.in_link:
            continue
        if (leaf.block, element.aside) != block:
            block, letters, ends = (leaf.block, element.aside), 0, False
        text = leaf.text.strip()
        letters += len(text)
        total += len(text)
        ends = ends or bool(_SENTENCE.search(text))
        if ends:
            said.add(element.aside)
        size[element.aside] += len(text)
        if ends and letters >= PROSE:
            prose.add(element.aside)
    if not prose or -1 in said:
        return set()
    around: dict[int, int] = {}  # of an element set aside, the next one around it
    below: dict[int, list[int]] = defaultdict(list)
    for place in range(1, len(elements)):  # an element comes after those around it
        if elements[place].aside == place:
            around[place] = elements[place].outer
            below[around[place]].append(place)
    for place in sorted(around, reverse=True):
        size[around[place]] += size[place]
    free, at = set(), -1
    while below[at]:
        at = max(below[at], key=lambda place: size[place])
        if not elements[at].wraps or 2 * size[at] < total:
            return set()
        free.add(at)
        if at in prose:
            return free
    return set()


def main_text(page: str | None, threshold: float = 0.1) -> str:
    """The main text of one page; ``threshold`` is the share of the best path's score that a content path needs."""
    elements, above, found = leaves(page or "")
    if any(elements[x.element].in_body for x in found):
        found = [x for x in found if elements[x.element].in_body]
    free = opened(elements, found) | {-1}
    found = [x for x in found if elements[x.element].aside in free]
    scores = path_scores(elements, above, found)
    best = max(scores.values(), default=0.0)
    if best <= 0:
        return ""
    chosen = [bool(x.text.strip()) and scores[elements[x.element].path] >= threshold * best for x in found]
    blocks = {x.block for x, yes in zip(found, chosen) if yes}
    plain = {x.block for x in found if x.text.strip() and not elements[x.element].in_link}  # blocks that are not links alone
    direct = {elements[x.element].part for x, yes in zip(found, chosen) if yes}
    holds = [False] * len(elements)
    for place in direct:
        holds[place] = True
    for place in range(len(elements) - 1, 0, -1):
        if elements[place].part == place and holds[place]:
            holds[elements[place].within] = True
    lines: list[str] = []
    current, parts = None, []
    for leaf, yes in zip(found, chosen):
        element = elements[leaf.element]
        part = element.part
        beside = part in direct or elements[part].tag in ("article", "main") and holds[part]
        if not (yes or leaf.block in blocks or element.heading and holds[part] or beside and leaf.block in plain):
            continue
        if leaf.block != current:
            lines.append("".join(parts))
            current, parts = leaf.block, []
        parts.append(leaf.text)
    lines.append("".join(parts))
    cleaned = (_SPACES.sub(" ", _html.unescape(x)).strip() for x in lines)
    return "\n".join(x for x in cleaned if x)


def _extract(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
