"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block of text. Link text weighs nothing, and blocks in elements whose class, id or
role only hints at boilerplate weigh less. The weights are summed over sliding windows of lines; where the sum surges a
stretch of text begins, where it dives the stretch ends, and the text between is kept. The container of the heaviest
stretch only adds to that: a short last paragraph in it belongs to the article, and a light block far from it doesn't.
Elements that are boilerplate by their tag leave gaps, and so do those that are by their whole name, unless they carry
the page: layouts call the wrapper of an article "content-sidebar-wrap" or "comment-content".
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and the window's weight (code points) at which a stretch may begin.
WINDOW = 3
SURGE = 80
#: What a code point weighs in an element that only hints at boilerplate.
HINTED = 0.25
#: Weight of stretches in one container from which they stay wherever they are.
ALONE = 3 * SURGE

# Element names of HTML by their role here.
RAW = "script|style|noscript|template|svg|iframe|textarea|select|annotation|annotation-xml|object|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu".split())
CONTAINERS = frozenset("html body div section article main center td form header aside blockquote".split())
NEVER_TEXT = frozenset("nav footer aside dialog menu head button fieldset input label".split())
PLAIN = frozenset("html body main".split())
# Words that name boilerplate. The second list may also name the place of an article, if nothing else is there.
_GONE = (
    "ads?|adv|advert\\w*|adbox|adslot|sponsor\\w*|side-?bar\\w*|menu\\w*|nav|navbar\\w*|navigation|breadcrumbs?|footer\\w*|comments?|commentlist|repl(?:y|ies)|respond|disqus\\w*"
    "|cookies?|consent|gdpr|newsletter\\w*|signup|login|pagination|pager|toolbar|skiplink|copyright|disclaimer"
)
_MAYBE = "promo\\w*|banner\\w*|masthead|notices?|notification\\w*|alerts?|popup\\w*|modal\\w*|overlay|subscri\\w*|share|sharing|social|related|recommend\\w*|widgets?|hidden|search\\w*"
# Words that stand beside such a word in a name without giving it another sense.
_BESIDE = frozenset(
    "area bar bars block body bottom box button buttons center col column container content elem element form global group head icon icons inner item items left link links list main module"
    " no outer page panel part post posts primary right row secondary section site slot small sticky stories sub tab text thread title top unit up wrap wrapper view log sign skip in".split()
)
_IS_GONE, _IS_MAYBE = re.compile(f"(?:{_GONE})\\Z"), re.compile(f"(?:{_MAYBE})\\Z")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comment|reply)(?![a-z])", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"']+)""")
#: A quote opens a value only after an equals sign, and one that nothing closes is an ordinary character.
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>"'=]|=\s*(?:"[^"]*"|'[^']*')?|["'])*+)>|<[!?/][^>]*>""", re.S | re.I
)

#: A word that names readers' remarks: an article in such an element is a remark, unless it has the page's heading.
_REMARKS = re.compile(r"comment|repl(?:y|ies)|respond|disqus", re.I)
#: What an element is: text, text of less weight, boilerplate unless it carries the page (a place, or a name for boilerplate), boilerplate.
TEXT, HINT, MAYBE, NAMED, REMARKS, GONE = range(6)


@dataclass
class Line:
    text: str
    weight: float
    container: int
    heading: bool
    menu_item: bool
    mark: int  # the innermost element around it that may be boilerplate
    in_article: bool = False
    in_main: bool = False
    title: bool = False


@dataclass
class Page:
    """lines; an empty line stands in each gap. Containers and marks by number: kinds, and parents with smaller numbers. Mark 0 is the page."""

    lines: list[Line] = field(default_factory=list)
    kinds: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [TEXT])
    above: list[int] = field(default_factory=lambda: [0])


def name_kind(names: str) -> int:
    """What the words of an element's class, id and role make of it.

    A word that names boilerplate does so if nothing but words of place stand beside it in its name: "comment-list" is
    gone, "comments-on-law" a hint.
    """
    kind = TEXT
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or parts[0] in ("has", "with", "no", "without") and len(parts) > 1:
            continue
        joined = "".join(parts)
        gone = [x for x in parts if _IS_GONE.match(x)] or ([joined] if _IS_GONE.match(joined) else [])
        maybe = [x for x in parts if _IS_MAYBE.match(x)]
        if gone or maybe:
            whole = gone == [joined] or all(x in gone or x in maybe or x in _BESIDE or x.isdigit() for x in parts)
            kind = max(kind, ((REMARKS if _REMARKS.search(joined) else NAMED) if gone else MAYBE) if whole else HINT)
    return kind


def element_kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in PLAIN:
        return TEXT
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if attributes else ""
    if tag == "article":
        return GONE if _COMMENT.search(names) else TEXT
    if attributes and (_UNSEEN.search(attributes) or "hidden" in _VALUE.sub("", attributes).lower().split()):
        return GONE
    if tag in NEVER_TEXT:
        return GONE
    if tag == "header" or tag == "form":
        return max(name_kind(names), TEXT if tag == "header" and in_article else MAYBE)
    kind = name_kind(names)
    if kind < MAYBE and not in_article and any("header" in _PARTS.findall(n.lower()) for n in names.split()):
        return MAYBE
    return kind


def page_lines(source: str) -> Page:
    """The page's lines. Every step of the way up is kept as an index, so the depth of the page costs nothing."""
    page = Page()
    # of each open element: tag, container, kind, nearest open block and list item or list, number in articles
    stack: list[tuple[str, int, int, int, int, int]] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = 0
    marked: list[int] = [0]  # open elements that may be boilerplate
    state = {"gone": 0, "hints": 0}

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html_lib.unescape("".join(text)).split())
        if joined:
            weight = max(0, len(joined) - linked)
            tag, container, *_ = stack[-1] if stack else ("", 0)
            block = stack[stack[-1][3]][0] if stack and stack[-1][3] >= 0 else ""
            item = weight * 10 < len(joined) and opened["li"] > 0
            weight *= HINTED if state["hints"] else 1
            page.lines.append(Line(joined, weight, container, block in HEADINGS, item, marked[-1], opened["article"] + opened["main"] > 0, opened["main"] > 0, block == "h1"))
        text.clear()
        linked = 0

    def pop_to(index: int) -> None:
        while len(stack) > index:
            tag, _, kind, *_ = stack.pop()
            opened[tag] -= 1
            state["hints"] -= kind == HINT
            if MAYBE <= kind < GONE:
                marked.pop()
            if kind == GONE:
                state["gone"] -= 1
            if kind >= MAYBE and not state["gone"]:
                page.lines.append(Line("", 0, 0, False, False, marked[-1]))

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not state["gone"]:
            text.append(piece)
            if opened["a"]:
                linked += len(" ".join(html_lib.unescape(piece).split()))

    at, last = 0, source.rfind(">") + 1
    for m in _TOKEN.finditer(source, 0, last):  # what no ">" follows is text
        take(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in ("br", "wbr"):
            take(" " if tag == "br" else "")
            continue
        if tag in BLOCKS and not state["gone"]:
            flush()
        if m[2]:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and tag not in ("li", "dd"):  # a block ends an open paragraph
            k = stack[-1][3] if stack else -1
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        if tag == "li":
            k = stack[-1][4] if stack else -1
            if k >= 0 and stack[k][0] == "li":
                pop_to(k)
        _, above, _, block, item, articles = stack[-1] if stack else ("", 0, TEXT, -1, -1, 0)
        kind = TEXT if state["gone"] else element_kind(tag, m[4] or "", articles > 0)
        if tag in CONTAINERS:
            page.kinds.append(tag)
            page.parents.append(above)
            above = len(page.kinds) - 1
        here = len(stack)
        stack.append((tag, above, kind, here if tag in BLOCKS else block, here if tag == "li" or tag in LISTS else item, articles + (tag in ("article", "main"))))
        opened[tag] += 1
        state["hints"] += kind == HINT
        state["gone"] += kind == GONE
        if MAYBE <= kind < GONE:
            page.marks.append(kind)
            page.above.append(marked[-1])
            marked.append(len(page.marks) - 1)
    take(source[at:])
    flush()
    return page


def kept_lines(page: Page) -> list[Line]:
    """Lines outside elements that may be boilerplate, and in those that carry the page.

    What has a name for boilerplate carries the page if an article is in it and none outside, if the page's heading and
    most of the text are in it, or if it has a long text and hardly any is outside. Of elements that are only places for boilerplate,
    one stays if more text is in it than outside of all, as in a page wrapped whole in a form.
    """
    size = len(page.marks)
    own = [0.0] * size
    article, titles, main = [0.0] * size, [0] * size, [0.0] * size
    for x in page.lines:
        own[x.mark] += x.weight
        article[x.mark] += x.weight * x.in_article
        main[x.mark] += x.weight * x.in_main
        titles[x.mark] += x.title
    total, articles, mains, headings = own[:], article[:], main[:], titles[:]
    for k in range(size - 1, 0, -1):  # marks around have smaller numbers
        for sums in (total, articles, mains, headings):
            sums[page.above[k]] += sums[k]
    stays = [True] + [False] * (size - 1)
    around, around_article, around_titles = own[:], article[:], titles[:]  # in the mark and in those around it, where they stay
    for k in range(1, size):
        up = page.above[k]
        around[k] += around[up]
        around_article[k] += around_article[up]
        around_titles[k] += around_titles[up]
        if not stays[up] or page.marks[k] < NAMED:
            continue
        outside = around[up]
        holds = mains[k] if page.marks[k] == REMARKS and not headings[k] else articles[k]
        titled = headings[k] and not around_titles[up] and total[k] > outside
        stays[k] = total[k] > 0 and ((holds > 0 and not around_article[up]) or titled)
    outside = sum(w for w, s in zip(own, stays) if s)
    heavy = max((k for k in range(1, size) if page.marks[k] >= NAMED and stays[page.above[k]] and not stays[k]), key=total.__getitem__, default=0)
    if heavy and total[heavy] > max(2 * ALONE, 10 * outside):  # nearly the whole page
        stays[heavy] = True
        outside += own[heavy]
    best = max((k for k in range(1, size) if page.marks[k] == MAYBE and stays[page.above[k]]), key=own.__getitem__, default=0)
    if best and own[best] > max(outside, SURGE):
        return [x for x in page.lines if stays[x.mark] and (x.weight or not x.text) or x.mark == best]
    return [x for x in page.lines if stays[x.mark]]


def stretches(weights: list[float]) -> list[tuple[int, int]]:
    """[begin, end) of the runs of lines between a surge and a dive of the windowed weights."""
    n = len(weights)
    blocks = [sum(weights[i : i + WINDOW]) for i in range(n)]
    level = min(SURGE, max(blocks, default=0) / 2)
    found, begin = [], None
    for i, b in enumerate(blocks):
        if begin is None and b > level and weights[i]:
            begin = i
        elif begin is not None and not weights[i] and (b == 0 or b < level / 4):
            found.append((begin, i))
            begin = None
    return found + ([(begin, n)] if begin is not None else [])


def main_text(source: str | None) -> str:
    """The article of one page, blocks joined by blank lines; empty if there is none."""
    if not source:
        return ""
    page = page_lines(source)
    lines = kept_lines(page)
    runs = stretches([x.weight for x in lines])
    if not runs:
        return "\n\n".join(x.text for x in lines if x.text and x.weight and not x.menu_item)
    own = [0.0] * len(page.kinds)
    for a, b in runs:
        for x in lines[a:b]:
            own[x.container] += x.weight
    inside = own[:]
    for k in range(len(inside) - 1, 0, -1):  # parents have smaller numbers
        inside[page.parents[k]] += inside[k]
    top = max(range(len(own)), key=own.__getitem__)  # of equals the first of the page
    while top and page.kinds[top] not in ("article", "main") and inside[page.parents[top]] * 0.62 > inside[top]:
        top = page.parents[top]  # most of the text around is in sister containers
    k = top
    while k and page.kinds[k] != "article":
        k = page.parents[k]
    top = k or top  # an article around the container is the whole of it
    within = [k == top for k in range(len(own))]
    for k in range(1, len(own)):
        within[k] = within[k] or within[page.parents[k]]
    article = page.kinds[top] in ("article", "main")
    in_run = [False] * len(lines)
    for a, b in runs:
        in_run[a:b] = [True] * (b - a)
    menus = set() if article else _menus(lines)
    return "\n\n".join(
        x.text for i, x in enumerate(lines)
        if x.text and i not in menus and (within[x.container] or not article and in_run[i] and (x.heading or own[x.container] >= ALONE))
    )


def _menus(lines: list[Line]) -> set[int]:
    """Items that are links, three or more in a row."""
    found: set[int] = set()
    row: list[int] = []
    for i, x in enumerate(lines):
        if x.menu_item:
            row.append(i)
        else:
            found |= set(row) if len(row) > 2 else set()
            row = []
    return found | (set(row) if len(row) > 2 else set())


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages plus text (main text, empty if none; a null page: empty) and n_chars, its code points.

    Columns of those names are replaced. Character references are decoded, white space inside a block becomes one
    space, blocks are trimmed and joined by two line feeds. Of containers with equal weight the first of the page
    counts. Rows are independent: repeated rows and an empty table need no care. Spark cuts Arrow batches at
    spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default), which bounds what a task holds.
    """

    @F.pandas_udf("string")
    def extracted(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    out = pages.withColumn("text", extracted(F.coalesce(F.col(html_col).cast("string"), F.lit(""))))
    return out.withColumn("n_chars", F.length("text").cast("long"))
