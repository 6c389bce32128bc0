"""Main text of web pages by line-block distribution (operator 7).

Markup is stripped into lines, one for each block of text. A line weighs as many characters as it has outside links; where
page furniture (menus, adverts, forms, comments ...) was, lines without weight stand. Weights are summed over sliding windows
of lines: where a window's sum reaches the surge threshold a stretch of text begins, where it falls below the dive threshold
it ends, and at either end lines that do not read like text (a row of menu words, a copyright line) are taken off. Both
thresholds follow the page's heaviest window, so no names are needed. An article or main element is the text as a whole.
Without one the heaviest stretch is, with the others in the container that it shares with every stretch of some weight.

Class names and ids are weak evidence: what they call furniture stays if it holds the article or most of the page's text, and
inside an article only a class that is nothing but an advert's, a comment's or a share box's counts.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare

#: Lines of a window; characters of a window that are a surge on any page; share of the page's heaviest window that is one as
#: well; share of the surge threshold below which a window is a dive.
WINDOW, SURGE, SHARE, DIVE = 3, 80, 0.3, 0.25

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>?|<[!?/][^>]*>?""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Element and attribute words of HTML and common page furniture. Fixed values.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea template noscript iframe object svg math select canvas audio video xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = set("nav footer aside form menu dialog head button fieldset".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs"
    " masthead topbar footer sidebar sidebars aside widget widgets newsletter subscribe signup login popup modal overlay comment comments commentlist disqus respond reply replies share sharing social related recommended"
    " recommendations pagination pager toolbar search copyright legal disclaimer skip offscreen hidden".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Elements that a new one of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
HOLDERS = set("div section article main body ul ol table td blockquote dl header".split())
PARTS = set("section ul ol table td blockquote dl header".split())
#: Elements whose lines are text even if they are short.
PROSE = set("p li blockquote pre dd dt h1 h2 h3 h4 h5 h6 figcaption caption".split())
#: Share of the heaviest stretch that another must weigh for the container of both to be sought.
SIDE = 0.2
_WORD = re.compile("[a-z0-9]+")
#: Class names that say what else a page has or lacks, not what the element is.
_MODIFIER = re.compile(r"(?:has|no|with|without)[-_]|.*[-_](?:enabled|disabled)$")
REMARKS = set("comment comments commentlist disqus respond reply replies".split())
#: Classes that are furniture even inside an article, each as the whole class of a container.
INSIDE = REMARKS | set("ad ads advert adverts advertisement adsense adslot sponsored promo newsletter share sharing related".split())
CONTAINERS = set("div section ul ol aside table".split())
_ENDING = re.compile(r"[.!?…:;,»”\"')\]]$")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)", re.I)


@dataclass(slots=True)
class Line:
    text: str
    weight: int
    holder: int  # the innermost open container; 0 outside
    scope: int  # the innermost article, or the outermost element where a main is open; 0 outside
    named: int = 0  # the innermost open element that is furniture by its class or id
    gap: int = 0  # the named element that this empty line stands for
    block: str = ""  # the innermost block element

    def reads(self) -> bool:
        """Whether the line looks like text rather than a menu's or a footer's."""
        if not self.weight or _RIGHTS.match(self.text):
            return False
        return self.block in PROSE or self.weight >= SURGE or (self.weight >= SURGE // 3 and bool(_ENDING.search(self.text)))


@dataclass
class Page:
    """Lines of a page while its markup is read. Containers and named elements know their parents, which have lower numbers."""

    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    parent: dict[int, int] = field(default_factory=dict)  # of containers
    named_in: dict[int, int] = field(default_factory=dict)  # the named element around a named one
    parts_of: set[int] = field(default_factory=set)  # containers that are a part of a text: sections, lists, quotes, tables
    holders: set[int] = field(default_factory=set)  # innermost named elements with an article or main element inside
    remarks: set[int] = field(default_factory=set)  # named elements for comments

    def close(self, holder: int, scope: int, named: int, block: str) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, max(0, len(text) - self.linked), holder, scope, named, block=block))
        self.parts.clear()
        self.linked = 0

    def gap(self, named: int = 0) -> None:
        self.lines += [Line("", 0, 0, 0, 0, named)] * WINDOW

    def settled(self, use_names: bool = True) -> list[Line]:
        """The lines without what is in named furniture.

        A named element is none after all where it holds an article or main element (and is no aside to far more other
        text), or two thirds of the page's unlinked text (unless that is in comments, or an article stands elsewhere).
        """
        inside = dict.fromkeys(self.named_in, 0)
        holds = set(self.holders)
        for line in self.lines:
            if line.named:
                inside[line.named] += line.weight
        for n in sorted(self.named_in, reverse=True):  # inner elements first
            if up := self.named_in[n]:
                inside[up] += inside[n]
                if n in holds:
                    holds.add(up)
        total, clear = sum(line.weight for line in self.lines), sum(line.weight for line in self.lines if not line.named)
        elsewhere = any(line.weight and line.scope and not line.named for line in self.lines)
        spared = {n for n, w in inside.items() if not use_names or (n in holds and 4 * w >= clear) or (3 * w > 2 * total and not elsewhere and n not in self.remarks)}
        stays = {0}
        for n in sorted(self.named_in):
            if n in spared and self.named_in[n] in stays:
                stays.add(n)
        return [line for line in self.lines if line.named in stays and line.gap not in spared]

    def around(self, lines: list[Line]) -> int:
        """The innermost container of all these lines; 0 if there is none."""
        count = dict.fromkeys(self.parent, 0)
        for line in lines:
            if line.holder:
                count[line.holder] += 1
        for n in sorted(self.parent, reverse=True):
            if up := self.parent[n]:
                count[up] += count[n]
        return max((n for n, k in count.items() if k == len(lines)), default=0)

    def within(self, container: int) -> set[int]:
        """The container and all inside it."""
        out = {container}
        for n in sorted(self.parent):
            if self.parent[n] in out:
                out.add(n)
        return out


def is_furniture(name: str, attrs: str, in_scope: bool) -> bool:
    """Whether an element is page furniture by its kind, role or invisibility."""
    if name in FURNITURE or (name == "header" and not in_scope):
        return True
    if "=" not in attrs:
        return name not in ("html", "body") and " hidden" in f" {attrs.lower()} ".replace("/", " ")
    if name in ("html", "body", "main"):
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def furniture_words(name: str, attrs: str, in_scope: bool) -> set[str]:
    """The words of an element's class and id that tell page furniture."""
    if "=" not in attrs or name in ("html", "body", "main"):
        return set()
    out: set[str] = set()
    for key, *values in _ATTR.findall(attrs):
        key = key.lower()
        if key not in ("class", "id"):
            continue
        classes = "".join(values).lower().split()
        if in_scope:
            if key == "class" and name in CONTAINERS:
                out |= INSIDE.intersection(classes)
            continue
        found = {w for c in classes if not _MODIFIER.match(c) for w in _WORD.findall(c)}
        if name == "article":
            found &= {"comment", "comments", "ad", "ads", "advert", "sponsored"}
        out |= found & WORDS
        if "header" in found and found <= {"header", "site", "page", "top", "global", "main", "app", "wrapper", "container", "bar"}:
            out.add("header")
    return out


def page_of(html: str) -> Page:
    """The lines of a page: text blocks, and empty lines where page furniture was or may have been. Linear in the page."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = []  # name, number, starts furniture, is named like furniture
    opened: dict[str, int] = {}  # how many elements of a name are open
    blocks: list[str] = []
    containers: list[int] = [0]
    named: list[int] = [0]
    scopes: list[tuple[int, bool]] = []  # open article and main elements, with whether it is a main
    furniture = mains = links = at = number = 0

    def scope() -> int:
        return (scopes[0] if mains else scopes[-1])[0] if scopes else 0

    def close() -> None:
        if not furniture:
            page.close(containers[-1], scope(), named[-1], blocks[-1] if blocks else "")

    def text(upto: int) -> None:
        if upto > at and not furniture:
            part = html[at:upto]
            part = entities.unescape(part) if "&" in part else part
            page.parts.append(part)
            if links:
                page.linked += len(" ".join(part.split()))

    def pop() -> None:
        """Close the innermost element, and note where furniture ends."""
        nonlocal furniture, links, mains
        was = furniture
        name, num, starts, by_name = stack.pop()
        opened[name] -= 1
        if by_name:
            close()
            if not furniture:
                page.gap(num)
            named.pop()
        furniture -= starts
        if name == "a":
            links = max(0, links - 1)
        if name in ("article", "main") and scopes and scopes[-1][0] == num:
            mains -= scopes.pop()[1]
        if containers[-1] == num:
            containers.pop()
        if name in BLOCK:
            blocks.pop()
        if was and not furniture:
            page.gap()

    while True:
        m = _TAG.search(html, at)
        text(m.start() if m else len(html))
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            if not furniture:
                page.parts.append(" ")
            continue
        if m[1]:
            if name in BLOCK:
                close()
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCK:
            close()
            if stack and (stack[-1][0] in CLOSES.get(name, ()) or stack[-1][0] == "p"):
                pop()
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in ("article", "main") and furniture and all(x[0] in ("nav", "header", "head") for x in stack if x[2]):
            while furniture:  # the furniture was never closed
                pop()
        number += 1
        starts = is_furniture(name, m[3], bool(scopes))
        words = set() if starts else furniture_words(name, m[3], bool(scopes))
        if (starts or words) and not furniture:
            close()
            page.gap(number if words else 0)
        furniture += starts
        stack.append((name, number, starts, bool(words)))
        opened[name] = opened.get(name, 0) + 1
        if name in BLOCK:
            blocks.append(name)
        if name in ("article", "main") and not furniture:
            if named[-1] and not words:
                page.holders.add(named[-1])
            scopes.append((number, name == "main"))
            mains += name == "main"
        if words:
            page.named_in[number] = named[-1]
            named.append(number)
            if words <= REMARKS:
                page.remarks.add(number)
        if name == "a":
            links += 1
        if name in HOLDERS:
            page.parent[number] = containers[-1]
            containers.append(number)
            if name in PARTS:
                page.parts_of.add(number)
    close()
    return page


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, end) of the stretches of lines between a surge of the window's sum and the dive after it."""
    n = len(weights)
    before = [0, *accumulate(weights)]
    ahead = [before[min(n, i + window)] - before[i] for i in range(n + 1)]  # sums of the windows that begin at each line
    surge = min(SURGE, SHARE * max(ahead))
    out, start = [], None
    for i, total in enumerate(ahead):
        if start is None:
            if i < n and weights[i] and total >= surge:
                start = i
        elif total < surge * DIVE or not total:
            out.append((start, i))
            start = None
    return out


def extract(html: str, window: int = WINDOW) -> str:
    """The main text of a page, its blocks joined by newlines; empty if there is none.

    Where names leave nothing, the text is sought among all lines that are not furniture by their elements.
    """
    page = page_of(html)
    return main_text(page, page.settled(), window) or main_text(page, page.settled(False), window)


def main_text(page: Page, lines: list[Line], window: int = WINDOW) -> str:
    by_scope: dict[int, int] = {}
    for line in lines:
        if line.scope:
            by_scope[line.scope] = by_scope.get(line.scope, 0) + line.weight
    scope = max(by_scope, key=lambda s: (by_scope[s], -s), default=0)
    if by_scope.get(scope):
        return "\n".join(line.text for line in lines if line.scope == scope and line.text)
    found = stretches([line.weight for line in lines], window)
    if not found:
        return ""
    weigh = {s: sum(line.weight for line in lines[s[0] : s[1]]) for s in found}
    best = max(found, key=lambda s: (weigh[s], -s[0]))
    home = page.around([line for s in found if weigh[s] >= SIDE * weigh[best] for line in lines[s[0] : s[1]] if line.weight])
    while home in page.parts_of:
        home = page.parent[home]  # what holds a section or a list holds its siblings too
    inside = page.within(home)
    chosen = [s for s in found if s == best or any(line.weight and line.holder in inside for line in lines[s[0] : s[1]])]
    span = [chosen[0][0], chosen[-1][1]]
    if home:  # light lines of the container, before and after its stretches
        at = [i for i, line in enumerate(lines) if line.weight and line.holder in inside]
        span = [min(span[0], at[0]), max(span[1], at[-1] + 1)]
    first, end = trimmed(lines, *span)
    taken = [False] * len(lines)
    for a, b in chosen:
        taken[a:b] = [True] * (b - a)
    # lines between stretches of one container are its text, however light
    return "\n".join(line.text for i, line in enumerate(lines) if first <= i < end and line.text and (taken[i] or home and line.holder in inside))


def trimmed(lines: list[Line], first: int, end: int) -> tuple[int, int]:
    """The stretch without lines at its ends that do not read like text; headings before the text stay. All, if nothing does."""
    reads = [i for i in range(first, end) if lines[i].reads()]
    return (reads[0], reads[-1] + 1) if reads else (first, end)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from the whole html, in one pass without a shuffle.

    A null html counts as empty. Null ids and urls, and repeated rows, pass through. Only these three columns are read.
    """
    prepare(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce(pages["html"], F.lit("")).alias("html"))
    return map_batches(rows, run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
