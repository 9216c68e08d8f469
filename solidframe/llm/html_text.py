"""Main text of web pages by composite text density.

For every node of a page the characters per tag are computed and adjusted for links (composite text density,
Sun, Song and Liao 2011): a node whose characters stand mostly in links, or whose tags are mostly links,
loses density. The densities of a node's block children are summed (its own counts where it has none); the
block with the largest sum is the main content, and the least density on its path to the body is the threshold:
below the body, every other node that reaches it gives the largest-sum node of its own subtree. Of equal sums an
article or main element goes first, then the outer node. What lies between two such nodes in their common
ancestor belongs to them, and so do headings right before them. If the body has the largest sum, all in it is
taken but menus: blocks below the threshold with most characters in links. Elements that are no content by their
tag, role or the words of their class and id (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are left out first and count in no density.

Pages are independent rows: no shuffle. The parser is tolerant: unclosed and misnested elements, missing
bodies, and pages that end in a tag. A head without an end tag ends at the body or at the first thing that
can't stand in it; the end tag of an element that is left out by its tag also closes blocks open inside it.
Open elements are found by name, so a page takes time in proportion to its length.

Cases: null, empty and blank html give an empty text; markup in comments, scripts and styles is no text;
equal rows give equal rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements of HTML by how they are laid out or parsed.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: What may stand in a head; anything else ends it.
HEAD_TAGS = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
CLOSES_P = BLOCKS - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
#: An opening tag that ends an open element, and where the search for it stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements, roles and words of class and id that mark what isn't the article.
DROP_TAGS = frozenset("nav aside footer form head script style noscript template button select textarea iframe svg canvas object menu dialog title input label datalist noembed noframes".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu topnav breadcrumb breadcrumbs sidebar sidebars aside footer masthead "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register comment comments commentlist disqus respond replies share sharing social related recommended pagination pager widget toolbar search".split()
)
KEEP_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[^A-Za-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")


class _Open:
    """The open elements of a page under parsing, found by name."""

    def __init__(self):
        self.stack, self.names = [0], ["body"]
        self.places: dict[str, list[int]] = {"body": [0]}
        self.blocks = [0]

    def push(self, element: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        self.names.append(name)

    def cut(self, place: int) -> None:
        """Closes the element at ``place`` and all in it."""
        while len(self.stack) > place:
            self.stack.pop()
            name = self.names.pop()
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()

    def last(self, *names: str) -> int:
        """Place of the innermost open element with one of the names; -1 without any."""
        return max((own[-1] for n in names if (own := self.places.get(n))), default=-1)

    def close(self, names: set[str], until: set[str]) -> None:
        """Closes the innermost of ``names``, unless one of ``until`` lies within it."""
        place = self.last(*names)
        if place > 0 and place > self.last(*until):
            self.cut(place)


class Page:
    """Elements of a page in order, each with its parent, and the texts and block ends between them."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attrs = ["body"], [-1], [""]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or None where a block begins or ends
        now = _Open()
        stack = now.stack
        at, raw = 0, None
        while at <= len(source):
            if raw is not None:  # what a script or style holds ends at its own end tag only
                end = re.compile(rf"</{raw}\b", re.I).search(source, at)
                if raw in ("textarea", "xmp"):
                    self.events.append((stack[-1], source[at : end.start() if end else len(source)]))
                at, raw = (end.start() if end else len(source)), None
                now.cut(len(stack) - 1)
            m = _TOKEN.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                if text.strip():
                    self._end_head(now)
                self.events.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            if m[0][:9] == "<![CDATA[":
                self._end_head(now)
                self.events.append((stack[-1], entities.escape(m[0][9:].removesuffix("]]>"))))
                continue
            name, ends, attrs = (m[2] or m[5] or "").lower(), m[1] or m[4], m[3] or m[6] or ""
            if not name:
                continue
            if name == "body" and not ends and now.last("template") < 0 and now.last("head") > 0:
                now.cut(now.places["head"][0])
            elif name in ("html", "body") if ends else name not in HEAD_TAGS:
                self._end_head(now)
            if name in ("html", "body"):
                if not ends and name == "body":
                    self.attrs[0] = attrs
                self.events.append((stack[-1], None))
            elif ends:
                if name in BLOCKS:
                    self.events.append((stack[-1], None))
                place = now.last(name)
                # an inline end tag closes nothing beyond its block
                if place > 0 and (name in BLOCKS or name in DROP_TAGS or place > now.blocks[-1]):
                    now.cut(place)
            else:
                if name == "br":
                    self.events.append((stack[-1], " "))
                if name in BLOCKS:
                    self.events.append((stack[-1], None))
                if name in CLOSES_P:
                    now.close({"p"}, {"td", "th", "table", "button", "article", "section", "div", "li", "blockquote", "aside", "main"} if name != "p" else {"td", "th", "table", "button"})
                if name in ENDS:
                    now.close(*ENDS[name])
                self.tags.append(name)
                self.parents.append(stack[-1])
                self.attrs.append(attrs)
                if name in VOID or attrs.endswith("/") and name in ("svg", "path", "use"):
                    continue
                now.push(len(self.tags) - 1, name)
                raw = name if name in RAW else None

    def _end_head(self, now: _Open) -> None:
        if self.tags[now.stack[-1]] == "head":
            now.cut(len(now.stack) - 1)

    def dropped(self) -> list[bool]:
        """Which elements are no content, or lie in one that isn't."""
        out, inside, headings = [False], [False], set()
        for k in range(1, len(self.tags)):
            if self.tags[k] in ("h1", "h2"):
                j = k
                while j >= 0 and j not in headings:
                    headings.add(j)
                    j = self.parents[j]
        for k in range(1, len(self.tags)):
            tag, p = self.tags[k], self.parents[k]
            inside.append(inside[p] or tag in ("article", "main"))
            gone = out[p] or tag in DROP_TAGS
            header = tag == "header"
            if not gone and self.attrs[k] and tag not in KEEP_TAGS:
                for m in _ATTR.finditer(self.attrs[k]):
                    name, value = m[1].lower(), (m[2] or "").strip("\"'")
                    if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                        gone = True
                    elif name == "role":
                        gone = gone or value.lower() in DROP_ROLES
                    elif name in ("class", "id"):
                        words = set(_WORDS.split(_CAMEL.sub(r"\1 \2", value).lower()))
                        gone = gone or bool(words & DROP_WORDS)
                        header = header or "header" in words
            # an article's own header holds its heading
            out.append(gone or header and not (inside[p] and k in headings))
        return out


def _density(c: int, t: int, lc: int, lt: int, body_c: int, body_lc: int) -> float:
    plain = c / max(t, 1)
    if not body_lc:
        return plain
    base = math.log(c / max(c - lc, 1) * lc + body_lc / max(body_c, 1) * c + math.e)
    return plain * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / max(math.log(base), 1e-3)


class Densities:
    """Composite text density of every element of a page that isn't left out, and the sums over children."""

    def __init__(self, page: Page, gone: list[bool], texts: list[tuple[int, str | None]]):
        n = len(page.tags)
        self.chars, self.links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        links = self.links
        for k, x in texts:
            if x and not gone[k]:
                self.chars[k] += len(x.strip())
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[page.parents[k]] or page.tags[k] == "a"
            links[k] = self.chars[k] if in_link[k] else 0
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(n - 1, 0, -1):
            if not gone[k]:
                p = page.parents[k]
                self.children[p].append(k)
                self.chars[p] += self.chars[k]
                links[p] += links[k]
                tags[p] += tags[k] + 1
                link_tags[p] += link_tags[k] + (page.tags[k] == "a")
        for own in self.children:
            own.reverse()
        self.density = [_density(self.chars[k], tags[k], links[k], link_tags[k] + (page.tags[k] == "a"), self.chars[0], links[0]) for k in range(n)]
        self.block = block = [page.tags[k] in BLOCKS for k in range(n)]
        self.sums = [sum(self.density[c] for c in self.children[k] if block[c]) or self.density[k] for k in range(n)]
        rank = [(self.sums[k], page.tags[k] in ("article", "main"), -k) for k in range(n)]
        self.best = list(range(n))  # of each subtree, the element with the largest sum
        for k in range(n - 1, 0, -1):
            p = page.parents[k]
            if not gone[k] and block[self.best[k]] and rank[self.best[k]] > rank[self.best[p]]:
                self.best[p] = self.best[k]

        path = [self.best[0]]
        while path[-1]:
            path.append(page.parents[path[-1]])
        self.threshold = min(self.density[k] for k in path)

    def menu(self, k: int) -> bool:
        """Whether a block below the threshold has most of its characters in links."""
        return self.block[k] and 2 * self.links[k] > self.chars[k] and self.density[k] < self.threshold

    def content(self) -> set[int]:
        """The largest-sum element, and those of other subtrees that reach the least density on its path to the body."""
        out, wait = {self.best[0]}, list(self.children[0]) if self.best[0] else []
        while wait:
            k = wait.pop()
            if self.chars[k] and self.density[k] >= self.threshold:
                out.add(self.best[k])
            if k != self.best[0]:
                wait.extend(self.children[k])
        return out


def _region(page: Page, found: Densities, content: set[int]) -> tuple[set[int], int]:
    """``content`` with what lies between its elements in their common ancestor and headings right before; the ancestor."""
    n = len(page.tags)
    below = [0] * n  # elements of the content in each subtree
    for k in range(n - 1, -1, -1):
        below[k] += k in content
        if k:
            below[page.parents[k]] += below[k]
    common = 0
    while common not in content:
        inner = [c for c in found.children[common] if below[c]]
        if len(inner) != 1:
            break
        common = inner[0]
    out = set(content)
    first = common
    if common not in content:
        inner = [c for c in found.children[common] if below[c]]
        out.update(c for c in found.children[common] if inner and inner[0] <= c <= inner[-1] and not found.menu(c))
        first = inner[0] if inner else 0
    while first > 0:
        own = [c for c in found.children[page.parents[first]] if c < first and found.chars[c]]
        while own and page.tags[own[-1]] in HEADINGS:
            out.add(own.pop())
        if own:
            break
        first = page.parents[first]
    return out, common


def main_text(source: str | None) -> str:
    """Text of the article of a page: its blocks, one a line."""
    if not source or not source.strip():
        return ""
    page = Page(source)
    gone = page.dropped()
    texts = [(k, entities.unescape(x) if x and "&" in x else x) for k, x in page.events]
    found = Densities(page, gone, texts)
    content, common = _region(page, found, found.content())
    kept = [False] * len(page.tags)
    for k in range(len(kept)):
        inherits = k > 0 and kept[page.parents[k]] and not (page.parents[k] == 0 and found.menu(k))
        kept[k] = not gone[k] and (k in content or inherits)
    inside = [i for i, (k, x) in enumerate(texts) if x and kept[k]]
    lo, hi = (inside[0], inside[-1]) if inside else (0, -1)
    blocks, now = [], []
    for i, (k, x) in enumerate([*texts, (0, None)]):
        if x is None:
            line = " ".join("".join(now).split())
            if line:
                blocks.append(line)
            now = []
        elif kept[k] or k == common and lo < i < hi:
            now.append(x)
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): the main text and its length in code points."""
    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
