"""Main text of HTML pages by tag-path ratios.

Every piece of text belongs to a block and every block to a root-to-leaf path of block elements
(with their first class).  Per path the length and punctuation of its text are added up; the ratio
of both to the path's blocks tells prose from labels, links count against it, and the sequence of
ratios is smoothed along the page.  Paths above a threshold are the content.

It is fused with what the markup says outright.  Elements for menus and footers never hold content as
long as there is other text; forms and what class or id mark as adverts, comments and the like don't
either, unless they hold the page's content (see ``_Page.left_out``); what stands beside ``main`` or
``article`` doesn't as long as these hold text.  Paragraphs, headings, lists, quotes and tables within
``main`` or ``article`` are content; everything else there is what its ratio says.  Without these
elements the container is the lowest common ancestor of the paths above the threshold, and the headings,
lists, quotes and tables between or next to their blocks are content too.  Lists of links are content
within an article.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame

from .common import arrow_rows

# Element names of the HTML standard by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript noembed noframes iframe xmp".split())
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NEVER = frozenset("head nav footer aside button select svg math canvas audio video object template dialog menu datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words in class or id that mark what is not content.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar sidebars widget widgets footer masthead topbar comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe "
    "subscription signup login search pagination pager toolbar skiplink alert toast copyright colophon".split()
)
# Those of them that mark what readers wrote.
REPLIES = frozenset("comment comments commentlist disqus respond replies reply".split())
# Beside these words ``header`` names the head of an article.
ARTICLE = frozenset("article post entry content story".split())
CONTAINERS = frozenset(("article", "main"))
LISTS = frozenset(("ul", "ol", "dl"))
FLOW = frozenset("p pre blockquote figure".split()) | LISTS
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")

#: A path is content from this share of the mean ratio, weighted by length, on.
THRESHOLD = 0.5
#: Marked parts are content if they hold more than so many times the prose outside of marks (of what readers wrote: the second).
MOST = (2, 8)
#: Of a path's text, the share in links that makes it a menu.
LINKS = 0.6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_QUOTE = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"""([^\s"'>/=][^\s"'>/=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]+)))?""")  # one after another, values included
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class _Page:
    """One pass over the markup: blocks as (path, text, length in links, element)."""

    def __init__(self, source: str):
        self.s, self.absent = source, set()
        self.blocks: list[tuple[int, str, int, int]] = []
        self.element, self.around, self.of = 0, [-1], [0]  # the open block element; per element the one around it and its path
        self.label, self.parent, self.banned, self.container = [""], [-1], [False], [-1]
        self.words: list[frozenset[str]] = [frozenset()]  # what marks the path itself
        self.count = [1]  # elements on the path
        self.index: dict[tuple[int, str, frozenset[str], bool], int] = {}
        self.stack: list[tuple[str, int, bool]] = []  # element, path, hides its text
        self.open: dict[str, int] = {}
        self.parts: list[str] = []
        self.linked, self.hidden = 0, 0
        self.read()

    def find(self, what: str, at: int) -> int:
        """Like str.find; what is absent once is not sought again, so damaged markup stays linear."""
        if what in self.absent:
            return -1
        got = self.s.find(what, at)
        if got < 0:
            self.absent.add(what)
        return got

    def path(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def below(self, given: list[bool]) -> list[bool]:
        """Those given and all paths below them."""
        out = given[:]
        for p in range(1, len(out)):
            out[p] = out[p] or out[self.parent[p]]
        return out

    def nearest(self, path: int) -> list[int]:
        """Per element the nearest on the path, itself included; those outside have the page's."""
        out = list(range(len(self.of)))
        for e in range(1, len(out)):
            if self.of[e] != path:
                out[e] = out[self.around[e]]
        return out

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.path(), text, self.linked, self.element))
        self.parts, self.linked = [], 0

    def text(self, piece: str) -> None:
        if piece and not self.hidden:
            self.parts.append(entities.unescape(piece) if "&" in piece else piece)
            if self.open.get("a"):
                self.linked += len(piece.strip())

    def push(self, name: str, attrs: str) -> None:
        here = self.path()
        if name in INLINE:
            hides = bool(attrs) and self.marks(name, attrs, here)[1]
            self.stack.append((name, here, hides))
        else:
            self.flush()
            first, hides, banned, words = self.marks_of(name, attrs, here)
            key = (here, name + first, words, banned)
            if key not in self.index:
                self.index[key] = len(self.label)
                self.label.append(name)
                self.parent.append(here)
                self.banned.append(self.banned[here] or banned)
                self.words.append(words)
                self.count.append(0)
                self.container.append(len(self.label) - 1 if name in CONTAINERS and self.container[here] < 0 else self.container[here])
            self.count[self.index[key]] += 1
            self.around.append(self.element)
            self.of.append(self.index[key])
            self.element = len(self.of) - 1
            self.stack.append((name, self.index[key], hides))
        self.hidden += self.stack[-1][2]
        self.open[name] = self.open.get(name, 0) + 1

    def marks(self, name: str, attrs: str, here: int) -> tuple[dict[str, str], bool]:
        got = {}
        for m in _ATTR.finditer(attrs):
            got.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        hides = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "")
        return got, hides

    def marks_of(self, name: str, attrs: str, here: int) -> tuple[str, bool, bool, frozenset[str]]:
        """First class, whether the text is hidden, whether the element never holds content, words that mark it."""
        got, hides = self.marks(name, attrs, here) if attrs else ({}, False)
        words = set(_WORD.findall(got.get("class", "") + " " + got.get("id", "")))
        found = words & MARKS
        outside = self.container[here] < 0
        if outside and (name == "header" or "header" in words and not words & ARTICLE and name not in HEADINGS):
            found.add("header")
        if name == "form" or got.get("role") == "form":
            found.add("form")
        if name in ("html", "body", "main"):
            found = set()
        first = got.get("class", "").split(None, 1)
        return ("." + first[0] if first else ""), hides, name in NEVER or got.get("role") in ROLES, frozenset(found)

    def left_out(self) -> list[bool]:
        """Which paths marks leave out.

        A mark doesn't count where its part of the page holds ``main``; where it holds an ``article``
        without a mark and there is none elsewhere, or only shorter ones; and where it holds most of
        the prose.  Prose below further marks isn't a part's own and comments within comments are
        never the page's content, so a list of comments marked one by one stays out.  An article's own mark counts only below another mark.
        """
        n = len(self.label)
        own = [0] * n
        for path, text, linked, _ in self.blocks:
            if not self.banned[path] and PUNCTUATION.search(text):
                own[path] += max(0, len(text) - linked)
        marked = [bool(w) and not self.banned[p] and self.label[p] != "article" for p, w in enumerate(self.words)]
        if not any(marked):
            return [False] * n

        below = self.below

        def sums(given: list[bool]) -> list[int]:
            """Prose of each path and below, without what is below further marks."""
            out = own[:]
            for p in range(n - 1, 0, -1):
                if not given[p]:
                    out[self.parent[p]] += out[p]
            return out

        covered = below(marked)
        prose = sums([False] * n)
        mains = [not self.banned[p] and self.label[p] == "main" and prose[p] > 0 for p in range(n)]
        mean = [prose[p] / self.count[p] if self.label[p] == "article" and not self.banned[p] else 0.0 for p in range(n)]
        other = max((max(mean[p], float(prose[p] if mains[p] else 0)) for p in range(n) if not covered[p]), default=0.0)
        best = [0.0 if self.words[p] else mean[p] for p in range(n)]  # of articles without a mark below each path
        for p in range(n - 1, 0, -1):
            q = self.parent[p]
            best[q], mains[q] = max(best[q], best[p]), mains[q] or mains[p]
        for p in range(n):
            if marked[p] and (mains[p] or best[p] > 0 and (not other or best[p] >= other and not self.words[p] & REPLIES)):
                marked[p] = False
        replies = [bool(w & REPLIES) for w in self.words]
        inner = below(replies)
        times = [MOST[r] for r in replies]
        main = any(mains[p] and self.label[p] == "main" and not covered[p] for p in range(n))
        free = [p for p in range(1, n) if marked[p] and not (replies[p] and (inner[self.parent[p]] or other)) and not (main and self.container[p] < 0)]
        while any(marked):
            part = sums(marked)
            top = max((p for p in free if marked[p]), key=lambda p: (part[p] / times[p], -p), default=0)
            if not top or part[top] <= times[top] * part[0]:
                break
            while top > 0:  # with what is marked around it
                marked[top] = False
                top = self.parent[top]
        return below(marked)

    def pop(self) -> None:
        name, _, hides = self.stack[-1]
        if name not in INLINE:
            self.flush()
            self.element = self.around[self.element]
        self.stack.pop()
        self.hidden -= hides
        self.open[name] -= 1

    def close_to(self, names: tuple[str, ...], stops: tuple[str, ...] | None) -> None:
        """Close the nearest open one of ``names``; not beyond ``stops`` (None: beyond inline elements only)."""
        if not any(self.open.get(n) for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name in names:
                while len(self.stack) > k:
                    self.pop()
                return
            if name in stops if stops is not None else name not in INLINE:
                return

    def read(self) -> None:
        s, at, n = self.s, 0, len(self.s)
        while at < n:
            lt = self.find("<", at)
            if lt < 0:
                self.text(s[at:])
                break
            self.text(s[at:lt])
            if s.startswith("<!--", lt):
                end = self.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            end_tag = s.startswith("/", lt + 1)
            m = _NAME.match(s, lt + 1 + end_tag)
            if not m:
                if end_tag or s[lt + 1 : lt + 2] in ("!", "?"):
                    end = self.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self.text("<")
                    at = lt + 1
                continue
            p = m.end()
            while True:  # to the end of the tag, over quoted values
                p = _TO_QUOTE.match(s, p).end()
                if p >= n or s[p] == ">":
                    break
                q = self.find(s[p], p + 1)
                p = p + 1 if q < 0 else q + 1
            if p >= n:
                break
            name, attrs, at = m[0].lower(), s[m.end() : p], p + 1
            if end_tag:
                if name == "br":
                    self.text(" ")
                elif self.open.get(name):
                    while self.stack[-1][0] != name:
                        self.pop()
                    self.pop()
                continue
            if name in RAW:
                close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(s, at)
                end = self.find(">", close.end()) if close else -1
                at = n if end < 0 else end + 1
                continue
            if name == "br":
                self.text(" ")
            if name in VOID:
                if name == "hr":
                    self.flush()
                continue
            if name in CLOSES:
                self.close_to(CLOSES[name], SCOPES[name])
            elif name not in INLINE:
                self.close_to(("p",), None)
            self.push(name, attrs)
            if attrs.endswith("/") and name in ("svg", "path"):
                self.pop()
        while self.stack:
            self.pop()
        self.flush()


def ratios(blocks: list[tuple[int, str, int, int]]) -> tuple[dict[int, float], dict[int, float], set[int]]:
    """Per path its ratio, the ratio smoothed along the page, and which paths are menus."""
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    nodes: dict[int, int] = {}
    links: dict[int, int] = {}
    for path, text, linked, _ in blocks:
        chars[path] = chars.get(path, 0) + len(text)
        marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
        nodes[path] = nodes.get(path, 0) + 1
        links[path] = links.get(path, 0) + min(linked, len(text))
    menu = {p for p in chars if links[p] > LINKS * chars[p]}
    ratio = {p: 0.0 if p in menu else chars[p] / nodes[p] * (1 + marks[p] / nodes[p]) * (1 - links[p] / chars[p]) ** 2 for p in chars}
    # smooth along the page, then back to paths as means
    raw = [ratio[b[0]] for b in blocks]
    smooth = [0.25 * raw[max(0, k - 1)] + 0.5 * raw[k] + 0.25 * raw[min(len(raw) - 1, k + 1)] for k in range(len(raw))]
    fused = dict.fromkeys(chars, 0.0)
    for (path, _, _, _), x in zip(blocks, smooth, strict=True):
        fused[path] += x / nodes[path]
    for p in menu:
        fused[p] = 0.0
    return ratio, fused, menu


def blocks_of(source: str | None, threshold: float = THRESHOLD) -> list[str]:
    """Content blocks of a page in order; none for null or empty pages or pages without text."""
    if not source:
        return []
    page = _Page(source)
    out = page.left_out()
    blocks = [b for b in page.blocks if not page.banned[b[0]] and not out[b[0]]] or [b for b in page.blocks if not page.banned[b[0]]] or page.blocks
    # the markup names where the article is; what of that is content the ratios say
    within = [b for b in blocks if page.container[b[0]] >= 0]
    blocks = within or blocks
    if not blocks:
        return []
    ratio, fused, menu = ratios(blocks)
    chars = dict.fromkeys(fused, 0)
    for path, text, _, _ in blocks:
        chars[path] += len(text)
    apart: set[int] = set()  # blocks of elements like the best path's parent that hold none of its blocks
    # the neighbour of a long block isn't content by that
    fused = {p: min(fused[p], ratio[p]) for p in chars}
    if not within:  # paths beside the best one share its ratio, except right in body
        best = max(chars, key=lambda p: (fused[p] * chars[p], -p))
        top = page.parent[best]
        if top > 0 and page.label[top] not in ("html", "body"):
            beside = page.below([p == top for p in range(len(page.label))])
            raised = {p for p in chars if beside[p] and p not in menu and fused[p] < fused[best]}
            around = page.nearest(top)
            real = {around[b[3]] for b in blocks if b[0] == best}
            apart = {k for k, b in enumerate(blocks) if b[0] in raised and around[b[3]] not in real and fused[b[0]] < threshold * fused[best]}
            fused |= dict.fromkeys(raised, fused[best])
    total = sum(chars.values())
    need = threshold * sum(fused[p] * chars[p] for p in chars) / total
    kept = {p for p in chars if fused[p] > 0 and fused[p] >= need}
    if not kept:
        return []
    if not within:
        return [blocks[k][1] for k in _between(page, blocks, kept, menu, apart)]
    # paragraphs, headings and the like of the article; lists of links where they are within it
    flow = page.below([x in FLOW or x in HEADINGS or x == "table" for x in page.label])
    article, lists = page.below([x == "article" for x in page.label]), page.below([x in LISTS for x in page.label])
    alone = not any(article[p] for p in kept)
    homes = {page.container[p] for p in kept}
    return [text for path, text, _, _ in blocks if path in kept or flow[path] and page.container[path] in homes and (path not in menu or lists[path] and (article[path] or alone))]


def _between(page: _Page, blocks: list[tuple[int, str, int, int]], kept: set[int], menu: set[int], apart: set[int]) -> list[int]:
    """Numbers of the blocks on ``kept`` paths, except ``apart``, and of what belongs to them below their lowest common ancestor."""
    n = len(page.label)
    held = [int(p in kept) for p in range(n)]
    for p in range(n - 1, 0, -1):
        held[page.parent[p]] += held[p]
    top = max(p for p in range(n) if held[p] == len(kept))
    if top in kept and top > 0:  # what stands beside its blocks
        top = page.parent[top]
    named = page.label[top] not in ("", "html", "body")
    inside, flow = [False] * n, [False] * n  # headings, lists and the like below the container; tables only if they don't lay out kept blocks
    for p in range(top + 1, n):
        q, x = page.parent[p], page.label[p]
        inside[p] = q == top or inside[q]
        flow[p] = inside[p] and (flow[q] or x in FLOW or x in HEADINGS or x == "table" and not held[p])
    heading = page.below([x in HEADINGS for x in page.label])
    container = page.nearest(top)
    content = [b[0] in kept and k not in apart for k, b in enumerate(blocks)]
    at = [k for k, c in enumerate(content) if c]
    for k in range(at[0], at[-1]):
        content[k] = content[k] or flow[blocks[k][0]]
    for k in range(at[0] - 1, -1, -1):  # what leads up to the first block
        path, _, _, e = blocks[k]
        if not flow[path] or path in menu or container[e] != container[blocks[at[0]][3]]:
            break
        content[k] = True
    head = None  # headings count as soon as something follows
    for k in range(at[-1] + 1, len(blocks)):
        path, _, _, e = blocks[k]
        if not flow[path] or path in menu and not named or container[e] != container[blocks[at[-1]][3]]:
            break
        if heading[path]:
            head = k if head is None else head
        else:
            for i in range(k if head is None else head, k + 1):
                content[i] = True
            head = None
    return [k for k, c in enumerate(content) if c]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, ``keep`` columns, text, n_chars) of each page.

    Null html counts as empty, and empty pages and pages without text have empty text.  Pages are read
    whole, however long; rows with one id, or one page, are pages of their own; other columns aren't read and
    may have any name; an empty table gives an empty result.
    """
    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, *keep))

    def make():
        def f(cols):
            texts = ["\n".join(blocks_of(h)) for h in cols[-1]]
            return dict(zip((id_col, *keep), cols, strict=False)) | {"text": texts, "n_chars": [len(t) for t in texts]}

        return f

    return arrow_rows(pages, make, f"{kinds}, text string, n_chars long", id_col, *keep, html_col)
