"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between block-level tags.  Each block stands in an element, and elements
that open alike (tag, classes, role, id) below the same path share a root-to-leaf path.  For each path the text
length, the punctuation and the link text of all its blocks are added up, and give a text ratio (length a
block) and a punctuation ratio (marks a block); their product, less the share of links, is smoothed over
neighbouring blocks and back to paths.

**Fusion.**  A path's ratio, as a part of the page's best, is fused with its mark: 1 inside ``article``, a half
less the share of links inside ``main`` beside an article (1 where ``main`` has none), 0 elsewhere and for what stands in an article's ``header`` but
headings.  How far marks count depends on the share of the page's unlinked text that is marked: from ``TRUSTED`` on
they decide and ratios only add to them, under it a mark adds to the ratio.  Paths over the threshold are content.
Without trusted marks the containers collect what their paths have; the deepest that holds nine tenths of the page's
weight is searched, headings and short paragraphs beside content stay, and so do headings and
paragraphs right under an element around the container.

**Boilerplate.**  Elements whose tag, class, role or id says what they are (menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles) never count.  Names are compared as whole tokens
(``sidebar``, ``site-sidebar``, not ``has-sidebar``); headings keep their text whatever their id.  Neither names nor the tag
``form`` rule out ``main`` or ``article``, what holds ``main`` or all articles, or what holds nine tenths
of the page's unlinked text; and inside these, words that headings and sections have by chance (``discussion``,
``related``) rule out nothing that is running text.

All sums go once from the leaves to the root, so a page takes time in proportion to its length, however deep.

Character references are decoded once, after markup is gone; white space inside a
block becomes one space; blocks are joined by an empty line.  Null and empty pages
give an empty text.  Nothing is cut off.  Repeated rows give repeated results; further columns are
ignored; an empty table gives no rows.  Unclosed and misnested tags are closed as
browsers do for paragraphs, list items and table cells.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kinfold.llm.common import table
from kinfold.shared import python_ready, tidy

# Element names of the HTML standard, by how they behave.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "button", "label"}
SKIP = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "optgroup", "label", "fieldset", "legend", "search"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag closes an open element of these, up to a barrier.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": set(), "tfoot": {"tr", "td", "th", "tbody"}}
BARRIER = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "html", "menu"}
#: Class, id and role names that say that an element isn't content.
NOT_CONTENT = re.compile(
    r"(?:ads?|adverts?|advertis\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|newsletter|subscri\w*|signup|sign-up|login|sidebar\d*|side-bar|aside|nav|navbar|navigation|menu|menus|topbar|breadcrumbs?|pagination|pager|footer|foot|header|masthead|topnav|comments?|commentlist|comment-\w+|replies|reply|respond|disqus|discussion|reader-\w+|related|recommend\w*|share|sharing|social|follow|popup|modal|overlay|widget|toolbar|skip-link|search|form|complementary|contentinfo|banner|alertdialog|alert|dialog|toc|hidden|tags|author-bio|rating|votes?|paywall)",
    re.I,
)
#: Of these, words that headings and sections of articles also have.
GENERIC = re.compile(r"(?:discussion|search|related|follow|tags|ratings?|votes?|social|shar(?:e|ing)|toc|form|widget|complementary)", re.I)
#: Running text: unlinked characters and marks at least, and links at most as a part of it.
RUNNING_CHARS, RUNNING_MARKS, RUNNING_LINKS = 200, 2, 0.3
#: Part of the unlinked text from which marks are trusted; thresholds of fused scores with and without that.
TRUSTED, MARKED_THRESHOLD, THRESHOLD = 0.3, 0.25, 0.1
#: First parts of names that speak of the page or of a topic: has-sidebar, tag-social.
MODIFIERS = {"has", "no", "not", "with", "without", "is", "show", "hide", "tag", "category", "cat", "format", "type", "template", "layout", "theme", "js", "supports"}
#: Parts that may follow a name that isn't content: share-buttons, widget-area.
NEUTRAL = re.compile(r"(?:buttons?|links?|lists?|items?|area|box|bar|container|wrapper|wrap|inner|outer|section|block|blocks|slot|unit|group|left|right|top|bottom|main|site|\d+)")
#: Where markup can begin: comments, declarations, tags.
_MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[>\"']")
_VALUE = re.compile(r"=\s*\Z")
#: Elements that may be open at a time; deeper ones count as siblings, as in browsers.
DEEPEST = 512
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_MARK = re.compile(r"[.,;:!?…。、，；：！？]")


class Tags:
    """A page's tags in order, each found by one walk over the characters."""

    def __init__(self, page: str):
        self.page, self.quoted, self.last = page, True, page.rfind(">")

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, outside quotes where these are closed; -1 without one."""
        page, start = self.page, at
        while self.quoted:
            m = _QUOTE_OR_END.search(page, at)
            if m and m.group() == ">":
                return m.start()
            if m and not _VALUE.search(page, max(start, m.start() - 20), m.start()):
                at = m.end()  # a quote inside a name or value
                continue
            close = page.find(m.group(), m.end()) if m else -1
            if close < 0:  # from here on quotes are odd; they count as other characters
                self.quoted = False
                break
            at = close + 1
        return page.find(">", start)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, lower-case name, whether it closes, attributes) of the next tag; the name is empty for comments and the like."""
        page = self.page
        m = _MARKUP.search(page, at)
        if not m or m.start() > self.last:
            # Markup that never ends holds no text.
            return (m.start(), len(page), "", False, "") if m else None
        begin, what = m.start(), m.group()
        if what == "<!--":
            close = page.find("-->", m.end())
            return begin, close + 3 if close >= 0 else len(page), "", False, ""
        if what in ("<!", "<?"):
            close = page.find(">", m.end())
            return begin, close + 1 if close >= 0 else len(page), "", False, ""
        name = _NAME.match(page, m.end() - 1)
        close = self._end(name.end())
        if close < 0:
            return begin, len(page), "", False, ""
        return begin, close + 1, name.group().lower(), what[1] == "/", page[name.end() : close]


def attributes(attrs: str) -> list[tuple[str, str]]:
    """(lower-case name, value) of a tag's attributes."""
    return [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(attrs)]


def hidden(found: list[tuple[str, str]]) -> bool:
    return any(k == "hidden" or (k == "aria-hidden" and v.lower() == "true") or (k == "style" and _DISPLAY.search(v)) for k, v in found)


@lru_cache(4096)
def not_content(names: str) -> str:
    """Empty, or "name" or "generic" where one of the names, as a whole or by its first or last part, says that an element isn't content."""
    found = ""
    for name in names.lower().split():
        if NOT_CONTENT.fullmatch(name):
            if not GENERIC.fullmatch(name):
                return "name"
            found = "generic"
            continue
        first, *rest = re.split(r"[-_]+", name.strip("-_"))
        if rest and first not in MODIFIERS and (NOT_CONTENT.fullmatch(rest[-1]) or (NOT_CONTENT.fullmatch(first) and all(map(NEUTRAL.fullmatch, rest)))):
            return "name"
    return found


class _Block:
    __slots__ = ("element", "text", "links", "marks")

    def __init__(self, element: int, text: str, links: int):
        self.element, self.text, self.links = element, text, min(links, len(text))
        self.marks = len(_MARK.findall(text))


class Page:
    """A page's blocks in order, its elements and its paths; parents come before what they hold. Number 0 of both is the page."""

    def __init__(self):
        self.blocks: list[_Block] = []
        self.holder, self.tag, self.path, self.doubt = [0], [""], [0], [""]
        self.above, self.part = [0], [("", "")]
        self._paths: dict[tuple, int] = {}

    def open(self, holder: int, tag: str, names: str, doubt: str) -> int:
        """A new element; ``doubt``: empty, or the kind of name that rules it out."""
        key = (self.path[holder], tag, names)
        if key not in self._paths:
            self._paths[key] = len(self.above)
            self.above.append(self.path[holder])
            self.part.append((tag, names))
        self.holder.append(holder), self.tag.append(tag), self.path.append(self._paths[key]), self.doubt.append(doubt)
        return len(self.holder) - 1


def read(page: str) -> Page:
    """The page's blocks outside elements whose tag says that they are no content."""
    out = Page()
    stack: list[tuple[str, int | None]] = []  # (tag, element or None where it is no content)
    opened: Counter[str] = Counter()
    skipped = 0
    link: int | None = None  # the depth of the open link
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.blocks.append(_Block(stack[-1][1] if stack else 0, text, links))
            parts, links = [], 0

    def pop_to(i: int) -> None:
        nonlocal skipped, link
        flush()
        for name, element in stack[i:]:
            skipped -= element is None
            opened[name] -= 1
        del stack[i:]
        if link is not None and link > i:  # a link ends with the block that it began in
            link = None

    at, size, tags = 0, len(page), Tags(page)
    while at < size:
        found = tags.next(at)
        end = found[0] if found else size
        if end > at and not skipped:
            parts.append(page[at:end])
            if link is not None:
                links += len(page[at:end].strip())
        if not found:
            break
        _, at, tag, closing, attrs = found
        if not tag:
            continue
        if closing:
            if tag == "a":
                link = None
            elif tag in BLOCK:
                if opened[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                elif not skipped:
                    flush()
            continue
        inside = opened["article"] or opened["main"]
        if tag in RAW and not (tag == "noscript" and inside):
            if not attrs.endswith("/") or tag in ("script", "style"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag == "br" or tag == "hr" or tag == "wbr":
            if not skipped:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    parts.append("\n")
            continue
        if tag in VOID:
            continue
        if tag == "a":
            link = len(stack) if any(k == "href" for k, _ in attributes(attrs)) else None
            continue
        if tag not in BLOCK:
            continue
        for i in range(len(stack) - 1, -1, -1):  # an open paragraph or heading ends here
            if stack[i][0] == "p" or (stack[i][0] in HEADINGS and tag in HEADINGS):
                pop_to(i)
                break
            if stack[i][0] in BARRIER or stack[i][0] in ("td", "th", "button"):
                break
        if tag in CLOSES:
            low = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[tag]:
                    low = i
                elif stack[i][0] in BARRIER:
                    break
            if low is not None:
                pop_to(low)
        if len(stack) >= DEEPEST:
            pop_to(DEEPEST - 1)
        flush()
        given = attributes(attrs) if attrs else []
        names = " ".join(v for k, v in given if v and k in ("class", "id", "role"))
        doubt = ""
        if tag == "form":
            doubt = "form"
        elif tag not in ("html", "body", "main", "article") and tag not in HEADINGS:
            doubt = not_content(names)
        # A header inside an article or main may hold the heading; its text is decided by the paths.
        gone = (tag in SKIP and tag != "form" and not (tag == "header" and inside)) or (tag not in ("html", "body") and hidden(given))
        holder = next((e for _, e in stack[-1:] if e is not None), 0)
        stack.append((tag, None if gone or skipped else out.open(holder, tag, names, doubt)))
        opened[tag] += 1
        skipped += stack[-1][1] is None
    flush()
    return out


def blocks(page: str) -> list[_Block]:
    return read(page).blocks


def _ruled_out(page: Page) -> list[bool]:
    """For each element whether it, or one around it, is no content by its name."""
    n = len(page.holder)
    own, chars, marks, has_main, has_article = [0] * n, [0] * n, [0] * n, [False] * n, [False] * n
    for b in page.blocks:
        own[b.element] += len(b.text) - b.links
        chars[b.element] += len(b.text)
        marks[b.element] += b.marks
    filled = [c > 0 for c in chars]
    for e in range(n - 1, 0, -1):
        up = page.holder[e]
        own[up] += own[e]
        chars[up] += chars[e]
        marks[up] += marks[e]
        filled[up] |= filled[e]
        has_main[up] |= has_main[e] or (page.tag[e] == "main" and filled[e])
        has_article[up] |= has_article[e] or (page.tag[e] == "article" and filled[e])
    doubted, within = [False] * n, [False] * n
    for e in range(1, n):
        up = page.holder[e]
        doubted[e] = doubted[up] or bool(page.doubt[e])
        within[e] = within[up] or page.tag[e] in ("article", "main")
    free_article = any(page.tag[e] == "article" and filled[e] and not doubted[e] for e in range(1, n))
    out = [False] * n
    for e in range(1, n):
        up = page.holder[e]
        out[e] = out[up]
        if page.doubt[e] and not out[e]:
            keeps = has_main[e] or (has_article[e] and not free_article) or (own[e] > 0 and own[e] >= 0.9 * own[0])
            running = own[e] >= RUNNING_CHARS and marks[e] >= RUNNING_MARKS and chars[e] - own[e] <= RUNNING_LINKS * chars[e]
            out[e] = not keeps and not (page.doubt[e] == "generic" and within[up] and running)
    return out


def _marks(page: Page, sums: dict[int, list[int]]) -> dict[int, float]:
    """The mark of each path that has blocks."""
    level, header = [0] * len(page.above), [False] * len(page.above)  # 2 inside an article, 1 inside main alone
    for p in range(1, len(level)):
        up, tag = page.above[p], page.part[p][0]
        level[p] = 2 if tag == "article" else max(level[up], int(tag == "main"))
        header[p] = tag == "header" or (header[up] and tag not in ("article", "main"))
    any_article = any(level[p] == 2 for p in sums)

    def mark(p: int) -> float:
        if not level[p] or (header[p] and page.part[p][0] not in HEADINGS):
            return 0.0
        if level[p] == 2 or not any_article:
            return 1.0
        _, chars, _, links = sums[p]
        return 0.5 * (1 - links / chars)

    return {p: mark(p) for p in sums}


def main_blocks(text: str, threshold: float = THRESHOLD) -> list[str]:
    """Texts of the content blocks, in page order."""
    page = read(text)
    out = _ruled_out(page)
    found = [b for b in page.blocks if not out[b.element]]
    if not found:
        return []
    path = [page.path[b.element] for b in found]
    sums: dict[int, list[int]] = {}
    for p, b in zip(path, found):
        t = sums.setdefault(p, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += b.marks
        t[3] += b.links
    ratio = {p: (chars / n) * (0.25 + marks / n) ** 0.5 * (1 - links / chars) for p, (n, chars, marks, links) in sums.items()}
    raw = [ratio[p] for p in path]
    smooth = dict.fromkeys(sums, 0.0)
    for i, p in enumerate(path):
        near = raw[max(0, i - 1) : i + 2]
        smooth[p] += (raw[i] + sum(near)) / (1 + len(near)) / sums[p][0]
    most = max(smooth.values()) or 1.0
    mark = _marks(page, sums)
    own = {p: chars - links for p, (_, chars, _, links) in sums.items()}
    marked = sum(c for p, c in own.items() if mark[p])
    if marked and marked >= TRUSTED * sum(own.values()):
        content = {p for p in sums if mark[p] and mark[p] + 0.2 * smooth[p] / most > MARKED_THRESHOLD}
        return [b.text for b, p in zip(found, path) if p in content]
    # Containers: the deepest path that holds nine tenths of the page's weight.
    n = len(page.above)
    weight = [0.0] * n
    for p, (_, chars, _, _) in sums.items():
        weight[p] += ratio[p] * chars * (1 + mark[p])
    for p in range(n - 1, 0, -1):
        weight[page.above[p]] += weight[p]
    container = 0
    for p in range(1, n):
        if page.above[p] == container and weight[p] and weight[p] >= 0.9 * weight[0]:
            container = p
    inside, around, up = [False] * n, set(), container
    inside[container] = True
    for p in range(1, n):
        inside[p] = inside[p] or inside[page.above[p]]
    while up:
        up = page.above[up]
        around.add(up)
    fused = {p: smooth[p] / most + 0.5 * mark[p] for p in sums}
    best = max((x for p, x in fused.items() if inside[p]), default=0.0)
    kept = {p for p, x in fused.items() if inside[p] and x >= threshold * best}
    beside = {page.above[p] for p in kept if p} | around

    def stays(b: _Block, p: int) -> bool:
        return p in kept or (p > 0 and page.above[p] in beside and page.part[p][0] in (*HEADINGS, "p", "li", "blockquote", "pre") and 2 * b.links < len(b.text))

    return [b.text for b, p in zip(found, path) if stays(b, p)]


def main_text(page: str | None) -> str:
    return "\n\n".join(main_blocks(page)) if page else ""


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """(keys, text, n_chars) for each row."""
    python_ready(pages.sparkSession, 500)
    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys) + ", text string, n_chars long"

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keys, "text", "n_chars"])

    return pages.select(*keys, page).mapInArrow(tidy(run), schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
