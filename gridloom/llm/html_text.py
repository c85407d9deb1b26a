"""Main text of web pages by tag-path ratios.

A page is read once into elements and text nodes.  The tag path of a block is the path of its
open block elements (tag and class; formatting inside a block and table cells count to the block).
For each path the text length, the punctuation and the share of linked text of its blocks are
summed; length and punctuation by block are fused into one ratio, lowered by links, and smoothed over
neighbouring blocks of one section.  A path's score is the mean over its blocks:

* paths whose score reaches a share of the scores' standard deviation hold content;
* the container of the content (an article or main element, else the deepest path with nearly all of it)
  gives the paths inside it that reach a much lower share, and its headings.

So the scores decide inside a container as well.  Elements that by their tag are never content
(menus, footers, sidebars, buttons, scripts) are left out.  Class names, roles, forms and headers only hint: a
name that says so plainly takes its element out unless that holds most of the page's text, a name
that may mean something else (``no-sidebar``, ``tags-page``) lowers scores.  If nothing is left, hints are ignored.

Paths are numbers in a tree of paths, so deep nesting costs no more than flat pages.
A page is handled alone, so nothing is shuffled and no host is hot.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import kernels as K

#: A path holds content from this share of the scores' standard deviation on.
THRESHOLD = 0.25
#: Paths inside the content's container need this share of that bound.
INSIDE = 0.02
#: Standard deviation, in blocks, of the smoothing.
SMOOTHING = 1.0
#: The container has at least this share of the content's characters; an article or main element counts from the rest on.
CONTAINED = 0.9
#: Factors on the score: of text in links, of ambiguous names, of what lies outside the page's article or main.
LINKED, AMBIGUOUS, OUTSIDE = 0.05, 0.3, 0.05

_TEXT = re.compile(r"[^<]++")
_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.DOTALL)
_TAG = re.compile(r"""</?[a-zA-Z](?:"[^"]*+"|'[^']*+'|[^'">])*+>""")
_BROKEN_TAG = re.compile(r"</?[a-zA-Z][^>]*+(?:>|\Z)")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_LABELS = re.compile(r"""\s(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_PUNCTUATION = re.compile(r"[,.;:!?…，。；：！？、]")

# Elements by what they do in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video select xmp noembed noframes".split())
RAW_TO_END = frozenset("script style textarea title xmp".split())
NEVER = frozenset("nav footer aside button dialog head menu label datalist".split())
HINTED = frozenset("form fieldset header".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input label button".split())
CELLS = frozenset("td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_LEVEL = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre table thead tbody tfoot tr caption figure figcaption address details summary hgroup center".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = frozenset("ul ol dl table article section main body html div".split())
# Words in class and id names, and roles, of what is no content; and words that turn such a name into something else.
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus".split())
HEADER_WORDS = frozenset("header headers masthead topbar".split())
UNWANTED_WORDS = COMMENT_WORDS | HEADER_WORDS | frozenset(
    "ad ads advert adverts advertisement advertisements adsense banner banners sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay"
    " sidebar sidebars side widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer footers related recommended share sharing social newsletter subscribe signup login search pagination pager skip toolbar tags".split()
)
MODIFIERS = frozenset("no not non without with has have by under below above and show hide is page pages layout template theme view enabled disabled".split())
UNWANTED_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar form".split())

_PLAIN, _MAYBE, _HEADER, _SAYS, _COMMENTS, _NEVER = range(6)


def _hint(tag: str, attributes: str) -> tuple[int, str]:
    """What an element's tag, role, class or id says of it, and its label in paths."""
    if not attributes:
        return (_NEVER if tag in NEVER else _HEADER if tag == "header" else _SAYS if tag in HINTED else _PLAIN), tag
    said, label = _PLAIN, tag
    for key, a, b, c in _LABELS.findall(attributes):
        key, value = key.lower(), (a or b or c).strip()
        if key == "role":
            if value.lower() in UNWANTED_ROLES:
                said = max(said, _SAYS)
        elif key in ("hidden", "aria-hidden"):
            if value.lower() != "false":
                said = max(said, _SAYS)
        elif value:
            if label == tag:
                label = f"{tag}.{value}"
            for name in value.split():
                parts = _PARTS.split(name) if not name.islower() or not name.isalpha() else (name,)
                parts = [p.lower() for p in parts]
                if UNWANTED_WORDS.isdisjoint(parts):
                    continue
                if not MODIFIERS.isdisjoint(parts[1:] if parts[0] in ("page", "pages") else parts):
                    said = max(said, _MAYBE)
                elif not COMMENT_WORDS.isdisjoint(parts):
                    said = max(said, _COMMENTS)
                else:
                    said = max(said, _HEADER if not HEADER_WORDS.isdisjoint(parts) else _SAYS)
    if tag in NEVER:
        return _NEVER, label
    if tag in ("html", "body", "article", "main"):
        return (said if said == _COMMENTS else _PLAIN), label
    if tag == "header":
        return max(said, _HEADER), label
    return (max(said, _SAYS) if tag in HINTED else said), label


@dataclass
class _Page:
    """Elements and paths by number, parents before children; text nodes in page order."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    said: list[int] = field(default_factory=lambda: [_PLAIN])
    held: list[bool] = field(default_factory=lambda: [False])  # inside an article or main
    linked: list[bool] = field(default_factory=lambda: [False])
    path: list[int] = field(default_factory=lambda: [0])
    section: list[int] = field(default_factory=lambda: [0])  # the element whose blocks are smoothed together
    path_parent: list[int] = field(default_factory=lambda: [0])
    path_tag: list[str] = field(default_factory=lambda: [""])
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # element, block, text
    _paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def add(self, above: int, tag: str, attributes: str) -> int:
        said, label = _hint(tag, attributes)
        path = self.path[above]
        me = len(self.parent)
        if tag not in INLINE and tag not in CELLS:
            key = (path, label)
            path = self._paths.get(key)
            if path is None:
                path = self._paths[key] = len(self.path_parent)
                self.path_parent.append(self.path[above])
                self.path_tag.append(tag)
        self.parent.append(above)
        self.tag.append(tag)
        self.said.append(said)
        self.held.append(self.held[above] or tag in ("article", "main"))
        self.linked.append(self.linked[above] or tag == "a")
        self.path.append(path)
        self.section.append(self.section[above] if tag in INLINE or tag in CELLS or tag in TEXT_LEVEL else me)
        return me


def parse(source: str) -> _Page:
    """The page's elements and text nodes; text nodes of one block share its number."""
    page = _Page()
    stack: list[tuple[str, int]] = []  # tag, element
    where: dict[str, list[int]] = defaultdict(list)  # of each tag, its places in the stack
    bounds: list[int] = []  # places of BOUNDS in the stack
    unclosed: set[str] = set()  # raw elements that nothing ahead closes
    block, at, end, broken = 0, 0, len(source), False

    def cut(k: int) -> None:
        while len(stack) > k:
            tag, _ = stack.pop()
            where[tag].pop()
            if tag in BOUNDS:
                bounds.pop()

    while at < end:
        here = stack[-1][1] if stack else 0
        m = _TEXT.match(source, at)
        if m:
            page.texts.append((here, block, html.unescape(m[0]) if "&" in m[0] else m[0]))
            at = m.end()
            continue
        m = _SKIP.match(source, at)
        if m:
            at = m.end()
            continue
        m = None if broken else _TAG.match(source, at)
        if m is None:
            m = _BROKEN_TAG.match(source, at)
            if m is None:
                page.texts.append((here, block, "<"))
                at += 1
                continue
            broken = True  # quotes don't close: from here on a tag ends at the next >
        token = m[0]
        at = m.end()
        name = _NAME.match(token)
        tag = name[1].lower()
        if token[1] == "/":
            if where[tag]:
                cut(where[tag][-1])
            if tag not in INLINE and tag not in CELLS:
                block += 1
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                close = None if tag in unclosed else re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.IGNORECASE).search(source, at)
                if close:
                    at = close.end()
                elif tag in RAW_TO_END:
                    at = end
                else:
                    unclosed.add(tag)
            continue
        if tag in VOID:
            if tag == "br":
                page.texts.append((here, block, " "))
            elif tag == "hr":
                block += 1
            continue
        closes = ("p",) if tag in CLOSES_P else CLOSES_OWN.get(tag, ())
        first = max((where[c][-1] for c in closes if where[c]), default=-1)
        if first > (bounds[-1] if bounds else -1):
            while first and stack[first - 1][0] in closes:
                first -= 1
            cut(first)
            here = stack[-1][1] if stack else 0
        if tag in CELLS:
            page.texts.append((here, block, " "))
        elif tag not in INLINE:
            block += 1
        if not token.endswith("/>") or tag not in ("a", "span", "div", "p"):
            where[tag].append(len(stack))
            if tag in BOUNDS:
                bounds.append(len(stack))
            stack.append((tag, page.add(here, tag, token[name.end() : -1])))
    return page


def _left_out(page: _Page, sizes: list[int], hints: bool) -> tuple[list[bool], list[float]]:
    """For each element: whether it is left out, and the factor of its names."""
    n = len(page.parent)
    out = [False] * n
    for k in range(1, n):
        out[k] = out[page.parent[k]] or page.said[k] == _NEVER

    def sums() -> tuple[list[int], list[int], list[int]]:
        """For each element, of what isn't left out: text, article and main elements with text, and first headings in it."""
        text, main, title = [0] * n, [0] * n, [0] * n
        for (k, _, _), size in zip(page.texts, sizes, strict=True):
            text[k] += 0 if out[k] else size
        for k in range(n - 1, 0, -1):
            main[k] += text[k] > 0 and page.tag[k] in ("article", "main")
            title[k] += text[k] > 0 and page.tag[k] == "h1"
            for total in (text, main, title):
                total[page.parent[k]] += total[k]
        return text, main, title

    if hints:
        text, _, title = sums()
        for k in range(1, n):
            out[k] = out[k] or out[page.parent[k]] or page.said[k] == _COMMENTS and not (2 * text[k] > text[0] and title[k])
    text, main, title = sums()
    factor = [1.0] * n
    for k in range(1, n):
        above = page.parent[k]
        said, most = page.said[k], 2 * text[k] > text[0]
        # a plain name is believed even of most of the text where the page's article or title lies outside
        body = most and (main[k] > 0 if main[0] else title[k] > 0 or not title[0] or 10 * text[k] > 8 * text[0])
        saved = body if said == _SAYS and page.tag[k] not in HINTED else most
        gone = said == _SAYS and not saved or said == _HEADER and not (saved or page.held[above])
        out[k] = out[k] or out[above] or hints and gone
        factor[k] = min(factor[above], AMBIGUOUS if said == _MAYBE and not most else 1.0)
    return out, factor


def _smooth(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Gaussian means over neighbours of the same run."""
    total, weights = values.copy(), np.ones(len(values))
    for step in range(1, min(int(3 * SMOOTHING), len(values) - 1) + 1):
        weight = np.exp(-0.5 * (step / SMOOTHING) ** 2) * (run[step:] == run[:-step])
        total[step:] += weight * values[:-step]
        total[:-step] += weight * values[step:]
        weights[step:] += weight
        weights[:-step] += weight
    return total / weights


def _chosen(page: _Page, blocks: dict[int, list[int]], sizes: list[int], factor: list[float], threshold: float) -> np.ndarray:
    """For each path, whether its text is content; ``blocks`` has the numbers of each block's text nodes."""
    n = len(page.path_parent)
    path, run, length, marks, linked, factors = [], [], [], [], [], []
    for members in blocks.values():
        first = page.texts[members[0]][0]
        path.append(page.path[first])
        run.append(page.section[first])
        length.append(sum(sizes[k] for k in members))
        marks.append(sum(len(_PUNCTUATION.findall(page.texts[k][2])) for k in members))
        linked.append(sum(sizes[k] for k in members if page.linked[page.texts[k][0]]))
        factors.append(min(factor[page.texts[k][0]] for k in members))
    path, length = np.array(path), np.array(length, float)
    by = lambda x: np.bincount(path, x, n)
    count = np.maximum(by(None), 1)
    total = by(length)
    ratio = total / count * (1 + by(np.array(marks, float)) / count)
    ratio *= 1 - (1 - LINKED) * by(np.array(linked, float)) / np.maximum(total, 1)
    run = np.cumsum(np.diff(np.array(run), prepend=-1) != 0)
    score = by(_smooth(ratio[path], run) * np.array(factors)) / count

    parent, tag = page.path_parent, page.path_tag
    within = total.copy()  # text below each path
    for p in range(n - 1, 0, -1):
        within[parent[p]] += within[p]
    named = np.zeros(n, bool)  # below an article or main that holds a share of the text
    for p in range(1, n):
        named[p] = named[parent[p]] or tag[p] in ("article", "main") and within[p] >= (1 - CONTAINED) * within[0]
    if named.any():
        score = np.where(named, score, score * OUTSIDE)
    bound = min(threshold * float(score[path].std()), float(score[path].max()))
    present = np.bincount(path, minlength=n) > 0
    content = present & (score >= bound)

    weight = np.where(content, total, 0.0)
    for p in range(n - 1, 0, -1):
        weight[parent[p]] += weight[p]
    if named.any():
        container = named
    else:
        deepest = 0
        for p in range(1, n):  # children come after parents, and at most one child of each holds so much
            if parent[p] == deepest and weight[p] >= CONTAINED * weight[0] and tag[p] not in TEXT_LEVEL:
                deepest = p
        container = np.zeros(n, bool)
        container[deepest] = deepest > 0 and tag[deepest] not in ("html", "body")
        for p in range(1, n):
            container[p] |= container[parent[p]]
        container[deepest] = False  # text that lies in it directly: elements of its path elsewhere may have it
    section = np.zeros(n, np.int64)  # of each path, the nearest one that isn't of the text itself
    for p in range(1, n):
        section[p] = section[parent[p]] if tag[p] in TEXT_LEVEL else p
    beside = np.zeros(n, bool)
    beside[section[content]] = True
    text_level = np.array([t in TEXT_LEVEL for t in tag])
    heading = np.array([t in HEADINGS for t in tag])
    near = container | beside[section] & text_level
    return content | present & near & ((score >= INSIDE * bound) | heading & (score > 0))


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    """The main text: blocks in page order joined by two newlines, white space inside a block as one space."""
    page = parse(source or "")
    sizes = [len(t) - t.count(" ") if not t.isspace() else 0 for _, _, t in page.texts]
    for hints in (True, False):
        out, factor = _left_out(page, sizes, hints)
        blocks: dict[int, list[int]] = {}
        for k, (element, block, _) in enumerate(page.texts):
            if not out[element]:
                blocks.setdefault(block, []).append(k)
        blocks = {b: members for b, members in blocks.items() if any(sizes[k] for k in members)}
        if blocks:
            chosen = _chosen(page, blocks, sizes, factor, threshold)
            kept = (m for m in blocks.values() if chosen[page.path[page.texts[m[0]][0]]])
            return "\n\n".join(t for m in kept if (t := " ".join("".join(page.texts[k][2] for k in m).split())))
    return ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.slices(batch, "html"):
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    Takes ``page_id``, ``url`` and ``html``; other columns are ignored.  Null and empty
    pages, and pages without content, have the empty text.  Null ids and urls stay;
    repeated rows are extracted each; an empty table gives no rows.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
