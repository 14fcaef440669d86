"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path (tag names with the words of class
and id) and lies in a container: the path up to its last sectioning element.
Paragraphs, headings, lists, tables and inline elements are no containers, and
an article or main element is one with all that is in it.

*Ratios.*  Per path the characters and the punctuation marks of its nodes are
summed up; a path's characters count in full when they hold a mark every
``MARK_EVERY`` characters, less when they hold fewer, and a fifth as links.
*Fuse.*  These sums are added up per container; its score is the logarithm, so
that neither one long text block nor many of them push others below the
threshold.  Article and main elements score ``CONTENT_PRIOR`` times as much;
containers with telling names (adverts, comments, notices) ``NOISE_PRIOR``, and
outside content elements blocks of nothing but links ``LINKS_PRIOR``.
*Smooth.*  A node between nodes of higher scores is raised by a Gaussian window
over its neighbours of the same kind; the edge of a run is not.
*Threshold.*  Nodes below ``SHARE`` of the best container's score are dropped.

Left out whatever the scores: scripts, styles and hidden elements, and menus,
footers, asides and page headers as the markup names them.  Forms and layout
words (has-sidebar) mark a wrapper, not its contents: a container that holds
most of the page's text under such a name counts as plain, and an article or
main element inside one is content.  Names on headings mean nothing.

Markup is read by one regular expression; unclosed and stray tags are put
right as browsers do for the common cases (a paragraph ends at the next block,
a list item at the next item, an end tag without a start is skipped).

Defined cases: null or empty html gives an empty text; a page without tags is
one block; a page all of whose nodes weigh nothing has no text; repeated rows
are handled one by one; text is never shortened; further columns, whatever
their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors of a score: article and main elements, noise by name, blocks of nothing but links; share of the best score that a node must reach.
CONTENT_PRIOR, NOISE_PRIOR, LINKS_PRIOR, SHARE = 1.5, 0.15, 0.3, 0.65
#: Characters per punctuation mark of running text; weight of text without marks, and of links.
MARK_EVERY, UNMARKED, LINK_WEIGHT = 60, 0.25, 0.2
#: Gaussian weights by distance in nodes.
KERNEL = [math.exp(-d * d / 2) for d in range(3)]
WINDOW = 2 * sum(KERNEL) - KERNEL[0]

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|[^<]+|<", re.S)
NAMES = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
MARKS = re.compile(r"[.,;:!?…。，、；：！？\"'()«»“”‘’-]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
                  "section select summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the kinds named, looked for up to the first of the bounds.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
        "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
        "option": (("option",), ("select",)), "body": (("head",), ())}
NOISE_TAGS = frozenset("nav footer aside button select dialog menu search head object audio video canvas".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: Blocks that make no container of their own.
TEXT_TAGS = frozenset("address blockquote caption center dd details dir dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol optgroup "
                      "option p pre summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role names that mark what is not the article; those of the second list also name page layouts.
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments "
                        "consent cookie cookies copyright disqus dialog footer gdpr login masthead menu menus modal nav navbar "
                        "navigation newsletter notice notices overlay pager pagination popup popups promo promos promoted related "
                        "recommended replies reply respond share sharing shares sidebar sidebars signup social sponsor sponsored "
                        "subscribe subscription teaser toolbar widget widgets complementary contentinfo skip tags toc".split())
LAYOUT_WORDS = frozenset("banner login masthead menu menus nav navbar navigation sidebar sidebars toolbar widget widgets".split())
CONTENT_WORDS = frozenset("article story".split())
PLAIN, CONTENT, NOISE, HIDDEN = 0, 1, 2, 3


class Paths:
    """Tag paths of one page, by number: kind, container, innermost element with a telling name, inside a link."""

    def __init__(self):
        self.number: dict[tuple[int, str], int] = {}
        self.kind, self.box, self.link = [PLAIN], [0], [False]
        self.named = [-1]                               # the path of the innermost element whose name marks noise
        self.outer: dict[int, int] = {}                 # that element's next one outwards
        self.layout: set[int] = set()

    def child(self, parent: int, tag: str, attrs: str) -> int:
        names = ""
        hidden = False
        words: set[str] = set()
        if attrs and not attrs.isspace():
            for m in NAMES.finditer(attrs):
                value = m[2] or m[3] or m[4] or ""
                key = m[1].lower()
                if key == "hidden":
                    hidden = True
                elif key == "style":
                    hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif key == "aria-hidden":
                    hidden |= value.lower() == "true"
                else:
                    words.update(w.lower() for w in WORDS.findall(value))
            names = " ".join(sorted(words))
        key = (parent, f"{tag} {names}{'!' if hidden else ''}")
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.kind)
            self._add(found, parent, tag, words, hidden)
        return found

    def _add(self, own: int, parent: int, tag: str, words: set[str], hidden: bool) -> None:
        kind, named = self.kind[parent], self.named[parent]
        main = tag == "main" or (tag != "body" and "main" in words)
        if kind == HIDDEN or hidden or tag in RAW:
            kind = HIDDEN
        elif tag in NOISE_TAGS or (tag == "header" and kind != CONTENT):
            kind = NOISE
        elif main or (kind != NOISE and tag == "article"):
            kind, named = CONTENT, -1
        elif kind == PLAIN and words & CONTENT_WORDS:
            kind = CONTENT
        noise = words & NOISE_WORDS
        if tag == "form" or (noise and tag not in ("html", "body", "article", "main") and tag not in HEADINGS):
            self.outer[own] = named
            named = own
            if noise <= LAYOUT_WORDS:
                self.layout.add(own)
        same = kind == self.kind[parent] and named == self.named[parent]
        inside = same and (kind == CONTENT or tag not in BLOCK or tag in TEXT_TAGS)
        self.kind.append(kind)
        self.named.append(named)
        self.box.append(self.box[parent] if inside else own)
        self.link.append(self.link[parent] or tag == "a")

    def names(self, path: int) -> Iterator[int]:
        """The elements with telling names that the path lies in, from the inside."""
        at = self.named[path]
        while at >= 0:
            yield at
            at = self.outer[at]


def text_nodes(source: str) -> tuple[Paths, list[tuple[int, int, str]]]:
    """Paths and text nodes (path, block number, text) of a page in order."""
    paths = Paths()
    stack: list[tuple[str, int]] = [("", 0)]
    nodes: list[tuple[int, int, str]] = []
    block = at = 0
    match = TOKEN.match
    while at < len(source):
        m = match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                nodes.append((stack[-1][1], block, text))
            continue
        tag = tag.lower()
        if tag in BLOCK or tag in RAW:
            block += 1
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            nodes.append((stack[-1][1], block, " "))
        if tag in VOID:
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, 0, -1):      # an open paragraph ends here
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in ("button", "td", "th", "table", "object"):
                    break
        closes = ENDS.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closes[0]:
                    del stack[k:]
                    break
                if stack[k][0] in closes[1]:
                    break
        stack.append((tag, paths.child(stack[-1][1], tag, m[3])))
    return paths, nodes


def node_scores(paths: Paths, nodes: list[tuple[int, int, str]]) -> tuple[list[float], float]:
    """Smoothed score of every node, and the best container's."""
    count: dict[int, list[int]] = {}
    for p, _, t in nodes:
        have = count.setdefault(p, [0, 0])
        have[0] += len(t.strip())
        have[1] += len(MARKS.findall(t))
    mass: dict[int, float] = {}                         # by container
    under: dict[int, float] = {}                        # by element with a telling name
    whole = 0.0
    for p, (chars, marks) in count.items():
        w = chars * min(1.0, UNMARKED + (1 - UNMARKED) * marks * MARK_EVERY / chars) * (LINK_WEIGHT if paths.link[p] else 1.0)
        mass[paths.box[p]] = mass.get(paths.box[p], 0.0) + w
        whole += w
        for e in paths.names(p):
            under[e] = under.get(e, 0.0) + w
    score, best = {}, 0.0
    for box, w in mass.items():
        noise = any(not (e in paths.layout and 2 * under[e] > whole) for e in paths.names(box))
        score[box] = math.log2(1 + w) * (NOISE_PRIOR if noise else CONTENT_PRIOR if paths.kind[box] == CONTENT else 1.0)
        if not noise:
            best = max(best, score[box])
    plain = {b for p, b, _ in nodes if paths.kind[p] == CONTENT or not paths.link[p]}       # blocks that are more than links
    raw = [score[paths.box[p]] * (1.0 if b in plain else LINKS_PRIOR) for p, b, _ in nodes]
    kind = [(paths.kind[p], paths.named[p]) for p, _, _ in nodes]
    smooth = []
    for k, own in enumerate(raw):
        near = [j for j in range(max(0, k - 2), min(len(nodes), k + 3)) if kind[j] == kind[k]]
        weight = sum(KERNEL[abs(j - k)] for j in near) if near[0] < k < near[-1] else WINDOW
        smooth.append(max(own, sum(KERNEL[abs(j - k)] * raw[j] for j in near) / weight))
    return smooth, best


def main_text(source: str | None, share: float = SHARE) -> str:
    """Article text of a page, one line per block."""
    if not source:
        return ""
    paths, nodes = text_nodes(source)
    nodes = [(p, b, html.unescape(t) if "&" in t else t) for p, b, t in nodes if paths.kind[p] in (PLAIN, CONTENT)]
    solid = [x for x in nodes if not x[2].isspace()]
    smooth, best = node_scores(paths, solid)
    if not best:
        return ""
    lines: dict[int, list[str]] = {}
    scores = iter(smooth)
    for _, b, t in nodes:
        if t.isspace() or next(scores) >= share * best:
            lines.setdefault(b, []).append(t)
    blocks = (" ".join("".join(x).split()) for x in lines.values())
    return "\n".join(x for x in blocks if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch({"key": batch.column("key"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                               "n_chars": pa.array([len(x) for x in texts], pa.int64())})


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars): the main text of every page."""
    kind = dict(pages.dtypes)[key]
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(_extract, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
