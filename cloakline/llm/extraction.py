"""Main text of web pages by composite text density.

The html is cut into tags and text and put together as a tree (void elements,
implied end tags and tags never closed as browsers have them).  Parts that
their element, role or class names as no article text (menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, reader comments) are
marked first and count for nothing.  For every other node below body

    density = C / T * log(C / LC * T / LT) to the base ln(C / notLC * LC + LCb / Cb * C + e)

with C its characters, T its tags, LC and LT those in links, notLC = C - LC,
b the body, and each divisor at least 1: characters per tag, less where links
hold them.  A node's sum is the total of its children's densities.  The node
with the largest sum is where the article is; the least density on its path
from body is the threshold.  Every topmost node of that density holds content,
of which the subtree with the largest sum is kept; in the same way below.

Where a page has ``article`` or ``main`` elements, or parts named as an article, the
search is among their nodes, and a kept subtree stands for all of its element:
short blocks of an article (headings, one-line paragraphs) are less dense than
the threshold and belong to it all the same.  Elsewhere a kept subtree takes
along the headings beside the nodes on its path.

Blocks are the stretches of text between block elements; ``br`` is white space.
White space is what Python's ``str.split`` takes as such, the no-break space too.

Defined cases: null html is empty and gives an empty text; a page without tags is
one block; html that ends within a tag, comment or script loses that piece
alone; null urls and ids are passed on; repeated rows are handled one by one;
an empty table gives an empty result; extra columns are ignored.  Time and
memory are in proportion to the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.llm.common import slices
from cloakline.session import read_table

# Element names of the HTML standard by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
                  "table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: an opening tag ends these, up to the nearest element of the second set
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
          "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "a": ({"a"}, {"table", "td", "th"}),
          "body": ({"head"}, set())}
CLOSES_P = BLOCK - {"body", "html", "head", "caption", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}

# What names a part that is no article text.
JUNK = frozenset("head script style noscript template textarea title iframe noembed noframes xmp svg math nav footer aside form button select "
                 "input object canvas dialog menu search datalist audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted "
                  "sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar header pagination pager "
                  "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
                  "share sharing social related recommended widget toolbar skip adbox adslot adunit adbanner adcontainer".split())
#: and words that end so: "topnav", "sitefooter", "usercomments"
ENDINGS, COMMENT_ENDINGS = ("nav", "menu", "sidebar", "footer", "banner", "navigation", "breadcrumbs"), ("comments", "commentlist")
#: "no-sidebar" says how the page is laid out
LAYOUT = frozenset("has no with without".split())
#: a part named by the first set, with nothing but the second beside it, is an article
ARTICLE = frozenset("article post entry story".split())
BESIDE = ARTICLE | frozenset("content body main text single blog news".split())

ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+))?+|=)*+"""
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(" + ATTRIBUTES + r")(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MARKS = ("class", "id", "role", "hidden", "style", "aria-")
OUT = "page_id long, url string, text string, n_chars long"


class Tree:
    """Nodes in page order; text runs with the node that holds them (node 0 is the document)."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.marks = [""], [-1], [""]
        self.flow: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a block begins or ends
        open_, at = [0], 0
        self.held: Counter[str] = Counter()  # open elements by name
        for m in iter(TOKEN.scanner(page).search, None):
            if m.start() < at:
                continue  # inside a script
            if m.start() > at:
                self.flow.append((open_[-1], page[at:m.start()]))
            at = m.end()
            if not m[2] or (m[4] != ">"):
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(open_, tag)
                continue
            self._implied(open_, tag)
            node = self._add(open_[-1], tag, m[3])
            if tag in BLOCK or tag == "br":
                self.flow.append((node, None if tag != "br" else " "))
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?|\\Z", re.I).search(page, at)
                at = end.end()
            elif tag not in VOID:
                open_.append(node)
                self.held[tag] += 1
        if at < len(page):
            self.flow.append((open_[-1], page[at:]))

    def _add(self, parent: int, tag: str, marks: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.marks.append(marks)
        return len(self.tag) - 1

    def _pop(self, open_: list[int], to: int) -> None:
        for node in open_[to:]:
            self.held[self.tag[node]] -= 1
            if self.tag[node] in BLOCK:
                self.flow.append((self.parent[node], None))
        del open_[to:]

    def _close(self, open_: list[int], tag: str) -> None:
        if tag in ("body", "html") or not self.held[tag]:
            return  # what follows belongs to the page still
        for k in range(len(open_) - 1, 0, -1):
            if self.tag[open_[k]] == tag:
                self._pop(open_, k)
                return
            if tag not in BLOCK and self.tag[open_[k]] in BLOCK:
                return  # an inline end tag closes no block
            if self.tag[open_[k]] in ("table", "body") and tag != self.tag[open_[k]] and tag in ("p", "li", "dd", "dt"):
                return

    def _implied(self, open_: list[int], tag: str) -> None:
        ends, walls = CLOSES.get(tag, (set(), set()))
        if tag in CLOSES_P:
            ends, walls = ends | {"p"}, walls | {"td", "th", "table", "button", "object"}
        if tag in HEADING:
            ends = ends | HEADING
        if not any(self.held[name] for name in ends):
            return
        lowest = None
        for k in range(len(open_) - 1, 0, -1):
            name = self.tag[open_[k]]
            if name in walls:
                break
            if name in ends:
                lowest = k
            elif name in BLOCK and name not in ends and not (tag in CLOSES and name not in walls and tag != "a"):
                break
        if lowest is not None:
            self._pop(open_, lowest)


def _named(marks: str) -> tuple[dict[str, str], list[set[str]]]:
    """Attributes of a tag, and the words of its id and of each of its classes."""
    if not any(m in marks.lower() for m in MARKS):
        return {}, []
    given = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(marks)}
    return given, [{w.lower() for w in NAME.findall(value)} for value in (given.get("id", ""), *given.get("class", "").split())]


def _says(names: set[str], known: frozenset[str], endings: tuple[str, ...]) -> set[str]:
    return {n for n in names if n in known or n.endswith(endings)}


def _kind(tag: str, marks: str, inside: bool) -> str:
    """What an element is by its name: "junk", "layout" (junk unless it holds the article), "home" (an article) or ""."""
    if tag in JUNK:
        return "junk"
    given, names = _named(marks) if tag not in ("html", "body") else ({}, [])
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", ""), re.I):
        return "junk"
    if given.get("role", "").lower() in ROLES or any(_says(n, COMMENTS, COMMENT_ENDINGS) for n in names):
        return "junk"
    if tag == "main" or given.get("role", "").lower() in ("main", "article"):
        return "home"
    if tag == "header" and not inside:
        return "layout"
    if tag not in HEADING and any((junk := _says(n, NAMES, ENDINGS)) and not n & LAYOUT and not (inside and junk == {"header"}) for n in names):
        return "layout"
    return "home" if tag == "article" or any(n & ARTICLE and n <= BESIDE for n in names) and tag in ("div", "section") else ""


def _parts(tree: Tree) -> tuple[list[bool], list[int]]:
    """Which nodes are no article text, and the element around each that is the article (0: none): the nearest ``article``, else the outermost other."""
    tag, parent, size = tree.tag, tree.parent, len(tree.tag)
    kind, home, holds = [""] * size, [0] * size, [False] * size
    for k in range(1, size):
        p = parent[k]
        kind[k] = "junk" if kind[p] == "junk" else _kind(tag[k], tree.marks[k], home[p] > 0)
        home[k] = k if kind[k] == "home" and (tag[k] == "article" or not home[p]) else home[p]
    homes = {h for h, name in zip(home, kind, strict=True) if h and name != "junk"}
    titles = [k for k in range(1, size) if tag[k] == "h1" and kind[k] != "junk"]
    for k in homes or titles[-1:]:
        k = parent[k]
        while k > 0 and not holds[k]:
            holds[k] = True
            k = parent[k]
    none = [False] * size
    for k in range(1, size):
        none[k] = none[parent[k]] or kind[k] == "junk" or (kind[k] == "layout" and not holds[k])
    return none, [0 if off else h for off, h in zip(none, home, strict=True)]


def _densities(tree: Tree, flow: list[tuple[int, str | None]], none: list[bool], body: int) -> tuple[list[float], list[float]]:
    """Composite text density of every node, and the sum over its children."""
    tag, parent, size = tree.tag, tree.parent, len(tree.tag)
    link = [False] * size
    chars, linked, tags, link_tags = [0] * size, [0] * size, [0] * size, [0] * size
    for k in range(1, size):
        link[k] = link[parent[k]] or tag[k] == "a"
    for node, text in flow:
        if text and not none[node]:
            n = len(" ".join(text.split()))
            chars[node] += n
            linked[node] += n * link[node]
    for k in range(size - 1, 0, -1):
        p = parent[k]
        if not none[k]:
            chars[p] += chars[k]
            linked[p] += linked[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + link[k]
    share = linked[body] / max(chars[body], 1)
    density, total = [0.0] * size, [0.0] * size
    for k in range(size):
        if chars[k] and not none[k]:
            c, t, lc, lt = chars[k], max(tags[k], 1), max(linked[k], 1), max(link_tags[k], 1)
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            density[k] = c / t * max(math.log(c / lc * t / lt), 0.0) / math.log(base)
            if k:
                total[parent[k]] += density[k]
    return density, total


def _kept(tree: Tree, density: list[float], total: list[float], none: list[bool], home: list[int], body: int) -> list[bool]:
    """Which nodes lie in a kept subtree."""
    tag, parent, size = tree.tag, tree.parent, len(tree.tag)
    some = any(home)  # then the article is in such an element
    fit = [k for k in range(size) if not none[k] and (home[k] or not some)]
    best = max(fit, key=lambda k: (total[k], density[k], -k))
    threshold, k = density[best], best
    while k not in (body, 0):
        k = parent[k]
        threshold = min(threshold, density[k])
    # the largest sum at or below each node, and where it is
    top = list(range(size))
    for k in range(size - 1, 0, -1):
        if not none[k] and total[top[k]] > total[top[parent[k]]]:
            top[parent[k]] = top[k]
    chosen, under = {best}, [False] * size
    for k in fit:
        under[k] = k > 0 and under[parent[k]]
        if not under[k] and density[k] >= threshold > 0 and k > body and tag[k] != "body":
            chosen.add(top[k])
            under[k] = True
    kept, path = [False] * size, [False] * size
    for k in chosen:
        kept[home[k] or k] = True
        while not home[k] and k > 0 and not path[k]:
            path[k] = True
            k = parent[k]
    for k in range(1, size):
        kept[k] = kept[k] or kept[parent[k]] or (tag[k] in HEADING and path[parent[k]])
    return kept


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by a blank line."""
    tree = Tree(page or "")
    flow = [(node, text and html.unescape(text)) for node, text in tree.flow]
    body = next((k for k, name in enumerate(tree.tag) if name == "body"), 0)
    none, home = _parts(tree)
    kept = _kept(tree, *_densities(tree, flow, none, body), none, home, body)
    blocks, words = [], []
    for node, text in [*flow, (0, None)]:
        if text is None:
            block = " ".join("".join(words).split())
            if block:
                blocks.append(block)
            words = []
        elif kept[node] and not none[node]:
            words.append(text)
    return "\n\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html) the columns OUT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            text = pa.array([main_text(page) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), text, pc.cast(pc.utf8_length(text), pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, OUT)


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))
