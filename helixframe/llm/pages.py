"""HTML extraction by composite text density.

Each node of the document tree gets its characters per tag, adjusted for the part that lies in links. The densities of
the children are summed; the node with the largest sum is the core of the article. Nodes outside it are kept where
their own density reaches the smallest density on the path from the body to the core, as are headings and the
paragraphs between them and the core. On the path inside an article or main element, what is not mostly links is kept.
Parts that no reader counts as article (navigation, scripts, notices, adverts, reader comments, forms that do not wrap
the page) are left out of the tree before scoring.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from helixframe.llm.arrow import add_columns

#: Comments and declarations by their heads only; a tag needs its end.
TOKEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>", re.S)
OPENING = re.compile(r"<!--|<!\[CDATA\[|<[!?]()()()()()()")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("head script style noscript template nav footer aside button select option textarea iframe object svg canvas menu dialog title audio video map noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section table".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: An opening tag ends an open element of these, looked for up to the given container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
UNLIKELY = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar side-bar sidenav menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar masthead footer comment comments disqus respond reply replies share sharing social related recommended recommendations widget widgets alert disclaimer copyright skip".split())
#: Words for texts of their own; others may stand on a wrapper of the whole page.
ASIDE = frozenset("cookie cookies consent gdpr notice notices popup modal overlay alert disclaimer copyright comment comments disqus respond reply replies related recommended promo promotion sponsor sponsored sponsors".split())
#: A class or id with one of these speaks of the page's layout; a header with one of those is the article's.
LAYOUT = frozenset("no not has with without is js layout of to for".split())
#: Quotations and listings are text, whatever their class says; adverts are named as such.
QUOTED = frozenset("blockquote pre figure table h1 h2 h3 h4 h5 h6".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion".split())
OWN = frozenset("article entry post story content".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Break(str):
    """Stands between the texts of a node where a block ends without an element."""


BREAK = Break("\n")
ENDS = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}


class Node:
    __slots__ = ("tag", "parent", "items", "doubtful", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, doubtful: int = 0):
        self.tag, self.parent, self.items, self.doubtful = tag, parent, [], doubtful
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is left out for what it is, and how doubtful it is: 1 a form or by class or id, 2 a text aside."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True, 0
    doubtful = int(tag == "form")
    if tag in ("html", "body", "main") or not attributes:
        return False, doubtful
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for word in value.split():
                parts = frozenset(re.split(r"[^a-z0-9]+", word))
                if not parts.isdisjoint(ADVERTS if tag in QUOTED else UNLIKELY) and parts.isdisjoint(LAYOUT) or "header" in parts and not in_article and parts.isdisjoint(LAYOUT | OWN):
                    doubtful = max(doubtful, 1 + (not parts.isdisjoint(ASIDE)))
        elif tag != "article" and (name == "role" and value in ROLES and not (tag == "form" and value == "form") or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True, doubtful
    return False, doubtful


def _prune(root: Node) -> None:
    """Take out doubtful elements, but for those that hold the page's article.

    That is an article or main element which is not doubtful itself; on pages without one, more than half of the text
    outside links. A text aside with that much stands only with the page's h1 in it, or where nothing else would be left.
    """
    nodes = in_order(root)
    holds: set[int] = set()
    for node in reversed(nodes):
        if node.parent is not None and not (node.doubtful and id(node) not in holds) and (node.tag in ("article", "main") or id(node) in holds):
            holds.add(id(node.parent))
    if any(n.doubtful and id(n) not in holds for n in nodes):
        prose, titled = _prose_chars(nodes, set()), {id(n) for n in nodes if n.tag == "h1"}
        marked = any(n.tag in ("article", "main") and (not n.doubtful or id(n) in holds) and prose[id(n)] for n in nodes)
        for node in reversed(nodes):
            if id(node) in titled and node.parent is not None:
                titled.add(id(node.parent))
        most = {id(n): n for n in nodes if n.doubtful and not marked and 2 * prose[id(n)] > prose[id(root)]}
        holds.update(k for k, n in most.items() if n.doubtful == 1 or k in titled)
        if not _prose_chars(nodes, {id(n) for n in nodes if n.doubtful and id(n) not in holds})[id(root)]:
            holds.update(most)
    for node in nodes:
        node.items = [x for x in node.items if isinstance(x, str) or not x.doubtful or id(x) in holds]


def _prose_chars(nodes: list[Node], without: set[int]) -> dict[int, int]:
    """Characters outside links of nodes, parents first, without those of some parts."""
    chars: dict[int, int] = dict.fromkeys(map(id, nodes), 0)
    for node in reversed(nodes):
        if node.tag == "a" or id(node) in without:
            chars[id(node)] = 0
            continue
        chars[id(node)] += sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        if node.parent is not None:
            chars[id(node.parent)] += chars[id(node)]
    return chars


@functools.lru_cache(4096)
def _kinds(tag: str) -> tuple[str, ...]:
    """The tag and the kinds of elements it belongs to."""
    sets = {"#block": BLOCKS, "#container": CONTAINERS, "#article": ("article", "main")}
    return tag, *(kind for kind, tags in sets.items() if tag in tags)


def parse(source: str) -> Node:
    """The tree of kept elements; texts stand in ``items`` between the child nodes. Any input gives a tree."""
    root = Node("body", None)
    stack: list[tuple[str, Node | None]] = [("#root", root)]  # None: inside a part that is left out
    places: dict[str, list[int]] = {}  # depths of the open elements of a tag, and of those of a kind
    at, end = 0, len(source)
    last = source.rfind(">") + 1  # no tag ends behind it

    def deepest(*names: str) -> int:
        return max((places[x][-1] for x in names if places.get(x)), default=0)

    def push(tag: str, child: Node | None) -> None:
        for kind in _kinds(tag):
            places.setdefault(kind, []).append(len(stack))
        stack.append((tag, child))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            for kind in _kinds(stack.pop()[0]):
                places[kind].pop()

    def text(chunk: str) -> None:
        node = stack[-1][1]
        if node is not None and chunk:
            node.items.append(html.unescape(chunk) if "&" in chunk else chunk)

    match = TOKEN.search(source, 0, last) or OPENING.search(source, last)
    while match:
        text(source[at : match.start()])
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if tag is None:
            close = source.find(ENDS[match[0]], at)
            if match[0] == "<![CDATA[":
                text(source[at : close if close >= 0 else end])
            at = close + len(ENDS[match[0]]) if close >= 0 else end
        elif closing:
            tag = tag.lower()
            depth = deepest(tag)
            if depth and (tag in BLOCKS or depth > deepest("#block")) and not (tag in ("p", "li") and depth < deepest("#container")):
                pop_to(depth)
        else:
            tag = tag.lower()
            node = stack[-1][1]
            if tag in VOID:
                if node is not None:
                    node.tags += 1
                    if tag in ("br", "hr"):
                        node.items.append(" " if tag == "br" else BREAK)
            else:
                if tag in CLOSES_P and (depth := deepest("p")) and depth == deepest("#block"):
                    pop_to(depth)
                if tag in IMPLIED:
                    ended, containers = IMPLIED[tag]
                    outside = deepest(*containers)
                    inner = [open_at[i] for x in ended if (open_at := places.get(x)) and (i := bisect.bisect(open_at, outside)) < len(open_at)]
                    if inner:
                        pop_to(min(inner))
                node = stack[-1][1]
                child = None
                if node is not None:
                    out, doubtful = _left_out(tag, attributes, bool(places.get("#article")))
                    if not out:
                        child = Node(tag, node, doubtful)
                        node.items.append(child)
                if tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at, max(at, last))
                    at = close.end() if close else end
                elif not attributes.endswith("/") or tag not in ("path", "circle", "use", "rect"):
                    push(tag, child)
        # Behind the last ">" only comments and the like can begin.
        match = TOKEN.search(source, at, last) if at < last else None
        match = match or OPENING.search(source, max(at, last))
    text(source[at:])
    _prune(root)
    return root


def in_order(root: Node) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(x for x in node.items if isinstance(x, Node))
    return found


def score(root: Node) -> list[Node]:
    """Fill in counts, densities and the sums of the children's densities; all nodes, parents first."""
    nodes = in_order(root)
    for node in reversed(nodes):
        node.chars += sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, max(node.tags, 1)
        if node.parent is not None:
            up = node.parent
            up.chars, up.tags = up.chars + node.chars, up.tags + node.tags + 1
            up.link_chars, up.link_tags = up.link_chars + node.link_chars, up.link_tags + node.link_tags
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            node.density = c / t * (math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(base) if base > 1.0000001 else math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)))
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def blocks(kept: list[Node | str]) -> list[str]:
    """Texts of the blocks of kept nodes and texts, in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(parts).split())
        if joined:
            out.append(joined)
        parts.clear()

    todo: list = [*reversed(kept)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if x is BREAK:
                flush()
            parts.append(x)
        else:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(source: str | None) -> str:
    """The article of a page: its blocks joined by newlines, white space inside a block as one space."""
    if not source:
        return ""
    root = parse(source)
    nodes = score(root)
    core = max(nodes, key=lambda n: n.total)
    if core.total <= 0:
        core = root
    path, node = [], core
    while node is not None:
        path.append(node)
        node = node.parent
    least = min(n.density for n in path)
    on_path = {id(n): k for k, n in enumerate(path)}
    # Where the path enters an article or main element; what lies inside is kept unless it is links.
    inner = max((k for k, n in enumerate(path) if n.tag in ("article", "main")), default=-1)
    kept: list = []
    todo: list = [(root, False)]
    while todo:
        x, near = todo.pop()
        if isinstance(x, str) or x is core:
            kept.append(x)
        elif id(x) in on_path:
            if x is not root:
                kept.append(BREAK)
                todo.append((BREAK, False))
            leads = _leads(x, on_path)
            todo.extend(reversed([(y, on_path[id(x)] <= inner or id(y) in leads) for y in _candidates(x, on_path)]))
        elif x.density >= least or x.tag not in BLOCKS or _prose(x) and (near or x.tag in HEADINGS):
            kept.append(x)
        else:
            todo.extend(reversed([(y, False) for y in x.items if isinstance(y, Node) and (y.tag in BLOCKS and y.tag not in HEADINGS or y.tag == "h1")]))
    return "\n".join(blocks(kept))


def _prose(node: Node) -> bool:
    """Most of the text is no link."""
    return 2 * node.link_chars < node.chars


def _candidates(node: Node, on_path: dict[int, int]) -> list[Node | str]:
    """Items of a node on the path, without runs of texts and inline elements that are mostly links."""
    out: list = []
    run: list = []

    def flush() -> None:
        chars = sum(len("".join(x.split())) if isinstance(x, str) else x.chars for x in run)
        if 2 * sum(x.link_chars for x in run if isinstance(x, Node)) < chars:
            out.extend(run)
        run.clear()

    for x in node.items:
        if isinstance(x, Node) and (x.tag in BLOCKS or id(x) in on_path):
            flush()
            out.append(x)
        elif x is BREAK:
            flush()
            out.append(x)
        else:
            run.append(x)
    flush()
    return out


def _leads(node: Node, on_path: dict[int, int]) -> set[int]:
    """The paragraphs of a node on the path between a heading and the core, as the lead of an article stands."""
    leads: set[int] = set()
    headed = False
    for x in node.items:
        if isinstance(x, Node):
            if id(x) in on_path:
                return leads
            if x.tag == "p" and headed:
                leads.add(id(x))
            headed = headed or x.tag in HEADINGS and _prose(x)
    return set()


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each whole page, and ``n_chars``, its code points.

    A null, empty or markup-only page gives an empty text. One output row per input row; input columns called text or
    n_chars are replaced. An empty table gives an empty table.
    """
    at = pages.columns.index(html_col)

    def compute(column: int):
        def run(batch: pa.RecordBatch) -> list:
            texts = [main_text(x) for x in batch.column(column).to_pylist()]
            return [texts, [len(x) for x in texts]]

        return run

    return add_columns(pages, "text string, n_chars long", compute, at)
