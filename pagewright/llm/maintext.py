"""Main text of pages by composite text density of their DOM nodes."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.operators.htmltree import Node, parse_html

# Elements that are never article text, and class, id or role names of such blocks.
NO_TEXT = frozenset(
    "script style noscript template iframe object embed applet audio video canvas svg map annotation annotation-xml head title nav footer aside "
    "button input select textarea option menu dialog frameset noframes".split())
_NAME = (r"(?:ads?|advert(?:s|isements?|ising|orials?)?|sponsor(?:s|ed|ship)?|promos?|promoted|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|"
         r"newsletter|subscribe|subscriptions?|nav|navbar|navigation|navlinks|menus?|breadcrumbs?|sidebars?|side|footer|masthead|header|toolbar|share|sharing|social|"
         r"related|recommend(?:ed|ations?)|comments?|discussion|disqus|respond|replies|login|signup|pagination|pager|widgets?)")
#: A whole class token or id: such names, with words that only say where or what kind of box it is.
_PLAIN = r"(?:site|page|global|main|top|bottom|left|right|box|bar|list|links|icons|buttons|area|container|wrapper|block|section|form|unit|slot|item)"
BOILERPLATE = re.compile(rf"(?:{_PLAIN}[_-])*{_NAME}(?:[_-](?:{_NAME}|{_PLAIN}))*", re.I)
#: Names of blocks of reader comments, and words in the names of the items that such blocks repeat.
COMMENTS = re.compile(r"(?:(?:user|readers?|post|article|entry)[_-])?(?:comments?|disqus|respond|replies)(?:[_-](?:list|area|container|wrapper|block|box|section|form|thread|item|body))*", re.I)
_ITEM = re.compile(r"(?:^|[_-])(?:comments?|repl(?:y|ies)|posts?|message|review|item|card|teaser|entry|promo|ad)(?:$|[_-])", re.I)
#: A name that parts of articles have as well; like an id it needs more than itself. Comments beyond so many times the rest are the page.
_ALSO_ARTICLE, COMMENTS_ONLY = "discussion", 10
#: What each such block around it leaves of a node's density; fewer characters than this are short.
LOWERED, SHORT = 0.25, 200
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html li listing main nav ol option p plaintext pre search section summary table tbody "
    "td tfoot th thead tr ul xmp".split())
_HEADING = re.compile("h[1-6]")
_CANDIDATE = frozenset("article body center dd details div fieldset figure form li main section table tbody td th tr blockquote p ul ol dl pre".split())


def _unwanted(node: Node, in_article: int) -> bool:
    if node.tag in NO_TEXT or (node.tag == "header" and not in_article):
        return True
    attrs = node.attrs or {}
    if node.tag in ("body", "html", "article", "main"):
        return False
    return "hidden" in attrs or (attrs.get("role") or "").lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true"


def _comments(node: Node) -> bool:
    """Whether it is a block or an item of reader comments: by class, id or item type."""
    attrs = node.attrs or {}
    if node.tag in ("body", "html", "main"):
        return False
    names = (attrs.get("class") or "").split() + (attrs.get("id") or "").split()
    return any(COMMENTS.fullmatch(name) for name in names) or (attrs.get("itemprop") or "").lower() == "comment"


def _repeats(node: Node) -> bool:
    """Whether it holds, itself or in lists below it, two items: nested articles or elements whose class names an item."""
    items, todo = 0, list(node.kids)
    while todo:
        kid = todo.pop()
        if kid.kind != "element":
            continue
        if kid.tag == "article" or any(_ITEM.search(name) for name in ((kid.attrs or {}).get("class") or "").split()):
            items += 1
        elif kid.tag in ("ul", "ol"):
            todo.extend(kid.kids)
    return items > 1


def _named(node: Node, inside: int) -> int:
    """How surely it is boilerplate: 3 reader comments, 2 a form or a whole class token says so, or an id with repeated
    items below it, 1 only an id outside of articles, else 0. In an article an id alone is an anchor."""
    if node.tag in ("body", "html", "main"):
        return 0
    if _comments(node):
        return 3
    if node.tag == "article":
        return 0
    attrs = node.attrs or {}
    classes = [name for name in (attrs.get("class") or "").split() if BOILERPLATE.fullmatch(name)]
    if node.tag == "form" or (attrs.get("role") or "").lower() == "form" or any(name.lower() != _ALSO_ARTICLE for name in classes):
        return 2
    if classes or any(BOILERPLATE.fullmatch(name) for name in (attrs.get("id") or "").split()):
        return 2 if _repeats(node) else 0 if inside else 1
    return 0


def _in_order(root: Node) -> list[tuple[Node, int, int]]:
    """Wanted nodes in document order with the place of their parent and whether they stand in a main (1) or an article (2)."""
    out, todo = [], [(root, -1, 0)]
    while todo:
        node, up, inside = todo.pop()
        if node.kind == "element" and _unwanted(node, inside):
            continue
        if node.kind not in ("element", "text", "document"):
            continue
        at = len(out)
        out.append((node, up, inside))
        inside = max(inside, {"main": 1, "article": 2}.get(node.tag, 0))
        todo.extend((kid, at, inside) for kid in reversed(node.kids))
    return out


def _without(nodes: list[tuple[Node, int, int]], gone: set[int]) -> list[tuple[Node, int, int]]:
    """The nodes without some of them and all that is below those."""
    out, place = [], {-1: -1}
    for k, (node, up, inside) in enumerate(nodes):
        if k not in gone and up in place:
            place[k] = len(out)
            out.append((node, place[up], inside))
    return out


def wanted(nodes: list[tuple[Node, int, int]]) -> list[tuple[Node, int, int]]:
    """The nodes without blocks that are boilerplate by name.

    Blocks of reader comments go with all articles in them, unless hardly anything else is on the page. Forms and
    blocks named by class, or by id over repeated items, go whatever their size, unless they hold an article or main
    of their own, the densest subtree, or most of the article they stand in. Blocks named by an id alone have to be short
    or half links as well."""
    says = [_named(node, inside) if node.kind == "element" else 0 for node, _, inside in nodes]
    if not any(says):
        return nodes
    stats = Densities(nodes)
    if 3 in says:
        top = [False] * len(nodes)
        for k, (_, up, _) in enumerate(nodes):
            top[k] = says[k] == 3 or up >= 0 and top[up]
        outer = [k for k in range(len(nodes)) if says[k] == 3 and not (nodes[k][1] >= 0 and top[nodes[k][1]])]
        rest = stats.chars[0] - stats.link_chars[0] - sum(stats.chars[k] - stats.link_chars[k] for k in outer)
        if COMMENTS_ONLY * rest >= sum(stats.chars[k] for k in outer):
            nodes = _without(nodes, set(outer))
            says = [_named(node, inside) if node.kind == "element" else 0 for node, _, inside in nodes]
            if not any(says):
                return nodes
            stats = Densities(nodes)
    k, around = stats.best, set()
    while k >= 0:
        around.add(k)
        k = nodes[k][1]

    def goes(k):
        if not says[k] or k in around or stats.holds[k]:
            return False
        if says[k] == 1:
            return stats.chars[k] < SHORT or 2 * stats.link_chars[k] >= stats.chars[k]
        home = _article(nodes, k)
        return home is None or 2 * stats.chars[k] <= stats.chars[home]

    return _without(nodes, {k for k in range(len(nodes)) if goes(k)})


class Densities:
    """Composite text densities and density sums of nodes, and the place of the densest subtree.

    Of each element: C characters, T tags below it, LC and LT of those in links. Its composite density is
    C/T * log(C/LC * T/LT) to the base ln(C/nonLC * LC + LCb/Cb * C + e), b being the body; it falls where
    links make up the text, and for each block around that a name says is boilerplate. The density sum adds the
    children's densities; the largest sum wins, the first of equal ones. The threshold is the least density on the
    path from the body to that node."""

    def __init__(self, nodes: list[tuple[Node, int, int]]):
        n = len(nodes)
        chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        weight, holds = [1.0] * n, [False] * n
        for k in range(n - 1, -1, -1):
            node, up, inside = nodes[k]
            # Articles in articles, and those that are comments, are no article of the page.
            holds[k] |= node.tag == "main" or node.tag == "article" and inside < 2 and not _comments(node)
            if node.kind == "text":
                chars[k] = len("".join(node.text.split()))
            elif node.tag == "a":
                link_chars[k], link_tags[k] = chars[k], tags[k] + 1
            if up >= 0:
                chars[up] += chars[k]
                link_chars[up] += link_chars[k]
                link_tags[up] += link_tags[k]
                tags[up] += tags[k] + (node.kind == "element")
                holds[up] |= holds[k]
        for k, (node, up, inside) in enumerate(nodes):
            weight[k] = weight[up] if up >= 0 else 1.0
            says = _named(node, inside) if node.kind == "element" else 0
            if says == 3 or says and not holds[k]:
                weight[k] *= LOWERED
        body = next((k for k, (node, _, _) in enumerate(nodes) if node.tag == "body"), 0)
        share = link_chars[body] / max(chars[body], 1)
        density, total = [0.0] * n, [0.0] * n
        for k in range(n - 1, -1, -1):
            node, up, _ = nodes[k]
            if node.kind != "element" or not chars[k]:
                continue
            c, t, lc, lt = chars[k], max(tags[k], 1), max(link_chars[k], 1), max(link_tags[k], 1)
            base = math.log(c / max(c - link_chars[k], 1) * link_chars[k] + share * c + math.e)
            density[k] = weight[k] * c / t * max(0.0, math.log(max(c / lc * (t / lt), 1e-9)) / max(base, 1e-9))
            if up >= 0:
                total[up] += density[k]
        self.chars, self.link_chars, self.weight, self.holds, self.density, self.total, self.body = chars, link_chars, weight, holds, density, total, body
        # In each subtree the candidate of the largest sum, the first of equal ones.
        within: list[int | None] = [None] * n
        for k in range(n - 1, -1, -1):
            node, up, _ = nodes[k]
            if node.tag in _CANDIDATE and (within[k] is None or total[k] >= total[within[k]]):
                within[k] = k
            if up >= 0 and within[k] is not None and (within[up] is None or total[within[k]] >= total[within[up]]):
                within[up] = within[k]
        self.within, self.best = within, body if within[body] is None else within[body]
        self.threshold, k = density[self.best], self.best
        while k != body and k >= 0:
            k = nodes[k][1]
            if k >= 0:
                self.threshold = min(self.threshold, density[k])


def _article(nodes: list[tuple[Node, int, int]], k: int, tags: tuple[str, ...] = ("article", "main")) -> int | None:
    """The outermost article that a node lies in, else the main."""
    found = {}
    while k >= 0:
        found[nodes[k][0].tag] = k
        k = nodes[k][1]
    return next((found[tag] for tag in tags if tag in found), None)


def chosen(nodes: list[tuple[Node, int, int]], stats: Densities) -> list[bool]:
    """Of each node whether it belongs to the main text.

    From the body down, as far as densities reach the threshold, each node's subtree of the largest sum is taken. If
    the densest one lies in an article or main, these are taken whole, and others only with an article of their own.
    Else the sections beside a taken section, the headings before the first taken subtree, and what lies between
    taken subtrees come along, unless its name says boilerplate or half of it stands in links."""
    n, near = len(nodes), stats.weight[stats.best]
    passed, tops = [False] * n, set()
    for k in range(stats.body, n):
        node, up, _ = nodes[k]
        if node.kind in ("element", "document") and (k == stats.body or up >= 0 and passed[up]) and stats.chars[k] and stats.density[k] >= stats.threshold:
            if _HEADING.fullmatch(node.tag or ""):
                continue  # kept with what it heads
            passed[k] = True
            tops.add(k if stats.within[k] is None else stats.within[k])
    tops.add(stats.best)
    # An article that a dense part lies in is taken whole: its title and short blocks belong to it.
    home = _article(nodes, stats.best)
    if home is not None:
        kind = nodes[home][0].tag
        tops = {top for top in (_article(nodes, k, (kind,)) for k in tops) if top is not None}
        return _below(nodes, tops)

    def apt(k):
        return stats.chars[k] > 0 and 2 * stats.link_chars[k] < stats.chars[k] and stats.weight[k] >= near

    beside = {nodes[k][1] for k in tops if nodes[k][0].tag == "section"}
    tops |= {k for k in range(stats.body, n) if nodes[k][1] in beside and nodes[k][0].tag == "section" and apt(k)}
    kept = _below(nodes, tops)
    first, last = min(tops), max(k for k in range(n) if kept[k])
    between = False
    for k in range(first - 1, stats.body, -1):
        node, up, _ = nodes[k]
        if _HEADING.fullmatch(node.tag or "") and apt(k) and (node.tag == "h1" or not between):
            first, between = k, False
            if node.tag == "h1":
                break
        # Text of a heading is seen before the heading itself.
        elif node.kind == "text" and node.text.strip() and not _in_heading(nodes, up):
            between = True
    holds = list(kept)
    for k in range(n - 1, 0, -1):
        if holds[k] and nodes[k][1] >= 0:
            holds[nodes[k][1]] = True
    open_ = [False] * n
    for k in range(n):
        up = nodes[k][1]
        # Around taken subtrees a node is open; of the open ones' children those that hold none are judged whole.
        open_[k] = holds[k] and not kept[k] and (up < 0 or open_[up])
        if not holds[k] and first <= k <= last and up >= 0 and open_[up] and apt(k):
            tops.add(k)
    tops.add(first)
    return _below(nodes, tops)


def _in_heading(nodes: list[tuple[Node, int, int]], k: int) -> bool:
    while k >= 0:
        if _HEADING.fullmatch(nodes[k][0].tag or ""):
            return True
        k = nodes[k][1]
    return False


def _below(nodes: list[tuple[Node, int, int]], tops: set[int]) -> list[bool]:
    out = [False] * len(nodes)
    for k, (_, up, _) in enumerate(nodes):
        out[k] = k in tops or up >= 0 and out[up]
    return out


def main_text(source: str | None) -> str:
    """Blocks of the main subtrees, joined by newlines; empty for null, empty and textless pages."""
    if not source:
        return ""
    nodes = wanted(_in_order(parse_html(source)))
    if not nodes:
        return ""
    kept = chosen(nodes, Densities(nodes))
    blocks, held, opened, depth = [], [], [], [0] * len(nodes)

    def close():
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    for k, (node, up, _) in enumerate(nodes):
        depth[k] = depth[up] + 1 if up >= 0 else 0
        while opened and opened[-1] >= depth[k]:
            opened.pop()
            close()
        if node.kind == "text":
            if kept[k]:
                held.append(node.text)
        elif node.tag == "br":
            held.append(" ")
        elif node.tag in BLOCKS:
            close()
            opened.append(depth[k])
    close()
    return "\n".join(blocks)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages(page_id, url, html), one row per row given; n_chars counts code points.

    Null html counts as empty, and text is then empty. Other columns are left out. The tree of a page is built
    by the library's tolerant parser and walked without recursion, so depth does not matter."""
    def kernel(batches):
        for batch in batches:
            texts = [main_text(source) for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
