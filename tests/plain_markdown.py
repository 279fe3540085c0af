"""Markdown of one page by a plain walk over its tree, to hold the Spark operator against. Only tests use it.

A tree becomes Markdown from the leaves up. Every finished element hands its parent a list of pieces: strings, and
the wishes LINE (stand at the start of a line) and GAP (behind an empty line). settle() grants the wishes in one pass.
"""

from __future__ import annotations

import re
from urllib.parse import quote, urljoin, urlsplit

from pagewright.functions.urls import DEFAULT_PORTS
from pagewright.operators.htmltree import HEADINGS

BLOCKS = frozenset("p div section article main header footer nav".split())
LISTS = frozenset(("ul", "ol"))
EMPHASIS = {"strong": "**", "b": "**", "em": "*", "i": "*"}
LINE, GAP = object(), object()
CHROME = frozenset("header footer nav".split())
SILENT = frozenset("script style noscript".split())
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_DOTS = re.compile(r"(?<=/)(?:\.|%2e){1,2}(?=/|$)", re.I)
_MARKS = re.compile(r"[*_`]")

def _clean_address(address):
    """(site, local part) of a web address in standard spelling, or None."""
    try:
        parts = urlsplit(address)
    except ValueError:
        return None
    if parts.scheme not in DEFAULT_PORTS or not parts.netloc:
        return None
    user, at, host = parts.netloc.rpartition("@")
    host = host.lower().removesuffix(":" + DEFAULT_PORTS[parts.scheme]).removesuffix(":")
    path = _DOTS.sub(lambda m: m[0].lower().replace("%2e", "."), parts.path)
    path = quote(urljoin("http://h/", path)[8:] if "/." in path else path, safe="!$%&'()*+,-./:;=@[]|~") or "/"
    hash_at = address.find("#")
    query = quote(parts.query, safe="!$%&()*+,-./:;=?@[]^`{|}~\\")
    mark = "?" if "?" in (address if hash_at < 0 else address[:hash_at]) else ""
    fragment = quote(parts.fragment, safe="!#$%&'()*+,-./:;=?@[]^{|}~\\")
    return parts.scheme, user + at, host, path + mark + query + ("#" if hash_at >= 0 else "") + fragment


def shown_address(base: str, href: str) -> str:
    """Plain twin of `display_href`."""
    text = href.strip("".join(map(chr, range(33)))).translate({9: None, 10: None, 13: None})
    home = _clean_address(base)
    if home is None:
        return href
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):", text)
    if scheme:
        name, rest = scheme[1].lower(), text[scheme.end():]
        if name not in DEFAULT_PORTS:
            return name + ":" + rest
        relative = name == home[0] and rest[:1] not in ("/", "\\")
        text = rest if relative else f"{name}://{rest.lstrip('/' + chr(92))}"
    cut = re.search(r"[?#]", text)
    path_end = cut.start() if cut else len(text)
    text = text[:path_end].replace("\\", "/") + text[path_end:]
    if not text:
        joined = base.split("#")[0]
    elif text[0] in "?#":
        joined = re.split("[?#]" if text[0] == "?" else "#", base)[0] + text
    elif text.startswith("//"):
        joined = f"{home[0]}:{text}"
    else:
        joined = urljoin(base, text)
    found = _clean_address(joined)
    if found is None:
        return href
    same = found[0] == home[0] and found[2] == home[2]
    return found[3] if same else f"{found[0]}://{found[1]}{found[2]}{found[3]}"


def settle(pieces: list, fresh: bool = True) -> str:
    """The text of pieces; `fresh` says that nothing stands before them."""
    out, newlines, empty = [], 0, fresh
    for piece in pieces:
        if piece is LINE or piece is GAP:
            lacking = 0 if empty or newlines else 1
            if piece is GAP:
                lacking = 1 if empty else max(0, 2 - newlines)
            piece = "\n" * lacking
        if piece:
            bare = piece.rstrip("\n")
            newlines = len(piece) - len(bare) + (0 if bare else newlines)
            empty = False
            out.append(piece)
    return "".join(out)


class _Open:
    """An element whose children are being read: its pieces so far, and what it lends to all below it."""

    __slots__ = ("node", "pieces", "pre", "link", "lists", "scope", "count")

    def __init__(self, node, above):
        self.node, self.pieces, self.count = node, [], 0
        self.pre = above.pre if above else False
        self.link = above.link if above else False
        self.lists = above.lists if above else ()
        self.scope = above.scope if above else None


class _Scope:
    """The links of a page or of one quotation, which may repeat those outside it and never uses references."""

    def __init__(self, compact):
        self.compact, self.seen, self.refs = compact, set(), []


def _label(node):
    """What stands for a link without text: its title or label, the alternative text of an image, or nothing."""
    own = next((node.attrs[name] for name in ("title", "aria-label") if name in node.attrs), "")
    if own.strip():
        return own
    image = next((below for below in node.walk() if below.tag == "img"), None)
    if image is None:
        return None
    alt = image.attrs.get("alt", "")
    return alt if alt.strip() else "img"


def _link(frame, href):
    text = settle(frame.pieces, False)
    if not _MARKS.sub("", text).strip():
        text = _label(frame.node)
    if text is None:
        return []
    text, scope = _SPACE.sub(" ", text).strip(" "), frame.scope
    if href:
        scope.seen.add(href)
    if not scope.compact:
        return [f"[{text}]({href})"]
    scope.refs.append({"text": text, "href": href})
    return [f"[{text}][{len(scope.refs) - 1}]"]


def _quote(frame):
    text = settle(frame.pieces)
    lines = text.removesuffix("\n").split("\n") if text else []
    quoted = "".join(f"> {line.removesuffix(chr(13))}\n" for line in lines)
    return [LINE, quoted, "\n" if text and not text.endswith("\n") else ""]


def _item(frame):
    if not settle(frame.pieces, False).strip():
        return []
    owner = frame.lists[-1] if frame.lists else None
    sign = f"{frame.count}." if owner is not None and owner.node.tag == "ol" else "-"
    return [LINE, "  " * max(len(frame.lists) - 1, 0) + sign + " ", *frame.pieces]


def _table(node):
    """Rows of cells, every row as wide as the widest; the line below the head rows, or the first row, divides them."""
    rows, heads, todo = [], 0, [(kid, False) for kid in reversed(node.kids)]
    while todo:
        part, head = todo.pop()
        if part.kind != "element":
            continue
        if part.tag != "tr":
            head = part.tag == "thead" or (head and part.tag not in ("tbody", "tfoot"))
            todo += [(kid, head) for kid in reversed(part.kids)]
            continue
        cells = [cell for cell in part.kids if cell.tag in ("td", "th")]
        rows.append([_SPACE.sub(" ", cell.text_content()).strip(" ") for cell in cells])
        heads += head or any(cell.tag == "th" for cell in cells)
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(cells + [""] * (width - len(cells))) + " |\n" for cells in rows]
    if width:
        lines.insert(heads or 1, "|" + "---|" * width + "\n")
    return [LINE, "".join(lines) if width else "", "\n"]


def _leaf(node, above, base, options):
    """Pieces of a node that is not descended into, or None."""
    tag = node.tag
    if node.kind == "text":
        return [node.text if above.pre else _SPACE.sub(" ", node.text).lstrip(" ")]
    if node.kind not in ("element", "document") or tag in SILENT or (tag in CHROME and options["strip_nav"]):
        return []
    if tag in ("br", "hr"):
        return ["\n"] if tag == "br" else [LINE, "---\n"]
    if tag == "img":
        source = node.attrs.get("src", "") if options["include_images"] else ""
        return [f"![{node.attrs.get('alt', '')}]({shown_address(base, source)})"] if source else []
    if tag == "table":
        return _table(node)
    return None


def _wrap(frame, href):
    """Pieces of an element from those of its children."""
    tag, inner = frame.node.tag, frame.pieces
    if tag in HEADINGS and not frame.link:
        return [LINE, "#" * int(tag[1]) + " ", *inner, "\n"]
    if tag in BLOCKS:
        return [LINE, *inner, GAP]
    if tag in LISTS:
        return [LINE, *inner, LINE]
    if tag in EMPHASIS:
        return [EMPHASIS[tag], *inner, EMPHASIS[tag]] if settle(inner, False).strip() else []
    if tag == "code" and not frame.pre:
        return ["`", *inner, "`"]
    if tag == "pre":
        return [LINE, "```\n", *inner, LINE, "```\n"]
    if tag == "blockquote":
        return _quote(frame)
    if tag == "li":
        return _item(frame)
    return inner if href is None else _link(frame, href)


def pieces_of(node, base: str, options: dict, scope: _Scope) -> list:
    """Pieces of a node and all below it."""
    top = _Open(None, None)
    top.scope = scope
    todo, frames, hrefs = [node], [top], []
    while todo:
        here = todo.pop()
        if here is None:  # the innermost open element is complete
            frame = frames.pop()
            frames[-1].pieces += _wrap(frame, hrefs.pop())
            continue
        above, href = frames[-1], None
        made = _leaf(here, above, base, options)
        if here.tag == "a" and made is None and options["include_links"]:
            href = shown_address(base, here.attrs.get("href", ""))
            made = [] if href and href in above.scope.seen else None
        if made is not None:
            above.pieces += made
            continue
        frame = _Open(here, above)
        if here.tag == "pre":
            frame.pre = True
        elif here.tag == "blockquote":
            frame.scope, frame.lists = _Scope(False), ()
        elif here.tag in LISTS:
            frame.lists = (*above.lists, frame)
        elif here.tag == "li" and above.lists:
            above.lists[-1].count += 1
            frame.count = above.lists[-1].count
        frame.link = above.link or href is not None
        frames.append(frame)
        hrefs.append(href)
        todo.append(None)
        todo.extend(reversed(here.kids))
    return top.pieces


def _section(heading):
    """The heading (or the `div` that wraps it) and the siblings that belong to its section."""
    start, level = heading, heading.tag
    wrapper = heading.parent
    if wrapper.tag == "div" and any(c.startswith("mw-heading") for c in wrapper.attrs.get("class", "").split()):
        start = wrapper
    yield start
    kids = start.parent.kids
    for kid in kids[kids.index(start) + 1:]:
        if any(n.tag in HEADINGS and n.tag <= level for n in (kid, *kid.kids) if n.kind == "element"):
            return
        yield kid


def render_tree(base: str, root, wanted: set | None, options: dict):
    """Raw Markdown and collected links of one page; `wanted` holds the node ids to render."""
    scope, pieces = _Scope(options["compact_links"]), []
    chosen = [root] if wanted is None else [node for number, node in enumerate(root.walk()) if number in wanted]
    for number, node in enumerate(chosen):
        pieces += [GAP] if number else []
        for part in _section(node) if node.tag in HEADINGS else (node,):
            pieces += pieces_of(part, base, options, scope)
    return settle(pieces), scope.refs
