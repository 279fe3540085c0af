"""Tolerant HTML tree building for one page: the helper inside the page kernels.

Follows the public HTML parsing rules for implied tags, scopes, raw text and active formatting
elements. Content misplaced in tables stays where it was written. Pure Python, no shared state.
"""

from __future__ import annotations

import html as charrefs
import re
from collections import Counter

# Element classes of the HTML parsing rules.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style noscript iframe noembed noframes xmp".split())
RCDATA = frozenset("title textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "header hgroup main menu nav ol p search section summary ul pre listing form table hr xmp plaintext "
    "h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col "
    "colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav "
    "noembed noframes noscript object ol p param plaintext pre script search section select source style "
    "summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
SECTIONS = frozenset("tbody thead tfoot".split())
MARKED = frozenset("td th caption applet marquee object".split())

_ATTR = r"[^\s=/>]+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)?"
_TOKEN = re.compile(
    r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|!(?P<decl>[^>]*)>|\?(?P<pi>[^>]*)>"
    r"|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    rf"|(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/=]++|{_ATTR})*+)>)", re.S)
_ATTRS = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?")
_ATTR_REF = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9])))")


class Node:
    __slots__ = ("kind", "tag", "attrs", "text", "kids", "parent")

    def __init__(self, kind, tag=None, attrs=None, text=None):
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs, text
        self.kids = []
        self.parent = None

    def add(self, child):
        child.parent = self
        self.kids.append(child)
        return child

    def take(self, child):
        """Append a node that may already hang elsewhere."""
        if child.parent is not None:
            child.parent.kids.remove(child)
        self.add(child)

    def walk(self):
        """This node and everything below it in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.kids))

    def text_content(self):
        return "".join(n.text for n in self.walk() if n.kind == "text")


def _attributes(source):
    found = {}
    for name, double, single, bare in _ATTRS.findall(source):
        value = double or single or bare
        if "&" in value:
            value = _ATTR_REF.sub(lambda m: charrefs.unescape(m.group()), value)
        found.setdefault(name.lower(), value)
    return found


class _Stack(list):
    """Open elements, with a count per tag and the set of them, so that most questions need no walk down the stack."""

    def __init__(self):
        super().__init__()
        self.open, self.held = Counter(), set()

    def _in(self, node):
        self.open[node.tag] += 1
        self.held.add(id(node))

    def _out(self, nodes):
        for node in nodes:
            self.open[node.tag] -= 1
            self.held.discard(id(node))

    def __contains__(self, node):
        return id(node) in self.held

    def append(self, node):
        super().append(node)
        self._in(node)

    def insert(self, at, node):
        super().insert(at, node)
        self._in(node)

    def pop(self):
        node = super().pop()
        self._out((node,))
        return node

    def remove(self, node):
        super().remove(node)
        self._out((node,))

    def __delitem__(self, at):
        self._out(self[at] if isinstance(at, slice) else (self[at],))
        super().__delitem__(at)

    def __setitem__(self, at, node):
        self._out((self[at],))
        super().__setitem__(at, node)
        self._in(node)


class TreeBuilder:
    def __init__(self):
        self.root = Node("document")
        self.html = self.head = self.body = None
        self.stack = _Stack()
        self.formatting = []  # None entries are markers
        self.foreign = 0

    # -- stack helpers

    def _push(self, node):
        self.stack.append(node)
        return node

    def _insert(self, tag, attrs, open_it=True):
        node = (self.stack[-1] if self.stack else self.root).add(Node("element", tag, attrs))
        return self._push(node) if open_it else node

    def _in_scope(self, tags, barriers=SCOPE):
        if not any(self.stack.open[tag] for tag in tags):
            return False
        for node in reversed(self.stack):
            if node.tag in tags:
                return True
            if node.tag in barriers:
                return False
        return False

    def _pop_until(self, tags):
        while len(self.stack) > 1:
            if self.stack.pop().tag in tags:
                return

    def _close_implied(self, keep=None):
        while self.stack[-1].tag in IMPLIED_END and self.stack[-1].tag != keep:
            self.stack.pop()

    def _close_p(self):
        if self._in_scope({"p"}, SCOPE | {"button"}):
            self._close_implied("p")
            self._pop_until({"p"})

    def _clear_marker(self):
        while self.formatting and self.formatting.pop() is not None:
            pass

    # -- document skeleton

    def _ensure_html(self):
        if self.html is None:
            self.html = self._insert("html", {})

    def _ensure_head(self):
        self._ensure_html()
        if self.head is None:
            self.head = self._insert("head", {})

    def _ensure_body(self):
        if self.body is None:
            self._ensure_head()
            del self.stack[1:]
            self.body = self._insert("body", {})

    # -- active formatting elements

    def _reconstruct(self):
        entries = self.formatting
        at = len(entries)
        while at and entries[at - 1] is not None and entries[at - 1] not in self.stack:
            at -= 1
        for k in range(at, len(entries)):
            entries[k] = self._insert(entries[k].tag, entries[k].attrs)

    def _remember(self, node):
        same = []
        for entry in reversed(self.formatting):
            if entry is None:
                break
            if entry.tag == node.tag and entry.attrs == node.attrs:
                same.append(entry)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(node)

    def _find_formatting(self, tag):
        for entry in reversed(self.formatting):
            if entry is None:
                return None
            if entry.tag == tag:
                return entry
        return None

    def _end_formatting(self, tag):
        """Close a formatting element that may overlap blocks (the adoption agency rule)."""
        if self.stack[-1].tag == tag and self.stack[-1] not in self.formatting:
            self.stack.pop()
            return
        for _ in range(8):
            entry = self._find_formatting(tag)
            if entry is None:
                self._end_other(tag)
                return
            if entry not in self.stack:
                self.formatting.remove(entry)
                return
            if not self._in_scope({tag}):
                return
            at = self.stack.index(entry)
            block = next((n for n in self.stack[at + 1:] if n.tag in SPECIAL), None)
            if block is None:
                del self.stack[at:]
                self.formatting.remove(entry)
                return
            self._rewrap(entry, at, block)

    def _rewrap(self, entry, at, block):
        between = self.stack[at + 1:self.stack.index(block)]
        mark = self.formatting.index(entry)
        inner = block
        for depth, node in enumerate(reversed(between), 1):
            if node in self.formatting and depth > 3:
                where = self.formatting.index(node)
                self.formatting.remove(node)
                mark -= where < mark
            if node not in self.formatting:
                self.stack.remove(node)
                continue
            copy = Node("element", node.tag, node.attrs)
            where = self.formatting.index(node)
            self.formatting[where] = copy
            self.stack[self.stack.index(node)] = copy
            if inner is block:
                mark = where + 1
            copy.take(inner)
            inner = copy
        self.stack[at - 1].take(inner)
        copy = Node("element", entry.tag, entry.attrs)
        for kid in block.kids:
            copy.add(kid)
        block.kids = []
        block.add(copy)
        where = self.formatting.index(entry)
        self.formatting.remove(entry)
        self.formatting.insert(mark - (where < mark), copy)
        self.stack.remove(entry)
        self.stack.insert(self.stack.index(block) + 1, copy)

    # -- tokens

    def text(self, data):
        if self.body is None:
            rest = data.lstrip(" \t\n\f\r")
            blank = data[:len(data) - len(rest)]
            if blank and self.head is not None:
                self._append_text(blank)
            if not rest:
                return
            data = rest
            self._ensure_body()
        if self.formatting and not self.foreign:
            self._reconstruct()
        self._append_text(data)

    def _append_text(self, data):
        parent = self.stack[-1]
        if parent.kids and parent.kids[-1].kind == "text":
            parent.kids[-1].text += data
        else:
            parent.add(Node("text", text=data))

    def comment(self, data):
        (self.stack[-1] if self.stack else self.root).add(Node("comment", text=data))

    def start(self, tag, attrs, closed):
        """Open an element; returns it if its content is raw text."""
        if self.foreign:
            if self._insert(tag, attrs, not closed) and not closed and tag in ("svg", "math"):
                self.foreign += 1
            return None
        if tag in ("html", "head", "body"):
            self._skeleton(tag, attrs)
            return None
        if self.body is None:
            if tag in IN_HEAD:
                self._ensure_head()
                if self.stack[-1] is not self.head:  # after </head>: still belongs to it
                    node = self.head.add(Node("element", tag, attrs))
                    return node if tag in RAW_TEXT or tag in RCDATA else None
                node = self._insert(tag, attrs, tag == "template")
                return node if tag in RAW_TEXT or tag in RCDATA else None
            self._ensure_body()
        return self._start_in_body("img" if tag == "image" else tag, attrs, closed)

    def _skeleton(self, tag, attrs):
        if tag == "html":
            self._ensure_html()
        elif tag == "head":
            self._ensure_head()
        else:
            self._ensure_body()
        node = {"html": self.html, "head": self.head, "body": self.body}[tag]
        if tag != "head" or not node.kids:
            for name, value in attrs.items():
                node.attrs.setdefault(name, value)

    def _start_in_body(self, tag, attrs, closed):
        if self._in_scope({"select"}, SPECIAL - {"select", "optgroup", "option"}):
            if tag in ("select", "input", "textarea", "button"):
                self._pop_until({"select"})
                if tag == "select":
                    return None
            elif tag not in ("option", "optgroup", "hr", "script", "template"):
                return None
        if tag in TABLE_PARTS:
            self._table_part(tag, attrs)
            return None
        if tag in CLOSES_P:
            self._close_p()
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        elif tag in ("li", "dd", "dt"):
            self._close_item({"li"} if tag == "li" else {"dd", "dt"})
        elif tag == "button" and self._in_scope({"button"}):
            self._close_implied()
            self._pop_until({"button"})
        elif tag in ("option", "optgroup"):
            if self.stack[-1].tag == "option":
                self.stack.pop()
            if tag == "optgroup" and self.stack[-1].tag == "optgroup":
                self.stack.pop()
        elif tag == "form" and self.stack.open["form"]:
            return None
        elif tag in ("a", "nobr"):
            entry = self._find_formatting(tag)
            if entry is not None:
                self._end_formatting(tag)
                if entry in self.formatting:
                    self.formatting.remove(entry)
                if entry in self.stack:
                    self.stack.remove(entry)
        if tag not in CLOSES_P and tag not in ("li", "dd", "dt", "param", "source", "track") \
                and tag not in RAW_TEXT and tag not in IN_HEAD:
            self._reconstruct()
        raw = tag in RAW_TEXT or tag in RCDATA
        foreign = tag in ("svg", "math")
        node = self._insert(tag, attrs, not (tag in VOID or raw or (foreign and closed)))
        if foreign and not closed:
            self.foreign += 1
        if tag in FORMATTING:
            self._remember(node)
        elif tag in MARKED:
            self.formatting.append(None)
        return node if raw else None

    def _close_item(self, tags):
        for node in reversed(self.stack) if any(self.stack.open[tag] for tag in tags) else ():
            if node.tag in tags:
                self._close_implied(node.tag)
                self._pop_until({node.tag})
                break
            if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                break
        self._close_p()

    def _table_part(self, tag, attrs):
        if not self.stack.open["table"]:
            return
        wanted = {"tr": SECTIONS, "td": {"tr"}, "th": {"tr"}, "col": {"colgroup"}}.get(tag, frozenset())
        while self.stack[-1].tag != "table" and self.stack[-1].tag not in wanted:
            if self.stack.pop().tag in ("td", "th", "caption"):
                self._clear_marker()
        if tag in ("tr", "td", "th") and self.stack[-1].tag == "table":
            self._insert("tbody", {})
        if tag in ("td", "th") and self.stack[-1].tag in SECTIONS:
            self._insert("tr", {})
        if tag == "col" and self.stack[-1].tag == "table":
            self._insert("colgroup", {})
        self._insert(tag, attrs, tag != "col")
        if tag in MARKED:
            self.formatting.append(None)

    def end(self, tag):
        if self.body is None:
            if tag == "head" and self.head is not None:
                del self.stack[1:]
            elif tag in ("body", "html", "br"):
                self._ensure_body()
                if tag == "br":
                    self._insert("br", {}, False)
            elif tag == "template" and self.stack and self.stack[-1].tag == "template":
                self.stack.pop()
            return
        if self.foreign:
            while self.stack.open[tag]:
                name = self.stack.pop().tag
                self.foreign -= name in ("svg", "math")
                if name == tag:
                    break
            return
        if tag in ("body", "html"):
            return
        if tag == "br":
            self._reconstruct()
            self._insert("br", {}, False)
        elif tag == "p":
            if not self._in_scope({"p"}, SCOPE | {"button"}):
                self._insert("p", {})
            self._close_p()
        elif tag in FORMATTING:
            self._end_formatting(tag)
        elif tag in HEADINGS:
            if self._in_scope(HEADINGS):
                self._close_implied()
                self._pop_until(HEADINGS)
        elif tag in TABLE_PARTS or tag == "table":
            if self._in_scope({tag}, {"html", "table", "template"} - {tag}):
                while True:
                    name = self.stack.pop().tag
                    if name in MARKED:
                        self._clear_marker()
                    if name == tag:
                        break
        elif tag in SPECIAL:
            barriers = SCOPE | {"ol", "ul"} if tag == "li" else SCOPE
            if self._in_scope({tag}, barriers):
                self._close_implied(tag)
                self._pop_until({tag})
                if tag in MARKED:
                    self._clear_marker()
        else:
            self._end_other(tag)

    def _end_other(self, tag):
        if not self.stack.open[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            node = self.stack[at]
            if node.tag == tag:
                del self.stack[at:]
                return
            if node.tag in SPECIAL:
                return


def parse_html(source: str) -> Node:
    """The document node of a page."""
    if "\r" in source:
        source = source.replace("\r\n", "\n").replace("\r", "\n")
    if "\0" in source:
        source = source.replace("\0", "")
    builder = TreeBuilder()
    pos, size = 0, len(source)
    while pos < size:
        found = _TOKEN.search(source, pos)
        stop = found.start() if found else size
        if stop > pos:
            data = source[pos:stop]
            builder.text(charrefs.unescape(data) if "&" in data else data)
        if not found:
            break
        pos = found.end()
        kind = found.lastgroup
        if kind == "attrs":
            tag, attrs = found["start"].lower(), found["attrs"]
            node = builder.start(tag, _attributes(attrs) if attrs else {}, attrs.endswith("/"))
            if node is not None:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                data = source[pos:close.start() if close else size]
                pos = close.end() if close else size
                if tag in RCDATA:
                    data = charrefs.unescape(data)
                    data = data[1:] if tag == "textarea" and data.startswith("\n") else data
                if data:
                    node.add(Node("text", text=data))
            elif tag in ("pre", "listing") and source.startswith("\n", pos):
                pos += 1
        elif kind == "end":
            builder.end(found["end"].lower())
        elif kind == "comment":
            builder.comment(found["comment"])
        elif kind == "decl" and not found["decl"].lower().startswith("doctype"):
            builder.comment(found["decl"])
        elif kind == "decl" and builder.html is None:
            builder.root.add(Node("doctype", text=found["decl"][7:].strip()))
    builder._ensure_body()
    return builder.root
