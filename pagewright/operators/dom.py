"""The page kernel: HTML to a relational node table.

Nodes are numbered in document order and carry the number of their last descendant, so "inside"
is an interval test. They also carry the byte range of their text within the page's whole text:
the text size of any element is a subtraction, and its text one slice of the document row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagewright.functions import as_col
from pagewright.operators.htmltree import HEADINGS, parse_html

NODE_TYPES = {
    "page_id": T.LongType(),
    "url": T.StringType(),
    "node_id": T.IntegerType(),
    "parent_id": T.IntegerType(),
    "end_id": T.IntegerType(),
    "depth": T.IntegerType(),
    "sib": T.IntegerType(),
    "elem": T.IntegerType(),           # position among element siblings, from 1
    "last_elem": T.BooleanType(),      # no element sibling after it
    "kind": T.StringType(),
    "tag": T.StringType(),
    "attrs": T.MapType(T.StringType(), T.StringType()),
    "text": T.StringType(),
    "text_from": T.LongType(),
    "text_to": T.LongType(),
    "parent_tag": T.StringType(),
    "parent_end": T.IntegerType(),
    "parent_to": T.LongType(),         # text_to of the parent
    "heading": T.IntegerType(),        # highest heading level of the element or its children
}
# Kinds of ancestors that a row can tell of, on demand: their tags, and the tags behind which they do not count.
# near_<kind> and top_<kind> are the ids of the innermost and outermost one, deep_<kind> is their number.
ANCESTORS = {
    "link": (("a",), ()), "quote": (("blockquote",), ()), "pre": (("pre",), ()), "list": (("ul", "ol"), ("blockquote",)),
    "ordered": (("ol",), ("ul", "blockquote")), "table": (("table",), ()), "row": (("tr",), ()),
    "head": (("thead",), ("tbody", "tfoot")), "hidden": (("script", "style", "noscript"), ()),
    "chrome": (("header", "footer", "nav"), ()),
}
NODE_TYPES |= {f"{what}_{kind}": T.IntegerType() for kind in ANCESTORS for what in ("near", "top", "deep")}
COLUMNS = [name for name in NODE_TYPES if name.split("_")[-1] not in ANCESTORS]
NODE_SCHEMA = T.StructType([T.StructField(name, NODE_TYPES[name]) for name in COLUMNS])
EMITTED = "emitted"  # the column metadata that names the tags a kernel was asked for
SHARES = "shares"    # the column metadata that says into how many shares the rows of pages are hashed
PAGES_PER_SHARE = 1024
FLUSH_ROWS = 16384
FLUSH_BYTES = 8 << 20


class _Lineage:
    """What the kinds of ancestors are below an element, from what they are beside it."""

    def __init__(self, kinds):
        self.top = (None, None, 0) * len(kinds)
        self.turns = {}  # tag -> [(place of the kind, does it count or bar)]
        for at, kind in enumerate(kinds):
            counting, barring = ANCESTORS[kind]
            for tag in counting:
                self.turns.setdefault(tag, []).append((3 * at, True))
            for tag in barring:
                self.turns.setdefault(tag, []).append((3 * at, False))

    def below(self, tag, node_id, beside):
        turns = self.turns.get(tag)
        if turns is None:
            return beside
        found = list(beside)
        for at, counts in turns:
            top = found[at + 1] if found[at + 1] is not None else node_id
            found[at:at + 3] = (node_id, top, found[at + 2] + 1) if counts else (None, None, 0)
        return tuple(found)


def page_rows(page_id, url, root, size_of_source, wanted, texts, page_text, columns):
    """Rows of one parsed page. `wanted(kind, tag)` selects; numbering always covers all nodes. Of a row only `columns`
    are handed on, and what they do not need is not worked out."""
    kinds = [kind for kind in ANCESTORS if any(c.endswith(f"_{kind}") for c in columns)]
    lineage = _Lineage(kinds)
    made = [*COLUMNS, *(f"{what}_{kind}" for kind in kinds for what in ("near", "top", "deep"))]
    pick = itemgetter(*[made.index(c) for c in columns])
    with_attrs, with_text, with_heading = "attrs" in columns, "text" in columns, "heading" in columns
    entries = []  # [node, parent entry, depth, sib, elem, last_elem, kinds of ancestors, node_id, end_id, from, to]
    pieces, size, count = [], 0, 0
    todo = [(root, None, 0, 0, None, None, lineage.top)]
    while todo:
        item = todo.pop()
        if len(item) == 1:  # all descendants done
            item[0][8], item[0][10] = count - 1, size
            continue
        node = item[0]
        entry = [*item, count, count, size, size]
        count += 1
        entries.append(entry)
        if node.kind == "text":
            pieces.append(node.text)
            size += len(node.text.encode("utf-8", "replace"))
            entry[10] = size
        elif node.kids:
            todo.append((entry,))
            elems = sum(kid.kind == "element" for kid in node.kids)
            seen = elems
            here, depth, below = entry, entry[2] + 1, lineage.below(node.tag, entry[7], entry[6])
            for sib in range(len(node.kids) - 1, -1, -1):
                kid = node.kids[sib]
                if kid.kind == "element":
                    todo.append((kid, here, depth, sib, seen, seen == elems, below))
                    seen -= 1
                else:
                    todo.append((kid, here, depth, sib, None, None, below))
    for node, up, depth, sib, elem, last, beside, node_id, end_id, start, stop in entries:
        kind, tag = node.kind, node.tag
        if not wanted(kind, tag):
            continue
        text, attrs, level = None, None, None
        if with_text:
            text = node.text
            if kind == "element" and (tag in texts or "*" in texts):
                text = node.text_content()
            elif kind == "document" and page_text:
                text = "".join(pieces)
        if with_attrs:
            attrs = list(node.attrs.items()) if kind == "element" else None
            if kind == "document":
                attrs = [("content_bytes", str(size_of_source))]
        if with_heading:
            level = min([int(n.tag[1]) for n in (node, *node.kids) if n.tag in HEADINGS], default=None)
        parent, above = (None, (None, None, None)) if up is None else (up[7], (up[0].tag, up[8], up[10]))
        yield pick((page_id, url, node_id, parent, end_id, depth, sib, elem, last, kind, tag, attrs, text, start, stop,
                    *above, level, *beside))


def _batcher(schema):
    arrow = to_arrow_schema(schema)

    def build(rows):
        columns = [pa.array(values, type=field.type) for values, field in zip(zip(*rows), arrow)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return build


def in_batches(rows: Iterator[tuple], text_at: int | None, build) -> Iterator[pa.RecordBatch]:
    """Group rows into Arrow batches bounded in rows and in text size."""
    pending, size = [], 0
    for row in rows:
        pending.append(row)
        size += len(row[text_at] or "") if text_at is not None else 0
        if len(pending) >= FLUSH_ROWS or size >= FLUSH_BYTES:
            yield build(pending)
            pending, size = [], 0
    if pending:
        yield build(pending)


def html_nodes(pages: DataFrame, tags: Iterable[str] | None = None, kinds: Iterable[str] | None = None,
               texts: Iterable[str] = (), page_text: bool | None = None, columns: Iterable[str] | None = None,
               partitions: int | None = None) -> DataFrame:
    """Parse `pages(page_id, url, html)` into node rows.

    The optimizer cannot see into the kernel, so what a query needs is said here: `tags` keeps only
    those elements (and `#text` beside them text rows) and `kinds` only those rows (the document row always stays, one per
    page), `texts` names tags whose rows carry their full text, `page_text` puts the whole text on the
    document row (default: only when nothing is filtered out), and `columns` are those that are built, by default
    COLUMNS; those of ANCESTORS come on demand only. `partitions` deals the bodies anew before they are parsed: a
    shuffle of all of them, of use where a file's row groups are fewer than the cores.
    """
    tag_set = None if tags is None else frozenset(tags)
    kind_set = None if kinds is None else frozenset(kinds) | {"document"}
    text_set = frozenset(texts)
    whole = (tag_set is None and kind_set is None) if page_text is None else page_text
    names = list(COLUMNS if columns is None else dict.fromkeys(columns))
    schema = T.StructType([T.StructField(name, NODE_TYPES[name]) for name in names])

    def wanted(kind, tag):
        if kind_set is not None and kind not in kind_set:
            return False
        return tag_set is None or kind == "document" or tag in tag_set or (kind == "text" and "#text" in tag_set)

    def kernel(batches):
        def rows():
            for batch in batches:
                for page_id, url, source in zip(*(column.to_pylist() for column in batch.columns)):
                    source = source or ""
                    size = len(source.encode("utf-8", "replace"))
                    yield from page_rows(page_id, url, parse_html(source), size, wanted, text_set, whole, names)

        return in_batches(rows(), names.index("text") if "text" in names else None, _batcher(schema))

    source = pages.select("page_id", "url", "html")
    rows = (source if partitions is None else source.repartition(partitions)).mapInArrow(kernel, schema)
    shares = pages.schema["page_id"].metadata.get(SHARES)
    if shares is not None and "page_id" in names:
        rows = rows.withMetadata("page_id", {SHARES: shares})
    # Selectors look here, so that none is evaluated on rows that were never made.
    return rows if tag_set is None or "tag" not in names else rows.withMetadata("tag", {EMITTED: sorted(tag_set)})


def shared_out(pages: DataFrame, count: int) -> DataFrame:
    """Pages that know how many they are, so that `clustered` hashes their nodes into shares of about PAGES_PER_SHARE pages.

    A fixed number of shares would grow with the table, and with them what the sorts of one task hold."""
    shares = max(pages.sparkSession.sparkContext.defaultParallelism, -(-count // PAGES_PER_SHARE))
    return pages.withMetadata("page_id", {SHARES: shares})


def clustered(rows: DataFrame) -> DataFrame:
    """Rows hashed on `page_id` alone. Windows on (page, parent) and the like accept that too, while
    without it each of them would ask for a shuffle of its own."""
    shares = rows.schema["page_id"].metadata.get(SHARES)
    return rows.repartition("page_id") if shares is None else rows.repartition(shares, "page_id")


def staged(rows: DataFrame) -> DataFrame:
    """Clustered rows, shuffled once more, so that what follows is a stage of its own.

    An executor keeps the generated classes of 100 expressions and operators. A stage of more windows than some dozen has
    more, and each of its tasks would compile all of them again. One share more makes the hash another one."""
    shares = rows.schema["page_id"].metadata.get(SHARES)
    return rows if shares is None else rows.repartition(shares + 1, "page_id")


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind") == "element")


def text_bytes() -> Column:
    """Bytes of all text below a node row."""
    return F.col("text_to") - F.col("text_from")


def node_tokens() -> Column:
    return F.floor(text_bytes() / 4).cast("bigint")


def attr(name: str, attrs="attrs") -> Column:
    return as_col(attrs)[name]


def with_text(rows: DataFrame, flag: Column, out: str = "content") -> DataFrame:
    """The flagged rows with their full text: a byte slice of the text that their page's document row holds.

    `rows` are those of whole pages, document rows included; rows and text of a page meet in one aggregate, so pages are
    parsed once and nothing is joined."""
    names = [c for c in rows.columns if c != "page_id"]
    pages = rows.groupBy("page_id").agg(
        F.max(F.when(F.col("kind") == "document", F.col("text"))).cast("binary").alias("_whole"),
        F.collect_list(F.when(flag, F.struct(*names))).alias("_hits"))
    found = pages.select("page_id", "_whole", F.explode("_hits").alias("_h")).select("page_id", "_whole", "_h.*")
    part = F.substring(F.col("_whole"), (F.col("text_from") + 1).cast("int"), text_bytes().cast("int")).cast("string")
    return found.withColumn(out, part).drop("_whole")
