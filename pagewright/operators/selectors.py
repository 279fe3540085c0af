"""CSS selection and traversal over node rows.

A selector becomes column predicates plus window functions, never a self-join: document order and
intervals make "is inside a match" a running maximum, "follows a match" a lag, and "child of a
match" a lookup within (page, parent). All windows cluster on `page_id`, so one shuffle serves a
whole selector and the pages are parsed once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.operators.dom import EMITTED, clustered, elements, with_text
from pagewright.operators.htmltree import RAW_TEXT, VOID

_IDENT = r"(?:[A-Za-z_\-\u0080-\U0010ffff]|\\.)(?:[\w\-\u0080-\U0010ffff]|\\.)*"
_SIMPLE = re.compile(
    rf"(?P<type>\*|{_IDENT})"
    rf"|\#(?P<id>(?:[\w\-\u0080-\U0010ffff]|\\.)+)"
    rf"|\.(?P<cls>{_IDENT})"
    rf"|\[\s*(?P<name>{_IDENT})\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>\"[^\"]*\"|'[^']*'|{_IDENT}|[\w\-]+)\s*)?\]"
    rf"|:(?P<pseudo>[a-z\-]+)(?:\((?P<arg>[^()]*)\))?")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")


@dataclass
class Compound:
    combinator: str | None  # relation to the compound before it
    test: Column
    tag: str | None = None
    needs_siblings: bool = field(default=False)


def _unescape(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _attr_test(name: str, op: str | None, value: str) -> Column:
    held = F.col("attrs")[name.lower()]
    if op is None:
        return held.isNotNull()
    if op == "=":
        return held == value
    if op == "~=":
        return F.array_contains(F.split(held, r"\s+"), value) if re.fullmatch(r"\S+", value) else F.lit(False)
    if op == "|=":
        return (held == value) | held.startswith(value + "-")
    if not value:
        return F.lit(False)
    return {"^=": held.startswith(value), "$=": held.endswith(value), "*=": held.contains(value)}[op]


def _nth_test(arg: str) -> Column:
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.strip().lower(), re.sub(r"\s+", "", arg.lower()))
    match = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", arg)
    if not match:
        raise ValueError(f"invalid :nth-child argument: {arg!r}")
    position = F.col("elem")
    if match[3]:
        return position == int(match[3])
    step = int(match[1] + "1") if match[1] in ("", "+", "-") else int(match[1])
    start = int(match[2] or 0)
    if step == 0:
        return position == start
    distance = position - start
    return (distance % step == 0) & (distance / step >= 0)


def _pseudo_test(name: str, arg: str | None, source: str) -> Column:
    if name == "not" and arg:
        inner = F.lit(False)
        for part in parse_selector(arg):
            if len(part) != 1:
                raise ValueError(f"unsupported :not() argument in selector: {source!r}")
            inner = inner | part[0].test
        return ~inner
    if name == "nth-child" and arg:
        return _nth_test(arg)
    simple = {"first-child": F.col("elem") == 1, "last-child": F.col("last_elem"),
              "only-child": (F.col("elem") == 1) & F.col("last_elem")}
    if name not in simple or arg is not None:
        raise ValueError(f"unsupported pseudo-class in selector: {source!r}")
    return simple[name]


def parse_selector(source: str) -> list[list[Compound]]:
    """Comma-separated alternatives, each a chain of compounds. Anything else raises ValueError."""
    alternatives, chain, pos = [], [], 0
    text = source.strip()
    if not text:
        raise ValueError("empty selector")
    combinator = None
    while pos < len(text):
        tests, tag, start = [], None, pos
        while match := _SIMPLE.match(text, pos):
            kind = match.lastgroup
            if match["type"]:
                if pos != start:
                    raise ValueError(f"invalid selector: {source!r}")
                if match["type"] != "*":
                    tag = _unescape(match["type"]).lower()
                    tests.append(F.col("tag") == tag)
            elif match["id"]:
                tests.append(F.col("attrs")["id"] == _unescape(match["id"]))
            elif match["cls"]:
                tests.append(F.array_contains(F.split(F.col("attrs")["class"], r"\s+"), _unescape(match["cls"])))
            elif match["name"]:
                tests.append(_attr_test(_unescape(match["name"]), match["op"], (match["value"] or "").strip("\"'")))
            elif kind:
                tests.append(_pseudo_test(match["pseudo"], match["arg"], source))
            pos = match.end()
        if pos == start:
            raise ValueError(f"invalid selector: {source!r}")
        test = F.lit(True)
        for one in tests:
            test = test & one
        chain.append(Compound(combinator, F.coalesce(test, F.lit(False)), tag, combinator == "+"))
        comma = re.compile(r"\s*,\s*").match(text, pos)
        if comma or pos == len(text):
            alternatives.append(chain)
            chain, combinator = [], None
            if comma and comma.end() == len(text):
                raise ValueError(f"invalid selector: {source!r}")
            pos = comma.end() if comma else pos
            continue
        step = _COMBINATOR.match(text, pos)
        if not step:
            raise ValueError(f"invalid selector: {source!r}")
        combinator, pos = step[1] or " ", step.end()
        if pos == len(text):
            raise ValueError(f"invalid selector: {source!r}")
    return alternatives


def needed_tags(selector: str) -> set[str] | None:
    """Tags the kernel must emit to evaluate a selector, or None if it needs all elements."""
    tags = set()
    for chain in parse_selector(selector):
        for compound in chain:
            if compound.tag is None or compound.needs_siblings:
                return None
            tags.add(compound.tag)
    return tags


def check_tags(nodes: DataFrame, selector: str) -> None:
    """Raises ValueError when the node rows were made without a tag that the selector names."""
    emitted = nodes.schema["tag"].metadata.get(EMITTED) if "tag" in nodes.columns else None
    if emitted is None:
        return
    named = {c.tag for chain in parse_selector(selector) for c in chain if c.tag is not None}
    if missing := named - set(emitted):
        raise ValueError(f"{selector!r} needs rows of {', '.join(sorted(missing))}, which html_nodes was not asked for")


def by_page(*order) -> Window:
    return Window.partitionBy("page_id").orderBy(*(order or ("node_id",)))


def before(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def up_to_here(window: Window) -> Window:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def siblings(*order) -> Window:
    return Window.partitionBy("page_id", "parent_id").orderBy(*(order or ("sib",)))


def inside(flag: Column) -> Column:
    """True for rows below a flagged row."""
    reach = F.max(F.when(flag, F.col("end_id"))).over(before(by_page()))
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def inside_or_self(flag: Column) -> Column:
    reach = F.max(F.when(flag, F.col("end_id"))).over(up_to_here(by_page()))
    return F.coalesce(reach >= F.col("node_id"), F.lit(False))


def from_parent(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """Add a value of the parent row. Each row that has one also stands for itself as a parent of others,
    and both meet in the same (page, key) group; the group is one family, and the window's clustering
    is already met by a shuffle on `page_id`. Rows without a value have nothing to give and stay single."""
    columns = rows.columns
    child = F.struct(F.lit(False).alias("up"), F.coalesce(F.col("parent_id"), F.lit(-1)).alias("key"))
    parent = F.struct(F.lit(True).alias("up"), F.col("node_id").alias("key"))
    roles = F.when(F.col("_given").isNull(), F.array(child)).otherwise(F.array(parent, child))
    family = Window.partitionBy("page_id", "_role.key").orderBy(F.desc("_role.up")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("_given", value).withColumn("_role", F.explode(roles))
            .withColumn(out, F.first(F.when(F.col("_role.up"), F.struct("_given"))).over(family)["_given"])
            .filter(~F.col("_role.up")).select(*[c for c in columns if c != out], out))


def css_flag(nodes: DataFrame, selector: str, out: str = "matched", keep_others: bool = False) -> DataFrame:
    """Element rows with a boolean column: does the element match the selector? With `keep_others` the rows that are no
    elements stay, unmatched."""
    check_tags(nodes, selector)
    rows = nodes if keep_others else elements(nodes)
    beside = Window.partitionBy("page_id", "parent_id", "kind").orderBy("sib")
    columns = [c for c in rows.columns if c != out]
    flags = []
    alternatives = parse_selector(selector)
    if any(compound.combinator in (">", "+", "~") for chain in alternatives for compound in chain):
        rows = clustered(rows)
    for number, chain in enumerate(alternatives):
        name = f"_m{number}"
        rows = rows.withColumn(name, chain[0].test)
        for compound in chain[1:]:
            held = F.col(name)
            if compound.combinator == " ":
                linked = inside(held)
            elif compound.combinator == "+":
                # The sibling just before, not the one before it among the rows that are there.
                next_to = F.lag("elem").over(beside) == F.col("elem") - 1
                linked = F.coalesce(next_to & F.lag(held).over(beside), F.lit(False))
            elif compound.combinator == "~":
                linked = F.coalesce(F.max(held).over(before(beside)), F.lit(False))
            else:
                rows = from_parent(rows, F.when(held, True), "_parent")
                linked = F.coalesce(F.col("_parent"), F.lit(False))
            rows = rows.withColumn("_linked", linked).withColumn(name, F.col("_linked") & compound.test)
        flags.append(F.col(name))
    matched = flags[0]
    for flag in flags[1:]:
        matched = matched | flag
    if keep_others:
        matched = F.coalesce(matched & (F.col("kind") == "element"), F.lit(False))
    return rows.select(*columns, matched.alias(out))


def css_select(nodes: DataFrame, selector: str) -> DataFrame:
    """Matching element rows; order by (page_id, node_id) for document order."""
    return css_flag(nodes, selector, "_hit").filter("_hit").drop("_hit")


def css_values(nodes: DataFrame, selector: str, attr: str = "textContent") -> DataFrame:
    """(page_id, url, node_id, value) per match: its text, inner markup or an attribute (null if absent)."""
    if attr == "innerHTML":
        hits = markup(nodes, selector).withColumn("value", F.col("inner_html"))
    elif attr == "textContent":
        hits = with_text(css_flag(nodes, selector, "_hit", keep_others=True), F.col("_hit"), "value")
    else:
        hits = css_select(nodes, selector).withColumn("value", F.col("attrs")[attr.lower()])
    return hits.select("page_id", "url", "node_id", "value")


def css_count(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, n) for every page, zero included."""
    flagged = css_flag(nodes, selector)
    return flagged.groupBy("page_id").agg(F.sum(F.col("matched").cast("bigint")).alias("n"))


def select_or_nothing(nodes: DataFrame, selector: str) -> DataFrame:
    """As `css_select`, but an invalid selector gives no rows: the rule of Markdown selection."""
    try:
        return css_select(nodes, selector)
    except ValueError:
        return elements(nodes).filter(F.lit(False))


def by_id(nodes: DataFrame, value: str) -> DataFrame:
    """First element of each page with the id."""
    hits = elements(nodes).filter(F.col("attrs")["id"] == value)
    return hits.withColumn("_n", F.row_number().over(by_page())).filter("_n = 1").drop("_n")


def by_class(nodes: DataFrame, names: str) -> DataFrame:
    """Elements that carry all of the blank-separated class names."""
    held = F.split(F.col("attrs")["class"], r"\s+")
    wanted = F.array(*[F.lit(name) for name in names.split()])
    return elements(nodes).filter(F.size(F.array_except(wanted, held)) == 0)


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return elements(nodes) if tag == "*" else elements(nodes).filter(F.col("tag") == tag.lower())


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return elements(nodes).filter(F.col("attrs")["name"] == name)


def first_match(nodes: DataFrame, selector: str, scope: str | None = None, value: str = "tag") -> DataFrame:
    """First match per page, or per element matching `scope` (descendants only, null if none).

    With a scope the result is (page_id, node_id of the scope, match_id, value): a column of the match comes along.
    """
    if scope is None:
        hits = css_select(nodes, selector)
        return hits.withColumn("_n", F.row_number().over(by_page())).filter("_n = 1").drop("_n")
    rows = css_flag(css_flag(nodes, selector, "_hit"), scope, "_scope")
    following = F.last(F.when(F.col("_hit"), F.struct("node_id", F.col(value).alias("value"))), ignorenulls=True).over(
        before(by_page(F.desc("node_id"))))
    inner = F.when(F.col("_next.node_id") <= F.col("end_id"), F.col("_next"))
    return (rows.withColumn("_next", following).filter("_scope").withColumn("_next", inner)
            .select("page_id", "node_id", F.col("_next.node_id").alias("match_id"), F.col("_next.value").alias("value")))


def all_matches(nodes: DataFrame, selector: str, scope: str | None = None) -> DataFrame:
    if scope is None:
        return css_select(nodes, selector)
    rows = css_flag(css_flag(nodes, selector, "_hit"), scope, "_scope")
    return rows.withColumn("_in", inside(F.col("_scope"))).filter("_hit AND _in").drop("_hit", "_scope", "_in")


def matches(nodes: DataFrame, selector: str) -> DataFrame:
    return css_flag(nodes, selector, "matched")


def nearest(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """Add the node_id of the nearest flagged ancestor-or-self.

    Flagged intervals nest, so the number of them open at a row names its innermost one: it is the
    last flagged row opened at that level.
    """
    columns = [c for c in rows.columns if c != out]
    edge = F.struct
    events = F.when(flag, F.array(
        edge(F.col("node_id").alias("pos"), F.lit(0).alias("end"), F.lit(1).alias("change")),
        edge(F.col("end_id").alias("pos"), F.lit(1).alias("end"), F.lit(-1).alias("change")),
    )).otherwise(F.array(edge(F.col("node_id").alias("pos"), F.lit(0).alias("end"), F.lit(0).alias("change"))))
    open_now = F.sum("_e.change").over(up_to_here(by_page("_e.pos", "_e.end")))
    last_open = F.last(F.when(F.col("_e.change") == 1, F.col("node_id")), ignorenulls=True).over(
        up_to_here(Window.partitionBy("page_id", "_level").orderBy("node_id")))
    return (rows.withColumn("_e", F.explode(events)).withColumn("_level", open_now).filter("_e.end = 0")
            .withColumn(out, F.when(F.col("_level") > 0, last_open)).select(*columns, out))


def closest(nodes: DataFrame, selector: str, out: str = "closest_id") -> DataFrame:
    """Element rows with the node_id of the nearest ancestor or self matching the selector."""
    return nearest(css_flag(nodes, selector, "_hit"), F.col("_hit"), out).drop("_hit")


def contains(a_id: Column, a_end: Column, b_id: Column) -> Column:
    """Is node b the node a or below it? (same page)"""
    return (a_id <= b_id) & (b_id <= a_end)


def parents(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, tag, parent_id, parent_tag, parent_attrs) of every node that has a parent row."""
    rows = from_parent(nodes, F.struct("tag", "attrs"), "_up").filter(F.col("_up").isNotNull())
    return rows.select("page_id", "node_id", "tag", "parent_id", F.col("_up.tag").alias("parent_tag"),
                       F.col("_up.attrs").alias("parent_attrs"))


def children(nodes: DataFrame, selector: str) -> DataFrame:
    """Child nodes (of any kind) of the matching elements."""
    flagged = _flag_all(nodes, selector)
    return from_parent(flagged, F.col("_hit"), "_of").filter("_of").drop("_hit", "_of")


def _flag_all(nodes: DataFrame, selector: str) -> DataFrame:
    """All node rows with `_hit`; simple selectors need no window and keep every row in place."""
    chains = parse_selector(selector)
    if all(len(chain) == 1 for chain in chains):
        test = F.lit(False)
        for chain in chains:
            test = test | chain[0].test
        return nodes.withColumn("_hit", (F.col("kind") == "element") & test)
    others = nodes.filter(F.col("kind") != "element").withColumn("_hit", F.lit(False))
    return css_flag(nodes, selector, "_hit").unionByName(others)


def child_stats(nodes: DataFrame) -> DataFrame:
    """Per parent: child counts and first/last child, over all nodes and over elements only."""
    is_elem = F.col("kind") == "element"
    elem_id = F.when(is_elem, F.col("node_id"))
    return nodes.filter(F.col("parent_id").isNotNull()).groupBy("page_id", "parent_id").agg(
        F.max("parent_tag").alias("parent_tag"), F.count("*").alias("child_nodes"), F.count(elem_id).alias("child_count"),
        F.min("node_id").alias("first_child"), F.max("node_id").alias("last_child"),
        F.min(elem_id).alias("first_elem"), F.max(elem_id).alias("last_elem"))


def sibling_links(nodes: DataFrame) -> DataFrame:
    """Node rows with next and previous sibling ids, over all nodes and over elements only."""
    elem_id = F.when(F.col("kind") == "element", F.col("node_id"))
    backward = siblings(F.desc("sib"))
    return nodes.select(
        "*", F.lead("node_id").over(siblings()).alias("next_sibling"),
        F.lag("node_id").over(siblings()).alias("prev_sibling"),
        F.min(elem_id).over(before(backward)).alias("next_elem"),
        F.max(elem_id).over(before(siblings())).alias("prev_elem"))


def class_list(attrs="attrs") -> Column:
    names = F.filter(F.split(F.col(attrs)["class"], r"\s+"), lambda c: c != "")
    return F.coalesce(F.array_distinct(names), F.array().cast("array<string>"))


def has_attribute(name: str, attrs="attrs") -> Column:
    """Presence test; also the value of boolean attributes such as `checked`."""
    return F.map_contains_key(F.col(attrs), name.lower())


def data_attributes(attrs="attrs") -> Column:
    """The `data-*` attributes without their prefix."""
    held = F.map_filter(F.col(attrs), lambda k, _: k.startswith("data-"))
    return F.transform_keys(held, lambda k, _: F.substring(k, F.lit(6), F.length(k)))


# -- bulk edits: they return a new node table and keep its invariants


def _without_key(name: str) -> Column:
    return F.map_filter(F.col("attrs"), lambda k, _: k != name.lower())


def set_attribute(nodes: DataFrame, selector: str, name: str, value) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    changed = F.map_concat(_without_key(name), F.create_map(F.lit(name.lower()), value))
    return _flag_all(nodes, selector).withColumn("attrs", F.when(F.col("_hit"), changed).otherwise(
        F.col("attrs"))).drop("_hit")


def remove_attribute(nodes: DataFrame, selector: str, name: str) -> DataFrame:
    return _flag_all(nodes, selector).withColumn("attrs", F.when(F.col("_hit"), _without_key(name)).otherwise(
        F.col("attrs"))).drop("_hit")


def drop_elements(nodes: DataFrame, selector: str) -> DataFrame:
    """Remove matching elements with everything below them. Ids of the rest are unchanged."""
    flagged = _flag_all(nodes, selector)
    return flagged.withColumn("_gone", inside_or_self(F.col("_hit"))).filter("NOT _gone").drop("_hit", "_gone")


def set_text(nodes: DataFrame, selector: str, text: str) -> DataFrame:
    """Replace the content of every outermost match by one text node.

    Ids are doubled, which leaves a free odd id right after each element for its new text.
    """
    flagged = _flag_all(nodes, selector)
    flagged = flagged.withColumn("_below", inside(F.col("_hit"))).filter("NOT _below").drop("_below")
    wide = flagged.withColumns({
        "node_id": F.col("node_id") * 2, "parent_id": F.col("parent_id") * 2, "end_id": F.col("end_id") * 2 + 1})
    new = wide.filter("_hit").select(
        "page_id", "url", (F.col("node_id") + 1).alias("node_id"), F.col("node_id").alias("parent_id"),
        (F.col("node_id") + 1).alias("end_id"), (F.col("depth") + 1).alias("depth"), F.lit(0).alias("sib"),
        F.lit(None).cast("int").alias("elem"), F.lit(None).cast("boolean").alias("last_elem"),
        F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tag"),
        F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(text).alias("text"),
        "text_from", "text_to", F.col("tag").alias("parent_tag"), F.col("end_id").alias("parent_end"),
        F.col("text_to").alias("parent_to"), F.lit(None).cast("int").alias("heading"))
    return wide.drop("_hit").unionByName(new)


def live_text(nodes: DataFrame) -> DataFrame:
    """(page_id, content): the page text rebuilt from the text rows, for edited node tables."""
    text = F.when(F.col("kind") == "text", F.struct("node_id", "text"))
    ordered = F.array_sort(F.collect_list(text))
    return nodes.groupBy("page_id").agg(
        F.array_join(F.transform(ordered, lambda r: r["text"]), "").alias("content"))


# -- serialization


def _escape(text: Column, quote: bool) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(" "), F.lit("&nbsp;"))
    if quote:
        return F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def markup(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, url, node_id, outer_html, inner_html) of every match.

    Every page with a match is written once, as ordered open and close pieces; a running byte count
    gives each element its range, and matches are slices of the page's markup. One parse, one
    shuffle.
    """
    rows = _flag_all(nodes, selector).filter(F.col("kind").isin("element", "text", "comment"))
    pairs = F.transform(F.map_entries("attrs"), lambda a: F.concat(
        F.lit(" "), a["key"], F.lit('="'), _escape(a["value"], True), F.lit('"')))
    opening = (
        F.when(F.col("kind") == "element", F.concat(F.lit("<"), F.col("tag"), F.array_join(pairs, ""), F.lit(">")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), F.col("text"), F.lit("-->")))
        .when(F.coalesce(F.col("parent_tag").isin(list(RAW_TEXT)), F.lit(False)), F.col("text"))
        .otherwise(_escape(F.col("text"), False)))
    closing = F.when((F.col("kind") == "element") & ~F.col("tag").isin(list(VOID)),
                     F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise("")
    pieces = F.array(
        F.struct(F.col("node_id").alias("pos"), F.lit(0).alias("side"), F.lit(0).alias("up"), opening.alias("s")),
        F.struct(F.col("end_id").alias("pos"), F.lit(1).alias("side"), (-F.col("depth")).alias("up"), closing.alias("s")))
    written = rows.select("page_id", "url", "node_id", "_hit", F.explode(pieces).alias("p")).withColumn(
        "_to", F.sum(F.octet_length("p.s")).over(up_to_here(by_page("p.pos", "p.side", "p.up"))))
    edge = F.struct((F.col("_to") - F.octet_length("p.s")).alias("a"), F.col("_to").alias("b"))
    ordered = F.array_sort(F.collect_list(F.struct("p.pos", "p.side", "p.up", "p.s")))
    ends = F.map_from_entries(F.collect_list(F.when(F.col("_hit") & (F.col("p.side") == 1), F.struct("node_id", edge.alias("e")))))
    starts = F.collect_list(F.when(F.col("_hit") & (F.col("p.side") == 0), F.struct("node_id", edge.alias("e"))))
    page = written.groupBy("page_id").agg(
        F.first("url").alias("url"), starts.alias("_starts"), ends.alias("_ends"),
        F.array_join(F.transform(ordered, lambda r: r["s"]), "").alias("_page"))
    hits = page.filter(F.size("_starts") > 0).select("page_id", "url", "_page", "_ends", F.inline("_starts"))

    def cut(start: Column, stop: Column) -> Column:
        return F.substring(F.col("_page").cast("binary"), (start + 1).cast("int"), (stop - start).cast("int")).cast("string")

    end = F.col("_ends")[F.col("node_id")]
    return hits.select("page_id", "url", "node_id", cut(F.col("e.a"), end["b"]).alias("outer_html"),
                       cut(F.col("e.b"), end["a"]).alias("inner_html"))


# -- document shortcuts and click targets


def links_of(nodes: DataFrame) -> DataFrame:
    return css_select(nodes, "a[href]")


def forms_of(nodes: DataFrame) -> DataFrame:
    return css_select(nodes, "form")


def title_of(nodes: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("page_id", "tag").orderBy("node_id")) == 1
    rows = nodes.withColumn("_hit", F.coalesce((F.col("tag") == "title") & first, F.lit(False)))
    return with_text(rows, F.col("_hit"), "title").select("page_id", "title")


def field_key(attrs: Column, tag: Column) -> Column:
    """The key under which a filled value of a field is kept: id, else tag and name, else tag."""
    held = F.nullif(attrs["id"], F.lit("")), F.nullif(attrs["name"], F.lit(""))
    return (F.when(held[0].isNotNull(), F.concat(F.lit("#"), held[0]))
            .when(held[1].isNotNull(), F.concat(tag, F.lit("[name='"), held[1], F.lit("']")))
            .otherwise(tag))


def form_key(attrs: Column) -> Column:
    return F.coalesce(F.concat(F.lit("form#"), attrs["id"]), F.lit("form"))


def click_target(nodes: DataFrame, selector: str) -> DataFrame:
    """(page_id, node_id, action, target) for each match: what a click on it would do.

    Links follow their address; buttons and submit inputs submit the nearest form above, forms
    themselves. Anything else has neither action nor target.
    """
    rows = css_flag(nodes, selector, "_hit")
    rows = nearest(rows, F.col("tag") == "form", "_form_id")
    form = F.max(F.when(F.col("tag") == "form", form_key(F.col("attrs")))).over(
        Window.partitionBy("page_id", "_form_id"))
    submits = (F.col("tag") == "button") | (
        (F.col("tag") == "input") & (F.lower(F.coalesce(F.col("attrs")["type"], F.lit("submit"))) == "submit"))
    target = F.when(F.col("tag") == "a", F.col("attrs")["href"]).when(
        (submits | (F.col("tag") == "form")) & F.col("_form_id").isNotNull(), F.col("_form"))
    action = F.when(target.isNotNull(), F.when(F.col("tag") == "a", "link").otherwise("submit"))
    return (rows.withColumn("_form", form).filter("_hit")
            .select("page_id", "node_id", action.alias("action"), target.alias("target")))
