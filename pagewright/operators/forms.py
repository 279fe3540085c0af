"""Forms over node rows: definitions, default values, overlays and the requests they submit."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.urls import form_encode, resolve_url
from pagewright.operators.dom import elements, html_nodes
from pagewright.operators.selectors import css_flag, field_key, form_key, nearest, needed_tags

FORM_TAGS = ("form", "input", "textarea", "select", "option", "button")
# Accepted methods, and controls that carry no value.
METHODS = ["POST", "PUT", "PATCH", "DELETE"]
NO_VALUE = ["submit", "button", "image", "reset", "file"]


def form_nodes(pages: DataFrame, selectors: Iterable[str] = ()) -> DataFrame:
    """Element rows of forms and controls, and of what the given selectors name besides."""
    tags = set(FORM_TAGS)
    for selector in selectors:
        needed = needed_tags(selector)
        tags = None if needed is None or tags is None else tags | needed
    return html_nodes(pages, tags, kinds=("element",), texts=("textarea", "option"))


def extract_forms(nodes: DataFrame) -> DataFrame:
    """(page_id, url, form_id, selector, action, method, enctype)."""
    attrs = F.col("attrs")
    method = F.upper(attrs["method"])
    multipart = attrs["enctype"] == "multipart/form-data"
    return elements(nodes).filter(F.col("tag") == "form").select(
        "page_id", "url", F.col("node_id").alias("form_id"), form_key(attrs).alias("selector"),
        attrs["action"].alias("action"), F.when(method.isin(METHODS), method).otherwise("GET").alias("method"),
        F.when(multipart, "multipart").otherwise("urlencoded").alias("enctype"))


def form_fields(nodes: DataFrame) -> DataFrame:
    """(page_id, form_id, name, value): default values of the named controls of every form.

    A later control of the same name wins, with inputs before text areas before selects.
    """
    attrs = F.col("attrs")
    rows = nearest(elements(nodes), F.col("tag") == "form", "form_id")
    rows = nearest(rows.filter(F.col("form_id").isNotNull()), F.col("tag") == "select", "select_id")
    kind = F.lower(F.coalesce(attrs["type"], F.lit("text")))
    checked = F.map_contains_key(attrs, "checked")
    input_value = F.when(kind.isin("checkbox", "radio"), F.when(checked, F.coalesce(attrs["value"], F.lit("on")))).when(
        ~kind.isin(NO_VALUE), F.coalesce(attrs["value"], F.lit("")))
    is_option = F.col("tag") == "option"
    option = F.when(is_option & F.col("select_id").isNotNull(), F.struct(
        (~F.map_contains_key(attrs, "selected")).alias("unselected"), F.col("node_id")))
    order = F.when(F.col("tag") == "input", 0).when(F.col("tag") == "textarea", 1).when(F.col("tag") == "select", 2)
    control = F.when(order == 2, F.col("node_id")).when(is_option, F.col("select_id")).otherwise(F.col("node_id"))
    controls = (
        rows.withColumn("_control", control).groupBy("page_id", "form_id", "_control").agg(
            F.max(F.when(order.isNotNull(), attrs["name"])).alias("name"), F.max(order).alias("_pass"),
            F.max(F.when(order == 0, input_value).when(order == 1, F.coalesce(F.col("text"), F.lit("")))).alias("_typed"),
            F.min_by(F.coalesce(attrs["value"], F.col("text")), option).alias("_chosen"))
        .withColumn("value", F.when(F.col("_pass") == 2, F.col("_chosen")).otherwise(F.col("_typed")))
        .filter((F.col("name") != "") & F.col("value").isNotNull()))
    return controls.groupBy("page_id", "form_id", "name").agg(
        F.max_by("value", F.struct("_pass", "_control")).alias("value"))


def validate_fields(nodes: DataFrame, overlay: list[tuple[str, str]]) -> DataFrame:
    """(page_id, ord, selector, value, name, code) for each page and each (selector, value) pair.

    The first match must be an input, text area or select with a name; `code` is null if it is. Selectors that
    name other elements need them in the rows: see `form_nodes(pages, selectors)`.
    """
    rows = elements(nodes)
    for n, (selector, _) in enumerate(overlay):
        rows = css_flag(rows, selector, f"_f{n}")
    firsts = [F.min_by(F.struct("tag", F.col("attrs")["name"].alias("name")),
                       F.when(F.col(f"_f{n}"), F.col("node_id"))).alias(f"_m{n}") for n in range(len(overlay))]
    checks = [F.struct(F.lit(n).alias("ord"), F.lit(selector).alias("selector"), F.lit(value).alias("value"),
                       F.col(f"_m{n}").alias("m")) for n, (selector, value) in enumerate(overlay)]
    usable = F.col("m.tag").isin("input", "textarea", "select") & F.col("m.name").isNotNull()
    code = F.when(F.col("m").isNull(), "SELECTOR_NOT_FOUND").when(~usable, "FORM_NOT_FOUND")
    return (rows.groupBy("page_id").agg(*firsts).select("page_id", F.inline(F.array(*checks)))
            .select("page_id", "ord", "selector", "value", F.when(code.isNull(), F.col("m.name")).alias("name"),
                    code.alias("code")))


def fill(fields: DataFrame, forms: DataFrame, overlay: DataFrame) -> DataFrame:
    """Fields with overlay values put over the defaults; `overlay` is (page_id, ord, name, value).

    An overlay name that a form lacks is added to it.
    """
    own = fields.select("page_id", "form_id", "name", "value", F.lit(-1).alias("ord"))
    put = forms.select("page_id", "form_id").join(overlay, "page_id").select(
        "page_id", "form_id", "name", "value", "ord")
    return own.unionByName(put).groupBy("page_id", "form_id", "name").agg(F.max_by("value", "ord").alias("value"))


def encode_form(pairs: Column) -> Column:
    """`a=1&b=2` of array<struct<name,value>>, sorted by name."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(
        form_encode(p["name"]), F.lit("="), form_encode(p["value"]))), "&")


def submit_requests(forms: DataFrame, fields: DataFrame, get_as_query: bool = False) -> DataFrame:
    """(page_id, form_id, url, method, content_type, body) for every form.

    GET carries its fields in the body unless `get_as_query` moves them to the address.
    """
    bodies = fields.groupBy("page_id", "form_id").agg(encode_form(F.collect_list(F.struct("name", "value"))).alias("body"))
    action = F.coalesce(F.col("action"), F.lit(""))
    target = F.when(action == "", F.col("url")).otherwise(resolve_url("url", "action"))
    joined = forms.join(bodies, ["page_id", "form_id"], "left").select(
        "page_id", "form_id", target.alias("url"), "method",
        F.lit("application/x-www-form-urlencoded").alias("content_type"),
        F.coalesce("body", F.lit("")).alias("body"))
    if not get_as_query:
        return joined
    is_get = F.col("method") == "GET"
    bare = F.regexp_replace("url", r"[?#].*$", "")
    return joined.withColumn("url", F.when(is_get & (F.col("body") != ""), F.concat(bare, F.lit("?"), F.col("body"))).otherwise(
        F.col("url"))).withColumn("body", F.when(~is_get, F.col("body")))


def field_values(nodes: DataFrame, overlay: DataFrame) -> DataFrame:
    """(page_id, node_id, key, value) of every control: the filled value kept under its key in
    `overlay(page_id, key, value)`, else its default."""
    attrs = F.col("attrs")
    default = F.when(F.col("tag") == "textarea", F.col("text")).otherwise(attrs["value"])
    controls = elements(nodes).filter(F.col("tag").isin("input", "textarea", "select")).select(
        "page_id", "node_id", field_key(attrs, F.col("tag")).alias("key"),
        F.coalesce(default, F.lit("")).alias("_default"))
    put = overlay.select("page_id", "key", F.col("value").alias("_put"))
    return controls.join(put, ["page_id", "key"], "left").select(
        "page_id", "node_id", "key", F.coalesce("_put", "_default").alias("value"))
