"""SQL names for column functions, and a table function that parses one page."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagewright.functions.text import DANGEROUS

REFERENCES = r"&(?:amp|lt|gt|quot|nbsp|apos|#x\+?[0-9a-fA-F]+|#\+?[0-9]+);|&|[^&]+"
_NUMBER = "CASE WHEN t LIKE '&#x%' THEN conv({d}, 16, 10) ELSE {d} END".format(d=r"regexp_extract(t, r'^&#x?\+?0*([0-9a-fA-F]+);$', 1)")
# One reference; the result of a replacement is never decoded again, and dangerous characters are left out.
_DECODED = f"""CASE t WHEN '&amp;' THEN '&' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>' WHEN '&quot;' THEN '"' WHEN '&nbsp;' THEN ' ' WHEN '&apos;' THEN r"'"
 ELSE CASE WHEN t LIKE '&#%;' AND length({_NUMBER}) BETWEEN 1 AND 10 AND bigint({_NUMBER}) <= 1114111 AND NOT bigint({_NUMBER}) BETWEEN 55296 AND 57343
 THEN regexp_replace(decode(unhex(lpad(hex(bigint({_NUMBER})), 8, '0')), 'UTF-32'), r'[{DANGEROUS}]', '') ELSE t END END"""
# name(parameters) -> (result type, SQL body)
SQL_FUNCTIONS = {
    "pw_tokens(s STRING)": ("BIGINT", "octet_length(s) div 4"),
    "pw_collapse_ws(s STRING)": ("STRING", r"ltrim(regexp_replace(s, r'(?U)\s+', ' '))"),
    "pw_strip_tags(s STRING)": ("STRING", r"regexp_replace(regexp_replace(s, '<[^>]*>', ' '), r'<[^>]*\z', '')"),
    "pw_normalize_ws(s STRING)": ("STRING", r"regexp_replace(regexp_replace(regexp_replace(s, r'(?U)(?<![^\S\n])[^\S\n]++(?=\n|\z)', ''), r'\n{3,}', '\n\n'), r'\A\n+|\n+\z', '')"),
    "pw_decode_entities(s STRING)": ("STRING", f"array_join(transform(regexp_extract_all(s, r'{REFERENCES}', 0), t -> {_DECODED}), '')"),
    "pw_clean(s STRING)": ("STRING", r"regexp_replace(pw_collapse_ws(pw_decode_entities(pw_strip_tags(s))), r'(?U)\s+\z', '')"),
    "pw_mime_base(ct STRING)": ("STRING", "coalesce(trim(split_part(ct, ';', 1)), 'text/html')"),
    "pw_is_text_mime(m STRING)": ("BOOLEAN", "lower(m) LIKE 'text/%' OR lower(m) LIKE '%+xml' OR lower(m) LIKE '%+json' OR lower(m) IN ('application/xhtml+xml', 'application/xml', 'application/json', 'application/javascript')"),
    "pw_address(url STRING)": ("STRING", r"replace(regexp_replace(regexp_replace(url, r'\A[\x00-\x20]+|[\x00-\x20]+\z', ''), r'[\t\n\r]', ''), r'\', '/')"),
    "pw_authority(url STRING)": ("STRING", r"regexp_extract(pw_address(url), r'^(?i:https?|wss?|ftp):/*(?:[^/?#]*@)?([^/?#]+)', 1)"),
    "pw_host(url STRING)": ("STRING", r"nullif(lower(regexp_extract(pw_authority(url), r'^(\[[^\]]*\]|[^:]*)', 1)), '')"),
    "pw_origin(url STRING)": ("STRING", r"lower(regexp_extract(pw_address(url), '^[A-Za-z]+', 0)) || '://' || pw_host(url) || coalesce(':' || nullif(nullif(regexp_extract(pw_authority(url), r':0*([0-9]+)$', 1), ''), CASE lower(regexp_extract(pw_address(url), '^[A-Za-z]+', 0)) WHEN 'http' THEN '80' WHEN 'ws' THEN '80' WHEN 'https' THEN '443' WHEN 'wss' THEN '443' ELSE '21' END), '')"),
    "pw_domain_matches(p STRING, h STRING)": ("BOOLEAN", "CASE WHEN lower(p) LIKE '*.%' THEN endswith(lower(h), substring(lower(p), 2)) AND length(h) > length(p) - 1 ELSE lower(h) = lower(p) END"),
}


class HtmlNodes:
    """SELECT * FROM pw_html_nodes(html): the node rows of one page, for one-off use in SQL."""

    def eval(self, html: str):
        from pagewright.operators.dom import COLUMNS, page_rows
        from pagewright.operators.htmltree import parse_html

        for row in page_rows(0, None, parse_html(html or ""), 0, lambda kind, tag: True, frozenset(), False, COLUMNS):
            yield row[2], row[3], row[4], row[5], row[9], row[10], dict(row[11] or []), row[12]


def register(spark: SparkSession) -> None:
    """Register everything as temporary functions of the session."""
    for signature, (kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    nodes = udtf(HtmlNodes, returnType="node_id int, parent_id int, end_id int, depth int, kind string, tag string, "
                                       "attrs map<string,string>, text string")
    spark.udtf.register("pw_html_nodes", nodes)
