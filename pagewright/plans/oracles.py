"""SQL twins of the registered queries, written for DuckDB on the same tables.

They rely on what the given pages look like (fixed shape, four named entities), so they are
independent of the library's parser.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

SITE = "https://site.example"


def _dec(x: str) -> str:
    """Decoded character references as they occur in the pages."""
    for name, value in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


def _text(x: str) -> str:
    """Text of a piece of page markup."""
    return _dec(f"regexp_replace(regexp_replace({x}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')")


def _pct(x: str) -> str:
    """Percent-encoded path characters."""
    return (f"list_reduce(list_prepend('', list_transform(string_split({x}, ''), lambda c: "
            "CASE WHEN c = '' OR ascii(c) < 128 THEN c ELSE url_encode(c) END)), lambda a, b: a || b)")


BODY = "regexp_extract(html, '<body>(.*)$', 1, 's')"
ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')"
TITLE = _dec("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")
LANG = "regexp_extract(html, '<html lang=\"([a-z]*)\"', 1)"
HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
TOKENS = f"(strlen({_text(BODY)}) // 4)"
ARTICLE_TOKENS = f"(strlen({_text(ARTICLE)}) // 4)"
# Fixed value: the text that is given in place of a page with content areas.
NOTICE = ("Page has content sections. Re-fetch with a `selector` for targeted content, or set "
          "`show_selectors_first=false` for the raw page.")
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_IN_LINE = r"[\t\x{0B}-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _links_cte(pages: str = "pages") -> str:
    return f"""
anchors AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS raw,
         unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS label,
         unnest(range(len(regexp_extract_all(html, '<a href="')))) AS i
  FROM {pages}),
shown AS (
  SELECT page_id, url, i::INT AS i, trim({_dec('label')}) AS text,
         CASE WHEN raw LIKE '/%' THEN {_pct(_dec('raw'))}
              WHEN starts_with({_dec('raw')}, regexp_extract(url, '^https?://[^/]+', 0) || '/')
                THEN substr({_dec('raw')}, length(regexp_extract(url, '^https?://[^/]+', 0)) + 1)
              ELSE {_dec('raw')} END AS href, {_dec('raw')} AS raw
  FROM anchors),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY i) AS nth FROM shown WHERE text <> ''),
found AS (
  SELECT page_id, url, i, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, text, href, raw
  FROM kept WHERE nth = 1)"""


O = ORACLES

O["page_titles"] = f"SELECT page_id, nullif(trim({TITLE}), '') AS title FROM pages"
O["page_meta"] = f"""SELECT page_id, {LANG} AS lang, NULL::VARCHAR AS description,
  'text/html; charset=' || regexp_extract(html, '<meta charset="([^"]*)"', 1) AS content_type FROM pages"""
O["page_tokens"] = f"SELECT page_id, {TOKENS} AS page_tokens FROM pages"
O["links"] = f"WITH {_links_cte()} SELECT page_id, i, pos, text, href FROM found"
O["links_per_host"] = f"""WITH {_links_cte()} SELECT {HOST} AS host, count(*) AS links,
  count(DISTINCT page_id) AS pages, count(DISTINCT href) AS hrefs FROM found GROUP BY 1"""
O["css_paragraph_text"] = f"""
WITH parts AS (SELECT page_id, unnest(string_split({ARTICLE}, '<p>')[2:]) AS part,
               unnest(range(1, len(string_split({ARTICLE}, '<p>')))) AS nth FROM pages)
SELECT page_id, nth::INT AS nth, {_text("string_split(part, '</p>')[1]")} AS content FROM parts"""
O["css_counts"] = """SELECT page_id, len(regexp_extract_all(html, '<a href="/')) AS nav_links,
  len(regexp_extract_all(html, '<p>')) AS paras,
  greatest(len(regexp_extract_all(html, '<li>')) - 1, 0) AS later_items,
  least(len(regexp_extract_all(html, '<li>')), 1) AS first_items, 2::BIGINT AS metas, 0::BIGINT AS not_ads FROM pages"""
O["children_count"] = """SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items,
  len(regexp_extract_all(html, '<li>')) AS nodes FROM pages WHERE contains(html, '<li>')"""
O["sibling_steps"] = """SELECT page_id, len(regexp_extract_all(html, '<li>')) - 1 AS with_next,
  len(regexp_extract_all(html, '<li>')) - 1 AS with_prev, len(regexp_extract_all(html, '<li>')) AS items
FROM pages WHERE contains(html, '<li>')"""
O["parent_tags"] = """SELECT page_id, 'li' AS parent_tag, len(regexp_extract_all(html, '<a href')) AS n
FROM pages WHERE contains(html, '<a href')"""
O["closest_nav"] = """
SELECT page_id, 'a' AS tag, len(regexp_extract_all(html, '<a href')) AS n, n AS found, 1 AS areas FROM pages WHERE contains(html, '<a href')
UNION ALL
SELECT page_id, 'p', len(regexp_extract_all(html, '<p>')) AS n, n, 1 FROM pages WHERE contains(html, '<p>')"""
O["matches_flag"] = "SELECT true AS matched, sum(len(regexp_extract_all(html, '<a href')))::BIGINT AS n FROM pages"
O["first_link_in_nav"] = f"""SELECT page_id, {_dec("regexp_extract(html, '<a href=[^>]*>([^<]*)</a>', 1)")} AS first_text
FROM pages WHERE contains(html, '<a href')"""
O["class_lookup"] = f"""SELECT page_id, 'ad' AS classes, false AS has_id,
  {_text("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")} AS content FROM pages"""
O["nav_markup"] = f"SELECT page_id, replace({NAV}, '&quot;', '\"') AS inner_html FROM pages"
O["text_without_nav"] = f"""
WITH t AS (SELECT page_id, {_text("regexp_replace(regexp_replace(" + BODY + ", '<nav>.*?</nav>', '', 's'), '<footer>.*?</footer>', '', 's')")} AS t FROM pages)
SELECT page_id, md5(t) AS digest, strlen(t) AS bytes FROM t"""
O["edited_titles"] = f"SELECT page_id, 'Untitled' AS title, '1' AS seen, {LANG} AS lang FROM pages"
O["article_text"] = f"SELECT page_id, md5({_text(ARTICLE)}) AS digest, strlen({_text(ARTICLE)}) AS bytes FROM pages"
O["content_selectors"] = f"""SELECT page_id, 1 AS rank, 'article' AS selector, {ARTICLE_TOKENS} AS tokens_est,
  NULL::VARCHAR AS label FROM pages WHERE {ARTICLE_TOKENS} >= 500"""

_LINES = """lines AS (
  SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1)::INT AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS nth
    FROM documents) WHERE trim(line, ' ') <> '')"""
O["document_outline"] = f"""WITH {_LINES} SELECT doc_id AS page_id, '#s' || n AS selector, strlen(line) // 4 AS tokens_est,
  'Part ' || n AS label FROM lines WHERE strlen(line) // 4 >= 40"""
O["section_content"] = f"""WITH {_LINES}, t AS (SELECT doc_id, string_agg(regexp_replace('Part ' || n || line, '{WS}+$', ''), chr(10) || chr(10) ORDER BY n) AS t FROM lines GROUP BY 1)
SELECT doc_id AS page_id, md5(t) AS digest, strlen(t) AS bytes FROM t"""
_COUNTS = f"""counts AS (SELECT page_id, count(*) AS links FROM found GROUP BY 1),
facts AS (
  SELECT page_id, url, html, nullif(trim({TITLE}), '') AS title, {LANG} AS lang, {TOKENS} AS tokens_est,
         strlen(html) AS content_bytes, coalesce(links, 0) AS links, {ARTICLE_TOKENS} AS area
  FROM pages LEFT JOIN counts USING (page_id))"""
O["page_results"] = f"""WITH {_links_cte()}, {_COUNTS}
SELECT page_id, url, title, lang, 'text/html; charset=utf-8' AS content_type, tokens_est, content_bytes, false AS truncated,
       links::INT AS links, 1 AS areas FROM facts"""
O["page_report"] = f"""WITH {_links_cte()}, {_COUNTS}
SELECT page_id, '{NOTICE}' || chr(10) || chr(10) || '---' || chr(10)
  || coalesce('**Title:** ' || title || chr(10), '') || '**URL:** ' || url || chr(10) || '**Status:** 200' || chr(10)
  || '**Links:** ' || links || chr(10) || '**Tokens (est):** ' || tokens_est || chr(10)
  || chr(10) || '**Content selectors:**' || chr(10) || '- `article` — ~' || area || ' tokens' || chr(10) AS report FROM facts"""
for _name, _by in (("host", HOST), ("lang", "lang")):
    O[f"stats_by_{_name}"] = f"""WITH {_links_cte()}, {_COUNTS}
SELECT {_by} AS {_name}, count(*) AS pages, sum(tokens_est)::BIGINT AS tokens, max(tokens_est) AS max_tokens,
       sum(content_bytes)::BIGINT AS bytes, sum(links)::BIGINT AS links, 0::BIGINT AS truncated_pages, quantile_cont(tokens_est, 0.5)::DOUBLE AS median_tokens FROM facts GROUP BY 1"""
O["section_savings"] = f"""WITH s AS (SELECT {TOKENS} / greatest({ARTICLE_TOKENS}, 1) AS x FROM pages)
SELECT count(*) AS pages, round(quantile_cont(x, 0.5), 6) AS median_saving, round(quantile_cont(x, 0.9), 6) AS p90_saving FROM s"""
_TYPE = """CASE page_id % 8 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/rss+xml'
  WHEN 3 THEN 'application/ld+json;x=1' WHEN 4 THEN 'text/xml' WHEN 5 THEN 'application/pdf' WHEN 6 THEN NULL
  ELSE 'text/plain; charset="latin1"' END"""
O["routed_responses"] = f"""SELECT page_id, CASE WHEN page_id % 8 IN (1, 5) THEN NULL ELSE nullif(trim({TITLE}), '') END AS title,
  CASE WHEN page_id % 8 = 1 THEN 'image/png' WHEN page_id % 8 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN page_id % 8 IN (1, 5) THEN 10 ELSE {TOKENS} END AS tokens_est, page_id % 8 IN (1, 5) AS is_binary FROM pages"""
def _flat(x: str) -> str:
    """Decoded text with single spaces and none in front."""
    return f"ltrim(regexp_replace({_dec(x)}, '{WS}+', ' ', 'g'), ' ')"


# A <b> that a <p> cuts off is opened again in all that follows, at most three deep. What the parser decoded is decoded once more.
_MARKDOWN = f"""nav AS (SELECT page_id, string_agg('- [' || trim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ') || '](' || href || ')', chr(10) ORDER BY i) AS nav FROM found GROUP BY 1),
paras AS (SELECT page_id, k, starts_with(p, '<b>') AS opens, {_flat("regexp_extract(p, '^(?:<b>)?([^<]*)', 1)")} AS t
  FROM (SELECT page_id, unnest(string_split({ARTICLE}, '<p>')[2:]) AS p, unnest(range(1, len(string_split({ARTICLE}, '<p>')))) AS k FROM pages)),
deep AS (SELECT *, repeat('**', (CASE WHEN opens THEN least(3, n - 1) + 1 ELSE least(3, n) END)::INT) AS b
  FROM (SELECT *, sum(opens::INT) OVER (PARTITION BY page_id ORDER BY k) AS n FROM paras)),
body AS (SELECT page_id, string_agg(CASE WHEN trim(t, ' ') = '' THEN '' ELSE b || t || CASE WHEN opens THEN chr(10) ELSE '' END || b END, chr(10) || chr(10) ORDER BY k) AS body, repeat('**', least(3, max(n))::INT) AS b FROM deep GROUP BY 1),
joined AS (SELECT page_id, {_flat("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")} || chr(10) || coalesce(nav || chr(10) || chr(10), '') || {_flat("regexp_extract(html, '<div class=.ad.>(.*?)</div>', 1, 's')")}
  || chr(10) || chr(10) || '# ' || {_flat("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} || chr(10) || coalesce(body, '') || chr(10) || chr(10)
  || coalesce(b, '') || {_flat("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} || coalesce(b, '') AS md FROM pages LEFT JOIN nav USING (page_id) LEFT JOIN body USING (page_id)),
markdown AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(md, '&quot;', '"'), '&amp;', '&'),
  '{WS_IN_LINE}+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS md FROM joined)"""
O["page_markdown"] = f"""WITH {_links_cte()}, {_MARKDOWN} SELECT page_id, strlen(md) // 4 AS tokens_est, false AS truncated, md5(md) AS digest FROM markdown"""
O["selectors_first"] = f"""WITH {_links_cte()}, {_MARKDOWN}
SELECT page_id, {ARTICLE_TOKENS} >= 500 AS notice, md5(CASE WHEN {ARTICLE_TOKENS} >= 500 THEN '{NOTICE}' ELSE md END) AS digest,
  CASE WHEN {ARTICLE_TOKENS} >= 500 THEN {TOKENS} ELSE strlen(md) // 4 END AS tokens_est, CASE WHEN {ARTICLE_TOKENS} >= 500 THEN 1 END AS areas
FROM pages JOIN markdown USING (page_id)"""
O["markdown_headings"] = f"""WITH {_LINES}, t AS (SELECT doc_id, n, '## Part ' || n || chr(10) || regexp_replace(regexp_replace(line, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM lines),
md AS (SELECT doc_id, count(*) AS sections, string_agg(t, chr(10) || chr(10) ORDER BY n) AS md FROM t GROUP BY 1)
SELECT documents.doc_id AS page_id, coalesce(sections, 0) AS sections, strlen(coalesce(md, '')) // 4 AS tokens_est, md5(coalesce(md, '')) AS digest FROM documents LEFT JOIN md USING (doc_id)"""
O["markdown_nav"] = f"""WITH {_links_cte()}
SELECT page_id, coalesce(nav, '') AS nav FROM pages LEFT JOIN (
  SELECT page_id, string_agg('- [' || text || '](' || href || ')', chr(10) ORDER BY i) AS nav FROM found GROUP BY 1) USING (page_id)"""
O["result_types"] = "SELECT 'object' AS type, count(*) AS n FROM events"

# -- addresses and navigation

O["url_origin"] = f"SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) AS origin, {HOST} AS host FROM pages"
_DIR = "regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '')"
_UP = f"CASE WHEN {_DIR} = '/' THEN '/' ELSE regexp_replace({_DIR}, '[^/]*/$', '') END"
O["url_resolve"] = f"""SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) || ({_UP}) || 'x/y?z=' || page_id AS absolute,
  ({_UP}) || 'x/y?z=' || page_id AS shown, regexp_replace(url, '#.*$', '') || '#part' AS part FROM pages"""
O["search_url"] = """SELECT item_id, 'https://s.example/?q=' ||
  replace(replace(replace(url_encode(text), '%20', '+'), '~', '%7E'), '%2A', '*') || '&x={}' AS url FROM benchmark"""
_KEYS = "keys AS (SELECT regexp_replace(url, '#.*$', '') AS key, min(page_id) AS hit FROM pages GROUP BY 1)"
O["fetch_from_corpus"] = f"""WITH {_KEYS}, asked AS (
  SELECT event_id AS request_id, CASE WHEN event_id // 25 = 7 THEN 'not an address' ELSE coalesce(url, '{SITE}/missing') END AS url
  FROM events LEFT JOIN pages ON page_id = event_id // 25)
SELECT request_id, hit AS page_id, CASE WHEN url = 'not an address' THEN 'INVALID_URL' WHEN hit IS NULL THEN 'HTTP_ERROR' END AS code,
       CASE WHEN url = 'not an address' THEN false WHEN hit IS NULL THEN true END AS retryable
FROM asked LEFT JOIN keys ON key = regexp_replace(url, '#.*$', '')"""
_LINKED = """linked AS (
  SELECT p.page_id, p.url, p.html || coalesce('<a href="' || replace(q.url, '&', '&amp;') || '">Next page</a>', '') AS html
  FROM pages p LEFT JOIN pages q ON q.page_id = p.page_id + 1)"""
_EDGES = f"""WITH {_KEYS}, {_LINKED}, {_links_cte('linked')},
targets AS (SELECT *, regexp_replace(CASE WHEN raw LIKE '/%' THEN regexp_extract(url, '^https?://[^/]+', 0) || href ELSE raw END, '#.*$', '') AS key FROM found)"""
O["link_graph"] = f"{_EDGES} SELECT page_id AS src, hit AS dst, pos FROM targets JOIN keys USING (key)"
O["link_degrees"] = f"""{_EDGES}, e AS (SELECT page_id AS src, hit AS dst FROM targets JOIN keys USING (key)),
ends AS (SELECT src AS page_id, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
SELECT page_id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM ends GROUP BY 1"""
O["dangling_links"] = f"{_EDGES} SELECT page_id, count(*) AS n FROM targets ANTI JOIN keys USING (key) GROUP BY 1"
_ABS = "regexp_extract(f.url, '^https?://[^/]+', 0) || f.href"
O["follow_by_index"] = f"""WITH {_links_cte()}
SELECT event_id, CASE WHEN f.page_id IS NOT NULL THEN {_ABS} END AS target, CASE WHEN f.page_id IS NULL THEN 'LINK_NOT_FOUND' END AS code
FROM events e LEFT JOIN found f ON f.page_id = event_id // 40 AND f.pos = (props->>'$.k')::INT % 9"""
O["follow_by_text"] = f"""WITH {_links_cte()}, asked AS (
  SELECT event_id, event_id // 40 AS page_id, ['TH', 'e', 'la', 'zz'][(props->>'$.k')::INT % 4 + 1] AS needle FROM events),
hits AS (SELECT event_id, min(pos) AS pos FROM asked JOIN found f USING (page_id) WHERE contains(lower(text), lower(needle)) GROUP BY 1)
SELECT a.event_id, CASE WHEN f.page_id IS NOT NULL THEN {_ABS} END AS target, CASE WHEN f.page_id IS NULL THEN 'LINK_NOT_FOUND' END AS code
FROM asked a LEFT JOIN hits h USING (event_id) LEFT JOIN found f ON f.page_id = a.page_id AND f.pos = h.pos"""
O["redirect_chain"] = f"""WITH RECURSIVE {_KEYS}, moves AS (
  SELECT key, q.url AS target FROM keys JOIN pages p ON p.page_id = hit JOIN pages q ON q.page_id = p.page_id + 1
  WHERE p.page_id % 4 <> 0 AND p.url <> q.url),
walk AS (
  SELECT page_id, url AS final_url, 0 AS hops FROM pages
  UNION ALL
  SELECT page_id, target, hops + 1 FROM walk JOIN moves ON key = regexp_replace(final_url, '#.*$', '') WHERE hops < 5 AND target <> final_url)
SELECT page_id, arg_max(final_url, hops) AS final_url, max(hops)::INT AS hops FROM walk GROUP BY 1"""
_ESC_URL = "replace(replace(replace(replace(n.url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
O["redirect_pages"] = O["redirect_chain"].replace("SELECT page_id, arg_max", ", ends AS (SELECT page_id, arg_max", 1) + f"""),
reached AS (SELECT page_id, hops, CASE WHEN hops = 0 THEN page_id ELSE coalesce(hit, page_id) END AS e FROM ends LEFT JOIN keys ON key = regexp_replace(final_url, '#.*$', ''))
SELECT r.page_id, p.url, hops, md5(CASE WHEN p.page_id % 4 = 0 OR n.url IS NULL THEN p.html
  ELSE replace(p.html, '<head>', '<head><meta http-equiv="refresh" content="0; url=' || {_ESC_URL} || '">') END) AS digest
FROM reached r JOIN pages p ON p.page_id = e LEFT JOIN pages n ON n.page_id = e + 1"""
O["links_of_current"] = f"""WITH {_links_cte()}, now AS (SELECT user_id AS session, max(event_id) // 40 AS page_id FROM events GROUP BY 1)
SELECT session, pos, text, count(*) OVER (PARTITION BY session) AS count FROM now JOIN found USING (page_id)"""

O["search_hits"] = """WITH h AS (SELECT page_id, url, unnest([0, 1, 3, 4, 5]) AS n FROM pages)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n))::INT AS rank, 'Hit ' || n AS title, url || '+' || n AS url FROM h"""

# -- rules

O["domain_rules"] = f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages),
r(no, suffix, header, value) AS (VALUES (1, '.example.com', 'X-Zone', 'com'), (1, '.example.com', 'X-Any', '1'),
  (2, '.example.net', 'X-Zone', 'other'), (2, '.example.org', 'X-Zone', 'other'), (3, '.example.org', 'X-Zone', 'org'), (3, '.example.org', 'X-Org', 'yes')),
a AS (SELECT page_id, header, value, no FROM h JOIN r ON ends_with(host, suffix) AND length(host) > length(suffix)
  UNION ALL SELECT page_id, 'X-Any', 'own', 99 FROM h WHERE page_id % 3 = 0)
SELECT page_id AS request_id, header, arg_max(value, no) AS value FROM a GROUP BY 1, 2"""
O["auth_profiles"] = f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages),
c AS (SELECT page_id, CASE page_id % 4
  WHEN 0 THEN CASE WHEN NOT ends_with(host, '.example.com') THEN 'AUTH_PROFILE_DOMAIN_MISMATCH' END
  WHEN 1 THEN CASE WHEN NOT (ends_with(host, '.example.net') OR host = 'example.net') THEN 'AUTH_PROFILE_DOMAIN_MISMATCH' END
  WHEN 2 THEN 'AUTH_PROFILE_NOT_FOUND' END AS code FROM h)
SELECT page_id AS request_id, code, CASE WHEN page_id % 4 = 0 AND code IS NULL THEN 'Bearer c0m' END AS auth,
  CASE WHEN page_id % 4 = 1 AND code IS NULL THEN 'n3t' END AS x_key FROM c"""
O["response_kinds"] = f"""WITH t AS (SELECT page_id, html, {_TYPE} AS ct FROM pages),
m AS (SELECT page_id, html, ct, coalesce(trim(string_split(ct, ';')[1]), 'text/html') AS mime FROM t)
SELECT page_id, mime, (mime LIKE 'text/%' OR mime LIKE '%+xml' OR mime LIKE '%+json') AS is_text,
  coalesce(ct IS NOT NULL AND (mime LIKE '%+xml' OR mime = 'text/xml'), false) AS is_feed,
  CASE page_id % 8 WHEN 0 THEN 'utf-8' WHEN 7 THEN 'latin1' END AS charset,
  CASE WHEN mime IN ('image/png', 'application/pdf') THEN 'binary' ELSE 'html' END AS kind,
  '[Binary content: ' || coalesce(trim(string_split(ct, ';')[1]), 'application/octet-stream') || ', ' || strlen(html) || ' bytes]' AS note FROM m"""
O["error_codes"] = """WITH e AS (SELECT (props->>'$.k')::INT AS k FROM events), c AS (
  SELECT k, CASE k % 6 WHEN 0 THEN 'TIMEOUT' WHEN 4 THEN 'INVALID_URL' WHEN 5 THEN 'SESSION_ERROR' ELSE 'HTTP_ERROR' END AS code,
  CASE k % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'index' WHEN 2 THEN 'text' END AS mode FROM e)
SELECT code, code IN ('TIMEOUT', 'HTTP_ERROR') AS retryable, mode, count(*) AS n,
  sum(CASE WHEN k % 2 = 0 THEN k ELSE 1000 END)::BIGINT AS limits FROM c GROUP BY 1, 2, 3"""

# -- text

O["token_estimates"] = """SELECT lang, source, sum(strlen(text) // 4)::BIGINT AS tokens, max(strlen(text) // 4) AS max_tokens
FROM documents GROUP BY 1, 2"""
O["normalize_ws"] = f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text || chr(10), '{WS_IN_LINE}+\\n', chr(10), 'g'),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))) AS digest FROM documents"""
O["collapse_ws"] = f"SELECT doc_id, md5(ltrim(regexp_replace(text, '{WS}+', ' ', 'g'), ' ')) AS digest FROM documents"
_AMP = "replace(replace(html, '&quot;', '\"'), '&amp;', '&')"
O["decode_entities"] = f"SELECT page_id, md5({_AMP}) AS digest, strlen({_AMP}) AS bytes FROM pages"
_STRIPPED = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
O["clean_html_text"] = f"""SELECT page_id, md5(trim(regexp_replace(replace(replace({_STRIPPED}, '&quot;', '"'), '&amp;', '&'), '{WS}+', ' ', 'g'), ' ')) AS digest,
  strlen({_STRIPPED}) AS bytes FROM pages"""
O["strip_controls"] = r"""SELECT doc_id, md5(regexp_replace(text, '[\x{1}-\x{8}\x{B}-\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', '', 'g')) AS digest FROM documents"""
O["chunk_rows"] = "SELECT lang, count(DISTINCT doc_id) AS docs, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE text <> '' GROUP BY 1"
O["base64_round_trip"] = "SELECT conv_id, turn, md5(base64(encode(text))) AS digest, true AS same FROM conversations"
O["sql_functions"] = f"""SELECT page_id, strlen(html) // 4 AS tokens, regexp_extract(url, '^https?://[^/?#]+', 0) AS origin, 'text/html' AS mime,
  ends_with({HOST}, '.example.com') AS in_com, md5(trim(regexp_replace(replace(replace({_STRIPPED}, '&quot;', '"'), '&amp;', '&'), '{WS}+', ' ', 'g'), ' ')) AS digest FROM pages"""

_CHUNKS = """parts AS (
  SELECT doc_id, text, list_filter(regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+'), lambda x: x <> '') AS ls FROM documents),
pieces AS (SELECT doc_id, text, flatten(list_transform(ls, lambda l: CASE WHEN strlen(l) <= 400 THEN [l]
  ELSE list_transform(range(0, length(l), 100), lambda s: substr(l, s + 1, 100)) END)) AS ps FROM parts),
folded AS (SELECT doc_id, list_reduce(list_transform(ps, lambda p: {'n': 1, 'open': strlen(p), 'top': strlen(p)}),
  lambda a, b: CASE WHEN a.open + b.open <= 400 THEN {'n': a.n, 'open': a.open + b.open, 'top': greatest(a.top, a.open + b.open)}
               ELSE {'n': a.n + 1, 'open': b.open, 'top': greatest(a.top, b.open)} END) AS f FROM pieces WHERE len(ps) > 0)"""
O["chunk_tokens"] = f"""WITH {_CHUNKS} SELECT doc_id, coalesce(f.n, 0)::INT AS n_chunks, true AS lossless, f.top::INT AS max_bytes
FROM documents LEFT JOIN folded USING (doc_id)"""

# bytes up to every character, then the line-border rule in plain comparisons
O["truncate_tokens"] = """WITH tail AS (
  SELECT doc_id, text, CASE WHEN strlen(text) <= 80 THEN '' ELSE text END AS t FROM documents),
pos AS (SELECT doc_id, unnest(range(1, length(t) + 1)) AS p, unnest(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1))) AS ch FROM tail),
b AS (SELECT doc_id, p, ch, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY p) AS stop FROM pos),
line AS (SELECT doc_id, min(p) + 1 AS first, min(stop) AS skipped FROM b WHERE stop > 80 AND ch = chr(10) GROUP BY 1),
fits AS (SELECT b.doc_id, max(b.p) FILTER (ch = chr(10)) AS last_line, max(b.p) AS last_char FROM b JOIN line USING (doc_id)
  WHERE p >= first AND stop - skipped <= 240 GROUP BY 1),
cut AS (SELECT t.doc_id, coalesce(substr(t.t, first), '') AS rest, CASE WHEN first IS NOT NULL AND strlen(substr(t.t, first)) > 240
    THEN substr(t.t, first, coalesce(last_line, last_char) - first + 1) END AS head
  FROM tail t LEFT JOIN line USING (doc_id) LEFT JOIN fits USING (doc_id))
SELECT doc_id, strlen(coalesce(head, rest)) // 4 AS tokens_est, head IS NOT NULL AS truncated,
  CASE WHEN head IS NOT NULL THEN 20 + strlen(head) // 4 END AS next_offset, md5(coalesce(head, rest)) AS digest FROM cut"""

# -- feeds built from documents

_ITEMS = f"""WITH {_LINES}, items AS (
  SELECT l.doc_id, n AS idx, trim(line, ' ') AS s, lang, source FROM lines l JOIN documents d USING (doc_id))"""
_ESC = "replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_COLLAPSED = f"trim(regexp_replace(s, '{WS}+', ' ', 'g'), ' ')"
O["feed_items"] = f"""{_ITEMS} SELECT doc_id, idx, regexp_replace(s, '^{WS}+|{WS}+$', '', 'g') AS title, '/d/' || doc_id || '/' || idx AS link, lang AS category,
  md5('<p>' || {_ESC} || '</p>') AS digest FROM items"""
O["feed_channels"] = "SELECT doc_id, source AS title, lang AS description FROM documents"
O["feed_markdown"] = f"""{_ITEMS}, pieces AS (
  SELECT doc_id, idx, '## [' || trim(s, ' ') || '](/d/' || doc_id || '/' || idx || ')' || chr(10) || lang || chr(10) || chr(10)
    || {_COLLAPSED} || chr(10) || chr(10) AS piece FROM items),
bodies AS (SELECT d.doc_id, source, regexp_replace('# ' || source || chr(10) || '*' || d.lang || '*' || chr(10) || chr(10)
    || coalesce(string_agg(piece, '' ORDER BY idx), ''), '{WS}+$', '') AS md
  FROM documents d LEFT JOIN pieces USING (doc_id) GROUP BY d.doc_id, source, d.lang)
SELECT doc_id, source AS title, strlen(md) // 4 AS tokens_est, md5(md) AS digest FROM bodies"""
O["feed_links"] = f"""{_ITEMS} SELECT doc_id, count(*) AS n, max(idx) AS last_i, min('/d/' || doc_id || '/' || idx) AS first_href FROM items GROUP BY 1"""

# -- forms and tables

O["form_fields"] = """
SELECT c_custkey, 'name' AS name, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 'news', 'yes' FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 'note', 'nation ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 'empty', '' FROM customer"""
_FORM = "replace(replace(replace(url_encode({}), '%20', '+'), '~', '%7E'), '%2A', '*')"
O["submit_requests"] = f"""SELECT c_custkey, '{SITE}/save/' || c_custkey AS url, 'POST' AS method,
  'empty=%C3%A9&name=' || {_FORM.format('c_name')} || CASE WHEN c_nationkey % 2 = 0 THEN '&news=yes' ELSE '' END
  || '&note=filled+%26+sent&segment=' || {_FORM.format('c_mktsegment')} AS body FROM customer"""
O["field_values"] = """
SELECT c_custkey, 'input[name=''name'']' AS key, CASE WHEN c_nationkey < 5 THEN 'typed' ELSE c_name END AS value FROM customer
UNION ALL SELECT c_custkey, 'input[name=''news'']', 'yes' FROM customer
UNION ALL SELECT c_custkey, 'input[name=''go'']', 'Go' FROM customer
UNION ALL SELECT c_custkey, 'select[name=''segment'']', '' FROM customer
UNION ALL SELECT c_custkey, 'textarea[name=''note'']', 'nation ' || c_nationkey FROM customer
UNION ALL SELECT c_custkey, 'input[name=''empty'']', '' FROM customer"""
# an input without a type counts as a submit control, a checkbox does not
O["click_targets"] = """SELECT 'submit' AS action, 'form#acct' AS target, 4 * count(*) AS n FROM customer
UNION ALL SELECT NULL, NULL, count(*) FROM customer"""
O["table_text"] = """SELECT c_custkey, '| field | value |' || chr(10) || '|---|---|' || chr(10) || '| name | ' || c_name || ' |' || chr(10)
  || '| segment | ' || c_mktsegment || ' |' || chr(10) || '| nation |  |' AS content FROM customer"""

# -- secrets

_SECRET = 'token = "[0-9a-f]{40}"'
_HANDLE = "('${secret_' || left(sha256(s), 32) || '}')"
O["redact_docs"] = f"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '{_SECRET}')) AS part,
    unnest(list_append(regexp_extract_all(text, '{_SECRET}'), NULL)) AS s,
    unnest(range(len(string_split_regex(text, '{_SECRET}')))) AS n FROM documents)
SELECT doc_id, md5(string_agg(part || coalesce({_HANDLE}, ''), '' ORDER BY n)) AS digest FROM p GROUP BY 1"""
_MARKED = f"{_SECRET}|MARK-[A-Z]{{4}}"
O["redact_marked"] = f"""WITH m AS (SELECT doc_id, chr(64976) || text || chr(64976) || ' MARK-ABCD ' || chr(64976) || ' end' AS text FROM documents),
p AS (SELECT doc_id, unnest(string_split_regex(text, '{_MARKED}')) AS part,
    unnest(list_append(regexp_extract_all(text, '{_MARKED}'), NULL)) AS s,
    unnest(range(len(string_split_regex(text, '{_MARKED}')))) AS n FROM m)
SELECT doc_id, md5(string_agg(part || coalesce({_HANDLE}, ''), '' ORDER BY n)) AS digest, true AS same FROM p GROUP BY 1"""
O["field_checks"] = """SELECT c_custkey, n::INT AS ord, CASE n WHEN 0 THEN 'name' END AS name,
  CASE n WHEN 1 THEN 'FORM_NOT_FOUND' WHEN 2 THEN 'SELECTOR_NOT_FOUND' END AS code FROM customer, range(3) AS r(n)"""
O["vault"] = f"""SELECT DISTINCT {_HANDLE} AS handle, s AS secret FROM (
  SELECT unnest(regexp_extract_all(text, '{_SECRET}')) AS s FROM documents)"""
O["resolve_docs"] = "SELECT doc_id, md5(text) AS digest FROM documents"

# -- cookies

_EV = "e AS (SELECT user_id AS session, event_id AS seq, ts, event_type AS kind, (props->>'$.k')::INT AS k FROM events)"
_NAMES = "['session_id', 'theme', 'cart', 'auth_token', 'lang'][k % 5 + 1]"
_DOMAINS = "['a.example', 'b.a.example', 'c.example'][k % 3 + 1]"
_COOKIES = f"""{_EV},
sets AS (SELECT session, seq, ts, {_NAMES} AS name, {_DOMAINS} AS domain, 'v' || seq AS value, CASE WHEN k % 4 = 1 THEN '/shop' ELSE '/' END AS path,
  k % 6 = 0 AS secure, CASE WHEN k % 4 = 0 THEN ts + to_seconds(k * 3600) END AS expires FROM e WHERE kind IN ('purchase', 'error')),
dels AS (SELECT session, seq, ts, {_NAMES} AS name, {_DOMAINS} AS domain FROM e WHERE kind = 'signup'),
last_set AS (SELECT session, domain, path, name, max(seq) AS seq FROM sets GROUP BY 1, 2, 3, 4),
jar AS (SELECT s.* FROM sets s JOIN last_set USING (session, domain, path, name, seq)
  WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.session = s.session AND d.domain = s.domain AND d.name = s.name AND d.seq > s.seq))"""
O["cookie_jar"] = f"""WITH {_COOKIES} SELECT session, domain, path, name, value, secure, strftime(expires, '%Y-%m-%d %H:%M:%S') AS expires FROM jar"""
O["cookie_list"] = f"""WITH {_COOKIES} SELECT session, count(*) AS n FROM jar WHERE (expires IS NULL OR expires > TIMESTAMP '2024-01-15')
  AND ends_with(domain, '.a.example') GROUP BY 1"""
O["cookie_header"] = f"""WITH {_COOKIES},
req AS (SELECT session, seq, ts, k % 2 = 0 AS https, {_DOMAINS} AS host, CASE WHEN k % 4 < 2 THEN '/shop/cart' ELSE '/shopping' END AS target
  FROM e WHERE kind IN ('view', 'click')),
latest AS (SELECT r.session, r.seq, s.domain, s.path, s.name, max(s.seq) AS set_seq FROM req r JOIN sets s ON s.session = r.session AND s.seq < r.seq
  AND (r.host = s.domain OR ends_with(r.host, '.' || s.domain)) GROUP BY ALL),
alive AS (SELECT l.session, l.seq, s.domain, s.path, s.name, s.value, s.secure, s.expires FROM latest l JOIN sets s ON s.session = l.session AND s.seq = l.set_seq
  WHERE NOT EXISTS (SELECT 1 FROM dels d WHERE d.session = l.session AND d.domain = l.domain AND d.name = l.name AND d.seq > l.set_seq AND d.seq < l.seq)),
sent AS (SELECT r.session, r.seq, string_agg(a.name || '=' || a.value, '; ' ORDER BY -length(a.path), a.name, a.domain) AS cookie
  FROM req r JOIN alive a ON a.session = r.session AND a.seq = r.seq
  WHERE (NOT a.secure OR r.https) AND (a.expires IS NULL OR a.expires > r.ts) AND (a.path = '/' OR starts_with(r.target, '/shop/')) GROUP BY 1, 2)
SELECT session, seq, cookie FROM req LEFT JOIN sent USING (session, seq)"""
O["cookie_deletes"] = f"""WITH {_COOKIES},
latest AS (SELECT d.session, d.seq, d.ts, d.name, d.domain, s.path, max(s.seq) AS set_seq FROM dels d JOIN sets s ON s.session = d.session
  AND s.name = d.name AND s.domain = d.domain AND s.seq < d.seq
  AND NOT EXISTS (SELECT 1 FROM dels x WHERE x.session = d.session AND x.name = d.name AND x.domain = d.domain AND x.seq > s.seq AND x.seq < d.seq) GROUP BY ALL),
hits AS (SELECT DISTINCT l.session, l.seq FROM latest l JOIN sets s ON s.session = l.session AND s.seq = l.set_seq WHERE s.expires IS NULL OR s.expires > l.ts)
SELECT d.session, d.seq, d.name, d.domain, h.seq IS NOT NULL AS deleted FROM dels d LEFT JOIN hits h ON h.session = d.session AND h.seq = d.seq"""
O["cookie_export"] = f"WITH {_COOKIES} SELECT session, count(*) AS n, max(value) AS last_value FROM jar GROUP BY 1"
O["set_cookie_lines"] = """SELECT c_custkey, c_name AS value, 'shop.example' AS domain, '/x' AS path, c_nationkey::BIGINT AS max_age,
  false AS secure, true AS http_only FROM customer"""
O["redact_cookies"] = f"""WITH {_COOKIES}, m AS (SELECT *, value AS s, name IN ('session_id', 'auth_token') AS hot FROM jar)
SELECT session, domain, path, name, CASE WHEN hot THEN repeat('•', 6) ELSE value END AS value, CASE WHEN hot THEN {_HANDLE} END AS handle FROM m"""

# -- storage

_STORE = f"""{_EV}, s AS (SELECT session, seq, CASE WHEN kind IN ('purchase', 'view') THEN 'set' WHEN kind = 'click' THEN 'get'
  WHEN kind = 'signup' THEN 'delete' WHEN k < 20 THEN 'clear' ELSE 'get' END AS op, 'https://o' || k % 2 || '.example' AS origin,
  'key' || k % 7 AS key, 'v' || seq AS value FROM e),
writes AS (SELECT * FROM s WHERE op IN ('set', 'delete')), clears AS (SELECT * FROM s WHERE op = 'clear'),
past AS (
  SELECT a.session, a.seq, a.op, a.origin, a.key, w.op AS w_op, w.value AS w_value, w.seq AS w_seq, c.seq AS c_seq
  FROM (SELECT * FROM s WHERE op <> 'clear') a
  ASOF LEFT JOIN writes w ON w.session = a.session AND w.origin = a.origin AND w.key = a.key AND w.seq < a.seq
  ASOF LEFT JOIN clears c ON c.session = a.session AND c.origin = a.origin AND c.seq < a.seq),
seen AS (SELECT *, coalesce(w_op = 'set' AND w_seq > coalesce(c_seq, -1), false) AS live FROM past),
state AS (
  SELECT session, origin, key, arg_max(value, seq) AS value FROM writes w GROUP BY 1, 2, 3
  HAVING arg_max(op, seq) = 'set' AND max(seq) > coalesce((SELECT max(c.seq) FROM clears c WHERE c.session = w.session AND c.origin = w.origin), -1))"""
O["storage_state"] = f"WITH {_STORE} SELECT * FROM state"
O["storage_asof"] = f"WITH {_STORE} SELECT session, seq, origin, key, CASE WHEN live THEN w_value END AS value FROM seen WHERE op = 'get'"
O["storage_list"] = f"""WITH {_STORE} SELECT session, origin, '{{' || string_agg('"' || key || '":"' || value || '"', ',' ORDER BY key) || '}}' AS entries,
  count(*) AS count FROM state GROUP BY 1, 2"""
O["storage_deletes"] = f"WITH {_STORE} SELECT session, seq, origin, key, live AS deleted FROM seen WHERE op = 'delete'"
O["storage_clears"] = f"""WITH {_STORE},
held AS (SELECT c.session, c.seq, c.origin, k.key, arg_max(w.op, w.seq) AS op, max(w.seq) AS w_seq FROM clears c
  JOIN (SELECT DISTINCT session, origin, key FROM writes) k ON k.session = c.session AND k.origin = c.origin
  JOIN writes w ON w.session = k.session AND w.origin = k.origin AND w.key = k.key AND w.seq < c.seq GROUP BY 1, 2, 3, 4),
prev AS (SELECT session, seq, origin, lag(seq, 1, -1) OVER (PARTITION BY session, origin ORDER BY seq) AS p FROM clears)
SELECT p.session, p.seq, p.origin, count(h.key) FILTER (h.op = 'set' AND h.w_seq > p.p) AS cleared
FROM prev p LEFT JOIN held h ON h.session = p.session AND h.seq = p.seq AND h.origin = p.origin GROUP BY 1, 2, 3"""
O["redact_storage"] = f"""WITH {_STORE}, m AS (SELECT *, regexp_extract(value, '^v[0-9]*7', 0) AS hit FROM state),
h AS (SELECT session, origin, key, value, hit, '${{secret_' || left(sha256(hit), 32) || '}}' || substr(value, length(hit) + 1) AS masked,
  '${{secret_' || left(sha256(value), 32) || '}}' AS whole FROM m)
SELECT session, origin, key, CASE WHEN hit <> '' THEN masked ELSE value END AS value, CASE WHEN hit <> '' THEN whole END AS handle FROM h"""
O["snapshot_merge"] = f"""WITH {_STORE}, ses AS (SELECT DISTINCT session FROM state)
SELECT session, origin, key, value FROM state WHERE NOT (origin = 'https://o0.example' AND key = 'key1')
UNION ALL SELECT session, 'https://o0.example', 'key1', 'preset' FROM ses
UNION ALL SELECT session, 'https://new.example', 'k', 'v' FROM ses"""

# -- history

_HIST = f"""WITH RECURSIVE {_EV}, h AS (
  SELECT session, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn,
    CASE WHEN kind IN ('view', 'purchase') THEN 'visit' WHEN kind = 'click' THEN 'back' WHEN kind = 'signup' THEN 'forward' ELSE 'failed' END AS op,
    '{SITE}/' || kind || '/' || k AS url, 'Page ' || k AS title FROM e),
walk AS (
  SELECT session, 0::BIGINT AS rn, NULL::BIGINT AS seq, -1::BIGINT AS cursor, 0::BIGINT AS length, NULL::VARCHAR AS code,
         []::STRUCT(url VARCHAR, title VARCHAR)[] AS stack FROM (SELECT DISTINCT session FROM h)
  UNION ALL
  SELECT w.session, h.rn, h.seq,
    CASE WHEN op = 'visit' THEN cursor + 1 WHEN op = 'back' AND cursor > 0 THEN cursor - 1
         WHEN op = 'forward' AND cursor < length - 1 THEN cursor + 1 ELSE cursor END,
    CASE WHEN op = 'visit' THEN cursor + 2 ELSE length END,
    CASE WHEN op = 'back' AND cursor <= 0 THEN 'NO_HISTORY' WHEN op = 'forward' AND cursor >= length - 1 THEN 'NO_HISTORY' END,
    CASE WHEN op = 'visit' THEN list_append(stack[1:cursor + 1], {{'url': h.url, 'title': h.title}}) ELSE stack END
  FROM walk w JOIN h ON h.session = w.session AND h.rn = w.rn + 1),
ends AS (SELECT session, arg_max(cursor, rn) AS cursor, arg_max(length, rn) AS length, arg_max(stack, rn) AS stack FROM walk GROUP BY 1),
entries AS (SELECT session, unnest(range(length)) AS index, unnest(stack) AS s, cursor FROM ends)"""
O["history_fold"] = f"{_HIST} SELECT session, seq, cursor, length, code FROM walk WHERE rn > 0"
O["history_entries"] = f"{_HIST} SELECT session, index, s.url AS url, s.title AS title, index = cursor AS current FROM entries"
O["snapshot_round_trip"] = O["history_entries"]
O["history_search"] = f"""{_HIST}, hit AS (
  SELECT session, index, s.url AS url, contains(lower(s.url), 'purchase/1') OR contains(lower(s.title), 'purchase/1') AS m,
    count(*) OVER (PARTITION BY session) AS total FROM entries),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY index DESC) AS rn, count(*) OVER (PARTITION BY session) AS n FROM hit WHERE m)
SELECT session, index, url, least(n, 3) AS count, total FROM ranked WHERE rn <= 3"""
O["current_page"] = f"{_HIST} SELECT session, seq, stack[cursor + 1].url AS current_url FROM walk WHERE rn > 0"
O["storage_origin"] = f"""{_HIST} SELECT CASE WHEN cursor >= 0 THEN '{SITE}' END AS origin, CASE WHEN cursor < 0 THEN 'NO_PAGE' END AS storage_code,
  count(*) AS n FROM walk WHERE rn > 0 GROUP BY 1, 2"""
O["session_info"] = f"""{_HIST}, {_COOKIES[len(_EV) + 1:].strip()},
counts AS (SELECT session, count(*) AS n FROM jar WHERE expires IS NULL OR expires > TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT session, stack[cursor + 1].url AS current_url, stack[cursor + 1].title AS title, length AS history_length,
  greatest(cursor, 0) AS history_index, coalesce(n, 0) AS cookies_count FROM ends LEFT JOIN counts USING (session)"""

# -- command logs

_LOG = f"""{_EV.replace('user_id AS session, event_id AS seq', 'user_id AS log, event_id AS line_no, event_id * 7919 % 10007 AS seq')},
c AS (SELECT *, CASE kind WHEN 'view' THEN 'fetch' WHEN 'click' THEN CASE WHEN k = 7 THEN 'quit' WHEN k = 8 THEN 'jump' ELSE 'links' END
    WHEN 'signup' THEN 'storage_set' WHEN 'purchase' THEN 'fetch' END AS action,
  kind = 'error' OR (kind = 'click' AND k = 8) OR (kind = 'signup' AND k % 10 = 0) AS bad
  FROM e WHERE NOT (kind = 'error' AND k < 10)),
v AS (SELECT *, max(CASE WHEN NOT bad THEN seq END) OVER (PARTITION BY log ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_seq FROM c),
a AS (SELECT *, NOT bad AND (last_seq IS NULL OR seq > last_seq) AS accepted, CASE WHEN bad THEN coalesce(last_seq + 1, 0) ELSE seq END AS reply_seq FROM v),
stops AS (SELECT log, min(line_no) AS stop FROM a WHERE accepted AND action = 'quit' GROUP BY 1),
cut AS (SELECT a.*, CASE WHEN bad OR NOT accepted OR kind = 'purchase' THEN 'INVALID_COMMAND' END AS code,
  CASE WHEN bad THEN 'line ' || line_no || ': invalid command' WHEN NOT accepted THEN 'seq ' || seq || ' must be greater than previous seq ' || last_seq
       WHEN kind = 'purchase' THEN 'fetch requires url, index, or text' END AS error
  FROM a LEFT JOIN stops USING (log) WHERE stop IS NULL OR line_no <= stop)"""
O["parse_commands"] = f"WITH {_LOG} SELECT log, line_no, CASE WHEN NOT bad THEN action END AS action, bad FROM c"
O["seq_validate"] = f"WITH {_LOG} SELECT log, line_no, accepted, reply_seq FROM a"
O["quit_cut"] = f"WITH {_LOG} SELECT log, count(*) AS rows, max(line_no) AS last_line FROM cut GROUP BY 1"
O["action_counts"] = f"WITH {_LOG} SELECT action, count(*) AS n, count(code) AS errors FROM cut WHERE NOT bad GROUP BY 1"
O["result_envelopes"] = f"""WITH {_LOG} SELECT log, line_no, code IS NULL AS ok, reply_seq AS seq, code, CASE WHEN code IS NOT NULL THEN false END AS retryable,
  '{{"id":"' || CASE WHEN bad THEN '' ELSE 'e' || line_no END || '","ok":' || CASE WHEN code IS NULL THEN 'true' ELSE 'false' END || ',"seq":' || reply_seq
  || CASE WHEN code IS NOT NULL THEN ',"error":"' || error || '","code":"' || code || '","retryable":false' ELSE '' END
  || CASE WHEN code IS NULL AND action = 'quit' THEN ',"status":"quit"' ELSE '' END || '}}' AS json FROM cut"""
O["unanswered"] = f"WITH {_LOG} SELECT log, 'e' || line_no AS id, seq, line_no FROM cut WHERE NOT bad AND action = 'storage_set'"
O["match_results"] = f"WITH {_LOG} SELECT action, code IS NULL AS ok, code AS result_code, count(*) AS n FROM cut WHERE NOT bad AND action <> 'storage_set' GROUP BY 1, 2, 3"
O["dedup_retries"] = f"WITH {_LOG} SELECT log, count(*) AS n, max(line_no) AS last_line FROM cut WHERE NOT bad AND action <> 'storage_set' GROUP BY 1"
O["error_counts"] = f"WITH {_LOG} SELECT code, count(*) AS n FROM cut WHERE code IS NOT NULL GROUP BY 1"

# -- streams: the answers of the batch queries

O["stream_history"], O["stream_storage"] = O["history_fold"], O["storage_asof"]
O["stream_snapshots"] = f"""WITH {_STORE}, last AS (SELECT session, origin, key, max(seq) AS seq, arg_max({{'op': op, 'value': value}}, seq) AS w FROM writes GROUP BY 1, 2, 3)
SELECT session, origin, key, seq, w.op AS op, CASE WHEN w.op = 'set' THEN w.value END AS value FROM last"""
O["tailed_commands"] = f"WITH {_LOG} SELECT bad, action, count(*) AS n, count(*) AS places FROM c GROUP BY 1, 2"
O["command_files"] = f"WITH {_LOG} SELECT count(*) AS lines, count(*) FILTER (NOT (kind = 'error' AND k < 10)) AS filled, true AS dense FROM e"
