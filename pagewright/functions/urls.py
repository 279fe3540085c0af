"""URL functions as column expressions: parsing, joining, shortening, origins, domain rules.

`parse_url` is not used: it returns NULL for many addresses found in real pages, such as ones
with a space. The rules followed here are those of the public URL standard for `http`-like
schemes; hosts are lower-cased but not converted to punycode.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewright.functions import as_col, let

# Default ports, and the schemes whose addresses have a host and a path.
DEFAULT_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
# Characters kept as they are in each part (printable ASCII minus the encode set).
PATH_KEEP = r"!$%&'()*+,\-./0-9:;=@A-Z\[\\\]_a-z|~"
QUERY_KEEP = r"!$%&()*+,\-./0-9:;=?@A-Z\[\\\]^_`a-z{|}~"
FRAGMENT_KEEP = r"!#$%&'()*+,\-./0-9:;=?@A-Z\[\\\]^_a-z{|}~"

# Addresses that are in standard spelling already, as almost all in real pages are. They take a
# short way around the full rules below: one regex test instead of taking everything apart.
_CLEAN_SITE = r"https?://[a-z0-9](?:[a-z0-9.\-]*[a-z0-9])?(?=[/?#]|$)"
_CLEAN_PATH = r"(?:[A-Za-z0-9_\-~!$&'()*+,;=:@%.]|/(?!\.|%2[eE]))*+"
_CLEAN_TAIL = r"(?:\?[A-Za-z0-9_\-~!$&()*+,;=:@%./?]*+)?(?:#[A-Za-z0-9_\-~!$&()*+,;=:@%./?]*+)?$"
_CLEAN_LOCAL = r"^(?=/)(?!//|/\.|/%2[eE])" + _CLEAN_PATH + _CLEAN_TAIL
_CLEAN_URL = "^" + _CLEAN_SITE + r"(?=/)(?!/\.|/%2[eE])" + _CLEAN_PATH + _CLEAN_TAIL

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _is_web(scheme: Column) -> Column:
    return scheme.isin(list(DEFAULT_PORTS))


def _percent_encode(s: Column, keep: str) -> Column:
    """Percent-encode the UTF-8 bytes of every run of characters outside `keep`."""
    runs = F.regexp_extract_all(s, F.lit(f"[{keep}]+|[^{keep}]+"), F.lit(0))

    def encode(run: Column) -> Column:
        hexed = F.regexp_replace(F.hex(run.cast("binary")), "(..)", "%$1")
        return F.when(run.rlike(f"^[{keep}]"), run).otherwise(hexed)

    return F.when(s.rlike(f"^[{keep}]*$"), s).otherwise(F.array_join(F.transform(runs, encode), ""))


def _authority(scheme: Column, raw: Column) -> Column:
    """Lower-case host, default port dropped."""
    host_port = F.regexp_extract(raw, r"^(?:[^@]*@)?(.*)$", 1)
    user = F.regexp_extract(raw, r"^([^@]*@)?", 1)
    host = F.lower(F.regexp_extract(host_port, r"^(.*?)(?::(\d*))?$", 1))
    port = F.regexp_extract(host_port, r"^(.*?)(?::0*(\d*))?$", 2)
    default = F.create_map(*[F.lit(x) for pair in DEFAULT_PORTS.items() for x in pair])[scheme]
    return F.concat(user, host, F.when((port == "") | (port == default), "").otherwise(F.concat(F.lit(":"), port)))


def _dot_segments(path: Column) -> Column:
    """Fold `.` and `..` away; a path that ends in one of them ends in a slash."""
    dot, dots = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    segments = F.split(path, "/")

    def fold(acc: Column, seg: Column) -> Column:
        parent = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(seg.rlike(dots), parent).when(seg.rlike(dot), acc).otherwise(F.array_append(acc, seg))

    folded = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), fold)
    tail = F.when(F.element_at(segments, -1).rlike(r"(?i)^(\.|%2e){1,2}$"), "/").otherwise("")
    joined = F.concat(F.array_join(folded, "/"), tail)
    return F.when(~path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), path).otherwise(
        F.when(joined == "", "/").otherwise(joined))


def _clean_path(path: Column) -> Column:
    encoded = _percent_encode(F.translate(path, "\\", "/"), PATH_KEEP)
    return let(F.when(encoded.startswith("/"), encoded).otherwise(F.concat(F.lit("/"), encoded)), _dot_segments)


def _split(url: Column) -> Column:
    """The five raw parts of an absolute address; `query` and `fragment` keep their `?` and `#`."""
    whole = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    return _parts(F.lower(F.regexp_extract(url, whole, 1)), *[F.regexp_extract(url, whole, n) for n in range(2, 6)])


def _parts(scheme: Column, authority: Column, path: Column, query: Column, fragment: Column) -> Column:
    return F.struct(scheme.alias("scheme"), authority.alias("authority"), path.alias("path"),
                    query.alias("query"), fragment.alias("fragment"))


def _normalized(raw: Column) -> Column:
    """Clean parts of a raw split; null unless it is a web address with a host."""
    return F.when(_is_web(raw["scheme"]) & (raw["authority"] != ""), _parts(
        raw["scheme"], _authority(raw["scheme"], raw["authority"]), _clean_path(raw["path"]),
        _percent_encode(raw["query"], QUERY_KEEP), _percent_encode(raw["fragment"], FRAGMENT_KEEP)))


def _trimmed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def _text(parts: Column) -> Column:
    return F.concat(parts["scheme"], F.lit("://"), parts["authority"], _local(parts))


def _local(parts: Column) -> Column:
    return F.concat(parts["path"], parts["query"], parts["fragment"])


def _site(authority: Column) -> Column:
    return F.regexp_replace(authority, "^[^@]*@", "")


def _joined(base: Column, href: Column) -> Column:
    """Raw parts of `href` on the page with raw parts `base`. Cleaning happens once, afterwards."""
    scheme = F.lower(F.regexp_extract(href, _SCHEME, 1))
    # a web scheme without slashes that equals the base's own starts a relative address
    same = (scheme == base["scheme"]) & ~href.rlike(_SCHEME + r"[/\\]")
    absolute = F.when((scheme != "") & ~same, href).when(
        href.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), href))

    def relative(rest: Column) -> Column:
        shape = r"(?s)^([^?#]*)(\?[^#]*)?(#.*)?$"
        path, query = F.regexp_extract(rest, shape, 1), F.regexp_extract(rest, shape, 2)
        folder = F.concat(F.regexp_extract(base["path"], r"^(.*/)?", 1), path)
        return _parts(
            base["scheme"], base["authority"],
            F.when(path == "", base["path"]).when(path.rlike(r"^[/\\]"), path).otherwise(folder),
            F.when((path == "") & (query == ""), base["query"]).otherwise(query),
            F.regexp_extract(rest, shape, 3))

    rest = F.when(same, F.regexp_replace(href, _SCHEME, "")).otherwise(href)
    return let(absolute, lambda url: F.when(url.isNotNull(), _split(url)).otherwise(let(rest, relative)))


def _resolved(base: Column, href: Column, finish) -> Column:
    """`finish(raw base, clean parts, opaque text)`: opaque stands for `mailto:` and the like."""
    def go(h: Column) -> Column:
        def with_base(b: Column) -> Column:
            usable = _is_web(b["scheme"]) & (b["authority"] != "")
            scheme = F.lower(F.regexp_extract(h, _SCHEME, 1))
            opaque = F.when(usable & (scheme != "") & ~_is_web(scheme),
                            F.concat(scheme, F.substring(h, F.length(scheme) + 1, F.length(h))))
            clean = F.when(usable, let(_joined(b, h), _normalized))
            return let(clean, lambda parts: finish(b, parts, opaque))

        return let(_split(_trimmed(base)), with_base)

    return let(_trimmed(href), go)


def _clean_site(url: Column) -> Column:
    """scheme://host of an address that starts cleanly, else empty."""
    return F.regexp_extract(url, f"^{_CLEAN_SITE}", 0)


def resolve_url(base, href) -> Column:
    """Absolute address of `href` on the page `base`; null if either cannot be understood."""
    base, href = as_col(base), as_col(href)
    full = _resolved(base, href, lambda _, parts, opaque: F.coalesce(_text(parts), opaque))
    is_clean = base.rlike(f"^{_CLEAN_SITE}")
    return F.when(is_clean & href.rlike(_CLEAN_LOCAL), F.concat(_clean_site(base), href)).when(
        is_clean & href.rlike(_CLEAN_URL), href).otherwise(full)


def display_href(base, href) -> Column:
    """Resolved address, shortened to path, query and fragment on the page's own site."""
    base, href = as_col(base), as_col(href)

    def shown(b: Column, parts: Column, opaque: Column) -> Column:
        same = (parts["scheme"] == b["scheme"]) & (
            _site(parts["authority"]) == _site(_authority(b["scheme"], b["authority"])))
        return F.coalesce(F.when(same, _local(parts)).otherwise(_text(parts)), opaque, href)

    own = F.substring(href, F.length(_clean_site(base)) + 1, F.length(href))
    short = F.when(_clean_site(href) == _clean_site(base), own).otherwise(href)
    is_clean = base.rlike(f"^{_CLEAN_SITE}") & (href.rlike(_CLEAN_LOCAL) | href.rlike(_CLEAN_URL))
    return F.when(is_clean, F.when(href.startswith("/"), href).otherwise(short)).otherwise(
        _resolved(base, href, shown))


def absolute_href(base, href) -> Column:
    """`http` and `https` addresses unchanged, others joined; what cannot be joined stays raw."""
    href = as_col(href)
    return F.when(href.startswith("http://") | href.startswith("https://"), href).otherwise(
        F.coalesce(resolve_url(base, href), href))


def origin(url) -> Column:
    """scheme://host[:port] without a default port; null for addresses that have no origin."""
    url = as_col(url)
    full = let(_split(_trimmed(url)), lambda raw: F.when(
        _is_web(raw["scheme"]) & (raw["authority"] != ""),
        F.concat(raw["scheme"], F.lit("://"), _site(_authority(raw["scheme"], raw["authority"])))))
    return F.when(url.rlike(f"^{_CLEAN_SITE}"), _clean_site(url)).otherwise(full)


def normalize_url(url) -> Column:
    """A web address in its standard spelling; null for anything else."""
    url = as_col(url)
    return F.when(url.rlike(_CLEAN_URL), url).otherwise(let(let(_split(_trimmed(url)), _normalized), _text))


def host(url) -> Column:
    return F.regexp_extract(origin(url), r"^[^:]+://([^:/]+|\[[^\]]*\])(?::\d+)?$", 1)


def domain_matches(pattern, name) -> Column:
    """Exact, or `*.x` with at least one label in front of `.x`; letter case is ignored."""
    pattern, name = F.lower(as_col(pattern)), F.lower(as_col(name))
    suffix = F.substring(pattern, F.lit(2), F.length(pattern))
    return F.when(pattern.startswith("*."),
                  name.endswith(suffix) & (F.length(name) > F.length(suffix))).otherwise(name == pattern)


def domain_keys(name) -> Column:
    """Every rule key that matches a host: itself and `*.` before each shorter suffix.

    Turns a domain-rule match into an equi-join.
    """
    def keys(labels: Column) -> Column:
        wild = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda k: F.concat(
            F.lit("*."), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
        return F.array_prepend(F.when(F.size(labels) > 1, wild).otherwise(F.array().cast("array<string>")),
                               F.array_join(labels, "."))

    return let(F.split(F.lower(as_col(name)), r"\."), keys)


def search_url(template, query) -> Column:
    """The form-encoded query in place of the first `{}` of the template."""
    template = as_col(template)
    at = F.instr(template, "{}")
    spliced = F.concat(F.left(template, at - 1), F.url_encode(as_col(query)),
                       F.substring(template, at + 2, F.length(template)))
    return F.when(at == 0, template).otherwise(spliced)


def form_encode(s) -> Column:
    return F.url_encode(as_col(s))


def meta_refresh_target(content) -> Column:
    """Address after `url=` in a refresh tag, without quotes; null if empty or missing."""
    raw = F.regexp_extract(as_col(content), r"(?is)url=(.*)", 1)
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?U)\A\s+|\s+\z", ""), r"\A['\"]+|['\"]+\z", "")
    return F.nullif(bare, F.lit(""))


def parse_path(url) -> Column:
    """The path of a web address, without query and fragment."""
    return let(let(_split(_trimmed(as_col(url))), _normalized), lambda parts: parts["path"])
