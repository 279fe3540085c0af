"""Text functions: token estimates, whitespace, entities, tags, truncation and chunking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagewright.functions import as_col, let

NL = "\n"

# Control characters and bidi overrides that may not come out of a numeric entity.
DANGEROUS = (
    r"\x{0}-\x{8}\x{B}-\x{C}\x{E}-\x{1F}\x{7F}\x{80}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
)
# The named entities decoded in text.
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "nbsp": " ", "apos": "'"}


def estimate_tokens(s) -> Column:
    """UTF-8 bytes divided by four, rounded down."""
    return F.floor(F.octet_length(as_col(s)) / 4).cast("bigint")


def collapse_ws(s) -> Column:
    """Whitespace runs become one space; leading whitespace goes, trailing stays as one space."""
    return F.ltrim(F.regexp_replace(as_col(s), r"(?U)\s+", " "))


def strip_dangerous(s) -> Column:
    return F.regexp_replace(as_col(s), f"[{DANGEROUS}]", "")


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _decode_token(token: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def numeric(digits: Column, body: Column) -> Column:
        value = F.when(body.startswith("#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
        return let(F.when(F.length(digits) <= 10, value), lambda n: F.when(
            (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), strip_dangerous(_code_point(n))))

    def decode(body: Column) -> Column:
        digits = F.regexp_extract(body, r"^#x?\+?0*([0-9a-fA-F]+)$", 1)
        return F.coalesce(named[body], let(digits, lambda d: F.when(d != "", numeric(d, body))), token)

    return F.when(token.startswith("&") & (F.length(token) > 1),
                  let(F.regexp_extract(token, "^&(.+);$", 1), decode)).otherwise(token)


def decode_entities(s) -> Column:
    """One decoding pass over the text: the result of a replacement is never decoded again."""
    s = as_col(s)
    pattern = r"&(?:amp|lt|gt|quot|nbsp|apos|#x\+?[0-9a-fA-F]+|#\+?[0-9]+);|&|[^&]+"
    tokens = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    return F.when(~s.contains("&"), s).otherwise(F.array_join(F.transform(tokens, _decode_token), ""))


def normalize_ws(s) -> Column:
    """Right-trim every line, keep at most one blank line in a row and none at either end."""
    trimmed = F.regexp_replace(as_col(s), r"(?U)(?<![^\S\n])[^\S\n]++(?=\n|\z)", "")
    single = F.regexp_replace(trimmed, r"\n{3,}", "\n\n")
    return F.regexp_replace(single, r"\A\n+|\n+\z", "")


def strip_tags(s) -> Column:
    """Each `<...>` becomes a space; an unclosed `<` drops the rest of the text."""
    return F.regexp_replace(F.regexp_replace(as_col(s), r"<[^>]*>", " "), r"<[^>]*\z", "")


def clean_description(s) -> Column:
    return F.regexp_replace(collapse_ws(let(strip_tags(s), decode_entities)), r"(?U)\s+\z", "")


def b64_encode(s) -> Column:
    """One line of base64, whatever line length the session is set to."""
    return F.regexp_replace(F.base64(as_col(s).cast("binary")), r"\s", "")


def b64_decode(s) -> Column:
    """Decoded text; null for input that is not base64."""
    return F.try_to_binary(as_col(s), F.lit("base64")).cast("string")


def _slice(b: Column, start: Column, size: Column | None = None) -> Column:
    size = F.length(b) if size is None else size
    return F.substring(b, (start + 1).cast("int"), size.cast("int"))


def _char_floor(b: Column, pos: Column) -> Column:
    """Largest character boundary at or before byte `pos` of UTF-8 bytes `b`."""
    pos = F.least(pos, F.length(b).cast("bigint"))

    def boundary(p: Column) -> Column:
        lead = F.hex(_slice(b, p, F.lit(1)))
        return (p >= F.length(b)) | (p <= 0) | ~lead.between("80", "BF")

    return let(pos, lambda p: F.when(boundary(p), p).when(boundary(p - 1), p - 1)
               .when(boundary(p - 2), p - 2).otherwise(p - 3))


def _page(text: Column, tokens: Column, cut: Column, nxt: Column) -> Column:
    return F.struct(text.alias("markdown"), tokens.cast("bigint").alias("tokens_est"),
                    cut.alias("truncated"), nxt.cast("bigint").alias("next_offset"))


def truncate_tokens(md, offset=0, max_tokens=None) -> Column:
    """One page of a document, as struct(markdown, tokens_est, truncated, next_offset).

    The start moves past the next newline after `offset`, the end back to the last newline that
    fits; both count in tokens of four UTF-8 bytes and never split a character.
    """
    md = as_col(md)
    offset = (F.lit(offset) if isinstance(offset, int) else offset).cast("bigint")
    limit = (F.lit(max_tokens) if not isinstance(max_tokens, Column) else max_tokens).cast("bigint")
    none = F.lit(None).cast("bigint")

    def start_of(b: Column) -> Column:
        def after_newline(pos: Column) -> Column:
            rest = _slice(b, pos).cast("string")
            newline = F.instr(rest, NL)
            skipped = F.octet_length(F.left(rest, newline))
            return F.when(pos >= F.length(b), F.length(b)).when(pos == 0, F.lit(0)).when(
                newline == 0, F.length(b)).otherwise(pos + skipped).cast("bigint")

        return let(_char_floor(b, offset * 4), after_newline)

    def cut_at(rest: Column) -> Column:
        def finish(size: Column) -> Column:
            def at_newline(head: Column) -> Column:
                back = F.instr(F.reverse(head), NL)
                kept = F.when(back == 0, head).otherwise(F.left(head, F.length(head) - back + 1))
                return let(kept, lambda k: _page(k, F.floor(F.octet_length(k) / 4), F.lit(True),
                                                 offset + F.floor(F.octet_length(k) / 4)))

            whole = _page(rest.cast("string"), F.floor(F.length(rest) / 4), F.lit(False), none)
            return F.when(size.isNull() | (size >= F.length(rest)), whole).otherwise(
                let(_slice(rest, F.lit(0), size).cast("string"), at_newline))

        return let(F.when(limit.isNotNull(), _char_floor(rest, limit * 4)), finish)

    return let(md.cast("binary"), lambda b: let(_slice(b, start_of(b)), cut_at))


def _pieces(line: Column, max_bytes: int) -> Column:
    """A line as pieces that each fit: cut every `max_bytes / 4` characters only if too long."""
    step = max(1, max_bytes // 4)
    cuts = F.sequence(F.lit(0), F.floor((F.length(line) - 1) / step).cast("int"))
    return F.when(F.octet_length(line) <= max_bytes, F.array(line)).otherwise(
        F.transform(cuts, lambda k: F.substring(line, k * step + 1, F.lit(step))))


def chunk_tokens(md, max_tokens: int) -> Column:
    """All pages of a document as array<string>; joining them gives the document back.

    Lines (with their newline) are packed greedily. The accumulator holds finished chunks by
    reference and only the open chunk is rebuilt per line, so the fold stays linear in practice.
    """
    max_bytes = max_tokens * 4
    lines = F.regexp_extract_all(as_col(md), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    parts = F.flatten(F.transform(lines, lambda line: _pieces(line, max_bytes)))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, part: Column) -> Column:
        fits = (F.octet_length(acc["open"]) + F.octet_length(part) <= max_bytes) | (acc["open"] == "")
        return F.when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], part).alias("open"))) \
            .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), part.alias("open")))

    return F.aggregate(parts, empty, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
        F.array_append(acc["done"], acc["open"])))
