"""Secret detection with reversible redaction: text with handles plus a vault table."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.functions import as_col

# Built-in secret patterns, in the order they are applied.
BUILTIN_PATTERNS = [
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("github_pat", r"gh[ps]_[A-Za-z0-9_]{36,}"),
    ("github_fine", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("openai", r"sk-[A-Za-z0-9]{20,}"),
    ("slack_bot", r"xoxb-[0-9]{10,}-[A-Za-z0-9]{20,}"),
    ("slack_user", r"xoxp-[0-9]{10,}-[A-Za-z0-9]{20,}"),
    ("slack_app", r"xapp-[0-9]-[A-Za-z0-9]{20,}"),
]
# Name parts that make a cookie sensitive, and its mask.
SENSITIVE_NAMES = ["session", "sid", "token", "jwt", "auth", "csrf"]
MASK = "\u2022" * 6
HANDLE = r"\$\{secret_[0-9a-f]{32}\}"


def jvm_pattern(pattern: str) -> str:
    """Named groups as the engine's regular expressions write them; their names may hold letters and digits only."""
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", named)


def _refused(pattern: str) -> str | None:
    """Why the engine cannot run a pattern; asked once, on the driver, without a job."""
    spark = SparkSession.active()
    try:
        empty = spark.sql("SELECT '' RLIKE :p AS empty", {"p": pattern}).first().empty
    except Exception as error:  # the engine's own message says what is wrong
        return str(error).splitlines()[0]
    return "it matches the empty text" if empty else None


def secret_patterns(extra: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Built-in patterns followed by the user's; a user pattern replaces one of the same name.

    A pattern that the engine cannot run, or that matches the empty text, is reported and left out.
    """
    patterns = list(BUILTIN_PATTERNS)
    for name, given in extra:
        pattern = jvm_pattern(given)
        if error := _refused(pattern):
            warnings.warn(f"invalid redaction pattern {name!r}: {error}", stacklevel=2)
            continue
        patterns = [p for p in patterns if p[0] != name] + [(name, pattern)]
    return patterns


def handle_of(secret: Column) -> Column:
    """A handle made from the content: equal values share it, and no counter is needed."""
    return F.concat(F.lit("${secret_"), F.left(F.sha2(secret, 256), F.lit(32)), F.lit("}"))


def _cut(text: Column, pattern: str) -> Column:
    """array<struct(secret, s)>: the matches of a pattern and what stands between them, in order.

    Both come from the text as it is, no mark is put into it. Where a pattern matched something of no length the
    two would not fit together: the job ends then rather than let a secret through."""
    def piece(s: Column, secret: bool) -> Column:
        return F.struct(F.lit(secret).alias("secret"), s.alias("s"))

    def put_together(cut: Column) -> Column:
        found, between = cut["found"], cut["between"]
        pieces = F.flatten(F.transform(between, lambda s, i: F.when(i < F.size(found), F.array(piece(s, False), piece(F.get(found, i), True)))
                                       .otherwise(F.array(piece(s, False)))))
        return F.when(F.size(between) == F.size(found) + 1, pieces).otherwise(
            F.raise_error(F.lit("a redaction pattern matches something of no length")).cast("array<struct<secret:boolean,s:string>>"))

    # A list of one: what a lambda is given is worked out once, a column that it names once for each piece.
    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")))
    return F.flatten(F.transform(once, put_together))


def _beginning(pattern: str) -> str:
    """Plain characters that every match begins with, as far as that is plain to see."""
    plain = re.match(r'[A-Za-z0-9_ ="-]*', pattern)[0]
    if "|" in pattern:
        return ""
    return plain[:-1] if pattern[len(plain):len(plain) + 1] in ("*", "+", "?", "{") else plain


def _has(text: Column, pattern: str) -> Column:
    """Does the pattern match somewhere? A search for its beginning is much cheaper and mostly enough."""
    beginning = _beginning(pattern)
    return text.contains(beginning) & text.rlike(pattern) if beginning else text.rlike(pattern)


def _segments(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The text cut at its matches. Later patterns only see what is still plain, so they cannot hit inside an earlier match."""
    def apply(segments: Column, pattern: str) -> Column:
        return F.flatten(F.transform(segments, lambda seg: F.when(
            seg["secret"] | ~_has(seg["s"], pattern), F.array(seg)).otherwise(_cut(seg["s"], pattern))))

    segments = F.array(F.struct(F.lit(False).alias("secret"), text.alias("s")))
    for _, pattern in patterns:
        segments = apply(segments, pattern)
    return segments


def _has_any(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Each pattern by itself: joined ones would number each other's groups anew."""
    found = F.lit(False)
    for _, pattern in patterns:
        found = found | _has(text, pattern)
    return found


def redact(text, patterns=None) -> Column:
    """The text with every secret replaced by its handle. Clean texts cost one regex test."""
    text, patterns = as_col(text), secret_patterns() if patterns is None else patterns
    replaced = F.transform(_segments(text, patterns), lambda seg: F.when(
        seg["secret"], handle_of(seg["s"])).otherwise(seg["s"]))
    return F.when(_has_any(text, patterns), F.array_join(replaced, "")).otherwise(text)


def secrets_in(text, patterns=None) -> Column:
    """array<string> of the secrets found in a text."""
    text, patterns = as_col(text), secret_patterns() if patterns is None else patterns
    found = F.transform(F.filter(_segments(text, patterns), lambda seg: seg["secret"]), lambda seg: seg["s"])
    return F.when(_has_any(text, patterns), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def redact_text(df: DataFrame, column: str, patterns=None) -> DataFrame:
    return df.withColumn(column, redact(column, patterns))


def build_vault(df: DataFrame, column: str, patterns=None) -> DataFrame:
    """(handle, secret), one row per distinct secret (partially aggregated before the shuffle)."""
    return (df.select(F.explode(secrets_in(column, patterns)).alias("secret")).distinct()
            .select(handle_of(F.col("secret")).alias("handle"), "secret"))


def whole_values(df: DataFrame, column: str) -> DataFrame:
    """Vault rows for values that are kept under a handle as a whole."""
    return df.select(F.col(column).alias("secret")).filter(F.col("secret").isNotNull()).distinct().select(
        handle_of(F.col("secret")).alias("handle"), "secret")


def resolve_handles(df: DataFrame, column: str, vault: DataFrame, key: str) -> DataFrame:
    """Put secrets back for handles; unknown handles stay.

    Only texts with handles take part, as one narrow (key, handle) row per different handle. A
    handle used by many texts makes its key hot on the many side only, which adaptive skew
    handling splits; each text then gets its few secrets back as a map.
    """
    used = df.select(
        key, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(f"({HANDLE})"), F.lit(1)))).alias("handle"))
    known = used.join(vault.select("handle", "secret"), "handle").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("handle", "secret"))).alias("_known"))
    filled = F.transform(_cut(F.col(column), HANDLE), lambda part: F.coalesce(
        F.when(part["secret"], F.col("_known")[part["s"]]), part["s"]))
    return df.join(known, key, "left").withColumn(column, F.when(
        F.col("_known").isNotNull(), F.array_join(filled, "")).otherwise(F.col(column))).select(*df.columns)


def is_sensitive_name(name) -> Column:
    lowered = F.lower(as_col(name))
    return F.exists(F.array(*[F.lit(s) for s in SENSITIVE_NAMES]), lambda s: lowered.contains(s))


def redact_cookies(cookies: DataFrame, patterns=None) -> DataFrame:
    """Sensitive names: masked value and a handle; other values are searched for secrets."""
    sensitive = is_sensitive_name("name")
    return cookies.withColumn("handle", F.when(sensitive, handle_of(F.col("value")))).withColumn(
        "value", F.when(sensitive, MASK).otherwise(redact("value", patterns)))


def cookie_vault(cookies: DataFrame, patterns=None) -> DataFrame:
    sensitive = is_sensitive_name("name")
    return whole_values(cookies.filter(sensitive), "value").unionByName(
        build_vault(cookies.filter(~sensitive), "value", patterns)).distinct()


def redact_storage(storage: DataFrame, patterns=None, single: bool = False) -> DataFrame:
    """Values searched for secrets; a single read also gets a handle for its whole value."""
    redacted = storage.withColumn("_r", redact("value", patterns))
    if single:
        redacted = redacted.withColumn("handle", F.when(F.col("_r") != F.col("value"), handle_of(F.col("value"))))
    return redacted.withColumn("value", F.col("_r")).drop("_r")


def storage_vault(storage: DataFrame, patterns=None, single: bool = False) -> DataFrame:
    found = build_vault(storage, "value", patterns)
    if not single:
        return found
    changed = storage.filter(redact("value", patterns) != F.col("value"))
    return found.unionByName(whole_values(changed, "value")).distinct()


def redact_pages(results: DataFrame, enabled: bool = True, patterns=None) -> DataFrame:
    """Only the Markdown of a page result is redacted, not its links or title."""
    return redact_text(results, "markdown", patterns) if enabled else results
