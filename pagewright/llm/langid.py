"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: A language's dictionary: at most this many pieces of at most this many characters.
PIECES, PIECE_CHARS = 64, 1024
#: More languages than this in the labels is an error, so what the driver gathers is bounded.
MOST_LANGUAGES = 500
#: Texts are compressed in parts of this many bytes, every part of them.
PART_BYTES = 8192
#: A text is rejected when the runner-up is within this share of the best size.
MARGIN = 0.004
#: Compression levels of the first and the second look.
LEVELS = (5, 19)
UNKNOWN = "und"

_CASED = re.compile(r"[^\w\s]|\d|_")


def train(labelled: DataFrame, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionaries by language from (text, lang), the language of most texts first.

    The sample is bounded: texts fall into `pieces` buckets by their hash, and of each language and bucket the
    text of smallest hash gives up to `piece_chars` characters. Null texts or languages teach nothing."""
    rows = labelled.filter("text IS NOT NULL AND lang IS NOT NULL AND text <> ''").select(
        "lang", "text", F.xxhash64("text").alias("h")).withColumn("bucket", F.pmod("h", F.lit(pieces)))
    chosen = rows.groupBy("lang", "bucket").agg(F.min("h").alias("h"), F.count("*").alias("n")).limit(MOST_LANGUAGES * pieces + 1).collect()
    if len({r.lang for r in chosen}) > MOST_LANGUAGES or len(chosen) > MOST_LANGUAGES * pieces:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not chosen:
        return {}
    wanted = labelled.sparkSession.createDataFrame([(r.lang, r.h) for r in chosen], "lang string, h long")
    sample = rows.join(F.broadcast(wanted), ["lang", "h"], "left_semi").select("lang", "h", F.substring("text", 1, piece_chars).alias("text"))
    found: dict[str, dict[int, str]] = {}
    for row in sample.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():
        found.setdefault(row.lang, {})[row.h] = row.text
    seen = {lang: sum(r.n for r in chosen if r.lang == lang) for lang in found}
    return {lang: _plain("\n".join(found[lang][h] for h in sorted(found[lang]))).encode()
            for lang in sorted(found, key=lambda lang: (-seen[lang], lang))}


def _plain(text: str) -> str:
    """Lower case without digits and signs, so that only words decide."""
    return " ".join(_CASED.sub(" ", text.lower()).split())


def _parts(raw: bytes) -> Iterator[bytes]:
    for at in range(0, len(raw), PART_BYTES):
        yield raw[at:at + PART_BYTES]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected.

    The whole text, in parts, is compressed once with each language's dictionary; the language of the smallest
    total is predicted; where the margin is narrow, a second look at the strongest level, which also finds short
    matches, decides, ties going to the dictionary that comes first. score is the share by which the runner-up is larger,
    scaled to 0..1 (0.25 or more is 1; 1 as well when only one language is known). Null, empty and letterless
    texts are `und` with score 0; they and narrow margins are rejected. A column of the same name is replaced."""
    names = ["lang_pred", "score", "rejected"]
    kept = [c for c in docs.columns if c.lower() not in names]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def kernel(batches):
        levels = [_packers(dictionaries, level) for level in LEVELS]
        for batch in batches:
            found = [_choose(t, levels, margin) for t in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, kept + names)

    return docs.select(*kept).mapInArrow(kernel, schema)


def _packers(dictionaries: dict[str, bytes], level: int) -> dict:
    found = {}
    for lang, raw in dictionaries.items():
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        found[lang] = zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_checksum=False)
    return found


def _choose(text: str | None, levels: list[dict], margin: float) -> tuple[str, float, bool]:
    if not levels[0] or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    raw = _plain(text).encode()
    for packers in levels:
        sizes = [0] * len(packers)
        for part in _parts(raw):
            for k, packer in enumerate(packers.values()):
                sizes[k] += len(packer.compress(part))
        best, other = min(sizes), min((s for k, s in enumerate(sizes) if k != sizes.index(min(sizes))), default=None)
        if other is None:
            return next(iter(packers)), 1.0, False
        lead = (other - best) / max(best, 1)
        if lead >= margin:
            break
    return list(packers)[sizes.index(best)], min(1.0, 4 * lead), lead < margin


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: CRC32 of its id as text leaves 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identified(docs: DataFrame) -> DataFrame:
    """Documents with predictions, learnt from their own labels that are not held out. A null id is not held out."""
    training = docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang")
    return identify(docs, train(training))
