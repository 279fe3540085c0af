"""Byte-level BPE, importance resampling and vector codes against brute force, and on odd rows."""
import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagewright.llm import bytebpe, resample, vectorcodes
from pagewright.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
RANKS = vocabulary("byte_bpe_50k.tiktoken")
TEXTS = ["", "a", " ", "  lead", "it's 's 'S don't   ", "x" * 3001, " " * 700, "the quick\n\n\nbrown\t fox" * 50, "é é́ ΣΑΣ ² ½ Ⅷ 😀", "a\x1cb\x85c d e",
         "<|endoftext|>", "1234567890 " * 30, "word " * 4000]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_gives_the_leftmost_least_pair():
    rng = random.Random(3)
    ranks = {bytes([b]): b for b in range(256)} | {a + b: n for n, (a, b) in enumerate(
        [(b"a", b"b"), (b"b", b"a"), (b"ab", b"ab"), (b"a", b"a"), (b"aa", b"b"), (b"ab", b"a")], 256)}
    for _ in range(300):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
        parts = [piece[k:k + 1] for k in range(len(piece))]
        while not (len(parts) == 1 or piece in ranks):
            pairs = [(ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, k = min(pairs)
            if rank == 1 << 30:
                break
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert bytebpe.merged(piece, ranks) == ([ranks[piece]] if piece in ranks else [ranks[p] for p in parts])


def test_encoder_agrees_with_the_library(spark, library):
    encoder = bytebpe.ByteEncoder(RANKS, public_tokenizers.PATTERN, remembered=300)
    for text in TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == library.encode_ordinary(text or "")
    assert encoder.ids(None) == b"" and len(encoder) <= 300


def test_encode_and_decode(spark, library):
    rows = [(n, t, "x") for n, t in enumerate(TEXTS)] + [(None, "null id", "x"), (0, "again", None), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bytebpe.decode(bytebpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    expected = sorted([(n, len(library.encode_ordinary(t or "")), (t or "").encode()) for n, t, _ in rows], key=key)
    assert sorted([(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in found.collect()], key=key) == expected
    assert all(len(r.ids) == 4 * r.n_tokens for r in found.collect())
    assert bytebpe.decode(bytebpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOW = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    words = WORD.findall((text or "").translate(ASCII_LOW))
    runs = [" ".join(words[k:k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def plain_resampled(docs, target):
    s, t = Counter(), Counter()
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            counts.update(plain_features(text)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    for doc_id, text in docs:
        words, found = plain_features(text)
        weight, score = sum(gain[b] for b in found), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, words])
    fit = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(fit[:5 * len(fit) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling(spark):
    read = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]
    docs = read("documents", "doc_id") + [(None, "word " * 30), (-1, None), (-2, ""), (-3, "Ünï Ünï a-b 7"), (-4, "one two " * 5000), (5, "twice " * 25)]
    target = read("benchmark", "item_id") + [(None, None)]
    schema = "doc_id long, text string, weight string"
    found = resample.resampled(spark.createDataFrame([(*d, "w") for d in docs], schema), spark.createDataFrame(target, "item_id string, text string") if isinstance(
        target[0][0], str) else spark.createDataFrame(target, "item_id long, text string"))
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_resampled(docs, target)


def test_resampling_of_equal_scores_and_few_rows(spark):
    rows = [(k % 50, 25, 75, 3) for k in range(100)] + [(None, 25, 1, 9), (70, 19, 1, 10 ** 6)]
    weighted = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long")
    whole = sorted((r.rank, r.doc_id, r.score) for r in resample.draw(weighted, percent=40).collect() if r.rank)
    split = sorted((r.rank, r.doc_id, r.score) for r in resample.draw(weighted, percent=40, rank_rows=7).collect() if r.rank)
    assert whole == split and [r[0] for r in whole] == list(range(1, 41))
    assert [(-r[2], r[1]) for r in whole] == sorted((-r[2], r[1]) for r in whole) and 70 not in {r[1] for r in whole}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(empty, empty).count() == 0
    assert [r.rank for r in resample.draw(weighted.limit(3)).collect()] == [None] * 3


def test_planes_sum_like_plain_gains():
    rng = np.random.default_rng(5)
    for high in (1, 700, 20000):
        values = rng.integers(-high, high + 1, resample.BUCKETS)
        planes, worth = resample.gain_planes(values)
        for size in (0, 1, 3000, 100000):
            buckets = rng.integers(0, 1 + rng.integers(resample.BUCKETS), size)
            assert resample.sliced_weight(buckets, planes, worth) == int(values[buckets].sum())


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(r[2], p) for r in kept[:entries]] for p in range(parts)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(cut(r[2], p), books[p])[1], []).append(cut(r[2], p))
            for k, found in groups.items():
                books[p][k] = [sum(c) // len(found) for c in zip(*found)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [(i, label, [near(cut(v, p), books[p]) for p in range(parts)]) for i, label, v in kept]
    by_label = Counter()
    for _, label, found in coded:
        by_label[label] += sum(d for d, _ in found)
    return sorted(((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), by_label[label], digest) for i, label, found in coded), key=repr)


SHAPE = "vec_id long, label int, embedding array<double>, code string, error int"


@pytest.mark.parametrize("block", [4096, 7])
def test_vector_codes(spark, monkeypatch, block):
    monkeypatch.setattr(vectorcodes, "BLOCK", block)
    rng = np.random.default_rng(block)
    good = [(int(n), int(n % 3) if n % 5 else None, (rng.normal(size=32) * (1 if n % 2 else 900)).tolist()) for n in range(150)]
    good += [(good[3][0], 9, good[3][2]), (None, 1, [0.0] * 32), (500, 1, [-0.001] * 32), (501, 1, [2.0 ** 19] * 32)]
    bad = [(-1, 1, None), (-2, 1, [None] + [0.0] * 31), (-3, 1, [float("nan")] * 32), (-4, 1, [float("inf")] * 32), (-5, 1, []), (-6, 1, [1.0] * 31), (900, 1, [1.0] * 16),
           (901, 1, [1e300] * 32)]
    found = vectorcodes.compressed(spark.createDataFrame([(*r, "c", 1) for r in good + bad], SHAPE))
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_codes(good)


def test_vector_codes_of_few_or_no_rows(spark):
    rows = [(4, None, [1.5] * 16), (2, None, [-1.5] * 16)]
    found = vectorcodes.compressed(spark.createDataFrame([(*r, "c", 1) for r in rows], SHAPE))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_codes(rows)
    none = vectorcodes.compressed(spark.createDataFrame([(1, 1, None, "c", 1)], SHAPE))
    assert none.columns == found.columns and none.count() == 0
    with pytest.raises(ValueError):
        vectorcodes.compressed(spark.createDataFrame([(*r, "c", 1) for r in rows], SHAPE), entries=300)
