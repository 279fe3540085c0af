"""Token files, packing, vectors and the pipeline against brute force, and on odd rows."""
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import embeddedup, packing, tokenbin, tokens
from pagewright.llm.hnsw import Graph
from pagewright.llm.queries import vocabulary
from pagewright.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
TEXTS = ["a  b \n c<|endoftext|>d x", "", "  lead", " it's 's 'S don't   ", "é é ́x   y  z\x1c q \x85 r", "\n\n a\tb \t c", "ΣΑΣ ΣΑΣ. Σ", "á é",
         "1 234 5.6 , ,,, ' '' 's ² ½ Ⅷ", "x İstanbul ǅ. ªͅ ºa²,b 😀 é😀", "Wörter, Straße; ÉTÉ!!! &&&", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_agrees_with_the_library(docs, name):
    encoder = Encoder(vocabulary(name), most=500)
    for text in TEXTS + [r.text for r in docs.limit(80).collect()]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids(None) == b""


@pytest.mark.parametrize("kind, plain", [(r"\p{L}", r"[^\W\d_]"), (r"[^\s\p{L}\p{N}]", r"[^\s\w]|_"), (r"\p{N}", r"\d")])
def test_written_out_classes_hold_the_same_characters(kind, plain):
    every = "".join(map(chr, range(0x10000)))
    assert tokens._cutter(kind)(every) == re.findall(plain, every)
    assert not re.search(r"\\W|\\w|\|", tokens._classes()[kind])


@pytest.mark.parametrize("most", [200, 60000, 2**32 - 1])
def test_codes_give_any_token(most):
    ids = np.random.default_rng(most).integers(0, most, 5000, np.uint64, endpoint=True).astype(np.uint32)
    ids[::7] = 3
    codes = tokenbin.Codes(tokenbin.encode(ids))
    assert len(codes) == 5000 and codes.slice(0, 5000).tolist() == ids.tolist()
    assert [codes[k] for k in range(0, 5000, 37)] == ids[::37].tolist()
    assert codes.slice(511, 1025).tolist() == ids[511:1025].tolist() and codes.slice(9, 9).tolist() == []
    with pytest.raises(IndexError):
        codes[5000]
    assert len(tokenbin.Codes(tokenbin.encode(ids[:0]))) == 0
    with pytest.raises(ValueError):
        tokenbin.Codes(b"none")


def whole_ids(texts, name):
    tokenizer = Encoder(vocabulary(name)).tokenizer
    return [(tokenizer.encode(t, add_special_tokens=False).ids if t else []) + [1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-5, None), (-4, ""), (3 * 10**9, "end"), (7, "again")]
    files = tokenbin.write_files(spark.createDataFrame([(*r, 1) for r in rows[::-1]], SCHEMA + ", n_tokens int"), vocabulary("word_bpe_49k.json"), file_ids=900, part_chars=60000)
    assert files.select("part").distinct().count() > 2 and files.count() > 20
    found = sorted((r.start, r.doc_id, r.n_tokens, r.c) for r in tokenbin.read_files(files).withColumn("c", F.crc32("ids")).collect())
    ids = whole_ids([t for _, t in rows], "word_bpe_49k.json")
    assert [f[1] for f in found] == sorted(i for i, _ in rows)
    assert sorted(f[1:] for f in found) == sorted((i, len(x), crc(x)) for (i, _), x in zip(rows, ids))
    at = 0
    for start, _, n, _ in found:
        assert start == at
        at += n
    assert tokenbin.read_files(tokenbin.write_files(docs.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0
    nameless = tokenbin.read_files(tokenbin.write_files(spark.createDataFrame([(None, "x"), (1, "y")], SCHEMA), vocabulary("word_bpe_49k.json")))
    assert [(r.doc_id, r.start) for r in nameless.orderBy("start").collect()] == [(None, 0), (1, 2)]


def test_codes_are_read_where_they_lie(spark, docs):
    files = tokenbin.write_files(docs, vocabulary("word_bpe_49k.json"), file_ids=900, part_chars=60000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # files of any size that matters are above the threshold
        read = tokenbin.read_files(files)
        assert read.count() == docs.count()
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("length, slots", [(2048, 16), (64, 3)])
def test_packing(spark, docs, length, slots):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, ""), (9003, "word " * 5000), (None, "x y")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA + ", length int").repartition(5)
    found = packing.pack(frame, vocabulary("byte_bpe_50k.json"), length, slots).collect()
    ids = dict(zip([i for i, _ in rows], whole_ids([t for _, t in rows], "byte_bpe_50k.json")))
    pieces, sequences = {}, {}
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id][r.start:r.start + r.length] and r.length > 0
        assert r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for kind in (pieces, sequences):
        for parts in kind.values():
            assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert all(n <= length and n & (n - 1) == 0 for n in sizes)
    assert sum(n < length for n in sizes) <= 12
    assert packing.pack(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, "", 100)


# -- vectors


def brute(rows):
    """Per row: links and smallest id reachable."""
    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                near[a].append(b)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((i, len(near[k]), min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)))
    return out


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist(), k % 3) for k in range(200)]
    centre = rng.normal(size=8)
    rows += [(500 - k, (centre + rng.normal(size=8) * 0.12).tolist(), 1) for k in range(150)]
    rows += [(1000 + k, [1.0] * 8, 2) for k in range(30)] + [(2000, [2.0] * 8, 2), (2001, [1.0] * 8, 0)]
    rows += [(3000, None, 1), (3001, [0.0] * 8, 1), (3002, [1.0, None] * 4, 1), (3003, [1.0, float("nan")] * 4, 1), (3004, [float("inf")] * 8, 1),
             (3005, [], 1), (3006, [1.0] * 8, None), (None, [1.0] * 8, 2), (3007, [1.0] * 4, 2), (3008, [1e-30] * 4, 2)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    found = embeddedup.near_duplicates(frame, shard=60).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in found)
    assert embeddedup.near_duplicates(frame.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 32))
    vectors[700:1100] = vectors[0] + rng.normal(size=(400, 32)) * 0.05
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    graph = Graph(vectors)
    truth = np.argsort(-(vectors @ vectors.T), axis=1)[:, :10]
    found = graph.search(vectors, 64)[0][:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, found)]) >= 0.9
    q, v = embeddedup.linked(graph, vectors, 0.9, 32)
    exact = int((vectors @ vectors.T >= 0.9).sum())
    assert len(q) >= 0.99 * exact and len(set(zip(q.tolist(), v.tolist()))) == len(q)


def test_audit_of_rare_links():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(1200, 16))
    vectors[601] = vectors[600] + rng.normal(size=16) * 0.01
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    graph = Graph(vectors)
    for layer in graph.layers:  # nothing leads to these two
        layer[np.isin(layer, [600, 601])] = -1
    exact = {(int(q), int(v)) for q, v in zip(*np.nonzero(vectors @ vectors.T >= 0.98))}
    told = {}
    q, v = embeddedup.linked(graph, vectors, 0.98, 32, probes=1200, told=told)
    assert told["beams"] == 0  # such a graph fails its audit, and brute force is the answer
    assert {(600, 601), (601, 600)} <= exact == set(zip(q.tolist(), v.tolist()))


def test_graph_is_searched_where_links_are_few():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(900, 24))
    vectors[1::300] = vectors[::300] + rng.normal(size=(3, 24)) * 0.01
    vectors /= np.sqrt((vectors**2).sum(1, keepdims=True))
    told = {}
    q, v = embeddedup.linked(Graph(vectors), vectors, 0.98, 32, told=told)
    assert told["beams"] == 900 and told["nearest"] >= embeddedup.NEAREST_RECALL and told["probed"] == embeddedup.PROBES
    assert set(zip(q.tolist(), v.tolist())) == {(int(a), int(b)) for a, b in zip(*np.nonzero(vectors @ vectors.T >= 0.98))}
    empty = embeddedup.linked(Graph(vectors[:0]), vectors, 0.98, 32)
    assert [len(x) for x in empty] == [0, 0]


def test_repeated_rows_are_no_links(spark):
    rows = [(1, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [1.0] + [-1.0] * 7, 1), (3, [1.0] + [-1.0] * 7, 1)]
    found = embeddedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3)]


# -- pipeline


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    extra = spark.createDataFrame([(None, None, None, None, None), (9000, "", "en", "s", 0), (9001, "the same of and to in " * 9, "en", "s", 198), (9001, "the same of and to in " * 9, "en", "s", 198),
                                   (9002, "the same of and to in " * 9, "en", None, 198)], docs.schema)
    got = docs.unionByName(extra)
    first = corpus_pipeline.language_id(spark, got, SF)
    assert first.columns == docs.columns and first.filter("text IS NULL OR text = ''").count() == 0
    assert first.count() >= 0.97 * docs.count()
    second = corpus_pipeline.near_dedup(spark, got, SF)
    assert second.columns == docs.columns and second.filter("doc_id >= 9001").count() == 1
    assert second.filter("text IS NULL").count() == 1 and second.filter("doc_id = 9000").count() == 1
    third = corpus_pipeline.substring_dedup(spark, got, SF)
    assert third.columns == docs.columns and third.count() == got.count()
    assert third.filter("doc_id = 9002").first().text == "" and third.filter("doc_id = 9002").first().n_chars == 0
    told = {r.doc_id: r for r in got.collect()}
    changed = {r.doc_id for r in third.collect() if r.text != told[r.doc_id].text}
    assert changed and all(t.text == told[t.doc_id].text for t in third.collect() if t.doc_id not in changed)
    fourth = corpus_pipeline.decontamination(spark, got, SF)
    assert fourth.columns == docs.columns and 0 < got.count() - fourth.count() < 0.2 * got.count()
    assert fourth.filter("doc_id IS NULL").count() == 1
    ids = fourth.agg(F.countDistinct("doc_id")).first()[0]
    assert corpus_pipeline.pack(spark, fourth.filter("doc_id IS NOT NULL"), SF).select("doc_id").distinct().count() == ids
