"""Corpus operators on texts against brute force, and on odd rows."""
import hashlib
import math
import re
import tracemalloc
import weakref
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import chat, decontaminate, langid, maintext, minhash, ngramlm, substrings
from pagewright.llm.common import WordHashes, components, kept
from pagewright.llm.substrings import Block

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
LONG = " ".join(f"w{k % 7001}" for k in range(20000))
ODD = [(None, "null id one two three"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (7, "word " * 400),
       (8, "null id one two three"), (8, "other text for the same id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- language


def test_languages_of_held_out_texts(docs):
    rows = langid.identified(docs).withColumn("out", langid.held_out(F.col("doc_id"))).filter("out").collect()
    assert len(rows) > 40
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_learns_from_what_is_not_held_out(docs):
    training = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("text", "lang")
    assert langid.train(training) == langid.train(docs.filter(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    assert len(langid.train(training)) == 4


def test_language_of_odd_texts(spark):
    known = {"aa": ("alpha beta gamma delta " * 9).encode(), "bb": ("uno dos tres cuatro cinco " * 9).encode()}
    rows = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "12 !?", 9.0), (4, "alpha gamma delta beta alpha", 9.0), (5, "tres dos cinco cuatro " * 9000, 9.0),
                                  (6, "xyzzy", 9.0)], "doc_id int, text string, score double")
    found = {r.doc_id: r for r in langid.identify(rows, known).collect()}
    assert [found[k].lang_pred for k in range(1, 6)] == ["und", "und", "und", "aa", "bb"]
    assert [found[k].rejected for k in range(1, 7)] == [True, True, True, False, False, True]
    assert found[1].score == 0 and langid.identify(rows, known).columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    alone = langid.identify(rows, {"aa": b"alpha"}).filter("doc_id = 4").first()
    assert (alone.lang_pred, alone.score, alone.rejected) == ("aa", 1.0, False)
    assert langid.identify(rows, {}).filter("lang_pred = 'und' AND rejected").count() == 6


# -- decontamination


def hits(text, items, size):
    words = decontaminate.words_of(text)
    hit, ids = set(), set()
    for item_id, other in items:
        theirs = decontaminate.words_of(other)
        if not theirs or item_id is None:
            continue
        n = min(size, len(theirs))
        grams = {tuple(theirs[k:k + n]) for k in range(len(theirs) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k:k + n]) in grams:
                hit.update(range(k, k + n))
                ids.add(str(item_id))
    return len(words), len(hit), ",".join(sorted(ids))


@pytest.mark.parametrize("shard, block", [(10**9, 10**6), (60, 3)])
def test_contamination(spark, shard, block, monkeypatch):
    items = [(1, "a b c d e f g h i j k l"), (2, "c d e f g h i j k l m n"), (10, "short Item"), (3, None), (4, "?!"), (None, "one two"), (5, "x x x x x x x x x x x")]
    texts = ["A B, c d e f g h i j k l m n o", "short item short ITEM", "x " * 30, None, "", "c d e f g h i j", "a b c d e f g h i", "k l short", "item z",
             "b c d e f g h i j k l short item", "one two", "é short item ß"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (0, texts[0])]
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard)
    index = decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda d: index(d, shard))
    whole = decontaminate.matches
    monkeypatch.setattr(decontaminate, "matches", lambda i, t, s: whole(i, t, s, 0, block))
    found = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    expected = [(i, *hits(t, items, 10)) for i, t in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in found), key=key) == sorted(
        ((i, w, h, hashlib.sha256(ids.encode()).hexdigest()) for i, w, h, ids in expected), key=key)
    assert all(r.contaminated == (r.n_hit > 0) and (r.n_items == 0) == (r.n_hit == 0) for r in found)


def test_proximity(spark, empty):
    items = spark.createDataFrame([("i", "red green blue")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "red very green blue"), (2, "red green"), (3, "blue"), (4, "red x x x x x green blue")], SCHEMA)
    index = decontaminate.build_index(docs)
    assert decontaminate.matches(index, items, 3).count() == 0
    assert [(r.starts, r.stops) for r in decontaminate.matches(index, items, 3, slop=1).collect()] == [([0], [4])]
    with pytest.raises(ValueError):
        decontaminate.matches(index, items, 3, slop=1000)
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count() == 0


def test_shards_one_by_one(spark, monkeypatch):
    """However many shards a split has, a task writes, reads and searches them one at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(k, "red green blue" if k % 3 == 0 else "red") for k in range(30)], SCHEMA).coalesce(1)
    index = decontaminate.build_index(docs, 200)
    groups = [g for f in index.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert len(groups) == index.count() > 5 and {g.num_rows for g in groups} == {1}
    searcher = decontaminate._searcher

    def alone(*args):
        search = searcher(*args)

        def kernel(batches):
            def watched():
                for batch in batches:
                    assert batch.num_rows == 1
                    yield batch

            yield from search(watched())

        return kernel

    monkeypatch.setattr(decontaminate, "_searcher", alone)
    found = decontaminate.matches(index, spark.createDataFrame([("i", "red green blue")], "item_id string, text string"), 3)
    assert found.count() == 10 and spark.conf.get(name) == before


# -- near-duplicates


def shingle_set(text, size):
    words = text.encode().lower().split() if text else []
    n = min(size, len(words))
    return {tuple(words[k:k + n]) for k in range(len(words) - n + 1)} if words else set()


def dup_components(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least.get(root(k)) if i is not None else None) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, size):
    rng = np.random.default_rng(size)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").limit(60).collect()]
    base = [f"t{k}" for k in rng.integers(0, 10**6, 90)]
    for k in range(160):  # near copies of one text, near to and beyond the threshold
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 12 if size == 2 else 5)):
            words[at] = f"c{k}x{at}"
        rows.append((10**6 - 2 * k, " ".join(words)))
    rows += [(5 * 10**6 + k, "same text again and again over") for k in range(40)]
    rows += ODD
    found = minhash.groups(spark.createDataFrame(rows, SCHEMA), size).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(dup_components(rows, size), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_near_duplicates_that_share_an_id(spark):
    x, clean = [" ".join(f"{c}{k}" for k in range(200)) for c in "xc"]
    rows = [(3, x), (8, x + " y"), (8, clean), (9, clean + " d"), (3, clean + " e f g"), (7, "alone with its words here")]
    for given in (rows, rows[::-1]):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in given], SCHEMA + ", lang string, source string, n_chars int")
        found = minhash.groups(frame).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(dup_components(given, 5), key=key)
    frame = frame.filter("doc_id NOT IN (9) AND text NOT LIKE '% g'")
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame, SF).collect()} == {(3, x), (8, clean), (7, rows[-1][1])}


def test_links_once_followed_are_not_followed_again(spark, monkeypatch):
    counts = []

    def counted(edges, *ends):
        counts.append(edges.count())
        return components(edges, *ends)

    monkeypatch.setattr(minhash, "components", counted)
    rows = [(k, " ".join(f"w{j}" for j in range(200)) + f" own{k}") for k in range(120)]
    assert {r.component_id for r in minhash.groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    assert counts[0] >= 119 and counts[1:] == [0, 0]


def test_links_across_groups_are_a_forest(spark):
    texts = [" ".join([f"{c}{k}" for k in range(60)] + [f"own{c}{j}"] * (j % 3)) for c in "ab" for j in range(150)] + ["another text on its own"]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], SCHEMA)
    nodes = minhash.signed(frame, 2).withColumnRenamed("doc_id", "rep").select("rep", "minima").cache()
    lists = spark.createDataFrame([(token, k) for token in (5, 7) for k in range(len(texts))], "token long, rep long")
    members = nodes.select("rep", F.col("rep").alias("g"), F.col("rep").alias("component"))
    bodies = frame.select(F.col("doc_id").cast("long").alias("rep"), "text")
    found = minhash.across_groups(lists, members, nodes, bodies, 2, 80).cache()
    assert {(r.node, r.component) for r in components(found).collect()} == {(k, k // 150 * 150) for k in range(300)}
    # Of the 22,350 pairs of either text a forest leaves each of the at most six block pairs.
    assert found.count() <= 6 * 299


def test_one_large_group_of_a_list_meets_only_the_others(spark):
    # Groups 0 (1,500 rows), 1 (300) and eleven of one row each.
    rows = spark.range(1811).select(F.lit(7).cast("long").alias("token"), F.col("id").alias("rep"), F.when(F.col("id") < 1500, 0).when(
        F.col("id") < 1800, 1).otherwise(F.col("id")).cast("long").alias("g"), F.col("id").alias("component"))
    dealt = minhash._block_pairs(rows, rows.groupBy("token", "g").agg(F.count("*").alias("n")), 128).collect()
    where, of = {}, {}
    for r in dealt:
        where.setdefault(r.rep, set()).add((r.i, r.j))
        of[r.rep] = r.g
    met = {}
    for rep, places in where.items():
        for place in places:
            met.setdefault(place, []).append(rep)
    pairs = {(a, b) for held in met.values() for a in held for b in held if a < b and of[a] != of[b]}
    assert len(pairs) == 1500 * 300 + 1800 * 11 + 55 and len(where) == 1811
    # 1,500 rows meet four other blocks, 300 thirteen and eleven all sixteen; before, each of 1,811 met fifteen.
    assert len(dealt) == 1500 * 4 + 300 * 13 + 11 * 16


def test_near_duplicates_of_nothing(empty, odd):
    assert minhash.groups(empty).count() == 0
    assert minhash.groups(odd).count() == len(ODD)


def test_exact_similarity():
    left, right = [np.arange(n, dtype=np.uint64) for n in (8, 10)], [np.arange(2, 10, dtype=np.uint64), np.arange(10, dtype=np.uint64)]
    assert minhash._links(left, right, 80).tolist() == [[False, True], [True, True]]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert found == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- repeated sequences


def without(rows, size):
    first = {}
    for i, t in rows:
        words = t.split() if t else []
        for k in range(len(words) - size + 1):
            g = tuple(words[k:k + size])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        words = t.split() if t else []
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            least = first.get(tuple(words[k:k + size]))
            if least is not None and (i is None or least < i):
                gone[k:k + size] = [True] * size
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def test_repeated_sequences(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{k}" for k in range(6)]
    passages = [" ".join(rng.choice(vocabulary, n)) for n in (13, 20, 60, 14)]
    rows = list(ODD)
    for k in range(150):
        parts = [" ".join(rng.choice([f"u{x}" for x in range(40)], rng.integers(0, 15)))]
        for _ in range(rng.integers(0, 4)):
            parts += [passages[rng.integers(0, 4)], " ".join(rng.choice(vocabulary[:3], rng.integers(0, 30)))]
        rows.append((int(rng.integers(10, 90)), " ".join(parts)))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA + ", N_words int, extra string")
    found = substrings.without_repeats(frame, block_chars=500, parts=3)
    assert sorted(found.columns) == ["doc_id", "extra", "kept_text", "n_removed", "n_words", "text"]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found.collect()), key=key) == sorted(without(rows, 13), key=key)


def test_a_block_keeps_no_words():
    texts, hashes = [" ".join(f"w{k % 977}" for k in range(at, at + 500)) for at in range(0, 100_000, 500)], WordHashes()
    hashes.of([f"w{k}".encode() for k in range(977)])
    tracemalloc.start()
    block = Block(texts, list(range(len(texts))), 13, hashes)
    block.keys()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 220 * len(block.hashed)


def test_a_worker_keeps_one_memory_at_a_time():
    first = kept("first", WordHashes)
    assert kept("first", WordHashes) is first
    kept("second", WordHashes)
    assert kept("first", WordHashes) is not first
    kept("first", WordHashes).itself = [kept("first", WordHashes)]  # as an encoder and its pieces
    gone = weakref.ref(kept("first", WordHashes))
    kept("second", WordHashes)
    assert gone() is None


def test_stages_take_small_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10_000)
        dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
        assert int(spark.conf.get(name)) == 512
    finally:
        spark.conf.set(name, before)


def test_repeats_of_nothing(empty):
    assert substrings.digests(empty).count() == 0


def test_equal_windows_have_equal_representatives():
    rng = np.random.default_rng(9)
    windows = [list(rng.integers(0, 4, 13)) for _ in range(200)]
    keys = {}
    for w in windows * 3:
        before, after = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        words = [f"q{x}" for x in [*before, *w, *after]]
        block = Block([" ".join(words)], [1], 13, WordHashes())
        keys.setdefault(tuple(w), set()).add(int(block.keys()[len(before)]))
    assert all(len(k) == 1 for k in keys.values())


# -- scores


def test_scores(spark, empty):
    rows = [(1, "the cat sat on the mat"), (2, "the cat sat on the hat the cat"), (3, "A dog"), (4, None), (None, "cat the the cat"), (5, ""), (1, "the cat")]
    texts = [decontaminate.words_of(t) for _, t in rows]
    for order in (1, 2, 3):
        counts = Counter(tuple(w[k:k + n]) for w in texts for n in range(1, order + 1) for k in range(len(w) - n + 1))
        total = sum(map(len, texts))

        def value(words, at):
            lost = 0
            for n in range(min(order, at + 1), 1, -1):
                gram = tuple(words[at - n + 1:at + 1])
                if counts[gram] >= 2:
                    return math.log(counts[gram] / counts[gram[:-1]]) + lost * math.log(0.4)
                lost += 1
            return math.log(counts[(words[at],)] / total) + lost * math.log(0.4)

        expected = [(i, len(w), round(sum(value(w, k) for k in range(len(w))), 6)) for (i, _), w in zip(rows, texts)]
        found = ngramlm.scores(spark.createDataFrame(rows, SCHEMA), order, block_chars=30, parts=3).collect()
        key = lambda r: tuple(map(str, r[:2]))
        for a, b in zip(sorted(((r.doc_id, r.n_words, r.score) for r in found), key=key), sorted(expected, key=key)):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-5
        assert all((r.mean_score is None) == (r.n_words == 0) for r in found)
    assert ngramlm.scores(empty).count() == 0


# -- conversations


def test_conversations(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (2, 1, "bot", "yes"), (2, 2, "user", "more"),
             (3, 5, "user", "hi"), (3, 6, "bot", "yes"), (3, 7, "user", "more"), (4, 0, "user", "hi"), (4, 1, "bot", "no"),
             (5, 0, None, "hi"), (6, 0, "user", None), (6, 0, "user", None), (6, None, "user", ""), (None, 0, "user", "hi"), (None, 0, "user", "lone")]
    frame = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, n string")
    found = {(r.conv_id, r.n_turns): r.rendered for r in chat.render(frame, "<", ">").collect()}
    assert set(found) == {(2, 3), (4, 2), (5, 1), (6, 2), (None, 1)}
    assert found[(2, 3)] == "<user\nhi>\n<bot\nyes>\n<user\nmore>\n"
    assert found[(6, 2)] == "<user\n>\n<user\n>\n" and found[(5, 1)] == "<\nhi>\n" and found[(None, 1)] == "<user\nlone>\n"
    assert chat.render(frame.limit(0)).count() == 0


# -- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Latest news of the side</p></div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b> text&nbsp;with<br>break and a <a href="/x">link</a> inside.</p><script>var a="<p>no</p>"</script>
<div class="ad">Buy</div><ul><li>One item</li><li>Two</li></ul><p>Second paragraph with enough words to weigh.</p>
<form><input value=x>Send</form></article><div class="comments"><p>I disagree with all of this, said a reader at length.</p></div><footer>&copy; us</footer></body></html>"""


def test_main_text(pages_of, spark):
    text = maintext.main_text(PAGE)
    assert text == "Title & more\nFirst bold text with break and a link inside.\nOne item\nTwo\nSecond paragraph with enough words to weigh."
    assert [maintext.main_text(x) for x in (None, "", "<p>", "<nav><a href=x>y</a></nav>")] == ["", "", "", ""]
    assert maintext.main_text("plain words only") == "plain words only"
    assert maintext.main_text("<div>" * 3000 + "deep") == "deep"
    links = "".join(f'<li><a href="/{k}">another page number {k}</a></li>' for k in range(40))
    assert maintext.main_text(f"<body><div><ul>{links}</ul></div><div><p>The words of the story are here, and they are many.</p><p>More of it.</p></div>"
                              ) == "The words of the story are here, and they are many.\nMore of it."
    rows = maintext.main_texts(pages_of(PAGE, None, "<p>é</p>")).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(0, len(text)), (1, 0), (2, 1)]
    assert maintext.main_texts(pages_of(PAGE).limit(0)).count() == 0


def paragraphs(n, name):
    return "".join(f"<p>{name}{k} " + "words of a longer paragraph " * 18 + "</p>" for k in range(n))


@pytest.mark.parametrize("wrap", ['<div class="layout no-sidebar">', '<div class="page has-sidebar">', '<div class="sidebar">', '<form action="/aspx">', '<div role="form">', '<div id="social">'])
def test_main_text_within_named_blocks(wrap):
    close = f"</{wrap[1:wrap.index(' ')]}>"
    for inner in (paragraphs(4, "n"), f"<article>{paragraphs(4, 'n')}</article>"):
        text = maintext.main_text(f"<body>{wrap}{inner}{close}</body>")
        assert [b.split()[0] for b in text.split("\n")] == ["n0", "n1", "n2", "n3"]


def test_main_text_keeps_sections_of_an_article():
    named = ['id="discussion"', 'id="related-work"', 'id="cookies"', 'class="social-impact"', 'class="navy-history"']
    sections = "".join(f"<section {name}><p>s{k} text</p></section>" for k, name in enumerate(named))
    junk = '<div class="share"><a href="/s">Share this</a></div><div class="newsletter box">Get our letter</div>'
    text = maintext.main_text(f"<body><article>{paragraphs(2, 'n')}{sections}{junk}</article><div class='comments'>{'<p>no</p>' * 3}</div></body>")
    assert [b.split()[0] for b in text.split("\n")] == ["n0", "n1", "s0", "s1", "s2", "s3", "s4"]


def starts(html):
    return [b.split()[0] for b in maintext.main_text(html).split("\n")]


@pytest.mark.parametrize("sections, each", [(2, 3), (4, 8)])
@pytest.mark.parametrize("tag", ["section", "div"])
def test_main_text_of_several_sections(sections, each, tag):
    parts = "".join(f"<{tag}>{paragraphs(each, f's{k}x')}</{tag}>" for k in range(sections))
    links = "".join(f'<li><a href="/{k}">page number {k}</a></li>' for k in range(30))
    names = [f"s{k}x{j}" for k in range(sections) for j in range(each)]
    assert starts(f"<body><div>{parts}</div></body>") == names
    assert starts(f"<body><ul>{links}</ul><div><h1>Title</h1>{parts}</div><div><ul>{links}</ul></div></body>") == ["Title", *names]
    assert starts(f"<body><div><ul>{links}</ul></div><h1>Title</h1><p>By us</p>{parts}<div><ul>{links}</ul></div></body>") == ["Title", "By", *names]
    assert starts(f"<body><main><h1>Title</h1>{parts}<p>End</p></main><div><p>x</p></div></body>") == ["Title", *names, "End"]


def test_main_text_with_short_parts_and_headings():
    long, links = paragraphs(5, "n"), "".join(f'<li><a href="/{k}">page number {k}</a></li>' for k in range(30))
    page = f"<body><h2>Elsewhere</h2><ul>{links}</ul><h2>Story</h2><div>{long}</div><h3>Mid</h3><ul>{links}</ul><div>{paragraphs(4, 'm')}</div></body>"
    assert starts(page) == ["Story", *[f"n{k}" for k in range(5)], "Mid", *[f"m{k}" for k in range(4)]]
    assert starts(f"<body><section>{long}</section><section><h2>Notes</h2><ul><li>a</li><li>b</li></ul></section></body>") == [*[f"n{k}" for k in range(5)], "Notes", "a", "b"]
    assert starts(f"<body><article>{long}</article><article>{paragraphs(5, 'm')}</article></body>") == [f"{c}{k}" for c in "nm" for k in range(5)]


LONG_BLOCKS = [
    '<div class="comments">{}</div>', '<section id="comments">{}</section>', '<section id="comments"><article>{}</article><article>{}</article></section>',
    '<article class="comment">{}</article>', '<div itemprop="comment">{}</div>', '<div id="disqus_thread">{}</div>', '<ol class="comment-list"><li>{}</li></ol>', '<form>{}</form>',
    '<div role="form">{}</div>', '<div class="advert">{}</div>', '<div class="ad-slot">{}</div>', '<div class="cookie-notice">{}</div>', '<div class="sidebar">{}</div>',
    '<section class="discussion"><div class="post">{}</div><div class="post">{}</div></section>', '<div id="related"><ul><li class="teaser">{}</li><li class="teaser">{}</li></ul></div>']


@pytest.mark.parametrize("block", LONG_BLOCKS)
@pytest.mark.parametrize("home", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div>{}</div>", "<div class='sidebar'><article>{}</article></div>"])
def test_main_text_without_long_blocks(home, block):
    junk = block.replace("{}", paragraphs(1, "x"))
    names = ["n0", "n1", "n2"]
    assert starts(f"<body>{home.replace('{}', paragraphs(3, 'n') + junk)}</body>") == names
    assert starts(f"<body>{home.replace('{}', paragraphs(3, 'n'))}{junk}</body>") == names
    if "comment" in block and "article" in home:
        assert starts(f"<body>{home.replace('{}', paragraphs(3, 'n'))}{junk * 8}</body>") == names


def test_main_text_keeps_what_only_looks_like_boilerplate():
    long = paragraphs(1, "s")
    for part in ('<section id="discussion">{}</section>', '<section class="discussion">{}</section>', '<section id="cookies">{}</section>', '<div id="related-work">{}</div>'):
        assert starts(f"<body><article>{paragraphs(2, 'n')}{part.replace('{}', long)}</article></body>") == ["n0", "n1", "s0"]
    assert starts(f'<body><article><form>{paragraphs(3, "n")}</form><p>s0</p></article></body>') == ["n0", "n1", "n2", "s0"]
    assert starts(f'<body><div class="comments">{paragraphs(3, "n")}</div></body>') == ["n0", "n1", "n2"]
    formula = "<math><semantics><mi>a</mi><mo>=</mo><mi>b</mi><annotation encoding='application/x-tex'>a = b</annotation></semantics></math>"
    assert maintext.main_text(f"<body><article>{paragraphs(2, 'n')}<p>where {formula} holds</p></article></body>").split("\n")[2] == "where a=b holds"


def test_main_text_of_given_pages(spark):
    for row in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", row.html, re.S).group(1)
        blocks = [" ".join(re.sub(r"<[^>]*>", " ", b).split()) for b in re.split(r"</?(?:h1|p|ul|li)>", inside)]
        assert maintext.main_text(row.html).replace("&", "&amp;") == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("text, letters", [("½ ²", False), ("Ⅷ ① ㊷", False), ("1 2 _ !", False), ("ª", True), ("7 ж", True)])
def test_only_letters_make_a_language(text, letters):
    levels = [langid._packers({"aa": b"one two three", "bb": b"drei vier"}, level) for level in langid.LEVELS]
    assert (langid._choose(text, levels, 0.0)[0] != "und") == letters == any(map(str.isalpha, text))
