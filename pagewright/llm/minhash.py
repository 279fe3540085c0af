"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pagewright.llm.common import WordHashes, components, in_sorted, mixed, stored, windows_hashed

#: A signature has COORDINATES coordinates; each is made of DEPTH minima, so unlike texts hardly ever agree in one.
COORDINATES, DEPTH = 32, 4
#: Pairs that agree in fewer coordinates are not looked at: at a similarity of 0.8 one in a million does.
MATCHES = 2
#: Pairs across groups whose minima agree less are dropped before texts are fetched: 0.8 is 4.5 deviations away.
LEAST_ESTIMATE = 0.62
#: Texts that one verifying task holds at a time, and signatures of a posting list in a block.
TEXTS, LISTED = 128, 512
SHINGLE, PERCENT = 5, 80

_SIGNED = "doc_id long, text_hash long, n_shingles long, name binary, coordinates array<long>, minima binary"


def shingles(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """The different 64-bit names of runs of `size` words ([^\\x20\\x09-\\x0D]+, A-Z lowered), sorted; of fewer words,
    but not none, the whole sequence is the one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows_hashed(hashes.of(words), min(size, len(words))))


def signed(docs: DataFrame, size: int, coordinates: int = COORDINATES, depth: int = DEPTH) -> DataFrame:
    """Per row: the size and name of its shingle set, its signature and the minima it is made of (16 bits of each)."""
    def kernel(batches):
        draw = np.random.default_rng(11)
        turn = draw.integers(0, 2**63, coordinates * depth, np.uint64)[:, None]
        odd = (draw.integers(0, 2**63, coordinates * depth, np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        tag = mixed(np.arange(1, coordinates + 1, dtype=np.uint64))
        hashes = WordHashes()
        for batch in batches:
            count, names, signatures, minima = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, size, hashes)
                count.append(len(found))
                if not len(found):
                    names.append(None), signatures.append(None), minima.append(None)
                    continue
                names.append(xxhash.xxh3_128_digest(found.tobytes()))
                least = np.full(len(turn), 0xFFFFFFFFFFFFFFFF, np.uint64)
                for at in range(0, len(found), 2048):
                    least = np.minimum(least, ((found[None, at:at + 2048] ^ turn) * odd).min(1))
                value = tag.copy()
                for row in least.reshape(coordinates, depth).T:
                    value = mixed(value ^ row)
                signatures.append(value.view(np.int64))
                minima.append((mixed(least) >> np.uint64(48)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(names, pa.binary()),
                pa.array(signatures, pa.list_(pa.int64())), pa.array(minima, pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "name", "coordinates", "minima"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(kernel, _SIGNED)


def posted(nodes: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """(token, rep, n): the postings by which pairs with enough matches are found.

    A token is a coordinate with its value. Tokens that only one node has find nothing. Of the others a node, in an
    order from the rarest on that is the same for all, needs all but the last matches - 1 (those of a node are
    fewer than its coordinates by its lone tokens, which would come first); nodes with fewer shared tokens than
    matches are skipped."""
    tokens = nodes.select("rep", F.explode("coordinates").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("token", "n")
    lists = tokens.join(shared, "token")
    mine = Window.partitionBy("rep")
    return lists.withColumn("at", F.row_number().over(mine.orderBy("n", "token"))).withColumn(
        "have", F.count("*").over(mine)).filter(F.col("at") <= F.col("have") - (matches - 1)).select("token", "rep", "n")


def _sets(table: pa.Table, size: int) -> list[np.ndarray]:
    hashes = WordHashes()
    return [shingles(t, size, hashes) for t in table["text"].to_pylist()]


def _links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the left sets reach the similarity with which of the right: by exact counts, some columns at a time."""
    every = np.unique(np.concatenate(left + right))
    both = np.zeros((len(left), len(right)))
    cuts = np.arange(0, len(every), 16384)
    for at in cuts:
        part = every[at:at + 16384]
        grids = []
        for sets in (left, right):
            grid = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                inside = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
                grid[k, np.searchsorted(part, inside)] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - both
    return 100 * np.rint(both) >= percent * np.rint(union)


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. One text of a meets at most TEXTS of b at a time."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / TEXTS).alias("salts"))
    dealt = pairs.join(sizes, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    b_side = dealt.select("a", "salt", F.col("b").alias("rep"), F.lit(1).alias("side"))
    a_side = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("rep"), F.lit(0).alias("side"))
    rows = b_side.unionByName(a_side).join(texts, "rep")

    def kernel(table):
        sets, side, reps = _sets(table, size), np.array(table["side"]), np.array(table["rep"])
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(here) or not len(there):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ok = _links([sets[here[0]]], [sets[k] for k in there], percent)[0]
        return pa.table({"a": pa.array(np.full(int(ok.sum()), reps[here[0]]), pa.int64()), "b": pa.array(reps[there[ok]], pa.int64())})

    return rows.groupBy("a", "salt").applyInArrow(kernel, "a long, b long")


def within_groups(members: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside a group (g, rep, component) between those outside its hub's component and all others.

    Both are cut into blocks of TEXTS; each pair of blocks is one task's work, of which at most one link for each
    text and component comes out. Pairs inside one component are not looked at."""
    hub = members.filter("g = rep").select("g", F.col("component").alias("home"))
    known = members.join(hub, "g").withColumn("away", F.col("component") != F.col("home"))
    sizes = known.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("away").cast("long")).alias("out")).filter("out > 0 AND n > 2").select(
        "g", F.ceil(F.col("n") / TEXTS).alias("ys"), F.ceil(F.col("out") / TEXTS).alias("xs"))
    open_ = known.join(sizes, "g")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    x = open_.filter("away").select("g", mine("xs").alias("ix"), blocks("ys").alias("iy"), "rep", "component", F.lit(0).alias("side"))
    y = open_.select("g", blocks("xs").alias("ix"), mine("ys").alias("iy"), "rep", "component", F.lit(1).alias("side"))
    rows = x.unionByName(y).join(texts, "rep")

    def kernel(table):
        side, reps, of = np.array(table["side"]), np.array(table["rep"]), np.array(table["component"])
        here, there = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(here) or not len(there) or len(set(of)) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = _sets(table, size)
        ok = _links([sets[k] for k in here], [sets[k] for k in there], percent) & (of[here][:, None] != of[there][None, :])
        found = {(int(reps[here[p]]), int(of[there[q]])): int(reps[there[q]]) for p, q in zip(*np.nonzero(ok))}
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array(list(found.values()), pa.int64())})

    return rows.groupBy("g", "ix", "iy").applyInArrow(kernel, "a long, b long")


class _Near:
    """Rows of one posting list, and which of them may be similar across groups and components.

    A pair that shares several lists is judged in the one of the smallest token only."""

    def __init__(self, table: pa.Table):
        self.token = table["token"][0].as_py()
        self.rep, self.g, self.of, self.mine = (np.array(table[c]) for c in ("rep", "g", "component", "mine"))
        self.minima = np.frombuffer(b"".join(table["minima"].to_pylist()), "<u2").reshape(len(self.rep), -1)
        lists = table["tokens"].to_pylist()
        self.tokens = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
        for k, found in enumerate(lists):
            self.tokens[k, :len(found)] = found

    def of_blocks(self, i: int, j: int):
        """(k, others, agreement) of each row k of block i with some of block j that may be similar."""
        here, there = np.flatnonzero(self.mine == i), np.flatnonzero(self.mine == j)
        for k in here:
            apart = there[(self.g[there] != self.g[k]) & (self.of[there] != self.of[k]) & ((i != j) | (self.rep[there] > self.rep[k]))]
            if not len(apart):
                continue
            agree = (self.minima[apart] == self.minima[k]).mean(1)
            near, agree = apart[agree >= LEAST_ESTIMATE], agree[agree >= LEAST_ESTIMATE]
            if len(near):
                theirs = self.tokens[near]
                own = np.where(np.isin(theirs, self.tokens[k]), theirs, np.iinfo(np.int64).max).min(1) == self.token
                if own.any():
                    yield k, near[own], agree[own]


def _block_pairs(rows: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """Rows of a list dealt to the pairs (i, j) of its blocks that their own block `mine` is part of.

    `sizes` are (token, g, n). A group of `width` rows or more has blocks of its own and meets the blocks of others only, so a
    list of one large group and a few other rows is dealt in proportion to its length; smaller groups share blocks."""
    large = F.col("n") >= width
    every = sizes.groupBy("token").agg(F.coalesce(F.sum(F.when(large, F.ceil(F.col("n") / width))), F.lit(0)).alias("first"),
                                       F.ceil(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)) / width).alias("shared"))
    ahead = Window.partitionBy("token").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.filter(large).select("token", "g", F.ceil(F.col("n") / width).alias("own")).withColumn(
        "start", F.coalesce(F.sum("own").over(ahead), F.lit(0)))
    place = F.xxhash64("rep")
    mine = F.when(F.col("own").isNull(), F.col("first") + F.pmod(place, F.greatest("shared", F.lit(1)))).otherwise(
        F.col("start") + F.pmod(place, F.col("own")))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("first") + F.col("shared") - 1)
    others = F.filter(blocks, lambda k: F.col("own").isNull() | (k < F.col("start")) | (k >= F.col("start") + F.col("own")))
    dealt = rows.join(every, "token").join(own, ["token", "g"], "left").withColumn("mine", mine).withColumn("other", F.explode(others))
    return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop(
        "other", "first", "shared", "own", "start")


def across_groups(lists: DataFrame, members: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links that join components which share a posting list across groups.

    Only lists that hold several groups and components are looked at, a pair of their blocks in one task. First the
    nodes are named that have a partner whose minima agree enough; then these come with their texts, again block
    against block, and full sets decide. Of the links of a block a forest over its components leaves the task, so rows
    grow with the nodes, not with their pairs."""
    known = lists.select("token", "rep").join(members, "rep")
    several = known.groupBy("token").agg(
        F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("component").alias("c"), F.max("component").alias("d")).filter(
        "lo <> hi AND c <> d").select("token")
    open_ = known.join(several, "token")
    about = open_.groupBy("rep").agg(F.collect_list("token").alias("tokens")).join(nodes.select("rep", "minima"), "rep")
    sizes = open_.groupBy("token", "g").agg(F.count("*").alias("n"))
    rows = _block_pairs(open_, sizes, LISTED).join(about, "rep")

    def marking(table):
        near, i, j = _Near(table), table["i"][0].as_py(), table["j"][0].as_py()
        has = np.zeros(len(near.rep), bool)
        for k, others, _ in near.of_blocks(i, j):
            has[k] = True
            has[others] = True
        return pa.table({"token": pa.array(np.full(int(has.sum()), near.token), pa.int64()), "rep": pa.array(near.rep[has], pa.int64())})

    marked = stored(rows.groupBy("token", "i", "j").applyInArrow(marking, "token long, rep long").distinct(), "marked")
    placed = marked.join(members, "rep")
    sizes = placed.groupBy("token", "g").agg(F.count("*").alias("n"))
    closer = _block_pairs(placed, sizes, TEXTS).join(about, "rep").join(texts, "rep")

    def joining(table):
        near, i, j = _Near(table), table["i"][0].as_py(), table["j"][0].as_py()
        found = [(-float(a), int(k), int(q)) for k, others, agree in near.of_blocks(i, j) for q, a in zip(others, agree)]
        sets, root, a, b = {}, {}, [], []
        hashes, bodies = WordHashes(), table["text"]

        def set_of(k):
            if k not in sets:
                sets[k] = shingles(bodies[k].as_py(), size, hashes)
            return sets[k]

        def top(c):
            while root.get(c, c) != c:
                c = root[c]
            return c

        for _, k, q in sorted(found):
            left, right = top(int(near.of[k])), top(int(near.of[q]))
            if left == right:
                continue
            both = int(in_sorted(set_of(k), set_of(q)).sum())
            if 100 * both >= percent * (len(sets[k]) + len(sets[q]) - both):
                root[max(left, right)] = min(left, right)
                a.append(int(near.rep[k]))
                b.append(int(near.rep[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return closer.groupBy("token", "i", "j").applyInArrow(joining, "a long, b long")


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), one row per row of (doc_id, text).

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest
    doc_id reachable. Equal sets are one node with a key of its own, which doc_ids are told from at the end only. Nodes that
    agree in signature coordinates are candidates:

    1. each node is held against one hub, the smallest node that shares most of its posting lists;
    2. nodes not linked to their hub are held against the rest of the hub's group, block against block;
    3. pairs that share lists across groups and are still apart are held against each other, until their components join.

    Full sets decide each time. A large group of copies costs one comparison per member, not one per pair, unless
    members are apart. Rows with no words (null, empty or white text) and rows with a null doc_id link with nothing
    and are kept; rows that share a doc_id are judged each by its own text."""
    signs = stored(signed(docs, size), "signatures")
    named = signs.filter("name IS NOT NULL AND doc_id IS NOT NULL")
    # Keys are given as the table is written, so they stay what they are.
    classes = stored(named.groupBy("name").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("coordinates").alias("coordinates"),
                                               F.any_value("minima").alias("minima")).select(
        "name", F.monotonically_increasing_id().alias("rep"), F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"),
        "coordinates", "minima"), "classes")
    lists = stored(posted(classes), "postings")
    hubs = lists.groupBy("token").agg(F.min("rep").alias("hub"))
    votes = lists.join(hubs, "token").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    members = stored(votes.groupBy("rep").agg(F.max_by("hub", F.when(F.col("hub") != F.col("rep"), F.struct("n", -F.col("hub")))).alias("g")).select(
        "rep", F.coalesce("g", "rep").alias("g")), "members")
    # A hub is of its own group, whatever other hub it was dealt to as well.
    dealt = stored(members.unionByName(members.select(F.col("g").alias("rep"), "g")).distinct(), "dealt")
    wanted = classes.join(dealt.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "text_hash")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts = stored(source.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("rep", "text"), "texts")

    first = stored(verified(dealt.filter("rep <> g").select(F.col("g").alias("a"), F.col("rep").alias("b")), texts, size, percent), "links")
    labelled = _labelled(dealt, components(first))
    labelled = _joined(labelled, within_groups(labelled, texts, size, percent))
    # Of a node in two groups either one will do: pairs inside both were held against each other.
    one = labelled.groupBy("rep").agg(F.min("g").alias("g"), F.min("component").alias("component"))
    joined = _joined(one, across_groups(lists, one, classes, texts, size, percent))
    least = joined.join(classes.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    told = joined.join(least, "component").select("rep", "component_id")
    found = classes.select("name", "rep", "doc_id").join(told, "rep", "left").select("name", F.coalesce("component_id", "doc_id").alias("component_id"))
    linked = named.select("doc_id", "text_hash", "n_shingles", "name").join(found, "name").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = signs.filter("name IS NULL OR doc_id IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labelled(dealt: DataFrame, joined: DataFrame) -> DataFrame:
    return stored(dealt.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "g", F.coalesce("component", "rep").alias("component")), "labelled")


def _joined(labelled: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of (rep, component) after further links (a, b). Only links between components are followed, not those that made them."""
    of = labelled.groupBy("rep").agg(F.min("component").alias("component"))
    ends = links.join(of.withColumnsRenamed({"rep": "a", "component": "u"}), "a").join(of.withColumnsRenamed({"rep": "b", "component": "v"}), "b")
    tops = components(stored(ends.select("u", "v").filter("u <> v").distinct(), "links"), "u", "v").withColumnsRenamed({"component": "top", "node": "component"})
    return stored(labelled.join(tops, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top"), "labelled")
