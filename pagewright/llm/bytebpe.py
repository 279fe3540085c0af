"""Byte-level BPE by a rank file: texts to token ids and back, merging with a segment tree over byte positions.

A piece of a text (one match of the pattern; no merge crosses its ends) is merged on its own. The leaves of a tree
belong to the byte positions of the piece; a leaf holds the rank of the token pair that starts there, the root the least
rank and of equal ranks the leftmost. A merge reads the root and sets three leaves: the pair that begins at the merged
token, the pair of its left neighbour, and the position that is no token's start any more. So a piece of n bytes takes
n log n steps, whatever it looks like.
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from pagewright.llm.common import batches_of
from pagewright.llm.tokens import _cutter, _odd

#: Ids of this many short pieces are remembered per worker, twice over; longer pieces are merged every time.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 48
_NO_PAIR = 1 << 62


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Rank (and id) of each token of a rank file: lines of a base64 token and a number."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. A piece that is a token itself is that token, as the tiktoken library has it."""
    get, n = ranks.get, len(piece)
    whole = get(piece)
    if whole is not None:
        return [whole]
    size = 1 << max(n - 2, 0).bit_length()     # leaves: a pair may start at any byte but the last
    tree = [_NO_PAIR] * (2 * size)
    stop = list(range(1, n + 1))               # of the token that starts here
    before = list(range(-1, n))                # start of the token in front
    for at in range(n - 1):
        rank = get(piece[at:at + 2])
        if rank is not None:
            tree[size + at] = rank * size + at
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    while (least := tree[1]) != _NO_PAIR:
        at = least & (size - 1)
        gone = stop[at]
        after = stop[at] = stop[gone]
        before[after] = at
        # Three leaves change: of the merged token, of its left neighbour, and of the position that is no start any more.
        own = beside = _NO_PAIR
        if after < n:
            rank = get(piece[at:stop[after]])
            if rank is not None:
                own = rank * size + at
        left = before[at]
        if left >= 0:
            rank = get(piece[left:after])
            if rank is not None:
                beside = rank * size + left
        for leaf, key in ((at, own), (left, beside), (gone, _NO_PAIR)):
            k = size + leaf
            if leaf < 0 or leaf >= size or tree[k] == key:
                continue
            tree[k] = key
            while k > 1:
                other = tree[k ^ 1]
                if other < key:
                    key = other
                k >>= 1
                if tree[k] == key:
                    break
                tree[k] = key
    found, at = [], 0
    while at < n:
        found.append(ranks[piece[at:stop[at]]])
        at = stop[at]
    return found


class ByteEncoder(dict):
    """Ids of whole texts; as a dict it remembers the packed ids of short pieces met lately, in two generations."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        super().__init__()
        self.ranks, self.most, self.older = load_ranks(path), remembered, {}
        self.cut = _cutter(pattern)
        self.cut_any = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = b"".join([i.to_bytes(4, "little") for i in merged(piece.encode("utf-8", "replace"), self.ranks)])
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def ids(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        # The standard library cuts faster, and alike but for a few numbers and separators.
        pieces = (self.cut_any if _odd()(text) else self.cut)(text)
        return b"".join(map(self.__getitem__, pieces))


@cache
def _encoder(path: str, pattern: str) -> ByteEncoder:
    """One per worker process, so that what it remembers outlives a task."""
    return ByteEncoder(path, pattern)


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id; an id without a token stands for none."""
    ranks = load_ranks(path)
    found = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, number in ranks.items():
        found[number] = token
    return found


def _id_type(df: DataFrame, name: str) -> tuple[T.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[name].dataType
    return kind, to_arrow_type(kind)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary) for every row: the ids of the whole text, little-endian unsigned 32-bit.

    `path` is a rank file, `pattern` cuts texts into pieces; there are no special tokens. A null or empty text has
    no ids. Rows are judged one by one, so null and repeated doc_ids stay as they are and further columns are left
    behind. Nothing is shuffled; a text is one worker's, and a worker holds one text, its ids and the pieces it remembers."""
    kind, arrow = _id_type(docs, doc_id)
    schema = pa.schema([("doc_id", arrow), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def kernel(batches):
        encoder = _encoder(path, pattern)

        def rows():
            for batch in batches:
                for key, value in zip(batch.column(0), batch.column(1)):
                    ids = encoder.ids(value.as_py())
                    yield {"doc_id": key.as_py(), "n_tokens": len(ids) // 4, "ids": ids}

        return batches_of(rows(), schema)

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(doc_id, text).mapInArrow(kernel, out)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded binary): the bytes that the ids stand for, joined. Null ids give null.

    Ids outside the file raise an IndexError; `decoded` of what `encode` made is the text's UTF-8."""
    kind, arrow = _id_type(tokens, "doc_id")
    schema = pa.schema([("doc_id", arrow), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def kernel(batches):
        import numpy as np

        table = token_bytes(path)

        def rows():
            for batch in batches:
                for key, count, packed in zip(*batch.columns):
                    ids = packed.as_py()
                    joined = None if ids is None else b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
                    yield {"doc_id": key.as_py(), "n_tokens": count.as_py(), "ids": ids, "decoded": joined}

        return batches_of(rows(), schema)

    out = T.StructType([T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()),
                        T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(kernel, out)
