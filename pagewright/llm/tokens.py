"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import cache

import numpy as np

from pagewright.llm.common import kept

#: Fixed value: how the byte-level tokenizer files cut a text before they merge.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Kept(dict):
    """Encoded pieces met lately: two generations of at most `most` each, so frequent ones stay."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.before = encode, most, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        found = self.before.get(text)
        if found is None:
            found = self.encode(text)
        self[text] = found
        return found


def _ranges(member) -> str:
    """The inside of a character class: the basic plane's characters of a kind."""
    found = [c for c in range(0x10000) if member(chr(c))]
    firsts, lasts = sorted(set(found) - {c + 1 for c in found}), sorted(set(found) - {c - 1 for c in found})
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(firsts, lasts))


@cache
def _classes() -> dict[str, str]:
    """Letters, numbers and the rest but white space in the standard library's patterns, for texts without _odd() characters.

    Written out, a class is one look into a table for each character; `[^\\W\\d_]` asks for three properties of it."""
    letter = f"[{_ranges(lambda c: c.isalnum() and not c.isdecimal())}]"
    rest = f"[{_ranges(lambda c: not c.isalnum() and not c.isspace())}]"
    return {r"[^\s\p{L}\p{N}]": rest, r"[\p{L}]": letter, r"[\p{N}]": r"\d", r"\p{L}": letter, r"\p{N}": r"\d"}


@cache
def _odd():
    """Finds numbers that are no decimal digits, and separators that only Python calls white space.

    Of the rare characters beyond the basic plane it finds all: a set of those would be searched one by one."""
    found = "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl"))
    return re.compile(f"[\x1c-\x1f{found}]|[\U00010000-\U0010ffff]").search


def _cutter(pattern: str):
    for name, found in _classes().items():
        pattern = pattern.replace(name, found)
    return re.compile(pattern).findall


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Encoder:
    """Ids of texts by the tokenizers library, whose model is asked once for each piece met lately.

    A text is cut by the file's own pattern; no merge crosses a cut, so the ids of the pieces in order are the
    ids of the text. Texts for which cutting first could differ (special tokens, characters
    that the two libraries class differently, letters that the file's normalizer would compose or lower by another rule) go to the
    library whole. Memory is bounded by `most`."""

    def __init__(self, path: str, most: int = 450_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.special = [t["content"] for t in told["added_tokens"]]
        normalizer, first = told.get("normalizer"), told["pre_tokenizer"]
        self.lowers = normalizer is not None
        if self.lowers:
            first = first["pretokenizers"][0]
            if [n["type"] for n in normalizer.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"] or first["type"] != "Split":
                raise ValueError(f"{path}: an unknown normalizer")
            self.cut = _cutter(first["pattern"]["Regex"])
        else:
            if first["type"] != "ByteLevel" or first.get("add_prefix_space"):
                raise ValueError(f"{path}: an unknown cut")
            self.cut = _cutter(BYTE_PATTERN)
        self.letters = _byte_letters()
        self.pieces = _Kept(self._piece, most)

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        spelt = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])

    def ids(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        if any(s in text for s in self.special) or _odd()(text):
            return self.direct(text)
        if self.lowers:
            if not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)):
                return self.direct(text)
            text = text.lower()
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


def shared_encoder(path: str, most: int = 450_000) -> Encoder:
    """One per worker process: it outlives a task, and so do the pieces it remembers, until another operator's memory is kept."""
    return kept(("encoder", path, most), lambda: Encoder(path, most))
