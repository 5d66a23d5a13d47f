"""Byte-pair encoding and decoding with word ends, exact and linear in the length of a word.

The tokenizer file's own rules: NFC, runs of white space to one space, lower case, pieces by pattern, bytes as printable
characters, merges inside a piece whose last unit carries the end mark. Special tokens in a text are found first, as they are.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import cache

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .text import per_text, text_of

_BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROLS, _BLANK = re.compile("[\x1c-\x1f]"), re.compile(f"[{_BLANKS}]+")
# Characters that the tokenizers library's tables have beyond Python's own.
_LETTERS = (
    "\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
    "\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0"
    "\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0")
_NUMBERS = (
    "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79"
    "\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa")
_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}, 0x3A3: 0x3C3}
_RARE = re.compile("[" + "".join(map(chr, _LOWER)) + "]")


@cache
def character_class(major: str) -> str:
    """Ranges of the characters whose general category begins with ``major`` (L or N), for a regular expression."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == major
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out) + (_LETTERS if major == "L" else _NUMBERS)


def lowered(text: str) -> str:
    """Lower case character by character: a sigma at a word's end has no form of its own."""
    return (text.translate(_LOWER) if _RARE.search(text) else text).lower()


CACHED = 500_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, members in ((r"\p{L}", character_class("L")), (r"\p{N}", character_class("N")), (r"\s", _BLANKS)):
            pattern = pattern.replace(name, members)
        self.pieces = re.compile(pattern)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        chars = byte_characters()
        # Units: a byte inside a piece is chr(b), the last byte chr(256 + b). Tokens become strings of units.
        self.unit_id = [vocab[c] for c in chars] + [vocab[c + self.end] for c in chars]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.text_of = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.text_of[i] = t
        # Rank of a token: units first, then merges in order. Everything below works on ranks.
        self.id_of, rank_of = list(self.unit_id), {}
        for u, i in enumerate(self.unit_id):
            rank_of[i] = u
        self.split: list[tuple[int, int]] = [(u, u) for u in range(512)]
        self.merged: dict[int, int] = {}
        units = [chr(u) for u in range(512)]
        for left, right in (m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            a, b = rank_of[vocab[left]], rank_of[vocab[right]]
            made = len(self.id_of)
            rank_of.setdefault(vocab[left + right], made)
            self.merged.setdefault(a << 20 | b, made)
            self.split.append((a, b))
            self.id_of.append(vocab[left + right])
            units.append(units[a] + units[b])
        self.length = [len(u) for u in units]
        self.machine = ahocorasick.Automaton()
        for r in range(len(units) - 1, -1, -1):  # of two ways to one string, the earlier merge counts
            self.machine.add_word(units[r], r)
        self.machine.make_automaton()
        self.shorter = self._prefixes(units)
        self.fits: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        # Decoding: all token texts in one buffer, and where each begins.
        parts = [t.encode() for t in self.text_of]
        self.offsets = np.cumsum([0] + [len(p) for p in parts]).tolist()
        self.buffer = b"".join(parts)
        self.decimal = [str(i) for i in range(size)]

    def _prefixes(self, units: list[str]) -> list[int]:
        """For each token, the longest other token that begins it; -1 if none."""
        rank, out = {u: r for r, u in reversed(list(enumerate(units)))}, []
        for u in units:
            n = len(u) - 1
            while n and u[:n] not in rank:
                n -= 1
            out.append(rank[u[:n]] if n else -1)
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging, applied to the text of both, gives just these two tokens. Answers are kept in a table."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit, merged, split = 1 << 30, self.merged, self.split
        while True:
            if merged.get(a << 20 | b, limit) < limit:
                return False  # the two ends that meet here would have merged before
            if a > b:
                limit, a = a, split[a][1]
                if a == limit:
                    limit, b = b + 1, split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, split[b][0]
                if b + 1 == limit:
                    limit, a = a, split[a][1]
                    if a == limit:
                        return True

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece. Longest matches first; where neighbours don't fit, shorter ones or one step back."""
        data = piece.encode("utf-8", "surrogatepass")
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        n, longest, length = len(text), [-1] * len(text), self.length
        for end, r in self.machine.iter(text):
            longest[end - length[r] + 1] = r  # matches come by end, so the last is the longest
        open_at, out, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0]
        shorter, compatible = self.shorter, self.compatible
        while at < n:
            while True:
                end = at + length[token]
                if open_at[end] and (not out or compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[end] if end < n else -1
                    break
                token = shorter[token]
                if token < 0:
                    open_at[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
        return [self.id_of[r] for r in out]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of the pieces of a run without white space, two bytes each; kept while common (two generations)."""
        found = self.old.get(chunk)
        if found is None:
            found = b"".join([self._piece(p) for p in self.pieces.findall(chunk)])
        if len(chunk) <= 64:
            if len(self.young) >= CACHED // 2:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = array("I", self.encode_piece(piece)).tobytes()
            if len(piece) <= 64:
                if len(self.known) >= CACHED // 2:
                    self.known.clear()
                self.known[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        parts, out = self.specials.split(text) if self.specials else [text], []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                continue
            part = lowered(unicodedata.normalize("NFC", part))
            blank = _CONTROLS.search(part)
            for chunk in (c for c in _BLANK.split(part) if c) if blank else part.split():
                found = self.young.get(chunk)
                out.append(self._chunk(chunk) if found is None else found)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def token(self, i: int) -> bytes:
        return self.buffer[self.offsets[i]:self.offsets[i + 1]]

    def decode(self, ids) -> str:
        """The tokens' texts, looked up by offset, joined by a space (the file names no decoder)."""
        known = {i: self.token(i) for i in set(ids)}
        return b" ".join([known[i] for i in ids]).decode()


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One encoder per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_column(text: Column, path: str, spark) -> Column:
    """Struct of ids (array of int) and decoded (string) for each text."""
    def make():
        bpe = loaded(path)

        def body(texts):
            ids = [bpe.encode(t) for t in texts]
            return {"ids": ids, "decoded": [bpe.decode(x.tolist()) for x in ids]}
        return body

    return per_text(text, make, "struct<ids:array<int>,decoded:string>", spark)


def digest_column(text: Column, path: str, spark, with_ids: bool = False) -> Column:
    """Struct of n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids; else only digests leave the Python worker."""
    def make():
        import hashlib

        bpe = loaded(path)
        decimal = bpe.decimal

        def body(texts):
            n, a, b, kept = [], [], [], []
            for t in texts:
                found = bpe.encode(t)
                ids = found.tolist()
                if with_ids:
                    kept.append(found)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return {"n_tokens": n, "ids_sha256": a, "decoded_sha256": b, "ids": kept}
        return body

    more = ",ids:array<int>" if with_ids else ""
    return per_text(text, make, f"struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string{more}>", spark)


def bpe_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
    ids: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, ids and decoded text, or with ``digests`` the number of tokens and both SHA-256 (with ``ids``, the ids
    too); and ``carry``.

    A null or empty text has no tokens and decodes to an empty text. Repeated rows and null ids are encoded one by one.
    ``path`` must be readable on the executors: the tokenizer is part of their installation. No exchange.
    """
    text, spark = text_of(text_col), docs.sparkSession
    made = (digest_column(text, path, spark, ids) if digests else encode_column(text, path, spark)).alias("__made")
    rest = [F.col(c).alias(f"__rest_{c}") for c in carry]
    out = docs.select(F.col(id_col).alias("__id"), made, *rest)
    return out.select(F.col("__id").alias(id_col), "__made.*", *[F.col(f"__rest_{c}").alias(c) for c in carry])
