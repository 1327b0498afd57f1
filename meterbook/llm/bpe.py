"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a piece has one encoding, so it has one last token. An automaton
over the vocabulary gives the tokens ending at each position; the one that is
compatible with the last token before it is stored, and the back-pointers from the
end give the ids. Two tokens are compatible if no merge across their border would
have come before the merges that built them.

Defined cases: a null or empty text has no tokens and decodes to the empty text.
Repeated documents each get their own row. Added tokens of the file are matched in
the text first, as the file's library does. A file with a normalizer or another
pre-tokenizer is refused.
"""

import hashlib
import json
import re
import sys
import unicodedata
from itertools import chain, groupby

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import annotate, prepare, text_udf, worker_cache

#: Bytes of pieces and number of token pairs (about 120 bytes each) that a worker keeps; beyond, it starts afresh.
PIECE_BYTES, PAIR_CACHE = 64 << 20, 200_000
#: A pair's key holds a token in so many bits.
ID_BITS = 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def piece_pattern(letters_below: int) -> re.Pattern:
    """How the byte-level pre-tokenizer splits a text of code points below a bound.

    Fixed value: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    The classes are written out as ranges, so that Latin-1 texts get small ones.
    """
    ranges: dict[str, list[str]] = {"L": [], "N": []}
    for kind, run in groupby(range(letters_below), lambda c: unicodedata.category(chr(c))[0]):
        if kind in ranges:
            first, *rest = run
            ranges[kind].append(f"\\U{first:08x}-\\U{(rest or [first])[-1]:08x}")
    letter, number = "".join(ranges["L"]), "".join(ranges["N"])
    space = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return re.compile(
        f" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.bytes = encode, 0

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        size = 240 + 4 * len(piece) + 8 * len(ids)  # the text, the tuple and their place in the table
        if self.bytes + size > PIECE_BYTES:
            self.clear()
            self.bytes = 0
            if size > PIECE_BYTES:
                return ids
        self.bytes += size
        self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        if model["type"] != "BPE" or spec["normalizer"] or not plain or odd:
            raise ValueError("only plain byte-level BPE files can be read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with strip or word rules are not supported")
        vocab: dict[str, int] = model["vocab"]
        if max(vocab.values()) >> ID_BITS:
            raise ValueError("the vocabulary has too many ids")
        letters = byte_letters()
        self.to_letters = {i: c for i, c in enumerate(letters)}
        value = {c: b for b, c in enumerate(letters)}
        self.text = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            self.parts.setdefault(made, (a, b, rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.parts:
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        if not all(c in vocab for c in letters):
            raise ValueError("the vocabulary lacks a byte")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: s.encode() for s, i in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.splitter = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.latin, self.wide = piece_pattern(256), piece_pattern(sys.maxunicode + 1)
        self.names = list(map(str, range(max(self.text) + 1)))
        self.known = _Pieces(self._piece)
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """Tokens at one edge while ``token`` was built: (token, made at, merged at)."""
        out, until = [], float("inf")
        while True:
            parts = self.parts.get(token)
            made = parts[2] if parts else -1
            out.append((token, made, until))
            if parts is None:
                return out
            token, until = parts[side], made

    def compatible(self, a: int, b: int) -> bool:
        """Whether the border between two neighbouring tokens outlasts every merge.

        A merge across it happens at its rank if both edge tokens exist by then and
        neither was merged before. Of equal merges the leftmost goes first, so one
        inside ``a`` at that rank precedes it and one inside ``b`` does not.
        """
        rank, right = self.rank, self._edge(b, 0)
        return not any(
            m is not None and made < m < until and made_b < m <= until_b
            for x, made, until in self._edge(a, 1)
            for y, made_b, until_b in right
            for m in (rank.get((x, y)),)
        )

    def _piece(self, piece: str) -> tuple[int, ...]:
        mapped = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_letters)
        n = len(mapped)
        last = [-1] * n  # by the prefix's last position: its last token, and where that begins
        back = [0] * n
        pairs = self.pairs
        if len(pairs) >= PAIR_CACHE:
            pairs.clear()
        for end, (token, size) in self.automaton.iter(mapped):
            if last[end] >= 0:
                continue
            before = end - size
            if before >= 0:
                key = last[before] << ID_BITS | token
                holds = pairs.get(key)
                if holds is None:
                    holds = pairs[key] = self.compatible(last[before], token)
                if not holds:
                    continue
            last[end], back[end] = token, before
        out, end = [], n - 1
        while end >= 0:
            out.append(last[end])
            end = back[end]
        out.reverse()
        return tuple(out)

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(text)
        return self.latin.findall(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known = self.known.__getitem__
        if self.splitter is None or not self.splitter.search(text):
            return list(chain.from_iterable(map(known, self._pieces(text))))
        out: list[int] = []
        for part in self.splitter.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                out.extend(chain.from_iterable(map(known, self._pieces(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """Ids the file does not have are left out."""
        try:
            return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return self.decode([i for i in ids if i in self.text])


@worker_cache
def _bpe(file: Broadcast) -> Bpe:
    return Bpe(file.value)


def load(spark, path: str) -> Broadcast:
    """The tokenizer file, read by the driver and sent to every worker.

    Its size is bounded by the vocabulary, not by the data.
    """
    prepare(spark)
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _digest(bpe: Bpe):
    def work(text: str | None) -> tuple[int, str, str]:
        ids = bpe.encode(text)
        decoded = bpe.decode(ids).encode("utf-8", "surrogatepass")
        return len(ids), hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return work


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded, and only digests kept."""
    file = load(docs.sparkSession, path)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return annotate(docs, text_udf(schema, lambda: _digest(_bpe(file))))


def _tokens(bpe: Bpe):
    def work(text: str | None) -> tuple[list[int], str]:
        ids = bpe.encode(text)
        return ids, hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()

    return work


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids array<int> and the decoded text's decoded_sha256."""
    file = load(docs.sparkSession, path)
    found = annotate(docs, text_udf("ids array<int>, decoded_sha256 string", lambda: _tokens(_bpe(file))))
    return found.selectExpr("doc_id", "cast(size(ids) as bigint) AS n_tokens", "ids", "decoded_sha256")
