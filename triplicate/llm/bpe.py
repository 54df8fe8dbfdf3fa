"""Byte-pair encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from triplicate.llm.common import TwoGenerations, map_batches, prepare, table, texts
from triplicate.llm.tokens import byte_letters, load, vocabulary

_NONE = 1 << 60
#: What the vocabulary's pattern of pieces splits on, and white space as it knows it.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_CONTROL = regex.compile(r"[\x1c-\x1f]")
#: Texts in these letters are normalized the same way by Python as by the library.
_PLAIN = regex.compile(r"[\x00-\u024f]*")
_LONGEST_KEPT = 64
_KEPT = 250_000


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols, the lowest rank first and the leftmost of equals, until no pair has a rank.

    ``pairs`` maps ``a << 32 | b`` to (rank, merged symbol). Leaf i of the tree holds the rank of the pair that
    starts at symbol i with i below it, so the root is the leftmost lowest-rank pair; a merge changes three leaves,
    each a logarithmic update.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = symbols[:]
    leaves = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * leaves)
    get = pairs.get
    for i in range(n - 1):
        if p := get(symbols[i] << 32 | symbols[i + 1]):
            tree[leaves + i] = p[0] << 32 | i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = leaves + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:
                return
            tree[k] = value

    while (root := tree[1]) != _NONE:
        i = root & 0xFFFFFFFF
        j = following[i]
        symbols[i] = get(symbols[i] << 32 | symbols[j])[1]
        symbols[j] = -1
        following[i] = k = following[j]
        put(j, _NONE)
        if k < n:
            before[k] = i
            p = get(symbols[i] << 32 | symbols[k])
            put(i, p[0] << 32 | i if p else _NONE)
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            p = get(symbols[h] << 32 | symbols[i])
            put(h, p[0] << 32 | h if p else _NONE)
    return [s for s in symbols if s >= 0]


class WordEncoder:
    """Encodes and decodes with a word-level byte-pair vocabulary (lower case, white space dropped, word ends marked)."""

    def __init__(self, name: str) -> None:
        with open(vocabulary(name), encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + suffix] for c in letters]
        self.pairs = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.token = {i: t for t, i in (vocab | self.special).items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.library = load(name)  # for normalization and pieces of rare scripts
        self.pieces, self.chunks = TwoGenerations(_KEPT), TwoGenerations(_KEPT)

    def _piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of lower-case text."""
        if (ids := self.pieces.get(piece)) is None:
            if (ids := self.pieces.old.get(piece)) is None:
                raw = piece.encode()
                ids = tuple(merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]], self.pairs))
            if len(piece) <= _LONGEST_KEPT:
                self.pieces[piece] = ids
                self.pieces.make_room()
        return ids

    def _cut(self, chunk: str) -> list[str]:
        if _PLAIN.fullmatch(chunk) and unicodedata.is_normalized("NFC", chunk):
            return _PIECE.findall(chunk.lower())
        byte = {c: b for b, c in enumerate(byte_letters())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
        return [bytes(byte[c] for c in p).decode() for p, _ in pieces]

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids and tokens of what stands between white space."""
        ids = [i for piece in self._cut(chunk) for i in self._piece(piece)]
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.token.__getitem__, ids))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text that decoding them gives: tokens joined by spaces."""
        ids: list[bytes] = []
        tokens: list[str] = []
        for part in self.split.split(text) if "<|" in text else [text]:
            if part in self.special:
                ids.append(np.array([self.special[part]], "<u4").tobytes())
                tokens.append(part)
                continue
            for chunk in part.split() if not _CONTROL.search(part) else _SPACES.split(part):
                found = self.chunks.get(chunk)
                if found is None:
                    found = self.chunks.old.get(chunk) or self._chunk(chunk)
                    if len(chunk) <= _LONGEST_KEPT:
                        self.chunks[chunk] = found
                        self.chunks.make_room()
                ids.append(found[0])
                if found[1]:
                    tokens.append(found[1])
        return b"".join(ids), " ".join(tokens)


def _encode(vocab: str):
    def make():
        encoder = WordEncoder(vocab)

        def step(batch: pa.RecordBatch) -> dict:
            done = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "ids": [i for i, _ in done], "decoded": [t for _, t in done]}

        return step

    return make


def encode_decode(docs: DataFrame, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded text of every whole text.

    Null and empty texts give no ids and an empty decoded text; repeated rows give repeated rows. One pass, no
    shuffle; each task keeps the ids of the chunks it met last.
    """
    prepare(docs.sparkSession)
    return map_batches(texts(docs), _encode(vocab), "doc_id long, ids binary, decoded string")


def _digests(vocab: str):
    def make():
        encoder = WordEncoder(vocab)

        def step(batch: pa.RecordBatch) -> dict:
            rows = []
            for t in batch.column("text").to_pylist():
                ids, decoded = encoder.encode(t)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ([], [], [])
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return step

    return make


def op4_bpe_segment_tree(spark: SparkSession, sf_dir: str, vocab: str = "word_bpe_49k.json") -> DataFrame:
    """Digests of every document's ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and decoded texts are digested where they are made, so they do not pass between Python and Spark.
    """
    prepare(spark)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(texts(table(spark, sf_dir, "documents")), _digests(vocab), schema)
