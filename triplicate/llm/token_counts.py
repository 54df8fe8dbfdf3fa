"""Token counts without token ids: lengths of frequent pre-tokens from a broadcast table, all others from worker caches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.llm.common import TwoGenerations, map_batches, mix, prepare, table, texts
from triplicate.llm.tokens import ByteEncoder

#: Pre-tokens in the broadcast table at most, and the longest, in bytes, that it holds: 2**17 slots of 18 bytes, 2.3 MB.
FREQUENT, LONGEST = 1 << 16, 16
#: Each batch of texts reports so many of its most frequent pre-tokens.
REPORTED = 2048
_SLOTS = 2 * FREQUENT
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _reported():
    def step(batch: pa.RecordBatch) -> dict:
        from collections import Counter

        seen: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(text.split(" ")[1:])
        most = [(w, n) for w, n in seen.most_common(REPORTED) if len(w.encode()) <= LONGEST]
        return {"piece": [w for w, _ in most], "n": [n for _, n in most]}

    return step


def frequent_pieces(docs: DataFrame, size: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of all texts, by the reports of each batch of texts.

    Only reports pass a shuffle, never pre-tokens themselves. Which pieces are found changes the speed, not the counts.
    """
    found = map_batches(texts(docs), lambda: _reported(), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in found.orderBy(F.desc("n"), "piece").limit(size).collect()]


def _packed(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of pieces of up to 16 bytes as two integers each; ``raw`` has 16 bytes to spare behind its last piece."""
    words = np.ndarray((len(raw) - 8,), "<u8", raw, strides=(1,))
    return words[start] & _LOW[np.minimum(size, 8)], words[start + 8] & _LOW[np.clip(size - 8, 0, 8)]


def _slot(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (mix(low + mix(high + size.astype(np.uint64))) % np.uint64(_SLOTS)).astype(np.int64)


class LengthTable:
    """An open-addressing hash table from short pieces to their numbers of tokens; pieces are compared whole, byte by byte."""

    def __init__(self, pieces: list[bytes], n_tokens: list[int]) -> None:
        self.low, self.high = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.uint64)
        self.size, self.n, self.probes = np.full(_SLOTS, 255, np.uint8), np.zeros(_SLOTS, np.uint8), 1
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces) + bytes(24), np.uint8)
        low, high = _packed(raw, np.cumsum(size) - size, size)
        for i, at in enumerate(_slot(low, high, size).tolist()):
            probes = 1
            while self.size[at] != 255:
                at, probes = (at + 1) % _SLOTS, probes + 1
            self.low[at], self.high[at], self.size[at], self.n[at] = low[i], high[i], size[i], n_tokens[i]
            self.probes = max(self.probes, probes)

    def find(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each piece, -1 where the table has none."""
        out = np.full(len(start), -1, np.int64)
        left = np.flatnonzero(size <= LONGEST)
        low, high = _packed(raw, start[left], size[left])
        at = _slot(low, high, size[left])
        for _ in range(self.probes):
            hit = (self.low[at] == low) & (self.high[at] == high) & (self.size[at] == size[left])
            out[left[hit]] = self.n[at[hit]]
            on = ~hit & (self.size[at] != 255)  # an empty slot ends the search
            left, low, high, at = left[on], low[on], high[on], (at[on] + 1) % _SLOTS
        return out


class TokenCounter(ByteEncoder):
    """Numbers of tokens of whole texts, a batch at a time."""

    def __init__(self, name: str, known: LengthTable, kept: int = 250_000) -> None:
        super().__init__(name)
        self.known, self.cache = known, TwoGenerations(kept)

    def _miss(self, piece: bytes) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.cache.old.get(piece) or len(self._ids(" " + piece.decode())) // 4
            if len(piece) <= 64:
                self.cache[piece] = n
        return n

    def count(self, column: list[str]) -> np.ndarray:
        """Pieces between spaces through the table and the cache; texts whose pieces depend on one another through the library."""
        out = np.zeros(len(column), np.int64)
        plain = [i for i, t in enumerate(column) if not self.whole(t)]
        for i in set(range(len(column))).difference(plain):
            out[i] = len(self.tokenizer.encode(column[i], add_special_tokens=False).ids)
        parts = [column[i].encode() for i in plain]
        data = b"".join(parts)
        size = np.array([len(p) for p in parts], np.int64)
        raw = np.frombuffer(data + bytes(24), np.uint8)
        space = np.flatnonzero(raw[: len(data)] == 32)
        ends = np.cumsum(size)
        owner = np.searchsorted(ends, space, "right")
        after = np.concatenate((space[1:], [len(data)]))[: len(space)]
        n_bytes = np.minimum(after, ends[owner]) - space - 1
        n = self.known.find(raw, space + 1, n_bytes)
        for i in np.flatnonzero(n < 0).tolist():
            at = int(space[i]) + 1
            n[i] = self._miss(data[at : at + int(n_bytes[i])])
        self.cache.make_room()
        total = np.bincount(owner, n, len(parts)).astype(np.int64) if len(parts) else np.zeros(0, np.int64)
        first = [len(self._ids(column[i].split(" ", 1)[0])) // 4 for i in plain]
        out[plain] = total + np.array(first, np.int64)
        return out


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", limit: int = 1024, size: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every whole text.

    A null text counts as empty and has no tokens; a text of any length is counted whole; repeated rows are counted each for
    itself; an empty table gives no rows; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = frequent_pieces(docs, size)
    encoder = ByteEncoder(vocab)
    known = spark.sparkContext.broadcast(LengthTable([p.encode() for p in pieces], [len(encoder._ids(" " + p)) // 4 for p in pieces]))

    def make():
        counter = TokenCounter(vocab, known.value)

        def step(batch: pa.RecordBatch) -> dict:
            column = batch.column("text").to_pylist()
            n = counter.count(column)
            n_bytes = [len(t.encode()) for t in column]
            return {"doc_id": batch.column("doc_id"), "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit}

        return step

    return map_batches(texts(docs), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents: doc_id, n_bytes, n_tokens, over_limit (see ``count_tokens``)."""
    return count_tokens(table(spark, sf_dir, "documents"))
