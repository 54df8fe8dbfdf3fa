"""Packing documents' tokens into sequences: bounded-space online best fit over bins in a bitset keyed by free space."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from triplicate.llm.common import map_batches, materialize, prepare, table, texts
from triplicate.llm.tokens import ByteEncoder

#: Full sequences that the pieces of one bucket would make, about.
GROUP = 8_192
#: Open bins at most; beyond it the fullest closes.
OPEN = 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit with at most ``bins`` open bins of ``size`` units.

    Bit f of ``free`` is set if an open bin has f units free, so the tightest bin for n units is the lowest set
    bit from n on, and the fullest bin is the lowest set bit of all.
    """

    def __init__(self, size: int, bins: int = OPEN) -> None:
        self.size, self.bins, self.open, self.free, self.made = size, bins, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, room: int) -> int:
        bins = self.by_free[room]
        bin_ = bins.pop()
        if not bins:
            self.free &= ~(1 << room)
        self.open -= 1
        return bin_

    def put(self, n: int) -> tuple[int, int]:
        """The bin and the offset in it where n units go, 1 <= n <= size."""
        fitting = self.free >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(room)
        else:
            room, bin_ = self.size, self.made
            self.made += 1
        if left := room - n:
            if self.open >= self.bins:
                self._take((self.free & -self.free).bit_length() - 1)
            self.by_free[left].append(bin_)
            self.free |= 1 << left
            self.open += 1
        return bin_, self.size - room


def best_fit(lengths: Iterable[int], size: int, bins: int = OPEN) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order they come."""
    packer = BestFit(size, bins)
    return [packer.put(n) for n in lengths]


def _cut(vocab: str, size: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = ByteEncoder(vocab)

        def step(batch: pa.RecordBatch) -> dict:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = memoryview(encoder.encode(text) + end)
                n = len(raw) // 4
                at = 0
                for piece in range(-(-n // size)):
                    to = at + ((n - 1) % size + 1 if piece == 0 else size)
                    rows.append((doc, piece, at, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                    at = to
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), zip(*rows, strict=True) if rows else [[]] * 5, strict=True))

        return step

    return make


def _packed(size: int, bins: int):
    """Packs what comes, run after run of one bucket, each into bins of its own; only the open bins are held."""
    schema = to_arrow_schema(StructType.fromDDL(f"{_PIECES}, sequence_id long, offset long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, packer = None, BestFit(size, bins)
        for batch in batches:
            sequence, offset = [], []
            for b, n in zip(batch.column("bucket").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if b != bucket:
                    bucket, packer = b, BestFit(size, bins)
                bin_, at = packer.put(n)
                sequence.append(b << 40 | bin_)
                offset.append(at)
            arrays = [batch.column(f.name) for f in list(schema)[:-2]] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def pack(
    docs: DataFrame, size: int = 2048, vocab: str = "byte_bpe_50k.json", end_id: int = 0, bins: int = OPEN, group: int = GROUP
) -> DataFrame:
    """Every document's tokens, each document ended by ``end_id``, in sequences of at most ``size`` tokens.

    Only documents longer than ``size`` are cut, the first piece taking the remainder. Pieces are dealt by hash
    into buckets of about ``group`` full sequences, whatever their source, and packed online, in the order in which
    they come: by hash of the document, whose pieces follow one another. A task holds ``bins`` open bins, however many
    pieces come; beyond that the fullest closes. Sequences are left part full where a bin closes early and by the bins
    open at a bucket's end: at most ``bins`` of each ``group``, so the waste does not grow with the corpus. Null texts
    count as empty (one token). Repeated rows are packed each for itself; an empty table gives no rows; further columns
    are not read. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    prepare(spark)
    pieces = materialize(map_batches(texts(docs), _cut(vocab, size, end_id), _PIECES))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    buckets = max(1, math.ceil(total / (size * group)))
    order = F.xxhash64("doc_id", F.lit(1))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).withColumn("turn", order)
    sorted_ = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "turn", "doc_id", "start", "piece", "ids_crc32")
    return sorted_.mapInArrow(_packed(size, bins), f"{_PIECES}, sequence_id long, offset long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
