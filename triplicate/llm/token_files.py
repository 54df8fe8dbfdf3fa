"""Token ids in Parquet files: list columns, dictionary or delta encoded, with small row groups and page indexes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplicate.llm.common import map_batches, prepare, shared_dir, table, texts
from triplicate.llm.tokens import ByteEncoder

#: How the files are laid out: the second format version encodes integers that outgrow the dictionary as deltas;
#: row groups and pages are small enough that the page index lets a reader of a few documents skip the rest.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
_FILE = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encode(vocab: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder, seen = ByteEncoder(vocab), 0
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def step(batch: pa.RecordBatch) -> dict:
            nonlocal seen
            ids = [encoder.encode(t) + end for t in batch.column("text").to_pylist()]
            sizes = np.array([len(i) // 4 for i in ids], np.int64)
            ends = np.cumsum(sizes)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            out = {
                "doc_id": batch.column("doc_id"),
                "part": np.full(len(ids), part, np.int32),
                "start_in_part": seen + ends - sizes,
                "n_tokens": sizes,
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values),
            }
            seen += int(ends[-1]) if len(ends) else 0
            return out

        return step

    return make


def write_tokens(docs: DataFrame, path: str, vocab: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode every text, append ``end_id``, and write the ids below ``path`` in ascending doc_id order.

    Documents are dealt out by ranges of doc_id and sorted by it within each file; files ascend in their part
    numbers. Null texts count as empty and give the end id alone. Rows that share a doc_id stand in the order of
    their texts. An empty table gives files without rows.
    """
    prepare(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ordered, _encode(vocab, end_id), _FILE).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids; ``ids`` selects documents.

    A selection reaches the scan, where row-group and page statistics of doc_id skip the rest; without the ids
    column only metadata is read.
    """
    files = spark.read.schema(_FILE).parquet(path)
    # One row for each file, so the running sum in one task and the broadcast are bounded by the number of files.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_file = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = per_file.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    wanted = files.where(F.col("doc_id").isin(ids)) if ids is not None else files
    joined = wanted.join(F.broadcast(before), "part")
    return joined.select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _digest():
    def step(batch: pa.RecordBatch) -> dict:
        ids = batch.column("ids")
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        at = ids.offsets.to_numpy()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": np.diff(at).astype(np.int64), "ids_crc32": crc}

    return step


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids, written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return map_batches(read_tokens(spark, path), _digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
