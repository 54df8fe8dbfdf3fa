"""Shared plumbing: reading tables, the shared scratch folder, Arrow batches, word boundaries."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch sent to a Python worker; bounds a worker's memory whatever the length of texts.
BATCH_BYTES = 2 << 20
#: Rows of such a batch at most.
BATCH_ROWS = 4096


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where unset and all is on one machine (tests)
    a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scratch-"))
    return named or sc.getCheckpointDir()


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than this share of all rows, one in so many, are joined apart; fewer rows than ``FREQUENT`` are no harm.
SHARE, FREQUENT = 200, 1000


def join_hot(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row for each value of ``keys`` and in ``n`` how many of ``rows`` have it.

    Values that hold more than one in ``SHARE`` of the ``total`` rows, fewer than ``SHARE`` of them therefore, are
    broadcast, so their rows stay where they are; all others are joined by shuffle. Both inputs are read twice.
    """
    if total <= FREQUENT:
        return rows.join(lookup.drop(n), keys, how)
    bound = max(FREQUENT, total // SHARE)
    hot, cold = lookup.where(F.col(n) > bound), lookup.where(F.col(n) <= bound)
    apart = rows.join(F.broadcast(hot.drop(n)), keys)
    return apart.unionByName(rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.drop(n), keys, how))


def texts(df: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; further columns, whatever their names, go."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def plainly_named(df: DataFrame) -> DataFrame:
    """All columns but doc_id and text under names without odd signs, for what looks columns up by name."""
    return df.toDF(*[c if c in ("doc_id", "text") else f"c{i}_" for i, c in enumerate(df.columns)])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a state per task: ``make()`` gives the function from a batch to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            out = step(batch)
            yield pa.RecordBatch.from_arrays(
                [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, fields)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of a batch at once: the bytes, each word's start and end, each text's first word.

    The last array has one entry more than there are texts.
    """
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True  # a text's end parts words as a space does
    part = ~_SPACE[raw]
    before = np.concatenate(([False], part))
    after = np.concatenate((part, [False]))
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    keep = start >= offsets[0]
    start, end = start[keep], end[end > offsets[0]]
    return raw, start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(pow(base, len(out), 1 << 64))))
    return out[:n]


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial modulo 2**64, scrambled with the word's length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = int(end[-1])
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(raw[:n].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    value = (total[end] - total[start]) * _powers(inverse, int(start[-1]) + 1)[start]
    return mix(value + mix((end - start).astype(np.uint64)))


class TwoGenerations(dict):
    """A dict that is a bounded cache: beyond ``size`` entries the older half is forgotten."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def make_room(self) -> None:
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
