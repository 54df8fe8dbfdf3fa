"""Tables that are kept by key and renewed in parts: all rows of some keys are replaced, and nothing else is touched.

A table is partitioned into buckets of its key. A change rewrites the buckets of its keys alone, through Spark's dynamic
overwrite of partitions, so doing it again leaves the same rows, and a failure half way is mended by doing it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from triplicate.sources.scratch import cut

#: Buckets of a table, where nothing else is said. A thousandth of the table's gigabytes or more keeps buckets handy.
BUCKETS = 64
_BUCKET, _MARK = "bucket_", "mark_"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, by: str, **options: str) -> None:
    # Rows go to one task for each bucket, large ones to several.
    rows.hint("rebalance", by).write.mode("overwrite").options(partitionOverwriteMode="dynamic", **options).partitionBy(by).parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _buckets_of(keys: DataFrame, key: str, buckets: int) -> list[int]:
    return sorted(r[0] for r in keys.select(_bucket(key, buckets).alias("b")).distinct().collect())  # no more than there are buckets


def replace_keys(path: str, key: str, touched: DataFrame, fresh: DataFrame, buckets: int = BUCKETS) -> None:
    """Rows of the touched keys are those of ``fresh`` from now on, others stay; keys without fresh rows lose theirs.

    ``touched`` has a column ``key`` (repeats and nulls do no harm); rows of ``fresh`` with other keys are not written. A
    table that isn't there is begun. ``buckets`` has to be the same each time.
    """
    keys = cut(touched.select(key).distinct())
    numbers = _buckets_of(keys, key, buckets)
    if not numbers:
        return
    fresh = cut(fresh.alias("f").join(keys.alias("k"), F.col(f"f.{key}").eqNullSafe(F.col(f"k.{key}")), "left_semi"))
    rows = fresh.withColumns({_BUCKET: _bucket(key, buckets), _MARK: F.lit(False)})
    before = _existing(fresh.sparkSession, path)
    if before is not None:
        other = before.where(F.col(_BUCKET).isin(numbers) & ~F.col(_MARK)).alias("f")
        rows = rows.unionByName(other.join(keys.alias("k"), F.col(f"f.{key}").eqNullSafe(F.col(f"k.{key}")), "left_anti").select(*rows.columns))
    # A bucket that ends up empty is written too, else its old rows would stay: each has a row that marks it.
    marks = fresh.sparkSession.createDataFrame([(n, True) for n in numbers], f"{_BUCKET} int, {_MARK} boolean")
    _write(rows.unionByName(marks, allowMissingColumns=True), path, _BUCKET)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a table."""
    return spark.read.parquet(path).where(~F.col(_MARK)).drop(_BUCKET, _MARK)


def rows_of(path: str, key: str, touched: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The touched keys' rows; only their buckets are read."""
    keys = touched.select(key).distinct()
    mine = touched.sparkSession.read.parquet(path).where(F.col(_BUCKET).isin(_buckets_of(keys, key, buckets)) & ~F.col(_MARK))
    return mine.alias("f").join(keys.alias("k"), F.col(f"f.{key}").eqNullSafe(F.col(f"k.{key}")), "left_semi").drop(_BUCKET, _MARK)


def append_once(path: str, batch_id: int, rows: DataFrame) -> None:
    """Rows of one batch added to a log; the same batch again takes the place of itself."""
    _write(rows.withColumn("batch", F.lit(batch_id)), path, "batch")


def renew_by_stream(
    changes: DataFrame, key: str, renewed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, log: str | None = None, logged: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS
) -> StreamingQuery:
    """Renews the keys of each micro-batch of ``changes`` as ``renewed(batch)`` gives them, and logs ``logged(batch)`` once.

    All that has arrived is taken, then the stream ends; the next start goes on from its checkpoint. A batch that is run
    again after a failure leaves what it would have left.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        replace_keys(path, key, batch, renewed(batch), buckets)
        if log and logged:
            append_once(log, batch_id, logged(batch))

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
