"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is absent, as in tests, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if named is None and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, for what several later stages use.

    It is then computed once, plans stay small, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: For each result that is being stored, from the outer to the inner one, the tables written on the way to it.
_MADE: list[list[str]] = []
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(name: str, spark: SparkSession, sources: list[str], build: Callable[[], DataFrame], alone: bool = False) -> DataFrame:
    """``build()``'s rows, written below the shared folder once for each version of the sources and read from there after.

    A version is the paths, sizes and times of change of all files below the sources, one row for each file, summed by
    Spark without reading them. A changed file makes a new version. Results are kept by session.
    With ``alone`` nothing but the result reads what ``build`` cuts on the way to it, which is deleted once it is written.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(sources)
    facts = F.xxhash64("path", "length", F.col("modificationTime").cast("string")).cast("decimal(38,0)")
    key = (spark.sparkContext.applicationId, name, str(files.agg(F.sum(facts)).first()[0]))
    if key not in _STORED:
        _MADE.append([])
        try:
            built = build()
            on_the_way = _MADE.pop()
            _MADE.append([])
            _STORED[key] = cut(built)
        finally:
            _MADE.pop()
        if alone:
            _delete(spark, on_the_way)
    return _STORED[key]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables on whatever file system they are."""
    for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
