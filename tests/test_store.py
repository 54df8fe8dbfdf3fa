"""Tables kept by key: what is replaced, what is left alone, and that doing it again changes nothing."""

import os
import re

from pyspark.sql import functions as F
from test_matching import items

from triplicate.operators.incremental import rematch, replace_documents
from triplicate.operators.matching import match_units
from triplicate.operators.units import aggregate_units
from triplicate.sources import store


def rows(spark, *values):
    return spark.createDataFrame(list(values), "project_id long, v string")


def held(spark, path):
    return sorted(map(tuple, store.read_store(spark, path).collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_keys_are_replaced_and_no_other_bucket_is_touched(spark, tmp_path):
    path = str(tmp_path / "t")
    first = rows(spark, *[(i, "a") for i in range(40)], (None, "n"))
    store.replace_keys(path, "project_id", first, first, 8)
    assert held(spark, path) == sorted(map(tuple, first.collect()), key=str)
    before = files(path)
    fresh = rows(spark, (3, "b"), (3, "c"), (99, "foreign"))
    for _ in range(2):
        store.replace_keys(path, "project_id", rows(spark, (3, None), (3, None)), fresh, 8)
        assert held(spark, path) == sorted([*[(i, "a") for i in range(40) if i != 3], (3, "b"), (3, "c"), (None, "n")], key=str)
    changed = {os.path.dirname(f) for f, _ in set(files(path).items()) ^ set(before.items())}
    assert len(changed) == 1
    store.replace_keys(path, "project_id", rows(spark, (None, "")), fresh.where("false"), 8)
    assert (None, "n") not in held(spark, path)
    store.replace_keys(path, "project_id", first, first.where("false"), 8)
    assert held(spark, path) == []


def test_a_log_takes_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, value in ((0, "x"), (1, "y"), (1, "y"), (0, "x")):
        store.append_once(path, batch, rows(spark, (batch, value)))
    assert sorted((r.batch, r.v) for r in spark.read.parquet(path).collect()) == [(0, "x"), (1, "y")]


def test_a_stream_renews_its_keys_and_can_be_run_again(spark, tmp_path):
    source, path, log = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "log")
    store.replace_keys(path, "project_id", rows(spark, (1, "old"), (2, "old")), rows(spark, (1, "old"), (2, "old")), 4)
    renewed = lambda batch: batch.groupBy("project_id").agg(F.max("v").alias("v"))

    def run(checkpoint):
        stream = spark.readStream.schema("project_id long, v string").option("maxFilesPerTrigger", 1).parquet(str(source))
        store.renew_by_stream(stream, "project_id", renewed, path, str(tmp_path / checkpoint), log, lambda batch: batch, 4).awaitTermination()

    rows(spark, (2, "p"), (2, "q")).coalesce(1).write.parquet(str(source / "a"))
    rows(spark, (3, "r")).coalesce(1).write.parquet(str(source / "b"))
    source_files = sorted((tmp_path / "in").rglob("*.parquet"))
    for n, f in enumerate(source_files):
        f.rename(source / f"{n}.parquet")
    run("cp")
    once = held(spark, path)
    assert once == [(1, "old"), (2, "q"), (3, "r")]
    run("cp")  # nothing new
    run("cp-lost")  # all batches again, under the same numbers
    assert held(spark, path) == once
    assert sorted((r.project_id, r.v) for r in spark.read.parquet(log).collect()) == [(2, "p"), (2, "q"), (3, "r")]


def test_only_projects_with_replaced_documents_are_matched_again(spark, tmp_path):
    lines, groups = str(tmp_path / "items"), str(tmp_path / "groups")
    codes = ["B36", "B36 L", "W30", "T84", "Q9-11"]
    every = [
        (side, f"{side[0]}{p}-{i}", codes[(i + p) % 5], {"project_id": p, "finish": "WHITE" if i % 2 else "OAK"})
        for p in range(30) for side in ("DESIGN", "ORDER", "ACK") for i in range(4)
    ]
    first = items(spark, *every)
    store.replace_keys(lines, "project_id", first, first, 16)
    store.replace_keys(groups, "project_id", first, match_units(aggregate_units(first)), 16)
    before = files(groups)
    fresh = items(spark, *[("ORDER", f"O{p}-new", "T84", {"project_id": p, "finish": "OAK"}) for p in (4, 11)])
    for _ in range(2):
        replace_documents(lines, fresh, 16)
        rematch(lines, groups, fresh, 16)
    kept = [e for e in every if not (e[0] == "ORDER" and e[3]["project_id"] in (4, 11))]
    whole = match_units(aggregate_units(items(spark, *kept, *[("ORDER", f"O{p}-new", "T84", {"project_id": p, "finish": "OAK"}) for p in (4, 11)])))
    assert held(spark, groups) == sorted(map(tuple, whole.collect()), key=str)
    assert len({os.path.dirname(f) for f, _ in set(files(groups).items()) ^ set(before.items())}) <= 2
    plan = store.rows_of(lines, "project_id", fresh, 16)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[(isnotnull\(bucket_#\d+\), )?bucket_#\d+ IN \(\d+,\d+\)", plan)  # two buckets are listed and read
