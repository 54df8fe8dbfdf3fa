import pytest
from pyspark.sql import functions as F

from triplicate.streaming.activity import allowed, beats, fixed_window, limited, limited_stream


def test_refused_hits_do_not_count():
    assert allowed([0, 1, 2, 3, 10.5, 11.2], 3, 10.0)[0] == [True, True, True, False, True, True]


def stream_of(spark, folder, df):
    """A stream of what files in the folder bring, one file in each micro-batch, in the order of their names."""
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(folder, df, name):
    """A file of these rows, later than those before."""
    import os
    import time

    folder.mkdir(exist_ok=True)
    df.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(folder / f"{name}.parquet", index=False)
    os.utime(folder / f"{name}.parquet", (time.time() - 100 + int(name), time.time() - 100 + int(name)))


def events_at(spark, *rows):
    """Rows of event_id, user_id and minutes after midnight."""
    df = spark.createDataFrame(list(rows), "event_id long, user_id long, m double")
    return df.select("event_id", "user_id", F.timestamp_seconds(F.col("m") * 60 + 1_704_067_200).alias("ts"))


@pytest.mark.parametrize("rule", [allowed, fixed_window])
def test_stream_and_table_agree_and_what_is_held_goes(spark, tmp_path, rule):
    df = events_at(spark, *[(i, i % 3, float(i * 5 + (i * 7) % 4)) for i in range(60)])
    for n in range(4):
        put(tmp_path / "in", df.where(f"event_id between {n * 15} and {n * 15 + 14}"), str(n))
    later = events_at(spark, (100, 9, 3000.0))
    put(tmp_path / "in", later, "8")  # a day and more later: everything before has expired
    put(tmp_path / "in", events_at(spark, (101, 9, 3001.0)), "9")
    stream = limited_stream(stream_of(spark, tmp_path / "in", df), rule=rule)
    name = f"limited_{rule.__name__}"
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    whole = df.unionByName(later).unionByName(events_at(spark, (101, 9, 3001.0)))
    assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, limited(whole, rule=rule).collect()))
    assert max(held) == 4 and held[-1] == 1  # the last user's alone


def test_a_silent_job_is_told_of_without_an_event_of_its_own(spark, tmp_path):
    day = 1440.0
    df = events_at(spark, (1, 1, 0.0), (2, 1, day), (3, 2, day), (4, 1, 5 * day), (5, 2, 2 * day))
    put(tmp_path / "in", df.where("event_id <> 4"), "1")
    put(tmp_path / "in", df.where("event_id = 4"), "2")
    put(tmp_path / "in", events_at(spark, (6, 3, 9 * day)), "3")
    q = beats(stream_of(spark, tmp_path / "in", df)).writeStream.format("memory").queryName("beats_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    told = sorted(map(tuple, spark.table("beats_out").collect()))
    assert told == sorted(map(tuple, beats(df).collect())) and [(r[0], r[3]) for r in told] == [(1, 1), (1, 2), (2, 2)] or [(r[0], r[3]) for r in told] == [(1, 2), (1, 1), (2, 2)]


def test_windows_begin_with_the_first_hit():
    assert fixed_window([0, 1, 2, 9, 10, 11, 30], 2, 10.0)[0] == [True, True, False, False, True, True, True]
    for rule in (allowed, fixed_window):
        times, held, one_by_one = [0.0, 1.0, 2.0, 9.0, 10.0, 11.0, 12.0, 30.0], [], []
        for t in times:
            passed, held = rule([t], 2, 10.0, held)
            one_by_one += passed
        assert one_by_one == rule(times, 2, 10.0)[0]


def test_pages_are_dealt_out_once_for_all_kinds_of_call(spark):
    from triplicate.plans import projects

    plan = projects.page_batches(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
