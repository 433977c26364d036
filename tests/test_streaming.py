from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.operators import scoring
from factloom.sources import interchange
from factloom.streaming import events as ev

SF = "/root/testdata/sf0.001"


def stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema.simpleString()[7:-1].replace(":", " ")
    return ev.event_stream(spark, SF, schema, "events.parquet")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_equal_the_batch(spark):
    got = run(ev.windowed(stream(spark).withWatermark("ts", "1 hour"), F.window("ts", "1 hour")), "tumbling", "complete")
    batch = ev.windowed(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), F.window("ts", "1 hour"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_decayed_sums_equal_the_batch(spark):
    got = {r.user_id: (r.at, r.total) for r in run(ev.decayed_sums(stream(spark), "user_id", 30.0), "decayed", "update").collect()}
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for user in list(got)[:3]:
        now = F.timestamp_seconds(F.lit(got[user][0]))
        want = scoring.reinforcement(rows.where(F.col("user_id") == user), ["user_id"], "ts", "value", 30.0, now).first().reinforcement
        assert got[user][1] == pytest.approx(want, rel=1e-6)


def test_first_seen(spark):
    got = run(ev.first_seen(stream(spark), ["event_id"]), "firsts", "append")
    assert got.count() == spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct().count()


def test_units_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"\n', 0.5), (2, "ü", None)], "i long, content string, value double")
    none = F.lit(None).cast("timestamp")
    units = rows.select(interchange.to_unit(F.col("i"), F.col("content"), F.col("value"), F.lit("X"), F.lit("ACTIVE"), F.array().cast("array<string>"), none).alias("u"))
    interchange.write_units(units, "u", str(tmp_path / "units"))
    (tmp_path / "blank").mkdir()
    (tmp_path / "blank" / "x.txt").write_text("\n  \n{bad\n")
    back = sorted((r.unit.sourceClaimId, r.unit.content, r.unit.confidence.value, r.unit.tags) for r in interchange.read_units(spark, str(tmp_path / "units")).collect())
    assert back == [("1", 'a "b"\n', 0.5, []), ("2", "ü", None, [])]
    assert "contentPublishedAt" not in units.first().u
    bad = interchange.read_units(spark, str(tmp_path / "blank")).collect()
    assert len(bad) == 1
