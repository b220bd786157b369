"""Streams with state: restarts, late and out-of-order rows, expiry at the edge, rings of histograms; the log as a source."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blockcache as bc
from lodestone.sources import wal
from lodestone.streaming import state

T0 = datetime.datetime(2024, 1, 1)


def feed(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(folder))


def at(s):
    return T0 + datetime.timedelta(seconds=s)


KV = "key string, ts timestamp, ord long, value string"


def test_newest_goes_on_after_a_restart(spark, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    first = [("a", at(5), 1, "x"), ("a", at(9), 2, "y"), ("b", at(1), 3, "z"), ("a", at(7), 4, "w")]
    state.run(state.newest(feed(spark, tmp_path / "in", first, KV), "1 hour"), out, cp, 2)
    now = lambda: {r.key: (r.value, r.n) for r in state.newest_now(spark.read.parquet(out)).collect()}
    assert now() == {"a": ("y", 3), "b": ("z", 1)}
    second = [("a", at(8), 9, "older"), ("b", at(1), 4, "same time, later"), ("c", at(0), 1, "new")]
    state.run(state.newest(feed(spark, tmp_path / "in", second, KV), "1 hour"), out, cp, 2)
    assert now() == {"a": ("y", 4), "b": ("same time, later", 2), "c": ("new", 1)}
    state.run(state.newest(feed(spark, tmp_path / "in", [], KV), "1 hour"), out, cp, 2)
    assert now() == {"a": ("y", 4), "b": ("same time, later", 2), "c": ("new", 1)}


def test_expiry_at_the_edge_and_reset(spark, tmp_path):
    out, cp, schema = str(tmp_path / "out"), str(tmp_path / "cp"), "key string, ts timestamp"
    run = lambda rows: state.run(state.expiring(feed(spark, tmp_path / "in", rows, schema), 10, "5 seconds"), out, cp, 2)
    alive = lambda: {r.key for r in state.alive_now(spark.read.parquet(out)).collect()}
    run([("a", at(0)), ("b", at(4)), ("c", at(15))])  # with rows up to 5 s late, now is 10
    assert alive() == {"a", "b", "c"}  # a's time to live ends at 10: not before now
    run([("c", at(16)), ("b", at(12))])  # now is 11; b begins again
    assert alive() == {"b", "c"}
    run([("c", at(25)), ("a", at(24))])  # now is 20; a comes back
    assert alive() == {"a", "b", "c"}
    run([("c", at(60))])
    assert alive() == {"c"}


def test_ring_equals_the_batch_form(spark, tmp_path):
    out, cp, schema = str(tmp_path / "out"), str(tmp_path / "cp"), "key string, ts timestamp, v double"
    rows = [("k", at(60 * m + s), float((m * 37 + s * s) % 400)) for m in range(6) for s in range(0, 60, 7)] + [("j", at(70), 5.0), ("k", at(200), 9e12)]
    ring = lambda x: state.windowed_histograms(feed(spark, tmp_path / "in", x, schema), 60, 3, [50.0, 99.0], "90 seconds")
    early = [r for i, r in enumerate(rows) if r[1] <= at(100) or r[1] <= at(180) and i % 2]  # the others come late, but within the watermark
    for part in (early, [r for r in reversed(rows) if r not in early], [("end", at(6000), 1.0)]):
        state.run(ring(part), out, cp, 2)
    df = spark.createDataFrame(rows, schema).withColumn("s", F.unix_timestamp("ts"))
    want = bc.windowed_histograms(df, ["key"], 60, 3, [50.0, 99.0], "s").collect()
    names = ["key", "w", "n", "mean", "least", "greatest", "p50", "p99"]
    assert sorted(tuple(r[c] for c in names) for r in spark.read.parquet(out).collect()) == sorted(tuple(r[c] for c in names) for r in want)


def test_windows_drop_the_oldest_sub_window(spark):
    df = spark.createDataFrame([("k", i, float(i + 1)) for i in range(5) for _ in range(100)], "key string, ts long, v double")
    got = {r.w: r for r in bc.windowed_histograms(df, ["key"], 1, 3, [50.0]).collect()}
    assert [(got[w].n, got[w].least, got[w].greatest, got[w].mean) for w in range(5)] == [(100, 1, 1, 1.0), (200, 1, 2, 1.5), (300, 1, 3, 2.0), (300, 2, 4, 3.0), (300, 3, 5, 4.0)]


def test_values_beyond_the_last_bucket_count(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 5_000_000_000_000, 6_000_000_000_000)], "k int, v double")
    r = bc.histogram_percentiles(df, ["k"], [50.0, 99.0]).first()
    assert r.n == 4 and r.p50 <= 2 and r.p99 > 1e12


LOG = "seq long, k string, v long"


def log_rows(spark, lo, hi):
    return spark.createDataFrame([(f"{i:04d}", i) for i in range(lo, hi)], "k string, v long").repartition(3)


def test_log_from_a_sequence_number(spark, tmp_path):
    p = str(tmp_path / "wal")
    assert wal.append(log_rows(spark, 0, 25), p, ["k"], 10) == 25
    assert wal.append(log_rows(spark, 25, 40), p, ["k"], 10) == 40
    assert [s for s, _ in wal.segments(p)] == [0, 10, 20, 25, 35]
    for start in (0, 9, 10, 24, 25, 39, 40, 99):
        got = wal.read(spark, p, LOG, start).collect()
        assert sorted((r.seq, r.v) for r in got) == [(i, i) for i in range(start, 40)]
    wal.purge(p, 20)
    assert wal.read(spark, p, LOG, 20).count() == 20
    with pytest.raises(Exception, match="not in the log any more"):
        wal.read(spark, p, LOG, 5).count()


def test_log_gap_raises(spark, tmp_path):
    import shutil

    p = str(tmp_path / "wal")
    wal.append(log_rows(spark, 0, 30), p, ["k"], 10)
    shutil.rmtree(dict(wal.segments(p))[10])
    with pytest.raises(Exception, match="gap in the log"):
        wal.read(spark, p, LOG, 0).count()
    assert wal.read(spark, p, LOG, 20).count() == 10


def test_two_runs_give_each_change_once(spark, tmp_path):
    p, out, cp = (str(tmp_path / x) for x in ("wal", "out", "cp"))
    run = lambda: wal.follow(spark, p, LOG, 5).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out).awaitTermination()
    wal.append(log_rows(spark, 0, 20), p, ["k"], 8)
    run()
    wal.append(log_rows(spark, 20, 33), p, ["k"], 8)
    run()
    run()
    assert sorted(r.seq for r in spark.read.parquet(out).collect()) == list(range(5, 33))
