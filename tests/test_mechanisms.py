"""Bloom filters, zone maps, single deletes, savepoints, ordered block traces, order statistics, common subsequences."""

import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import functions as fn
from lodestone import sinks, sources
from lodestone.operators import bloom, drive, kv, order, scoring
from lodestone.sources import block_io, zones


@pytest.mark.parametrize("n", [1_000, 20_000, 300_000])
def test_bloom_rate_and_no_false_negatives(spark, n):
    keys, others = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key")), spark.range(n, n + 300_000).select(F.concat(F.lit("k"), "id").alias("key"))
    shape = bloom.Shape.of(n)
    f = bloom.build(keys, "key", shape)
    assert bloom.may_hold(keys, "key", f, shape).count() == n
    rate = bloom.may_hold(others, "key", f, shape).count() / 300_000
    assert rate <= 1.5 * shape.expected(n)


def test_bloom_merges_in_any_order(spark):
    keys = spark.range(5000).withColumn("key", F.when(F.col("id") % 50 > 0, F.col("id")))
    shape = bloom.Shape.of(5000, 12)
    parts = [bloom.build(keys.filter(F.col("id") % 3 == i), "key", shape) for i in range(3)]
    whole = sorted(map(tuple, bloom.build(keys, "key", shape).collect()))
    for ways in ([0, 1, 2], [2, 0, 1]):
        assert sorted(map(tuple, bloom.merge([bloom.merge([parts[ways[0]], parts[ways[1]]]), parts[ways[2]]]).collect())) == whole
    for send in (32 << 20, 0):  # sent to all tasks, or dealt by block
        assert bloom.semi_join(spark.range(8000).withColumn("key", F.col("id")), keys, "key", 12, send).count() == 4900


def test_zone_maps_open_few_files(spark, tmp_path):
    p = str(tmp_path / "z")
    df = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    zones.write(df, p, ["k"], ["k", "v", "n"], files=20)
    assert spark.read.parquet(f"{p}/zones").agg(F.sum("rows")).first()[0] == 10_000
    for ranges in ({"k": (500, 900)}, {"k": (None, 10), "v": (5, None)}, {"k": (9990, None)}, {"n": (4000, 4100)}, {"k": (20_000, None)}):
        got = zones.read(spark, p, ranges)
        want = df
        for c, (lo, hi) in ranges.items():
            want = want.filter((F.col(c) >= (lo if lo is not None else -1)) & (F.col(c) < (hi if hi is not None else 10**9)))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert len(got.inputFiles()) <= 3
    assert len(zones.files_for(spark, p, {"v": (0, 1000)})) == 20


def replayed(versions, snapshots):
    """The rules read out loud: versions newest first, one look ahead."""
    stripe = lambda s: sum(s > x for x in snapshots)
    out, i, last = [], 0, None
    while i < len(versions):
        seq, kind = versions[i]
        s = stripe(seq)
        if kind == "single":
            last = s
            if i + 1 == len(versions):
                if s > 0:
                    out.append(seq)
                i += 1
            elif stripe(versions[i + 1][0]) != s:
                out.append(seq)
                i += 1
            elif versions[i + 1][1] in ("single", "delete"):
                i += 1
            else:
                i += 2
        else:
            if last != s and not (kind == "delete" and s == 0):
                out.append(seq)
            last = s
            i += 1
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["put", "put", "delete", "single", "single"])), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=3, unique=True))
def test_single_deletes(spark, ops, snapshots):
    rows = [("d", k, i, kind, i) for i, (k, kind) in enumerate(ops)]
    log = spark.createDataFrame(rows, "cf string, key long, seq long, type string, value long")
    got = sorted(r.seq for r in kv.compact_single(log, ["seq"], snapshots, "seq").collect())
    assert got == sorted(s for k in range(4) for s in replayed([(i, kind) for _, x, i, kind, _ in reversed(rows) if x == k], snapshots))


def survivors(kinds):
    kept, stack = [], []
    for i, kind in enumerate(kinds):
        if kind == "save":
            stack.append(len(kept))
        elif kind == "rollback":
            if stack:
                del kept[stack.pop() :]
        elif kind == "pop":
            if stack:
                stack.pop()
        else:
            kept.append(i)
    return kept


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["put", "put", "save", "save", "rollback", "pop", "delete"]), max_size=40), min_size=1, max_size=4))
def test_savepoints(spark, batches):
    rows = [(b, i, kind) for b, kinds in enumerate(batches) for i, kind in enumerate(kinds)]
    got = kv.batch_survivors(spark.createDataFrame(rows, "b int, at int, type string"), ["b"], ["at"]).collect()
    assert sorted((r.b, r.at) for r in got) == [(b, i) for b, kinds in enumerate(batches) for i in survivors(kinds)]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_block_trace_over_many_splits(spark, tmp_path, small_splits):
    p = tmp_path / "io.txt"
    good = [f"{i // 3} 0 {i * 8} 8 {i % 2}" for i in range(500)]
    p.write_text("\r\n".join([*good, "17 0 5 8", "9 9 9 9 9", "bad"]) + "\n")
    parsed = block_io.lines(spark, str(p))
    assert parsed.select("split").distinct().count() > 10
    got = block_io.read(spark, str(p)).orderBy("place").collect()
    assert [(r.place, r.time, r.address, r.type) for r in got] == [(i, i // 3, i * 8, i % 2) for i in range(500)]
    again = block_io.read(spark, str(p), rounds=3).orderBy("round", "place").collect()
    assert [r.time for r in again] == [i // 3 + k * 166 for k in range(3) for i in range(500)]
    assert block_io.read(spark, str(p), percent=30).count() == 150


def test_block_trace_time_must_not_go_back(spark, tmp_path, small_splits):
    p = tmp_path / "io.txt"
    times = list(range(200))
    for where in (1, 57, 199):  # at the head, inside, and at the end of splits
        t = times[:where] + [where - 2] + times[where:]
        p.write_text("".join(f"{x} 0 1 8 1\n" for x in t))
        reqs = block_io.requests(block_io.lines(spark, str(p)))
        assert [r.ahead for r in block_io.backward(reqs).collect()] == [where - 1]
        with pytest.raises(Exception, match="must not decrease"):
            block_io.read(spark, str(p)).count()
    p.write_text("x\n1 0 1 8 1\n")
    assert block_io.read(spark, str(p)).count() == 0


def test_places_and_order_statistics(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aaaab"), rnd.randint(0, 50), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = {r.i: (r.place, r.n) for r in order.numbered(df, ["v", "i"], ["g"], total="n").collect()}
    for g in "ab":
        own = sorted((v, i) for x, v, i in rows if x == g)
        assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    picks = order.nth(df, "v", ["g"], {"mid": F.floor(F.col("size") / 2), "p95": F.bround(0.95 * (F.col("size") - 1)).cast("long")}, ["i"]).collect()
    for r in picks:
        own = sorted(v for x, v, _ in rows if x == r.g)
        assert (r.mid, r.p95) == (own[len(own) // 2], own[round(0.95 * (len(own) - 1))])


def test_common_subsequence():
    rnd = random.Random(2)

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    for _ in range(60):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 40))] for _ in range(2))
        assert scoring.common_length(a, b) == table(a, b)
    a, b = ([rnd.randint(0, 500) for _ in range(20_000)] for _ in range(2))
    start = time.time()
    assert 0 < scoring.common_length(a, b) < 20_000 and time.time() - start < 1


def test_thirty_days(spark):
    days = [(1, k) for k in range(65) if k != 20] + [(2, k) for k in range(29)] + [(3, k) for k in range(30)]
    d = spark.createDataFrame(days, "drive int, k int").select("drive", F.date_add(F.lit("2024-01-01").cast("date"), F.col("k")).alias("day"), F.col("k").cast("long").alias("errors"))
    ends = {(r.drive, (r.window_end - __import__("datetime").date(2024, 1, 1)).days) for r in drive.consecutive(d, 30).collect()}
    assert ends == {(1, k) for k in range(50, 65)} | {(3, 29)}
    flat = drive.flatten_window(drive.window_values(d, 30), "e", 30).collect()
    assert {(r.drive, r.e_t00, r.e_t29) for r in flat} == {(1, k - 29, k) for k in range(50, 65)} | {(3, 0, 29)}


def test_fill_days_between(spark):
    day = lambda k: F.date_add(F.lit("2024-01-01").cast("date"), k)
    rows = [(1, 0, 5, 1, 2.0, None), (1, 3, 1, 1, 4.0, "m"), (1, 5, 2, 0, 5.0, None), (2, 7, 1, 0, 1.0, None)]
    d = spark.createDataFrame(rows, "drive int, k int, errors long, flag long, wear double, model string").withColumn("day", day(F.col("k"))).drop("k")
    got = drive.gap_fill(d).orderBy("drive", "day").collect()
    assert [(r.errors, r.flag, r.wear, r.model) for r in got] == [(5, 1, 2.0, "m"), (0, 0, 2.0, "m"), (0, 0, 2.0, "m"), (1, 1, 4.0, "m"), (0, 0, 4.0, "m"), (2, 0, 5.0, "m"), (1, 0, 1.0, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "y" / "sub").mkdir(parents=True)
    for name, v in (("20180123.csv", 1), ("log_2018-02-01.csv", 2), ("sub/2018_03_05.csv", 3), ("notes.csv", 4)):
        (tmp_path / "y" / name).write_text(f"b,a\n{v},x\n")
    got = sources.daily_csv(spark, str(tmp_path / "y"), "b int, a string").collect()
    assert sorted((str(r.ds), r.b, r.a) for r in got) == [("2018-01-23", 1, "x"), ("2018-02-01", 2, "x"), ("2018-03-05", 3, "x")]
    df = spark.createDataFrame([("2024-05-06", 1), ("2024-05-07", 2)], "ds string, v int").withColumn("ds", F.to_date("ds"))
    sinks.daily_csv(df, str(tmp_path / "days"))
    assert sorted(x.name for x in (tmp_path / "days").iterdir() if x.suffix == ".csv" and not x.name.startswith(".")) == ["20240506.csv", "20240507.csv"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "My paper (1).txt").write_text("abcde")
    assert [(r.paper, r.chunk, r.text) for r in sources.papers(spark, str(tmp_path / "p"), 3).collect()] == [("My_paper_1", 0, "abc"), ("My_paper_1", 1, "de")]
    (tmp_path / "o.ini").write_text("[DBOptions]\n  a=1\n b = x y\n[CF \"d\"]\n a=2\n")
    assert [tuple(r) for r in sources.options_ini(spark, str(tmp_path / "o.ini")).collect()] == [("DBOptions", "a", "1"), ("DBOptions", "b", "x y"), ('CF "d"', "a", "2")]


def test_mapping_functions(spark):
    df = spark.createDataFrame([("MA1", "d", "1", 7.0, 8.0), ("ZZ", "d", "1", 7.0, 8.0)], "model string, disk_id string, ds string, r_177 double, r_5 double")
    assert [(r.r_177, r.r_5) for r in fn.drop_by_model(df, "model").collect()] == [(None, 8.0), (7.0, 8.0)]
    assert fn.of_model(df, "model", "MA1").columns == ["disk_id", "ds", "r_5"]
    r = fn.map_features(spark.createDataFrame([("3", "x")], "write_count string, read_count string")).first()
    assert r.r_241 == 3.0 and r.r_242 == 0.0 and r.r_5 == 0.0 and len(fn.MAPPED) == 15
    v = spark.createDataFrame([("degrades", "Improved yet higher"), ("improves", "Higher"), ("improves", "lower"), ("uses", "worse"), ("degrades", None)], "v string, e string")
    assert [x.v for x in v.select(fn.fix_verb(F.col("v"), F.col("e")).alias("v")).collect()] == ["improves", "degrades", "improves", "uses", "degrades"]


def test_sorted_files_are_verified(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id").alias("v"))
    got = sinks.verified(df, str(tmp_path / "s"), "k", 4).collect()
    assert sum(r.rows for r in got) == 5000 and all(r.ordered and r.apart for r in got) and 2 <= len(got) <= 4


def test_one_bucket_is_read(spark, tmp_path):
    p = str(tmp_path / "b")
    sinks.buckets(spark.range(2000).withColumnRenamed("id", "k"), p, "k", 8)
    got = sinks.buckets.read(spark, p, "k", 8, 77)
    assert [r.k for r in got.collect()] == [77]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(got.inputFiles()) <= 8


def test_recovery_filter_stops_and_replaces(spark):
    log = spark.createDataFrame([(i, k, i) for i, k in enumerate("kkrikksk")], "seq long, act string, value long")
    act = F.when(F.col("act") == "s", "stop").when(F.col("act") == "i", "ignore").when(F.col("act") == "r", "replace").otherwise("keep")
    got = kv.filtered_log(log, act, {"value": F.lit(-1).cast("long")}).orderBy("seq").collect()
    assert [(r.seq, r.value) for r in got] == [(0, 0), (1, 1), (2, -1), (4, 4), (5, 5)]


def test_puts_of_entities_and_times(spark):
    rows = spark.createDataFrame([("d", 1, "x", None, 9), ("d", 2, None, {"": "v", "c": "w"}, None)], "cf string, key long, value string, entity map<string,string>, t long")
    got = kv.puts(rows, F.col("key"), F.col("t")).orderBy("key").collect()
    assert [(r.type, r.value, r.columns, r.write_time) for r in got] == [("put", "x", None, 9), ("put_entity", "v", {"c": "w"}, None)]


def test_turtle_in_linear_time():
    tokens = ["e:a", "p", "x"] + [t for i in range(200_000) for t in (",", f"x{i}")] + [".", "e:b", "a", "e:T", ";", "q", "y", "."]
    start = time.time()
    got = sources.statements(tokens)
    assert len(got) == 200_003 and got[-1] == {"s": "e:b", "p": "q", "o": "y"} and time.time() - start < 2


def test_paths_of_a_forest(spark):
    from lodestone.operators import graph

    nodes = spark.createDataFrame([("1", None, "a"), ("2", "1", "b"), ("3", "2", "c"), ("4", "1", "d"), ("5", None, "e")], "node string, parent string, label string")
    assert sorted((r.label, r.path, r.depth) for r in graph.paths(nodes).collect()) == [("a", "a", 1), ("b", "a/b", 2), ("c", "a/b/c", 3), ("d", "a/d", 2), ("e", "e", 1)]
    assert graph.paths(nodes.limit(0)).count() == 0


def test_backups_keep_a_file_once(spark, tmp_path):
    from lodestone.sinks import backups

    live, to = str(tmp_path / "live"), str(tmp_path / "to")
    for n in range(3):
        spark.range(n * 100, n * 100 + 100).repartition(2).write.mode("append").parquet(live)
        assert backups.backup(spark, live, to) == n + 1
        assert len(list((tmp_path / "to" / "files").glob("[0-9a-f]*"))) == 2 * (n + 1)
    assert [backups.restore(spark, to, n).count() for n in (1, 2, 3)] == [100, 200, 300] and backups.restore(spark, to).agg(F.sum("id")).first()[0] == 299 * 150
    assert backups.damaged(spark, to, 3).count() == 0
    for f in (tmp_path / "live").glob("part-*"):  # a smaller table, then the old backups go
        f.unlink()
    spark.range(500, 510).coalesce(1).write.mode("append").parquet(live)
    backups.backup(spark, live, to)
    assert backups.purge(spark, to, 1) == [1, 2, 3] and backups.backups(to) == [4]
    assert len(list((tmp_path / "to" / "files").glob("[0-9a-f]*"))) == 1 and backups.restore(spark, to).count() == 10
    victim = next((tmp_path / "to" / "files").glob("[0-9a-f]*"))
    victim.write_bytes(b"no")
    for crc in (tmp_path / "to" / "files").glob(".*.crc"):
        crc.unlink()
    assert backups.damaged(spark, to, 4).count() == 1


def test_sections_and_replay(spark):
    df = spark.createDataFrame([(" 5 ", None, "c9"), ("", " ", None)], "temperature_c string, study string, condition_id string")
    got = [r.m for r in df.select(fn.section(df.columns, fn.ENVIRONMENT, ["env_id", "condition_id"], "ENV_1").alias("m")).collect()]
    assert got == [{"temperature_c": "5", "condition_id": "c9", "id": "c9"}, None]
    t = spark.createDataFrame([(100, "a"), (104, "b")], "ts long, k string")
    assert sorted((r.k, r.due) for r in sources.replayed(t, "ts", 2.0).collect()) == [("a", 0.0), ("b", 2.0)]
    with pytest.raises(ValueError):
        sources.replayed(t, "ts", 0)


def test_scratch_is_cleared(spark):
    import os

    from lodestone.sources import scratch

    p = scratch.path(spark, "x")
    spark.range(3).write.parquet(p)
    assert spark.read.parquet(p).count() == 3
    scratch.clear(spark)
    assert not os.path.exists(p.removeprefix("file://"))
