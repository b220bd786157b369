"""Steps whose tasks must not grow with the tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import blockcache as bc
from lodestone.operators import kv, order, vector

ACCESS = "block long, btype string, caller string, level long"


@pytest.mark.parametrize("levels", [7, 90])
@pytest.mark.parametrize("most", [1000, 3])
def test_summary_is_that_of_grouping_sets(spark, levels, most):
    rnd = random.Random(levels)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["F", "O", None]), rnd.choice(["a", "b", None]), rnd.choice([None, *range(levels)])) for _ in range(900)]
    acc = spark.createDataFrame([*rows, (None, "X", "only nulls", 1)], ACCESS)
    sets = [[F.col("btype")], [F.col("caller")], [F.col("caller"), F.col("level")], [F.col("caller"), F.col("btype")]]
    want = acc.groupingSets(sets, "btype", "caller", "level").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"))
    got = bc.summary(acc, most)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert bc.summary(acc.limit(0), most).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("Expand" in plan) == (most == 3)


def test_places_have_partitions_by_rows(spark, monkeypatch):
    rows = spark.range(4000).withColumn("id", F.col("id") * 7 % 4001)
    assert order.pieces(rows) == 4 and order.pieces(rows, 100) == 40
    few = order.pieces
    monkeypatch.setattr(order, "pieces", lambda df: few(df, 100))
    n = order.numbered(rows, ["id"])
    assert [r.place for r in n.orderBy("id").collect()] == list(range(4000))
    monkeypatch.setattr(kv, "pieces", lambda df: few(df, 100))
    ops = spark.createDataFrame([(i % 50, i, ("put", "save", "put", "rollback", "put")[i // 50 % 5]) for i in range(500)], "b int, at int, type string")
    out = kv.batch_survivors(ops, ["b"], ["at"])
    assert sorted(r["at"] for r in out.collect()) == sorted(i for i in range(500) if i // 50 % 5 in (0, 4))
    assert "hashpartitioning(b" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("pairs", [1, 50])
def test_search_holds_few_pairs(spark, pairs):
    rng = np.random.default_rng(pairs)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 3, (70, 4)))]
    rows = vector.numbered(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    dealt = rows.select(F.lit(0).cast("long").alias("block"), F.lit(0).alias("side"), "row", "id", "v")
    asks = rows.filter("id % 5 = 0").select(F.lit(0).cast("long").alias("block"), F.lit(1).alias("side"), "row", "id", "v")
    got = vector._search(dealt.unionByName(asks), 3, pairs=pairs).collect()
    want = vector.knn(rows, rows.filter("id % 5 = 0"), 3).collect()
    assert sorted(got) == sorted(want) and len(got) == 42
