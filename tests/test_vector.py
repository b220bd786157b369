"""Exact search and the inverted file: repeated ids, odd vectors, recall."""

import random

import pytest

from lodestone.operators import vector

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("block", [50_000, 7])
def test_knn_brute_force(spark, block):
    rnd = random.Random(block)
    data = [(rnd.randint(0, 40), [float(rnd.randint(-3, 3)) for _ in range(4)]) for _ in range(60)]
    odd = [(3, None), (4, [1.0, None, 2.0, 3.0]), (5, [float("nan")] * 4), (6, []), (7, [1.0])]
    rows = vector.numbered(spark.createDataFrame(data + odd, SCHEMA))
    got = vector.knn(rows, rows.filter("id % 5 = 0"), 3, block).collect()
    want = []
    for i, (q, v) in enumerate(data):
        if q % 5 == 0:
            want += [(q, c, d) for d, c in sorted((sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), c) for j, (c, w) in enumerate(data) if j != i)[:3]]
    assert sorted((r.query_id, r.vec_id, r.dist) for r in got) == sorted(want)


def test_inverted_file_keeps_repeated_ids(spark):
    rows = vector.numbered(spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 2.0]), (3, [5.0, 5.0]), (20, [0.0, 0.0]), (20, [0.0, 0.5])], SCHEMA))
    f = vector.InvertedFile(rows, 2, 2)
    got = sorted((r.query_id, r.vec_id, r.dist) for r in f.search(rows.filter("id = 20"), 9, 2).collect())
    assert got == sorted([(20, 20, 0.25), (20, 1, 1.0), (20, 1, 4.0), (20, 3, 50.0), (20, 20, 0.25), (20, 1, 0.25), (20, 1, 2.25), (20, 3, 45.25)])
    assert vector.InvertedFile(rows.limit(0), 4).search(rows.limit(0), 3, 2).count() == 0


def test_all_lists_probed_is_exact_and_large_lists_are_split(spark):
    rows = vector.numbered(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    q = rows.filter("id % 20 = 0")
    exact = vector.knn(rows, q, 10)
    assert vector.recall(vector.InvertedFile(rows, 8, 2, block=11).search(q, 10, 8), exact) == 1.0


def test_recall(spark):
    from lodestone.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.1"
    assert vector.recall(QUERIES["idx_ivf"](spark, sf), QUERIES["jn_knn"](spark, sf)) >= 0.9
