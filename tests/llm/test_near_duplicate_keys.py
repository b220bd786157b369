"""Keys of the near-duplicate stage: their length follows the rows, recall stays, groups of thousands, equal hashes."""

import random

import numpy as np
import pytest

from lodestone.llm import simhash

DOC = "doc_id long, text string"


def variants(seed, groups, size, words=150, share=0.07):
    """Texts in groups, each a copy of its group's first with a few words replaced: similarities on both sides of 0.8."""
    rnd = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rnd.randint(0, 9999)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for at in range(0, words, rnd.choice([31, 47, 71, 149])):
                w[at] = f"n{rnd.randint(0, 10**9)}"
            out.append(" ".join(w))
    rnd.shuffle(out)
    return out


def similar_pairs(texts, least=0.8):
    """All pairs of a similarity of at least `least`, by brute force over all pairs."""
    grams = [simhash.shingles(t.encode(), 5) for t in texts]
    number = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
    n = np.array([len(g) for g in grams])
    common = np.zeros((len(texts), len(texts)), np.float32)
    names = sorted(number, key=number.get)
    place = {g: i % 4096 for g, i in number.items()}
    for start in range(0, len(names), 4096):
        x = np.zeros((len(texts), 4096), np.float32)
        for i, g in enumerate(grams):
            at = [place[s] for s in g if start <= number[s] < start + 4096]
            x[i, at] = 1
        common += x @ x.T
    i, j = np.nonzero(np.triu(common >= least * (n[:, None] + n[None, :] - common), 1))
    return list(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("size", [3, 4])
def test_recall_for_each_key_length(spark, size):
    texts = variants(size, 60, 6)
    pairs = similar_pairs(texts)
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(list(enumerate(texts)), DOC), size=size).collect()}
    missed = sum(i in kept and j in kept for i, j in pairs)
    assert len(pairs) > 200 and missed <= 0.05 * len(pairs)


@pytest.mark.parametrize("size", [2000])  # 5000 passes as well, in two minutes more
def test_recall_in_groups_of_thousands(spark, size):
    texts = variants(size, 1, size, 100)
    pairs = similar_pairs(texts)
    kept = {r.doc_id for r in simhash.first_of_each(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    alone = set(range(size)) - {k for p in pairs for k in p}
    missed = sum(i in kept and j in kept for i, j in pairs)
    assert alone <= kept and missed <= 0.1 * len(pairs)
    linked = set(range(size)) - alone
    assert len(kept & linked) < 0.05 * size


def test_unrelated_texts_meet_in_proportion():
    rnd = np.random.default_rng(1)
    for size in (1, 2):  # the shorter keys, at a size that a test can hold: a key more is 256 times fewer meetings, 4 times the keys
        n = 4000
        x = rnd.integers(0, 256, (n, simhash.WIDE_BYTES), dtype=np.int64)
        place = simhash.wide_keys(size)
        met = 0
        for p in place:
            key = sum(x[:, b] << 8 * i for i, b in enumerate(p))
            c = np.unique(key, return_counts=True)[1]
            met += int((c * (c - 1) // 2).sum())
        want = len(place) * n * (n - 1) / 2 / 256**size
        assert 0.8 * want < met < 1.2 * want
    assert [simhash.key_bytes(n) for n in (0, 10**6, 10**9 // 2, 10**10, 10**11, 10**13)] == [3, 3, 3, 4, 4, 5]
    assert len(simhash.wide_keys(3)) == 256 and len(simhash.wide_keys(4)) == 1024
    assert all(len(set(k)) == 4 for k in simhash.wide_keys(4).tolist())


def test_every_fingerprint_is_a_class_of_its_own(spark):
    """Texts without a common word stay, however their fingerprints hash."""
    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(500)]
    assert simhash.first_of_each(spark.createDataFrame(list(enumerate(texts)), DOC)).count() == 500


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_rows_are_picked_by_number_as_bits_or_dealt(spark, most):
    rnd = random.Random(5)
    numbers = [part << 33 | at for part in range(3) for at in range(200)]
    rows = spark.createDataFrame([(n, f"t{n}", n % 7) for n in numbers], "row long, text string, word long")
    some = rnd.sample(numbers, 90)
    picks = spark.createDataFrame([(n,) for n in [*some, *some[:9], 7 << 33]], "row long")  # one twice, one of no row
    got = simhash._picked(rows, "row", picks, most)
    assert got.columns == rows.columns and sorted(r.row for r in got.collect()) == sorted(some)
    assert simhash._picked(rows, "row", picks.limit(0), most).count() == 0


def test_whole_texts_are_not_shuffled_to_pick_the_first(spark):
    docs = spark.createDataFrame(list(enumerate(variants(6, 10, 4))), DOC)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for it
    try:
        plan = simhash.first_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "hashpartitioning" not in plan and "text" in plan
