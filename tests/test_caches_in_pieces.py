"""Caches that are fed a trace in pieces are the caches that see it whole, and draw what a seeded generator draws."""

import pickle
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators import blockcache as bc

ACCESS = "block long, size long, caller string, level long, btype string, ts long, o1 long, o2 long, o3 long, key_id long, is_hit long"


def _rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.randint(0, 80), rnd.randint(1, 9), "c", rnd.randint(1, 7), rnd.choice("FO"), i // 3, i % 3, 0, 0, rnd.randint(0, 4), 1) for i in range(n)]


def test_pieces_are_the_whole(spark):
    acc = spark.createDataFrame(random.Random(1).sample(_rows(1600, 3), 1600), ACCESS)
    configs = [(n, 90) for n in bc.POLICIES]
    got, want = ({(r.policy, r.hits, r.accesses) for r in bc.simulate(acc, configs, chunk_rows=c).collect()} for c in (300, 10_000))
    assert got == want and len(got) == len(configs) and {r[2] for r in got} == {1600}


def test_a_piece_is_a_part_of_the_trace(spark):
    rows, n = bc._cut(spark.createDataFrame(_rows(1600, 4), ACCESS), 200, 1024, ["block"])
    assert n == 8 and rows.groupBy("chunk").count().agg({"count": "max"}).first()[0] < 800
    assert bc.simulate(spark.createDataFrame(_rows(0, 4), ACCESS), [("lru", 9)]).collect() == []


def test_a_task_writes_one_piece(spark):
    rows, n = bc._cut(spark.createDataFrame(_rows(1600, 6), ACCESS), 100, 1024, ["block"])
    of = bc._by_chunk(rows, n).withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("chunk").alias("k")).collect()
    assert n == len(of) == 16 and {r.k for r in of} == {1}


def test_draws_are_those_of_the_generator():
    rnd, d, r = random.Random(1), bc._Draws(7), np.random.default_rng(7)
    for _ in range(1500):
        n = rnd.choice([1, 2, 200, rnd.randint(2, 5000), 2_500_000_001, 3_000_000_000])  # the great ones refuse many numbers
        assert (d(n, min(64, n)) == r.integers(0, n, min(64, n))).all()
        d = pickle.loads(pickle.dumps(d)) if rnd.random() < 0.01 else d


def _plain(rows, capacity, worth, sample=64):
    rng, cache, names, by_size, used, hits = np.random.default_rng(1), {}, [], {}, 0, 0
    for i, (b, s) in enumerate(rows):
        if b in cache:
            hits += 1
            cache[b][1] += 1
            by_size[s.bit_length()] = by_size.get(s.bit_length(), 0) + 1
            continue
        while used + s > capacity:
            some = rng.integers(0, len(names), min(sample, len(names))).tolist()
            at = min(some, key=lambda j: worth(*cache[names[j]][:2], i - cache[names[j]][2] + 1, by_size.get(cache[names[j]][0].bit_length(), 0)))
            old, names[at] = names[at], names[-1]
            names.pop()
            used -= cache.pop(old)[0]
        cache[b] = [s, 1, i]
        names.append(b)
        used += s
    return hits


def test_sampled_caches_step_by_step():
    rows = [(r[0], r[1]) for r in _rows(3000, 5)]
    for name, worth in (("hyperbolic", lambda s, n, age, c: n / (age * s)), ("costclass", lambda s, n, age, c: (c + 1) / s)):
        for capacity in (20, 150):
            cache = bc.POLICIES[name](capacity)
            for at in range(0, len(rows), 700):
                cache.feed(rows[at : at + 700])
                cache = pickle.loads(pickle.dumps(cache))
            assert cache.hits == _plain(rows, capacity, worth)


def test_sampled_caches_that_hold_more_than_a_sample(monkeypatch):
    rnd, calls, careful = random.Random(8), [], bc._Draws.__call__
    monkeypatch.setattr(bc._Draws, "__call__", lambda self, n, k: calls.append(n) or careful(self, n, k))
    rows = [(rnd.randint(0, 400), rnd.randint(1, 9)) for _ in range(9000)]
    for name, worth in (("hyperbolic", lambda s, n, age, c: n / (age * s)), ("costclass", lambda s, n, age, c: (c + 1) / s)):
        cache = bc.POLICIES[name](700)
        for at in range(0, len(rows), 3700):
            cache.feed(rows[at : at + 3700])
            cache = pickle.loads(pickle.dumps(cache))
        assert cache.hits == _plain(rows, 700, worth) and len(cache.cache) > 64
    assert len(calls) < 500  # not one for each of some 12,000 evictions


def test_parts_with_refused_numbers_are_fed_again():
    rnd = random.Random(9)
    rows = [(rnd.randint(0, 400), rnd.randint(1, 9), i, "F", i % 7) for i in range(6000)]
    for name in ("hyperbolic", "costclass", "ts", "linucb"):
        quick, careful = (bc.POLICIES[name](700) for _ in range(2))
        fed = [r[: len(quick.fields)] for r in rows]
        for c in (quick, careful):
            c.draw.ahead = c.draw.rng.integers(0, 1 << 32, 60_000, np.uint32).astype(np.uint64)
            c.draw.ahead[[100, 101, 40_000]] = 0  # zero is refused for all n but powers of two
        quick.feed(fed)
        careful.run(fed, lambda n, c=careful: c.draw(n, min(64, n)))
        assert (quick.hits, quick.cache) == (careful.hits, careful.cache)


def test_a_piece_is_dealt_in_packs(spark):
    rows, n = bc._cut(spark.createDataFrame(_rows(1600, 7), ACCESS), 800, 1024, ["block", "btype"], True)
    got = rows.orderBy("pos").collect()
    assert n == 2 and len(got) < 2 * n + 2 and sum(pa.ipc.open_stream(r.rows).read_all().num_rows for r in got) == 1600


def _plain_bandit(rows, capacity, choose, learn, sample=64):
    """Hits and evictions of a bandit's cache step by step; it is told at once what it hears."""
    rng, cache, names, gone, used, hits, evicted = np.random.default_rng(2), {}, [], {}, 0, 0, 0
    for b, s, nth, btype, level in rows:
        if b in cache:
            hits += 1
            cache[b] = cache.pop(b)[0], nth
            continue
        if b in gone:
            learn(*gone.pop(b), 0.0)
        x = np.array((1.0, zlib.crc32(btype.encode()) % 2, level / 8, min(1.0, s / capacity)))
        while used + s > capacity:
            arm, evicted = choose(x), evicted + 1
            old = next(iter(cache))
            if arm:
                old = names[min(rng.integers(0, len(names), min(sample, len(names))).tolist(), key=lambda j: cache[names[j]][1])]
            at, last = names.index(old), names.pop()
            if at < len(names):
                names[at] = last
            used -= cache.pop(old)[0]
            gone[old] = arm, x
            if len(gone) > 64:
                learn(*gone.pop(next(iter(gone))), 1.0)
        cache[b] = s, nth
        names.append(b)
        used += s
    return hits, evicted


def _bandit_rows(n, blocks, seed):
    rnd, met = random.Random(seed), {}
    for _ in range(n):
        b = int(rnd.paretovariate(0.5)) % blocks
        met[b] = met.get(b, 0) + 1
        yield b, rnd.randint(1, 9), met[b], rnd.choice("FO"), rnd.randint(1, 7)


class _Counted:
    """A generator that counts its draws of beta numbers."""

    calls = 0

    def __init__(self, rng):
        self.rng, self.bit_generator = rng, rng.bit_generator

    def __reduce__(self):
        return _Counted, (self.rng,)

    def beta(self, *args):
        _Counted.calls += 1
        return self.rng.beta(*args)


def test_thompson_step_by_step():
    for blocks, capacity in ((100, 150), (5000, 150), (5000, 700)):
        rows, rng, win, loss, evicted = list(_bandit_rows(6000, blocks, 4)), np.random.default_rng(1), [1.0, 1.0], [1.0, 1.0], 0

        def learn(arm, x, reward, win=win, loss=loss):
            win[arm] += reward
            loss[arm] += 1 - reward

        hits, evicted = _plain_bandit(rows, capacity, lambda x, r=rng, w=win, o=loss: int(r.beta(w[1], o[1]) > r.beta(w[0], o[0])), learn)
        cache, _Counted.calls = bc.POLICIES["ts"](capacity), 0
        cache.arms = _Counted(cache.arms)
        for at in range(0, len(rows), 2500):
            cache.feed(rows[at : at + 2500])
            cache = pickle.loads(pickle.dumps(cache))
        assert (cache.hits, cache.win, cache.loss) == (hits, win, loss) and evicted > 500
    assert _Counted.calls < evicted  # and not two for each, where blocks seldom come back


def test_linucb_step_by_step():
    for blocks, capacity in ((100, 150), (5000, 150), (5000, 700)):
        rows, g, r = list(_bandit_rows(4000, blocks, 5)), [np.eye(4), np.eye(4)], [np.zeros(4), np.zeros(4)]

        def bound(x, arm, g=g, r=r):
            a = np.linalg.inv(g[arm])
            return x @ a @ r[arm] + 0.2 * np.sqrt(x @ a @ x)

        def learn(arm, x, reward, g=g, r=r):
            g[arm] += np.outer(x, x)
            r[arm] += reward * x

        hits, evicted = _plain_bandit(rows, capacity, lambda x, f=bound: int(f(x, 1) > f(x, 0)), learn)
        cache = bc.POLICIES["linucb"](capacity)
        for at in range(0, len(rows), 1700):
            cache.feed(rows[at : at + 1700])
            cache = pickle.loads(pickle.dumps(cache))
        assert cache.hits == hits and evicted > 300
        for own, m, n in zip(cache.sums, g, r, strict=True):
            assert np.allclose(own, np.r_[m[np.triu_indices(4)], n], rtol=1e-12)
