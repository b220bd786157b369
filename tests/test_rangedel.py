"""Range deletes: small cases with known fragments, and both paths against brute force."""

import random

import pytest

from lodestone.operators import rangedel

CASES = {
    "apart": ([("a", "b", 10), ("c", "d", 5)], [("a", "b", 10), ("c", "d", 5)], {"": 0, "a": 10, "b": 0, "c": 5}),
    "overlap": ([("a", "e", 10), ("c", "g", 15)], [("a", "c", 10), ("c", "e", 15), ("c", "e", 10), ("e", "g", 15)], {"a": 10, "c": 15, "e": 15, "g": 0}),
    "contiguous": ([("a", "c", 10), ("c", "e", 20), ("c", "e", 5), ("e", "g", 15)], [("a", "c", 10), ("c", "e", 20), ("c", "e", 5), ("e", "g", 15)], {"a": 10, "c": 20, "e": 15, "g": 0}),
    "same ends": ([("a", "c", 10), ("a", "c", 7), ("a", "c", 3)], [("a", "c", 10), ("a", "c", 7), ("a", "c", 3)], {"a": 10, "b": 10, "c": 0}),
    "same start": ([("a", "e", 10), ("a", "g", 7), ("a", "c", 3)], [("a", "c", 10), ("a", "c", 7), ("a", "c", 3), ("c", "e", 10), ("c", "e", 7), ("e", "g", 7)], {"a": 10, "c": 10, "e": 7, "g": 0}),
    "mixed ends": (
        [("a", "c", 30), ("a", "g", 20), ("a", "e", 10), ("a", "g", 7), ("a", "c", 3)],
        [("a", "c", 30), ("a", "c", 20), ("a", "c", 10), ("a", "c", 7), ("a", "c", 3), ("c", "e", 20), ("c", "e", 10), ("c", "e", 7), ("e", "g", 20), ("e", "g", 7)],
        {"a": 30, "c": 20, "e": 20, "g": 0},
    ),
    "overlap and same start": (
        [("a", "e", 10), ("j", "n", 4), ("c", "i", 6), ("c", "g", 8), ("j", "l", 2)],
        [("a", "c", 10), ("c", "e", 10), ("c", "e", 8), ("c", "e", 6), ("e", "g", 8), ("e", "g", 6), ("g", "i", 6), ("j", "l", 4), ("j", "l", 2), ("l", "n", 4)],
        {"a": 10, "c": 10, "e": 8, "i": 0, "j": 4, "m": 4},
    ),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_fragments(spark, name):
    given, want, covers = CASES[name]
    t = spark.createDataFrame([("d", bytearray(lo.encode()), bytearray(hi.encode()), s) for lo, hi, s in given], "cf string, lo binary, hi binary, seq long")
    got = rangedel.fragments(t).collect()
    assert sorted((bytes(r.lo).decode(), bytes(r.hi).decode(), r.seq) for r in got) == sorted(want)
    swept = list(rangedel.sweep(sorted(((1, lo), (1, hi), s) for lo, hi, s in given)))
    for key, seq in covers.items():
        assert max([s for lo, hi, s in swept if lo <= (1, key) < hi], default=0) == seq
    assert all(a[1] <= b[0] for a, b in zip(swept, swept[1:], strict=False))
    versions = spark.createDataFrame([("d", bytearray(k.encode()), n) for k in covers for n in (covers[k] - 1, covers[k], covers[k] + 1)], "cf string, key binary, seq long")
    for few in (10, 0):
        left = rangedel.range_deleted(versions, t, few=few, a_part=2).collect()
        assert sorted((bytes(r.key).decode(), r.seq) for r in left) == sorted((k, n) for k in covers for n in (covers[k] - 1, covers[k], covers[k] + 1) if n >= covers[k] or not covers[k])


@pytest.mark.parametrize("upper", [9, 7, 5, 3])
def test_fragments_at_a_snapshot(spark, upper):
    given = CASES["overlap and same start"][0]
    seen = {9: {"a": 0, "c": 8, "e": 8, "i": 0, "j": 4, "m": 4}, 7: {"a": 0, "c": 6, "e": 6, "i": 0, "j": 4, "m": 4}, 5: {"a": 0, "c": 0, "e": 0, "i": 0, "j": 4, "m": 4}, 3: {"a": 0, "c": 0, "e": 0, "i": 0, "j": 2, "m": 0}}[upper]
    swept = list(rangedel.sweep(sorted(((1, lo), (1, hi), s) for lo, hi, s in given if s <= upper)))
    assert {k: max([s for lo, hi, s in swept if lo <= (1, k) < hi], default=0) for k in seen} == seen


@pytest.mark.parametrize(("few", "a_part", "a_task"), [(10_000, 1, 1), (0, 20_000, 2_000_000), (0, 6, 40), (0, 2, 5)])
@pytest.mark.parametrize("kind", ["long", "string", "binary"])
def test_against_brute_force(spark, few, a_part, a_task, kind):
    rnd = random.Random(few + a_part)
    make = {"long": lambda i: i, "string": lambda i: f"{i:03d}", "binary": lambda i: bytearray(f"{i:03d}".encode())}[kind]
    tombs = []
    for s in range(80):
        lo = rnd.choice([rnd.randint(0, 120), 10])
        tombs.append((rnd.choice("abbb"), lo, lo + rnd.choice([-2, 0, 1, 3, 10, 100]), rnd.randint(0, 300)))
    versions = [(rnd.choice("abc"), rnd.choice([rnd.randint(0, 130), 42, 42]), rnd.randint(0, 300), i) for i in range(600)]
    t = spark.createDataFrame([(c, make(max(lo, 0)), make(max(hi, 0)), s) for c, lo, hi, s in tombs] + [(None, make(0), make(999), 999), ("a", None, make(5), 999)], f"cf string, lo {kind}, hi {kind}, seq long")
    v = spark.createDataFrame([(c, make(k), s, i) for c, k, s, i in versions] + [("a", None, 1, -1), (None, make(3), 1, -2)], f"cf string, key {kind}, seq long, i long")
    want = {i for c, k, s, i in versions if not any(c == d and max(lo, 0) <= k < max(hi, 0) and q > s for d, lo, hi, q in tombs)} | {-1, -2}
    got = [r.i for r in rangedel.range_deleted(v, t, few=few, a_part=a_part, a_task=a_task).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pieces_grow_with_tombstones_not_with_parts(spark):
    t = spark.createDataFrame([("d", i, 1_000_000 - i, i) for i in range(64)], "cf string, lo long, hi long, seq long")
    parts = rangedel.Parts([("d", 1000 * i) for i in range(1, 900)])
    pieces, covers = rangedel.cut(t, parts)
    assert pieces.count() <= 128 and covers.count() == 898
    assert rangedel.newest_fragments(pieces).count() <= 2 * 64 + 2
