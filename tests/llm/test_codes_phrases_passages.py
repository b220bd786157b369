"""Vector codes, collocations and repeated passages against brute force and SQL, with the odd cases."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, substring, vectorcode
from lodestone.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<double>, label int"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def docs(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOC)
    for c in ("chunk", "body", "bucket", "items", "phrase", "words", "n", "kept", "label_error", "_at"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_collocations", "op13_substring_dedup"])
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE[name])
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in order) for r in rel.fetchall())))


# op11


def lloyd(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Plain Lloyd rounds in Python integers: (codes, error) by row, and the last codebooks."""
    rows = [[min(max(int(np.floor(x * scale)) if abs(x) < 1e300 else int(x), -(2**63)), 2**63 - 1) for x in v] for v in rows]
    w = len(rows[0]) // parts
    books = [[r[p * w : p * w + w] for r in rows[:entries]] for p in range(parts)]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for r in rows:
                own[nearest(p, r[p * w : p * w + w])[0]].append(r[p * w : p * w + w])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [[nearest(p, r[p * w : p * w + w]) for p in range(parts)] for r in rows]
    return [([k for k, _ in f], sum(d for _, d in f)) for f in found], books


@pytest.mark.parametrize("scale", [1.0, 1e15])
def test_codes_brute_force(spark, scale):
    rnd = random.Random(3)
    rows = [[rnd.choice([0.0, 0.25, -1.5, rnd.gauss(0, 1)]) * scale for _ in range(8)] for _ in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame([(i, v, None if i % 3 else i % 2) for i, v in enumerate(rows)], VECTORS).repartition(5)
    got = sorted(vectorcode.compress(df, entries=7).collect())
    want, books = lloyd(rows, entries=7)
    assert [(list(r.codes), r.error) for r in got] == [(c, min(e, 2**63 - 1)) for c, e in want]
    assert [r.code for r in got] == ["".join(f"{k:02x}" for k in c) for c, _ in want]
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}
    sums = collections.Counter()
    for i, (_, e) in enumerate(want):
        sums[None if i % 3 else i % 2] += min(e, 2**63 - 1)
    assert [r.label_error for r in got] == [min(sums[None if i % 3 else i % 2], 2**63 - 1) for i in range(len(rows))]


def test_bounds_spare_scans():
    rnd = np.random.default_rng(1)
    x = np.floor(rnd.normal(0, 1024, (3000, 16))).astype(np.int64) + 20_000 * np.eye(16, dtype=np.int64)[rnd.integers(0, 16, 3000)]
    book = vectorcode.Codebook(x[:40], None)
    a, u, low, met = vectorcode.assigned(x, book, None, None, None)
    assert met == 3000
    total = 0
    for _ in range(6):
        new = np.array([x[a == k].sum(axis=0) // max(1, (a == k).sum()) if (a == k).any() else book.entries[k] for k in range(40)])
        book = vectorcode.Codebook(new, book.entries)
        a, u, low, met = vectorcode.assigned(x, book, a, u, low)
        total += met
        assert (a == ((x[:, None, :] - new[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        d = np.sqrt(((x - new[a]) ** 2).sum(axis=1))
        assert (u >= d).all()
    assert total < 6 * 3000 * 0.8


def test_codes_ties_go_to_the_lower_index(spark):
    rows = [(1, [0.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 4, 1), (4, [1.0] * 4, 2)]
    got = {r.vec_id: r.code for r in vectorcode.compress(spark.createDataFrame(rows, VECTORS), entries=2, rounds=0).collect()}
    assert got == {1: "00000000", 2: "01010101", 3: "00000000", 4: "00000000"}


def test_codes_odd_rows(spark):
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [0.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0, 9.0], None), (1, None, 1), (2, [1.0, None, 3.0, 4.0], 1), (3, [1.0, float("nan"), 3.0, 4.0], 1)]
    rows += [(4, [float("inf"), 2.0, 3.0, 4.0], 1), (6, [], 1), (7, [1.0, 2.0, 3.0], 1), (8, [1.0] * 8, 1), (9, [1e300, -1e300, 0.0, 0.0], 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("v", F.lit(2)).withColumn("error", F.lit(3))
    got = vectorcode.compress(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id) for r in got) == [-1, 5, 5, 9]
    assert {r.vec_id: r.code[:2] for r in got if r.vec_id != 5} == {9: "02", None: "01"}  # components are ordered as seeds: 5, 5, 9, null
    assert sorted(r.error for r in got) == [0, 0, 0, 0]
    assert vectorcode.compress(df.limit(0)).count() == 0
    assert vectorcode.compress(df.filter("vec_id = 1")).count() == 0


def test_frequent_label(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*[(F.col("id") * k % 17).cast("double") for k in range(1, 9)]).alias("embedding"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id").cast("int")).alias("label"))
    got = vectorcode.compress(df, entries=16).collect()
    assert {r.label_error for r in got if r.vec_id % 3} == {sum(r.error for r in got if r.vec_id % 3)}


# op12


def phrases(rows, least, most=2000):
    """Straight from the definition: every longer phrase is looked at."""
    from re import split

    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in split("[.,;:!?\x0a-\x0d]", lower):
            w = [x for x in split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = collections.defaultdict(list)
    inside = lambda x, y: any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
    big = [(lang, p, a) for (lang, p), a in f.items() if len(p) > 1 and a >= least]
    for lang, p, a in big:
        s, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not any(x == lang and len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for x, q, b in big):
            out[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:most]))


def made(seed, n):
    rnd = random.Random(seed)
    words = ["New", "york", "the", "of", "été", "a", "A", "x y", "\x00", "日本", "b-c", "d"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \r\n", "!"]) for _ in range(rnd.randint(0, 60)))
    return [(i, text() + "new york city hall" * (i % 3), rnd.choice(["en", "en", "en", None, "und", "fr"])) for i in range(n)] + [(n, None, "en"), (n, "", None), (n + 1, " \t. ", "xx")]


@pytest.mark.parametrize(("least", "most"), [(3, 2000), (2, 7), (300, 2000)])
def test_collocations_brute_force(spark, least, most):
    rows = made(1, 60)
    got = collocations.collocations(docs(spark, rows).repartition(3), least=least, most=most).collect()
    want = phrases(rows, least, most)
    assert sorted(tuple(r) for r in got) == want
    assert least > 100 or len(want) > 20


def test_collocations_in_small_chunks(spark):
    rows = made(2, 40)
    whole = collocations.counted(docs(spark, rows), least=3).collect()
    small = collocations.counted(docs(spark, rows).repartition(4), least=3, chunk_bytes=200, bucket_bytes=50).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, small))


def test_collocations_long_repeated_empty(spark):
    long = "wort " * 60_000
    got = collocations.collocations(docs(spark, [(1, long, "de"), (1, long, "de")])).collect()
    assert [tuple(r) for r in got] == [("de", 1, "wort wort wort wort", 119994, 120000, 119996, 120000, 999966)]
    assert collocations.collocations(docs(spark, [])).count() == 0
    assert collocations.collocations(docs(spark, [(1, None, None)])).count() == 0


def test_score_beyond_64_bits(spark):
    a, left, right = 9_000_000_000_000_000_001, 9_000_000_000_000_000_007, 9_000_000_000_000_000_003
    df = spark.createDataFrame([(a, left, right), (1, 1, 1), (1, 3, 4)], "a long, l long, r long")
    assert [r.s for r in df.select(collocations.score("a", "l", "r").alias("s")).collect()] == [2_000_000 * a // (left + right), 1_000_000, 285714]


def test_ranks_of_one_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 50 > 0, "en").otherwise("fr").alias("lang"), (F.col("id") * 7919 % 5003).alias("score"))
    got = collocations.ranked(df.repartition(8), [F.desc("score")], "lang", 300).collect()
    want = {lang: sorted((r.score for r in df.collect() if r.lang == lang), reverse=True)[:300] for lang in ("en", "fr")}
    assert all([r.score for r in sorted(got, key=lambda r: r.rank) if r.lang == lang] == want[lang] and sorted(r.rank for r in got if r.lang == lang) == list(range(1, len(want[lang]) + 1)) for lang in want)


# op13


def passages(rows, window=20):
    """Straight from the definition: (doc, words, removed places) by row."""
    key = lambda i: (i is None, i or 0)
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t, _ in rows]
    for i, w in texts:
        for s in range(len(w) - window + 1):
            p = tuple(w[s : s + window])
            first[p] = min(first.get(p, (key(i), s)), (key(i), s))
    out = []
    for i, w in texts:
        gone = {x for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < (key(i), s) for x in range(s, s + window)}
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def repeated(seed, n, window):
    rnd = random.Random(seed)
    shared = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 50)) for _ in range(rnd.randint(window // 2, 4 * window))] for _ in range(8)]
    out = []
    for i in range(n):
        w = []
        for _ in range(rnd.randint(0, 4)):
            w += rnd.choice(shared)[rnd.randint(0, 5) :]
            w += [f"own{i}-{rnd.randint(0, 9)}" for _ in range(rnd.randint(0, 2))]
        out.append((rnd.choice([i, i, i, 7, None]), rnd.choice([" ", "\n", "\t "]).join(w), "en"))
    return out + [(100, "a b " * 60, "en"), (101, "b a " * 60, "en"), (5, None, "en"), (6, "", None), out[0], out[1]]


@pytest.mark.parametrize(("window", "chunk", "bucket"), [(20, 8 << 20, 2 << 20), (20, 300, 100), (21, 500, 200), (2, 400, 300), (5, 8 << 20, 1000)])
def test_passages_brute_force(spark, window, chunk, bucket):
    rows = repeated(window, 50, window)
    got = substring.repeats(docs(spark, rows).repartition(4), window, chunk_bytes=chunk, bucket_bytes=bucket).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == passages(rows, window)
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got)


def test_passages_large_group_and_long_text(spark):
    common = " ".join(f"w{k}" for k in range(30))
    long = " ".join(f"x{k}" for k in range(60_000))
    rows = [(i, f"{common} mine{i}", "en") for i in range(300)] + [(1000, long, "en"), (1001, "start " + long, "en")]
    got = {r.doc_id: r for r in substring.repeats(docs(spark, rows).repartition(7), chunk_bytes=2000, bucket_bytes=5000).collect()}
    assert [got[i].n_removed for i in (0, 1, 299, 1000, 1001)] == [0, 30, 30, 0, 60_000]
    assert got[1].kept == "mine1" and got[1001].kept == "start"
    assert substring.repeats(docs(spark, [])).count() == 0
