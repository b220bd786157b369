"""Operators against plain recomputations: the additive model, whole language-model scores, clashing names of items."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, gru, lmscore, quality

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def best_tree(g, h, lo, hi, depth):
    """The shallow tree over bins lo .. hi - 1 by trying every cut: value of each bin."""
    total = lambda a, b: (sum(g[a:b]), sum(h[a:b]))
    gain = lambda a, b: total(a, b)[0] ** 2 / (total(a, b)[1] + 5)
    if depth and hi - lo > 1:
        cut = max(range(lo + 1, hi), key=lambda c: (gain(lo, c) + gain(c, hi), -c))
        if gain(lo, cut) + gain(cut, hi) > gain(lo, hi) + 1e-9:
            return best_tree(g, h, lo, cut, depth - 1) + best_tree(g, h, cut, hi, depth - 1)
    return [total(lo, hi)[0] / (total(lo, hi)[1] + 5)] * (hi - lo)


def best_grid(g, h):
    """A cut along the rows, then the best cut along the columns on either side, by trying all."""
    cols = len(g[0])
    add = lambda part, x: [sum(x[r][c] for r in part) for c in range(cols)]

    def side(part):
        a, b = add(part, g), add(part, h)
        return max(sum(a[:c]) ** 2 / (sum(b[:c]) + 5) + sum(a[c:]) ** 2 / (sum(b[c:]) + 5) for c in range(1, cols + 1))

    cut = max(range(1, len(g)), key=lambda c: (side(range(c)) + side(range(c, len(g))), -c)) if len(g) > 1 else 1
    out = []
    for part in (range(cut), range(cut, len(g))):
        values = best_tree(add(part, g), add(part, h), 0, cols, 1) if len(part) else None
        out += [values for _ in part]
    return out


def plain_fit(x, y, bins, coarse, rounds, pairs, rate):
    """Boosting in Python lists: (function of a row that gives its score, the pairs used)."""
    base = math.log((sum(y) + 1) / (len(y) + 1 - sum(y)))
    cuts = lambda f, n: sorted(set(np.quantile([r[f] for r in x], np.linspace(0, 1, n + 1)[1:-1]).tolist()))
    fine, thin = [cuts(f, bins) for f in range(len(x[0]))], [cuts(f, coarse) for f in range(len(x[0]))]
    at = lambda edges, v: sum(e < v for e in edges)
    tables = [[0.0] * (len(e) + 1) for e in fine]
    grids = {}

    def z(r):
        return base + sum(t[at(e, v)] for t, e, v in zip(tables, fine, r, strict=True)) + sum(t[at(thin[a], r[a])][at(thin[b], r[b])] for (a, b), t in grids.items())

    def slopes():
        p = [1 / (1 + math.exp(-z(r))) for r in x]
        return [t - q for t, q in zip(y, p, strict=True)], [q * (1 - q) for q in p]

    for _ in range(rounds):
        for f in range(len(fine)):
            if len(tables[f]) > 1:
                g, h = slopes()
                sums = [[0.0] * len(tables[f]) for _ in range(2)]
                for r, a, b in zip(x, g, h, strict=True):
                    sums[0][at(fine[f], r[f])] += a
                    sums[1][at(fine[f], r[f])] += b
                tables[f] = [t + rate * v for t, v in zip(tables[f], best_tree(*sums, 0, len(tables[f]), 2), strict=True)]
    g, h = slopes()

    def cells(a, b, g, h):
        out = [[[0.0] * (len(thin[b]) + 1) for _ in range(len(thin[a]) + 1)] for _ in range(2)]
        for r, u, v in zip(x, g, h, strict=True):
            out[0][at(thin[a], r[a])][at(thin[b], r[b])] += u
            out[1][at(thin[a], r[a])][at(thin[b], r[b])] += v
        return out

    found = []
    for a in range(len(fine)):
        for b in range(a + 1, len(fine)):
            u, v = cells(a, b, g, h)
            found.append((sum(p * p / (q + 5) for m, n in zip(u, v, strict=True) for p, q in zip(m, n, strict=True)), a, b))
    for _, a, b in sorted(found, reverse=True)[:pairs]:
        grids[a, b] = [[0.0] * (len(thin[b]) + 1) for _ in range(len(thin[a]) + 1)]
    for _ in range(rounds // 3):
        for a, b in grids:
            step = best_grid(*cells(a, b, *slopes()))
            grids[a, b] = [[t + rate * v for t, v in zip(m, n, strict=True)] for m, n in zip(grids[a, b], step, strict=True)]
    return (lambda r: 1 / (1 + math.exp(-z(r)))), list(grids)


def test_additive_model_brute_force():
    rnd = random.Random(3)
    x = [[rnd.random(), rnd.choice([0.0, 1.0, 2.0]), rnd.gauss(0, 1), rnd.random() ** 3] for _ in range(90)]
    y = [int((r[0] > 0.5) != (r[2] > 0) or r[3] > 0.7) for r in x]
    for seed in range(3):
        y = [t ^ (rnd.random() < 0.05 * seed) for t in y]
        args = dict(bins=6, coarse=3, rounds=9, pairs=2, rate=0.3)
        score, pairs = plain_fit(x, y, **args)
        model = quality.fit(np.array(x), np.array(y, float), **args)
        assert [(a, b) for a, b, _ in model["pairs"]] == pairs
        rows = x + [[rnd.random() * 2 - 0.5 for _ in range(4)] for _ in range(40)]
        assert np.allclose(quality.score(model, np.array(rows)), [score(r) for r in rows], atol=1e-9)


def test_whole_language_model_score(spark):
    """Each document's score once more, a token at a time in one stream, with the shares of unknown tokens."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(2, 40)]) for _ in range(rnd.randint(0, 90))) + (" rare%d" % i) * (i % 3 == 0), "en", "s", 0) for i in range(60)]
    kept = {}
    learn = lmscore.learn
    try:
        lmscore.learn = lambda table, vocab, *a: kept.setdefault("p", learn(kept.setdefault("t", table), kept.setdefault("v", vocab), *a))
        got = {r.doc_id: r for r in lmscore.score_documents(spark.createDataFrame(rows, DOC), symbols=16, classes=4, hidden=8, shard_tokens=500).collect()}
    finally:
        lmscore.learn = learn
    p, vocab = kept["p"], kept["v"]
    train = [t.split() for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 10]
    counts = {}
    for w in train:
        for x in [*w, ""]:
            counts[x] = counts.get(x, 0) + 1
    for i, t, *_ in rows:
        tokens = [*t.split(), ""]
        sym = [int(vocab.symbols(np.array([lmscore._hash(x.encode())], np.uint64))[0]) for x in tokens]
        model = float(gru.log_likelihood(p, [np.array(sym, np.uint16)], vocab.end, width=1)[0]) / math.log(10)
        other = sum(math.log10(counts.get(x, 0) + 0.1) - vocab.rest for x, s in zip(tokens, sym, strict=True) if s == vocab.unknown)
        assert abs(got[i].score - (model + other)) < 1e-3 * max(1, abs(model))
        n, v = sum(counts.values()), len(counts)
        assert abs(got[i].base_score - sum(math.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)) < 1e-6
        assert (got[i].n_tokens, got[i].n_known) == (len(tokens), sum(x in counts for x in tokens))


def test_items_with_clashing_names(spark):
    item = "what is the name of the long river that runs through the old town and the answer is the blue one of course"
    docs = spark.createDataFrame([(1, f"before it {item} after it"), (2, "nothing of the kind is in here")], "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("found", F.lit(1))
    items = spark.createDataFrame([(7, item)], "item_id long, text string").withColumn("doc_id", F.lit(3)).withColumn("start_word", F.lit("x")).withColumn("score", F.lit("y"))
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(1, 7)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]
