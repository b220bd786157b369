"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased runs of letters; every term of the examples is in the vector space and weighs (1 + ln tf) times its
inverse document frequency over all documents, so the distance is the plain one.

Examples are labelled rows in the order of a hash of their id, at most `max_rows` of them and at most `max_postings`
distinct terms in all, so the index is bounded and can be sent to every task. Examples with like terms share a block, and
the index keeps the greatest weight in each block for every term that several blocks' worth of examples hold. A query adds
up the postings of its other terms, which are short, and bounds the rest by the block maxima; examples are then scored
exactly in the order of their bounds, some at a time, until the next bound is below the k-th cosine. So neighbours are
exact; ties go to the smaller example id. Terms that no example has scale all cosines of a query alike.

Neighbours vote with their cosine, of which each shared term gave a part. Neighbours share topics more than labels, so the
parts count by what a term tells of the label: one plus the root of the likelihood ratio of its document frequencies under
the two labels, if that passes a threshold that grows with the number of terms tried, and a thousandth if not. Votes are
calibrated by an isotonic fit, with straight lines between its steps, on the examples' own leave-one-out votes; texts that
share no term with any example get the smoothed rate of the examples without neighbours.

Cases: null and empty texts have no term and get that rate; without labelled rows every score is 0.1; very long texts are
counted whole; repeated rows are scored alike; several labels of one document count as their rounded mean, and of several
texts of one labelled id the smallest is an example; a null doc_id has no label and held_out null; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, discard, slices, written
from lodestone.llm.quality import labelled

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = 0.1
HARDLY = 1e-3  # what a term counts in a vote that tells nothing of the label


def terms(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _coded(index: dict[str, int], text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers of the known terms of a text and how often each occurs."""
    own = terms(text)
    i, tf = np.unique(np.fromiter(map(index.get, own, repeat(-1)), np.int32, len(own)), return_counts=True)
    known = int(np.searchsorted(i, 0))
    return i[known:], tf[known:].astype(np.int32)


def coded(rows: DataFrame, keep: list[str], vocab: list[str]) -> DataFrame:
    """The columns of `keep` with ids binary and tf binary (32-bit numbers) of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {t: i for i, t in enumerate(vocab)}
        for b in slices(batches, 500):
            own = [_coded(index, t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in keep), *(pa.array([x[c].tobytes() for x in own], pa.binary()) for c in (0, 1))], names=[*keep, "ids", "tf"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, kinds + "ids binary, tf binary")


def vocabulary(examples: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All terms of the examples (doc_id, text, y), the most frequent first, in how many of them each occurs, and with label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            own = [set(terms(t)) for t in b.column("text").to_pylist()]
            y = np.repeat(np.array(b.column("y").to_pylist(), np.int32), [len(s) for s in own])
            yield pa.record_batch([pa.array([t for s in own for t in s], pa.string()), pa.array(y)], names=["term", "y"])

    df = examples.select("text", "y").mapInArrow(run, "term string, y int").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("hit"))
    got = df.toPandas().sort_values(["df", "term"], ascending=[False, True])  # at most max_postings rows
    return got["term"].tolist(), got["df"].to_numpy(np.int64), got["hit"].to_numpy(np.int64)


def document_frequencies(counts: DataFrame, n_terms: int) -> tuple[int, np.ndarray]:
    """Number of coded rows, and in how many each term occurs; a task sends one number a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(n_terms, np.int64)
        for b in batches:
            n += b.num_rows
            df += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])], names=["t", "n"])

    got = counts.select("ids").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    t, n = got["t"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    out = np.zeros(n_terms, np.int64)
    out[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), out


def relevance(df: np.ndarray, hit: np.ndarray, pos: int, n: int) -> np.ndarray:
    """1 + the root of the likelihood ratio for terms (in df of n examples, hit of the pos ones) that go with a label beyond chance, else HARDLY."""
    rate, bar = pos / n if n else 0.0, 2 * math.log(100 * max(1, len(df)))

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)

    llr = 2 * (part(hit, df * rate) + part(df - hit, df * (1 - rate)) + part(pos - hit, (n - df) * rate) + part((n - pos) - (df - hit), (n - df) * (1 - rate)))
    return np.where(llr > bar, 1 + np.sqrt(np.maximum(llr, 0)), HARDLY)


def weights(i: np.ndarray, tf: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Unit vector over the terms i."""
    w = (1 + np.log(tf)) * value[i]
    return w / np.sqrt(w @ w) if len(w) else w


class BlockMaxIndex:
    """Postings of unit vectors by term, and block maxima of all terms in more than `long` of the vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 4, long: float = 1 / 6):
        # terms are numbered by frequency, so the first ones tell the language and kind of a text
        order = sorted(range(len(vectors)), key=lambda d: (vectors[d][0][:12].tolist(), d))
        self.names, self.block, n = np.array(order, np.int64), block, len(order)
        self.at = np.argsort(self.names)
        size = np.array([len(vectors[d][0]) for d in order], np.int64)
        self.start = np.r_[0, size.cumsum()]
        none = np.empty(0)
        self.term = np.concatenate([vectors[d][0] for d in order] + [none]).astype(np.int64)
        self.weight = np.concatenate([vectors[d][1] for d in order] + [none])
        by = np.argsort(self.term, kind="stable")
        self.doc = np.repeat(np.arange(n), size)[by]
        self.post = self.weight[by]
        self.cut = np.searchsorted(self.term[by], np.arange(n_terms + 1))
        self.of = np.arange(n) // block
        blocks = -(-n // block)
        heavy = np.flatnonzero(np.diff(self.cut) > max(4, n * long))
        self.place = np.full(n_terms, -1, np.int32)
        self.place[heavy] = np.arange(len(heavy))
        self.most = np.zeros((len(heavy), blocks))
        for k, t in enumerate(heavy):
            s = slice(self.cut[t], self.cut[t + 1])
            np.maximum.at(self.most[k], self.doc[s] // block, self.post[s])
        self.query = np.zeros(n_terms)
        self.scored = self.searched = 0  # examples scored exactly, and looked at in all

    def _parts(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the terms of these examples, where each example starts among them)."""
        size = self.start[d + 1] - self.start[d]
        first = size.cumsum() - size
        return np.repeat(self.start[d] - first, size) + np.arange(size.sum()), first

    def _exact(self, d: np.ndarray) -> np.ndarray:
        """Cosines of these examples (places in the index) with the laid-out query."""
        at, first = self._parts(d)
        return np.round(np.add.reduceat(self.query[self.term[at]] * self.weight[at], first), 12)

    def search(self, i: np.ndarray, q: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest positive cosine, without `skip`; ties to the smaller number."""
        n = len(self.names)
        if not n or not len(i):
            return np.empty(0, np.int64), np.empty(0)
        place = self.place[i]
        rare, often = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
        lo = self.cut[i[rare]]
        size = self.cut[i[rare] + 1] - lo
        at = np.repeat(lo - (size.cumsum() - size), size)
        at += np.arange(len(at))
        bound = np.bincount(self.doc[at], np.repeat(q[rare], size) * self.post[at], n)
        if len(often):
            bound = bound + (q[often] @ self.most[place[often]])[self.of]
        if skip >= 0:
            bound[self.at[skip]] = 0
        self.query[i] = q
        places, cosines, kth, few = np.empty(0, np.int64), np.empty(0), 0.0, k + k // 2 + 1
        left = (bound > 0) & (self.start[1:] > self.start[:-1])
        while True:
            open_ = np.flatnonzero(left & (bound >= kth - 1e-9))  # in falling order, some at a time
            if len(open_) > few:
                open_ = open_[np.argpartition(-bound[open_], few)[:few]]
            if not len(open_):
                break
            left[open_] = False
            places, cosines = np.concatenate([places, open_]), np.concatenate([cosines, self._exact(open_)])
            kth = float(np.partition(cosines, -k)[-k]) if len(cosines) >= k else 0.0
            few *= 2
        self.query[i] = 0
        self.scored, self.searched = self.scored + len(places), self.searched + n
        d, cos = self.names[places[cosines > 0]], cosines[cosines > 0]
        top = np.lexsort((d, -cos))[:k]
        return d[top], cos[top]


def isotonic(x: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Not falling fit of y over x: the mean place of each step and its smoothed value."""
    prior = y.mean()
    cells: list[list[float]] = []
    for v in np.unique(x):
        hit = y[x == v]
        cells.append([v * len(hit), hit.sum(), len(hit)])
        while len(cells) > 1 and cells[-2][1] / cells[-2][2] >= cells[-1][1] / cells[-1][2]:
            last = cells.pop()
            cells[-1] = [a + b for a, b in zip(cells[-1], last, strict=True)]
    value = np.maximum.accumulate([(c[1] + smooth * prior) / (c[2] + smooth) for c in cells])
    return np.array([c[0] / c[2] for c in cells]), value


class Model:
    """Vocabulary, term values and index of the examples; calibration once it is fitted."""

    def __init__(self, value: np.ndarray, telling: np.ndarray, ids: np.ndarray, y: np.ndarray, counts: list[tuple[np.ndarray, np.ndarray]], k: int = 50):
        self.value, self.k = value, k
        order = np.argsort(ids)
        self.ids, self.y = ids[order], y[order].astype(float)  # ties between examples go by these numbers
        self.index = BlockMaxIndex([(counts[d][0], weights(*counts[d], value)) for d in order], len(value))
        # of a cosine, HARDLY counts as it is; the rest of what telling terms count is looked up in a narrow table
        self.few = np.flatnonzero(telling > HARDLY)
        self.column = np.full(len(value), -1, np.int64)
        self.column[self.few] = np.arange(len(self.few))
        self.told: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for e, d in enumerate(order):
            i, w = counts[d][0], weights(*counts[d], value)
            has = self.column[i] >= 0
            if has.any():
                self.told[e] = self.column[i[has]], w[has] * (telling[i[has]] - HARDLY)
        self.rest, self.at, self.level = UNKNOWN, np.zeros(1), np.full(1, UNKNOWN)

    def vote(self, i: np.ndarray, tf: np.ndarray, own_id: int | None = None) -> tuple[float | None, list[int]]:
        """Share of label 1 among the neighbours by their cosines' telling parts, and their ids; own_id is left out."""
        skip = -1 if own_id is None else int(np.searchsorted(self.ids, own_id))
        q = weights(i, tf, self.value)
        d, cos = self.index.search(i, q, self.k, skip)
        if not len(d):
            return None, []
        say, own = HARDLY * cos, self.column[i]
        if (own >= 0).any():
            mine = np.zeros(len(self.few))
            mine[own[own >= 0]] = q[own >= 0]
            for n, e in enumerate(d.tolist()):
                if e in self.told:
                    at, w = self.told[e]
                    say[n] += mine[at] @ w
        return float((say * self.y[d]).sum() / say.sum()), self.ids[d].tolist()

    def fit(self, votes: list[tuple[float | None, int]]) -> None:
        """Calibration by the examples' leave-one-out votes."""
        own = np.array([v for v, _ in votes if v is not None])
        y = np.array([y for v, y in votes if v is not None], float)
        none = [y for v, y in votes if v is None]
        self.rest = (sum(none) + 0.5 * UNKNOWN) / (len(none) + 0.5)
        self.at, self.level = isotonic(np.round(own, 6), y) if len(own) else (np.zeros(1), np.full(1, self.rest))

    def score(self, i: np.ndarray, tf: np.ndarray) -> tuple[float, list[int]]:
        vote, near = self.vote(i, tf)
        return (self.rest if vote is None else float(np.interp(vote, self.at, self.level))), near


def _pairs(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, t in zip(b.column("ids").to_pylist(), b.column("tf").to_pylist(), strict=True):
        yield np.frombuffer(i, np.int32), np.frombuffer(t, np.int32)


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_postings: int = 1_000_000, k: int = 50) -> tuple[Model, DataFrame]:
    """Index over the labelled rows, term values from all documents, calibration by leave-one-out votes; and the coded documents."""
    rows = written(labelled(docs, labels, "toxic", max_rows).withColumn("o", F.xxhash64("doc_id")), "examples")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            yield pa.record_batch([b.column("o"), pa.array([len(set(terms(t))) for t in b.column("text").to_pylist()], pa.int64())], names=["o", "n"])

    sizes = sorted((r.o, r.n) for r in rows.select("o", "text").mapInArrow(measure, "o long, n long").collect())  # at most max_rows
    fits = np.cumsum([n for _, n in sizes]) <= max_postings
    examples = rows if fits.all() else rows.filter(F.col("o") < sizes[int(np.argmin(fits))][0])
    vocab, ex_df, hit = vocabulary(examples)
    n, pos = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = written(coded(docs, ["doc_id"], vocab), "term_counts")
    total, df = document_frequencies(counts, len(vocab))
    value = np.log((total + 1) / (df + 1)) + 1e-6
    own = written(coded(examples, ["doc_id", "y"], vocab), "coded_examples")
    discard(rows)
    got = own.toPandas()  # at most max_postings numbers
    pairs = [(np.frombuffer(i, np.int32), np.frombuffer(t, np.int32)) for i, t in zip(got["ids"], got["tf"], strict=True)]
    model = Model(value, relevance(ex_df, hit, pos, n), got["doc_id"].to_numpy(np.int64), got["y"].to_numpy(), pairs, k)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes = [model.vote(i, t, d)[0] for d, (i, t) in zip(b.column("doc_id").to_pylist(), _pairs(b), strict=True)]
            yield pa.record_batch([pa.array(votes, pa.float64()), b.column("y")], names=["vote", "y"])

    if len(got):
        model.fit([(r.vote, r.y) for r in own.repartition(-(-len(got) // 500)).mapInArrow(left_out, "vote double, y int").collect()])
    discard(own)
    return model, counts


def assess(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_postings: int = 1_000_000, k: int = 50) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples) of every row."""
    model, counts = learn(docs, labels, max_rows, max_postings, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, list[int]]] = {}  # texts of equal counts are searched once
        for b in slices(batches):
            out = []
            for i, tf in _pairs(b):
                key = i.tobytes() + tf.tobytes()
                if key not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[key] = model.score(i, tf)
                out.append(known[key])
            yield pa.record_batch([b.column("doc_id"), pa.array([s for s, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = counts.mapInArrow(run, f"doc_id {kind}, score double, evidence array<long>")
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
