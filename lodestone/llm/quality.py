"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counted over whole texts from Arrow's own bytes. Boosting goes round the features, fitting each time one
shallow tree on the gradient by that feature's bins; the trees of a feature add up to one lookup table. The pairs of
features that best explain what is left get tables too. A score is then the sum of the table cells of a row's bins,
through a logistic.

The model is fitted on at most `max_rows` labelled rows, taken in the order of a hash of their id.

Cases: null and empty texts have the features of an empty text and get a score; very long texts are counted whole; rows of
equal features score alike, so there are no ties to break; an empty table gives no rows; without any labelled row the score is
0.5, with one class only that class's smoothed rate; several labels of one document count as their rounded mean, and
of several texts of one labelled id the smallest is learned; labels of unknown documents are ignored; a null doc_id has no label and held_out null; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, fresh, slices, utf8

FEATURES = ["log_bytes", "upper", "symbols", "exclaims", "bars", "digits", "spaces", "lines_a_word", "word_bytes", "stops_a_word", "unique_words", "repeated_lines", "short_words"]


def _classes() -> np.ndarray:
    own = {"upper": range(65, 91), "lower": range(97, 123), "symbol": b"#$%&*~^<>{}=+@\\/_`", "exclaim": b"!", "bar": b"|", "digit": range(48, 58), "space": b" \t\n\r\x0b\x0c", "line": b"\n", "stop": b".,;:?"}
    out = np.zeros((256, len(own)))
    for i, members in enumerate(own.values()):
        out[list(members), i] = 1
    return out


CLASSES = _classes()


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    hist = np.zeros((len(texts), 256))
    more = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        hist[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        words = t.split()
        distinct = Counter(words)
        lines = [x for x in t.split(b"\n") if x.strip()]
        more[i] = len(words), len(distinct), len(lines) - len(set(lines)), sum(n for w, n in distinct.items() if len(w) < 4)
    size, words = hist.sum(axis=1), np.maximum(more[:, 0], 1)
    upper, lower, symbol, exclaim, bar, digit, space, line, stop = (hist @ CLASSES).T
    n = np.maximum(size, 1)
    return np.column_stack([np.log1p(size), upper / np.maximum(upper + lower, 1), symbol / n, exclaim / n, bar / n, digit / n, space / n, line / words, (size - space) / words, stop / words, more[:, 1] / words, more[:, 2] / (line + 1), more[:, 3] / words])


def _tree(g: np.ndarray, h: np.ndarray, depth: int, smooth: float = 5.0) -> np.ndarray:
    """Values of a shallow tree over ordered bins with gradient sums g and curvature sums h."""
    out = np.full(len(g), g.sum() / (h.sum() + smooth))
    if depth and len(g) > 1:
        gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > g.sum() ** 2 / (h.sum() + smooth) + 1e-9:
            out[:cut], out[cut:] = _tree(g[:cut], h[:cut], depth - 1, smooth), _tree(g[cut:], h[cut:], depth - 1, smooth)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, smooth: float = 5.0) -> np.ndarray:
    """Values of a tree over a grid: one cut along the rows, then one along the columns on either side, the best such cuts."""

    def gain(a: np.ndarray, b: np.ndarray) -> float:
        gl, hl = a.cumsum(), b.cumsum()
        return float((gl**2 / (hl + smooth) + (gl[-1] - gl) ** 2 / (hl[-1] - hl + smooth)).max())

    up_g, up_h, all_g, all_h = g.cumsum(axis=0), h.cumsum(axis=0), g.sum(axis=0), h.sum(axis=0)
    cut = max(range(1, len(g)), key=lambda c: gain(up_g[c - 1], up_h[c - 1]) + gain(all_g - up_g[c - 1], all_h - up_h[c - 1])) if len(g) > 1 else 1
    out = np.empty_like(g)
    for part in (slice(0, cut), slice(cut, None)):
        out[part] = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 1, smooth)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 8, rounds: int = 120, pairs: int = 6, rate: float = 0.15) -> dict:
    """Model of rows x (n, features) and labels y of 0 and 1."""
    base = (y.sum() + 1) / (len(y) + 2)
    model = {"base": float(np.log(base / (1 - base))), "edges": [], "tables": [], "pairs": []}
    if not len(y) or y.min() == y.max():
        return model
    q = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(c, q)) for c in x.T]
    at = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), model["base"])

    def grad() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(len(edges)):
            if len(tables[f]) > 1:
                g, h = grad()
                step = rate * _tree(np.bincount(at[f], g, len(tables[f])), np.bincount(at[f], h, len(tables[f])), 2)
                tables[f] += step
                z += step[at[f]]
    thin = [np.unique(np.quantile(c, np.linspace(0, 1, coarse + 1)[1:-1])) for c in x.T]
    cell = [np.searchsorted(e, c, side="left") for e, c in zip(thin, x.T, strict=True)]
    g, h = grad()
    gains = []
    for a, b in combinations([f for f in range(len(edges)) if len(thin[f])], 2):
        k, n = cell[a] * (len(thin[b]) + 1) + cell[b], (len(thin[a]) + 1) * (len(thin[b]) + 1)
        gains.append(((np.bincount(k, g, n) ** 2 / (np.bincount(k, h, n) + 5)).sum(), a, b))
    grids = [[a, b, np.zeros((len(thin[a]) + 1, len(thin[b]) + 1))] for _, a, b in sorted(gains, reverse=True)[:pairs]]
    for _ in range(rounds // 3):
        for a, b, grid in grids:
            g, h = grad()
            k = cell[a] * grid.shape[1] + cell[b]
            step = rate * _tree2(np.bincount(k, g, grid.size).reshape(grid.shape), np.bincount(k, h, grid.size).reshape(grid.shape))
            grid += step
            z += step[cell[a], cell[b]]
    return model | {"edges": edges, "tables": tables, "thin": thin, "pairs": grids}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores of rows x: table cells added up, through the logistic."""
    z = np.full(len(x), model["base"])
    for e, t, c in zip(model["edges"], model["tables"], x.T, strict=False):
        z += t[np.searchsorted(e, c, side="left")]
    for a, b, grid in model["pairs"]:
        z += grid[np.searchsorted(model["thin"][a], x[:, a], side="left"), np.searchsorted(model["thin"][b], x[:, b], side="left")]
    return 1 / (1 + np.exp(-z))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled rows outside the held-out fold."""
    some = labels.filter(F.col(label).isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.round(F.avg(label)).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # bounded by max_rows
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> dict:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = features(utf8(b, "text"))
            yield pa.record_batch([b.column("y"), *map(pa.array, x.T)], names=["y", *FEATURES])

    rows = labelled(docs, labels, "quality", max_rows).select("text", "y").mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = rows.toPandas()
    return fit(got[FEATURES].to_numpy(float), got["y"].to_numpy(float))


def predict(docs: DataFrame, model: dict, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns of `keep` (default doc_id) with the score (named as `out` says) of every row's whole text."""
    keep = keep or ["doc_id"]
    text, more = ("text", []) if "text" in keep else (own := fresh("text_", [*keep, out]), [F.col("text").alias(own)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.record_batch([*[b.column(c) for c in keep], pa.array(score(model, features(utf8(b, text))))], names=[*keep, out])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *more).mapInArrow(run, f"{kinds}, `{out}` double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = predict(docs, learn(docs, labels, max_rows))
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
