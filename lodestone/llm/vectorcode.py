"""Compressed vector codes: integer Lloyd rounds over equal parts of the vectors, with Hamerly's two bounds.

A component x becomes floor(scale * x); a vector is cut into equal consecutive parts, and each part position has a codebook
of its own. Beside every vector stand, for each part, its entry, one upper bound on the distance to it and one lower bound
on the distance to the second nearest. When the entries move, the upper bound grows by the move of the own entry and the
lower one shrinks by the largest move among the others. As long as the upper bound is strictly below the lower bound, or
below half the way from the entry to its nearest neighbour, the entry is still the only nearest one and no distance is
taken. Else the upper bound is made exact; if it still fails, the part meets all entries in exact integers, where the lower
index wins a tie. Bounds are rounded outwards, so rounding can only cost a scan.

A round is one pass over the vectors: it writes vectors, entries and bounds to a table in the shared folder, and with them
a row of sums for every entry that the task used, so that the next codebooks come from the small column of sums alone. What
moves through the driver is the codebooks: `entries` times the length of a vector.

Cases: vectors that are null, empty, or hold null or non-finite components take no part; of the others the most frequent
length counts, the longer of equally frequent ones, among lengths that `parts` divides, as vectors of different lengths have
no distance. Components beyond 64 bits count as the nearest 64-bit integer, and so do errors; where 64-bit floats could
round, distances are taken in Python integers. Rows of a null vec_id are coded but come last among the first entries; of
equal vec_ids the smaller vector comes first; repeated rows are coded row by row. With fewer vectors than entries the
codebooks are that much shorter. An empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, written

LONG = (1 << 63) - 1
EXACT = 1 << 53  # integers below it are exact in a 64-bit float


def whole(vectors: DataFrame, parts: int, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v array<long>) of every valid vector whose length is the most frequent one."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double") * F.lit(float(scale)))
    given = F.forall(vec_col, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    edge = lambda e: F.when(e >= float(1 << 63), F.lit(LONG)).when(e < -float(1 << 63), F.lit(-LONG - 1)).otherwise(F.floor(e))
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & (F.size(vec_col) % parts == 0)
    rows = vectors.filter(ok & given).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), x.alias("x"))
    rows = rows.select("id", "label", F.transform("x", edge).alias("v"))
    best = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("v") == (best["size"] if best else 0))


def _exactly(x: np.ndarray, books: list[np.ndarray]) -> bool:
    """Whether all squared distances are exact in 64-bit floats."""
    most = max([1, *(int(max(abs(int(b.max())), abs(int(b.min())))) for b in (x, *books) if b.size)])
    return 4 * most * most * x.shape[1] < EXACT


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, np.inf), np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x, -np.inf), -np.inf)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Codebook:
    """The entries of one part position, how far each moved last, and half the way to its nearest neighbour."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        big = entries.astype(object)
        k = len(entries)
        self.entries = entries
        self.half = np.full(k, np.inf)
        if k > 1:
            apart = np.array([[int(((a - b) ** 2).sum()) for b in big] for a in big], object) if not _exactly(entries, [entries]) else _squares(entries, entries)
            np.fill_diagonal(apart, np.inf if apart.dtype != object else 1 << 200)
            self.half = _down(_root(apart.min(axis=1)) / 2)
        self.move = None if before is None else _up(_root(np.array([int(((a - b) ** 2).sum()) for a, b in zip(big, before.astype(object), strict=True)], object)))
        if self.move is not None:
            order = np.argsort(-self.move, kind="stable")
            self.most = np.full(k, self.move[order[0]])
            self.most[order[0]] = self.move[order[1]] if k > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, its squared distance, the squared distance to the nearest other entry) by meeting all entries."""
        d = _squares(x, self.entries)
        a = d.argmin(axis=1)  # the first of equals
        rows = np.arange(len(x))
        near = d[rows, a]
        if len(self.entries) == 1:
            return a, near, np.full(len(x), np.inf)
        d[rows, a] = np.inf if d.dtype != object else 1 << 200
        return a, near, d.min(axis=1)

    def own(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Squared distance to the given entries."""
        if _exactly(x, [self.entries]):
            return ((x - self.entries[a]) ** 2).sum(axis=1)
        return ((x.astype(object) - self.entries.astype(object)[a]) ** 2).sum(axis=1)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries, as floats where those are exact."""
    if _exactly(x, [entries]):
        xf, ef = x.astype(np.float64), entries.astype(np.float64)
        return (xf * xf).sum(axis=1)[:, None] - 2.0 * (xf @ ef.T) + (ef * ef).sum(axis=1)[None, :]
    ef, out = entries.astype(object), np.empty((len(x), len(entries)), object)
    for i, row in enumerate(x.astype(object)):
        out[i] = ((ef - row) ** 2).sum(axis=1)
    return out


def assigned(x: np.ndarray, book: Codebook, a: np.ndarray | None, u: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (entries, upper bounds, lower bounds, parts that met all entries); bounds are those before the last move."""
    if a is None:
        a, near, other = book.scan(x)
        return a, _up(_root(near)), _down(_root(other)), len(x)
    a, u, low = a.copy(), _up(u + book.move[a]), _down(low - book.most[a])
    bar = np.maximum(low, book.half[a])
    doubt = np.flatnonzero(~(u < bar))
    if len(doubt):
        u[doubt] = _up(_root(book.own(x[doubt], a[doubt])))
        doubt = doubt[~(u[doubt] < bar[doubt])]
    if len(doubt):
        a[doubt], near, other = book.scan(x[doubt])
        u[doubt], low[doubt] = _up(_root(near)), _down(_root(other))
    return a, u, low, len(doubt)


STATE = "id long, v array<long>, entry array<int>, upper array<double>, lower array<double>, error decimal(38,0), scanned int"
SUMS = "part int, code int, place int, n long, total decimal(38,0)"


def _pass(rows: DataFrame, books: list[Codebook], first: bool, last: bool) -> DataFrame:
    """One round over all rows: state rows, and at a task's end its sums by part, entry and place (state columns null)."""
    label_type = rows.schema["label"].dataType.simpleString()
    m, width = len(books), books[0].entries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b.entries), np.int64) for b in books]
        total = [np.zeros(b.entries.shape, object) for b in books]
        names = ["label", *(x.split()[0] for x in (*STATE.split(", "), *SUMS.split(", ")))]
        label_arrow = None
        for b in batches:
            label_arrow = b.schema.field("label").type
            k = b.num_rows
            if not k:
                continue
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(k, m * width)
            before = None if first else [b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(k, m) for c in ("entry", "upper", "lower")]
            a, u, low = np.empty((k, m), np.int32), np.empty((k, m)), np.empty((k, m))
            error, scanned = np.zeros(k, object), 0
            for p, book in enumerate(books):
                x = v[:, p * width : (p + 1) * width]
                a[:, p], u[:, p], low[:, p], met = assigned(x, book, *([None] * 3 if first else (c[:, p] for c in before)))
                scanned += met
                if last:
                    error += np.array([int(e) for e in book.own(x, a[:, p])], object)
                else:
                    safe = x if k * int(max(abs(int(x.max())), abs(int(x.min())))) < LONG else x.astype(object)
                    part = np.zeros(book.entries.shape, safe.dtype)
                    np.add.at(part, a[:, p], safe)
                    total[p] += part.astype(object)
                    n[p] += np.bincount(a[:, p], minlength=len(n[p]))
            lists = lambda x, t: pa.ListArray.from_arrays(np.arange(0, k * x.shape[1] + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), t))
            met = np.zeros(k, np.int32)
            met[0] = scanned
            state = [b.column("label"), b.column("id"), b.column("v"), lists(a, pa.int32()), lists(u, pa.float64()), lists(low, pa.float64()), pa.array(error.tolist(), pa.decimal128(38, 0)) if last else pa.nulls(k, pa.decimal128(38, 0)), pa.array(met)]
            none = [pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))]
            yield pa.record_batch([*state, *none], names=names)
        used = [(p, c) for p in range(m) for c in np.flatnonzero(n[p]).tolist()]
        if used:
            k = len(used) * width
            state = [pa.nulls(k, t) for t in (label_arrow, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.decimal128(38, 0), pa.int32())]
            part, code = (np.repeat([x[i] for x in used], width).astype(np.int32) for i in (0, 1))
            sums = [pa.array(part), pa.array(code), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))), pa.array(np.repeat([n[p][c] for p, c in used], width)), pa.array([int(t) for p, c in used for t in total[p][c]], pa.decimal128(38, 0))]
            yield pa.record_batch([*state, *sums], names=names)

    return rows.mapInArrow(run, f"label {label_type}, {STATE}, {SUMS}")


def _moved(table: DataFrame, entries: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry's componentwise floor(sum / count) over its parts; unused entries stay."""
    out = [e.copy() for e in entries]
    for r in table.filter("part IS NOT NULL").groupBy("part", "code", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["part"]][r["code"], r["place"]] = int(r["total"]) // r["n"]
    return out


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256, codes array<int>) of every valid vector."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    rows = whole(vectors, parts, scale, id_col, vec_col, label_col)
    spark = rows.sparkSession
    seeds = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not seeds:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string, codes array<int>")
    start = np.array([r["v"] for r in seeds], np.int64)
    width = start.shape[1] // parts
    now = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    before: list[np.ndarray | None] = [None] * parts
    state = None
    for k in range(rounds + 1):
        books = [Codebook(e, b) for e, b in zip(now, before, strict=True)]
        last = k == rounds
        src = rows if state is None else state.filter("part IS NULL").select("label", "id", "v", "entry", "upper", "lower")
        new = _pass(src, books, state is None, last)
        new = written(new.select("label", "id", F.col("entry").alias("codes"), F.least(F.col("error"), F.lit(LONG)).cast("long").alias("error")) if last else new, f"codes-{k}")
        if state is not None:
            discard(state)
        state = new
        if not last:
            before, now = now, _moved(state, now)
    text = ",".join(str(int(c)) for e in now for row in e for c in row)
    digest = hashlib.sha256(text.encode()).hexdigest()
    by_label = state.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error"))
    by_label = written(by_label.withColumnRenamed("label", "_label"), "label-errors")  # a table of its own, so that a frequent label's side of the join can be split
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return state.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "codes")
