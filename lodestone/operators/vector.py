"""Vector search: exact nearest neighbours of a query set, and an inverted file over trained centroids.

Vectors are dealt into blocks of bounded size; a task holds one block while the queries that are sent to it stream past in
batches, and gives each query its k nearest of the block. The exact search sends every query to every block; the inverted
file sends a query to the blocks of its nearest lists only. A list with many vectors is several blocks, so none is one task's.

Centroids are trained by Lloyd rounds over all vectors as integers (floor of scale times a component), so that training gives
the same centroids however rows are dealt; a task sends a sum for each centroid it used. The lists are written in order of
their centroid, and a search reads the written lists.

A row is known by its number in a written table: rows that share an id are queries and candidates of their own, and only the
row itself is not its own neighbour. Vectors that are null, empty or hold null or non-finite components take no part, nor do
those of another length than the most frequent one. Ties in the rounded distance go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import scratch

MOST_CENTROIDS = 65_536  # of what training sends to every task


def l2(a: Column, b: Column) -> Column:
    """Squared distance, rounded to 6 digits so that ties are stable."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.round(F.aggregate(d, F.lit(0.0), lambda s, x: s + x), 6)


def _kept(df: DataFrame, label: str, order: str | None = None) -> DataFrame:
    at = scratch.path(df.sparkSession, label)
    (df.repartitionByRange(order).sortWithinPartitions(order) if order else df).write.parquet(at)
    return df.sparkSession.read.parquet(at)


def numbered(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, id, v array<double>) of the valid vectors as a written table."""
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda e: e.cast("double")).alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.filter(F.size("v") == (usual["n"] if usual else 0))
    return _kept(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


def _matrix(b: pa.RecordBatch, name: str = "v") -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _search(dealt: DataFrame, k: int, batch: int = 1024, pairs: int = 1 << 19) -> DataFrame:
    """(query_id, vec_id, dist) from rows (block, side, row, id, v): side 0 is held, side 1 asks. Of `pairs` of the two the
    distances are held at once, or of one query and all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, ready = None, None

        def ask(own: np.ndarray, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            row, vec, x, xx = ready
            near = (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T) + xx[None, :]
            near[own[:, None] == row[None, :]] = np.inf
            most = min(k, len(row)) - 1
            bound = np.partition(near, most, axis=1)[:, most]
            a, b = np.nonzero(near <= (bound + 1e-6 * (1 + np.abs(bound)))[:, None])  # what rounding could let in
            fine = np.isfinite(near[a, b])
            a, b = a[fine], b[fine]
            dist = np.round(((q[a] - x[b]) ** 2).sum(axis=1), 6)
            order = np.lexsort((vec[b], dist, a))
            a, b, dist = a[order], b[order], dist[order]
            first = np.searchsorted(a, a, side="left")
            top = np.arange(len(a)) - first < k
            a, b, dist = a[top], b[top], dist[top]
            return pa.record_batch([pa.array(own[a]), pa.array(ids[a]), pa.array(vec[b]), pa.array(dist)], names=["query_row", "query_id", "vec_id", "dist"])

        for whole in batches:
            key = whole.column("block").to_numpy() * 2 + whole.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                block, side = divmod(int(key[s]), 2)
                if block != now:
                    held, ready, now = [], None, block
                for at in range(s, e, batch):
                    part = whole.slice(at, min(batch, e - at))
                    row, ids, v = part.column("row").to_numpy(), part.column("id").to_numpy(zero_copy_only=False), _matrix(part)
                    if not side:
                        held.append((row, ids, v))
                    elif held or ready:
                        if ready is None:
                            r, i, x = (np.concatenate(c) for c in zip(*held, strict=True))
                            ready, held = (r, i, x, (x * x).sum(axis=1)), []
                        few = max(1, pairs // len(ready[0]))
                        for j in range(0, len(row), few):
                            yield ask(row[j : j + few], ids[j : j + few], v[j : j + few])

    met = dealt.repartition("block").sortWithinPartitions("block", "side").mapInArrow(run, "query_row long, query_id long, vec_id long, dist double")
    w = Window.partitionBy("query_row").orderBy("dist", "vec_id")
    return met.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("query_id", "vec_id", "dist")


def knn(rows: DataFrame, queries: DataFrame, k: int, block: int = 50_000) -> DataFrame:
    """The k nearest other rows of each query; both are rows of one numbered() table."""
    blocks = max(1, -(-rows.count() // block))
    held = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), F.lit(0).alias("side"), "row", "id", "v")
    ask = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("side"), "row", "id", "v")
    return _search(held.unionByName(ask), k)


def whole(v: Column, scale: int) -> Column:
    return F.transform(v, lambda e: F.floor(e * F.lit(float(scale))))


def _far(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows to integer centroids; exact below 2 ** 53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centers.T) + (centers * centers).sum(axis=1)[None, :]


def trained(rows: DataFrame, lists: int, rounds: int = 4, scale: int = 1024) -> np.ndarray:
    """Integer centroids: first the `lists` rows least by md5 of their id, then the floored means of their nearest rows."""
    if lists > MOST_CENTROIDS:
        raise ValueError(f"at most {MOST_CENTROIDS} centroids are sent to every task; use more levels")
    x = rows.select("id", whole(F.col("v"), scale).alias("x"))
    seeds = x.orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id", "x").limit(lists).collect()
    centers = np.array([r["x"] for r in seeds], np.float64)
    for _ in range(rounds if len(seeds) else 0):

        def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray = centers) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
            for b in batches:
                v = _matrix(b, "x")
                near = _far(v.astype(np.float64), c).argmin(axis=1)
                np.add.at(total, near, v)
                n += np.bincount(near, minlength=len(c))
            used = np.flatnonzero(n)
            if len(used):
                d = c.shape[1]
                yield pa.record_batch([pa.array(np.repeat(used, d)), pa.array(np.tile(np.arange(d), len(used))), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], d))], names=["list", "place", "total", "n"])

        found = x.mapInArrow(sums, "list long, place long, total long, n long").groupBy("list", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        centers = centers.copy()
        for r in found.collect():  # as many rows as the centroids have components
            centers[r["list"], r["place"]] = r["total"] // r["n"]
    return centers


def _nearest(v: Column, centers: np.ndarray, probes: int, scale: int) -> Column:
    """The `probes` nearest lists of a vector, nearest first, ties to the lower."""

    @F.pandas_udf("array<int>")
    def near(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        d = _far(np.floor(np.stack(x.to_numpy()) * scale), centers)
        return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return near(v)


class InvertedFile:
    """Written lists (list, block, row, id, v) of the rows whose nearest centroid is theirs."""

    def __init__(self, rows: DataFrame, lists: int, rounds: int = 4, scale: int = 1024, block: int = 50_000):
        self.scale, self.centers = scale, trained(rows, lists, rounds, scale)
        if not len(self.centers):
            self.lists, self.sizes = rows.withColumn("list", F.lit(0)).withColumn("block", F.lit(0).cast("long")), []
            return
        near = rows.withColumn("list", _nearest(F.col("v"), self.centers, 1, scale)[0])
        self.lists = _kept(near, "lists", "list")
        self.sizes = [(r["list"], -(-r["count"] // block)) for r in self.lists.groupBy("list").count().collect()]  # a row a centroid

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, vec_id, dist): the k nearest other rows in the query's `probes` nearest lists."""
        if not len(self.centers):
            return queries.selectExpr("id AS query_id", "id AS vec_id", "CAST(0 AS DOUBLE) AS dist").limit(0)
        most = 1 << 20  # blocks of a list are numbered from list * most on
        pieces = F.create_map(*[F.lit(x) for s in self.sizes for x in s])[F.col("list")] if len(self.sizes) <= 256 else None
        spark = queries.sparkSession
        sizes = spark.createDataFrame(self.sizes, "list int, pieces int")
        with_pieces = lambda df: df.withColumn("pieces", pieces) if pieces is not None else df.join(F.broadcast(sizes), "list")
        held = with_pieces(self.lists).select((F.col("list") * F.lit(most).cast("long") + F.pmod(F.xxhash64("row"), "pieces")).alias("block"), F.lit(0).alias("side"), "row", "id", "v")
        ask = queries.withColumn("list", F.explode(_nearest(F.col("v"), self.centers, probes, self.scale)))
        ask = with_pieces(ask).filter("pieces IS NOT NULL").select(F.explode(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda p: F.col("list") * F.lit(most).cast("long") + p)).alias("block"), F.lit(1).alias("side"), "row", "id", "v")
        return _search(held.unionByName(ask), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    keys = ["query_id", "vec_id"]
    n = exact.count()
    return exact.select(*keys).intersectAll(found.select(*keys)).count() / n if n else 1.0
