"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks. A block keeps a list per dimension, sorted by the component, and is read from both ends of
all lists at once, since a query's component may have either sign. A vector is met at the least depth at which any list
shows it; its whole score is then computed (random access). After each depth, an unseen vector's component in a dimension
lies between the two ends reached, which bounds its score for each query; a query stops as soon as that bound is below
its k-th score. A tie could still win by its smaller id, so equality does not stop it.

Each vector moves once, to the task of its block; the queries are sent to every block and stream past it in batches, and a
block gives a query at most k rows; the final ranking is a window over those. No task holds more than one block and one
batch. Every query has to meet every block, so the work grows with queries times vectors; with a fixed share of the rows
as queries that is the square of the rows. What moves is a row for each query and block; a block has as many vectors as
give every core a few blocks, up to `most` (65,536: some 150 MB with its lists at 64 components), so in large tables a query
moves once for every 65,536 vectors.

Scores are exact integers at any size of the components: where 64-bit floats could round, a block is searched in Python
integers. Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor does a null vec_id;
components whose scaled floor is beyond a 64-bit integer count as the nearest one, and so do scores in the result; vectors
of different lengths do not meet; a row is never its own candidate, repeated rows and rows of a repeated id are candidates
and queries of their own; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written


LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, id, v array<long>) of every valid vector as a written table: its number, and floor(scale * x)."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    edge = lambda e: F.when(e >= float(1 << 63), F.lit(LONG)).when(e < -float(1 << 63), F.lit(-LONG - 1)).otherwise(F.floor(e))
    rows = vectors.filter(ok).select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(fine)
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform("x", lambda e: edge(e * float(scale))).alias("v")), "vectors")


class Block:
    """Sorted lists of a block of vectors, met in the order of their least depth."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        n = len(ids)
        order = np.argsort(x, axis=0, kind="stable")
        self.low = np.take_along_axis(x, order, axis=0)  # row t: the t-th smallest component of each dimension
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        depth = np.minimum(rank, n - 1 - rank).min(axis=1)  # where any list first shows a vector, from either end
        met = np.lexsort((ids, depth))
        self.rows, self.ids, self.x, self.depth = rows[met], ids[met], x[met], depth[met]

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, id, score) of the k best of each query in this block; own are the queries' row numbers."""
        n, m = len(self.ids), len(q)
        best = np.full((m, k), -np.inf, self.x.dtype)
        who = np.full((m, k), np.iinfo(np.int64).max)
        live, at, depth = np.arange(m), 0, 1
        while at < n and len(live):
            end = int(np.searchsorted(self.depth, depth, side="left"))  # all vectors shown above this depth
            for s in range(at, end, 2048):
                e = min(s + 2048, end)
                score = q[live] @ self.x[s:e].T
                score[self.rows[s:e][None, :] == own[live][:, None]] = -np.inf
                some = (score >= best[live, -1:]).any(axis=1)
                rows = live[some]
                if len(rows):
                    all_s = np.concatenate([best[rows], score[some]], axis=1)
                    all_i = np.concatenate([who[rows], np.broadcast_to(self.ids[s:e], (len(rows), e - s))], axis=1)
                    if all_s.shape[1] > 4 * k and all_s.dtype != object:  # keep what reaches the k-th score, ties included, before sorting
                        kth = -np.partition(-all_s, k - 1, axis=1)[:, k - 1]
                        width = int((all_s >= kth[:, None]).sum(axis=1).max())
                        near = np.argpartition(-all_s, min(width, all_s.shape[1] - 1), axis=1)[:, :width] if width < all_s.shape[1] else np.broadcast_to(np.arange(all_s.shape[1]), all_s.shape)
                        all_s, all_i = np.take_along_axis(all_s, near, axis=1), np.take_along_axis(all_i, near, axis=1)
                    top = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                    best[rows], who[rows] = np.take_along_axis(all_s, top, axis=1), np.take_along_axis(all_i, top, axis=1)
            at = end
            if at < n:
                hi, lo = self.low[n - 1 - depth], self.low[depth]  # an unseen component lies between
                bound = np.maximum(q[live] * hi, q[live] * lo).sum(axis=1)
                live = live[bound >= best[live, -1]]
            depth *= 2
        place, rank = np.nonzero(best > -np.inf)
        return place, who[place, rank], best[place, rank]


def _arrays(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of a batch, by length of the vectors."""
    v, row, i = b.column("v"), b.column("row").to_numpy(), b.column("id").to_numpy()
    size = v.value_lengths().to_numpy()
    if len(size) and (size == size[0]).all():
        return [(row, i, v.flatten().to_numpy().reshape(-1, size[0]))]
    lists = v.to_pylist()
    return [(row[at], i[at], np.array([lists[k] for k in at], np.int64)) for n in np.unique(size) for at in [np.flatnonzero(size == n)]]


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int | None = None, query_block: int = 2048, most: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors and queries are rows of one written table (row, id, v)."""
    n = vectors.count()
    block = block or min(most, max(4096, -(-n // (4 * vectors.sparkSession.sparkContext.defaultParallelism))))
    blocks = max(1, -(-n // block))
    # rows are dealt by their number, so that a repeated id cannot fill a block
    right = vectors.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("vb"), F.lit(0).alias("side"), "row", "id", "v")
    left = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("vb"), F.lit(1).alias("side"), "row", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)  # vectors of the block, by length
        ready: dict[int, tuple] = {}
        now = -1

        def meet(own: np.ndarray, qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch | None:
            dim = q.shape[1]
            if dim not in ready and dim in held:
                row, i, x = (np.concatenate(p) for p in zip(*held.pop(dim), strict=True))
                ready[dim] = row, i, x, Block(row, i, x.astype(np.float64)), _most(x)
            if dim not in ready:
                return None
            row, i, x, found, most = ready[dim]
            if most * _most(q) * dim < 1 << 53:
                place, who, score = found.search(own, q.astype(np.float64), k)
            else:
                place, who, score = Block(row, i, x.astype(object)).search(own, q.astype(object), k)
                score = np.array([min(max(int(s), -LONG - 1), LONG) for s in score], np.int64)
            return pa.record_batch([pa.array(own[place]), pa.array(qid[place]), pa.array(who.astype(np.int64)), pa.array(score.astype(np.int64))], names=["query_row", "query_id", "vec_id", "score"])

        for whole in batches:
            key = whole.column("vb").to_numpy().astype(np.int64) * 2 + whole.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                vb, side = divmod(int(key[s]), 2)
                if vb != now:
                    held, ready, now = defaultdict(list), {}, vb
                for a in range(s, e, query_block):
                    for row, i, x in _arrays(whole.slice(a, min(query_block, e - a))):
                        if not side:
                            held[x.shape[1]].append((row, i, x))
                        elif (out := meet(row, i, x)) is not None:
                            yield out

    dealt = right.unionByName(left).repartition(blocks, "vb").sortWithinPartitions("vb", "side")
    met = dealt.mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
