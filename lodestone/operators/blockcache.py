"""Block-cache access statistics. Input: block, size, caller, level, btype, ts, order columns, key_id, is_hit."""

from __future__ import annotations

import math
import pickle
import sys
import zlib
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import scratch

ORDER = ["ts", "o1", "o2", "o3"]


def summary(acc: DataFrame, most: int = 1000) -> DataFrame:
    """Accesses by type, by caller, by caller and level, by caller and type, and the distinct blocks of each.

    A block is a row that says by a bit each with which (type, caller, level) it is met, so the rows are not copied for each
    grouping, and blocks are counted by what they are met with. More kinds than `most` are left to grouping sets.
    """
    by, sets = ["btype", "caller", "level"], [(0,), (1,), (1, 2), (1, 0)]
    kinds = acc.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if not 0 < len(kinds) <= most:
        cols = [[F.col(by[k]) for k in s] for s in sets]
        return acc.groupingSets(cols, *by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"))
    words, groups = [f"_w{k}" for k in range(-(-len(kinds) // 63))], {}
    for at, r in enumerate(kinds):
        for i, s in enumerate(sets):
            g = groups.setdefault((i, *(r[k] if k in s else None for k in range(3))), [0, *[0] * len(words)])
            g[0] += r["n"]
            g[1 + at // 63] |= 1 << at % 63
    spark, long = acc.sparkSession, lambda names: "".join(f", {c} long" for c in names)
    types = ", ".join(f"_{c} {acc.schema[c].dataType.simpleString()}" for c in by)
    bits = spark.createDataFrame([(*r[:3], *(1 << at % 63 if at // 63 == k else 0 for k in range(len(words)))) for at, r in enumerate(kinds)], types + long(words))
    asked = spark.createDataFrame([(*k, *v) for k, v in groups.items()], f"_set int, {types}, n long{long(f'_g{w}' for w in words)}")
    met = acc.filter("block IS NOT NULL").join(F.broadcast(bits), reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by)))
    per = met.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).groupBy(*words).agg(F.count(F.lit(1)).alias("_m"))
    inside = reduce(or_, (F.col(w).bitwiseAND(F.col(f"_g{w}")) != 0 for w in words))
    found = per.crossJoin(F.broadcast(asked)).groupBy("_set", *[f"_{c}" for c in by]).agg(F.sum(F.when(inside, F.col("_m")).otherwise(F.lit(0))).alias("blocks"))
    key = reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_set", *[f"_{c}" for c in by])))
    return asked.alias("a").join(found.alias("b"), key, "left").select(*[F.col(f"a._{c}").alias(c) for c in by], "n", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def size_stats(acc: DataFrame) -> DataFrame:
    q = F.percentile("size", F.array(F.lit(0.5), F.lit(0.95)))
    return acc.groupBy("btype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("mean"), q.alias("q")).select("btype", "n", "mean", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))


def access_counts(acc: DataFrame) -> DataFrame:
    return acc.groupBy("block", "btype").agg(F.count(F.lit(1)).alias("c"))


def access_count_stats(acc: DataFrame) -> DataFrame:
    return access_counts(acc).groupBy("btype").agg(F.count(F.lit(1)).alias("blocks"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("most"), F.round(F.stddev_pop("c"), 6).alias("stddev"))


def data_block_access(acc: DataFrame, keys_in_block: int = 64) -> DataFrame:
    """Percent of a block's keys that are accessed, and percent of accesses that hit, over blocks."""
    per = acc.groupBy("block").agg(F.count_distinct("key_id").alias("k"), F.avg(F.col("is_hit").cast("double")).alias("h"))
    return per.agg(F.round(F.avg(100 * F.col("k") / keys_in_block), 6).alias("pct_keys"), F.round(F.avg(100 * F.col("h")), 6).alias("pct_hits"))


def percent_access(acc: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    """Percent of accesses of each column value within a row value, pivoted."""
    n = acc.groupBy(rows).pivot(cols, values).count()
    total = sum((F.coalesce(F.col(f"`{v}`"), F.lit(0)) for v in values), F.lit(0))
    return n.select(rows, *[F.round(100 * F.coalesce(F.col(f"`{v}`"), F.lit(0)) / total, 6).alias(f"pct_{v}") for v in values])


def count_buckets(acc: DataFrame, limits: list[int]) -> DataFrame:
    """Blocks by access-count bucket (upper limits; last one open) and type."""
    label = F.lit(f">{limits[-1]}")
    for x in reversed(limits):
        label = F.when(F.col("c") <= x, F.lit(f"<={x}")).otherwise(label)
    return access_counts(acc).groupBy(label.alias("bucket"), "btype").agg(F.count(F.lit(1)).alias("blocks"))


def reuse_interval(acc: DataFrame) -> DataFrame:
    """Gaps between accesses of a block: how many by whole gap."""
    w = Window.partitionBy("block").orderBy(*ORDER)
    return acc.withColumn("gap", F.col("ts") - F.lag("ts").over(w)).filter("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def lifetime(acc: DataFrame) -> DataFrame:
    return acc.groupBy("block").agg((F.max("ts") - F.min("ts")).alias("lifetime"))


def reuse_timeline(acc: DataFrame, width: int) -> DataFrame:
    """Share of the blocks of window i that are accessed in a later window j."""
    b = acc.select("block", F.floor(F.col("ts") / width).alias("w")).distinct()
    size = b.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    j = b.alias("x").join(b.alias("y"), (F.col("x.block") == F.col("y.block")) & (F.col("x.w") < F.col("y.w")))
    hit = j.groupBy(F.col("x.w").alias("w"), F.col("y.w").alias("later")).agg(F.count(F.lit(1)).alias("reused"))
    return hit.join(size, "w").select("w", "later", F.round(F.col("reused") / F.col("n"), 6).alias("share"))


def spatial_locality(acc: DataFrame, keys_in_block: int = 64, step: int = 10) -> DataFrame:
    """Blocks by the percent of their keys that are referenced, in steps."""
    per = acc.groupBy("block").agg(F.count_distinct("key_id").alias("k"), F.sum("size").alias("bytes"))
    return per.groupBy((F.floor(100 * F.col("k") / keys_in_block / step) * step).alias("pct")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("bytes").alias("bytes"))


def correlation_features(acc: DataFrame) -> DataFrame:
    """Correlation of past accesses and time since the last one with the time to the next."""
    w = Window.partitionBy("block").orderBy(*ORDER)
    f = acc.select((F.row_number().over(w) - 1).alias("past"), (F.col("ts") - F.lag("ts").over(w)).alias("since"), (F.lead("ts").over(w) - F.col("ts")).alias("until")).filter("since is not null and until is not null")
    return f.agg(F.round(F.corr("past", "until"), 6).alias("past_until"), F.round(F.corr("since", "until"), 6).alias("since_until"))


def skewness(acc: DataFrame, cuts: list[int]) -> DataFrame:
    """Percent of accesses on the top x percent of blocks."""
    by = access_counts(acc).groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(F.desc("c"))  # a row per access count
    run = by.withColumn("b1", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("a1", F.sum(F.col("m") * F.col("c")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = by.agg(F.sum("m").alias("blocks"), F.sum(F.col("m") * F.col("c")).alias("accesses"))
    x = run.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(acc.sparkSession.createDataFrame([(c,) for c in cuts], "pct long")))
    want = F.floor(F.col("blocks") * F.col("pct") / 100)
    part = F.greatest(F.lit(0), F.least(F.col("m"), want - (F.col("b1") - F.col("m")))) * F.col("c")
    return x.groupBy("pct").agg(F.round(100 * F.sum(part) / F.first("accesses"), 6).alias("pct_accesses"))


def miss_ratio(acc: DataFrame, width: int) -> DataFrame:
    """Miss percent and missed bytes by time bucket."""
    miss = F.col("is_hit") == 0
    return acc.groupBy(F.floor(F.col("ts") / width).alias("bucket")).agg(F.round(100 * F.avg(miss.cast("double")), 6).alias("miss_pct"), F.sum(F.when(miss, F.col("size")).otherwise(F.lit(0))).alias("miss_bytes"))


def miss_bytes_summary(acc: DataFrame, width: int) -> DataFrame:
    """Mean and p95 (element min(int(.95 n), n - 1)) of the missed bytes over buckets."""
    m = miss_ratio(acc, width)
    w, n = Window.orderBy("miss_bytes", "bucket"), F.count(F.lit(1)).over(Window.partitionBy())  # a row per bucket
    r = m.withColumn("i", F.row_number().over(w) - 1).withColumn("n", n)
    return r.agg(F.round(F.avg("miss_bytes"), 6).alias("mean"), F.max(F.when(F.col("i") == F.least(F.floor(0.95 * F.col("n")), F.col("n") - 1), F.col("miss_bytes"))).alias("p95"))


def next_access(acc: DataFrame) -> DataFrame:
    """Time of the next access of the same block."""
    return acc.withColumn("next_ts", F.lead("ts").over(Window.partitionBy("block").orderBy(*ORDER)))


def _cut(acc: DataFrame, chunk_rows: int, chunks: int, columns: list[str], packed: bool = False) -> tuple[DataFrame, int]:
    """The accesses as a written table of `columns`, pos, a number that follows their order, and chunk, the range of the
    order that pos >> 33 tells, a folder each; and a bound of the chunks. No task sees the whole trace."""
    n = max(1, min(chunks, -(-acc.count() // chunk_rows)))
    at = scratch.path(acc.sparkSession, "placed")
    own = acc.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).withColumn("pos", F.monotonically_increasing_id())
    own = own.select(*columns, "pos", F.shiftright("pos", 33).alias("chunk"))
    own = _packed(own, columns) if packed else own
    own.write.partitionBy("chunk").parquet(at)
    return acc.sparkSession.read.schema(own.schema).parquet(at), n


PACK = 16_384


def _packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are sorted by pos in each partition, thousands in one: (rows, an Arrow stream of `columns`, pos, the first,
    and chunk). What reads a chunk in order then sorts a row for thousands."""

    def pack(batches):
        for b in batches:
            chunk = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                for at in range(s, e, PACK):
                    part = b.slice(at, min(PACK, e - at)).select(columns)
                    out = pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, part.schema) as w:
                        w.write_batch(part)
                    yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary()), b.column("pos").slice(at, 1), b.column("chunk").slice(at, 1)], names=["rows", "pos", "chunk"])

    return rows.mapInArrow(pack, "rows binary, pos long, chunk long")


def _by_chunk(rows: DataFrame, n: int) -> DataFrame:
    """The n chunks a partition each; by hash several of them would meet in one, the more the longer the trace."""
    return rows.repartitionById(n, F.col("chunk").cast("int"))


def placed(acc: DataFrame, chunk_rows: int = 500_000, chunks: int = 1024) -> tuple[DataFrame, int]:
    """The accesses cut in ranges of their order, with next_pos, the pos of the next access of the same block."""
    rows, n = _cut(acc, chunk_rows, chunks, acc.columns)
    return rows.repartition(n, "block").withColumn("next_pos", F.lead("pos").over(Window.partitionBy("block").orderBy("pos"))), n


def below(y: np.ndarray, w: np.ndarray, upto: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query, the sum of w over the first `upto` places whose y is less than its limit: a merge tree, level by level."""
    values, rank = np.unique(y, return_inverse=True)
    cut, out = np.searchsorted(values, limit), np.zeros(len(upto), np.int64)
    for level in range(len(y).bit_length()):
        ask = np.flatnonzero(upto >> level & 1)
        if not len(ask):
            continue
        key = (np.arange(len(y)) >> level) * (len(values) + 1) + rank
        order = np.argsort(key, kind="stable")
        total = np.r_[0, w[order].cumsum()]
        block = (upto[ask] >> level) - 1
        out[ask] += total[np.searchsorted(key[order], block * (len(values) + 1) + cut[ask])] - total[block << level]
    return out


FAR = 1 << 52  # beyond every pos, and still exact as a float


def reuse_distance(acc: DataFrame, chunk_rows: int = 80_000) -> DataFrame:
    """(block, distance): bytes of the distinct other blocks between two accesses of a block, each at its latest size.

    Exact, in ranges of the order. An access counts between two others if it lies there and its block is not accessed
    again before the later one, which is a sum over a quadrant of (place, next place). Inside a chunk a merge tree gives
    it. Where the earlier access lies in another chunk, the sum is that of what each chunk between left behind (a small
    table over pairs of chunks), of what the earlier access's chunk left behind after it, less what this chunk has touched.
    """
    rows, n = placed(acc, chunk_rows)
    later = F.coalesce(F.shiftright("next_pos", 33), F.lit(n))
    left = rows.filter(later > F.col("chunk")).select("chunk", "pos", "size", "next_pos", later.cast("int").alias("till"))
    mass = np.zeros((n, n + 1), np.int64)
    for r in left.groupBy("chunk", "till").agg(F.sum("size").alias("s")).collect():  # at most a row for two chunks
        mass[r.chunk, r.till] = r.s
    held = mass[:, ::-1].cumsum(axis=1)[:, ::-1]  # what a chunk left behind that is not touched before a later one
    past = np.vstack([np.zeros((1, n + 1), np.int64), held.cumsum(axis=0)])

    def behind(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        c, till, size = int(pdf["chunk"].iloc[0]), pdf["till"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        after = np.arange(1, len(pdf) + 1)
        own = size.sum() - below(till, size, np.full(len(pdf), len(pdf)), till) - (size.cumsum() - below(till, size, after, till))
        out = pd.DataFrame({"pos": pdf["next_pos"], "prev": pdf["pos"], "prev_size": size, "base": own + past[till, till] - past[c + 1, till]})[till < n]
        return out.astype(np.int64)

    first = left.groupBy("chunk").applyInPandas(behind, "pos long, prev long, prev_size long, base long")
    every = rows.join(first, "pos", "left").select("chunk", "pos", "next_pos", "block", "size", "prev", "prev_size", "base")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos, size = pdf["pos"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
        nxt, prev = pdf["next_pos"].fillna(FAR).to_numpy(np.int64), pdf["prev"].fillna(-1).to_numpy(np.int64)
        cross, k = prev >= 0, np.arange(len(pos))
        here = np.searchsorted(pos, nxt)  # the place of the next access, if it is in this chunk
        near = here < len(pos)
        near[near] = pos[here[near]] == nxt[near]
        before = np.full(len(pos), -1)
        before[here[near]] = k[near]
        total = np.r_[0, size.cumsum()]
        live = lambda at, upto: total[upto] - below(nxt, size, upto, pos[at] + 1)
        out = np.zeros(len(pos), np.int64)
        q = np.flatnonzero(before >= 0)
        out[q] = live(q, q) - live(q, before[q] + 1)
        x = np.flatnonzero(cross)
        weight = pdf["prev_size"].fillna(0).to_numpy(np.int64)
        touched = np.r_[0, weight.cumsum()][x] - below(prev, weight, x, prev[x] + 1)
        out[x] = live(x, x) + pdf["base"].fillna(0).to_numpy(np.int64)[x] - touched
        again = cross | (before >= 0)
        return pd.DataFrame({"block": pdf["block"].to_numpy()[again], "distance": out[again]})

    return every.groupBy("chunk").applyInPandas(inside, "block long, distance long")


class _Cache:
    """A cache that is fed its accesses in order, in as many pieces as one likes: all it knows is in its attributes, which
    can be pickled, and grows with what the cache holds, not with the trace. `fields` are the columns of an access."""

    fields: tuple[str, ...] = ("block", "size")

    def __init__(self, capacity: int):
        self.capacity, self.used, self.hits, self.accesses = capacity, 0, 0, 0
        self.cache: dict = {}

    def feed(self, rows) -> None:
        raise NotImplementedError


class _Lru(_Cache):
    touch, newest = True, False

    def feed(self, rows) -> None:
        cache, capacity, used, hits, touch, newest = self.cache, self.capacity, self.used, self.hits, self.touch, self.newest
        for b, s in rows:
            if b in cache:
                hits += 1
                if touch:
                    cache[b] = cache.pop(b)
                continue
            if s > capacity:
                continue
            while used + s > capacity:
                used -= cache.pop(next(reversed(cache)) if newest else next(iter(cache)))
            cache[b] = s
            used += s
        self.used, self.hits = used, hits


class _Fifo(_Lru):
    touch = False


class _Mru(_Lru):
    newest = True


class _Ranked(_Cache):
    """Evicts the least value; value(size, place in the block's accesses, next place, floor) is set at each access, with lazy
    heap entries, of which at most as many are stale as hold."""

    fields = ("block", "size", "nth", "next_pos")

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.heap: list[tuple[float, int]] = []
        self.floor = 0.0

    def feed(self, rows) -> None:
        import heapq

        cache, heap, capacity, used, hits, floor, value = self.cache, self.heap, self.capacity, self.used, self.hits, self.floor, self.value
        for b, s, nth, nxt in rows:
            if b in cache:
                hits += 1
            elif s > capacity:
                continue
            else:
                while used + s > capacity:
                    v, old = heapq.heappop(heap)
                    if old in cache and cache[old][0] == v:
                        used -= cache.pop(old)[1]
                        floor = max(floor, v)
                used += s
            size = cache[b][1] if b in cache else s
            v = value(size, nth, nxt, floor)
            cache[b] = v, size
            heapq.heappush(heap, (v, b))
            if len(heap) > 2 * len(cache) + 64:
                heap[:] = [(x[0], k) for k, x in cache.items()]
                heapq.heapify(heap)
        self.used, self.hits, self.floor = used, hits, floor


class _Lfu(_Ranked):
    @staticmethod
    def value(s, nth, nxt, floor) -> float:
        return float(nth)


class _GdSize(_Ranked):
    fields = ("block", "size", "size", "size")

    @staticmethod
    def value(s, nth, nxt, floor) -> float:
        return floor + 1.0 / max(s, 1)


class _Opt(_Ranked):
    """Evicts the block whose next access is farthest."""

    fields = ("block", "size", "size", "next_pos")

    @staticmethod
    def value(s, nth, nxt, floor) -> float:
        return -float("inf") if nxt is None else -nxt


class _Ghost(_Cache):
    """Admits a block only on its second access within the ghost list, which holds as many bytes of names."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.ghost: dict[int, int] = {}
        self.gused = 0

    def feed(self, rows) -> None:
        cache, ghost, capacity, used, gused, hits = self.cache, self.ghost, self.capacity, self.used, self.gused, self.hits
        for b, s in rows:
            if b in cache:
                hits += 1
                cache[b] = cache.pop(b)
            elif b in ghost:
                gused -= ghost.pop(b)
                while cache and used + s > capacity:
                    used -= cache.pop(next(iter(cache)))
                if s <= capacity:
                    cache[b] = s
                    used += s
            elif s <= capacity:
                while gused + s > capacity:
                    gused -= ghost.pop(next(iter(ghost)))
                ghost[b] = s
                gused += s
        self.used, self.gused, self.hits = used, gused, hits


class _Arc(_Cache):
    """Adaptive replacement by bytes: a recent and a frequent list with ghosts that move the target between them."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.lists: tuple[dict, ...] = ({}, {}, {}, {})
        self.sizes, self.p = [0, 0, 0, 0], 0.0

    def feed(self, rows) -> None:
        (t1, t2, b1, b2), size, capacity, p, hits = self.lists, self.sizes, self.capacity, self.p, self.hits
        lists = self.lists

        def put(k: int, b: int, s: int) -> None:
            lists[k][b] = s
            size[k] += s

        def drop(k: int, b: int) -> int:
            s = lists[k].pop(b)
            size[k] -= s
            return s

        def shrink(need: int, frequent: bool) -> None:
            while size[0] + size[1] + need > capacity and (t1 or t2):
                if t1 and (size[0] > p or frequent and size[0] >= p or not t2):
                    b = next(iter(t1))
                    put(2, b, drop(0, b))
                else:
                    b = next(iter(t2))
                    put(3, b, drop(1, b))

        for b, s in rows:
            if b in t1 or b in t2:
                hits += 1
                put(1, b, drop(0 if b in t1 else 1, b))
                continue
            if s > capacity:
                continue
            if b in b1:
                p = min(capacity, p + s * max(1.0, size[3] / max(1, size[2])))
                drop(2, b)
                shrink(s, False)
                put(1, b, s)
            elif b in b2:
                p = max(0.0, p - s * max(1.0, size[2] / max(1, size[3])))
                drop(3, b)
                shrink(s, True)
                put(1, b, s)
            else:
                while b1 and size[0] + size[2] + s > capacity:
                    drop(2, next(iter(b1)))
                while b2 and sum(size) + s > 2 * capacity:
                    drop(3, next(iter(b2)))
                shrink(s, False)
                put(0, b, s)
        self.p, self.hits = p, hits


class _Slots:
    """Names in slots without gaps, and whole numbers of them in arrays that a sample can index: a slot is filled by the last.
    The numbers are floats, exact below 2 ** 53, so that quotients need no conversion."""

    def __init__(self, columns: int):
        self.names: list = []
        self.table = np.zeros((columns, 256))

    def add(self, name) -> int:
        """A slot for a name, whose numbers are still to be set."""
        at = len(self.names)
        if at == self.table.shape[1]:
            self.table = np.hstack([self.table, np.zeros_like(self.table)])
        self.names.append(name)
        return at

    def drop(self, at: int):
        """Empties a slot; gives the name that moved there, or None."""
        names = self.names
        last, n = names.pop(), len(names)
        if at == n:
            return None
        names[at] = last
        self.table[:, at] = self.table[:, n]
        return last


class _Refused(Exception):
    """A quick run whose draws are not known to be the generator's."""


class _Draws:
    """The numbers that a seeded generator's integers(0, n, k) gives call by call, from 32-bit numbers drawn many at a time:
    the high half of number times n, and the next number where the low half says that n would not come out even."""

    def __init__(self, seed: int):
        self.rng, self.ahead, self.at = np.random.default_rng(seed), np.zeros(0, np.uint64), 0

    def __call__(self, n: int, k: int) -> np.ndarray:
        if n == 1:
            return np.zeros(k, np.int64)
        if self.at + k > len(self.ahead):
            self.ahead, self.at = np.r_[self.ahead[self.at :], self.rng.integers(0, 1 << 32, max(k, 1 << 16), np.uint32).astype(np.uint64)], 0
        at, self.at = self.at, self.at + k
        m = self.ahead[at : self.at] * np.uint64(n)
        low = m.view(np.uint32)[0 if sys.byteorder == "little" else 1 :: 2]
        if low[low.argmin()] < n:
            most = (1 << 32) % n
            bad = np.flatnonzero(low < most)
            if len(bad):  # the one refused goes, and all after it move up
                self.ahead, self.at = np.delete(self.ahead, at + int(bad[0])), at
                return self(n, k)
        return (m >> np.uint64(32)).view(np.int64)

    def rows(self, n: int, k: int) -> np.ndarray:
        """The next n times k of the 32-bit numbers, k a row, which stay the next until `take` takes those of some rows."""
        if self.at + n * k > len(self.ahead):
            more = self.rng.integers(0, 1 << 32, 2 * n * k, np.uint32).astype(np.uint64)
            self.ahead, self.at = np.r_[self.ahead[self.at :], more], 0
        return self.ahead[self.at : self.at + n * k].reshape(n, k)

    def take(self, rows: np.ndarray, ns: list[int]) -> None:
        """Takes the first rows, a row for each of ns, below which its numbers were to fall; raises if one would be refused."""
        n = np.array(ns, np.uint64)[:, None]
        if ((rows[: len(ns)] * n & np.uint64(0xFFFFFFFF)) < np.uint64(1 << 32) % n).any():
            raise _Refused
        self.at += len(ns) * rows.shape[1]


class _Drawing(_Cache):
    """Evicts from seeded samples. Accesses are fed in parts, each first with quick draws, which take 32-bit numbers row by row
    as if the generator refused none; whether it does is looked up for all rows of a part at once. If so (a few parts in a
    hundred), or if rows give out or a sample is short, the part is fed again, from the state it began with, by careful draws."""

    sample = 64
    part = 2048

    def __init__(self, capacity: int, seed: int, columns: int):
        super().__init__(capacity)
        self.draw, self.slots = _Draws(seed), _Slots(columns)

    def feed(self, rows) -> None:
        rows, at = list(rows), 0
        while at < len(rows):
            part = rows[at : at + max(self.part, len(self.cache))]
            began = pickle.dumps({k: v for k, v in vars(self).items() if k != "draw"})  # quick draws leave it as it was
            try:
                drawn, ns = self.draw.rows(len(part) + 256, self.sample), []
                self.run(part, self.quick(iter(drawn), ns))
                self.draw.take(drawn, ns)
            except _Refused:
                vars(self).update(pickle.loads(began))
                self.run(part, lambda n: self.draw(n, min(self.sample, n)))
            at += len(part)

    def quick(self, drawn, ns: list):
        multiply, shift, half, by = np.multiply, np.right_shift, np.array(32, np.uint64), np.array(0, np.uint64)
        some, k, note = np.zeros(self.sample, np.uint64), self.sample, ns.append
        places = some.view(np.int64)

        def draw(n: int) -> np.ndarray:
            row = next(drawn, None)
            if n < k or row is None:
                raise _Refused
            note(n)
            by[()] = n
            multiply(row, by, some)
            shift(some, half, some)
            return places

        return draw

    def run(self, rows, draw) -> None:
        raise NotImplementedError


class _Sampled(_Drawing):
    """Evicts the least worthy of a seeded sample, the first of equals; what `worth` gives says how worthy the sampled slots
    are at a place of the trace. A slot's first number is its size; `came` sets its numbers, `hit` hears of hits."""

    def __init__(self, capacity: int, columns: int):
        super().__init__(capacity, 1, columns)
        self.at = 0

    def run(self, rows, draw) -> None:
        cache, slots, capacity, used, hits, came, hit, add, drop = self.cache, self.slots, self.capacity, self.used, self.hits, self.came, self.hit, self.slots.add, self.slots.drop
        names, worth = slots.names, self.worth()
        for i, (b, s) in enumerate(rows, self.at):
            at = cache.get(b)
            if at is not None:
                hits += 1
                hit(at, s)
                continue
            if s > capacity:
                continue
            while used + s > capacity:
                some = draw(len(names))
                at = some.item(worth(some, i + 1).argmin())
                used -= int(slots.table.item(0, at))
                del cache[names[at]]
                moved = drop(at)
                if moved is not None:
                    cache[moved] = at
            cache[b] = at = add(b)
            came(at, s, i)
            used += s
        self.used, self.hits, self.at = used, hits, self.at + len(rows)


class _Hyperbolic(_Sampled):
    """Hits a unit of time in the cache, by size."""

    def __init__(self, capacity: int):
        super().__init__(capacity, 3)

    def came(self, at: int, s: int, i: int) -> None:
        table = self.slots.table
        table[0, at], table[1, at], table[2, at] = s, 1, i

    def hit(self, at: int, s: int) -> None:
        self.slots.table[1, at] += 1

    def worth(self):
        slots, time, subtract, multiply, divide = self.slots, np.array(0.0), np.subtract, np.multiply, np.divide
        size, count, age = got = np.empty((3, self.sample))

        def worth(some: np.ndarray, now: int) -> np.ndarray:
            nonlocal got, size, count, age
            if len(some) != len(age):
                size, count, age = got = np.empty((3, len(some)))
            slots.table.take(some, 1, got, "clip")
            time[()] = now
            subtract(time, age, age)
            multiply(age, size, age)
            return divide(count, age, age)

        return worth


class _CostClass(_Sampled):
    """Hits of the block's size class and one, by size. Worths are kept by slot and taken anew some time after a hit: that is
    work for all slots, and until it is less than that for the samples met meanwhile, these are taken by themselves."""

    def __init__(self, capacity: int):
        super().__init__(capacity, 2)
        self.by_size, self.wait = np.ones(80), 0

    def came(self, at: int, s: int, i: int) -> None:
        table = self.slots.table
        table[0, at], table[1, at] = s, self.by_size.item(int(s).bit_length()) / s if s else np.inf

    def hit(self, at: int, s: int) -> None:
        self.by_size[int(s).bit_length()] += 1
        self.wait = 1 + len(self.slots.names) // 512

    def of(self, size: np.ndarray) -> np.ndarray:
        return self.by_size.take(np.frexp(size)[1]) / size  # the exponent of a whole number is its length in bits

    def worth(self):
        slots = self.slots

        def worth(some: np.ndarray, now: int) -> np.ndarray:
            if self.wait:
                self.wait -= 1
                if self.wait:
                    return self.of(slots.table[0].take(some))
                n = len(slots.names)
                slots.table[1, :n] = self.of(slots.table[0, :n])
            return slots.table[1].take(some)

        return worth


class _Bandit(_Drawing):
    """Each eviction uses the oldest block or the least used of a seeded sample, as the bandit says, who hears 1 when 64 more
    blocks are gone, and 0 if the block comes back before.

    As long as none comes back, what is heard at the next evictions is known, so `look` plans up to 64 of them at once;
    choose(what is planned, context) gives the arm; settle(k) makes the bandit what it is after k of the plan, and
    learn(arm, context) then hears of one that came back."""

    fields = ("block", "size", "nth", "btype", "level")
    late = 64

    def __init__(self, capacity: int):
        super().__init__(capacity, 2, 1)
        self.place, self.gone, self.ahead, self.planned = {}, {}, self.late, None

    def run(self, rows, draw) -> None:
        cache, slots, place, gone, capacity, used, hits, choose, late = self.cache, self.slots, self.place, self.gone, self.capacity, self.used, self.hits, self.choose, self.late
        names, contexts, plan, k = slots.names, {}, (), 0
        for b, s, nth, btype, level in rows:
            if b in cache:
                hits += 1
                cache[b] = cache.pop(b)
                slots.table[0, place[b]] = nth
                continue
            if b in gone:
                self.settle(k)
                self.ahead, plan, k = max(4, k), (), 0  # where blocks often come back, plans are short
                self.learn(*gone.pop(b))
            if s > capacity:
                continue
            context = contexts.get((btype, level, s))
            if context is None:
                context = contexts[btype, level, s] = float(zlib.crc32(str(btype).encode()) % 2), float(level) / 8, min(1.0, s / capacity)
            while used + s > capacity:
                if k == len(plan):
                    self.settle(k)
                    plan, k = self.look(), 0
                arm = choose(plan[k], context)
                k += 1
                if arm == 0:
                    old = next(iter(cache))
                    at = place.pop(old)
                else:
                    some = draw(len(names))
                    at = some.item(slots.table[0].take(some).argmin())
                    old = names[at]
                    del place[old]
                used -= cache.pop(old)
                moved = slots.drop(at)
                if moved is not None:
                    place[moved] = at
                gone[old] = arm, context
                if len(gone) > late:
                    del gone[next(iter(gone))]
            cache[b] = s
            place[b] = at = slots.add(b)
            slots.table[0, at] = nth
            used += s
        self.settle(k)
        self.used, self.hits = used, hits

    def heard(self) -> tuple[list, np.ndarray]:
        """What is heard up to the last eviction of a plan, in order, and how much of it at each eviction and after the last."""
        self.ahead = min(self.late, 2 * self.ahead)
        at = np.maximum(0, np.arange(self.ahead + 1) - (self.late - len(self.gone)))
        return list(self.gone.values())[: at[-1]], at


class _Thompson(_Bandit):
    """Thompson sampling between the two evictions, seeded."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.arms, self.win, self.loss = np.random.default_rng(1), [1.0, 1.0], [1.0, 1.0]

    def look(self) -> list[int]:
        heard, at = self.heard()
        second = np.r_[0, np.cumsum([arm for arm, _ in heard])][at]
        wins = np.array(self.win[::-1]) + np.stack([second, at - second], 1)
        self.planned = self.arms.bit_generator.state, wins
        drawn = self.arms.beta(wins[:-1], self.loss[::-1])  # as draws of one number each, in this order
        return (drawn[:, 0] > drawn[:, 1]).astype(int).tolist()

    def settle(self, k: int) -> None:
        if self.planned is None:
            return
        (state, wins), self.planned = self.planned, None
        if k < len(wins) - 1:
            self.arms.bit_generator.state = state
            self.arms.beta(wins[:k], self.loss[::-1])
        self.win = wins[k, ::-1].tolist()

    def choose(self, plan: int, context: tuple[float, ...]) -> int:
        return plan

    def learn(self, arm: int, context: tuple[float, ...]) -> None:
        self.loss[arm] += 1


class _LinUcb(_Bandit):
    """Upper confidence bound of each eviction's reward, a ridge model of the context each: one, block type, level, size.

    A model is kept as sums: the upper triangle of one and the products of contexts, and contexts by rewards. A plan has
    their triangular factors (L D L'), of all the sums that it may need at once, by which a bound takes no inverse."""

    width = 0.2

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.sums = np.tile(np.r_[np.eye(4)[np.triu_indices(4)], np.zeros(4)], (2, 1))

    @staticmethod
    def terms(contexts: list[tuple[float, ...]], reward: float) -> np.ndarray:
        x = np.ones((len(contexts), 4))
        x[:, 1:] = np.array(contexts).reshape(-1, 3)
        i, j = np.triu_indices(4)
        return np.hstack([x[:, i] * x[:, j], reward * x])

    @staticmethod
    def factors(sums: np.ndarray) -> np.ndarray:
        a, b, c, d, e, f, g, h, i, j, r0, r1, r2, r3 = np.ascontiguousarray(sums.T)  # rows abcd, efg, hi, j
        p, q, r = b / a, c / a, d / a
        e = e - p * b
        f, g = f - q * b, g - r * b
        s, t = f / e, g / e
        h = h - q * c - s * f
        i = i - r * c - t * f
        u = i / h
        j = j - r * d - t * g - u * i
        r1 = r1 - p * r0
        r2 = r2 - q * r0 - s * r1
        r3 = r3 - r * r0 - t * r1 - u * r2
        return np.array([p, q, r, s, t, u, 1 / a, 1 / e, 1 / h, 1 / j, r0 / a, r1 / e, r2 / h, r3 / j]).T

    def look(self) -> list[tuple]:
        heard, at = self.heard()
        arms, terms = np.array([arm for arm, _ in heard], bool), self.terms([x for _, x in heard], 1.0)
        sums = [np.vstack([own, terms[arms == k]]).cumsum(0) for k, own in enumerate(self.sums)]
        second = np.r_[0, np.cumsum(arms)][at]
        self.planned = sums, at - second, second
        found = self.factors(np.vstack(sums)).tolist()
        return list(zip([found[k] for k in (at - second)[:-1].tolist()], [found[len(sums[0]) + k] for k in second[:-1].tolist()], strict=True))

    def settle(self, k: int) -> None:
        if self.planned is None:
            return
        (sums, *upto), self.planned = self.planned, None
        self.sums = np.array([own[n[k]] for own, n in zip(sums, upto, strict=True)])

    def choose(self, plan: tuple, context: tuple[float, ...]) -> int:
        x1, x2, x3 = context
        (p, q, r, s, t, u, a, b, c, d, m0, m1, m2, m3), (p_, q_, r_, s_, t_, u_, a_, b_, c_, d_, n0, n1, n2, n3) = plan
        y1 = x1 - p
        y2 = x2 - q - s * y1
        y3 = x3 - r - t * y1 - u * y2
        z1 = x1 - p_
        z2 = x2 - q_ - s_ * z1
        z3 = x3 - r_ - t_ * z1 - u_ * z2
        first = m0 + m1 * y1 + m2 * y2 + m3 * y3 + self.width * math.sqrt(a + b * y1 * y1 + c * y2 * y2 + d * y3 * y3)
        return 1 if n0 + n1 * z1 + n2 * z2 + n3 * z3 + self.width * math.sqrt(a_ + b_ * z1 * z1 + c_ * z2 * z2 + d_ * z3 * z3) > first else 0

    def learn(self, arm: int, context: tuple[float, ...]) -> None:
        self.sums[arm] += self.terms([context], 0.0)[0]


class _Hybrid(_Cache):
    """One least-recently-used cache of whole blocks and of single rows of them (a sixteenth of the size); either is a hit."""

    fields = ("block", "size", "key_id")

    def feed(self, rows) -> None:
        cache, capacity, used, hits = self.cache, self.capacity, self.used, self.hits
        for b, s, key in rows:
            row, block = (b, key), (b,)
            found = next((x for x in (row, block) if x in cache), None)
            if found:
                hits += 1
                cache[found] = cache.pop(found)
            for x, n in ((block, s), (row, max(1, s // 16))):
                if x in cache or found == row or n > capacity or x == block and found:
                    continue
                while used + n > capacity:
                    used -= cache.pop(next(iter(cache)))
                cache[x] = n
                used += n
        self.used, self.hits = used, hits


class _Priority(_Cache):
    """Least recently used in two parts: blocks of the type seen first, as index blocks are, may fill a share of the bytes
    before their oldest join the others, which are evicted first."""

    fields = ("block", "size", "btype")
    share = 0.5

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.high, self.low, self.parts, self.best = {}, {}, [0, 0], None

    def feed(self, rows) -> None:
        high, low, used, best, hits, capacity, share = self.high, self.low, self.parts, self.best, self.hits, self.capacity, self.share
        for b, s, btype in rows:
            best = btype if best is None else best
            hit = b in high or b in low
            hits += hit
            if hit:
                own, k = (high, 0) if b in high else (low, 1)
                s = own.pop(b)
                used[k] -= s
            elif s > capacity:
                continue
            while sum(used) + s > capacity:
                k = 1 if low else 0
                own = low if low else high
                used[k] -= own.pop(next(iter(own)))
            if btype == best:
                high[b] = s
                used[0] += s
                while used[0] > share * capacity and len(high) > 1:
                    old = next(iter(high))
                    low[old] = high.pop(old)
                    used[0] -= low[old]
                    used[1] += low[old]
            else:
                low[b] = s
                used[1] += s
        self.best, self.hits = best, hits


POLICIES: dict[str, type[_Cache]] = {
    "lru": _Lru, "fifo": _Fifo, "mru": _Mru, "lfu": _Lfu, "gdsize": _GdSize, "opt": _Opt, "arc": _Arc, "ghost": _Ghost, "hyperbolic": _Hyperbolic, "costclass": _CostClass, "ts": _Thompson, "linucb": _LinUcb,
    "hybrid": _Hybrid, "priority": _Priority,
}


def simulate(acc: DataFrame, configs: list[tuple[str, int]], rate: float = 1.0, chunk_rows: int = 2_000_000) -> DataFrame:
    """Hits and accesses of each (policy, capacity in bytes), each one cache.

    A cache is sequential by nature, so the trace is cut into ranges of its order, and a job for each range feeds it to the
    caches, a task a configuration; between the jobs a cache is a row of a written table. No task sees more than a range, and
    time grows with the trace. `rate` takes that share of the blocks by hash and of the capacity, as in spatial sampling; it
    is in the result, which is then an estimate.
    """
    spark = acc.sparkSession
    fields = sorted({c for name, _ in configs for c in POLICIES[name].fields})
    given = [c for c in fields if c not in ("next_pos", "nth")]
    if rate < 1:
        acc = acc.filter(F.pmod(F.xxhash64("block"), F.lit(1_000_000)) < int(rate * 1_000_000))
    rows, n = _cut(acc.select(*{*given, *ORDER}), chunk_rows, 1 << 20, given, len(given) == len(fields))
    if len(given) < len(fields):
        at, w = scratch.path(spark, "places"), Window.partitionBy("block").orderBy("pos")
        met = rows.repartition(n, "block").withColumn("next_pos", F.lead("pos").over(w)).withColumn("nth", F.row_number().over(w))
        packs = _packed(_by_chunk(met, n).sortWithinPartitions("chunk", "pos").select(*fields, "pos", "chunk"), fields)
        packs.write.partitionBy("chunk").parquet(at)
        rows = spark.read.schema(packs.schema).parquet(at)

    def run(batches):
        now, cache = None, None
        done = lambda: pa.record_batch([pa.array([now]), pa.array([pickle.dumps(cache)]), pa.array([cache.hits]), pa.array([cache.accesses])], names=["i", "state", "hits", "accesses"])
        column = lambda v: v.to_pylist() if v.null_count or not pa.types.is_integer(v.type) else v.to_numpy().tolist()
        for b in batches:
            for i, was, rows in zip(b.column("i").to_pylist(), b.column("state"), b.column("rows"), strict=True):
                if i != now:  # begins with the cache as it was
                    if now is not None:
                        yield done()
                    now, was = i, was.as_py()
                    cache = pickle.loads(was) if was else POLICIES[configs[now][0]](int(configs[now][1] * rate))
                    continue
                for part in pa.ipc.open_stream(rows.as_buffer()):
                    cache.accesses += part.num_rows
                    values = {c: column(part.column(c)) for c in cache.fields}
                    cache.feed(zip(*(values[c] for c in cache.fields), strict=True))
        if now is not None:
            yield done()

    schema = "i long, state binary, hits long, accesses long"
    states = spark.createDataFrame([(i, None, 0, 0) for i in range(len(configs))], schema)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(configs) - 1).cast("long")))
    for c in range(n):
        dealt = rows.filter(F.col("chunk") == c).select(numbers.alias("i"), "pos", "rows")
        fed = states.select("i", F.lit(-1).cast("long").alias("pos"), "state").unionByName(dealt, allowMissingColumns=True)
        at = scratch.path(spark, "caches")
        fed.repartition(len(configs), "i").sortWithinPartitions("i", "pos").mapInArrow(run, schema).write.parquet(at)
        states = spark.read.schema(schema).parquet(at)
    of = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in configs]), F.col("i").cast("int") + 1)
    out = states.filter("accesses > 0").select(of(0).alias("policy"), of(1).cast("long").alias("capacity"), F.lit(float(rate)).alias("rate"), "hits", "accesses")
    return out.withColumn("miss_ratio", F.round(1 - F.col("hits") / F.col("accesses"), 6))


def histogram_limits(top: float = 1e12) -> list[int]:
    """Bucket limits that grow by half, cut to two significant digits: from 1 and 2 on."""
    out, v = [1, 2], 2.0
    while v < top:
        v *= 1.5
        x, scale = int(v), 1
        while x // scale >= 100:
            scale *= 10
        out.append(x // scale * scale)
    return out


def histogram(values: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """(by, i, lo, hi, n, mn, mx, total): a row for each growing bucket that has values; the last bucket takes all above.

    Histograms merge by adding rows of the same bucket, so they combine before the shuffle and over any groups of `by`.
    """
    limits = histogram_limits()
    table = F.array(*[F.lit(float(x)) for x in limits])
    b = values.select(*by, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    b = b.withColumn("i", F.least(F.size(F.filter(table, lambda top: top < F.col("x"))), F.lit(len(limits) - 1)))
    b = b.withColumn("lo", F.coalesce(F.get(table, F.col("i") - 1), F.lit(0.0))).withColumn("hi", F.get(table, F.col("i")))
    return b.groupBy(*by, "i", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("mn"), F.max("x").alias("mx"), F.sum("x").alias("total"))


def merged_histograms(rows: DataFrame, by: list[str]) -> DataFrame:
    """One histogram for each group of `by` from histograms of parts of it."""
    return rows.groupBy(*by, "i", "lo", "hi").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.sum("total").alias("total"))


def percentiles(rows: DataFrame, by: list[str], percents: list[float]) -> DataFrame:
    """Of histograms: n, mean, extremes, and percentiles interpolated in their bucket and held inside the extremes: p<percent>."""
    w = Window.partitionBy(*by)  # a row a bucket
    run = rows.withColumn("cum", F.sum("n").over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w)).withColumn("lowest", F.min("mn").over(w)).withColumn("highest", F.max("mx").over(w))
    agg = []
    for p in percents:
        need = F.col("_all") * (p / 100)
        inside = F.col("lo") + (F.col("hi") - F.col("lo")) * (need - (F.col("cum") - F.col("n"))) / F.col("n")
        hit = F.when(F.col("cum") >= need, F.struct("i", F.least(F.greatest(inside, F.col("lowest")), F.col("highest")).alias("q")))
        agg.append(F.round(F.min(hit)["q"], 6).alias(f"p{p:g}".replace(".", "_")))
    return run.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"), F.min("mn").alias("least"), F.max("mx").alias("greatest"), *agg)


def histogram_percentiles(values: DataFrame, by: list[str], percents: list[float]) -> DataFrame:
    """Percentiles from the growing buckets: columns n and p<percent>."""
    return percentiles(histogram(values, by), by, percents).drop("mean", "least", "greatest")


def windowed_histograms(values: DataFrame, by: list[str], width: int, count: int, percents: list[float], ts: str = "ts") -> DataFrame:
    """Percentiles over each window of `count` sub-windows of `width`: (by, w, n, mean, least, greatest, p<percent>), w the last sub-window.

    Rows are counted once, into the histogram of their sub-window; only those histograms are copied to the windows they are in.
    """
    sub = histogram(values.withColumn("_sub", F.floor(F.col(ts) / width)), [*by, "_sub"])
    to = sub.withColumn("w", F.explode(F.sequence(F.col("_sub"), F.col("_sub") + count - 1)))
    return percentiles(merged_histograms(to, [*by, "w"]), [*by, "w"], percents)


def queue_stats(events: DataFrame, by: str) -> DataFrame:
    """Length over time from (ts, delta): enqueued, dequeued, greatest and time-weighted mean length."""
    per = events.groupBy(by, "ts").agg(F.sum("delta").alias("d"), F.count_if(F.col("delta") > 0).alias("enq"), F.count_if(F.col("delta") < 0).alias("deq"))
    w = Window.partitionBy(by).orderBy("ts")
    q = per.withColumn("len", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("dt", F.lead("ts").over(w) - F.col("ts"))
    return q.groupBy(by).agg(F.sum("enq").alias("enqueued"), F.sum("deq").alias("dequeued"), F.max("len").alias("max_len"), F.round(F.try_divide(F.sum(F.col("len") * F.col("dt")), F.sum("dt")), 6).alias("mean_len"))


def hot_set(counts: DataFrame, step: float = 0.01, least: int = 10_000, ratio: float = 0.5, lift: float = 2.5) -> DataFrame:
    """Hot addresses (address, n): most written first, in steps of 1 % of them until a step adds under 1 % of the writes; none unless that set holds enough.

    Ranks come from the counts of counts, so no task sees all addresses in order.
    """
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)  # a row per count
    r = by.select("n", "m", F.sum("m").over(w).alias("b1"))
    total = by.agg(F.sum("m").alias("addresses"), F.sum(F.col("m") * F.col("n")).alias("writes"))
    spark = counts.sparkSession
    steps = spark.range(1, round(1 / step) + 1).withColumnRenamed("id", "k")
    cells = r.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(steps))
    size = F.col("addresses") * step
    got = F.greatest(F.lit(0.0), F.least(F.col("b1"), F.col("k") * size) - F.greatest(F.col("b1") - F.col("m"), (F.col("k") - 1) * size)) * F.col("n")
    gain = cells.groupBy("k").agg((F.sum(got) / F.first("writes")).alias("share"), F.first("addresses").alias("addresses"))
    stop = gain.agg(F.coalesce(F.min(F.when(F.col("share") < step, F.col("k"))), F.lit(round(1 / step) + 1)).alias("stop"))
    held = gain.crossJoin(F.broadcast(stop)).filter("k < stop").agg(F.coalesce(F.sum("share"), F.lit(0.0)).alias("r"), (F.count(F.lit(1)) * step).alias("f"), F.coalesce(F.first("addresses"), F.lit(0)).alias("addresses"))
    ok = held.select("r", "f", ((F.col("addresses") > least) & (F.col("r") > ratio) & (F.col("f") > 0) & (F.col("r") > lift * F.col("f"))).alias("is_hot"))
    return ok.select(F.round("r", 6).alias("write_share"), F.round("f", 6).alias("address_share"), "is_hot")
