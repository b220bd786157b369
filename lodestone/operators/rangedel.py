"""Range deletes: tombstones (cf, lo, hi, seq) that hide older versions of the keys from lo to before hi.

Overlapping tombstones are cut into disjoint fragments, each with the newest sequence number that covers it, so that a key
meets one fragment. The key space is dealt into parts by borders drawn from the ends of the tombstones. A tombstone gives a
piece to the part where it starts and one to the part where it ends; the parts in between it covers whole, and of those only
the newest sequence number counts: it goes to the nodes of a binary tree over the parts, at most two a level, and comes down
as one number for each part. So rows grow with the tombstones, not with the keys or parts they span. A part is swept once in
key order with a heap of open pieces.

Few tombstones (checked) are swept by the driver and looked up by binary search, and versions do not move. Otherwise versions
go to their key's part and, by part size, to one of several sub-parts that all have the part's fragments, so a key with most
of the versions is not one task's; the last fragment that starts at or before a version's key is found by a window.

Keys are integers, strings or bytes. Versions with a null key or family, and tombstones with a null or empty range, hide nothing.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestone.operators.order import numbered

START, END = (0,), (2,)  # before and after all keys; a key k is (1, k)


def sweep(pieces: Iterable[tuple]) -> Iterator[tuple]:
    """Disjoint (lo, hi, newest seq) of pieces (lo, hi, seq) that come in order of lo; bounds are START, END or (1, key)."""
    open_: list[tuple] = []
    at = START

    def until(stop: tuple) -> Iterator[tuple]:
        nonlocal at
        while open_:
            seq, hi = open_[0]
            if hi <= at:
                heapq.heappop(open_)
                continue
            end = min(hi, stop)
            if at < end:
                yield at, end, -seq
                at = end
            if end == stop:
                return

    def joined() -> Iterator[tuple]:
        nonlocal at
        for lo, hi, seq in pieces:
            yield from until(lo)
            at = lo
            heapq.heappush(open_, (-seq, hi))
        yield from until(END)

    last = None
    for lo, hi, seq in joined():
        if last and last[1] == lo and last[2] == seq:
            last = (last[0], hi, seq)
            continue
        if last:
            yield last
        last = (lo, hi, seq)
    if last:
        yield last


def fragments(tombstones: DataFrame) -> DataFrame:
    """(cf, lo, hi, seq): disjoint key ranges, each with every sequence number that covers it. As many rows as there are
    such pairs: tombstones that all overlap give the square of their number."""
    ends = tombstones.filter("lo < hi").select("cf", F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    n = numbered(ends, ["lo"], ["cf"], "i")
    first, last = (n.select(F.col("cf").alias(f"_cf{s}"), F.col("lo").alias(f"_k{s}"), F.col("i").alias(f"_i{s}")) for s in "ab")
    t = tombstones.filter("lo < hi").join(first, (F.col("cf") == F.col("_cfa")) & (F.col("lo") == F.col("_ka"))).join(last, (F.col("cf") == F.col("_cfb")) & (F.col("hi") == F.col("_kb")))
    t = t.select("cf", "seq", F.explode(F.sequence("_ia", F.col("_ib") - 1)).alias("i")).distinct()
    cell = n.join(n.select("cf", F.col("lo").alias("hi"), (F.col("i") - 1).alias("i")), ["cf", "i"])
    return t.join(cell, ["cf", "i"]).select("cf", "lo", "hi", "seq")


class Parts:
    """Borders (cf, key) that cut the order of families and keys into parts."""

    def __init__(self, borders: list[tuple]):
        self.borders = sorted(set(borders))
        self.count = len(self.borders) + 1
        self.keys, self.first = defaultdict(list), {}
        for i, (cf, key) in enumerate(self.borders):
            self.first.setdefault(cf, i)
            self.keys[cf].append(key)

    def of(self, cf: Column, key: Column, before: bool = False) -> Column:
        """The part of a key, or of all that comes just before it."""
        side, families = "left" if before else "right", sorted(self.keys)

        @F.pandas_udf("int")
        def place(c, k):
            import pandas as pd

            out = np.zeros(len(c), np.int32)
            names = c.to_numpy()
            for name in set(names.tolist()):
                if name is None:
                    continue
                mine = np.flatnonzero(names == name)
                base = self.first[name] if name in self.first else sum(len(self.keys[f]) for f in families[: bisect_left(families, name)])
                keys = self.keys.get(name, [])
                values = k.iloc[mine].tolist()
                find = bisect_left if side == "left" else bisect_right
                fast = bool(keys) and isinstance(keys[0], int)
                out[mine] = base + (np.searchsorted(np.array(keys), np.array(values), side=side) if fast else np.array([find(keys, v) for v in values], np.int64))
            return pd.Series(out)

        return place(cf, key)


def _draw(tombstones: DataFrame, count: int, parts: int) -> Parts:
    """Borders at even steps among a sample of the tombstones' ends; a few hundred ends a part pass through the driver."""
    ends = tombstones.select("cf", F.explode(F.array("lo", "hi")).alias("key"))
    share = min(1.0, 200.0 * parts / max(1, 2 * count))
    seen = sorted({(r["cf"], r["key"]) for r in ends.sample(share, seed=1).collect()})
    return Parts([seen[i * len(seen) // parts] for i in range(1, parts)] if len(seen) > parts else seen)


def cut(tombstones: DataFrame, parts: Parts) -> tuple[DataFrame, DataFrame]:
    """(pieces (part, cf, lo, hi, seq), covers (part, seq)): null bounds reach to the end of the part."""
    t = tombstones.withColumn("_p", parts.of(F.col("cf"), F.col("lo"))).withColumn("_q", parts.of(F.col("cf"), F.col("hi"), before=True))
    none = F.lit(None).cast(tombstones.schema["lo"].dataType)
    one = F.col("_p") == F.col("_q")
    piece = lambda p, lo, hi: F.struct(p.alias("part"), lo.alias("lo"), hi.alias("hi"))
    both = F.when(one, F.array(piece(F.col("_p"), F.col("lo"), F.col("hi")))).otherwise(F.array(piece(F.col("_p"), F.col("lo"), none), piece(F.col("_q"), none, F.col("hi"))))
    pieces = t.select("cf", "seq", F.explode(both).alias("x")).groupBy("x.part", "cf", "x.lo", "x.hi").agg(F.max("seq").alias("seq"))
    levels = max(1, parts.count.bit_length())
    nodes = []
    for n in range(levels):  # of the parts a .. b - 1, what level n holds of their binary decomposition
        a, b = F.floor((F.col("_p") + 1 + (1 << n) - 1) / (1 << n)), F.floor(F.col("_q") / (1 << n))
        for odd, at in ((a % 2 == 1, a), (b % 2 == 1, b - 1)):
            nodes.append(F.when((a < b) & odd, F.struct(F.lit(n).alias("level"), at.cast("long").alias("at"))))
    held = t.filter(F.col("_q") > F.col("_p") + 1).select("seq", F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull())).alias("x"))
    held = held.groupBy("x.level", "x.at").agg(F.max("seq").alias("seq"))
    wide = F.expr("shiftleft(1L, level)")
    covers = held.select("seq", F.explode(F.sequence(F.col("at") * wide, (F.col("at") + 1) * wide - 1)).alias("part")).groupBy(F.col("part").cast("int").alias("part")).agg(F.max("seq").alias("seq"))
    return pieces, covers


def newest_fragments(pieces: DataFrame) -> DataFrame:
    """(part, cf, lo, hi, seq): the pieces of each part swept into disjoint ranges with their newest sequence number."""
    schema = pieces.select("part", "cf", "lo", "hi", "seq").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for b in batches:
                kind = b.schema
                yield from zip(*(b.column(c).to_pylist() for c in ("part", "cf", "lo", "hi", "seq")), strict=True)

        def groups() -> Iterator[tuple]:
            own, mine = None, []
            for part, cf, lo, hi, seq in rows():
                if (part, cf) != own:
                    if mine:
                        yield own, mine
                    own, mine = (part, cf), []
                mine.append((START if lo is None else (1, lo), END if hi is None else (1, hi), seq))
            if mine:
                yield own, mine

        out: list[tuple] = []
        for (part, cf), mine in groups():
            for lo, hi, seq in sweep(mine):
                out.append((part, cf, lo[1] if lo != START else None, hi[1] if hi != END else None, seq))
            if len(out) >= 10_000:
                yield pa.record_batch([pa.array(c, kind.field(f).type) for f, c in zip(kind.names, zip(*out, strict=True), strict=True)], schema=kind)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, kind.field(f).type) for f, c in zip(kind.names, zip(*out, strict=True), strict=True)], schema=kind)

    return pieces.select("part", "cf", "lo", "hi", "seq").repartition("part").sortWithinPartitions("part", "cf", "lo").mapInArrow(run, schema)


def cover_of(found: dict[str, list[tuple]], cf: Column, key: Column) -> Column:
    """Newest sequence number among disjoint fragments by family (in order of lo) that covers a key; null if none does."""
    held = {c: ([f[0] for f in x], [f[1] for f in x], [f[2] for f in x]) for c, x in found.items()}

    @F.pandas_udf("long")
    def look(c, k):
        import pandas as pd

        out = np.full(len(c), -1, np.int64)
        there = np.zeros(len(c), bool)
        names, none = c.to_numpy(), k.isna().to_numpy()
        for name, (lo, hi, seq) in held.items():
            mine = np.flatnonzero((names == name) & ~none)
            if not len(mine):
                continue
            values = k.iloc[mine].tolist()
            if isinstance(lo[0], int):
                v = np.array(values, np.int64)
                at = np.searchsorted(np.array(lo, np.int64), v, side="right") - 1
                ok = (at >= 0) & (v < np.array(hi, np.int64)[at])
            else:
                at = np.array([bisect_right(lo, v) - 1 for v in values], np.int64)
                ok = np.array([i >= 0 and v < hi[i] for i, v in zip(at, values, strict=True)], bool)
            there[mine[ok]], out[mine[ok]] = True, np.array(seq, np.int64)[at[ok]]
        return pd.Series(pd.array(np.where(there, out, 0), dtype="Int64")).mask(~there)

    return look(cf, key)


def range_deleted(versions: DataFrame, tombstones: DataFrame, key_seq: str = "seq", few: int = 10_000, a_part: int = 20_000, a_task: int = 2_000_000) -> DataFrame:
    """Versions not covered by a tombstone [lo, hi) of the same cf with a larger sequence number."""
    t = tombstones.filter("cf IS NOT NULL AND lo < hi AND seq IS NOT NULL").select("cf", "lo", "hi", F.col("seq").cast("long").alias("seq"))
    if isinstance(versions.schema["key"].dataType, LongType):
        t = t.withColumn("lo", F.col("lo").cast("long")).withColumn("hi", F.col("hi").cast("long"))
    some = t.limit(few + 1).collect() if few else []
    if few and len(some) <= few:
        own = defaultdict(list)
        for r in sorted(some, key=lambda r: r["lo"]):
            own[r["cf"]].append(((1, r["lo"]), (1, r["hi"]), r["seq"]))
        found = {cf: [(lo[1], hi[1], seq) for lo, hi, seq in sweep(x)] for cf, x in own.items()}
        if not found:
            return versions
        return versions.withColumn("_cover", cover_of(found, F.col("cf"), F.col("key"))).filter(F.col("_cover").isNull() | (F.col("_cover") <= F.col(key_seq))).drop("_cover")
    count = t.count()
    parts = _draw(t, count, min(4096, max(1, -(-2 * count // a_part))))
    pieces, covers = cut(t, parts)
    kept = newest_fragments(pieces)
    known = "cf IS NOT NULL AND key IS NOT NULL"
    v = versions.filter(known).withColumn("_part", parts.of(F.col("cf"), F.col("key")))
    sizes = v.groupBy("_part").count().select(F.col("_part").alias("part"), F.greatest(F.ceil(F.col("count") / a_task), F.lit(1)).cast("int").alias("subs"))  # a row a part, 4096 at most
    frags = kept.join(F.broadcast(sizes), "part").withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    v = v.join(F.broadcast(sizes.withColumnRenamed("part", "_part")), "_part").join(F.broadcast(covers.select(F.col("part").alias("_part"), F.col("seq").alias("_whole"))), "_part", "left")
    v = v.withColumn("_sub", F.pmod(F.xxhash64(*[c for c, kind in versions.dtypes if "map<" not in kind]), F.col("subs")).cast("int")).drop("subs")
    fragment = F.struct(F.col("cf").alias("f"), "hi", "seq")
    left = v.select(*v.columns, F.lit(1).alias("_kind"), F.lit(None).cast(kept.select(fragment.alias("x")).schema["x"].dataType).alias("_x"))
    right = frags.select(F.col("part").alias("_part"), "_sub", "cf", F.col("lo").alias("key"), F.lit(0).alias("_kind"), fragment.alias("_x"))
    w = Window.partitionBy("_part", "_sub").orderBy("cf", F.asc_nulls_first("key"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right, allowMissingColumns=True).withColumn("_f", F.last("_x", ignorenulls=True).over(w)).filter("_kind = 1")
    inside = (F.col("_f.f") == F.col("cf")) & (F.col("_f.hi").isNull() | (F.col("key") < F.col("_f.hi")))
    cover = F.greatest(F.col("_whole"), F.when(inside, F.col("_f.seq")))
    out = met.filter(cover.isNull() | (cover <= F.col(key_seq))).select(*versions.columns)
    return out.unionByName(versions.filter(f"NOT ({known})"))
