"""Reads of a versioned key log: newest visible version, merges, range deletes, expiry, wide columns, scans, compaction.

A log row has cf, key, sequence columns (newest greatest), type (put, delete, merge) and value. Newest versions combine
before their one shuffle on (cf, key). Merges read the log once: rows are sorted newest first within a key, all below its
newest put or delete are passed over, and the others fold in the same task. A key that holds much of the log is split by
`stripes` of the sequence: what is left of a stripe is one small state, and states of stripes fold in order like rows do.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.order import pieces
from lodestone.operators.rangedel import range_deleted  # noqa: F401  one of the log's reads

KEY = ["cf", "key"]


def newest(log: DataFrame, seq: list[str], by: list[str] = KEY) -> DataFrame:
    """Newest version of each key, deletes among them."""
    rest = [c for c in log.columns if c not in by]
    top = log.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_top"))
    return top.select(*[F.col(c) if c in by else F.col(f"_top.`{c}`").alias(c) for c in log.columns])


def resolve(log: DataFrame, seq: list[str]) -> DataFrame:
    """Values as a reader sees them where merge operands overwrite: newest version, deleted keys hidden."""
    return newest(log, seq).filter("type <> 'delete'").select(*KEY, "value")


def visible(log: DataFrame, column: str, snapshot) -> DataFrame:
    """What a snapshot sees; the filter reaches the scan."""
    return log.filter(F.col(column) <= snapshot)


def effective(log: DataFrame, seq: list[str], by: list[str] = KEY) -> DataFrame:
    """The rows a merge read folds: all above the newest put or delete of the key, and that row itself."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(s) for s in seq]).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.coalesce(F.max((F.col("type") != "merge").cast("int")).over(w), F.lit(0))
    return log.withColumn("_cut", cut).filter("_cut = 0").drop("_cut")


@dataclass(frozen=True)
class Merge:
    """A merge operator: `fold` is an aggregate over column `value` and the sequence columns. With `again` its results, each
    at the sequence of its newest row, fold to the same as all their rows, so that stripes of a key may be folded apart."""

    fold: Callable[[list[str]], Column]
    again: bool = True


def _listed(seq: list[str]) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*seq, "value"))), lambda x: x["value"].cast("string")), ",")


@dataclass
class Merges:
    """Merge operators by name."""

    known: dict[str, Merge] = field(default_factory=dict)

    def register(self, name: str, fold: Callable[[list[str]], Column], again: bool = True) -> Merges:
        """A registry with one operator more; this one stays as it is."""
        return Merges({**self.known, name: Merge(fold, again)})

    def __getitem__(self, name: str) -> Merge:
        if name not in self.known:
            raise KeyError(f"no merge operator {name}: {sorted(self.known)}")
        return self.known[name]


MERGES = Merges({
    "add": Merge(lambda seq: F.sum("value")),
    "max": Merge(lambda seq: F.max("value")),  # of bytes: the greatest by byte
    "xor": Merge(lambda seq: F.bit_xor("value")),
    "put": Merge(lambda seq: F.max_by("value", F.struct(*seq))),
    "append": Merge(_listed),
    "sortlist": Merge(lambda seq: F.array_join(F.array_sort(F.collect_list("value")), ","), again=False),
})


def merged(log: DataFrame, seq: list[str], operator: str, with_base: bool = True, merges: Merges = MERGES, stripes: Sequence[int] = ()) -> DataFrame:
    """Value of each key under a merge operator; a delete is no base, and hides the key unless operands follow.

    stripes are borders of the first sequence column: rows of a key meet by stripe, then one state for each stripe.
    """
    op = merges[operator]
    kept = "type = 'merge'" if not with_base else "type <> 'delete'"
    if not stripes or not op.again:
        return effective(log, seq).filter(kept).groupBy(*KEY).agg(op.fold(seq).alias("value"))
    stripe = sum((F.col(seq[0]) > F.lit(s)).cast("int") for s in stripes)
    part = effective(log.withColumn("_stripe", stripe), seq, [*KEY, "_stripe"])
    # a state: what the stripe's rows fold to, and whether a put or delete is below them, which hides the stripes before
    counted = F.expr(kept)
    states = (
        part.withColumn("value", F.when(counted, F.col("value"))).groupBy(*KEY, "_stripe")
        .agg(F.max(F.struct(*seq)).alias("_at"), F.bool_or(F.col("type") != "merge").alias("_base"), F.count_if(counted).alias("_n"), op.fold(seq).alias("value"))
    )
    below = F.coalesce(F.max(F.col("_base").cast("int")).over(Window.partitionBy(*KEY).orderBy(F.desc("_stripe")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    live = states.withColumn("_cut", below).filter("_cut = 0 AND _n > 0").select(*KEY, *[F.col(f"_at.{s}").alias(s) for s in seq], "value")
    return live.groupBy(*KEY).agg(op.fold(seq).alias("value"))


def merge_operands(log: DataFrame, seq: list[str]) -> DataFrame:
    """Operands of each key, base first, in order."""
    rows = effective(log, seq).filter("type <> 'delete'")
    return rows.groupBy(*KEY).agg(_listed(seq).alias("operands"), F.count(F.lit(1)).alias("n"))


def agg_named(log: DataFrame, seq: list[str]) -> DataFrame:
    """Folds operands (func, value) in order: when the function changes, the value so far goes into the new one."""
    ops = F.array_sort(F.collect_list(F.struct(*seq, "func", "value")))
    empty = F.struct(F.lit(None).cast("string").alias("f"), F.lit(None).cast("double").alias("v"))

    def step(acc: Column, x: Column) -> Column:
        v = x["value"].cast("double")
        out = F.when(acc["v"].isNull(), v).when(x["func"] == "sum", acc["v"] + v).when(x["func"] == "mul", acc["v"] * v).when(x["func"] == "max", F.greatest(acc["v"], v)).otherwise(v)
        return F.struct(x["func"].alias("f"), out.alias("v"))

    return log.groupBy(*KEY).agg(F.aggregate(ops, empty, step)["v"].alias("value"))


def alive(rows: DataFrame, ttl: int, now: int, written: str = "write_time") -> DataFrame:
    """Rows not expired: expired if ttl > 0 and written + ttl < now."""
    return rows.filter(F.lit(ttl <= 0) | (F.col(written) + ttl >= now))


def compact(log: DataFrame, seq: list[str], snapshots: list[int], column: str) -> DataFrame:
    """Folds history: the newest version per key and snapshot stripe; in the lowest stripe deletes go too."""
    stripe = sum(((F.col(column) > s).cast("int") for s in snapshots), F.lit(0))
    out = newest(log.withColumn("stripe", stripe.cast("long")), seq, [*KEY, "stripe"])
    return out.filter("NOT (stripe = 0 AND type = 'delete')")


def compact_single(log: DataFrame, seq: list[str], snapshots: Sequence[int], column: str) -> DataFrame:
    """The versions that a whole compaction leaves of puts, deletes and single deletes.

    Versions are seen newest first, in stripes between snapshots. A single delete looks at the next older version of its
    key: in the same stripe both go if that is a put, and the single delete alone goes if that is another delete (a
    mismatch); with the next version in an older stripe it stays, and as the oldest version it goes if no snapshot is below
    it. Any other version is hidden by a newer one of its stripe; a delete that no snapshot is below goes too. Rows are
    seen in order with one row of context, so a key's history is never held.
    """
    stripe = sum(((F.col(column) > s).cast("int") for s in snapshots), F.lit(0))
    w = Window.partitionBy(*KEY).orderBy(*[F.desc(s) for s in seq])
    seen = log.withColumn("_s", stripe).withColumn("_newer", F.lag("_s").over(w)).withColumn("_older", F.lead("_s").over(w)).withColumn("_type", F.lead("type").over(w))
    single = F.col("type") == "single"
    below = F.col("_older").isNotNull() & (F.col("_older") != F.col("_s"))
    alone = F.col("_older").isNull() & (F.col("_s") > 0)
    shown = (F.col("_newer").isNull() | (F.col("_newer") != F.col("_s"))) & ~((F.col("type") == "delete") & (F.col("_s") == 0))
    return seen.filter(F.when(single, below | alone).otherwise(shown)).drop("_s", "_newer", "_older", "_type")


def single_mismatches(log: DataFrame, seq: list[str], snapshots: Sequence[int], column: str) -> DataFrame:
    """(cf, mismatches): single deletes whose next older version in their stripe is a delete of either kind."""
    stripe = sum(((F.col(column) > s).cast("int") for s in snapshots), F.lit(0))
    w = Window.partitionBy(*KEY).orderBy(*[F.desc(s) for s in seq])
    met = log.withColumn("_s", stripe).withColumn("_older", F.lead("_s").over(w)).withColumn("_type", F.lead("type").over(w))
    return met.filter("type = 'single' AND _older = _s AND _type IN ('single', 'delete')").groupBy("cf").agg(F.count(F.lit(1)).alias("mismatches"))


def batch_survivors(ops: DataFrame, batch: list[str], at: list[str], kind: str = "type") -> DataFrame:
    """The writes of each batch that no rollback undoes: kinds save, rollback and pop work a stack of savepoints.

    A rollback undoes all since the newest savepoint and takes it away, a pop takes it away alone; either without a
    savepoint does nothing. A savepoint and what takes it are met at their depth of the stack; a write goes if a savepoint
    that is rolled back is open where it stands. Running sums in order, however long the batch.
    """
    order = Window.partitionBy(*batch).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col(kind) == "save", 1).when(F.col(kind).isin("rollback", "pop"), -1).otherwise(0)
    d = ops.repartition(pieces(ops), *batch).withColumn("_d", F.sum(step).over(order))
    d = d.withColumn("_low", F.least(F.lit(0), F.coalesce(F.min("_d").over(before), F.lit(0))))
    taker = F.col(kind).isin("rollback", "pop") & (F.col("_d") >= F.col("_low"))  # else the stack is empty here
    depth = F.when(F.col(kind) == "save", F.col("_d") - F.col("_low")).when(taker, F.col("_d") - F.col("_low") + 1)
    d = d.withColumn("_depth", depth)
    level = Window.partitionBy(*batch, "_depth").orderBy(*at)
    taken = F.lead(F.col(kind)).over(level)
    undone = F.when(F.col("_depth").isNotNull() & (F.col(kind) == "save") & (taken == "rollback"), 1).when(F.col("_depth").isNotNull() & (F.col(kind) == "rollback"), -1).otherwise(0)
    out = d.withColumn("_undone", undone).withColumn("_open", F.sum("_undone").over(order))
    return out.filter((F.col("_open") == 0) & ~F.col(kind).isin("save", "rollback", "pop")).drop("_d", "_low", "_depth", "_undone", "_open")


def filtered_log(log: DataFrame, action: Column, replaced: dict[str, Column], seq: str = "seq") -> DataFrame:
    """A log as a recovery filter lets it through: records to `keep`, those to `ignore` gone, those to `replace` with other
    columns, and nothing from the first record on that says `stop`."""
    acted = log.withColumn("_act", action)
    stop = acted.filter("_act = 'stop'").agg(F.min(seq).alias("_stop"))  # one row
    live = acted.crossJoin(F.broadcast(stop)).filter((F.col("_stop").isNull() | (F.col(seq) < F.col("_stop"))) & F.col("_act").isin("keep", "replace"))
    return live.select(*[F.when(F.col("_act") == "replace", replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in log.columns])


def puts(rows: DataFrame, seq: Column, written_at: Column | None = None) -> DataFrame:
    """Rows (cf, key, value, or entity: a map of columns) as put records of a log: an entity's anonymous column is its
    value, and a timed put carries its own write time, null for now."""
    entity = F.col("entity") if "entity" in rows.columns else F.lit(None).cast("map<string,string>")
    value = F.coalesce(F.col("value").cast("string"), default_column(entity)) if "value" in rows.columns else default_column(entity)
    kind = F.when(entity.isNotNull(), "put_entity").otherwise("put")
    return rows.select("cf", "key", seq.alias("seq"), kind.alias("type"), value.alias("value"), F.map_filter(entity, lambda k, _: k != "").alias("columns"), (written_at if written_at is not None else F.lit(None).cast("long")).alias("write_time"))


def overlay(stored: DataFrame, batch: DataFrame, seq: list[str]) -> DataFrame:
    """Reads an uncommitted batch over stored rows; the batch wins."""
    both = stored.withColumn("_layer", F.lit(0)).unionByName(batch.withColumn("_layer", F.lit(1)))
    return resolve(both, ["_layer", *seq])


def coalesce_families(rows: DataFrame, order: list[str]) -> DataFrame:
    """Columns (cf, key, col, value) of each key over families; of equal names the later family in `order` wins."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("cf"))
    return rows.withColumn("_o", rank).filter("_o > 0").groupBy("key", "col").agg(F.max_by("value", "_o").alias("value"))


def attribute_groups(rows: DataFrame) -> DataFrame:
    """Each key with its families kept apart, as a map in text, in order of family."""
    return rows.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cf", "value"))), lambda x: F.concat(x["cf"], F.lit("="), x["value"].cast("string"))), ";").alias("groups"))


def default_column(entity: Column) -> Column:
    """Value of a wide-column entity: its anonymous column, or null."""
    return F.try_element_at(entity, F.lit(""))


def multi_get(log: DataFrame, keys: DataFrame, seq: list[str]) -> DataFrame:
    return resolve(log.join(keys, KEY, "left_semi"), seq)


def scan(rows: DataFrame, lo=None, hi=None, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Rows with lo <= key < hi in key order, the first `limit`."""
    if lo is not None:
        rows = rows.filter(F.col("key") >= lo)
    if hi is not None:
        rows = rows.filter(F.col("key") < hi)
    rows = rows.orderBy(F.desc("key") if reverse else F.asc("key"))
    return rows.limit(limit) if limit is not None else rows


def seek(rows: DataFrame, target, n: int, backward: bool = False) -> DataFrame:
    """n rows from the first key >= target on, or backward from the last key <= target."""
    rows = rows.filter(F.col("key") <= target if backward else F.col("key") >= target)
    return rows.orderBy(F.desc("key") if backward else F.asc("key")).limit(n)


def multi_scan(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of many ranges (range_id, lo, hi) in one pass; the ranges are a short list."""
    return rows.join(F.broadcast(ranges), (F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))).select("range_id", "key", "value")


def fifo_retention(files: DataFrame, cap: int) -> DataFrame:
    """Newest files whose sizes add up to at most cap: (file, age order ord, size)."""
    w = Window.orderBy(F.desc("ord"), "file").rowsBetween(Window.unboundedPreceding, 0)  # a row per file
    return files.withColumn("running", F.sum("size").over(w)).filter(F.col("running") <= cap)


def options_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys (name, value) that differ or are on one side only."""
    j = a.withColumnRenamed("value", "left_value").join(b.withColumnRenamed("value", "right_value"), "name", "full_outer")
    return j.filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
