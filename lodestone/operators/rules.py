"""Tuning rules as data: conditions on logs, options and time series, and their combination.

Expressions are built from a whitelist of comparisons; nothing is evaluated as code.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}
TERM = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_.]*)|(-?\d+(?:\.\d+)?))\s*([*/+-])?\s*(-?\d+(?:\.\d+)?)?\s*$")


def expression(text: str) -> Column:
    """`a > 3 and b*2 <= c`: comparisons of columns and numbers, joined by and."""

    def side(s: str) -> Column:
        m = TERM.match(s)
        if not m or bool(m[3]) != bool(m[4]):
            raise ValueError(f"not a term: {s!r}")
        c = F.col(f"`{m[1]}`") if m[1] else F.lit(float(m[2]))
        if not m[3]:
            return c
        k = F.lit(float(m[4]))
        return {"*": c * k, "/": F.try_divide(c, k), "+": c + k, "-": c - k}[m[3]]

    parts = []
    for p in re.split(r"\s+and\s+", text.strip(), flags=re.I):
        m = re.fullmatch(r"(.+?)(>=|<=|==|!=|>|<)(.+)", p)
        if not m:
            raise ValueError(f"not a comparison: {p!r}")
        parts.append(OPS[m[2]](side(m[1]), side(m[3])))
    return reduce(Column.__and__, parts)


def log_condition(lines: DataFrame, pattern: str) -> DataFrame:
    """Log lines (ts, line) that match a pattern."""
    return lines.filter(F.col("line").rlike(pattern))


def series_condition(series: DataFrame, text: str, by: str, aggregate: str | None = None) -> DataFrame:
    """Epochs or, with an aggregate (avg, max, min, latest, oldest), entities for which an expression on statistics holds."""
    how = {"avg": F.avg("v"), "max": F.max("v"), "min": F.min("v"), "latest": F.max_by("v", "pos"), "oldest": F.min_by("v", "pos")}
    names = sorted(set(re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", re.sub(r"\band\b", " ", text))))
    keys = [by] if aggregate else [by, "pos"]
    wide = series.groupBy(*keys).pivot("stat", names).agg(how[aggregate or "avg"])
    return wide.filter(expression(text)).select(*keys)


def overlap(a: DataFrame, b: DataFrame, by: str, period: int) -> DataFrame:
    """Pairs of triggers of one entity within a period; met by equal time buckets."""
    deal = lambda df, n, spread: df.select(by, F.col("pos").alias(n), F.explode(F.array(*[F.floor(F.col("pos") / period) + i for i in spread])).alias("_b"))
    j = deal(a, "t1", (0,)).join(deal(b, "t2", (-1, 0, 1)), [by, "_b"])
    return j.filter(F.abs(F.col("t1") - F.col("t2")) <= period).select(by, "t1", "t2").distinct()


def combine(*triggers: DataFrame, by: str) -> DataFrame:
    """Entities for which all conditions hold."""
    return reduce(lambda a, b: a.join(b.select(by).distinct(), by, "left_semi"), triggers[1:], triggers[0].select(by).distinct())


def matches(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, condition, matches): for how many rows each condition holds, in one reading."""
    counts = rows.agg(*[F.count_if(expression(x)).alias(f"_{i}") for i, (_, x) in enumerate(rules)])
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(x).alias("condition"), F.col(f"_{i}").alias("matches")) for i, (n, x) in enumerate(rules)])
    return counts.select(F.inline(each))


def apply_suggestion(options: DataFrame, name: str | DataFrame, action: str, value: float) -> DataFrame:
    """Sets, increases or decreases (by a factor) an option (name, value); the name may come as a table of one row."""
    v = F.col("value")
    new = {"set": F.lit(float(value)), "increase": v * (1 + value), "decrease": v * (1 - value)}[action]
    if isinstance(name, str):
        return options.withColumn("value", F.when(F.col("name") == name, new).otherwise(v))
    own = options.crossJoin(F.broadcast(name.select(F.col("name").alias("_name"))))
    return own.withColumn("value", F.when(F.col("name") == F.col("_name"), new).otherwise(v)).drop("_name")
