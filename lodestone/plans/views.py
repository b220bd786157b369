"""Domain views over the given tables: request trace, versioned key log, drive days, failures, block accesses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = {"view": "get", "click": "gets", "purchase": "set", "signup": "add", "error": "delete"}


class Tables:
    """Tables and views of one folder, by call: t("orders"), t("v_trace")."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return globals()[name](self) if name.startswith("v_") else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def v_trace(t: Tables) -> DataFrame:
    """Requests: line_no, ts (s), key, key_size, value_size, op."""
    e = t("events")
    op = F.create_map(*[F.lit(x) for kv in OPS.items() for x in kv])[F.col("event_type")]
    key = F.col("user_id").cast("string")
    return e.select(
        F.col("event_id").alias("line_no"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), key.alias("key"),
        F.length(key).cast("long").alias("key_size"), F.floor(F.coalesce("value", F.lit(0.0))).alias("value_size"), op.alias("op"),
    )


def v_kv(t: Tables) -> DataFrame:
    """Versioned log: cf, key, (day, a, b, c) as sequence, type (put, merge, delete), value."""
    return t("lineitem").select(
        F.col("l_linestatus").alias("cf"), F.col("l_partkey").alias("key"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"),
        F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.col("l_suppkey").alias("c"),
        F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "merge").otherwise("put").alias("type"), F.col("l_quantity").cast("long").alias("value"),
    )


def v_drive_rows(t: Tables) -> DataFrame:
    """Error log rows: drive, day, errors, written, flag, model, ord (order in the log)."""
    return t("lineitem").select(
        F.col("l_suppkey").alias("drive"), F.col("l_shipdate").cast("date").alias("day"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long")).alias("errors"),
        F.col("l_extendedprice").alias("written"), (F.col("l_discount") > 0.05).cast("long").alias("flag"), F.col("l_returnflag").alias("model"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").cast("long").alias("o2"), F.col("l_partkey").alias("o3"),
    )


def v_drive_daily(t: Tables) -> DataFrame:
    """Drive days: drive, day, errors (sum), wear (running sum of quantity), flag (max)."""
    from pyspark.sql import Window

    d = v_drive_rows(t).groupBy("drive", "day").agg(F.sum("errors").alias("errors"), F.max("flag").alias("flag"))
    w = Window.partitionBy("drive").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("wear", F.sum("errors").over(w))


def v_dense(t: Tables) -> DataFrame:
    """Drive days of five busy drives, with few gaps: drive, day, errors."""
    return v_drive_rows(t).groupBy((F.col("drive") % 5).alias("drive"), "day").agg(F.sum("errors").alias("errors"))


def v_failure(t: Tables) -> DataFrame:
    """Failures: drive, fail_day: first day with at least 40 errors."""
    return v_drive_daily(t).filter("errors >= 40").groupBy("drive").agg(F.min("day").alias("fail_day"))


def v_block(t: Tables) -> DataFrame:
    """Block accesses: block, size, caller, level, btype, ts (day), o1..o3 (order within a day)."""
    return t("lineitem").select(
        F.col("l_partkey").alias("block"), F.col("l_quantity").cast("long").alias("size"), F.col("l_returnflag").alias("caller"), F.col("l_linenumber").cast("long").alias("level"),
        F.col("l_linestatus").alias("btype"), F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("ts"),
        F.col("l_orderkey").alias("o1"), F.col("l_linenumber").cast("long").alias("o2"), F.col("l_suppkey").alias("o3"), F.pmod("l_orderkey", F.lit(64)).alias("key_id"), (F.col("l_discount") > 0.03).cast("long").alias("is_hit"),
    )


def v_series(t: Tables) -> DataFrame:
    """Telemetry series: entity, stat, pos, v."""
    o = t("orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("entity"), F.substring("o_orderpriority", 1, 1).alias("stat"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("o_totalprice").alias("v"))


def v_pred(t: Tables) -> DataFrame:
    """Predictions: sample_id, task, truth, pred."""
    return t("labels").filter("quality is not null and toxic is not null").select(F.col("doc_id").alias("sample_id"), F.concat(F.lit("task"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("task"), F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("pred"))


SQL_VIEWS = {
    "v_trace": """SELECT event_id AS line_no, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS key, CAST(length(CAST(user_id AS VARCHAR)) AS BIGINT) AS key_size,
        CAST(floor(coalesce(value, 0)) AS BIGINT) AS value_size, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'gets' WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'add' WHEN 'error' THEN 'delete' END AS op FROM events""",
    "v_kv": """SELECT l_linestatus AS cf, l_partkey AS key, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day, l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b, l_suppkey AS c,
        CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'merge' ELSE 'put' END AS type, CAST(l_quantity AS BIGINT) AS value FROM lineitem""",
    "v_drive_rows": """SELECT l_suppkey AS drive, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS errors, l_extendedprice AS written,
        CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS flag, l_returnflag AS model, l_orderkey AS o1, CAST(l_linenumber AS BIGINT) AS o2, l_partkey AS o3 FROM lineitem""",
    "v_drive_sum": "SELECT drive, day, CAST(sum(errors) AS BIGINT) AS errors, CAST(max(flag) AS BIGINT) AS flag FROM v_drive_rows GROUP BY drive, day",
    "v_drive_daily": "SELECT *, CAST(sum(errors) OVER (PARTITION BY drive ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS wear FROM v_drive_sum",
    "v_dense": "SELECT drive % 5 AS drive, day, CAST(sum(errors) AS BIGINT) AS errors FROM v_drive_rows GROUP BY ALL",
    "v_failure": "SELECT drive, min(day) AS fail_day FROM v_drive_daily WHERE errors >= 40 GROUP BY drive",
    "v_block": """SELECT l_partkey AS block, CAST(l_quantity AS BIGINT) AS size, l_returnflag AS caller, CAST(l_linenumber AS BIGINT) AS level, l_linestatus AS btype,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS ts, l_orderkey AS o1, CAST(l_linenumber AS BIGINT) AS o2, l_suppkey AS o3, l_orderkey % 64 AS key_id, CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END AS is_hit FROM lineitem""",
    "v_series": """SELECT o_custkey AS entity, substr(o_orderpriority, 1, 1) AS stat, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS pos, o_totalprice AS v FROM orders""",
    "v_pred": """SELECT doc_id AS sample_id, 'task' || CAST(doc_id % 3 AS VARCHAR) AS task, CAST(quality AS BIGINT) AS truth, CAST(toxic AS BIGINT) AS pred FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""",
}


def with_views(sql: str) -> str:
    """Puts the views that a statement uses before it as common table expressions."""
    used: list[str] = []

    def need(text: str) -> None:
        for v in SQL_VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in used:
                need(SQL_VIEWS[v])
                used.append(v)

    need(sql)
    ctes = [f"{v} AS ({SQL_VIEWS[v]})" for v in used]
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            ctes.append(body[len(head) :])
            return head + ", ".join(ctes)
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
