"""Queries on series, drives and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import drive, scoring, series
from lodestone.plans.registry import query

BY = ["entity", "stat"]
STATS = "st AS (SELECT entity, stat, count(*) AS n, median(v) AS m, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.25) AS b, quantile_cont(v, 0.75) AS c, quantile_cont(v, 0.95) AS d, min(v) AS min_v, max(v) AS max_v FROM v_series GROUP BY ALL), dv AS (SELECT entity, stat, abs(v - m) AS d FROM v_series JOIN st USING (entity, stat)), md AS (SELECT entity, stat, median(d) AS mad FROM dv GROUP BY ALL)"
SLOPE = "sl AS (SELECT entity, stat, round(CASE WHEN count(*) >= 3 THEN regr_slope(v, pos) END, 6) AS slope FROM v_series GROUP BY ALL)"
CHANGE = "df AS (SELECT *, row_number() OVER w - 1 AS i, abs(v - lag(v) OVER w) AS d FROM v_series WINDOW w AS (PARTITION BY entity, stat ORDER BY pos)), cp AS (SELECT entity, stat, CASE WHEN count(*) >= 4 THEN CAST(arg_max(i, row(d, -i)) FILTER (d IS NOT NULL) AS BIGINT) END AS changepoint FROM df GROUP BY ALL)"
OUT = "ou AS (SELECT entity, stat, count(*) FILTER (mad > 0 AND n >= 4 AND 0.6745 * dv.d / mad > 3.5) AS outliers FROM dv JOIN md USING (entity, stat) JOIN st USING (entity, stat) GROUP BY ALL)"
FRAME = f"{STATS}, {SLOPE}, {CHANGE}, {OUT}, fr AS (SELECT entity, stat, n, round(m, 6) AS median, round(st.d, 6) AS p95, min_v, max_v, slope, changepoint, outliers FROM st JOIN sl USING (entity, stat) JOIN cp USING (entity, stat) JOIN ou USING (entity, stat))"


@query("agg_robust_stats", f"WITH {STATS} SELECT entity, stat, n, round(a, 6) AS q05, round(b, 6) AS q25, round(m, 6) AS median, round(c, 6) AS q75, round(st.d, 6) AS q95, round(c - b, 6) AS iqr, round(mad, 6) AS mad, min_v, max_v FROM st JOIN md USING (entity, stat)")
def _(t):
    return series.robust_stats(t("v_series"), BY)


@query("agg_slope", f"WITH {SLOPE} SELECT * FROM sl")
def _(t):
    return series.slope(t("v_series"), BY)


@query("agg_changepoint", f"WITH {CHANGE} SELECT * FROM cp")
def _(t):
    return series.changepoint(t("v_series"), BY)


@query("agg_outliers", f"WITH {STATS}, {OUT} SELECT * FROM ou")
def _(t):
    return series.outliers(t("v_series"), BY)


@query("agg_frames", f"WITH {FRAME} SELECT * FROM fr")
def _(t):
    return series.frames(t("v_series"), BY)


@query("agg_risk_score", f"WITH {FRAME} SELECT entity, round(sum(least(10.0::DOUBLE, abs(coalesce(slope, 0)) * 1.5) + least(10.0::DOUBLE, outliers * 0.75) + CASE WHEN changepoint IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS risk FROM fr GROUP BY entity")
def _(t):
    return series.risk_score(series.frames(t("v_series"), BY), ["entity"])


@query("agg_fleet_attr", f"""WITH {FRAME}, k AS (SELECT stat, count(*) AS n_drives, list_sort(list(median)) AS l, round(avg(slope), 6) AS mean_slope, round(avg(outliers), 6) AS mean_outliers, round(avg(CASE WHEN changepoint IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS changepoint_share FROM fr GROUP BY stat),
 tp AS (SELECT stat, string_agg(CAST(entity AS VARCHAR), ',' ORDER BY r) AS top_drives FROM (SELECT stat, entity, row_number() OVER (PARTITION BY stat ORDER BY abs(coalesce(slope, 0)) DESC, entity) AS r FROM fr) WHERE r <= 5 GROUP BY stat)
 SELECT stat, n_drives, l[n_drives // 2 + 1] AS median_of_medians, l[CAST(round_even(0.95 * (n_drives - 1), 0) AS BIGINT) + 1] AS p95_of_medians, mean_slope, mean_outliers, changepoint_share, top_drives FROM k JOIN tp USING (stat)""")
def _(t):
    return series.fleet_attributes(series.frames(t("v_series"), BY), "entity", "stat")


@query("win_topk_signals", f"WITH {FRAME} SELECT entity, stat, r FROM (SELECT entity, stat, row_number() OVER (PARTITION BY entity ORDER BY abs(coalesce(slope, 0)) + outliers DESC, stat) AS r FROM fr) WHERE r <= 3")
def _(t):
    return series.top_signals(series.frames(t("v_series"), BY), "entity", "stat")


@query("win_rate_change", "SELECT * FROM (SELECT entity, stat, pos, round(100 * ((v - lag(v, 2) OVER w) * 60.0 / (pos - lag(pos, 2) OVER w)) / nullif(lag(v, 2) OVER w, 0), 6) AS rate FROM v_series WINDOW w AS (PARTITION BY entity, stat ORDER BY pos)) WHERE rate >= 50")
def _(t):
    return series.rate_change(t("v_series"), BY)


@query("win_unaccumulate", "SELECT * FROM (SELECT entity, stat, pos, round(v - lag(v) OVER (PARTITION BY entity, stat ORDER BY pos), 6) AS delta FROM v_series) WHERE delta IS NOT NULL")
def _(t):
    return series.unaccumulate(t("v_series"), BY)


@query("agg_ts_reduce", "SELECT entity, stat, round(avg(v), 6) AS avg_v, max(v) AS max_v, min(v) AS min_v, arg_max(v, pos) AS latest, arg_min(v, pos) AS oldest FROM v_series GROUP BY ALL")
def _(t):
    return series.reduce_series(t("v_series"), BY)


@query("srt_nearest_rank", "SELECT entity, l[CAST(round_even(0.95 * (len(l) - 1), 0) AS BIGINT) + 1] AS p95 FROM (SELECT entity, list_sort(list(v)) AS l FROM v_series GROUP BY entity)")
def _(t):
    w, n = Window.partitionBy("entity").orderBy("v", "pos"), F.count(F.lit(1)).over(Window.partitionBy("entity"))
    s = t("v_series").withColumn("i", F.row_number().over(w) - 1).withColumn("n", n)
    return s.filter(F.col("i") == F.bround(0.95 * (F.col("n") - 1)).cast("long")).select("entity", F.col("v").alias("p95"))


@query("srt_topk_series", "SELECT entity, pos, v FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY v DESC, pos) AS r FROM v_series) WHERE r <= 3")
def _(t):
    w = Window.partitionBy("entity").orderBy(F.desc("v"), "pos")
    return t("v_series").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("entity", "pos", "v")


@query("agg_daily_collapse", "SELECT drive, day, CAST(sum(errors) AS BIGINT) AS errors, arg_max(written, row(o1, o2, o3)) AS written, CAST(max(flag) AS BIGINT) AS flag, arg_max(model, row(o1, o2, o3)) AS model FROM v_drive_rows GROUP BY ALL")
def _(t):
    return drive.daily_collapse(t("v_drive_rows"), ["o1", "o2", "o3"])


FILL = "sp AS (SELECT drive, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT drive, min(day)::TIMESTAMP AS d0, max(day)::TIMESTAMP AS d1 FROM v_drive_daily GROUP BY drive)), fill AS (SELECT sp.drive, sp.day, coalesce(errors, 0) AS errors, coalesce(flag, 0) AS flag, last_value(wear IGNORE NULLS) OVER (PARTITION BY sp.drive ORDER BY sp.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wear FROM sp LEFT JOIN v_drive_daily d ON d.drive = sp.drive AND d.day = sp.day)"
ENDS = "isl AS (SELECT drive, day, day - CAST(row_number() OVER (PARTITION BY drive ORDER BY day) AS INTEGER) AS g FROM v_drive_daily), ends AS (SELECT drive, day AS window_end FROM (SELECT drive, day, row_number() OVER (PARTITION BY drive, g ORDER BY day) AS run FROM isl) WHERE run >= 2)"


MODELS = "dm AS (SELECT drive, day, CASE WHEN errors % 3 > 0 THEN 'm' || flag END AS model FROM v_drive_daily)"


@query("win_gap_fill", f"WITH {FILL}, {MODELS}, fm AS (SELECT fill.*, dm.model AS own FROM fill LEFT JOIN dm USING (drive, day)) SELECT drive, day, errors, flag, wear, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY drive ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own IGNORE NULLS) OVER (PARTITION BY drive ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS model FROM fm")
def _(t):
    return drive.gap_fill(t("v_drive_daily").withColumn("model", F.when(F.col("errors") % 3 > 0, F.concat(F.lit("m"), F.col("flag").cast("string")))))


RUNS = "isl AS (SELECT drive, day, day - CAST(row_number() OVER (PARTITION BY drive ORDER BY day) AS INTEGER) AS g FROM v_dense), rn AS (SELECT drive, day, row_number() OVER (PARTITION BY drive, g ORDER BY day) AS run FROM isl)"


@query("win_consecutive30", f"WITH {RUNS} SELECT drive, day AS window_end FROM rn WHERE run >= 30")
def _(t):
    return drive.consecutive(t("v_dense"), 30)


@query("prj_flatten_window", f"WITH {RUNS}, fl AS (SELECT drive, day, " + ", ".join(f"lag(errors, {29 - i}) OVER w AS e_t{i:02d}" for i in range(30)) + " FROM v_dense WINDOW w AS (PARTITION BY drive ORDER BY day)) SELECT fl.* FROM fl JOIN rn USING (drive, day) WHERE run >= 30")
def _(t):
    return drive.flatten_window(drive.window_values(t("v_dense"), 30), "e", 30)


@query("win_first_healthy", f"WITH {ENDS} SELECT drive, min(window_end) AS window_end FROM ends WHERE drive NOT IN (SELECT drive FROM v_failure WHERE drive % 2 = 0) GROUP BY drive")
def _(t):
    return drive.first_healthy(drive.consecutive(t("v_drive_daily"), 2), t("v_failure").filter("drive % 2 = 0"))


@query("jn_asof_window", f"WITH {ENDS} SELECT drive, max(window_end) AS window_end, min(CAST(fail_day - window_end AS BIGINT)) AS ttf FROM ends JOIN v_failure USING (drive) WHERE fail_day - window_end BETWEEN 0 AND 300 GROUP BY drive")
def _(t):
    return drive.last_before_failure(drive.consecutive(t("v_drive_daily"), 2), t("v_failure"), 300)


@query("win_last_before_failure", "SELECT drive, day AS window_end, CAST(fail_day - day AS BIGINT) AS ttf FROM (SELECT *, row_number() OVER (PARTITION BY drive ORDER BY day DESC) AS r FROM v_drive_daily JOIN v_failure USING (drive) WHERE fail_day - day BETWEEN 0 AND 30) WHERE r = 1")
def _(t):
    return drive.last_before_failure(t("v_drive_daily").select("drive", F.col("day").alias("window_end")), t("v_failure"))


@query("jn_left_failure", "SELECT s_suppkey AS drive, least(a, b, c) AS fail_day FROM supplier LEFT JOIN (SELECT drive, min(day) AS a FROM v_drive_daily WHERE errors >= 45 GROUP BY drive) x ON x.drive = s_suppkey LEFT JOIN (SELECT drive, min(day) AS b FROM v_drive_daily WHERE wear >= 3000 GROUP BY drive) y ON y.drive = s_suppkey LEFT JOIN (SELECT drive, min(day) AS c FROM v_drive_daily WHERE errors = 50 GROUP BY drive) z ON z.drive = s_suppkey")
def _(t):
    d = t("v_drive_daily")
    first = lambda cond, n: d.filter(cond).groupBy("drive").agg(F.min("day").alias(n))
    return drive.failure_day(t("supplier").select(F.col("s_suppkey").alias("drive")), [first("errors >= 45", "a"), first("wear >= 3000", "b"), first("errors = 50", "c")])


@query("jn_semi_candidates", "SELECT DISTINCT drive, day FROM v_drive_daily WHERE drive IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    return t("v_drive_daily").join(t("supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("drive")), "drive", "left_semi").select("drive", "day").distinct()


@query("jn_anti_failed", "SELECT s_suppkey AS drive FROM supplier WHERE s_suppkey NOT IN (SELECT drive FROM v_drive_daily WHERE errors >= 100)")
def _(t):
    return t("supplier").select(F.col("s_suppkey").alias("drive")).join(t("v_drive_daily").filter("errors >= 100"), "drive", "left_anti")


@query("agg_first_failure", "SELECT drive, min(day) AS fail_day, arg_min(model, row(day, o1, o2, o3)) AS model FROM v_drive_rows WHERE errors > 0 GROUP BY drive")
def _(t):
    return drive.first_failure(t("v_drive_rows").filter("errors > 0"), ["o1", "o2", "o3"])


@query("agg_app_hist", "SELECT o_orderpriority AS app, n, CAST(count(*) OVER () AS BIGINT) AS distinct_apps FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, app LIMIT 10")
def _(t):
    c = t("orders").groupBy(F.col("o_orderpriority").alias("app")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("app", "n", F.count(F.lit(1)).over(Window.partitionBy()).alias("distinct_apps")).orderBy(F.desc("n"), "app").limit(10)


@query("agg_rows_by_year_model", "SELECT CAST(year(day) AS INTEGER) AS year, model, count(*) AS n FROM v_drive_rows GROUP BY ROLLUP (year(day), model)")
def _(t):
    return t("v_drive_rows").rollup(F.year("day").alias("year"), "model").agg(F.count(F.lit(1)).alias("n"))


@query("win_dedup_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(t):
    return drive.dedup_keep_first(t("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 100).select("o_custkey", "o_orderkey")


def _dealt(seed, key):
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"


@query("win_cohort", f"SELECT {_dealt(1, 's_suppkey')} % (SELECT greatest(1, CAST(ceil(count(*) / 10.0) AS BIGINT)) FROM supplier) AS cohort, count(*) AS n FROM supplier GROUP BY 1")
def _(t):
    return drive.cohorts(t("supplier").select("s_suppkey"), "s_suppkey", 10, 1).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@query("win_ratio_sample", f"""WITH h AS (SELECT count(*) FILTER (pred = 1) AS n1, count(*) FILTER (pred = 0) AS n0 FROM v_pred), w AS (SELECT least(n1, greatest(30, 100 - n0)) AS pos, n0 FROM h), v AS (SELECT pos, least(n0, 100 - pos) AS neg FROM w),
  r AS (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY {_dealt(1, 'sample_id')}, sample_id) AS r FROM v_pred WHERE pred IN (0, 1)) SELECT sample_id, task, truth, pred, pred AS label FROM r, v WHERE r <= CASE pred WHEN 1 THEN pos ELSE neg END""")
def _(t):
    return drive.ratio_sample(t("v_pred").withColumn("label", F.col("pred")), "label", "sample_id", 100, 0.3, 1)


@query("jn_pair_random", f"""WITH a AS (SELECT c_custkey, {_dealt(0, 'c_custkey')} % 8 AS p, row_number() OVER (PARTITION BY {_dealt(0, 'c_custkey')} % 8 ORDER BY {_dealt(1, 'c_custkey')}, c_custkey) - 1 AS i FROM customer),
  b AS (SELECT p_partkey, {_dealt(0, 'p_partkey')} % 8 AS p, row_number() OVER (PARTITION BY {_dealt(0, 'p_partkey')} % 8 ORDER BY {_dealt(1, 'p_partkey')}, p_partkey) - 1 AS i FROM part), n AS (SELECT p, count(*) AS n FROM b GROUP BY p)
  SELECT c_custkey, p_partkey FROM a JOIN n USING (p) JOIN b ON b.p = a.p AND b.i = a.i % n""")
def _(t):
    return drive.pair_by_position(t("customer").select("c_custkey"), t("part").select("p_partkey"), "c_custkey", "p_partkey", 8)


@query("agg_confusion", "SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0)::DOUBLE, 0), 6) AS accuracy FROM (SELECT count(*) FILTER (truth = 1 AND pred = 1) AS tp, count(*) FILTER (truth = 0 AND pred = 1) AS fp, count(*) FILTER (truth = 1 AND pred = 0) AS fn, count(*) FILTER (truth = 0 AND pred = 0) AS tn FROM v_pred)")
def _(t):
    return scoring.confusion(t("v_pred"))


@query("agg_mse", "SELECT round(avg((truth - pred) * (truth - pred)), 6) AS mse FROM v_pred")
def _(t):
    return scoring.mse(t("v_pred"))


@query("agg_task_means", "SELECT task, count(*) AS n, round(avg(CASE WHEN truth = 1 THEN pred END), 6) AS mean_score FROM v_pred GROUP BY task")
def _(t):
    return scoring.task_means(t("v_pred").withColumn("score", F.when(F.col("truth") == 1, F.col("pred"))))


@query("jn_pred_truth", "SELECT task, count(*) AS n, CAST(sum(truth) AS BIGINT) AS truths FROM v_pred JOIN documents ON sample_id = doc_id GROUP BY task")
def _(t):
    return t("v_pred").join(t("documents").select(F.col("doc_id").alias("sample_id")), "sample_id").groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("truths"))


@query("jn_fleet_pred", "SELECT s_suppkey AS drive, CASE WHEN fail_day IS NULL THEN 0 ELSE 1 END::BIGINT AS flag FROM supplier LEFT JOIN (SELECT * FROM v_failure WHERE drive % 3 = 0) f ON f.drive = s_suppkey")
def _(t):
    return scoring.fleet_flags(t("supplier").select(F.col("s_suppkey").alias("drive")), t("v_failure").filter("drive % 3 = 0").select("drive", F.lit(1).cast("long").alias("flag")), "drive")


@query("jn_refs_lookup", "SELECT n_nationkey, coalesce(r_name, '') AS ref FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n_regionkey = r_regionkey")
def _(t):
    r = t("region").filter("r_regionkey < 3")
    return t("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", F.coalesce("r_name", F.lit("")).alias("ref"))


@query("fn_tokenize", r"SELECT item_id, list_aggregate(regexp_extract_all(lower(trim(text)), '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)?|[%°]+|[^\s]'), 'string_agg', '|') AS toks FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", F.array_join(scoring.tokens(F.col("text")), "|").alias("toks"))


def _pairs(t):
    b = t("benchmark")
    return b.select("item_id", F.col("text").alias("cand")).join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("ref")), "item_id")


NG = r"tk AS (SELECT a.item_id, regexp_extract_all(lower(trim(a.text)), '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)?|[%°]+|[^\s]') AS c, regexp_extract_all(lower(trim(b.text)), '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)?|[%°]+|[^\s]') AS r FROM benchmark a JOIN benchmark b ON b.item_id - 1 = a.item_id)"


@query("fn_bleu4", f"""WITH {NG}, ns AS (SELECT unnest([1, 2, 3, 4]) AS n),
 ga AS (SELECT item_id, n, g, count(*) AS x FROM (SELECT item_id, n, unnest(list_transform(range(1, len(c) - n + 2), lambda i: array_to_string(c[i:i + n - 1], ' '))) AS g FROM tk, ns) GROUP BY ALL),
 gb AS (SELECT item_id, n, g, count(*) AS y FROM (SELECT item_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM tk, ns) GROUP BY ALL),
 m AS (SELECT item_id, n, sum(least(x, coalesce(y, 0))) AS hit, sum(x) AS total FROM ga LEFT JOIN gb USING (item_id, n, g) GROUP BY ALL), p AS (SELECT item_id, sum(ln((hit + 1e-9) / (total + 1e-9))) AS logs FROM m GROUP BY item_id)
 SELECT item_id, round(CASE WHEN len(c) < 4 THEN 0 ELSE (CASE WHEN len(c) > len(r) THEN 1 ELSE exp(1 - len(r) / greatest(len(c), 1)::DOUBLE) END) * exp(logs / 4) END, 6) AS bleu FROM tk LEFT JOIN p USING (item_id)""")
def _(t):
    return scoring.bleu4(_pairs(t), "item_id")


@query("fn_rouge_l", f"""WITH RECURSIVE {NG}, l AS (
    SELECT item_id, 0 AS i, list_transform(r, lambda z: 0) AS line FROM tk
    UNION ALL
    SELECT item_id, i + 1, list_transform(range(1, len(cand) + 1), lambda j: list_max(cand[1:j])) FROM (
      SELECT l.item_id, i, list_transform(range(1, len(r) + 1), lambda j: CASE WHEN r[j] = c[i + 1] THEN coalesce(line[j - 1], 0) + 1 ELSE line[j] END) AS cand FROM l JOIN tk ON tk.item_id = l.item_id WHERE i < len(c))),
  e AS (SELECT tk.item_id, coalesce(list_max(line), 0) AS n, len(c) AS nc, len(r) AS nr FROM l JOIN tk ON tk.item_id = l.item_id AND i = len(c)),
  f AS (SELECT item_id, coalesce(n / nullif(nc, 0)::DOUBLE, 0) AS p, coalesce(n / nullif(nr, 0)::DOUBLE, 0) AS q FROM e)
  SELECT item_id, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS rouge_l FROM f""")
def _(t):
    return scoring.rouge_l(_pairs(t), "item_id")


@query("fn_fip", "SELECT o_custkey, round(coalesce(count(*) FILTER (o_orderstatus IN ('O', 'F')) / nullif(count(*), 0)::DOUBLE, 0), 6) AS fip FROM orders GROUP BY 1")
def _(t):
    claims = t("orders").groupBy("o_custkey").agg(F.collect_list(F.array(F.concat(F.lit("IR:AF_"), "o_orderstatus"))).alias("claims"))
    return claims.select("o_custkey", scoring.fip(F.col("claims"), F.array(F.lit("AF_O"), F.lit("AF_F"))).alias("fip"))


@query("fn_cfv", "SELECT o_custkey, round(coalesce(count(*) FILTER (o_orderpriority LIKE '%URGENT%' AND o_totalprice > 0) / nullif(count(*), 0)::DOUBLE, 0), 6) AS cfv FROM orders GROUP BY 1")
def _(t):
    s = F.struct(F.array("o_orderkey").alias("evidence"), F.when(F.col("o_orderpriority").contains("URGENT"), "up").alias("direction"))
    return t("orders").groupBy("o_custkey").agg(F.collect_list(s).alias("s")).select("o_custkey", scoring.cfv(F.col("s")).alias("cfv"))
