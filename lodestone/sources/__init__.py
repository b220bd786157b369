"""Readers: request traces, row files, simulator XML, logs, drive logs, job files, papers, triples. All read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import functions as fn

TRACE_COLUMNS = ["ts", "key", "key_size", "value_size", "client_id", "op", "ttl"]
KVPACK_DEFAULTS = {"source": "kvpack", "kv_ftl": "KVPack"}  # fixed values
# fixed values: paths in simulator results and the columns they fill, later ones over earlier ones
SIM_PATHS = [
    ("//Device_Throughput_KOPS", "throughput_kops"),
    ("//Device_Throughput", "throughput_kops"),
    ("//Average_Read_Latency", "read_latency_p50_us"),
    ("//Read_Latency_P99", "read_latency_p99_us"),
    ("//Read_Latency_P999", "tail_latency_p999_us"),
    ("//Tail_Latency_P999", "tail_latency_p999_us"),
    ("//Write_Amplification", "write_amplification"),
    ("//Read_Amplification", "read_amplification"),
    ("//GC_Overhead", "gc_overhead_pct"),
    ("//Average_Value_Size", "value_size_bytes"),
    ("//Average_Key_Size", "key_size_bytes"),
    ("//Read_Write_Ratio", "read_write_ratio"),
    ("//Access_Skew", "access_skew"),
    ("//Device_Vendor", "vendor"),
    ("//Device_Model", "model"),
    ("//Firmware_Version", "firmware"),
    ("//Device_Capacity_GB", "capacity_gb"),
    ("//Interface_Type", "interface"),
]
FLOW_PATHS = [("//Request_Count", "requests"), ("//IOPS", "iops"), ("//Bandwidth", "bandwidth"), ("//Device_Response_Time", "response_time")]  # fixed values: tags of a flow
# fixed values: what store logs say
LOG_PATTERNS = {
    "gb_written": r"(?i)Cumulative writes:.*?(\d[\d.]*)\s*GB written",
    "gb_read": r"(?i)Cumulative reads:.*?(\d[\d.]*)\s*GB read",
    "user_gb": r"(?i)User writes:.*?(\d+\.?\d*)\s*GB",
    "write_amplification": r"(?i)write[- ]amplification[:\s]+(\d+\.?\d*)",
    "read_amplification": r"(?i)read[- ]amplification[:\s]+(\d+\.?\d*)",
    "compact_s": r"(?i)Compact\(s\)\s*:\s*(\d+\.?\d*)",
    "p50": r"(?is)Percentile.*?50th[^0-9]*(\d+\.?\d*)\s*us",
    "p99": r"(?is)Percentile.*?99th[^0-9]*(\d+\.?\d*)\s*us",
    "p999": r"(?is)Percentile.*?99\.9[^0-9]*(\d+\.?\d*)\s*us",
    "ops": r"(?i)([\d.]+)\s*ops/sec",
}


def trace_csv(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Headless request trace; rows that are short or hold no numbers go, but count for max_rows.

    max_rows needs line order: lines are numbered by place in the file, and only that case pays for it.
    """
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    if max_rows is not None:
        from lodestone.operators.order import numbered

        raw = numbered(raw, ["line_no"], name="_place").filter(F.col("_place") < max_rows).drop("_place")
    p = F.split("value", ",")
    num = lambda i, t: F.try_element_at(p, F.lit(i)).try_cast(t)
    text = lambda i: F.try_element_at(p, F.lit(i))
    out = raw.filter(F.size(p) >= 7).select("line_no", num(1, "long").alias("ts"), text(2).alias("key"), num(3, "int").alias("key_size"), num(4, "int").alias("value_size"), text(5).alias("client_id"), text(6).alias("op"), num(7, "long").alias("ttl"))
    return out.filter("ts is not null and key_size is not null and value_size is not null and ttl is not null")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, JSON (object or list) or JSON lines, by suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    return spark.read.option("multiLine", path.endswith(".json")).json(path)


def kvpack(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """JSON lines cut to the allowed columns; broken lines go; defaults for source and kv_ftl."""
    df = spark.read.option("mode", "DROPMALFORMED").json(path)
    df = df.select(*[c for c in allowed if c in df.columns])
    for k, v in KVPACK_DEFAULTS.items():
        df = df.withColumn(k, F.coalesce(F.col(k).cast("string"), F.lit(v)) if k in df.columns else F.lit(v))
    return df


def sim_xml(spark: SparkSession, path: str, paths: list[tuple[str, str]] | None = None) -> DataFrame:
    """(file, names of `paths`, and <name>_number): the first text at each path of every simulator result file.

    Where several paths have one name, the last that is found counts. Texts are trimmed; numbers where they are.
    """
    paths = SIM_PATHS if paths is None else paths
    w = spark.read.text(path, wholetext=True).select(F.col("value").alias("_xml"), F.col("_metadata.file_path").alias("file"))
    names = list(dict.fromkeys(name for _, name in paths))
    found = {n: F.coalesce(*[F.nullif(F.trim(F.get(F.xpath("_xml", F.lit(f"{at}/text()")), F.lit(0))), F.lit("")) for at, name in reversed(paths) if name == n]) for n in names}
    return w.select("file", *[c.alias(n) for n, c in found.items()]).select("*", *[F.col(n).try_cast("double").alias(f"{n}_number") for n in names])


def kv_log(spark: SparkSession, path: str) -> DataFrame:
    """(file, and a column for each of LOG_PATTERNS): what each store log says; the first match counts.

    Write amplification that a log does not give is what was written over what users wrote.
    """
    w = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    num = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("double")
    w = w.select("file", *[num(p).alias(name) for name, p in LOG_PATTERNS.items()]).withColumn("kops", F.col("ops") / 1000)
    return w.withColumn("write_amplification", F.coalesce("write_amplification", F.when(F.col("user_gb") > 0, F.col("gb_written") / F.col("user_gb"))))


def log_stats(lines: DataFrame) -> DataFrame:
    """`name P50 : x P95 : y P99 : z COUNT : n SUM : s` lines (ts, line) as long rows (ts, stat, v)."""
    name = F.regexp_extract("line", r"([A-Za-z][\w.]*)\s+P50", 1)
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(r"(P\d+|COUNT|SUM)\s*:\s*[\d.]+"), F.lit(1)).alias("k"), F.regexp_extract_all("line", F.lit(r"(?:P\d+|COUNT|SUM)\s*:\s*([\d.]+)"), F.lit(1)).alias("v"))
    out = lines.filter(name != "").select("ts", name.alias("name"), F.explode(pairs).alias("p"))
    return out.select("ts", F.concat_ws(".", "name", F.lower(F.col("p.k"))).alias("stat"), F.col("p.v").try_cast("double").alias("v"))


def daily_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Many daily CSV files at any depth; the day `ds` comes from the file's own name, and rows of files without one go.

    Header names are matched by file; a schema spares reading all files to guess it.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*")
    df = (reader.schema(schema).option("enforceSchema", False) if schema else reader).csv(path)
    return df.withColumn("ds", fn.file_date(F.col("_metadata.file_name"))).filter("ds IS NOT NULL")


def parquet_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Column-pruned scan; ds falls back to log_date; missing columns are null."""
    df = spark.read.parquet(path)
    if "ds" not in df.columns and "log_date" in df.columns:
        df = df.withColumnRenamed("log_date", "ds")
    return ensure_columns(df, columns)


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds missing columns as null and orders all."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def error_log(spark: SparkSession, path: str, counters: list[str]) -> DataFrame:
    """Drive error log: missing counters are 0, microseconds become days."""
    df = spark.read.option("header", True).csv(path)
    num = [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in counters]
    return df.select("drive_id", F.timestamp_micros(F.col("timestamp_usec").cast("long")).cast("date").alias("day"), *num)


def fio_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job files as rows: name, text and the known keys; the global section is left out."""
    w = spark.read.text(path, wholetext=True)
    part = F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\[[^\]\n]+\][^\[]*)"), F.lit(1)))
    j = w.select(part.alias("job_text")).withColumn("job_name", F.regexp_extract("job_text", r"^\[([^\]]+)\]", 1)).filter("job_name <> 'global'")
    return j.select("job_name", "job_text", *[fn.fio_value(F.col("job_text"), k).alias(k) for k in fn.FIO_KEYS])


def fio_grid(kinds: DataFrame, sizes: list[str], depths: list[int]) -> DataFrame:
    """A job for each kind of request (column rw) with each of a few block sizes and queue depths."""
    each = lambda v: F.explode(F.array(*map(F.lit, v)))
    return kinds.withColumn("bs", each(sizes)).withColumn("iodepth", each(depths).alias("iodepth")).withColumn("iodepth", F.col("iodepth").cast("long"))


def papers(spark: SparkSession, path: str, size: int = 2000) -> DataFrame:
    """Texts of a folder in chunks of a fixed length: (paper, file, chunk, text); `paper` is the file's name without ending, made safe."""
    w = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.url_decode(F.regexp_replace("_metadata.file_name", r"\+", "%2B")).alias("file"), "value")
    return w.select(fn.paper_id(F.col("file")).alias("paper"), "file", F.posexplode(fn.chunks(F.col("value"), size)).alias("chunk", "text"))


def statements(tokens: list[str]) -> list[dict]:
    """Triples of a Turtle document's tokens, in one pass."""
    out, s, p = [], "", ""
    for x in tokens:
        if x == ".":
            s = p = ""
        elif x == ";":
            p = ""
        elif x == ",":
            continue
        elif not s:
            s = x
        elif not p:
            p = x
        else:
            out.append({"s": s, "p": p, "o": x})
    return out


def _statements(tokens):
    """statements() of an array column, over Arrow batches."""

    @F.pandas_udf("array<struct<s:string,p:string,o:string>>")
    def run(t):
        import pandas as pd

        return pd.Series([statements(x.tolist()) for x in t], dtype=object)

    return run(tokens)


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files of the plain kind: one subject a block, predicates by `;`, objects by `,`."""
    w = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)^\s*(@prefix|@base|#)[^\n]*$", "").alias("v"))
    lit = r"\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\]|\\.)*\"(?:@[\w-]+|\^\^[\w:<>/#.\-]+)?|<[^>]*>|[^\s;,.\"]+(?:\.[^\s;,.\"]+)*|[;,.]"
    tok = w.select(F.monotonically_increasing_id().alias("f"), F.regexp_extract_all("v", F.lit(f"({lit})"), F.lit(1)).alias("t"))
    out = tok.select(F.inline(_statements(F.col("t"))))
    return out.select("s", F.when(F.col("p") == "a", "rdf:type").otherwise(F.col("p")).alias("p"), F.regexp_replace("o", r'^"+|"+(@[\w-]+|\^\^.*)?$', "").alias("o"), F.col("o").startswith('"').alias("o_is_literal")).distinct()


def trace_text(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Query, block-cache and IO traces in their text form, by schema."""
    return spark.read.schema(columns).csv(path, mode="DROPMALFORMED")


def synthetic(times: DataFrame, addresses: int, mode: str = "hotcold", hot: float = 0.2, hot_tenths: int = 8, read_tenths: int = 5, seed: int = 1) -> DataFrame:
    """A synthetic request (time, address, type) for each time: streaming, uniform, or hot and cold addresses. The draws are
    hashes of the time, so they are the same wherever they are made."""
    from lodestone.operators.drive import dealt

    u, v, w = (dealt(seed + i, "time") for i in range(3))
    top, warm = F.lit(1 << 32), int(addresses * hot)
    cold = F.lit(warm) + F.pmod(u, F.lit(max(addresses - warm, 1)))
    pick = {"streaming": F.pmod("time", F.lit(max(addresses, 1))), "uniform": F.pmod(u, F.lit(max(addresses, 1))), "hotcold": F.when(v * 10 < hot_tenths * top, F.pmod(u, F.lit(max(warm, 1)))).otherwise(cold)}[mode]
    return times.select("time", pick.cast("long").alias("address"), (w * 10 < read_tenths * top).cast("int").alias("type"))


def replayed(trace: DataFrame, ts: str = "ts", fast_forward: float = 1.0) -> DataFrame:
    """Adds `due`: when a replay runs each operation, in seconds from its start; fast_forward times as fast as recorded."""
    if fast_forward <= 0:
        raise ValueError("a replay goes forward")
    first = trace.agg(F.min(ts).alias("_first"))  # one row
    return trace.crossJoin(F.broadcast(first)).withColumn("due", (F.col(ts) - F.col("_first")) / F.lit(float(fast_forward))).drop("_first")


def benchmark_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark report; rows whose ops_sec is no number go."""
    df = spark.read.option("sep", "\t").option("header", True).csv(path)
    return df.withColumn("ops_sec", F.col("ops_sec").try_cast("double")).filter("ops_sec is not null")


def unpivot(df: DataFrame, ids: list[str], name: str, value: str) -> DataFrame:
    """Pivoted statistics as long rows."""
    return df.unpivot(ids, [c for c in df.columns if c not in ids], name, value)


def options_ini(spark: SparkSession, path: str) -> DataFrame:
    """Option files as (section, name, value)."""
    w = spark.read.text(path, wholetext=True)
    s = w.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^\s*(\[[^\]\n]+\][^\[]*)"), F.lit(1))).alias("x"))
    s = s.select(F.regexp_extract("x", r"^\[([^\]]+)\]", 1).alias("section"), F.explode(F.regexp_extract_all("x", F.lit(r"(?m)^\s*([\w.]+\s*=\s*[^\n\r]*)"), F.lit(1))).alias("kv"))
    return s.select("section", F.trim(F.split_part("kv", F.lit("="), F.lit(1))).alias("name"), F.trim(F.regexp_extract("kv", r"=(.*)$", 1)).alias("value"))
