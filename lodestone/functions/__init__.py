"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIO_KEYS = ["rw", "bs", "iodepth", "numjobs", "rwmixread", "random_distribution", "bssplit"]  # fixed values: the known job keys

# fixed values: health attributes, those that a drive model does not report, and those that counters of another log stand for
SMART = ["r_5", "r_9", "r_12", "r_173", "r_174", "r_175", "r_177", "r_180", "r_181", "r_182", "r_183", "r_184", "r_187", "r_195", "r_197", "r_199", "r_233", "r_241", "r_242"]
DROPPED = {
    "MA1": ["r_177", "r_181", "r_182", "r_183", "r_233", "r_241", "r_242"],
    "MA2": ["r_173", "r_177", "r_180", "r_181", "r_182", "r_195"],
    "MB1": ["r_173", "r_174", "r_175", "r_233"],
    "MB2": ["r_173", "r_174", "r_175", "r_233"],
    "MC1": ["r_175", "r_177", "r_181", "r_182", "r_233", "r_241", "r_242"],
    "MC2": ["r_175", "r_177", "r_181", "r_182", "r_233", "r_241", "r_242"],
}
COUNTERS = {"write_count": "r_241", "read_count": "r_242", "uncorrectable_error": "r_187", "correctable_error": "r_195", "erase_error": "r_182", "write_error": "r_181"}
MAPPED = [c for c in SMART if c not in DROPPED["MB1"]]


def drop_by_model(df: DataFrame, model: str, dropped: dict[str, list[str]] | None = None) -> DataFrame:
    """Attributes that a row's model does not report become null; models without a list keep all."""
    lists = DROPPED if dropped is None else dropped
    gone = lambda c: F.col(model).isin(*[m for m, cs in lists.items() if c in cs])
    return df.select(*[F.when(F.coalesce(~gone(c), F.lit(True)), F.col(c)).alias(c) if any(c in cs for cs in lists.values()) else F.col(c) for c in df.columns])


def of_model(df: DataFrame, model: str, name: str, ids: list[str] | None = None) -> DataFrame:
    """The rows of one model with the attributes it reports, in order."""
    kept = [c for c in SMART if c not in DROPPED.get(name, []) and c in df.columns]
    return df.filter(F.col(model) == name).select(*(ids or ["disk_id", "ds"]), *kept)


def map_features(df: DataFrame) -> DataFrame:
    """Adds the attributes of MAPPED: from the counter that stands for one, where it is there and a number, else 0."""
    of = {r: c for c, r in COUNTERS.items() if c in df.columns}
    return df.select("*", *[F.coalesce(F.col(of[r]).try_cast("double"), F.lit(0.0)).alias(r) if r in of else F.lit(0.0).alias(r) for r in MAPPED])


# fixed values: columns of the optional sections
ENVIRONMENT = ["temperature_c", "relative_humidity_pct", "vibration_freq_hz", "vibration_amp_g", "throughput_change_pct", "tail_latency_change_pct", "study", "condition_id"]


def section(columns: list[str], keys: list[str], ids: list[str], default: str) -> Column:
    """The given keys whose columns are there and not blank, as a map with an `id`: the first of the id columns that is not
    blank, else the default. Null if no key is."""
    have = [k for k in keys if k in columns]
    if not have:
        return F.lit(None).cast("map<string,string>")
    text = lambda k: F.nullif(F.trim(F.col(k).cast("string")), F.lit(""))
    found = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, have)), F.array(*map(text, have))), lambda _, v: v.isNotNull())
    own = F.coalesce(*[text(i) for i in ids if i in columns], F.lit(default))
    return F.when(F.cardinality(found) > 0, F.map_concat(found, F.create_map(F.lit("id"), own)))


def first_alias(df_columns: list[str], names: list[str]) -> Column:
    """First non-blank of the alias columns that exist."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df_columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def parse_series(text: Column) -> Column:
    """A JSON list, a ; or , list, or a scalar as array of doubles; what is no number goes."""
    t = F.trim(text)
    json = F.from_json(t, "array<double>")
    parts = F.split(F.regexp_replace(t, r"[\[\]\s]", ""), "[;,]")
    return F.coalesce(F.when(t.startswith("["), json), F.filter(F.transform(parts, lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x)))


def norm_date(text: Column) -> Column:
    """Mixed date texts as a date."""
    t = F.trim(text)
    return F.coalesce(F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")), F.when(t.rlike(r"^\d{4}/\d{2}/\d{2}"), F.try_to_date(F.substring(t, 1, 10), "yyyy/MM/dd")))


def file_date(path: Column) -> Column:
    """The first date in a file's own name: year, month and day with or without a dash or line between."""
    d = F.regexp_extract(path, r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[^/]*$", 0)
    return F.try_to_date(F.substring(F.regexp_replace(d, r"\D", ""), 1, 8), "yyyyMMdd")


def safe_id(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_"), 1, 72)


def slug(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 128)


def fio_value(job: Column, key: str) -> Column:
    """Value of a key of a job text."""
    return F.nullif(F.trim(F.regexp_extract(job, rf"(?m)^\s*{key}\s*=\s*([^\n\r]+)", 1)), F.lit(""))


def policies(text: Column) -> Column:
    """k=v;k=v as a map."""
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def policy_list(text: Column) -> Column:
    """The policies of a text with semicolons, trimmed, blank ones left out; null if there is none."""
    found = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found)


def extract_json(text: Column) -> Column:
    """The outermost {...} of a text."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


# fixed values: words of the evidence that turn a verb
BETTER = ["improve", "decrease", "reduced", "lower"]
WORSE = ["increase", "worse", "degrade", "higher"]


def fix_verb(verb: Column, evidence: Column) -> Column:
    """Turns `degrades` where the evidence has a word of the better, and `improves` where it has one of the worse."""
    e = F.lower(F.coalesce(evidence, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: e.contains(w))
    return F.when((verb == "degrades") & has(BETTER), "improves").when((verb == "improves") & has(WORSE), "degrades").otherwise(verb)


def observations(c: dict[str, Column]) -> Column:
    """Names of the threshold rules that hold, of columns hit, pressure, inline, iter, churn_slope, tail_slope."""
    rules = [("low_hit", c["hit"] < 0.85), ("cache_pressure", c["pressure"] > 0.5), ("low_inline", c["inline"] < 0.4), ("iterators", c["iter"] > 0), ("churn_up", c["churn_slope"] > 0), ("tail_up", c["tail_slope"] > 0)]
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def query_terms(c: dict[str, Column], terms: dict[str, list[str]]) -> Column:
    """Search terms of the signals that are present."""
    return F.flatten(F.array(*[F.when(c[k].isNotNull(), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in terms.items()]))


def value_distribution(text: Column) -> Column:
    """A histogram given as a JSON object, as a map."""
    return F.from_json(text, "map<string,double>")


def policy_string(gc: Column, wl: Column) -> Column:
    return F.concat_ws(";", F.concat(F.lit("gc="), gc), F.concat(F.lit("wl="), wl))


def xor_bytes(a: Column, b: Column) -> Column:
    """XOR of two binary values byte by byte; the longer one's tail stays."""

    @F.pandas_udf("binary")
    def run(x, y):
        import pandas as pd

        def one(p, q):
            if p is None or q is None:
                return None
            n = max(len(p), len(q))
            return (int.from_bytes(p.ljust(n, b"\0"), "big") ^ int.from_bytes(q.ljust(n, b"\0"), "big")).to_bytes(n, "big")

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=object)

    return run(a, b)


def paper_id(file: Column) -> Column:
    """A file's name without its ending, in letters, digits, dots, lines and dashes."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", ""), 1, 128)


def chunks(text: Column, size: int = 2000) -> Column:
    """Pieces of a text of fixed length."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
