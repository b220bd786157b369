"""Scores of predictions and responses: confusion, errors, task means, grounding, text overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.trace import ratio


def confusion(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, tn and precision, recall, accuracy (0 where undefined) of truth and pred."""
    hit = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("pred") == p))
    c = pairs.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    r = lambda a, b: F.round(ratio(a, b), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("*", r(tp, tp + fp).alias("precision"), r(tp, tp + fn).alias("recall"), r(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def mse(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg(F.pow(F.col("truth") - F.col("pred"), 2)), 6).alias("mse"))


def task_means(scores: DataFrame) -> DataFrame:
    """Per task: rows and mean of the scores that are there."""
    return scores.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def fleet_flags(drives: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Every drive with its predicted flag, 0 where it is absent."""
    return drives.join(predicted, key, "left").select(key, F.coalesce("flag", F.lit(0)).alias("flag"))


def known_ref(refs: Column, ref: Column) -> Column:
    """Whether a reference, without its IR, ENV or LIT mark, is known; literature ids always are."""
    bare = F.regexp_replace(ref, r"^(IR|ENV|LIT):", "")
    return bare.startswith("LIT_") | F.array_contains(refs, bare)


def fip(claims: Column, refs: Column) -> Column:
    """Share of claims (array of support arrays) that have support, all of it known; 0 without claims."""
    good = F.size(F.filter(claims, lambda s: (F.size(s) > 0) & F.forall(s, lambda r: known_ref(refs, r))))
    return F.round(ratio(good, F.size(claims)), 6)


def cfv(statements: Column) -> Column:
    """Share of statements (evidence, direction) with evidence and a direction; 0 without statements."""
    good = F.size(F.filter(statements, lambda s: (F.size(s["evidence"]) > 0) & s["direction"].isNotNull() & (F.trim(s["direction"]) != "")))
    return F.round(ratio(good, F.size(statements)), 6)


TOKEN = r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)?|[%°]+|\S"  # fixed value: the token pattern


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.trim(text)), F.lit(TOKEN), F.lit(0))


def _ngrams(t: Column, n: int) -> Column:
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def bleu4(pairs: DataFrame, key: str) -> DataFrame:
    """BLEU-4 of columns cand and ref with smoothing 1e-9; a candidate below four tokens scores 0. One shuffle, by key."""
    t = pairs.select(key, tokens(F.col("cand")).alias("c"), tokens(F.col("ref")).alias("r")).withColumn("nc", F.size("c")).withColumn("nr", F.size("r"))
    mark = lambda side, n, x: F.transform(_ngrams(F.col(side), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(x).alias("x"), F.lit(1 - x).alias("y")))
    rows = t.select(key, "nc", "nr", F.explode_outer(F.concat(*[mark(side, n, x) for n in range(1, 5) for side, x in (("c", 1), ("r", 0))])).alias("e")).select(key, "nc", "nr", "e.*")
    grams = rows.repartition(key).groupBy(key, "nc", "nr", "n", "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    by = grams.groupBy(key, "nc", "nr", "n").agg(F.sum(F.least("x", "y")).alias("hit"), F.sum("x").alias("total"))
    p = by.groupBy(key, "nc", "nr").agg(F.sum(F.when(F.col("n").isNotNull(), F.log((F.col("hit") + 1e-9) / (F.col("total") + 1e-9)))).alias("logs"))
    brevity = F.when(F.col("nc") > F.col("nr"), 1.0).otherwise(F.exp(1 - F.col("nr") / F.greatest(F.col("nc"), F.lit(1))))
    return p.select(key, F.round(F.when(F.col("nc") < 4, 0.0).otherwise(brevity * F.exp(F.col("logs") / 4)), 6).alias("bleu"))


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of b: a step of the table is one addition."""
    at: dict = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, over Arrow batches."""

    @F.pandas_udf("int")
    def run(x, y):
        import pandas as pd

        return pd.Series([None if p is None or q is None else common_length(p.tolist(), q.tolist()) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def rouge_l(pairs: DataFrame, key: str) -> DataFrame:
    """F1 of the longest common token subsequence of cand and ref."""
    t = pairs.select(key, tokens(F.col("cand")).alias("c"), tokens(F.col("ref")).alias("r")).withColumn("lcs", lcs(F.col("c"), F.col("r")))
    p, q = ratio(F.col("lcs"), F.size("c")), ratio(F.col("lcs"), F.size("r"))
    return t.select(key, F.round(ratio(2 * p * q, p + q), 6).alias("rouge_l"))
