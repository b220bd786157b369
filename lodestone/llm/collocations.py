"""Collocations: phrases whose words go together more often than apart, for each language.

All 1- to max_n-word phrases within a piece of text are counted. Nearly all of them occur a few times, and a phrase row is
many times the size of the word it starts with, so phrases are first counted by hash (lodestone.llm.chunks: five bytes for
each distinct phrase of a chunk), and a chunk learns which of its phrases may reach the least count. Those, each with its
exact number in the chunk, are exploded into DataFrame rows (lang, phrase, n) and hash-aggregated by language and phrase;
what a shared hash let through falls under the least count here. Parts of a frequent phrase are at least as frequent, so
prefix and suffix counts are joined from the same table. Scores are exact decimals with integer division. A phrase is inside
a longer frequent one only if it is inside one that is longer by one word and at least as frequent as that, so one anti-join
with one-word extensions is enough.

Ranks are not taken in one window over a language, which may hold most rows: rows are sorted by range, and a row's rank is
its place in its range behind the language's rows of the ranges before.

Cases: a null text has no words, a null language is `und` and counts with texts of that name; texts are taken whole,
however long; repeated rows count again; ties in score go to the more frequent phrase, then to the smaller in bytes; cuts
tied after flooring go to the shorter first part; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.chunks import Numbers, among, answered, buckets_for, chunked, factors, keys, lanes, mixed, runs, settled, standing, standing_keys
from lodestone.llm.common import discard, utf8, written

UND = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(bytes(range(65, 91)) + BREAKS, bytes(range(97, 123)) + b"\n" * len(BREAKS))


class Pieces:
    """The words of a chunk's rows as numbers in one line, cut into pieces that no phrase crosses."""

    def __init__(self, rows: pa.Table):
        (batch,) = rows.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], rows.schema)]
        self.numbers, self.langs = Numbers(), Numbers()
        word, length, lang = [], [], []
        for text, name in zip(utf8(batch, "text"), utf8(batch, "lang"), strict=True):
            k = self.langs[name]
            words = []
            for piece in text.translate(FOLD).split(b"\n"):
                w = piece.split()  # blanks and tabs: all other white space has cut the piece
                if w:
                    words += w
                    length.append(len(w))
                    lang.append(k)
            word.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.word = np.concatenate(word) if word else np.zeros(0, np.int64)
        size = np.array(length, np.int64)
        self.lang = np.repeat(np.array(lang, np.int64), size)
        self.left = np.repeat(np.cumsum(size), size) - np.arange(len(self.word))
        self.hash = lanes(self.numbers)[:, 0][self.word] if len(self.word) else np.zeros(0, np.uint64)
        self.lang_hash = lanes(self.langs)[:, 1][self.lang] if len(self.word) else np.zeros(0, np.uint64)

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of all phrases of n words."""
        at = np.flatnonzero(self.left >= n)
        by = factors(n + 1, n)[:, 0]
        h = self.lang_hash[at] * by[n]
        for i in range(n):
            h += self.hash[at + i] * by[i]
        return at, mixed(h)


def counted(docs: DataFrame, max_n: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = 4 << 20, bucket_bytes: int = 1 << 20) -> DataFrame:
    """(lang, words, phrase, n) as a written table: phrases that occur `least` times or more; with words = 0 and an empty
    phrase, all words of the language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    chunks = chunked(rows, "text", chunk_bytes)
    buckets = buckets_for(chunks, bucket_bytes)
    weight = next(t for t in (np.uint8, np.uint32, np.uint64) if least <= np.iinfo(t).max)

    def emit(own: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        p = Pieces(own)
        h = np.sort(np.concatenate([p.phrases(n)[1] for n in range(1, max_n + 1)]))
        starts, ends = runs(h)
        return h[starts], np.minimum(ends - starts, least)

    def judge(w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w.astype(np.int64), starts) >= least

    found = standing(chunks, emit, judge, weight, buckets, "phrases")

    def explode(chunk: int, own: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
        p, stand = Pieces(own), standing_keys(got)
        words, langs = pa.array(list(p.numbers), pa.binary()), pa.array(list(p.langs), pa.binary())

        def out(lang: np.ndarray, n: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([langs.take(pa.array(lang)), pa.array(np.full(len(lang), n, np.int32)), phrase, pa.array(count.astype(np.int64))], names=["lang", "words", "phrase", "n"])

        total = np.bincount(p.lang, minlength=len(p.langs))
        yield out(np.arange(len(total)), 0, pa.array([b""] * len(total), pa.binary()), total)
        code = p.lang * len(p.numbers) + p.word  # exact: equal codes are equal phrases
        for n in range(1, max_n + 1):
            at, h = p.phrases(n)
            at = at[among(keys(h, buckets), stand)]
            if n > 1:
                at = at[code[at] >= 0]  # the shorter phrase here stands too
                value = code[at] * len(p.numbers) + p.word[at + n - 1]
            else:
                value = code[at]
            _, first, number, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
            code = np.full(len(p.word), -1, np.int64)
            code[at] = number
            if not len(first):
                return
            first = at[first]
            parts = [words.take(pa.array(p.word[first + i])) for i in range(n)]
            yield out(p.lang[first], n, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if n > 1 else parts[0], count)

    rows = answered(chunks, found, explode, "lang binary, words int, phrase binary, n long")
    total = rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | (F.col("words") == 0))
    out = settled(total.select(F.col("lang").cast("string").alias("lang"), "words", F.col("phrase").cast("string").alias("phrase"), "n"), "phrase-counts")
    discard(chunks, found)
    return out


def score(a: str, left: str, right: str) -> Column:
    """floor(2000000 * a / (left + right)) of three columns, in decimals with integer division: exact at any size."""
    return F.expr(f"(2000000BD * CAST({a} AS DECIMAL(19, 0))) div (CAST({left} AS DECIMAL(19, 0)) + CAST({right} AS DECIMAL(19, 0)))")


def ranked(rows: DataFrame, by: list[Column], group: str, most: int) -> DataFrame:
    """The first `most` rows of each group in the order of `by`, with their rank, without a group meeting in one task."""
    placed = written(rows.repartitionByRange(F.col(group), *by).sortWithinPartitions(F.col(group), *by).select("*", F.monotonically_increasing_id().alias("_at")), "ranges")
    placed_by = F.shiftright("_at", 33)
    sizes = placed.groupBy(F.col(group).alias("_g"), placed_by.alias("_p")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = sizes.withColumn("_before", before).filter(F.col("_before") < most)
    at = placed.withColumn("_p", placed_by).join(sizes.withColumnRenamed("_p", "_q"), (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_q")))
    return at.withColumn("rank", (F.col("_at") - F.col("_from") + F.col("_before") + 1).cast("long")).filter(F.col("rank") <= most).select(*rows.columns, "rank")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, most: int = 2000, inside: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_n words."""
    counts = counted(docs, max_n, least, text_col, lang_col)
    part = counts.filter(F.col("words").between(1, max_n - 1)).select("lang", "phrase", "n")
    found = counts.filter("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("_l", F.expr("substring_index(phrase, ' ', k)")).withColumn("_r", F.expr("substring_index(phrase, ' ', k - words)"))
    left = part.select(F.col("lang").alias("lang_l"), F.col("phrase").alias("_l_"), F.col("n").alias("l"))
    right = part.select(F.col("lang").alias("lang_r"), F.col("phrase").alias("_r_"), F.col("n").alias("r"))
    cut = cut.join(left, (F.col("lang") == F.col("lang_l")) & (F.col("_l") == F.col("_l_"))).join(right, (F.col("lang") == F.col("lang_r")) & (F.col("_r") == F.col("_r_")))
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("m"))
    scored = lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    ends = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = found.filter("words > 2").select(F.col("lang").alias("lang_x"), F.explode(ends).alias("inner"), "a").groupBy("lang_x", "inner").agg(F.max("a").alias("b"))
    d = lambda c: F.col(c).cast("decimal(19,0)")
    own = scored.join(longer, (F.col("lang") == F.col("lang_x")) & (F.col("phrase") == F.col("inner")) & (d("b") * 100 >= d("a") * inside), "left_anti")
    best = ranked(own, [F.desc("score"), F.desc("a"), F.col("phrase")], "lang", most)
    total = counts.filter("words = 0").select(F.col("lang").alias("lang_n"), "n")
    return best.join(total, F.col("lang") == F.col("lang_n")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
