"""Language identification by rank-order n-gram profiles.

Every language profile is the list of its most frequent letter 1- to 3-grams over all its training texts. A document is
ranked the same way over its whole text; its distance to a language is the sum, over the document's profile, of how far
each n-gram is out of place, a missing one counting as the whole profile length. The least distance wins, ties go to the
smaller language name.

Cases: null texts and texts without a letter are `und` with score 0; if no row can be learned from, all are `und`; null
languages are never learned; very long texts are ranked whole; any number of languages is learned; repeated rows count as
often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, fresh, slices

UND = "und"
BITS = 20


@cache
def _letters() -> np.ndarray:
    """Lower-case code of every character that Unicode calls a letter, 0 for all else; the last entry stands for those beyond."""
    low = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)]
    table = np.array(low, np.int64)
    table = table[: int(np.flatnonzero(table)[-1]) + 2]
    assert table.max() < 1 << BITS
    return table


def grams(text: str) -> np.ndarray:
    """Keys of all 1- to 3-grams of a text; a word begins and ends with a blank, and none crosses one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    x = table[np.minimum(code, len(table) - 1)]
    x = np.concatenate([[0], x, [0]])
    x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]
    if len(x) < 3:
        return np.empty(0, np.int64)
    two = x[:-1] | (x[1:] << BITS)
    three = (two[:-1] | (x[2:] << (2 * BITS)))[x[1:-1] != 0]
    return np.concatenate([x[x != 0] | (1 << 60), two | (2 << 60), three | (3 << 60)])


def ranked(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent keys, ties to the smaller key; keys come in order."""
    return keys[np.argsort(-counts, kind="stable")[:length]]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with text and lang; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def send() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, n = merged(parts)
                yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])

        for b in slices(batches, 250):
            texts: dict[str, list[str]] = defaultdict(list)
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                texts[lang].append(t)
            for lang, some in texts.items():
                keys = grams(" ".join(some))
                if len(keys):
                    held[lang].append(np.unique(keys, return_counts=True))
                    size += len(held[lang][-1][0])
            if size > 1_000_000:
                held = defaultdict(list, {k: [merged(v)] for k, v in held.items()})
                if (size := sum(len(v[0][0]) for v in held.values())) > 2_000_000:
                    yield from send()
                    held, size = defaultdict(list), 0
        yield from send()

    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, length: int = 400) -> dict[str, np.ndarray]:
    """Profiles by language, at most `length` n-grams each: 8 * length bytes a language on the driver."""
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= length)
    rows = top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "gram"))), lambda x: x["gram"]).alias("grams"))  # at most `length` a row
    return {x.lang: np.array(x.grams, np.int64) for x in rows.toLocalIterator()}


class Profiles:
    """Language profiles laid out for scoring."""

    def __init__(self, profiles: dict[str, np.ndarray], length: int = 400):
        self.length, self.names = length, sorted(profiles)
        self.keys = np.unique(np.concatenate([*profiles.values(), np.empty(0, np.int64)]))
        self.rank = np.full((len(self.names), len(self.keys)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.keys, profiles[name])] = np.arange(len(profiles[name]))

    def distances(self, text: str | None) -> tuple[int, float, float] | None:
        """Number of the nearest language, its likeness and that of all together; None for a text without a letter."""
        keys = grams(text) if text and self.names else ()
        if not len(keys):
            return None
        own = ranked(*np.unique(keys, return_counts=True), self.length)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        place = np.where(self.keys[at] == own, self.rank[:, at], -1)
        off = np.where(place >= 0, np.abs(place - np.arange(len(own))), self.length).sum(axis=1)
        best = int(off.argmin())
        like = np.maximum(1 - off / (self.length * len(own)), 0)
        return best, float(like[best]), float(like.sum())


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], length: int = 400, keep: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score"), most: int = 500, likeness: str | None = None) -> DataFrame:
    """The columns of `keep` (default doc_id) with lang_pred and score (named as `out` says), for every row and its whole text.

    If a name is given for it, the likeness to the nearest profile is a further column: 1 less the share of the greatest
    possible distance, 0 where no n-gram of the text is in the profile.

    A task holds the profiles of at most `most` languages; more are compared in parts, one after the other.
    """
    keep = keep or ["doc_id"]
    text, said_cols = ("text", []) if "text" in keep else (own := fresh("text_", [*keep, *out]), [F.col("text").alias(own)])
    name, score = out
    like = fresh("likeness", [*keep, *out, text])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    carried = kinds + ("" if text in keep else f", `{text}` string")
    names = sorted(profiles)
    parts = [names[s : s + most] for s in range(0, max(1, len(names)), most)]
    rows = docs.select(*keep, *said_cols)
    for k, part in enumerate(parts):
        last = k == len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], k=k, part=part, last=last) -> Iterator[pa.RecordBatch]:
            model = Profiles({x: profiles[x] for x in part}, length)
            for b in slices(batches):
                found = [model.distances(t) for t in b.column(text).to_pylist()]
                who = [model.names[f[0]] if f else UND for f in found]
                best, total = (np.array([f[c] if f else 0.0 for f in found]) for c in (1, 2))
                if k:  # the languages come in order, so an earlier one wins a tie
                    old = np.array(b.column(score).to_pylist(), float)
                    who = [x if a >= c else y for x, y, a, c in zip(b.column(name).to_pylist(), who, old, best, strict=True)]
                    best, total = np.maximum(old, best), total + np.array(b.column(like).to_pylist(), float)
                cols, heads = [b.column(c) for c in keep], list(keep)
                if last:
                    any_ = 1 / max(1, len(names))
                    share = np.where(total > 0, best / np.where(total > 0, total, 1), [0.0 if f is None else any_ for f in found])
                    also = [pa.array(best)] if likeness else []
                    yield pa.record_batch([*cols, pa.array(who, pa.string()), pa.array(np.clip(share, 0, 1)), *also], names=[*heads, name, score, *([likeness] if likeness else [])])
                else:
                    more = [] if text in keep else [b.column(text)]
                    yield pa.record_batch([*cols, *more, pa.array(who, pa.string()), pa.array(best), pa.array(total)], names=[*heads, *([text] if more else []), name, score, like])

        rows = rows.mapInArrow(run, f"{kinds}, `{name}` string, `{score}` double" + (f", `{likeness}` double" if likeness else "") if last else f"{carried}, `{name}` string, `{score}` double, `{like}` double")
    return rows


def identify(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    held = crc_mod("doc_id", 4) == 2
    profiles = learn(docs.filter(~F.coalesce(held, F.lit(False))), length)
    return predict(docs, profiles, length).select("doc_id", held.alias("held_out"), "lang_pred", "score")
