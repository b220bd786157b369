"""Benchmark decontamination: block-max WAND over a BM25 inverted index of the test items.

The index holds the test items; the queries are all passages of all documents: windows of `window` words, `step` apart,
the last one reaching the end. An item is retrieved if a passage reaches its threshold: `share` of the score that the item
gives itself or, if it is longer than a passage, of the least that any `window` of its words in a row give it.

Items are numbered by ascending threshold, and blocks of items keep each term's greatest BM25 weight. A passage first adds
up its terms' block maxima, coarse blocks before fine ones, and is done if no block can reach its lowest threshold. If one
can, a cursor runs along the postings of each term: the pivot is the first item that the terms up to it could bring to the
threshold of the first one; items before it are skipped, as is the rest of a block whose maxima stay below the pivot's
threshold, and all others are scored exactly. Since thresholds ascend, all items that reach their own are found.

A retrieved item is then verified on the whole document: of the word n-grams of its question (first half of its words) and
of its answer (second half), at least `overlap` each must occur there.

An index holds at most `max_items` items; a larger benchmark is cut into several, which documents pass one after the other
in one reading. Weights are those of the whole benchmark, which the driver holds once. Items with fewer than `least` words
leak where all their words occur in a row.

Cases: null and empty texts have no passage; very long texts are cut into passages whole; items without words (or null) are
not searched; ties need no order, since every item that reaches its threshold counts; repeated documents and items give a
row each; a null doc_id or item_id is kept; an empty table of either kind gives no rows; further columns are ignored, and
kept by `clean`.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _ngrams(w: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(w))
    return set(zip(*(w[i:] for i in range(n)), strict=False)) if n else set()


class Statistics:
    """Number of items with at least `least` words, their mean length and how many of them hold a term."""

    def __init__(self, texts: Iterable[str | None], least: int):
        self.items, length, self.df = 0, 0, Counter()
        for t in texts:
            if len(w := words(t)) >= least:
                self.items, length = self.items + 1, length + len(w)
                self.df.update(set(w))
        self.mean = length / max(self.items, 1)

    def of(self, texts: Iterable[str | None]) -> Statistics:
        """The same with only the terms of these texts."""
        own = Statistics((), 0)
        own.items, own.mean, own.df = self.items, self.mean, {x: self.df.get(x, 0) for t in texts for x in words(t)}
        return own

    def weights(self, w: list[str]) -> dict[str, float]:
        """BM25 weights of the terms in an item."""
        norm = K1 * (1 - B + B * len(w) / (self.mean or len(w)))
        idf = lambda x: float(np.log(1 + (self.items - (df := self.df.get(x, 0)) + 0.5) / (df + 0.5)))
        return {x: idf(x) * k * (K1 + 1) / (k + norm) for x, k in Counter(w).items()}


def _lightest(w: list[str], weight: dict[str, float], window: int) -> float:
    """The least weight of the distinct terms of `window` words in a row, of all words if there are fewer."""
    held = Counter(w[:window])
    now = best = sum(weight[x] for x in held)
    for out, new in zip(w, w[window:], strict=False):
        held[out] -= 1
        now -= weight[out] * (held[out] == 0)
        now += weight[new] * (held[new] == 0)
        held[new] += 1
        best = min(best, now)
    return best


class ItemIndex:
    """BM25 index of test items with block maxima, and the short items by their words."""

    def __init__(self, items: list[tuple[int | None, str]], share: float, ngram: int, least: int, block: int = 4, window: int | None = None, stats: Statistics | None = None, coarse: int = 16):
        stats = stats or Statistics((t for _, t in items), least)
        self.short: dict[int, dict[tuple[str, ...], list[tuple[int | None, float]]]] = {}
        for i, t in items:
            if 0 < len(w := words(t)) < least:
                self.short.setdefault(len(w), {}).setdefault(tuple(w), []).append((i, sum(stats.weights(w).values())))
        found = [(i, w, stats.weights(w)) for i, t in items if len(w := words(t)) >= max(least, 1)]
        found = sorted(((share * _lightest(w, own, window or len(w)), k, i, w, own) for k, (i, w, own) in enumerate(found)), key=lambda x: x[:2])
        self.items, self.bar = [(i, w) for _, _, i, w, _ in found], [x[0] - 1e-9 for x in found]
        self.block, n = block, len(found)
        self.term: dict[str, int] = {}
        self.docs: list[list[int]] = []  # postings by term, items in order
        self.weight: list[list[float]] = []
        for d, (_, _, _, _, own) in enumerate(found):
            for x, v in own.items():
                t = self.term.setdefault(x, len(self.term))
                if t == len(self.docs):
                    self.docs.append([])
                    self.weight.append([])
                self.docs[t].append(d)
                self.weight[t].append(v)
        self.top = [max(w) for w in self.weight]
        blocks = -(-n // block)
        most = np.zeros((len(self.docs), blocks), np.float32)
        for t, (docs, w) in enumerate(zip(self.docs, self.weight, strict=True)):
            np.maximum.at(most[t], np.array(docs) // block, np.array(w, np.float32))
        self.most = most
        self.low = np.array(self.bar[::block], np.float32) - np.float32(1e-3)  # bars ascend
        # coarse blocks of fine ones are looked at first, where there are enough
        self.wide = np.arange(0, blocks, coarse) if blocks > 4 * coarse else None
        if self.wide is not None:
            self.most_wide, self.coarse = np.maximum.reduceat(most, self.wide, axis=1), coarse
        half = [len(w) // 2 for _, w in self.items]
        self.question = [_ngrams(w[:h], ngram) for (_, w), h in zip(self.items, half, strict=True)]
        self.answer = [_ngrams(w[h:], ngram) for (_, w), h in zip(self.items, half, strict=True)]

    def _open(self, terms: list[int]) -> bool:
        """Whether the block maxima of the terms let any block reach its lowest threshold."""
        if self.wide is None:
            return bool((self.most.take(terms, axis=0).sum(axis=0) >= self.low).any())
        some = np.flatnonzero(self.most_wide.take(terms, axis=0).sum(axis=0) >= self.low[self.wide])
        for k in some.tolist():
            s = slice(k * self.coarse, (k + 1) * self.coarse)
            if (self.most[terms, s].sum(axis=0) >= self.low[s]).any():
                return True
        return False

    def search(self, terms: set[int | None]) -> list[tuple[int, float]]:
        """(item, score) of all items that reach their threshold for distinct terms; None is no term of the index."""
        terms.discard(None)
        return self._wand(terms) if terms and self._open(list(terms)) else []

    def _wand(self, terms: set[int]) -> list[tuple[int, float]]:
        bar, top, block, most = self.bar, self.top, self.block, self.most
        cursors = [[self.docs[t][0], t, 0] for t in terms]  # item, term, place in the term's postings
        out: list[tuple[int, float]] = []

        def advance(some: list[list[int]], item: int) -> None:
            for c in some:
                docs = self.docs[c[1]]
                c[2] = bisect_left(docs, item, c[2])
                c[0] = docs[c[2]] if c[2] < len(docs) else -1

        while True:
            cursors = sorted(c for c in cursors if c[0] >= 0)
            if not cursors:
                return out
            reach, need, n = 0.0, bar[cursors[0][0]], 0
            for n, c in enumerate(cursors):
                reach += top[c[1]]
                if reach >= need:
                    break
            else:
                return out
            pivot = cursors[n][0]
            while n + 1 < len(cursors) and cursors[n + 1][0] == pivot:
                n += 1
            upto, k = cursors[: n + 1], pivot // block
            if sum(float(most[c[1], k]) for c in upto) < bar[pivot] - 1e-3:
                advance(upto, min((k + 1) * block, cursors[n + 1][0] if n + 1 < len(cursors) else len(bar)))
            elif cursors[0][0] == pivot:
                score = sum(self.weight[c[1]][c[2]] for c in upto)
                if score >= bar[pivot]:
                    out.append((pivot, score))
                advance(upto, pivot + 1)
            else:
                advance([c for c in upto if c[0] < pivot], pivot)

    def _short_leaks(self, w: list[str]) -> list[tuple[int | None, float, int, float, float]]:
        """The short items whose words occur in a row, at their first place."""
        out = []
        for n, items in sorted(self.short.items()):
            first: dict[tuple[str, ...], int] = {}
            for s, x in enumerate(zip(*(w[i:] for i in range(n)), strict=False)):
                if x in items:
                    first.setdefault(x, s)
            out += [(i, score, s, 1.0, 1.0) for x, s in first.items() for i, score in items[x]]
        return out

    def leaks(self, text: str | None, window: int, step: int, ngram: int, overlap: float) -> list[tuple[int | None, float, int, float, float]]:
        """(item_id, score, first word of the best passage, question overlap, answer overlap) of the items in a document."""
        w = words(text)
        if not w:
            return []
        out = self._short_leaks(w)
        if not self.items:
            return out
        t = list(map(self.term.get, w))
        found: dict[int, tuple[float, int]] = {}
        for s in range(0, max(1, len(w) - window + step), step):
            for d, score in self.search({*t[s : s + window]}):
                if score > found.get(d, (0.0, 0))[0]:
                    found[d] = score, s
        if not found:
            return out
        have = set(zip(*(w[i:] for i in range(ngram)), strict=False))
        for d, (score, s) in sorted(found.items()):
            q, a = self.question[d], self.answer[d]
            here = have if len(next(iter(q))) == ngram and len(next(iter(a))) == ngram else have | _ngrams_of(w, {len(next(iter(q))), len(next(iter(a)))})
            qo, ao = len(q & here) / len(q), len(a & here) / len(a)
            if qo >= overlap and ao >= overlap:
                out.append((self.items[d][0], score, s, qo, ao))
        return out


def _ngrams_of(w: list[str], sizes: set[int]) -> set[tuple[str, ...]]:
    return set().union(*(_ngrams(w, n) for n in sizes))


def _indexes(benchmark: DataFrame, max_items: int, least: int) -> list[tuple[list[tuple], Statistics]]:
    """The items in parts of at most max_items, in order of id, each with the statistics of all items for its terms."""
    items = sorted(((r.item_id, r.text) for r in benchmark.select("item_id", "text").toLocalIterator() if r.text), key=lambda x: (x[0] is None, x[0], x[1]))
    stats = Statistics((t for _, t in items), least)
    return [(part, stats.of(t for _, t in part)) for part in (items[s : s + max_items] for s in range(0, max(1, len(items)), max_items))]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 64, step: int = 32, share: float = 0.4, ngram: int = 5, overlap: float = 0.4, least: int = 8, max_items: int = 2_000) -> DataFrame:
    """(doc_id, item_id, score, start_word, question_overlap, answer_overlap) for each leaked item of each document."""
    if step > window:
        raise ValueError("passages must not leave gaps")
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    found_type = pa.list_(pa.struct([("item_id", item_type), ("score", pa.float64()), ("start_word", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
    names = [f.name for f in found_type.value_type]
    schema = f"doc_id {doc_kind}, text string, found array<struct<item_id:{item_kind},score:double,start_word:bigint,question_overlap:double,answer_overlap:double>>"
    out = docs.select("doc_id", "text")
    parts = _indexes(benchmark, max_items, least)
    for k, (items, stats) in enumerate(parts):

        def run(batches: Iterator[pa.RecordBatch], k=k, items=items, stats=stats) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, share, ngram, least, window=window, stats=stats)
            for b in slices(batches):
                texts = b.column("text").to_pylist()
                found = [[dict(zip(names, x, strict=True)) for x in index.leaks(t, window, step, ngram, overlap)] for t in texts]
                if k:
                    found = [(x or []) + y for x, y in zip(b.column("found").to_pylist(), found, strict=True)]
                rows = pa.record_batch([b.column("doc_id"), b.column("text"), pa.array(found, found_type)], names=["doc_id", "text", "found"])
                yield rows.filter(pa.array(map(bool, found), pa.bool_())) if k == len(parts) - 1 else rows

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", F.inline("found"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 64, step: int = 32, share: float = 0.4, ngram: int = 5, overlap: float = 0.4, least: int = 8, max_items: int = 2_000) -> DataFrame:
    """The rows of docs, all columns, that hold no test item."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for items, stats in _indexes(benchmark, max_items, least):

        def run(batches: Iterator[pa.RecordBatch], items=items, stats=stats) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, share, ngram, least, window=window, stats=stats)
            for b in slices(batches):
                yield b.filter(pa.array([not index.leaks(t, window, step, ngram, overlap) for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, kinds)
    return docs
