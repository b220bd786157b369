"""Exact repeated passages across a corpus by fixed-block anchors.

A passage is a window of `window` consecutive words. Every document long enough is cut into non-overlapping reference
blocks of half a window, so that each window holds a whole block wherever it starts. All rolling windows of a block's
length, of all documents, probe the index of blocks. A block that is met by any probe but its own is an anchor, and so is
each place whose probe met it: two equal windows hold equal anchors, since a block of the one is at the same place in the
other. Only windows that hold an anchor go on; in text that repeats nothing there are none.

Hits are extended without pairs: the windows round anchors are hashed whole, to 96 bits (odds of one false repeat about 1e-3
in 10^13 words), and of equal windows the earliest start is found where they meet. A run of later windows is a maximal exact
repeat, and its words go. A passage that half of all documents hold is one entry for each chunk of documents, whatever its
number of copies, so no group of copies meets as pairs, and none meets in one task as more than an entry a chunk.

The index, its probes and the windows travel as in lodestone.llm.chunks: chunks send four bytes for each distinct probe,
and are told which of their places are anchors and which of their windows come later.

Cases: a null text has no words; texts are taken whole, however long; fewer words than a window repeat nothing. Rows that
share a doc_id count as one document, each from its own start: of equal windows in them the smaller start is the earlier,
and equal starts are neither, so both stay. A null doc_id comes after all others. An empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import MESSAGE, Numbers, U, among, answered, buckets_for, chunked, factors, keys, lanes, messages, rolled, runs, settled, standing, standing_keys
from lodestone.llm.common import discard, utf8

REFERENCE, OFTEN = 1, 2  # a block of the index; met more than once in its chunk
LAST = (1 << 63) - 1  # the place of a null doc_id


class Words:
    """The words of a chunk's rows as numbers, in one line."""

    def __init__(self, rows: pa.Table, window: int):
        (batch,) = rows.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], rows.schema)]
        self.numbers, self.texts = Numbers(), utf8(batch, "text")
        found, length = [], []
        for t in self.texts:
            w = t.split()  # bytes: just the six ASCII white-space bytes
            length.append(len(w))
            found.append(np.fromiter(map(self.numbers.__getitem__, w), np.int64, len(w)))
        self.length = np.array(length, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.word = np.concatenate(found) if found else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(self.length)), self.length)
        self.start = np.arange(len(self.word)) - self.at[self.row]
        self.left = self.length[self.row] - self.start
        ids = batch.column("doc_id")
        self.id = ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        self.hash = lanes(self.numbers)[self.word] if len(self.word) else np.zeros((0, 2), np.uint64)
        self.long = self.length[self.row] >= window

    def windows(self, n: int, lane: int, salt: int) -> np.ndarray:
        """Hash of n words from each place on; meaningless where fewer are left."""
        h = rolled(np.ascontiguousarray(self.hash[:, lane]), n, factors(n, salt)[:, lane])
        return np.concatenate([h, np.zeros(len(self.word) - len(h), np.uint64)])


def _probes(w: Words, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of all probes, their hashes): rolling windows of a block's length in documents of a window or more."""
    at = np.flatnonzero(w.long & (w.left >= block))
    return at, w.windows(block, 0, 1)[at]


def _windows(w: Words, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the whole windows at the given places: 64 and 32 bits."""
    return w.windows(window, 0, 2)[at], (w.windows(window, 1, 2)[at] >> U(32)).astype(np.uint32)


def _earliest(h: np.ndarray, h2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, run number by order, whether a window of the same words starts earlier, by order)."""
    order = np.lexsort((start, doc, h2, h))
    h, h2, doc, start = h[order], h2[order], doc[order], start[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])] if len(h) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)[run] if len(h) else run
    return order, new, (doc != doc[first]) | (start != start[first])


def repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, bucket_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): words not covered by a window that also starts earlier, space-joined.

    spans are the removed runs of words, from start to before stop.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    block = (window + 1) // 2  # a whole block lies in every window
    chunks = chunked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", chunk_bytes)
    buckets = buckets_for(chunks, bucket_bytes)

    def probes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        w = Words(rows, window)
        at, h = _probes(w, block)
        order = np.argsort(h)
        h, reference = h[order], (w.start[at] % block == 0)[order]
        starts, ends = runs(h)
        kind = np.logical_or.reduceat(reference, starts) * REFERENCE + (ends - starts > 1) * OFTEN if len(h) else np.zeros(0)
        return h[starts], kind

    def anchors(kind: np.ndarray, starts: np.ndarray) -> np.ndarray:
        size = np.diff(np.r_[starts, len(kind)])
        return (np.bitwise_or.reduceat(kind & REFERENCE, starts) > 0) & ((size > 1) | (np.bitwise_or.reduceat(kind & OFTEN, starts) > 0))

    found = standing(chunks, probes, anchors, np.uint8, buckets, "anchors")

    def extend(chunk: int, rows: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
        w = Words(rows, window)
        at, h = _probes(w, block)
        hit = np.zeros(len(w.word) + window, np.int64)
        hit[at[among(keys(h, buckets), standing_keys(got))]] = 1
        hits = np.concatenate([[0], np.cumsum(hit)])
        place = np.arange(len(w.word))
        place = place[(w.left >= window) & (hits[place + window - block + 1] > hits[place])]
        h, h2 = _windows(w, place, window)
        doc, start = w.id[w.row[place]], w.start[place]
        order, new, _ = _earliest(h, h2, doc, start)
        first = order[new]  # one entry for equal windows of a chunk
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield messages(chunk, h[first], buckets, h[first], h2[first], doc[first], start[first].astype(np.uint32), pack=squeeze)

    def compare(t: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        items, chunk = [open_(x) for x in t.column("items").to_pylist()], t.column("chunk").to_pylist()
        n = [len(x) // 24 for x in items]
        h, h2, doc, start = (np.concatenate([np.frombuffer(x, kind, k, off * k) for x, k in zip(items, n, strict=True)]) for kind, off in ((np.uint64, 0), (np.uint32, 8), (np.int64, 12), (np.uint32, 20)))
        order, _, late = _earliest(h, h2, doc, start)
        later = np.zeros(len(h), bool)
        later[order] = late
        out, at = [], 0
        for c, k in zip(chunk, n, strict=True):
            mine = slice(at, at + k)
            if later[mine].any():
                out.append((c, h[mine][later[mine]].tobytes() + h2[mine][later[mine]].tobytes()))
            at += k
        return pa.table([pa.array([t.column("bucket")[0].as_py()] * len(out), pa.int32()), pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "chunk", "items"])

    later = settled(answered(chunks, found, extend, MESSAGE).groupBy("bucket").applyInArrow(compare, MESSAGE), "later-windows")
    discard(found)

    def remove(chunk: int, rows: pa.Table, got: pa.Table) -> Iterator[pa.RecordBatch]:
        w = Words(rows, window)
        items = got.column("items").to_pylist()
        told = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64, len(x) // 12) for x in items)])
        told2 = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8) for x in items)])
        place = np.flatnonzero(w.left >= window)
        h, h2 = _windows(w, place, window)
        sort = np.sort(h)
        twin = sort[1:][sort[1:] == sort[:-1]]
        some = among(h, twin) | among(h, np.sort(told))
        place, h, h2 = place[some], h[some], h2[some]
        # the answers stand before all places of the chunk: what equals one of them is later than it
        doc = np.concatenate([np.full(len(told), -LAST - 1), w.id[w.row[place]]])
        start = np.concatenate([np.full(len(told), -1), w.start[place]])
        order, _, late = _earliest(np.concatenate([told, h]), np.concatenate([told2, h2]), doc, start)
        late = order[late] - len(told)
        edge = np.zeros(len(w.word) + window + 1, np.int64)
        np.add.at(edge, place[late], 1)
        np.add.at(edge, place[late] + window, -1)
        gone = np.cumsum(edge)[: len(w.word)] > 0
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "spans": []}
        for k, text in enumerate(w.texts):
            mine = gone[w.at[k] : w.at[k + 1]]
            step = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            values = len(mine), int(mine.sum()), b" ".join(compress(text.split(), (~mine).tolist())), [{"start": s, "stop": e} for s, e in step.reshape(-1, 2).tolist()]
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.record_batch([rows.column("doc_id").combine_chunks(), *(pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    out = answered(chunks, later, remove, "doc_id long, n_words long, n_removed long, kept binary, spans array<struct<start: long, stop: long>>")
    return out.withColumn("kept", F.col("kept").cast("string"))

