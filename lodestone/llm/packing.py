"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's token ids, with an end id, are cut into pieces of the sequence length; only the last piece of a document is
shorter. Full pieces are sequences by themselves. The others are dealt into random groups of about `group` pieces by a
hash of their row number, and each group is packed by itself: pieces from long to short, ties by row number, each into
the first sequence that has room. A tournament tree over the free room of the sequences finds that first one in
logarithmic time. Groups need nothing of each other, so any number of them runs at once.

Where the tokenizer's file shows that white space never lies inside a token, documents are cut at ASCII white space and each
distinct part is encoded once in a task; for other files the library encodes whole texts.

Cases: null and empty texts are one end id; very long texts are cut into full pieces and a rest; repeated rows and equal doc_ids are packed as documents of their own (row
numbers tell them apart); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import slices, written

NEVER = 1 << 30
HASH_BITS = 20


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PUNCT = "!-&(-/:-@\\[-`{-~"
LATIN = re.compile(f"[{LETTERS}]+").fullmatch
PLAIN = re.compile(f"([{LETTERS}]*)([{PUNCT}]*)").fullmatch


class WordPieces:
    """Byte pair encoding of many words at once with the merges of a tokenizer file.

    Words of one length form a matrix; each round merges in every row its leftmost pair of lowest rank, so the matrix loses
    a column and the rows without a pair that merges leave it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int32)
        pairs = [(vocab[a] << 20 | vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(model["merges"])]
        table = np.array(sorted(pairs), np.int64)
        self.pair = np.append(table[:, 0], -1)  # the last stands for no merge
        self.rank = np.append(table[:, 1], NEVER).astype(np.int32)
        self.made = np.append(table[:, 2], 0).astype(np.int32)
        none = len(table)
        slot = self._slot(table[:, 0])
        self.slots = np.full(1 << HASH_BITS, none, np.int32)
        self.slots[slot] = np.arange(none)
        self.shared = np.zeros(1 << HASH_BITS, bool)  # slots of more than one pair
        self.shared[slot[self.slots[slot] != np.arange(none)]] = True
        self.none = none

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * 0x1E3779B97F4A7C15 >> (63 - HASH_BITS)) & ((1 << HASH_BITS) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the merges of these pairs."""
        key = left.astype(np.int64) << 20 | right
        slot = self._slot(key)
        at = self.slots[slot]
        at = np.where(self.pair[at] == key, at, self.none)
        more = self.shared[slot] & (at == self.none)
        if more.any():
            k = key[more]
            i = np.searchsorted(self.pair[:-1], k)
            at[more] = np.where(self.pair[i] == k, i, self.none)
        return at

    def encode(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            for i in range(0, len(own), 20_000):
                self._matrix(words, own[i : i + 20_000], int(n), out)
        return out

    def _matrix(self, words: list[bytes], own: np.ndarray, n: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([words[i] for i in own]), np.uint8).reshape(-1, n)
        sym = np.concatenate([self.inner[raw[:, :-1]], self.last[raw[:, -1:]]], axis=1)
        at = self.find(sym[:, :-1], sym[:, 1:])
        rank = self.rank[at]
        while True:
            over = rank.min(axis=1) == NEVER if n > 1 else np.ones(len(own), bool)
            if over.any():
                buf, w = sym[over].astype("<u4").tobytes(), 4 * n
                for k, i in enumerate(own[over].tolist()):
                    out[i] = buf[k * w : k * w + w]
                keep = ~over
                own, sym, rank, at = own[keep], sym[keep], rank[keep], at[keep]
            if not len(own):
                return
            rows, pos = np.arange(len(own)), rank.argmin(axis=1)
            new = self.made[at[rows, pos]]
            n -= 1
            later = np.arange(n) > pos[:, None]
            sym = np.where(later, sym[:, 1:], sym[:, :-1])
            sym[rows, pos] = new
            later = later[:, : n - 1]
            rank, at = np.where(later, rank[:, 1:n], rank[:, : n - 1]), np.where(later, at[:, 1:n], at[:, : n - 1])
            r = np.flatnonzero(pos < n - 1)
            p = pos[r]
            at[r, p] = found = self.find(sym[r, p], sym[r, p + 1])
            rank[r, p] = self.rank[found]
            r = np.flatnonzero(pos > 0)
            p = pos[r] - 1
            at[r, p] = found = self.find(sym[r, p], sym[r, p + 1])
            rank[r, p] = self.rank[found]


def cuts_at_blanks(path: str) -> bool:
    """Whether the file's tokenizer is of the kind known to treat parts between white space alike wherever they stand."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = [x["type"] for x in (file.get("normalizer") or {}).get("normalizers", [])]
    split = ((file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"  # fixed value: the file's split pattern
    blanks = any(c.isspace() for t in file.get("added_tokens") or [] for c in t["content"])
    return steps == ["NFC", "Replace", "Lowercase"] and (split.get("pattern") or {}).get("Regex") == pattern and split.get("invert") is True and bool(file["model"].get("end_of_word_suffix")) and not blanks


class Encoder:
    """Token ids of whole texts; encodes each distinct part between white space once.

    Parts of Latin letters, of ASCII punctuation, or of the one then the other, go to WordPieces; all others to the library.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tok, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.words = WordPieces(path) if cuts_at_blanks(path) else None  # else whole texts go to the library

    def learn(self, parts: list[str]) -> None:
        one, words, two, first, second, other = [], [], [], [], [], []
        for p in parts:
            if p.isalpha() and len(p) <= 60 and (p.isascii() or LATIN(p)):
                one.append(p)
                words.append(p.lower().encode())
            elif (m := PLAIN(p)) and len(p) <= 60:
                two.append(p)
                first.append(m[1].lower().encode())
                second.append(m[2].encode())
            else:
                other.append(p)
        self.known.update(zip(one, self.words.encode(words), strict=True))
        todo = list({*first, *second} - {b""})
        ids = dict(zip(todo, self.words.encode(todo), strict=True)) | {b"": b""}
        self.known.update((p, ids[a] + ids[b]) for p, a, b in zip(two, first, second, strict=True))
        for i in range(0, len(other), 2000):
            got = self.tok.encode_batch_fast(other[i : i + 2000], add_special_tokens=False)
            self.known.update((p, np.array(e.ids, np.uint32).tobytes()) for p, e in zip(other[i : i + 2000], got, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.words is None:
            got = [e for i in range(0, len(texts), 100) for e in self.tok.encode_batch_fast([t or "" for t in texts[i : i + 100]], add_special_tokens=False)]
            return [np.array(e.ids, np.uint32).tobytes() for e in got]
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        flat = [p for parts in split for p in parts]
        if len(self.known) > self.most:
            self.known.clear()
        ids = list(map(self.known.get, flat))
        new = {p for p, x in zip(flat, ids, strict=True) if x is None}
        if new:
            self.learn(list(new))
            known = self.known
            ids = [known[p] if x is None else x for p, x in zip(flat, ids, strict=True)]
        out, at = [], 0
        for parts in split:
            out.append(b"".join(ids[at : at + len(parts)]))
            at += len(parts)
        return out


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, row (number of the document's row), and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = encoder(tokenizer), np.array([end], np.uint32).tobytes()
        for b in slices(batches, 500):
            ids = coder.encode(b.column("text").to_pylist())
            at, start, size, crc, total, own = [], [], [], [], [], []
            for i, x in enumerate(ids):
                x += tail
                for s in range(0, len(x), 4 * length):
                    part = x[s : s + 4 * length]
                    at.append(i)
                    start.append(s // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(x) // 4)
                    if keep_ids:
                        own.append(np.frombuffer(part, np.uint32).astype(np.int32))
            rows = pa.array(at, pa.int32())
            cols = [b.column("doc_id").take(rows), *(pa.array(c, pa.int64()) for c in (start, size, crc, total)), b.column("row").take(rows)]
            yield pa.record_batch(cols + [pa.array(own, pa.list_(pa.int32()))] * keep_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"] + ["ids"] * keep_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long" + ", ids array<int>" * keep_ids)


def first_fit(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, taken in the given order, by a tournament tree of free room."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    tree = [room] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins.append(at - leaves)
        offsets.append(room - tree[at])
        tree[at] -= size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left > right else right
    return bins, offsets


def pack(parts: DataFrame, length: int = 2048, group: int = 2048, seed: int = 7) -> DataFrame:
    """Adds sequence_id and offset to pieces (a written table: their row numbers must not change)."""
    full = parts.filter(F.col("length") == length)
    rest = parts.filter(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        b, o = first_fit(pdf["length"].tolist(), length)
        return pd.DataFrame({"row": pdf["row"], "start": pdf["start"], "sequence_id": 2 * (pdf["g"].to_numpy() * (1 << 32) + np.array(b, np.int64)) + 1, "offset": np.array(o, np.int64)})

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema}
    names = [c for c in parts.columns if c != "row"]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = one(pdf)
        return pdf.loc[out.index, names].assign(sequence_id=out["sequence_id"], offset=out["offset"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    packed = dealt.groupBy("g").applyInPandas(whole, schema)
    # a full piece is a sequence of its own: even numbers, from its place in the written table
    alone = full.select(*names, (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, group: int = 2048, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    return pack(written(pieces(docs, tokenizer, length, end, keep_ids), "pieces"), length, group)
