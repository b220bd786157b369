"""Language-model scoring of whole documents: a gated recurrent model (gru.py) and a smoothed unigram base.

Tokens are the words of the lower-cased text and one end token. The text is read once: each task cuts its documents into
blocks and writes, for each block, the distinct tokens (as 64-bit hashes in ascending order), how often each occurs in
training documents, and the documents as sequences of places in that list. Counts of the whole corpus are added up by
hash. The counts of common tokens, of which there can be no more than a parameter says, are sent to all tasks; a block
gets those of its rare tokens by a join. Blocks then hold everything needed to score their documents.

The model's symbols are the most frequent training tokens and one for all others; the others share their probability in
proportion to their smoothed counts, so a document's score is the probability of its exact tokens. All training documents
are learned from whole, their state carried from window to window. They are dealt to shards by a hash of id and text, so
the model does not depend on the layout of the table; every shard trains from the same start and the parameters are
averaged by their number of tokens, `rounds` times. What is gathered therefore grows with the corpus.

Cases: null and empty texts are one end token; with no training document all counts are zero and the base is that of an
empty corpus; very long texts are learned from and scored whole, in windows; a null doc_id counts as training and has held_out null; repeated rows count as often as they occur; of
equally frequent tokens those of smaller hash are symbols first; an empty table gives no rows; further columns are ignored. Two different tokens with one 64-bit hash would share their counts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import gru
from lodestone.llm.common import crc_mod, discard, slices, utf8, written

END = b""
NO_ID = -(1 << 63)  # stands for a null id in a block
_hash = partial(xxhash.xxh64_intdigest, seed=0)
END_HASH = _hash(END)
BLOCK = "block long, ids binary, held binary, lens binary, seq binary, hashes binary, counts binary"


def blocks(docs: DataFrame, tokens: int = 1_500_000) -> DataFrame:
    """Tokenised blocks of documents (columns doc_id, text, held); a block ends with the document that fills it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        known: dict[bytes, int] = defaultdict(count().__next__)  # a new token gets the next place
        ids, held, seqs, size = [], [], [], 0

        def send() -> pa.RecordBatch:
            nonlocal made
            h = np.fromiter(map(_hash, known), np.uint64, len(known))
            hashes, place = np.unique(h, return_inverse=True)
            seq = place.astype(np.int32)[np.concatenate(seqs)]
            lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
            learn = np.repeat(np.array(held) == 0, lens)
            counts = np.bincount(seq[learn], minlength=len(hashes)).astype(np.int32)
            made += 1
            row = [[part << 32 | made], *([x.tobytes()] for x in (np.array(ids, np.int64), np.array(held, np.int8), lens.astype(np.int32), seq, hashes, counts))]
            return pa.record_batch([pa.array(row[0], pa.int64()), *(pa.array(x, pa.binary()) for x in row[1:])], names=["block", "ids", "held", "lens", "seq", "hashes", "counts"])

        for b in slices(batches, 500):
            for i, hold, t in zip(b.column("row").to_pylist(), b.column("held").to_pylist(), utf8(b, "text"), strict=True):
                words = t.lower().split()
                words.append(END)
                seqs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                ids.append(i)
                held.append(hold)
                size += len(words)
                if size >= tokens:
                    yield send()
                    known = defaultdict(count().__next__)
                    ids, held, seqs, size = [], [], [], 0
        if seqs:
            yield send()

    return docs.select("row", "held", "text").mapInArrow(run, BLOCK)


def token_counts(table: DataFrame) -> DataFrame:
    """(h, n) of every distinct training token; blocks are summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, counts in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist(), strict=True):
                h, n = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.int32)
                yield pa.record_batch([pa.array(h[n > 0]), pa.array(n[n > 0].astype(np.int64))], names=["h", "n"])

    return table.select("hashes", "counts").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def rare_counts(table: DataFrame, counts: DataFrame, common: np.ndarray) -> DataFrame:
    """(block, h, n): the corpus counts of the tokens of each block but the common ones (hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, hashes in zip(b.column("block").to_pylist(), b.column("hashes").to_pylist(), strict=True):
                h = np.setdiff1d(np.frombuffer(hashes, np.uint64), common, assume_unique=True).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), block)), pa.array(h)], names=["block", "h"])

    return table.select("block", "hashes").mapInArrow(run, "block long, h long").join(counts, "h")


class Vocabulary:
    """The model's symbols and the corpus totals."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, v: int, symbols: int, classes: int):
        self.n, self.v = n, v
        rest = n - int(counts.sum())
        freq = [(int(c), int(h)) for h, c in zip(hashes, counts, strict=True)] + [(rest, -1)]
        if END_HASH not in {h for _, h in freq}:
            freq.append((0, END_HASH))
        freq.sort(key=lambda x: (-x[0], x[1]))
        size = -(-max(len(freq), classes) // classes) * classes
        self.freq = np.array([c for c, _ in freq] + [0] * (size - len(freq)), float)
        self.unknown = next(i for i, (_, h) in enumerate(freq) if h == -1)
        self.end = next(i for i, (_, h) in enumerate(freq) if h == END_HASH)
        known = sorted((h, i) for i, (_, h) in enumerate(freq) if h != -1)
        self.keys = np.array([h for h, _ in known], np.uint64)
        self.symbol = np.array([i for _, i in known], np.int32)
        self.base = math.log10(n + 0.1 * (v + 1))
        self.rest = math.log10(max(rest, 0) + 0.1 * (max(v - len(hashes), 0) + 1))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.symbol[at], self.unknown).astype(np.int32)


def sample(table: DataFrame, vocab: Vocabulary, shards: int) -> DataFrame:
    """All training documents as symbols: (shard, o, syms). Shard and order come from id and text, not from the layout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, held, lens, seq, hashes in zip(*(b.column(c).to_pylist() for c in ("ids", "held", "lens", "seq", "hashes")), strict=True):
                symbols = vocab.symbols(np.frombuffer(hashes, np.uint64)).astype(np.uint16)[np.frombuffer(seq, np.int32)]
                rows = []
                for i, hold, syms in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(held, np.int8).tolist(), _docs(lens, symbols), strict=True):
                    if not hold:
                        raw = syms.tobytes()
                        rows.append((xxhash.xxh64_intdigest(raw, seed=i & 0xFFFFFFFF) >> 1, raw))
                for k in range(0, len(rows), 2000):
                    o = np.array([x for x, _ in rows[k : k + 2000]], np.int64)
                    yield pa.record_batch([pa.array((o % shards).astype(np.int32)), pa.array(o), pa.array([x for _, x in rows[k : k + 2000]], pa.binary())], names=["shard", "o", "syms"])

    return table.select("ids", "held", "lens", "seq", "hashes").mapInArrow(run, "shard int, o long, syms binary")


def _docs(lens: bytes, syms: np.ndarray) -> list[np.ndarray]:
    return np.split(syms, np.frombuffer(lens, np.int32).cumsum()[:-1])


def average(models: DataFrame, fan: int = 16) -> tuple[np.ndarray, float]:
    """Mean of parameter rows (p binary, w double) by weight, fan rows at a time, so that no task or driver holds many."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float64) * w for p, w in zip(pdf["p"], pdf["w"], strict=True))
        return pd.DataFrame({"p": [(total / pdf["w"].sum()).tobytes()], "w": [pdf["w"].sum()]})

    models = written(models, "models")
    while (n := models.count()) > fan:
        groups = -(-n // fan)
        fewer = written(models.withColumn("g", F.pmod(F.xxhash64("p"), F.lit(groups))).groupBy("g").applyInPandas(mean, "p binary, w double"), "models")
        discard(models)
        models = fewer
    rows = sorted(models.collect(), key=lambda r: r.p)
    discard(models)
    total = sum(r.w for r in rows)
    return (sum(np.frombuffer(r.p, np.float64) * r.w for r in rows) / total, total) if total else (np.empty(0), 0.0)


def learn(table: DataFrame, vocab: Vocabulary, hidden: int, classes: int, rounds: int, shard_tokens: int) -> dict:
    """Model parameters: every shard of about shard_tokens tokens trains on all its documents, the shards are averaged."""
    params = gru.initial(vocab.freq, hidden, classes)
    shards = max(1, -(-vocab.n // shard_tokens))
    for k in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], params=params, k=k) -> Iterator[pa.RecordBatch]:
            own, held, size, shard, weight = params, [], 0, None, 0

            def fit(own: dict) -> dict:
                return gru.train(own, held, vocab.end, done=k / rounds, share=1 / rounds)

            def send() -> pa.RecordBatch:
                flat = np.frombuffer(gru.packed(own), np.float32).astype(np.float64)
                return pa.record_batch([pa.array([flat.tobytes()], pa.binary()), pa.array([float(weight)])], names=["p", "w"])

            for b in batches:
                for s, syms in zip(b.column("shard").to_pylist(), b.column("syms").to_pylist(), strict=True):
                    if s != shard and weight:
                        own = fit(own)
                        yield send()
                        own, held, size, weight = params, [], 0, 0
                    shard = s
                    held.append(np.frombuffer(syms, np.uint16))
                    size, weight = size + len(held[-1]), weight + len(held[-1])
                    if size > 4 * shard_tokens:  # a shard that very many equal rows swell goes through in parts
                        own, held, size = fit(own), [], 0
            if weight:
                own = fit(own)
                yield send()

        dealt = sample(table, vocab, shards).repartition(shards, "shard").sortWithinPartitions("shard", "o")
        flat, total = average(dealt.select("shard", "syms").mapInArrow(run, "p binary, w double"))
        if not total:
            break
        params = gru.unpacked(flat, params)
    return params


def score_documents(docs: DataFrame, symbols: int = 1024, hidden: int = 32, classes: int = 32, rounds: int = 2, shard_tokens: int = 2_000_000, common_share: int = 65_536) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens that make up at least one in common_share of all training tokens are common: there are at most so many.
    """
    held = crc_mod("doc_id", 10) == 0
    source = docs.select(F.col("doc_id").cast("long").alias("row"), F.coalesce(held, F.lit(False)).cast("byte").alias("held"), "text")
    table = written(blocks(source.withColumn("row", F.coalesce("row", F.lit(NO_ID)))), "blocks")
    counts = written(token_counts(table), "token_counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = sorted(((r.n, r.h & (1 << 64) - 1) for r in counts.filter(F.col("n") * common_share >= n).collect()), key=lambda x: (-x[0], x[1]))  # at most common_share
    best = common[: symbols - 2]
    vocab = Vocabulary(np.array([h for _, h in best], np.uint64), np.array([c for c, _ in best], np.int64), n, v, symbols, classes)
    by_hash = sorted((h, c) for c, h in common)
    keys, known = np.array([h for h, _ in by_hash], np.uint64), np.array([c for _, c in by_hash], np.int64)
    params = learn(table, vocab, hidden, classes, rounds, shard_tokens)

    def looked_up(hashes: np.ndarray, keys: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, known[at], 0)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        rare = right["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(rare)
        rare, often = rare[order], right["n"].to_numpy(np.int64)[order]
        for row in left.itertuples():
            hashes = np.frombuffer(row.hashes, np.uint64)
            c = looked_up(hashes, keys, known) + looked_up(hashes, rare, often)
            seq, lens = np.frombuffer(row.seq, np.int32), np.frombuffer(row.lens, np.int32)
            sym = vocab.symbols(hashes)
            doc = np.repeat(np.arange(len(lens)), lens)
            add = lambda v, doc=doc, seq=seq, lens=lens: np.bincount(doc, v[seq], len(lens))
            base = np.log10(c + 0.1) - vocab.base
            other = np.where(sym == vocab.unknown, np.log10(c + 0.1) - vocab.rest, 0)
            model = gru.log_likelihood(params, _docs(row.lens, sym[seq]), vocab.end) / math.log(10)
            out.append(pd.DataFrame({"row": np.frombuffer(row.ids, np.int64), "held": np.frombuffer(row.held, np.int8) == 1, "n_tokens": lens.astype(np.int64), "n_known": add((c > 0).astype(float)).astype(np.int64), "base_score": add(base), "score": model + add(other)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: [] for k in ("row", "held", "n_tokens", "n_known", "base_score", "score")})

    left = table.select("block", "ids", "held", "lens", "seq", "hashes").groupBy("block")
    right = rare_counts(table, counts, keys).select("block", "h", "n").groupBy("block")
    done = left.cogroup(right).applyInPandas(finish, "row long, held boolean, n_tokens long, n_known long, base_score double, score double")
    doc_id = F.when(F.col("row") != NO_ID, F.col("row"))
    return done.select(doc_id.alias("doc_id"), F.when(doc_id.isNotNull(), F.col("held")).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.n).cast("long").alias("train_tokens"), "base_score", "score")
