"""Chunks of whole rows, and hashed items that chunks exchange by bucket.

Word windows and phrases outnumber the words they are made of, and most of them occur once. So they do not travel as rows.
Rows are packed into chunks of some megabytes of text, written once. A chunk sends its distinct items as four bytes of a
hash each, with a small weight, to the bucket that the hash's other bits name; a bucket gathers what all chunks sent, judges
every hash by its weights, and answers each chunk with those of its hashes that stand. A hash that stands by mistake, for
two items that share one, costs a little work, as the chunks then take up whole items; one that should stand is never lost.

An item counts once in a chunk however often it occurs there, so a bucket holds at most one entry for each chunk and item,
and none is hot. Bucket and chunk sizes are parameters: a bucket is held by one task, and bytes of text over chunk size
times bytes of text over bucket size is the number of messages, so larger inputs want both larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import slices, written

U = np.uint64
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)


def settled(df: DataFrame, label: str) -> DataFrame:
    """written(), after which the shuffle files behind the table go too."""
    with _cleaning(df.sparkSession):
        return written(df, label)


def chunked(rows: DataFrame, text: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """(chunk, size, body) as a written table: whole rows with so many bytes of text, or one row with more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, part = [], 0, 0, TaskContext.get().partitionId()

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in held:
                    out.write_batch(b)
            return pa.record_batch([pa.array([(part << 32) + made]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "body"])

        for b in slices(batches, 10_000):
            length = np.array([x or 0 for x in pa.compute.binary_length(b.column(text)).to_pylist()], np.int64)
            at = 0
            while at < b.num_rows:
                end = at + max(1, int(np.searchsorted(np.cumsum(length[at:]), chunk_bytes - size, side="right")))
                held.append(b.slice(at, end - at))
                size += int(length[at:end].sum())
                at = end
                if size >= chunk_bytes or at < b.num_rows:
                    yield chunk()
                    held, size, made = [], 0, made + 1
        if held:
            yield chunk()

    return settled(rows.mapInArrow(pack, "chunk long, size long, body binary"), "chunks")


def buckets_for(chunks: DataFrame, bucket_bytes: int) -> int:
    """Number of buckets if one gets the items of so many bytes of text."""
    total = chunks.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def rows_of(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


class Numbers(dict):
    """Word to its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def lanes(words: Numbers) -> np.ndarray:
    """Two independent 64-bit hashes of each numbered word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)


def factors(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit factors for each of two lanes."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"%d %d" % (salt, i)) for i in range(n)), np.uint64).reshape(-1, 2) | U(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolled(words: np.ndarray, n: int, by: np.ndarray) -> np.ndarray:
    """Hash of every n consecutive words of one lane."""
    size = max(0, len(words) - n + 1)
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h += words[i : i + size] * by[i]
    return mixed(h)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash; in order of the hashes."""
    return ((h >> U(32)) * U(buckets)) >> U(32)


def keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half: all that travels of a hash."""
    return (bucket_of(h, buckets) << U(32)) | (h & U(0xFFFFFFFF))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal neighbours."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.r_[starts[1:], len(sorted_values)]


def messages(chunk: int, h: np.ndarray, buckets: int, *columns: np.ndarray, pack: Callable[[bytes], bytes] = bytes) -> pa.RecordBatch:
    """(bucket, chunk, items) rows for items in order of their hash; items are the columns' bytes one after the other."""
    b = bucket_of(h, buckets)
    starts, ends = runs(b)
    items = [pack(b"".join(c[s:e].tobytes() for c in columns)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.record_batch([pa.array(b[starts].astype(np.int32)), pa.array(np.full(len(starts), chunk, np.int64)), pa.array(items, pa.binary())], names=["bucket", "chunk", "items"])


MESSAGE = "bucket int, chunk long, items binary"


def standing(chunks: DataFrame, emit: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], judge: Callable[[np.ndarray, np.ndarray], np.ndarray], weight: type, buckets: int, label: str) -> DataFrame:
    """(bucket, chunk, items): the hashes of each chunk that stand.

    emit gives a chunk's distinct hashes in order and their weights; judge gets all weights, equal hashes side by side, and
    where each run of equals starts, and says which runs stand.
    """
    wide = np.dtype(weight).itemsize

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body"), strict=True):
                h, w = emit(rows_of(body.as_py()))
                yield messages(chunk, h, buckets, (h & U(0xFFFFFFFF)).astype(np.uint32), w.astype(weight))

    def gather(t: pa.Table) -> pa.Table:
        items, chunk = t.column("items").to_pylist(), t.column("chunk").to_pylist()
        n = [len(x) // (4 + wide) for x in items]
        low = np.concatenate([np.frombuffer(x, np.uint32, k) for x, k in zip(items, n, strict=True)])
        w = np.concatenate([np.frombuffer(x, weight, k, 4 * k) for x, k in zip(items, n, strict=True)])
        order = np.argsort(low, kind="stable")
        starts, ends = runs(low[order])
        ok = np.zeros(len(low), bool)
        ok[order] = np.repeat(judge(w[order], starts), ends - starts)
        out, at = [], 0
        for c, k in zip(chunk, n, strict=True):
            mine = low[at : at + k][ok[at : at + k]]
            if len(mine):
                out.append((c, mine.tobytes()))
            at += k
        return pa.table([pa.array([t.column("bucket")[0].as_py()] * len(out), pa.int32()), pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "chunk", "items"])

    return settled(chunks.mapInArrow(send, MESSAGE).groupBy("bucket").applyInArrow(gather, MESSAGE), label)


def standing_keys(answers: pa.Table) -> np.ndarray:
    """Keys of a chunk that stand, in order."""
    parts = [(U(b) << U(32)) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(answers.column("bucket").to_pylist(), answers.column("items").to_pylist(), strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are among the ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def answered(chunks: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """f(chunk, its rows, its answers) for every chunk."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def meet(own: pa.Table, got: pa.Table) -> pa.Table:
        if not own.num_rows:
            return kinds.empty_table()
        out = f(own.column("chunk")[0].as_py(), rows_of(own.column("body")[0].as_py()), got)
        return pa.Table.from_batches(out).cast(kinds)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)
