"""WARC archives and their capture index by external merge.

write_archives() writes one gzip member per record into rolling files in the shared folder; a payload that another page
with a larger id has too becomes a revisit of that page. Files are named by task attempt and listed in a written table, so
files of lost or repeated attempts are never read. read_runs() reads the files back, checks every payload's digest, and
turns each file into one run of captures sorted by URL key, timestamp and page. merge_runs() cuts the key space into ranges
of a bounded number of captures; within a range the runs' slices are merged by a loser tree, so the ranges in order are
the global capture history. The range key ends with the page, so captures of one URL may fill many ranges.

Cases: a null payload is empty; a null URL has no target line and the empty key; equal page_ids write a record each, and
of equal payloads every record with the largest page_id is the response; null page_ids come before all others; an empty
table writes no file and gives no capture; payloads of any length are written, read and checked whole, one record in memory
at a time; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import new_path, slices, written

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def _local(path: str) -> str | None:
    return re.sub(r"^file:/*", "/", path) if re.match(r"file:|/", path) else None


def open_path(path: str, mode: str):
    """A file of the shared folder: local, or by Arrow's file systems (hdfs, s3, gs, ...)."""
    if local := _local(path):
        if mode == "wb":
            os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, mode)
    from pyarrow import fs

    system, own = fs.FileSystem.from_uri(path)
    if mode == "wb":
        system.create_dir(os.path.dirname(own), recursive=True)
    return system.open_output_stream(own) if mode == "wb" else system.open_input_stream(own)


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, then path and query; scheme, www, default port and fragment go."""
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").lower().removeprefix("www."), u.port
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    when = EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, least: int = 0, roll: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes a record per row (page_id, url, html); the table of files (file, records, bytes)."""
    folder = new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    same = rows.filter(F.length("payload") >= least).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "keeper")
    rows = rows.join(same, "sha", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, name, made, count, size = TaskContext.get(), None, "", 0, 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.record_batch([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

        for b in slices(batches, 200):
            for page_id, url, payload, sha, keeper in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "keeper")), strict=True):
                if out is None:
                    name, made, count, size = f"{folder}/{task.partitionId():06d}-{made:04d}-{uuid.uuid4().hex[:12]}.warc.gz", made + 1, 0, 0
                    out = open_path(name, "wb")
                revisit = keeper is not None and (page_id is None or page_id < keeper)
                z = zlib.compressobj(level, wbits=31)
                raw = z.compress(record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), keeper, revisit)) + z.flush()
                out.write(raw)
                count, size = count + 1, size + len(raw)
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(rows.select("page_id", "url", "payload", "sha", "keeper").mapInArrow(run, "file string, records long, bytes long"), "archives")


def members(read: Callable[[int], bytes], chunk: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a stream, one in memory at a time."""
    at, rest = 0, read(chunk)
    while rest:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not rest:
                raise EOFError("archive is cut off")
            parts.append(z.decompress(rest))
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data if z.eof else read(chunk)
        yield at, used, b"".join(parts)
        at += used
        rest = rest or read(chunk)


def parse(content: bytes) -> dict:
    """Fields of one record; checks lengths and digest."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)\r?$", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page = lambda x: None if x in (None, "None") else int(x)
    name = lambda k: (m := re.search(r"<urn:x-page:([^>]*)>", fields.get(k, ""))) and m[1]
    return {"url_key": url_key(fields.get("WARC-Target-URI")), "ts": re.sub(r"\D", "", fields["WARC-Date"]), "page_id": page(name("WARC-Record-ID")), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(name("WARC-Refers-To")), "payload": payload}


def read_runs(archives: DataFrame) -> DataFrame:
    """Captures of every file as runs: (run, pos, captures ...), sorted within a run by URL key, timestamp and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                rows = []
                with open_path(file, "rb") as f:
                    for offset, length, content in members(f.read):
                        r = parse(content)
                        rows.append((*(r[c] for c in NAMES[:7]), file, offset, length))
                rows.sort(key=_order)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.record_batch([pa.array([os.path.basename(file)] * len(rows)), pa.array(range(len(rows)), pa.int64()), *cols], names=["run", "pos", *NAMES])

    n = max(1, archives.count())
    spread = archives.select("file").repartition(min(n, 4 * archives.sparkSession.sparkContext.defaultParallelism + n // 8))
    return written(spread.mapInArrow(run, f"run string, pos long, {CAPTURE}"), "runs")


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges sorted sequences: each inner node keeps the loser of its match, so the next winner replays one path."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.head]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.tree[at] == -1:
                self.tree[at] = i
                return
            if self._beats(self.tree[at], i):
                i, self.tree[at] = self.tree[at], i
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[w := self.tree[0]] is not None:
            yield self.head[w]
            self.head[w] = h = next(self.runs[w], None)
            self.keys[w] = None if h is None else self.key(h)
            self._play(w)


def merge_runs(runs: DataFrame, rows_a_range: int = 100_000) -> DataFrame:
    """All captures in global order: (part, place, captures ...), parts and places ascending."""
    n = max(1, -(-runs.count() // rows_a_range))
    cut = runs.repartitionByRange(n, "url_key", "ts", F.col("page_id").asc_nulls_first(), "file", "offset").sortWithinPartitions("run", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list[tuple]] = {}
        for b in batches:
            for name, *row in zip(b.column("run").to_pylist(), *(b.column(c).to_pylist() for c in NAMES), strict=True):
                own.setdefault(name, []).append(tuple(row))
        part, place, held = TaskContext.get().partitionId(), 0, []
        for row in LoserTree([iter(r) for r in own.values()], _order):
            held.append(row)
            if len(held) == 10_000:
                yield _merged(part, place, held)
                place, held = place + len(held), []
        if held:
            yield _merged(part, place, held)

    return cut.select("run", *NAMES).mapInArrow(run, f"part int, place long, {CAPTURE}")


def _merged(part: int, place: int, rows: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
    return pa.record_batch([pa.array([part] * len(rows), pa.int32()), pa.array(range(place, place + len(rows)), pa.int64()), *cols], names=["part", "place", *NAMES])


def capture_history(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives of `pages`, reads them back and merges their index: captures with their number from 0 in the
    global order of URL key, timestamp and page (column `capture`), and the range and the place in it that give it."""
    merged = written(merge_runs(read_runs(write_archives(pages, least))), "captures")
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = sizes.select(F.col("part").alias("_part"), before.alias("_before"))
    return merged.join(starts, F.col("part") == F.col("_part")).withColumn("capture", F.col("_before") + F.col("place")).drop("_part", "_before")
