"""SimHash near-duplicate classes by a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 bytes. Two fingerprints that differ in at most 3 bits differ in at most 3 bytes, so they share
at least 5 positional bytes: the guaranteed minimum of the count filter. A posting of one (position, byte) pair would hold
1/256 of all fingerprints, so postings are keyed by several positions at once. Among any 5 positions, 3 lie in the same
half of the 8, so the 8 triples inside the two halves reach every such pair. A posting longer than `cap` is keyed again by
every 5 positions that hold its triple, and if still longer by 3 of 6 nibbles of the other 24 bits: at most 4096 distinct
fingerprints can agree there, so no posting that is compared is unbounded and none is cut.

Inside a posting, the shared positional bytes of a pair are tallied, pairs with fewer than the minimum go, and the others
are verified by Hamming distance. A posting emits a spanning forest of its links, never its pairs. Only distinct
fingerprints take part, so exact copies cost nothing. Components come from alternating large-star and small-star steps.

Cases: null and empty texts have fingerprint zero and are linked like any other; repeated rows stay rows of their own;
a null doc_id keeps its row and is never a component id unless its whole component has none; texts are taken whole, however
long; a bit that exactly half of the hashes set is 0, and of equal ids any stands for its component; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chunks import settled
from lodestone.llm.common import discard, fresh, slices, utf8, written

SEED = 42
BYTE = [0xFF << (8 * i) for i in range(8)]
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
FIVES = list(combinations(range(8), 5))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(positions) -> int:
    return sum(BYTE[i] for i in positions)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a UTF-8 text over word shingles; 0 if it has no word."""
    words = text.lower().split()  # bytes: A-Z only, and just the six ASCII white-space bytes
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 64):
        bits = np.unpackbits(h[i : i + 255 * 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, width) for t in utf8(b, text_col)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(id_col), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _linked(a: np.ndarray, x: np.uint64, max_bits: int) -> np.ndarray:
    """Which of a are linked to x: tally of shared positional bytes, then Hamming distance."""
    y = a ^ x
    z = y | (y >> np.uint64(4))
    z |= z >> np.uint64(2)
    z |= z >> np.uint64(1)
    near = np.flatnonzero(np.bitwise_count(z & np.uint64(0x0101010101010101)) <= max_bits)
    return near[np.bitwise_count(y[near]) <= max_bits]


def _forest(a: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one posting, as (root, member)."""
    out, rest = [], a
    while len(rest) > 1:
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            hit = _linked(rest, todo.pop(), max_bits)
            if len(hit):
                found = rest[hit]
                out += [(int(root), int(v)) for v in found]
                todo += list(found)
                rest = np.delete(rest, hit)
    return out


def _posting_edges(postings: DataFrame, max_bits: int) -> DataFrame:
    """Links inside postings (t, k, fp) none of which is longer than a bound; postings are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(fp)]
            two = ends - starts == 2
            u, v = fp[starts[two]], fp[starts[two] + 1]
            ok = np.bitwise_count(u ^ v) <= max_bits
            out = list(zip(u[ok].tolist(), v[ok].tolist(), strict=True))
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                out += _forest(fp[s:e], max_bits)
            return out

        def send(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.record_batch([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["u", "v"])

        key, fp = np.empty((0, 2), np.int64), np.empty(0, np.uint64)
        for b in batches:
            key = np.concatenate([key, np.column_stack([b.column("t").to_numpy().astype(np.int64), b.column("k").to_numpy()])])
            fp = np.concatenate([fp, b.column("fp").to_numpy().view(np.uint64)])
            if not len(fp):
                continue
            last = int(np.flatnonzero((key == key[-1]).all(axis=1))[0])
            if last:
                yield send(flush(key[:last], fp[:last]))
                key, fp = key[last:], fp[last:]
        if len(fp):
            yield send(flush(key, fp))

    return postings.select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(run, "u long, v long")


def _counted(keys: DataFrame) -> DataFrame:
    """Postings of two or more, with their length."""
    n = keys.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(n, ["t", "k"])


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    key = [F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)]
    return fps.select("fp", F.inline(F.array(*key)))


def links(fps: DataFrame, max_bits: int = 3, cap: int = 4096) -> DataFrame:
    """A spanning set of links (u, v) between distinct fingerprints (column fp) within max_bits, at most 3."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the postings guarantee links of up to 3 bits")
    post = written(_counted(_keyed(fps.select("fp").distinct(), [_mask(c) for c in TRIPLES])), "postings")
    edges, made = _posting_edges(post.filter(F.col("n") <= cap), max_bits), [post]
    if post.filter(F.col("n") > cap).limit(1).count():  # the exact way for long postings
        holds = [[i for i, f in enumerate(FIVES) if set(t) <= set(f)] for t in TRIPLES]
        five = F.array(*[F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(FIVES[i])))).alias("k")) for i in h]) for h in holds])
        keys = post.filter(F.col("n") > cap).select("fp", F.inline(F.element_at(five, F.col("t") + 1))).distinct()
        post5 = written(_counted(keys), "postings5")
        made.append(post5)
        edges = edges.union(_posting_edges(post5.filter(F.col("n") <= cap), max_bits))
        rest = post5.filter(F.col("n") > cap)
        if rest.limit(1).count():
            masks = []
            for f in FIVES:
                nibbles = [0xF << (8 * i + s) for i in range(8) if i not in f for s in (0, 4)]
                masks.append([_signed(_mask(f) | sum(c)) for c in combinations(nibbles, 3)])
            keys = rest.select("fp", "t", F.posexplode(F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in masks]), F.col("t") + 1)).alias("c", "m"))
            keys = keys.select("fp", (F.col("t") * 20 + F.col("c")).alias("t"), F.col("fp").bitwiseAND(F.col("m")).alias("k"))
            edges = edges.union(_posting_edges(_counted(keys), max_bits))
    out = written(edges.distinct(), "links")
    discard(*made)
    return out


def components(edges: DataFrame, label: str = "cc", most: int = 60) -> DataFrame:
    """(node, root) for the nodes of edges (u, v): root is the smallest node of the component.

    Large-star, then small-star, until the edges no longer change; every round is a written table. A hub's neighbours are
    met by a partial minimum and a join that AQE can split, never by one task's list.
    """
    cur = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    seen = None
    for _ in range(most):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, cur = cur, written(small.union(down.select("u", F.col("m").alias("v"))).distinct(), label)
        if hasattr(old, "_written_to"):
            discard(old)
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, cap: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, component_id) of every row: component_id is the smallest id reachable over links."""
    fps = written(fingerprints(docs, width, id_col, text_col), "fps")
    first = fps.groupBy("fp").agg(F.min(id_col).alias("lo"))
    comp = components(links(fps, max_bits, cap))
    root = first.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    best = root.groupBy("root").agg(F.min("lo").alias("component_id"))
    mapped = root.select("fp", "root").join(best, "root").select("fp", "component_id")
    return fps.join(mapped, "fp").select(id_col, "fp", "component_id")


# Similar documents: five-word shingles and a Jaccard similarity of about 0.8 need more room than 64 bits. Documents of
# Jaccard similarity s have shingle sets of cosine 2s/(1+s), so each bit of a SimHash differs with probability
# arccos(2s/(1+s))/pi: 0.15 at 0.8. Of 512 bits about 78 differ, and about 17 of the 64 positional bytes stay equal, against
# a quarter of a byte for unrelated texts. The same index then works with a count filter that holds all but surely.
WIDE_BITS, WIDE_BYTES = 512, 64


def wide_keys(size: int) -> np.ndarray:
    """[key, byte] positions: 4 ** (size + 1) sets of `size` different positional bytes, each byte in equally many.

    A byte stays equal with 0.27 at a similarity of 0.8, so a key of one byte more is met by about a quarter of the pairs
    that met the shorter one, and four times as many keys keep the recall; unrelated texts meet in 256 times fewer.
    """
    steps, rng = [(11, 38), (23, 10), (7, 29), (17, 41)], np.random.default_rng(size)
    if size != 3:
        steps = [tuple((1 + rng.choice(WIDE_BYTES - 1, size - 1, replace=False)).tolist()) for _ in range(max(1, 4 ** (size - 2)))]
    return np.array([[i, *((i + s) % WIDE_BYTES for s in step)] for step in steps for i in range(WIDE_BYTES)])


def key_bytes(rows: int) -> int:
    """Bytes of a key: one more for every 256 times as many rows, from half a billion on. Until then unrelated texts that
    meet, 2 ** -16 of all pairs, cost less than four times as many keys would."""
    return 3 + max(0, -(-(max(1, rows).bit_length() - 30) // 8))


def wide_fingerprint(text: bytes, width: int = 5) -> bytes:
    """512-bit SimHash over distinct word shingles; zero if there is no word."""
    words = text.lower().split()
    if not words:
        return bytes(WIDE_BYTES)
    grams = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))
    total = np.zeros(WIDE_BITS, np.int64)
    step = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(h), 255 * 16):
        x = h[i : i + 255 * 16, None] + step  # eight words of mixed bits from each hash
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").tobytes()


def _wide_near(a: np.ndarray, x: np.ndarray, max_bits: int, shared: int) -> np.ndarray:
    """Places of the fingerprints in a that are within max_bits of x and share enough bytes with it."""
    y = a ^ x
    near = np.flatnonzero(np.bitwise_count(y).sum(axis=1, dtype=np.int32) <= max_bits)
    return near[(y[near].view(np.uint8).reshape(-1, WIDE_BYTES) == 0).sum(axis=1) >= shared]


def _first_common(a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first of the keys at which the fingerprints of each row agree."""
    same = (a ^ b).view(np.uint8).reshape(-1, WIDE_BYTES) == 0
    return np.argmax(np.logical_and.reduce([same[:, place[:, i]] for i in range(place.shape[1])]), axis=1)


UNIT = ["t", "k", "i", "j"]


def _units(post: DataFrame, fps: DataFrame, cap: int) -> DataFrame:
    """Postings (t, k, fid, n) with the columns of fps, cut into units to compare: a posting of more than about cap
    fingerprints is cut into blocks, and every two of its blocks, and every block with itself, are a unit (t, k, i, j)."""
    cuts = F.ceil(F.col("n") / cap).cast("int")
    own = post.select("t", "k", "fid", F.pmod(F.xxhash64("fid", "t"), cuts).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), cuts - 1)).alias("o"))
    own = own.select("t", "k", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "fid")
    return _in_order(own.join(fps, "fid"))


def _in_order(units: DataFrame) -> DataFrame:
    return units.repartition(*UNIT).sortWithinPartitions(*UNIT, "b", "fid")


def _whole_units(batches: Iterator[pa.RecordBatch], more: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of whole units, in order: keys [row, 4], b, fid, fp, c and the columns of `more` as lists."""
    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(x).to_numpy().astype(np.int64) for x in UNIT])
        fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, 8)
        texts = [np.array([*batch.column(x).to_pylist(), None], object)[:-1] for x in more]
        got = (key, batch.column("b").to_numpy(), batch.column("fid").to_numpy(), fp, batch.column("c").to_numpy(), *texts)
        if (key[0] == key[-1]).all() and (not held or (held[-1][0][-1] == key[0]).all()):
            held.append(got)  # still inside one unit
            continue
        all_ = [np.concatenate(x) for x in zip(*held, got, strict=True)]
        last = int(np.flatnonzero((all_[0] == all_[0][-1]).all(axis=1))[0])
        if last:
            yield tuple(x[:last] for x in all_)
        held = [tuple(x[last:] for x in all_)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _pairs(key: np.ndarray, b: np.ndarray, fp: np.ndarray, c: np.ndarray, max_bits: int, shared: int, once: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and differing bits of the pairs of one unit that are near enough and of different c; with the keys as `once`,
    only of those for which the unit's posting is the first that holds both."""
    t, within = int(key[0, 0]), key[0, 2] == key[0, 3]
    second = int(np.searchsorted(b, b[0], "right"))  # the second block starts there
    xs, ys = [], []
    for x in range(len(b) - 1 if within else second if second < len(b) else 0):
        start = x + 1 if within else second
        hit = start + _wide_near(fp[start:], fp[x], max_bits, shared)
        hit = hit[c[hit] != c[x]]
        if once is not None and len(hit):
            hit = hit[_first_common(fp[hit], fp[x][None], once) == t]
        xs.append(np.full(len(hit), x))
        ys.append(hit)
    none = np.empty(0, np.int64)
    x, y = np.concatenate([none, *xs]).astype(np.int64), np.concatenate([none, *ys]).astype(np.int64)
    return x, y, np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int32)


def _members(units: DataFrame, max_bits: int, shared: int, once: np.ndarray | None) -> DataFrame:
    """The rows (unit, b, fid) of units that lie in any pair: they are few, and only their texts are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, b, fid, fp, c in _whole_units(batches, []):
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(fid)]
            keep = np.zeros(len(fid), bool)
            two = starts[(ends - starts == 2) & (key[starts, 2] == key[starts, 3])]
            y = fp[two] ^ fp[two + 1]
            two = two[(c[two] != c[two + 1]) & ((y.view(np.uint8).reshape(-1, WIDE_BYTES) == 0).sum(axis=1) >= shared) & (np.bitwise_count(y).sum(axis=1, dtype=np.int32) <= max_bits)]
            if once is not None:
                two = two[_first_common(fp[two], fp[two + 1], once) == key[two, 0]]
            keep[two] = keep[two + 1] = True
            for s, e in zip(starts, ends, strict=True):
                if e - s > 2 or e - s == 2 and key[s, 2] != key[s, 3]:
                    x, y, _ = _pairs(key[s:e], b[s:e], fp[s:e], c[s:e], max_bits, shared, once)
                    keep[s + x] = keep[s + y] = True
            yield pa.record_batch([*(pa.array(key[keep, i]) for i in range(4)), pa.array(b[keep].astype(np.int64)), pa.array(fid[keep])], names=[*UNIT, "b", "fid"])

    return units.select(*UNIT, "b", "fid", "fp", "c").mapInArrow(run, "t long, k long, i long, j long, b long, fid long")


def shingles(text: bytes, width: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def _verified(units: DataFrame, max_bits: int, shared: int, once: np.ndarray | None, width: int, least: float) -> DataFrame:
    """Links (u, v) that join the classes c of a unit's rows (with texts): pairs are verified by the Jaccard similarity of
    their shingles, the nearest first, unless links of the unit join them already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, b, fid, fp, c, text in _whole_units(batches, ["text"]):
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out = []
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fid)], strict=True):
                xs, ys, bits = _pairs(key[s:e], b[s:e], fp[s:e], c[s:e], max_bits, shared, once)
                root = {x: x for x in c[s:e].tolist()}
                sets: dict[int, set[bytes]] = {}

                def find(x: int, root=root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                def grams(x: int, s=s, sets=sets, text=text) -> set[bytes]:
                    if x not in sets:
                        sets[x] = shingles(text[s + x] or b"", width)
                    return sets[x]

                for k in np.lexsort((ys, xs, bits)).tolist():
                    x, y = int(xs[k]), int(ys[k])
                    p, q = find(int(c[s + x])), find(int(c[s + y]))
                    if p == q:
                        continue
                    one, two = grams(x), grams(y)
                    if least * max(len(one), len(two)) <= min(len(one), len(two)):
                        n = len(one & two)
                        if n >= least * (len(one) + len(two) - n):
                            root[max(p, q)] = min(p, q)
                            out.append((int(fid[s + x]), int(fid[s + y])))
            if out:
                u = np.array(out, np.int64)
                yield pa.record_batch([pa.array(u.min(axis=1)), pa.array(u.max(axis=1))], names=["u", "v"])

    return units.select(*UNIT, "b", "fid", "fp", "c", F.col("text").cast("binary").alias("text")).mapInArrow(run, "u long, v long")


def similar_links(fps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], width: int = 5, least: float = 0.8, max_bits: int = 110, shared: int = 6, cap: int = 1024, tight: int = 60, dense: int = 64, size: int | None = None) -> DataFrame:
    """A spanning set of the links (u, v) of a shingle similarity of at least `least` between distinct wide fingerprints
    (columns fid, fp) that meet in a posting within max_bits; a written table.

    texts_of(fids) gives (fid, text). Every pair that meets is verified or lies in one class of verified links. Postings
    of more than `dense` first give the links within `tight` bits, so that groups of near copies are joined by few tests;
    then all postings are tested for pairs that those classes do not join already. Pairs are never rows of a table: a
    unit's rows come with their texts and are compared where they are.
    """

    size = size or key_bytes(fps.count())
    place = wide_keys(size)
    low = 8 * size

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2000):
            x = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, WIDE_BYTES).astype(np.int64)
            k = np.arange(len(place)) << low
            for i in range(size):
                k = k | x[:, place[:, i]] << 8 * i
            yield pa.record_batch([pa.array(k.ravel()), pa.array(np.repeat(b.column("fid").to_numpy(), len(place)))], names=["key", "fid"])

    def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, in order of key, whose key is also that of a neighbour; the last row waits for the next batch."""
        last, met = np.empty((2, 0), np.int64), False
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([last, np.stack([b.column("key").to_numpy(), b.column("fid").to_numpy()])], axis=1)
            like = rows[0, 1:] == rows[0, :-1]
            keep = np.r_[met, like] | np.r_[like, False]
            out = rows[:, :-1][:, keep[:-1]]
            yield pa.record_batch([pa.array(out[0]), pa.array(out[1])], names=["key", "fid"])
            met = bool(like[-1]) if len(like) else met
            last = rows[:, -1:]
        if met:
            yield pa.record_batch([pa.array(last[0]), pa.array(last[1])], names=["key", "fid"])

    pairs = "key long, fid long"
    some = settled(fps.select("fid", "fp").mapInArrow(keyed, pairs).repartition("key").sortWithinPartitions("key").mapInArrow(shared_only, pairs), "wide_keys")
    keys = some.select(F.shiftright("key", low).cast("int").alias("t"), F.col("key").bitwiseAND(F.lit((1 << low) - 1)).alias("k"), "fid")
    post = settled(_counted(keys), "wide_post")
    discard(some)

    def found(some: DataFrame, own: DataFrame, bits: int, once: np.ndarray | None, label: str) -> DataFrame:
        near = settled(_members(_units(some, own, cap), bits, shared, once), "wide_near")
        texts = settled(texts_of(near.select("fid")).join(own, "fid"), "wide_texts")
        out = settled(_verified(_in_order(near.join(texts, "fid")), bits, shared, once, width, least), label)
        discard(near, texts)
        return out

    made, first, own = [post], None, fps.select("fid", "fp", F.col("fid").alias("c"))
    long_ = post.filter((F.col("n") > dense) & (F.col("t") < len(place) // 4))  # so near pairs share half of their bytes
    if long_.limit(1).count():
        first = found(long_, own, min(tight, max_bits), None, "wide_first")
        classes = settled(components(first, "wide_cc1").select(F.col("node").alias("fid"), "root").distinct(), "wide_classes")
        made.append(classes)
        own = fps.select("fid", "fp").join(classes, "fid", "left").select("fid", "fp", F.coalesce("root", "fid").alias("c"))
    sure = found(post, own, max_bits, place, "wide_sure")
    discard(*made)
    return sure if first is None else sure.union(first)


def _picked(rows: DataFrame, row: str, picks: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The rows whose number (column row of both, 0 or more) is in picks.

    Rows carry whole texts and stay where they are: the numbers come to them as bits, 64 to a word, if these are at most
    `most` words, a number and a bit mask each; only beyond that rows are dealt by their number.
    """
    word, bits = (fresh(c, rows.columns) for c in ("word", "bits"))
    masks = picks.groupBy(F.shiftright(row, 6).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{row}` & 63 AS int)))").alias(bits))
    masks = settled(masks, "wide_picks")
    if masks.count() > most:
        return rows.join(picks, row, "left_semi").select(*[f"`{c}`" for c in rows.columns])
    met = rows.join(F.broadcast(masks), F.shiftright(row, 6) == F.col(word))
    return met.filter(F.expr(f"getbit(`{bits}`, cast(`{row}` & 63 AS int)) = 1")).select(*[f"`{c}`" for c in rows.columns])


def first_of_each(docs: DataFrame, width: int = 5, least: float = 0.8, max_bits: int = 110, cap: int = 1024, size: int | None = None) -> DataFrame:
    """The rows of docs, all columns, that come first in their class of similar texts: smallest doc_id, nulls last.

    Texts are linked whose word shingles have a Jaccard similarity of at least `least`, of the pairs that postings of
    their wide fingerprints join. `size` is the bytes of a posting's key, by default what the number of texts asks for.
    """
    names = docs.columns
    fp, row = (fresh(c, names) for c in ("fp", "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [wide_fingerprint(t, width) for t in utf8(b, "text")]
            yield pa.record_batch([*b.columns, pa.array(own, pa.binary())], names=[*b.schema.names, fp])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(run, f"{kinds}, `{fp}` binary").withColumn(row, F.monotonically_increasing_id())
    rows = settled(rows, "wide_rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col(row).alias("row"))
    one = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("o"))
    one = settled(one.select(F.col("o.row").alias("fid"), "fp", "o"), "wide_fps")  # a fingerprint's number is its first row

    def texts_of(fids: DataFrame) -> DataFrame:  # one text stands for a fingerprint: that of its first row
        return _picked(rows.select(F.col(row).alias("fid"), "text"), "fid", fids)

    sure = similar_links(one.select("fid", "fp"), texts_of, width, least, max_bits, cap=cap, size=size)
    classes = components(sure, "wide_cc").select(F.col("node").alias("fid"), "root")
    best = one.join(classes, "fid", "left").groupBy(F.coalesce("root", "fid").alias("root")).agg(F.min("o").alias("o")).select(F.col("o.row").alias(row))
    return _picked(rows, row, best).select(*[f"`{c}`" for c in names])
