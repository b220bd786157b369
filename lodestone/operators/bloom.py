"""Key filters without false negatives: blocked Bloom filters as rows that merge by bitwise or.

A filter is a table of blocks of 512 bits. A key has a block by one hash and `probes` bits in it by others, so a test reads
one row. Building is one aggregate, the bitwise or of the keys' masks by block, which combines before its shuffle; filters of
equal shape merge by the same aggregate, in any order, to the filter of all their keys. A filter whose size, known before it
is used, is under a limit is sent to all tasks; a larger one stays dealt by block, and keys travel to it.

Null keys are in no filter, and no filter may hold them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS = 64 * WORDS
ROW_BYTES = 8 * (WORDS + 1)


@dataclass(frozen=True)
class Shape:
    """Number of blocks, and of bits that a key sets."""

    blocks: int
    probes: int

    @staticmethod
    def of(keys: int, bits_per_key: float = 10.0) -> Shape:
        return Shape(max(1, -(-int(keys * bits_per_key) // BITS)), max(1, round(bits_per_key * log(2))))

    @property
    def bytes(self) -> int:
        return self.blocks * ROW_BYTES

    def expected(self, keys: int) -> float:
        """Rate of false positives of an unblocked filter with as many bits."""
        return (1 - exp(-self.probes * keys / (self.blocks * BITS))) ** self.probes


def _block(key: Column, shape: Shape) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shape.blocks).cast("long"))


def _places(key: Column, shape: Shape) -> list[Column]:
    """Places in the block: nine bits of a hash each, seven to a hash."""
    hashes = [F.xxhash64(F.lit(i + 1), key) for i in range(-(-shape.probes // 7))]
    return [F.shiftrightunsigned(hashes[i // 7], 9 * (i % 7)).bitwiseAND(F.lit(BITS - 1)).cast("int") for i in range(shape.probes)]


def build(keys: DataFrame, key: str, shape: Shape) -> DataFrame:
    """(block, w0 .. w7) of the keys that are there."""
    at = [F.col(f"_p{i}") for i in range(shape.probes)]
    placed = keys.filter(F.col(key).isNotNull()).select(_block(F.col(key), shape).alias("block"), *[p.alias(f"_p{i}") for i, p in enumerate(_places(F.col(key), shape))])
    one = lambda p: F.expr(f"shiftleft(1L, {p} & 63)")
    word = lambda w: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.shiftright(p, 6) == w, one(f"_p{i}")).otherwise(F.lit(0).cast("long")) for i, p in enumerate(at)])
    return placed.groupBy("block").agg(*[F.bit_or(word(w)).alias(f"w{w}") for w in range(WORDS)])


def merge(filters: list[DataFrame]) -> DataFrame:
    """The filter of all keys of filters of one shape."""
    return reduce(DataFrame.unionByName, filters).groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def may_hold(rows: DataFrame, key: str, held: DataFrame, shape: Shape, send_bytes: int = 32 << 20) -> DataFrame:
    """The rows whose key the filter may hold: all whose key it was built from, and few others."""
    own = held.select(F.col("block").alias("_block"), F.array(*[f"w{w}" for w in range(WORDS)]).alias("_bits"))
    own = F.broadcast(own) if shape.bytes <= send_bytes else own
    asked = rows.withColumn("_block", _block(F.col(key), shape)).filter(F.col(key).isNotNull())
    hit = reduce(lambda a, b: a & b, [F.expr(f"(shiftrightunsigned(_bits[_q{i} >> 6], _q{i} & 63) & 1) = 1") for i in range(shape.probes)])
    met = asked.join(own, "_block").withColumns({f"_q{i}": p for i, p in enumerate(_places(F.col(key), shape))})
    return met.filter(hit).select(*rows.columns)


def semi_join(rows: DataFrame, keys: DataFrame, key: str, bits_per_key: float = 10.0, send_bytes: int = 32 << 20) -> DataFrame:
    """Rows whose key is among the keys: the filter takes most others out before rows are shuffled, then the join is exact."""
    shape = Shape.of(keys.count(), bits_per_key)
    return may_hold(rows, key, build(keys, key, shape), shape, send_bytes).join(keys.select(key), key, "left_semi").select(*rows.columns)
