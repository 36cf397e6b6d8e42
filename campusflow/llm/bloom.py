"""Bloom filters as literals of a query, of a bounded size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 4
BITS = 8
#: The largest level (bytes) that goes into a query as a literal.
LITERAL_BYTES = 16 << 20

@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    data: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(j)), F.lit(self.bits)) for j in range(HASHES)]

    def passes(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(F.lit(self.data), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10)
            out = out & (F.call_function("shiftright", byte.cast("int"), F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out


def bloom_level(keys: DataFrame, count: int, number: int) -> Level:
    """The Bloom filter of ``count`` keys; the driver receives its bits only."""
    bits = max(64, count * BITS)
    if bits // 8 > LITERAL_BYTES:
        raise ValueError(f"{count} keys exceed a literal of {LITERAL_BYTES} bytes")
    level = Level(number, bits, b"")
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    byte = F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("at", F.lit(8)).cast("int")))
    data = bytearray(-(-bits // 8))
    for row in at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(byte.alias("value")).collect():
        data[row["byte"]] = row["value"]
    return Level(number, bits, bytes(data))


def only_likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is probably among ``wanted``'s, so that a join
    that follows moves few others. Lists beyond a literal filter nothing."""
    count = wanted.count()
    if count * BITS // 8 > LITERAL_BYTES:
        return rows
    level = bloom_level(wanted.select(F.col(column).alias("key")), count, 0)
    return rows.where(level.passes(F.col(column)))
