"""Telling rows that may be among some keys before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB.
MOST_BITS = 1 << 27


def may_be_among(keys: DataFrame, column: str, most_bits: int = MOST_BITS) -> Callable[[DataFrame], DataFrame]:
    """A filter for rows with ``column``: all whose value ``keys`` has pass, and few others. A join after it is exact.

    The filter is a bit for each hash, in rows of 4 KB that are broadcast; its
    size follows the number of keys up to ``most_bits`` and no further. With far
    more keys than bits most rows pass.
    """
    bits = 1 << 15
    while bits < min(16 * keys.count(), most_bits):
        bits *= 2
    bit = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    table = keys.select(F.bitmap_bucket_number(bit).alias("__bucket"), F.bitmap_bit_position(bit).alias("at"))
    table = table.groupBy("__bucket").agg(F.bitmap_construct_agg("at").alias("__bits"))

    def passed(rows: DataFrame) -> DataFrame:
        # At most most_bits / 32768 rows of 4 KB.
        joined = rows.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(table), "__bucket")
        at = F.bitmap_bit_position(bit)
        byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return joined.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)

    return passed
