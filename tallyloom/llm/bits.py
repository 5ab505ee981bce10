"""A bitmap of fixed size over 64-bit fingerprints, to leave rows out of a shuffle that can't matter to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import fresh

#: Bits of the map: its size on the driver and on the executors is BITS / 8 bytes (4 MiB) whatever the corpus is.
BITS = 1 << 25


def bitmap_table(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(bucket, bits): bit (key mod bits) is set for every key; a row of 4 KiB per bucket, bits / 32768 rows at most."""
    place = F.pmod(key, F.lit(bits)) + 1  # Spark numbers bits from 1
    return keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))


def with_hits(df: DataFrame, key: Column, table: DataFrame, hit: str, bits: int = BITS) -> DataFrame:
    """df with the boolean column `hit`: false only where the key is surely none of the table's (a broadcast of bits / 8 bytes at most)."""
    taken, bucket, map_ = fresh(df, hit, "bucket", "bits")
    place = F.pmod(key, F.lit(bits))
    joined = df.join(F.broadcast(table.select(F.col("bucket").alias(bucket), F.col("bits").alias(map_))), F.floor(place / 32768) + 1 == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(map_), (F.floor(place % 32768 / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(taken, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop(bucket, map_)


def bitmap_of(keys: DataFrame, key: Column, bits: int = BITS) -> bytes:
    """The bitmap_table as one byte string on the driver."""
    rows = bitmap_table(keys, key, bits).collect()
    out = bytearray(bits // 8)
    for r in rows:
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = r.bits
    return bytes(out)


def maybe_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among those of the map: never false for one that is."""
    place = keys.astype(np.int64) & (8 * len(bitmap) - 1)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
