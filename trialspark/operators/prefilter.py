"""A bitmap of ids, by which rows that surely have none of them stay out of a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: at most 2 MB are broadcast, whatever the number of ids.
BITS = 1 << 24
_BUCKET_BITS = 32768  # of Spark's bitmap functions


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(BITS))


def split_by_ids(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(maybe, surely_not): rows of df whose key may be among ids (one column, same name), and those whose key is not. Nothing
    is shuffled but the ids. With very many ids the bitmap fills up and maybe grows towards df; the split stays right."""
    at = _place(F.col(key))
    bits = ids.where(F.col(key).isNotNull()).select(F.floor(_place(F.col(key)) / _BUCKET_BITS).alias("_bucket"), (_place(F.col(key)) % _BUCKET_BITS).alias("_bit")).distinct()
    maps = bits.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    marked = df.withColumn("_bucket", F.floor(at / _BUCKET_BITS)).join(F.broadcast(maps), "_bucket", "left")  # BITS / 8 bytes at most
    bit = at % _BUCKET_BITS
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2) == 1, F.lit(False))
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)
