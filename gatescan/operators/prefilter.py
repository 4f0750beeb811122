"""A Bloom filter of one table's keys that another table's scan is filtered with, before anything of it is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatescan.storage import stored

#: Bits a key and bits that a key sets (about 1 in 100 other keys pass), and the most bits: 1 MB, which bounds what goes to each task.
#: With more than some 700,000 keys more of the other keys pass, which costs time alone.
BITS_A_KEY, HASHES, MOST_BITS = 12, 4, 1 << 23


def _place(hashed: Column, words: Column) -> Column:
    return F.shiftrightunsigned(hashed, 24).bitwiseAND(words - 1).cast("int")


def _mask(hashed: Column) -> Column:
    """A bit in each quarter of a key's word, so that HASHES of them are set."""
    mask = F.lit(0).cast("long")
    for k in range(HASHES):
        at = F.shiftright(hashed, 4 * k).bitwiseAND(15).cast("int") + 16 * k
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def bloom_filter(keys: DataFrame, key: str) -> Column:
    """The filter of keys, array<long>, as a scalar subquery of a stored row: its words are put together in Spark and stand in no
    plan, so neither plans nor their texts grow with the keys. The driver holds the row, MOST_BITS at most, while a query runs."""
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    size = min(MOST_BITS, 1 << max(10, (n * BITS_A_KEY).bit_length())) // 64
    hashed = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"))
    words = hashed.groupBy(_place(F.col("h"), F.lit(size)).cast("long").alias("word")).agg(F.bit_or(_mask(F.col("h"))).alias("set"))
    every = words.unionByName(keys.sparkSession.range(size).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set")))
    whole = every.groupBy("word").agg(F.bit_or("set").alias("set")).agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("x"))
    return stored(whole.select(F.col("x.set").alias("words")), "filter").scalar()


def might_contain(words: Column, key: Column) -> Column:
    """Whether key may be among the filter's keys: true for each of them, and for few others. A key's bits lie in one word, as each
    time that a plan names the filter, it goes to the tasks once more."""
    hashed = F.xxhash64(key)
    found = F.get(words, _place(hashed, F.size(words).cast("long"))).bitwiseAND(_mask(hashed))
    return F.getbit(F.bit_count(found).cast("long"), F.lit(HASHES.bit_length() - 1)) == 1  # the count is HASHES if all are set
