"""Operator 1: sharding by a Feistel permutation of global row numbers.

Rows get global numbers 0..N-1 in content order (hash of the key columns, then the key columns), so the numbering does
not depend on files, splits or partitions. A Feistel network over Z_a x Z_b with a*b >= N permutes the numbers; walking
the cycle until the value is below N keeps it a permutation of 0..N-1. Shard = value mod shards, slot = value div shards,
so shard sizes differ by at most one row and slots have no gaps. Everything is built from Spark SQL functions.

Nulls in key columns take part as values of their own; rows with equal keys are interchangeable and get distinct numbers;
an empty table gives an empty result; the caller's columns are kept and may have any names but those starting with "__".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm.common import materialise, text_of

#: Numbering buckets. Their sizes, and those of the chunks of hot keys, are all that is broadcast.
BUCKETS = 4096
#: A key with more than N / HOT_SHARE rows is hot, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 256
#: Chunks in which the interchangeable rows of a hot key are numbered.
CHUNKS = 64
ROUNDS = 4
#: Most steps of the cycle walk. The domain exceeds N by fewer than sqrt(N)+1 values, so 64 steps always suffice up to
#: N = 3,900, and beyond fail with a probability under N**-31 (raise_error then, never a wrong slot).
WALK = 64


def number_rows(df: DataFrame, keys: list[str], into: str = "__row") -> DataFrame:
    """Add the global row number in content order.

    Buckets are hash ranges of the key, numbered locally; a key that holds a large part of the rows is spread over
    CHUNKS units. Only the unit sizes (at most BUCKETS + HOT_SHARE * CHUNKS rows) are put in one place.
    """
    n = df.count()
    h = F.xxhash64(*keys)
    rows = df.withColumn("__h", h).withColumn("__at", F.monotonically_increasing_id())
    hot = rows.groupBy("__h").count().filter(F.col("count") > max(n // HOT_SHARE, 1000)).select(F.col("__h").alias("__hot"))
    rows = rows.join(F.broadcast(hot), F.col("__h") == F.col("__hot"), "left")
    rows = rows.withColumn("__bucket", F.pmod("__h", F.lit(BUCKETS).cast("long"))).withColumn(
        "__chunk", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("__at"), F.lit(CHUNKS).cast("long")))
    ).withColumn("__hot", F.coalesce("__hot", F.lit(0)))
    unit = ["__bucket", "__hot", "__chunk"]
    before = F.sum("__n").over(Window.orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*unit).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(*unit).orderBy("__h", *keys))
    return (
        rows.withColumn("__local", local)
        .join(F.broadcast(offsets), unit)
        .withColumn(into, F.col("__before") + F.col("__local") - 1)
        .drop("__h", "__at", "__local", "__before", *unit)
    )


def _sides(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def _feistel(x: Column, n: int, seed: int) -> Column:
    a, b = (F.lit(v).cast("long") for v in _sides(n))
    left, right = F.call_function("div", x, b), F.pmod(x, b)
    for k in range(ROUNDS):
        left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(2 * k)), a), a)
        right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(2 * k + 1)), b), b)
    return left * b + right


def permute(x: Column, n: int, seed: int) -> Column:
    """The image of row number x under the seeded permutation of 0..n-1."""
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), _feistel(x, n, seed), lambda y, _: F.when(y < n, y).otherwise(_feistel(y, n, seed))
    )
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long"))


def shard_rows(df: DataFrame, shards: int, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """df with `shard` (0..shards-1) and `slot` (0.. without gaps in each shard).

    keys: the columns that give rows their content order, all of them by default.
    """
    n = df.count()
    rows = number_rows(df, keys or df.columns)
    rows = rows.withColumn("__to", permute(F.col("__row"), n, seed))
    m = F.lit(shards).cast("long")
    return rows.withColumn("shard", F.pmod("__to", m).cast("int")).withColumn("slot", F.call_function("div", F.col("__to"), m)).drop("__row", "__to")


def op1_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = text_of().cast("binary")
    narrow = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = shard_rows(materialise(narrow), shards=16, seed=20240901)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
