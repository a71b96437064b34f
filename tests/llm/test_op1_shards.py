import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from graphloom.llm import shards
from tests.llm.helpers import DOCS, SMALL, table_dir


def check(rows, m):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    sizes = [len(slots.get(k, [])) for k in range(m)]
    assert max(sizes) - min(sizes) <= 1


def test_query(spark):
    rows = shards.op1_shards(spark, SMALL).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    check(rows, 16)
    for r in rows:
        b = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)


def test_same_result_for_any_layout(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    a = {r.doc_id: (r.shard, r.slot) for r in shards.shard_rows(df, 5, 3).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in shards.shard_rows(df.repartition(7, "lang"), 5, 3).collect()}
    assert a == b
    assert a != {r.doc_id: (r.shard, r.slot) for r in shards.shard_rows(df, 5, 4).collect()}


def test_permutation_of_every_small_n(spark):
    for n in (1, 2, 3, 7, 16, 17, 1000):
        got = [r[0] for r in spark.range(n).select(shards.permute(F.col("id"), n, 9)).collect()]
        assert sorted(got) == list(range(n))


def test_awkward_and_empty(spark, tmp_path):
    rows = shards.op1_shards(spark, table_dir(tmp_path / "a", spark)).collect()
    assert len(rows) == 12
    check(rows, 16)
    empty = shards.op1_shards(spark, table_dir(tmp_path / "b", spark, df=spark.createDataFrame([], DOCS)))
    assert empty.count() == 0


def test_hot_key_and_clashing_columns(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("count"), F.lit("x").alias("size"), F.lit(1).alias("bucket")
    )
    rows = shards.shard_rows(df, 16, 1).collect()
    assert len(rows) == 6000 and Counter(r["count"] for r in rows)[7] == 4000
    check(rows, 16)


def hashed(*values, seed=42):
    """xxhash64 of longs (int) and ints (one-element tuples), one after the other; nulls leave the hash as it is."""
    for v in values:
        if v is not None:
            raw = struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def independent(rows, m, seed):
    """(shard, slot) by row, with numbering, Feistel network and cycle walk written out in plain Python."""
    n = len(rows)
    order = sorted(range(n), key=lambda i: (hashed(*rows[i]) % shards.BUCKETS, hashed(*rows[i]), rows[i]))
    a = next(x for x in range(1, n + 2) if x * x >= n)
    b = -(-n // a)
    assert a * b >= n
    out = {}
    for number, i in enumerate(order):
        y = number
        while True:
            left, right = divmod(y, b)
            for k in range(shards.ROUNDS):
                left = (left + hashed(right, (seed,), (2 * k,)) % a) % a
                right = (right + hashed(left, (seed,), (2 * k + 1,)) % b) % b
            y = left * b + right
            if y < n:
                break
        out[i] = (y % m, y // m)
    return out


def test_against_an_independent_network(spark):
    docs = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = independent(docs, 16, 20240901)
    got = {r.doc_id: (r.shard, r.slot) for r in shards.op1_shards(spark, SMALL).collect()}
    assert got == {docs[i][0]: v for i, v in want.items()}
