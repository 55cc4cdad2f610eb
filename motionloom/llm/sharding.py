"""Sharding by a two-pass external shuffle: scatter records uniformly into memory-sized buckets by a
seeded hash, then Fisher-Yates shuffle each bucket and write it.

The buckets, one after another, are a random order of all records; record number g of it goes to
shard g mod `shards` as number g div `shards`. So the law is `rows`: counts of shards differ by one
at most. The number of buckets is the larger of bytes / `bucket_bytes` and eight for each shuffle
partition, so a bucket fits in memory at any size and no task has many more than others. Bucket and
order depend on the seed and a record's whole content alone, never on where it was read: reruns agree.

Repeats of one record share a bucket, where any order of them is the same, as long as they fill no more
than an eighth of one. Beyond that each task puts its repeats together, one record and their number go
on, and every repeat is scattered by its own number. So a record that a third of all rows repeat fills
no bucket and no task.

Every bucket is written as it leaves its task, into the folder of each shard, and read_shards() reads it back; the one
table that is ordered in one task has a row for each bucket (three million at 100 TB).

Defined results. A null text has size 0 + 1 and crc32 0; null doc_ids scatter by what else the record holds. Equal
texts are different records, and rows repeated whole too: each gets a slot of its own. An empty table
gives no rows. Other columns are carried whatever their names (repeated names and names with dots, too);
a shard or slot column of the input is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, identity, load, numbered, partitions, pick, place, repeated

BUCKET_BYTES = 32 << 20


def _shuffle(seed: int, shards: int, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        # the rows arrive in any order, so they are put in one first
        order = np.lexsort((table["_b"].to_numpy(), table["_a"].to_numpy()))
        rng = np.random.Generator(np.random.PCG64([seed, table["_bucket"][0].as_py()]))
        rng.shuffle(order)  # Fisher-Yates
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        at += table["_before"][0].as_py()
        cols = [table[c] for c in table.column_names[4:]]
        cols += [pa.array(at % shards, pa.int32()), pa.array(at // shards, pa.int64())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def external_shuffle(docs: DataFrame, shards: int = 16, seed: int = 3, bucket_bytes: int = BUCKET_BYTES, scratch: Scratch | None = None) -> DataFrame:
    """docs with shard (int) and slot (long) of each row."""
    spark, text = docs.sparkSession, f"_{place(docs, 'text')}"
    scratch = scratch or Scratch(spark, "shards")
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in ("shard", "slot")]
    rows = numbered(docs).select(*(f"_{i}" for i in kept))
    cols = rows.columns
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    a, b = identity(rows)
    rows = rows.select(a.alias("_a"), b.alias("_b"), *cols)
    total = rows.agg(F.sum(size)).first()[0] or 0
    buckets = max(-(-total // bucket_bytes), 8 * partitions(spark))
    parts = max(-(-total // (4 * bucket_bytes)), partitions(spark))
    # records whose repeats fill more than an eighth of a bucket
    hot = rows.groupBy("_a", "_b").agg(F.count("*").alias("n"), F.max(size).alias("size")).where(F.col("n") * F.col("size") > bucket_bytes // 8)
    hot = scratch.cut(hot.select("_a", "_b"), "hot")
    bucket = lambda nth: F.pmod(F.xxhash64(F.lit(seed), "_a", "_b", nth), F.lit(buckets)).alias("_bucket")
    dealt = rows.select(bucket(F.lit(0).cast("long")), "_a", "_b", *cols)
    if not hot.isEmpty():
        once = rows.join(hot, ["_a", "_b"]).groupBy("_a", "_b").agg(F.first(F.struct(*cols)).alias("row"), F.count("*").alias("n"))
        each = repeated(once, "n").select(bucket(F.col("nth")), "_a", "_b", "row.*")
        dealt = dealt.join(hot, ["_a", "_b"], "left_anti").select(dealt.columns).unionByName(each)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("n"))
    first = scratch.cut(counts.select("_bucket", (F.sum("n").over(W.orderBy("_bucket")) - F.col("n")).alias("_before")), "first")
    dealt = dealt.join(first, "_bucket").select("_bucket", "_a", "_b", "_before", *cols).repartition(parts, "_bucket")
    out = dealt.select(*cols, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    out = dealt.groupBy("_bucket").applyInArrow(_shuffle(seed, shards, to_arrow_schema(out)), out)
    return out.toDF(*(docs.columns[i] for i in kept), "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 3, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the shuffled table as one folder of Parquet for each shard, bucket by bucket without a further
    shuffle, and returns what read_shards() reads back. The folder must not exist, so nothing is overwritten."""
    scratch = Scratch(docs.sparkSession, "shards")
    out = external_shuffle(docs, shards, seed, bucket_bytes, scratch)
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    scratch.only()
    return read_shards(docs.sparkSession, path, out)


def read_shards(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """The written shards; `like` gives columns and types where they are known (an empty table has no files)."""
    if like is None:
        return spark.read.parquet(path)
    schema = like.schema
    back = spark.read.schema(type(schema)([*(f for f in schema if f.name != "shard"), schema["shard"]])).parquet(path)
    return back.toDF(*(f"_{i}" for i in range(len(schema)))).select(*(f"_{i}" for i in range(len(schema) - 2)), f"_{len(schema) - 1}", f"_{len(schema) - 2}").toDF(*schema.names)


def sharded(docs: DataFrame, shards: int = 16, seed: int = 3) -> DataFrame:
    """docs with shard and slot, from shards written to the shared folder. There columns are numbered, so that names
    which Parquet takes for one another do no harm."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = numbered(docs).select(*(f"_{i}" for i, c in enumerate(docs.columns) if c in kept))
    names = ["text" if i == place(docs, "text") else f"_{i}" for i, c in enumerate(docs.columns) if c in kept]
    out = write_shards(rows.toDF(*names), Scratch(docs.sparkSession, "sharded").path("out"), shards, seed)
    return out.toDF(*kept, "shard", "slot")


def op3_shard(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, as written and read back."""
    out = sharded(pick(load(spark, sf_dir, "documents"), "doc_id", "text"), 16)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
