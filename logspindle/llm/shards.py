"""Sharding by extendible hashing under a byte limit."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, spare

#: Bytes of text that a shard may hold.
LIMIT = 2 << 20
#: Bits of the hash; prefixes grow up to it.
BITS = 52
#: Bits that each further look at oversized prefixes adds.
STEP = 6


def _hash(key):
    """The first 52 bits of the key's md5 (52 fit a signed long and a double alike)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(h, depth: int):
    return F.shiftrightunsigned(h, BITS - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The buckets of ``rows`` (h long, n_bytes long): depth int, prefix long (its first ``depth`` bits), shard_bytes long.

    A bucket splits on one more bit only while it holds more than ``limit`` bytes. Byte counts are taken at a
    depth that the total size suggests and summed upwards; only prefixes that are still too large there are
    counted again, deeper. Only counts come to the driver. Buckets at the last bit may exceed the limit: they hold
    one hash value, which no bit can divide.
    """
    total = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    low, out, rest = 0, None, rows
    high = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 4))
    while True:
        fine = rest.groupBy(_prefix(F.col("h"), high).alias("p")).agg(F.sum("n_bytes").alias("n"))
        levels = F.explode(F.sequence(F.lit(low), F.lit(high)))
        each = fine.select("p", "n", levels.alias("depth")).withColumn("prefix", F.expr(f"shiftrightunsigned(p, {high} - depth)"))
        sums = settle(each.groupBy("depth", "prefix").agg(F.sum("n").alias("n")))
        parent = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("n").alias("up_n"))
        sums = sums.withColumn("up", F.shiftrightunsigned("prefix", 1)).join(parent, ["depth", "up"], "left")
        mine = sums.where(((F.col("n") <= limit) | (F.col("depth") == BITS)) & (F.col("up_n").isNull() | (F.col("up_n") > limit)))
        mine = mine.where((F.col("depth") > low) | F.lit(low == 0)).select("depth", "prefix", F.col("n").alias("shard_bytes"))
        out = mine if out is None else out.unionByName(mine)
        large = sums.where((F.col("depth") == high) & (F.col("n") > limit)).select(F.col("prefix").alias("q"))
        if high == BITS or large.limit(1).count() == 0:
            return out
        rest = rest.join(large, _prefix(F.col("h"), high) == F.col("q"), "left_semi")
        low, high = high, min(BITS, high + STEP)


def shard(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with shard_id string, shard_depth int, shard_bytes long and n_bytes long.

    The shard of a row is the bucket whose bits begin its key's hash; shard_id writes those bits (empty: all
    rows fit one shard). n_bytes counts the text as UTF-8 (null: 0). Rows with one key can't be split by
    hash bits; where they alone exceed the limit, the rows of each input partition are dealt over numbered parts
    of the bucket (``bits.partition.part``), each within the limit unless it is one row that alone exceeds it. Which part a row of such a key gets
    follows the input's partitions. Null keys hash as the empty string. Columns of those four names are replaced; other columns pass, whatever their names.
    """
    names = ("shard_id", "shard_depth", "shard_bytes", "n_bytes")
    docs = docs.drop(*names)
    origin, order, h, k, prefix, piece = (spare(docs, f"__{x}") for x in ("from", "order", "h", "k", "prefix", "part"))
    base = docs.withColumn(origin, F.spark_partition_id()).withColumn(h, _hash(F.col(key_col))).withColumn("n_bytes", F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).withColumn(order, F.xxhash64(text_col))
    dirs = settle(directory(base.select(F.col(h).alias("h"), "n_bytes"), limit))
    depths = [r["depth"] for r in dirs.select("depth").distinct().collect()]  # at most BITS + 1 rows
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("h"), d).alias("prefix")) for d in sorted(depths)] or [F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))]))
    keys = base.select(F.col(h).alias("h")).distinct().withColumn("t", tries).select("h", "t.depth", "t.prefix")
    found = keys.join(dirs, ["depth", "prefix"]).select(F.col("h").alias(k), F.col("depth").alias("shard_depth"), F.col("prefix").alias(prefix), "shard_bytes")
    bits = F.when(F.col("shard_depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(prefix), 10, 2), F.col("shard_depth"), F.lit("0")))
    rows = base.join(found, F.col(h) == F.col(k), "left").withColumn("shard_id", bits)
    whole = rows.where(F.col("shard_bytes") <= limit)
    over = rows.where(F.col("shard_bytes") > limit)
    # what is left is one repeated key: cut its running byte count; a row that crosses a limit opens the next part
    w = Window.partitionBy("shard_id", origin).orderBy("n_bytes", order)
    before = F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1))
    half = max(1, limit // 2)
    part = F.when(F.col("n_bytes") > half, F.row_number().over(w) + F.lit(1 << 40)).otherwise(F.floor(F.coalesce(before, F.lit(0)) / F.lit(half)))
    over = over.withColumn(piece, part).withColumn("shard_id", F.concat_ws(".", "shard_id", F.col(origin).cast("string"), F.col(piece).cast("string")))
    over = over.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard_id"))).drop(piece)
    return whole.unionByName(over).drop(h, k, origin, order, prefix)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One directory of Parquet for each shard."""
    sharded.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select("doc_id", "n_bytes", "shard_id", F.col("shard_depth").cast("int").alias("shard_depth"), "shard_bytes")


SQL = f"""
WITH h AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
e AS (SELECT *, h >> ({BITS} - depth) AS prefix FROM h, (SELECT unnest(range(0, 21))::INT AS depth)),
s AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, prefix) AS total FROM e)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard_id,
       depth AS shard_depth, total::BIGINT AS shard_bytes
FROM s WHERE total <= {LIMIT} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
