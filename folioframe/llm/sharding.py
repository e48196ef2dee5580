"""Shards of bounded size by extendible hashing.

A row's place is the sha-256 prefix of its key. Buckets are hash prefixes; a bucket over
the limit is split on its next bit, others stay, so the leaves are the smallest prefixes
that fit. Sizes of all prefixes down to a depth come from one aggregation over (prefix,
bytes), pre-aggregated before its shuffle; only rows of buckets that are still too large at
that depth are read again, some bits deeper. No text is moved, and what is known of a
bucket is its sum alone.

Defined results: a null text has 0 bytes; a null key is a key of its own; an empty table
has no shards; rows that repeat a key lie together, and where they, or one row alone,
exceed the limit, their bucket is split to the last bit and marked oversized; columns other
than the key and the text are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import pinned

BITS = 60
#: Bits that a round looks ahead of the depth that even buckets would need, and rounds after the first add.
AHEAD, DEEPER = 3, 8


def placed(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, h, bytes) of every row."""
    digest = F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256)
    return documents.select(key, F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("h"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("bytes"))


def _prefix(depth: int):
    return F.shiftright("h", BITS - depth)


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_docs, oversized): one row per shard."""
    total = rows.agg(F.sum("bytes")).first()[0]
    spark = rows.sparkSession
    if total is None:
        return spark.createDataFrame([], "depth int, prefix long, shard_bytes long, shard_docs long, oversized boolean")
    top, found, alive = 0, [], rows
    depth = min(BITS, max(0, ceil(log2(max(1, total / max_bytes)))) + AHEAD)
    while True:
        fine = alive.groupBy(_prefix(depth).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        levels = fine.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "prefix", "bytes", "docs")
        levels = levels.groupBy("depth", F.expr(f"shiftright(prefix, {depth} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        levels = pinned(levels)
        above = levels.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("shard_bytes").alias("up_bytes"))
        nodes = levels.withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left")
        # The top level of a later round is only there because it is too large.
        parent_full = F.coalesce(F.col("up_bytes") > max_bytes, F.lit(top == 0) & (F.col("depth") == top))
        last = depth == BITS
        fits = F.col("shard_bytes") <= max_bytes
        found.append(nodes.where(parent_full & ((fits | (F.col("depth") == BITS)) if last else fits)).select("depth", "prefix", "shard_bytes", "shard_docs", (~fits).alias("oversized")))
        full = pinned(levels.where((F.col("depth") == depth) & ~fits).select(F.col("prefix").alias("full")))
        if last or not full.limit(1).count():
            break
        alive = alive.join(full, _prefix(depth) == F.col("full"), "left_semi")
        top, depth = depth, min(BITS, depth + DEEPER)
    return pinned(reduce(DataFrame.unionByName, found))


def shards(documents: DataFrame, max_bytes: int, key: str = "doc_id") -> DataFrame:
    """(key, bytes, shard, depth, shard_bytes, shard_docs, oversized) of every row; shard is the prefix in bits."""
    rows = placed(documents, key)
    leaves = directory(rows, max_bytes)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect())  # at most BITS + 1
    if not depths:
        depths = [0]
    looks = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths)))
    out = rows.select(key, "bytes", looks.alias("x")).select(key, "bytes", "x.depth", "x.prefix").join(leaves, ["depth", "prefix"])
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select(key, "bytes", bits.alias("shard"), "depth", "shard_bytes", "shard_docs", "oversized")
