"""Extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split.

Rows are counted once in cells of a fine prefix; coarser prefixes are sums of cells. A row's shard is the
shortest prefix of its hash whose bytes fit the limit, so a bucket splits on another bit only while it is
oversized. Cells that are still oversized are refined again by more bits; rows that no bit can part (the
same row, repeated) go to overflow shards by their running size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small_or_shuffled, quoted, shared_dir, table, written

SHARD_BYTES = 16 << 20
#: Bits of the first fine prefix, bits that a further round adds, and bits of a hash.
FIRST_BITS, ROUND_BITS, HASH_BITS = 12, 8, 60
#: Bytes that a row's fixed-width columns take, about.
FIXED_BYTES = 16


def hash_of(*keys: str) -> F.Column:
    """The first 60 bits of an md5 over the keys; a null differs from an empty string."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(quoted(k)).cast("string")), F.lit("-")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: int | str) -> F.Column:
    """The first bits of the hash; `bits` is a number or a column's name."""
    return F.expr(f"shiftrightunsigned(hash, {HASH_BITS} - {bits})")


def _directory(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell of `high` bits: the fewest bits from `low` on at which its bucket fits; null if none does.

    A bucket of this round has at most 2 ** (high - low) cells."""
    bucket = F.expr(f"shiftrightunsigned(cell, {high} - bits)")
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("bits"))
    sized = levels.withColumn("size", F.sum("bytes").over(Window.partitionBy("bits", bucket)))
    return sized.groupBy("cell").agg(F.min(F.when(F.col("size") <= limit, F.col("bits"))).alias("depth"))


def _pages(rest: DataFrame, size: str, limit: int) -> DataFrame:
    """Rows of equal hash, which no bit can part, in pages: each task fills pages of its own. A page ends before the
    row that would take it over the limit; a row over the limit has a page of its own.

    Sizes are first rounded up to a power of two: rows of one such class fill a page by count, so a page's number is its
    row's place over the count, and no running sum has to be broken."""
    n = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col(size), F.lit(1))))), F.lit(limit)).cast("long")
    placed = rest.withColumn("salt", F.spark_partition_id()).withColumn("class", F.when(F.col(size) > 0, n).otherwise(F.lit(1)).cast("long")).withColumn("tie", F.monotonically_increasing_id())
    # the largest row of a class says how many of its rows fit a page
    group = Window.partitionBy("hash", "salt", "class")
    place = F.row_number().over(group.orderBy("tie")) - 1
    page = F.floor(place / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.max(size).over(group), F.lit(1)))))
    numbered = placed.withColumn("page", page)
    first = numbered.select("*", F.dense_rank().over(Window.partitionBy("hash", "salt").orderBy("class", "page")).alias("number"))
    return first.withColumn("overflow", F.col("salt").cast("long") * (1 << 32) + F.col("number")).drop("salt", "class", "tie", "page", "number")


def assign_shards(rows: DataFrame, size: str, keys: list[str], limit: int = SHARD_BYTES, first_bits: int = FIRST_BITS, round_bits: int = ROUND_BITS) -> DataFrame:
    """Adds `depth` (bits of the shard's prefix), `shard` (those bits as text) and `overflow` (0, or the number of
    the page for rows that no bit can part).

    `size` is a column of bytes (null: 0) and `keys` are the hashed columns; nulls hash like any value, equal rows
    go together. No shard or page exceeds `limit`, but for a single row that does, which has one of its own. An empty
    table gives an empty table. Columns of the three names are replaced, all others stay, whatever they are called;
    nulls in `size` become 0. `rows` is read twice, the first time only `size` and `keys`; what no prefix of a round
    parts is written in between.
    """
    names = [c for c in rows.columns if c not in ("depth", "shard", "overflow")]
    n_bytes = F.coalesce(F.col(quoted(size)), F.lit(0)).cast("long")
    left = rows.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"), hash_of(*keys).alias("hash"), n_bytes.alias("bytes"))
    out, low, high = None, 0, min(first_bits, HASH_BITS)
    while True:
        cells = left.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"))
        found = written(_directory(cells, low, high, limit), "directory")
        placed = join_small_or_shuffled(left.withColumn("cell", _prefix(high)), found, "cell", "inner").drop("cell")
        done = placed.filter("depth is not null").withColumn("overflow", F.lit(0).cast("long"))
        out = done if out is None else out.unionByName(done)
        rest = placed.filter("depth is null").drop("depth")
        if found.filter("depth is null").limit(1).count() == 0:
            break
        if high == HASH_BITS:
            pages = _pages(written(rest, "inseparable"), "bytes", limit).withColumn("depth", F.lit(HASH_BITS))
            out = out.unionByName(pages.select(*out.columns))
            break
        left, low, high = written(rest, "oversized"), high + 1, min(HASH_BITS, high + round_bits)
    bits = F.lpad(F.conv(_prefix("depth").cast("string"), 10, 2), F.col("depth"), "0")
    kept = ((F.col("bytes") if c == size else F.col("row").getField(c)).alias(c) for c in names)
    return out.select(*kept, "depth", "overflow", F.when(F.col("depth") == 0, F.lit("")).otherwise(bits).alias("shard"))


def shard_sizes(assigned: DataFrame, size: str) -> DataFrame:
    """(shard, depth, overflow, shard_rows, shard_bytes)"""
    return assigned.groupBy("shard", "depth", "overflow").agg(F.count("*").alias("shard_rows"), F.sum(size).alias("shard_bytes"))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder a shard, with every row of it. `rows` carries the columns of `assign_shards`; a shard is bounded, so
    one task can write it."""
    rows.repartition("shard", "overflow").sortWithinPartitions("shard", "overflow").write.option("compression", "zstd").partitionBy("shard", "depth", "overflow").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The written rows with the shard that each lies in."""
    return spark.read.schema(schema).parquet(path).withColumn("shard", F.coalesce("shard", F.lit("")))  # an empty folder name reads as null


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents in shards of at most SHARD_BYTES and reads back where each lies and how full its shard is."""
    docs = table(spark, sf_dir, "documents")
    text_bytes = sum((F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in docs.schema if isinstance(f.dataType, T.StringType)), F.lit(FIXED_BYTES)).cast("long")
    keyed = docs.withColumn("content", F.md5(F.coalesce("text", F.lit("")))).withColumn("row_bytes", text_bytes)
    sharded = assign_shards(keyed, "row_bytes", ["doc_id", "content"])
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path)
    back = read_shards(spark, path, sharded.schema)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = back.select("doc_id", n_bytes.alias("n_bytes"), "row_bytes", "shard", "depth", "overflow")
    return join_small_or_shuffled(rows, shard_sizes(rows, "row_bytes"), ["shard", "depth", "overflow"], "inner").select(
        "doc_id", "n_bytes", "row_bytes", "shard", "depth", "overflow", "shard_rows", "shard_bytes"
    )
