"""Incremental scans: a file stream, and batches that update a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lintlake.operators.changes import upsert
from lintlake.operators.findings import LineRule, scan_lines


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of document tables as they arrive."""
    return spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(path).select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content")
    )


def scan_stream(sources: DataFrame, rules: list[LineRule], findings_path: str, checkpoint: str) -> StreamingQuery:
    """Findings of all that has arrived, appended."""
    return scan_lines(sources, rules).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(findings_path)


def manifest_stream(sources: DataFrame, manifest: str, checkpoint: str) -> StreamingQuery:
    """Keeps (path, hash) of the newest content of each path, a version of the table for each batch."""

    def update(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("path").agg(F.max(F.substring(F.sha2("content", 256), 1, 16)).alias("hash"))
        merged = upsert(spark.read.parquet(f"{manifest}/{n - 1}"), new, "path") if n else new
        merged.write.mode("overwrite").parquet(f"{manifest}/{n}")

    return sources.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MANIFEST = "path string, hash string, bucket int, version long"
BUCKETS = 64


def load_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """(path, hash, bucket) as of now: of each bucket its newest version."""
    rows = spark.read.schema(MANIFEST).parquet(manifest)
    # a few versions a bucket; as partitions they are read from the folders' names
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["bucket", "version"]).select("path", "hash", "bucket")


def tree_digest(manifest_rows: DataFrame) -> DataFrame:
    """(digest, n_files): one digest of all paths and hashes, whatever their order: of buckets first, then of these."""
    each = manifest_rows.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "path", "hash"))), "|"), 256).alias("d"), F.count("*").alias("n"))
    return each.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("bucket").cast("string"), "d"))), "|"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def manifest_buckets(sources: DataFrame, manifest: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps (path, hash) of the newest content of each path in buckets by hash of the path. A batch reads and writes only the buckets that
    its paths fall in, each as a new version, so what it costs follows the batch and not the project. A batch that runs
    again writes the same rows again; the state is the table, so a new checkpoint goes on where the table stands."""
    sources.sparkSession.createDataFrame([], MANIFEST).write.mode("append").partitionBy("bucket", "version").parquet(manifest)

    def update(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("path").agg(F.max(F.substring(F.sha2("content", 256), 1, 16)).alias("hash")).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets
        if not touched:
            return
        version = (spark.read.schema(MANIFEST).parquet(manifest).agg(F.max("version")).first()[0] or 0) + 1
        held = load_manifest(spark, manifest).filter(F.col("bucket").isin(touched))
        merged = held.join(new.select("path"), "path", "left_anti").select("path", "hash", "bucket").unionByName(new.select("path", "hash", "bucket"))
        merged.withColumn("version", F.lit(version).cast("long")).repartition("bucket").write.mode("append").partitionBy("bucket", "version").parquet(manifest)

    return sources.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
