"""Exact length histogram: documents by encoded length, and suffix sums that answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, table, written
from .tokens import DEFAULT_TOKENIZER, encoder

#: Context limits that are always among the answered lengths.
LIMITS = (0, 128, 256, 512, 1024, 2048, 4096, 8192, 16_384, 32_768, 65_536, 131_072)
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
#: Lengths that share one partial sum.
STRIPE = 1024


def token_lengths(docs: DataFrame, text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """n_tokens of each document; a null or empty text has 0. Texts of any length are encoded whole; other columns are not read."""

    def count(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.record_batch([pa.array([len(ids) // 2 for ids in enc.batch(part.column(0).to_pylist())], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(docs: DataFrame, text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(n_tokens, n_docs): the exact histogram, added up on the map side first."""
    return token_lengths(docs, text, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def context_answers(histogram: DataFrame, limits=LIMITS, quantiles=QUANTILES, stripe: int = STRIPE) -> DataFrame:
    """For each length that occurs and each of `limits`: how many documents and tokens reach it, what a
    cut at that length leaves (`truncated_tokens`) and drops, and which quantiles fall on it.

    An empty histogram gives the limits with zero counts. Suffix sums run inside stripes of lengths and
    over the stripes' totals, so no task holds more than a stripe or the list of stripes.
    """
    spark = histogram.sparkSession
    marks = spark.createDataFrame([(int(x), 0, True) for x in limits], "n_tokens long, n_docs long, is_limit boolean")
    h = histogram.select(F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_docs").cast("long").alias("n_docs"), F.lit(False).alias("is_limit"))
    h = h.unionByName(marks).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"), F.max("is_limit").alias("is_limit"))
    h = h.withColumn("stripe", F.floor(F.col("n_tokens") / stripe)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.desc("stripe"))
    whole = Window.orderBy("stripe").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stripes = (
        h.groupBy("stripe").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "stripe",
            (F.sum("d").over(above) - F.col("d")).alias("docs_above"),
            (F.sum("t").over(above) - F.col("t")).alias("tokens_above"),
            F.sum("d").over(whole).alias("docs_total"),
            F.sum("t").over(whole).alias("tokens_total"),
        )
    )
    inside = Window.partitionBy("stripe").orderBy(F.desc("n_tokens"))
    out = (
        h.join(stripes, "stripe")
        .withColumn("docs_ge", F.sum("n_docs").over(inside) + F.col("docs_above"))
        .withColumn("tokens_ge", F.sum("tokens").over(inside) + F.col("tokens_above"))
        .withColumn("truncated_tokens", F.col("tokens_total") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge"))
        .withColumn("docs_below", F.col("docs_total") - F.col("docs_ge"))
    )
    # the q-quantile is the least length that at least q of all documents don't exceed
    at = [
        F.when((F.col("docs_below") < q * F.col("docs_total")) & (F.col("docs_below") + F.col("n_docs") >= q * F.col("docs_total")), F.lit(float(q)))
        for q in quantiles
    ]
    return out.select(
        "n_tokens", "n_docs", "is_limit", "docs_ge", "tokens_ge", "docs_total", "tokens_total", "truncated_tokens",
        (F.col("tokens_total") - F.col("truncated_tokens")).alias("dropped_tokens"),
        F.array_compact(F.array(*at)).alias("quantiles") if at else F.array().cast("array<double>").alias("quantiles"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a few thousand rows, read twice
    return context_answers(written(length_histogram(table(spark, sf_dir, "documents")), "lengths"))
