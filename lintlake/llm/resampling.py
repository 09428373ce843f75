"""Importance resampling towards a target distribution, with a dictionary of distinct features.

The n-gram strings of corpus and target are counted, each distinct string is hashed once, its counts are added up
by bucket, and the bucket's gain is joined back to the string and from there to the documents' own counts of it.
Strings that make up a fixed share of the corpus (there can only be so many) are joined by broadcast, so no key
of the shuffled join can be hot.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, join_small_or_shuffled, quoted, slices, small_batches, table, with_fields, written

RUN = 1
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Longer strings are never broadcast, so a dictionary of BROADCAST_ROWS strings stays under 6 MB.
BROADCAST_BYTES = 256
#: Different strings that a task counts before it sends them on, and bytes of these.
COUNTED, COUNTED_BYTES = 200_000, 32 << 20

_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def features(text: str | None, longest: int) -> tuple[list[bytes], int]:
    """(runs of 1 to `longest` words joined by one space, number of words). A-Z are lower-cased; a word is a run of
    digits, a-z and letters beyond ASCII."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()
    runs = list(words)
    for k in range(2, longest + 1):
        runs += map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return runs, len(words)


def _strings(column: list[bytes]) -> pa.Array:
    return pa.array(column, pa.binary()).cast(pa.string())


def feature_counts(docs: DataFrame, text: str = "text", longest: int = RUN) -> DataFrame:
    """How often each feature occurs in all texts: (feature, n). Null, empty and blank texts have none. Tasks add up
    before the shuffle; what one holds is bounded in strings and in bytes."""

    def run(batches):
        seen, size = Counter(), 0
        for batch in batches:
            for part in slices(batch, 0):
                new = Counter()
                for t in part.column(0).to_pylist():
                    new.update(features(t, longest)[0])
                size += sum(map(len, new.keys() - seen.keys()))
                seen.update(new)
                if len(seen) >= COUNTED or size >= COUNTED_BYTES:
                    yield pa.record_batch([_strings(list(seen)), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])
                    seen, size = Counter(), 0
        if seen:
            yield pa.record_batch([_strings(list(seen)), pa.array(list(seen.values()), pa.int64())], ["feature", "n"])

    return docs.select(F.col(quoted(text)).cast("string").alias("t")).mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = RUN, buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """(feature, n, bucket, gain) for each distinct feature of `docs`, and how many features these hold together.

    A bucket's gain is floor(1000 * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) with s of S features of the
    corpus and t of T of the target in it. Without a corpus the dictionary is empty; an empty target is T = 0.
    """
    bucket = F.crc32(F.col("feature").cast("binary")) % buckets
    ours = written(feature_counts(docs, text, longest).withColumn("bucket", bucket.cast("int")), "features")
    s = ours.groupBy("bucket").agg(F.sum("n").alias("s"))
    t = feature_counts(target, target_text, longest).groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("t"))
    both = written(s.join(t, "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")), "buckets")  # a row a bucket at most
    in_corpus = both.agg(F.sum("s")).first()[0] or 0
    in_target = t.agg(F.sum("t")).first()[0] or 0
    d = lambda x: x.cast("double")
    odds = d((F.col("t") + 1) * F.lit(in_corpus + buckets)) / d((F.col("s") + 1) * F.lit(in_target + buckets))
    gains = both.select("bucket", F.floor(F.lit(1000.0) * F.log(odds)).cast("long").alias("gain"))
    return ours.join(F.broadcast(gains) if buckets <= BROADCAST_ROWS else gains, "bucket").select("feature", "n", "bucket", "gain"), in_corpus


def weights(
    docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", carry: list[str] | None = None, longest: int = RUN, buckets: int = BUCKETS,
) -> DataFrame:
    """`row`, the columns `carry` of `docs` (all by default) as a struct, `at` (a number of the row), `n_words`,
    `n_features` and `weight`, the sum of the gains of all its features.

    Any columns may be there, whatever they are called; equal rows and equal ids are weighed apart. A text without
    words, or null, has no features and weight 0; an empty table stays empty. A long text is counted alone.
    """
    small_batches(docs.sparkSession)
    gains, total = dictionary(docs, target, text, target_text, longest, buckets)
    gains = written(gains.select("feature", "n", "gain"), "gains")
    often = -(-total // BROADCAST_ROWS)  # at most BROADCAST_ROWS strings can occur so often
    frequent = (F.col("n") >= often) & (F.octet_length("feature") <= BROADCAST_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast({r["feature"].encode(): r["gain"] for r in gains.where(frequent).select("feature", "gain").collect()})

    def run(batches):
        gain = shared.value
        for batch in batches:
            for part in slices(batch, 1):
                n_words, n_features, weight, ends, rest, counts = [], [], [], [0], [], []
                for t in part.column(1).to_pylist():
                    runs, words = features(t, longest)
                    own = 0
                    for f, n in Counter(runs).items():
                        if (g := gain.get(f)) is None:
                            rest.append(f)
                            counts.append(n)
                        else:
                            own += g * n
                    n_words.append(words)
                    n_features.append(len(runs))
                    weight.append(own)
                    ends.append(len(rest))
                others = pa.StructArray.from_arrays([_strings(rest), pa.array(counts, pa.int64())], ["feature", "n"])
                yield pa.record_batch(
                    [part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), others)],
                    ["row", "n_words", "n_features", "weight", "rest"],
                )

    rows = docs.select(F.struct(*[F.col(quoted(n)) for n in (docs.columns if carry is None else carry)]).alias("row"), F.col(quoted(text)).cast("string").alias("t"))
    schema = with_fields([rows.schema["row"], *StructType.fromDDL("n_words long, n_features long, weight long, rest array<struct<feature: string, n: long>>")])
    counted = written(rows.mapInArrow(run, schema).withColumn("at", F.monotonically_increasing_id()), "weights")
    others = counted.select("at", F.explode("rest").alias("r")).select("at", "r.feature", F.col("r.n").alias("times"))
    joined = others.join(gains.where(~frequent).select("feature", "gain").hint("merge"), "feature").groupBy("at").agg(F.sum(F.col("times") * F.col("gain")).alias("more"))
    return counted.drop("rest").join(joined.hint("merge"), "at", "left").select("row", "at", "n_words", "n_features", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id alone; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(weighted: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """`score` and `rank` beside the columns of `weights`. Of the N rows with `least_words` words or more, the
    floor(percent * N / 100) of highest score are drawn; `rank` numbers them from 1 and is null for the rest.

    Equal scores go by the smaller id (null ids last), then by place. Rows are dealt by ranges of score and sorted there;
    a rank is a row's place in its range after the sizes of the ranges before, so no task sorts all rows.
    """
    key = F.col("row").getField(doc_id)
    scored = weighted.withColumn("score", F.col("weight") + noise(key, seed))
    order = [F.desc("score"), key.asc_nulls_last(), F.asc("at")]
    parts = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = F.col("n_words") >= least_words
    # those that can't be drawn come last, dealt by the same ranges
    ranged = written(scored.repartitionByRange(parts, F.desc(fit), *order).sortWithinPartitions(F.desc(fit), *order).withColumn("place", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("range", F.shiftright("place", 33).cast("int"))
    sizes = ranged.where(fit).groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
    drawn = (sizes.agg(F.sum("n")).first()[0] or 0) * percent // 100
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    numbered = join_small_or_shuffled(ranged, before, "range", "left")
    return numbered.select("row", "n_words", "n_features", "weight", "score", F.when(fit & (rank <= drawn), rank).alias("rank"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards `benchmark`, and its rank if it was drawn."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(weights(docs, target, carry=["doc_id"])).select("row.doc_id", "n_features", "weight", "score", "rank")
