"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document is measured and judged by rules. Failures are added up by host (the document's source),
each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts, and the
hosts' verdicts are joined back: on a bad host a document that fails one soft rule goes, elsewhere it
takes two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, join_small_or_shuffled, table, written

#: Fixed values of the base rules.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Soft rules: symbols a word, share of duplicate lines, and mean word length.
MAX_SYMBOLS_A_WORD = 0.1
MAX_DUP_LINES = 0.3
WORD_LENGTH = (2.0, 15.0)
#: A host is bad if its shrunk rate of documents that fail any rule is above this.
MAX_HOST_RATE = 0.5


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window that the text holds twice or more.

    The hashes of all windows are sorted with their places; equal neighbours are repeats. Sorting keeps it
    at n log n for a text of any length.
    """
    windows = lambda w: F.filter(
        F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))), lambda s: s["i"] < F.size(w) - 2
    )
    repeated = lambda s: F.sort_array(
        F.transform(
            F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))), lambda x: x["i"]
        )
    )
    covered = lambda p: F.aggregate(  # noqa: E731  places in order: each adds what the one before has not covered
        p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"]
    )
    return bind(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(bind(F.sort_array(windows(w)), lambda s: bind(repeated(s), covered))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `docs` and a struct `m` of the text's measures. A null text measures as an empty one."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return docs.withColumn(
        "m",
        bind(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
                (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                bind(lines, lambda x: F.size(x).cast("long")).alias("n_lines"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ),
    )


def judge(measured: DataFrame) -> DataFrame:
    """Adds `base_failed` and `soft_failures` from the measures `m`."""
    m = lambda n: F.col(f"m.{n}")
    some = F.greatest(m("n_words"), F.lit(1))
    soft = [
        m("n_symbols") > MAX_SYMBOLS_A_WORD * m("n_words"),
        m("n_dup_lines") > MAX_DUP_LINES * m("n_lines"),
        ~(m("word_chars") / some).between(*WORD_LENGTH),
    ]
    return measured.withColumn("base_failed", (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEAT_PERCENT * m("n_words"))).withColumn(
        "soft_failures", sum((x.cast("int") for x in soft), F.lit(0))
    )


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row a host: documents, failures and the rate shrunk by a beta prior.

    The prior has the hosts' mean rate, weighted by documents, and the strength that the spread of their rates
    beyond chance gives (moments of the beta-binomial distribution). Null is a host like any other. A hot host
    is added up on the map side first.
    """
    failed = F.col("base_failed") | (F.col("soft_failures") > 0)
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("n2"), F.sum(F.col("n_docs") * rate * rate).alias("r2"))
    mean, n, k = F.col("f") / F.col("n"), F.col("n"), F.col("k")
    # s2: the weighted variance of rates; c: its expectation at full correlation; rho: what of it isn't chance
    spread = F.col("r2") - n * mean * mean
    chance, full = mean * (1 - mean) * (k - 1), mean * (1 - mean) * (n - F.col("n2") / n)
    rho = F.when(full > chance, F.least(F.greatest((spread - chance) / (full - chance), F.lit(1e-6)), F.lit(0.999))).otherwise(F.lit(1e-6))
    prior = total.select(mean.alias("mean"), (1 / rho - 1).alias("strength"))
    # one row: the only table here that is broadcast unseen
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("mean") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("host_rate"))


def verdicts(judged: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Adds `host_rate` and `kept`. `judged` is read twice, so it should be a written table."""
    rates = host_rates(judged, host).select(F.col("host").alias("_host"), "host_rate")
    joined = join_small_or_shuffled(judged, rates, judged[host].eqNullSafe(rates["_host"]), "left").drop("_host")
    allowed = F.when(F.col("host_rate") > max_rate, 0).otherwise(1)
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("soft_failures") <= allowed))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(measure(table(spark, sf_dir, "documents"))).drop("text")
    return verdicts(written(judged.select("doc_id", "source", "m", "base_failed", "soft_failures"), "judged")).select(
        "doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept", "soft_failures", F.round("host_rate", 6).alias("host_rate")
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that are kept, with the columns of `docs`."""
    packed = docs.select(F.struct("*").alias("row"), F.col(host).alias("source"), F.col(text).alias("text"))
    judged = judge(measure(packed)).select("row", "source", "base_failed", "soft_failures")
    return verdicts(written(judged, "judged")).filter("kept").select("row.*")
