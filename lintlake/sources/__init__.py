"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions import base_name, extension, ignore_glob, is_test_path, normal_path, worked_out

#: What a scan reads, and the caps that its semantics have.
PHP, JS = (".php", ".blade.php", ".inc", ".phtml", ".module", ".php5"), (".js", ".jsx", ".ts", ".tsx")
MAX_FILES, MAX_FILE_KB = 5000, 500


def read_project(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, hash, content) of all files under root; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.expr(f"substring_index(path, '{root.rstrip('/')}/', -1)")
    return files.select(
        normal_path(inside).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.expr("decode(content, 'UTF-8')").alias("content"),
    ).withColumn("ext", extension(F.col("path")))


def select_files(files: DataFrame, extensions=PHP + JS, ignored: list[str] = (), max_kb: int = MAX_FILE_KB, max_files: int = MAX_FILES) -> DataFrame:
    """What a scan reads: known extensions, not ignored, not too large, the first `max_files` by lower-case path."""
    keep = F.col("ext").isin(*extensions) & (F.col("size") <= max_kb * 1024)
    for pattern in ignored:
        keep &= ~F.col("path").rlike(ignore_glob(pattern))
    return files.filter(keep).orderBy(F.lower("path"), "path").limit(max_files)


def best_manifest(files: DataFrame, name: str) -> DataFrame:
    """The manifest of that name nearest the root."""
    depth = F.size(F.split("path", "/"))
    return files.filter(base_name(F.col("path")) == name).orderBy(depth, "path").limit(1)


def read_clover(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, total, covered, pct) of a Clover report's statement lines."""
    rows = spark.read.format("xml").option("rowTag", "file").schema("_name string, line array<struct<_num: int, _type: string, _count: long>>").load(path)
    stmt = rows.select(F.col("_name").alias("file_path"), F.explode("line").alias("l")).filter("l._type = 'stmt'")
    return stmt.groupBy("file_path").agg(F.count("*").alias("total"), F.count_if(F.col("l._count") > 0).alias("covered")).withColumn("pct", F.col("covered") / F.col("total") * 100)


def read_jest(spark: SparkSession, path: str) -> DataFrame:
    """The same of a JSON summary."""
    kind = "map<string, struct<lines: struct<total: long, covered: long, pct: double>>>"
    files = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("file_path", "v")).filter("file_path != 'total'")
    return files.select("file_path", "v.lines.total", "v.lines.covered", "v.lines.pct")


def sarif(findings: DataFrame, results: int = 5000) -> DataFrame:
    """(part, sarif): JSON documents of at most about `results` findings each, every one with the rules it names, by id. Files are dealt
    out by hash, so a file's findings are in one document; a document is one group, bounded by the number of parts."""
    level = F.when(F.col("severity").isin("critical", "high"), "error").when(F.col("severity") == "medium", "warning").otherwise("note")
    parts = max(1, -(-findings.count() // results))
    result = F.struct("file", "line", F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), "fingerprint")
    rule = F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name"))
    each = findings.groupBy(F.pmod(F.xxhash64("file"), F.lit(parts)).alias("part")).agg(F.array_sort(F.collect_set(rule)).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    return each.select(
        "part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct("rules").alias("driver")).alias("tool"), "results")).alias("runs"))).alias("sarif")
    )


def inside(files: DataFrame, root: str) -> DataFrame:
    """Files whose path, once `.` and `..` are worked out at whatever depth, lies under root."""
    return files.withColumn("path", worked_out(normal_path(F.col("path")))).filter(F.col("path").startswith(root.rstrip("/") + "/"))


def test_files(files: DataFrame, most: int = 10_000) -> DataFrame:
    """Files that look like tests, ignored ones too, the first by path; settings of test tools are none."""
    return files.filter(is_test_path(F.col("path"))).orderBy("path").limit(most)


def first_existing(files: DataFrame, candidates: list[str]) -> DataFrame:
    """The first of the candidates, in their order, that exists."""
    tried = files.sparkSession.createDataFrame(list(enumerate(candidates)), "nth int, path string")
    return files.join(F.broadcast(tried), "path").orderBy("nth").limit(1).drop("nth")


def save_baseline(findings: DataFrame, path: str, project: str, profile: str) -> None:
    """One snapshot for each project and profile; others stay."""
    rows = findings.select(F.lit(project).alias("project_slug"), F.lit(profile).alias("profile"), "fingerprint", "rule_id", "severity", "category", "file", "line", "confidence")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_slug", "profile").parquet(path)


def load_baseline(spark: SparkSession, path: str, project: str, profile: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("project_slug") == project) & (F.col("profile") == profile))
