"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables up to this many rows of a few dozen bytes may be broadcast; callers count them first.
BROADCAST_ROWS = 20_000
#: Bytes of text that a Python worker takes in hand at once.
SLICE_BYTES = 4 << 20
#: Rows that Spark hands to a Python worker at once. A batch lies in the executor's memory beside its heap, several times over while
#: its buffers grow and are passed on.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches have BATCH_ROWS rows at most; a lower number that is set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets one of its own; on a
    cluster that is an error, since each machine would have another."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row, however often `body` names it.

    Catalyst may copy a projected expression into every place that uses it, also into lambdas, where
    it would be computed again for each element. A lambda variable cannot be copied.
    """
    return F.transform(F.array(value), body)[0]


def quoted(name: str) -> str:
    """The name of a column so that dots and backticks in it stand for themselves."""
    return "`" + name.replace("`", "``") + "`"


def with_fields(fields: Iterable[T.StructField], **more: T.DataType) -> T.StructType:
    """A schema of these fields and then of new ones; as an object, so that any column name will do."""
    return T.StructType([*fields, *(T.StructField(n, t) for n, t in more.items())])


def renamed(df: DataFrame, name: str, to: str) -> T.StructField:
    return T.StructField(to, df.schema[name].dataType)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings (or bytes) in `column` have at most `most` bytes together; a longer
    value is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if `df` has at most `rows` rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def join_small_or_shuffled(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Broadcast `right` where counting shows that it is small, else shuffle (AQE splits skewed keys)."""
    return left.join(F.broadcast(right) if small(right) else right.hint("merge"), on, how)
