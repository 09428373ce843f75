"""Whitening of embeddings: MLlib's RowMatrix over exactly centred rows, a local eigendecomposition, and the
whitening matrix broadcast to tasks.

Entries are put on a grid of whole numbers first, so sums are exact, and a row's distance from the mean is a
quotient of two whole numbers that is rounded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import quoted, table, with_fields, written

#: Steps of the grid in one unit, and what is added.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries from here on have no exact place on the grid in a double.
_LARGEST = float(1 << 42)
#: Eigenvalues under this share of the largest are rounding.
_FLAT = 1e-12
#: The covariance matrix lies on the driver: 128 MB at this many dimensions.
MOST_DIMENSIONS = 4096


_MADE = "deviation decimal(38,0), whitened array<double>"


@dataclass
class Fit:
    """What was fitted: rows, exact sums by dimension, falling eigenvalues, their unit vectors as columns, the trace."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        """Projection on the components over the root of each one's eigenvalue. Along a flat component there is
        nothing to scale; its column is NaN."""
        return self.vectors / np.sqrt(np.where(self.flat, np.nan, self.eigenvalues))

    @property
    def flat(self) -> np.ndarray:
        return self.eigenvalues <= _FLAT * max(self.eigenvalues[:1].max(initial=0), 0)


def on_grid(df: DataFrame, vector: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of `df` (all by default) as a struct `row`, and `grid`, floor(SCALE * entry) + SHIFT for each
    entry.

    Rows go whose vector is null or empty, or holds a null, an entry that isn't finite, or one of 2^42 or more in
    size (no double holds its place)."""
    v = F.col(quoted(vector))
    good = F.coalesce(F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False))), F.lit(False)) & (F.size(v) > 0)
    kept = [F.col(quoted(n)) for n in (df.columns if carry is None else carry)]
    return df.where(good).select(F.struct(*kept).alias("row"), F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT).alias("grid"))


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact sums of a task's vectors for each number of dimensions: 32-bit halves are added apart, so none overflows."""
    found: dict[int, list] = {}
    for batch in batches:
        sizes = batch["grid"].str.len().to_numpy()
        for d in np.unique(sizes):
            x = np.stack(batch["grid"].to_numpy()[sizes == d])
            low, high = (x & 0xFFFFFFFF).sum(0).astype(object), (x >> 32).sum(0).astype(object)
            n, so_far = found.get(int(d), (0, 0))
            found[int(d)] = [n + len(x), so_far + low + high * (1 << 32)]
    rows = [(d, i, n, Decimal(int(s))) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
    yield pd.DataFrame(rows, columns=["dimensions", "i", "n", "s"])


def fit(grid: DataFrame) -> Fit | None:
    """Fit to all rows of `on_grid`; None if there are none. Vectors of another length than most have (ties: the
    longer one) don't count. The covariance's divisor is the number of rows."""
    by = grid.select("grid").mapInPandas(_sums, "dimensions int, i int, n long, s decimal(38,0)").groupBy("dimensions", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    most = by.where("i = 0").orderBy(F.desc("n"), F.desc("dimensions")).first()
    if most is None:
        return None
    n, d = most["n"], most["dimensions"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"a covariance of {d} dimensions is too large for the driver")
    sums = [int(r["s"].to_integral_value()) for r in by.where(F.col("dimensions") == d).orderBy("i").collect()]
    rows = grid.where(F.size("grid") == d).select(array_to_vector(_centred(n, sums)).alias("v"))
    covariance = gramian(rows) / n
    e, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    e, vectors = e[::-1], vectors[:, ::-1]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(d)])  # the largest entry is positive: the same at every run
    return Fit(n, sums, e, vectors * np.where(sign == 0, 1, sign), float(np.trace(covariance)))


def _centred(n: int, sums: list[int]):
    """(n * x - sum) / n, the numerator exact while it fits 64 bits, else in decimals."""
    s = F.array(*[F.lit(Decimal(v)).cast("decimal(38,0)") for v in sums])
    exact = lambda x, t: x.cast("decimal(20,0)") * F.lit(n).cast("decimal(18,0)") - t
    return F.zip_with("grid", s, lambda x, t: exact(x, t).cast("double") / F.lit(float(n)))


def gramian(vectors: DataFrame) -> np.ndarray:
    """The sum of v v^T over the vectors of a one-column table; tasks add up, the driver gets one matrix."""
    name = vectors.columns[0]
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, name)).computeGramianMatrix().toArray()


def _squares(v: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of whole numbers under 2^52 in size."""
    high, low = v >> 26, v & ((1 << 26) - 1)
    parts = ((high * high).sum(1), (high * low).sum(1), (low * low).sum(1))
    return [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]


def whiten(
    df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, fitted: Fit | None = None, carry: list[str] | None = None,
) -> tuple[DataFrame, Fit | None]:
    """(the columns `carry` of `df`, all by default, with `deviation` and `whitened`; what was fitted).

    `deviation` is the exact sum of (n * x - sum)^2 as decimal(38,0), null where it has more digits; `whitened`
    is an array of at most `components` doubles, null along a component without variance. Columns `deviation` and
    `whitened` are replaced, others stay. Rows without a usable vector go (see `on_grid`), and those of another
    length than what was fitted; equal rows stay apart. An empty table stays empty. A task holds one batch.
    """
    names = [n for n in (df.columns if carry is None else carry) if n not in ("deviation", "whitened")]
    rows = written(on_grid(df, vector, names).withColumn("at", F.monotonically_increasing_id()), "grid")
    fitted = fitted or fit(rows)
    if fitted is None:
        return df.sparkSession.createDataFrame([], with_fields([*rows.schema["row"].dataType, *StructType.fromDDL(_MADE)])), None
    spark, n, d = df.sparkSession, fitted.n, len(fitted.sums)
    shared = spark.sparkContext.broadcast((np.array(fitted.sums, object), fitted.matrix[:, :components]))

    def run(batches):
        sums, matrix = shared.value
        small = n < 1 << 31 and max(abs(s) for s in sums) < 1 << 62
        for batch in batches:
            x = np.stack(batch.pop("grid").to_numpy()) if len(batch) else np.zeros((0, d), np.int64)
            if small and len(x) and max(-int(x.min()), int(x.max())) < (1 << 62) // n:
                off = x * n - sums.astype(np.int64)
            else:
                off = x.astype(object) * n - sums
            fits = off.dtype == np.int64 and (not off.size or np.abs(off).max() < 1 << 52)
            exact = _squares(off) if fits else [sum(int(v) ** 2 for v in r) for r in off]
            batch["deviation"] = [Decimal(v) if v < 10**38 else None for v in exact]
            batch["whitened"] = list((off / n).astype(np.float64) @ matrix)
            yield batch

    # pandas would turn whole numbers beside nulls into doubles, so only the row's number goes through it
    made = rows.where(F.size("grid") == d).select("at", "grid").mapInPandas(run, f"at long, {_MADE}")
    joined = rows.select("at", "row").join(made, "at")
    return joined.select(*[F.col("row").getField(n).alias(n) for n in names], "deviation", "whitened"), fitted


def identity_error(whitened: DataFrame, fitted: Fit | None, column: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of whitened rows (those fitted to) minus the identity; components
    without variance are left out. None if there is nothing to measure."""
    k = 0 if fitted is None else min(int((~fitted.flat).sum()), whitened.select(F.max(F.size(column))).first()[0] or 0)
    if not k:
        return None
    mean = list(whitened.agg(*[F.avg(F.col(column)[i]) for i in range(k)]).first())
    centred = F.zip_with(F.slice(column, 1, k), F.array(*map(F.lit, mean)), lambda z, m: z - m)
    return float(np.abs(gramian(whitened.select(array_to_vector(centred).alias("v"))) / fitted.n - np.eye(k)).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector of `embeddings` and component. `deviation` is null where 64 bits can't hold it;
    `deviation_exact` has it as a decimal. A component without variance has no `whitened` value."""
    rows, fitted = whiten(table(spark, sf_dir, "embeddings"), carry=["vec_id"])
    rows = written(rows, "whitened")
    error = identity_error(rows, fitted)
    shares = (fitted.eigenvalues[:COMPONENTS] / (fitted.trace or 1)).tolist() if fitted else []
    of = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "w"))
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("w").alias("whitened"), F.get(of, F.col("i")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), F.col("deviation").alias("deviation_exact"),
    )
