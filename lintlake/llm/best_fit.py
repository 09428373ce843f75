"""Best-fit decreasing packing with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so the corpus is packed by how often each length occurs: lengths
are taken in falling order, a segment tree over remaining capacities finds the tightest open bin in logarithmic
time, and equal documents that go to bins of one remaining capacity are placed in one step. The bins are those
of best-fit decreasing over all documents, one by one, yet the driver holds no more than a count for each
length and the list of steps. A document finds its bin by its length and its number among documents of that
length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import quoted, renamed, slices, table, with_fields, written
from .tokens import DEFAULT_TOKENIZER, encoder

CAPACITY = 1024
END_ID = 2
#: Rows that leave a task together.
_ROWS = 5000
#: Lengths and numbers of documents share a 64-bit key.
_NUMBER_BITS = 40


class CapacityTree:
    """Runs of open bins by what still fits into each; a node holds how many runs lie below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.runs_below = [0] * (2 * self.leaves)
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.runs.setdefault(room, []).append((first, bins))
            self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].pop()

    def _count(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.runs_below[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of `need` or more that an open bin has."""
        node = need + self.leaves
        while not self.runs_below[node]:  # up, until something lies to the right
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node + (not self.runs_below[2 * node])
        return node - self.leaves


def steps(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, number of the first document, first bin, offset there, documents to a bin) of each step of best-fit
    decreasing, and how many bins there are. `counts` says how many documents have each length."""
    tree, out, bins = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        number, left = 0, counts[length]
        while left:
            if (room := tree.tightest(length)) is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                (first, n), each = tree.take(room), room // length
            full = min(n, left // each)
            if full:
                out.append((length, number, first, capacity - room, each))
                tree.put(room - each * length, first, full)
                number, left, first, n = number + full * each, left - full * each, first + full, n - full
            if n and left:  # fewer documents are left than a bin holds
                out.append((length, number, first, capacity - room, each))
                tree.put(room - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            tree.put(room, first, n)
    return out, bins


def best_fit(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` and each one's `sequence_id` (from 0, without gaps) and `offset` there; columns of these names are
    replaced, all others stay, whatever they are called.

    Lengths are 1 to `capacity`; anything else, null too, is an error, since it has no bin. Equal rows are packed
    one by one; ties in length go by place. An empty table stays empty. Rows are written once, so that their numbers
    hold when an executor is lost; a number is a count within the task that wrote the row, added to what earlier tasks
    wrote of that length, so no group is larger than one task's rows, however many rows share a length.
    """
    own = [n for n in pieces.columns if n not in ("sequence_id", "offset")]
    fits = F.col(quoted(length)).between(1, capacity)
    checked = F.when(fits, F.col(quoted(length)).cast("int")).otherwise(F.raise_error(F.lit(f"lengths are 1 to {capacity}")).cast("int"))
    rows = written(pieces.select(F.struct(*(F.col(quoted(n)) for n in own)).alias("row"), checked.alias("len"), F.monotonically_increasing_id().alias("at")), "best-fit").withColumn("task", F.shiftright("at", 33).cast("int"))
    by_task = rows.groupBy("len", "task").agg(F.count("*").alias("n"))
    counts = {r["len"]: r["n"] for r in by_task.groupBy("len").agg(F.sum("n").alias("n")).collect()}
    plan, _ = steps(counts, capacity)
    key, first, at, each = (np.array(x, np.int64) for x in (zip(*[((a << _NUMBER_BITS) + b, c, d, e) for a, b, c, d, e in sorted(plan)], strict=True) if plan else [[]] * 4))

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, want = size.to_numpy(np.int64), number.to_numpy(np.int64)
        want = (size << _NUMBER_BITS) + want
        i = np.searchsorted(key, want, "right") - 1
        nth, many = want - key[i], each[i]
        return pd.DataFrame({"sequence_id": first[i] + nth // many, "offset": at[i] + nth % many * size})

    before = F.coalesce(F.sum("n").over(Window.partitionBy("len").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("len", "task").orderBy("at")) - 1).join(by_task.select("len", "task", before.alias("before")), ["len", "task"])
    placed = numbered.select("row", place("len", F.col("before") + F.col("nth")).alias("p"))
    return placed.select(*[F.col("row").getField(n).alias(n) for n in own], "p.sequence_id", "p.offset")


PIECE = "piece int, start long, length long, ids binary, doc_tokens long"


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` tokens: a longer document is cut into pieces of `capacity` tokens, the first of
    which takes the rest; any other document is one piece. `ids` are little-endian unsigned 32-bit.

    A null or empty text is the end id alone. Null and repeated doc_ids stay; only `doc_id` and `text` are read.
    Each row of an empty table has no pieces. A long text is encoded alone and its pieces leave the task in
    batches, so a task holds one slice of texts and one batch of pieces.
    """
    schema = with_fields([renamed(docs, doc_id, "doc_id"), *StructType.fromDDL(PIECE)])

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            arrow_id, rows = batch.schema.field(0).type, []

            def out(rows=rows, arrow_id=arrow_id):
                kinds = (arrow_id, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)
                rows.clear()
                return made

            for part in slices(batch, 1):
                for key, raw in zip(part.column(0).to_pylist(), enc.batch(part.column(1).to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id)).astype("<u4")
                    start, stop = 0, (len(ids) - 1) % capacity + 1
                    for n in range(-(-len(ids) // capacity)):
                        rows.append((key, n, start, stop - start, ids[start:stop].tobytes(), len(ids)))
                        start, stop = stop, stop + capacity
                        if len(rows) >= _ROWS:
                            yield out()
            if rows:
                yield out()

    return docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).cast("string").alias("text")).mapInArrow(run, schema)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with a checksum of their ids, packed."""
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return best_fit(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
