"""Hierarchical multi-length packing.

Documents are routed to tiers of context sizes. What is longer than the longest window fills windows
of its own; the rest of it, and every shorter document, goes to the smallest tier that holds it. The
tier of the longest windows is packed first, its gaps filled from shorter tiers, then each shorter
tier is packed into windows of its own size. Step groups hold the same number of tokens in every tier.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import renamed, slices, table, with_fields
from .tokens import DEFAULT_TOKENIZER, encoder

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that wait at most in one task before tiers are packed.
POOL_TOKENS = 1 << 20
#: Tokens of a step group.
STEP_TOKENS = 16_384

PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class Packer:
    """Packs the documents of one task. Everything that waits is in `short`, sorted by length, and `long`."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, first_id: int):
        self.tiers, self.step_tokens, self.first_id = tiers, step_tokens, first_id
        self.top = tiers[-1]
        self.long: list[tuple] = []  # tails that only the top tier holds
        self.short: list[tuple] = []  # (length, order, document, start, ids), for the other tiers
        self.waiting = self.order = self.sequences = 0
        self.of_window: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, document, ids: np.ndarray) -> None:
        whole = len(ids) // self.top * self.top
        for at in range(0, whole, self.top):
            self._emit([(document, at, ids[at : at + self.top])], self.top)
        if whole < len(ids):
            self._wait(document, whole, ids[whole:])

    def _wait(self, document, start: int, ids: np.ndarray) -> None:
        self.order += 1
        item = (len(ids), self.order, document, start, ids)
        self.long.append(item) if len(self.tiers) == 1 or len(ids) > self.tiers[-2] else insort(self.short, item)
        self.waiting += len(ids)

    def _emit(self, parts: list[tuple], window: int) -> None:
        n = self.of_window.get(window, 0)
        self.of_window[window] = n + 1
        group = n // max(1, self.step_tokens // window)
        offset = 0
        for document, start, ids in parts:
            self.rows.append((document, start, ids, self.first_id + self.sequences, offset, window, (self.first_id << 4) + (group << 4) + window.bit_length()))
            offset += len(ids)
        self.sequences += 1

    def _take(self, gap: int) -> tuple:
        """The longest waiting piece that fits the gap, else so much of a longer one."""
        i = bisect_right(self.short, gap, key=lambda x: x[0])
        n, _, document, start, ids = self.short.pop(i - 1) if i else self.short.pop() if self.short else self.long.pop()
        self.waiting -= n
        if n > gap:
            self._wait(document, start + gap, ids[gap:])
            ids = ids[:gap]
        return document, start, ids

    def _fill(self, window: int, parts: list[tuple]) -> None:
        gap = window - sum(len(x[2]) for x in parts)
        while gap:
            parts.append(self._take(gap))
            gap -= len(parts[-1][2])
        self._emit(parts, window)

    def pack(self, last: bool) -> None:
        while self.long and (self.waiting >= self.top):
            n, _, document, start, ids = self.long.pop()
            self.waiting -= n
            self._fill(self.top, [(document, start, ids)])
        for window in reversed(self.tiers[:-1]):  # documents of a tier go to windows of that tier
            low = window // 2
            while self.short and self.short[-1][0] > low and self.waiting >= window:
                self._fill(window, [])
        if last:  # what is left fills windows of falling powers of two, so nothing is padded
            while self.waiting:
                self._fill(min(self.top, 1 << (self.waiting.bit_length() - 1)), [])


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER,
    tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row for each piece of a document: its place there, its ids (little-endian unsigned 32-bit) and its
    place in a sequence. `window` is the sequence's length, a power of two, so nothing is padded.

    A null or empty text is one piece of one id, the end id. Null and repeated doc_ids stay as they are; each
    row is packed on its own. Only `doc_id` and `text` are read. Nothing is shuffled: a task packs the rows of
    its partition and holds at most `pool_tokens` and one batch. The same partition gives the same sequences
    again when an executor is lost.
    """
    if list(tiers) != sorted(tiers) or any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are rising powers of two")
    schema = with_fields([renamed(docs, doc_id, "doc_id"), *StructType.fromDDL(PIECE)])

    def run(batches):
        enc, packer = encoder(tokenizer), Packer(tiers, step_tokens, TaskContext.get().partitionId() << 36)

        def out():
            rows, packer.rows = packer.rows, []
            column = lambda k, t: pa.array([r[k] for r in rows], t)
            ids = [r[2].astype("<u4") for r in rows]
            return pa.record_batch(
                [
                    pa.array([r[0][0] for r in rows], arrow_id), column(1, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([r[0][1] for r in rows], pa.int64()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.int32()), column(6, pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"],
            )

        arrow_id = None
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for part in slices(batch, 1):
                for key, raw in zip(part.column(0).to_pylist(), enc.batch(part.column(1).to_pylist()), strict=True):
                    ids = np.append(np.frombuffer(raw, "<u2"), np.uint16(end_id))
                    packer.add((key, len(ids)), ids)
                    if packer.waiting > pool_tokens:
                        packer.pack(last=False)
                    if len(packer.rows) >= 5000:
                        yield out()
        if arrow_id is not None:
            packer.pack(last=True)
            yield out()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def digest(pieces: DataFrame, *more: str) -> DataFrame:
    """The pieces with a checksum of their ids in place of these, or beside them with `more="ids"`."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group", *more)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack_documents(table(spark, sf_dir, "documents")))
