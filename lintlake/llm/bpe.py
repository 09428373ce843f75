"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch lie in one array of symbols. An index maps each adjacent pair to all its
positions; a heap holds the ranks that occur. Ranks are applied in ascending order, each at all its
positions at once, and the lists of the pairs to the left and right of what was merged are updated.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, renamed, slices, table, with_fields
from .tokens import DEFAULT_TOKENIZER, WORD_PATTERN, PieceCache, pieces, vocabulary


class PairIndexEncoder:
    def __init__(self, path: str, full: int | None = None):
        v = vocabulary(path)
        id_of = lambda token: v.ids[bytes(v.letters[c] for c in token)]
        self.left = np.array([id_of(a) for a, _ in v.merges], np.int64)
        self.right = np.array([id_of(b) for _, b in v.merges], np.int64)
        self.made = np.array([id_of(a + b) for a, b in v.merges], np.int64)
        keys = self.left << 32 | self.right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.byte_ids = np.array([v.ids[bytes([b])] for b in range(256)], np.int64)
        self.word = regex.compile(WORD_PATTERN)
        self.special = v.special
        self.special_at = regex.compile("(" + "|".join(regex.escape(s) for s in v.special) + ")") if v.special else None
        self.cache = PieceCache(full)  # of pieces that follow a space, without it

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the vocabulary has none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], -1)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        sym = np.append(self.byte_ids[raw], -1)  # position n stands for "none"
        sym = sym.astype(np.int32)
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = n
        prv[(ends - sizes)] = n
        nxt[n] = prv[n] = n
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            at = at[(at < n) & (nxt[at] < n)]
            rank = self.ranks(sym[at], sym[nxt[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(positions)

        note(np.arange(n, dtype=np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]  # some have been merged away since
            if a == b and len(at) > 1:  # in a run of equal symbols, every second pair from its left end
                at = np.unique(at)
                chained = np.append(False, nxt[at[:-1]] == at[1:])
                place = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - begin) % 2 == 0]
            elif len(lists) > 1:
                at = np.unique(at)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            sym[gone] = -1
            nxt[at] = after
            prv[after] = at
            nxt[n] = prv[n] = n
            note(np.unique(np.concatenate([prv[at], at])))
        keep = sym[:n] >= 0
        ids = sym[:n][keep].astype("<u2")
        counts = np.append(0, np.cumsum(keep))
        stops = counts[ends]
        return np.split(ids, stops[:-1]) if len(words) else []

    def _words(self, piece: str) -> list[str]:
        """The words of a piece; special tokens stand alone."""
        if self.special_at and any(s in piece for s in self.special):
            return [w for part in self.special_at.split(piece) for w in ([part] if part in self.special else self.word.findall(part))]
        return self.word.findall(piece)

    def _encoded(self, new: list[str], lead: str) -> dict[str, bytes]:
        """Ids of the pieces `lead + x` by x."""
        cut = [self._words(lead + p) for p in new]
        unknown = list({w for ws in cut for w in ws} - self.special.keys())
        of_word = {s: np.array([i], "<u2").tobytes() for s, i in self.special.items()}
        if unknown:
            of_word.update(zip(unknown, (ids.tobytes() for ids in self.merge([w.encode() for w in unknown])), strict=True))
        return {p: b"".join(map(of_word.__getitem__, ws)) for p, ws in zip(new, cut, strict=True)}

    def batch(self, texts: list[str | None]):
        """Yield the ids of each text as little-endian unsigned 16-bit bytes. Callers bound the texts' bytes."""
        cut = [pieces(t or "") for t in texts]
        wanted = {p for _, rest in cut for p in rest}
        known = {p: ids for p in wanted if (ids := self.cache.ids.get(p)) is not None}
        new = self._encoded(list(wanted - known.keys()), " ")
        self.cache.update(new)
        first_ids = self._encoded(list({first for first, _ in cut}), "")
        ids_of = (known | new).__getitem__
        for first, rest in cut:
            yield first_ids[first] + b"".join(map(ids_of, rest))


@lru_cache(maxsize=1)
def pair_encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def _ids(enc: PairIndexEncoder, texts: pa.Array) -> list[bytes]:
    return [np.frombuffer(raw, "<u2").astype("<u4").tobytes() for raw in enc.batch(texts.to_pylist())]


def _texts(known: list[bytes], ids: list[bytes | None]) -> pa.Array:
    return pa.array([b"".join(map(known.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace") for x in ids], pa.string())


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, ids): each whole text's ids as little-endian unsigned 32-bit integers. A null or empty text has
    none. Null and repeated doc_ids stay; other columns are not read. Texts are taken in slices bounded in bytes;
    one longer than a slice is taken alone."""

    def run(batches):
        enc = pair_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.record_batch([part.column(0), pa.array(_ids(enc, part.column(1)), pa.binary())], ["doc_id", "ids"])

    return _plain(docs, doc_id, text).mapInArrow(run, with_fields([renamed(docs, doc_id, "doc_id")], ids=T.BinaryType()))


def decode(encoded: DataFrame, ids: str = "ids", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """The columns of `encoded` and `decoded`, the text of `ids`; bytes that aren't UTF-8 become U+FFFD. Null ids give an
    empty text. A column that was called `decoded` is replaced."""
    names = [c for c in encoded.columns if c != "decoded"]
    left = encoded.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"), F.col(quoted(ids)).alias("ids"))

    def run(batches):
        known = vocabulary(tokenizer).bytes_of
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.record_batch([part.column(0), _texts(known, part.column(1).to_pylist())], ["row", "decoded"])

    decoded = left.mapInArrow(run, with_fields([left.schema["row"]], decoded=T.StringType()))
    return decoded.select(*(F.col("row").getField(c).alias(c) for c in names), "decoded")


def encode_and_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, ids, decoded): `encode` and then `decode` in one Python stage, so that a task has one worker with one
    vocabulary."""

    def run(batches):
        enc, known = pair_encoder(tokenizer), vocabulary(tokenizer).bytes_of
        for batch in batches:
            for part in slices(batch, 1):
                ids = _ids(enc, part.column(1))
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), _texts(known, ids)], ["doc_id", "ids", "decoded"])

    return _plain(docs, doc_id, text).mapInArrow(run, with_fields([renamed(docs, doc_id, "doc_id")], ids=T.BinaryType(), decoded=T.StringType()))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
