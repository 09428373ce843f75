"""Substring dedup with suffix automata over words.

A window is a run of 35 words. Every window has an anchor, its least 6-gram hash, and equal windows have
equal anchors, so a corpus falls into reference shards by anchor: a shard holds the pieces of all texts
whose windows have that anchor, each window in one piece only. Anchors that occur once are left out.
A shard's suffix automaton counts the places of every substring; streaming the pieces through it gives
matching statistics, the longest suffix at each word that occurs twice or more, and so the maximal spans
above the length threshold.

The reference is the corpus itself here and grows with it, so its automata are not broadcast: texts are
dealt to the task that builds the automaton of their shard. `strip_reference` is for a given reference of
bounded size and does broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small_or_shuffled, quoted, renamed, slices, table, with_fields, written
from .words import anchors, chunks, digest_of, mixed, signed

#: Fixed values of the contract.
WINDOW = 35
K = 6
#: A shard of more distinct pieces than this is split by its windows, one key for each window's words.
HOT_PIECES = 2000
#: Pieces that a task remembers to have given, so that it need not give their words again.
SEEN_PIECES = 1_000_000
#: Words that a broadcast reference may have, and words of one of its shards.
BROADCAST_WORDS, SHARD_WORDS = 2_000_000, 100_000


RESULT = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept": T.StringType()}


class SuffixAutomaton:
    """Of several sequences; `weight` counts the places of each state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.weight = [0]

    def _state(self, length: int, after: dict, link: int) -> int:
        self.next.append(after)
        self.len.append(length)
        self.link.append(link)
        self.weight.append(0)
        return len(self.len) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state of p's longest string and the symbol, apart from q's longer strings."""
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, weight: int = 1) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for symbol in sequence:
            q = nxt[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
            else:
                new = self._state(length[last] + 1, {}, 0)
                p = last
                while p >= 0 and symbol not in nxt[p]:
                    nxt[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
                last = new
            self.weight[last] += weight

    def count(self) -> None:
        """Add the places of longer strings to their suffixes; once, after the last `add`."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.weight[self.link[s]] += self.weight[s]

    def matches(self, sequence, least: int = 1):
        """Yield for each symbol the length of the longest suffix so far that occurs `least` times or more."""
        nxt, link, length, weight = self.next, self.link, self.len, self.weight
        state = n = 0
        for symbol in sequence:
            while state and symbol not in nxt[state]:
                state = link[state]
                n = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                n += 1
            at, m = state, n
            while at and weight[at] < least:
                at = link[at]
                m = length[at]
            yield m if at else 0


def _runs(starts: list[int]) -> list[int]:
    """first, last, first, last, ... of runs of neighbouring numbers."""
    if not starts:
        return []
    a = np.array(starts)
    cut = np.flatnonzero(np.diff(a) > 1)
    return np.stack([a[np.append(0, cut + 1)], a[np.append(cut, len(a) - 1)]], 1).ravel().tolist()


def repeated_windows(pieces: list[tuple[list[str], int]], window: int = WINDOW) -> list[list[int]]:
    """For each (words, places) the runs of windows that have two places or more among all."""
    if len(pieces) == 1:  # each window of the only piece has as many places as the piece
        words, places = pieces[0]
        return [[0, len(words) - window] if places > 1 else []]
    automaton = SuffixAutomaton()
    for words, places in pieces:
        automaton.add(words, places)
    automaton.count()
    return [_runs([i - window + 1 for i, n in enumerate(automaton.matches(words, 2)) if n >= window]) for words, _ in pieces]


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(key, text): equal texts share a key."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(t)).alias("key"), t.alias("text"))


def _anchors_of_texts(keyed: DataFrame, window: int, k: int) -> DataFrame:
    """(key, anchor), a row for each run of windows."""

    def run(batches):
        for batch in batches:
            for at, w in chunks(batch.column(1)):
                anchor, first, _ = anchors(w, window, k)
                if len(anchor):
                    yield pa.record_batch([batch.column(0).take(pa.array(w.row[first] + at)), signed(anchor)], ["key", "anchor"])

    return keyed.mapInArrow(run, "key binary, anchor long")


def _pieces_of_texts(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(key, text, anchors) to (key, first, anchor, piece, text): the pieces whose anchor is listed.
    `text` is null where the task has given the same piece before."""

    def marked(anchor: np.ndarray, row: np.ndarray) -> np.ndarray:
        return anchor ^ mixed(row.astype(np.uint64))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, listed = batch.column("key"), batch.column("anchors")
            values, bounds = listed.values.to_numpy(zero_copy_only=False).view(np.uint64), listed.offsets.to_numpy()
            for at, w in chunks(batch.column("text")):
                anchor, first, last = anchors(w, window, k)
                rows = len(w.first_of_row) - 1
                sizes = np.diff(bounds[at : at + rows + 1])
                wanted = marked(values[bounds[at] : bounds[at + rows]], np.repeat(np.arange(rows), sizes))
                keep = np.isin(marked(anchor, w.row[first]), wanted)
                anchor, first, end = anchor[keep], first[keep], last[keep] + window
                if not len(anchor):
                    continue
                row, piece, texts = w.row[first], [], []
                if len(seen) > SEEN_PIECES:
                    seen.clear()
                for b, e in zip(first.tolist(), end.tolist(), strict=True):
                    words = w.joined(b, e)
                    piece.append(digest_of(words))
                    texts.append(None if piece[-1] in seen else words)
                    seen.add(piece[-1])
                piece = np.array(piece, np.uint64)
                yield pa.record_batch(
                    [keys.take(pa.array(row + at)), pa.array((first - w.first_of_row[row]).astype(np.int32)), signed(anchor), signed(piece), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["key", "first", "anchor", "piece", "text"],
                )

    return texts.select("key", "text", "anchors").mapInArrow(run, "key binary, first int, anchor long, piece long, text string")


def _by_automaton(pieces: DataFrame, window: int) -> DataFrame:
    """(anchor, piece, runs) from distinct pieces; a shard has at most HOT_PIECES."""

    def run(batches):
        group, anchor, out = [], None, []

        def close():
            for (piece, _, _), runs in zip(group, repeated_windows([(w, n) for _, w, n in group], window), strict=True):
                if runs:
                    out.append((anchor, piece, runs))

        def table_of():
            rows = list(out)
            out.clear()
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], ["anchor", "piece", "runs"])

        for batch in batches:
            for a, p, t, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "text", "places")), strict=True):
                if a != anchor:
                    close()
                    group, anchor = [], a
                    if len(out) > 5000:
                        yield table_of()
                group.append((p, t.split(" "), n))
        close()
        yield table_of()

    return pieces.select("anchor", "piece", "text", "places").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, piece long, runs array<int>")


def _by_window(pieces: DataFrame, window: int) -> DataFrame:
    """The same for shards of any size: every window's words are a key of their own."""
    words = F.split("text", " ")
    at = pieces.withColumn("words", words).select("anchor", "piece", "places", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("words") - window), lambda i: F.unhex(F.md5(F.concat_ws(" ", F.slice("words", i + 1, window)))))).alias("i", "w"))
    at = written(at, "windows")
    counts = at.groupBy("w").agg(F.sum("places").alias("n")).filter("n > 1").select("w")
    return at.join(counts.hint("merge"), "w", "left_semi").groupBy("anchor", "piece").agg(F.flatten(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.array(i, i))).alias("runs"))


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, k: int = K, hot_pieces: int = HOT_PIECES) -> DataFrame:
    """(key, spans): for each text, by md5, the runs of words covered by repeated windows as [first, end) pairs;
    texts without any have no row."""
    keyed = _keyed(docs, text)
    found = written(_anchors_of_texts(keyed, window, k).groupBy("key", "anchor").agg(F.count("*").alias("places")), "anchors")
    repeated = found.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1").select("anchor")
    listed = found.join(repeated.hint("merge"), "anchor", "left_semi").groupBy("key").agg(F.collect_list("anchor").alias("anchors"))
    # every copy of a text gives its pieces again, so places count once for each copy
    cut = written(_pieces_of_texts(keyed.join(listed.hint("merge"), "key"), window, k), "pieces")
    distinct = written(cut.groupBy("anchor", "piece").agg(F.max("text").alias("text"), F.count("*").alias("places")), "shards")
    hot = distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot_pieces).select("anchor", F.lit(True).alias("hot"))
    marked = join_small_or_shuffled(distinct, hot, "anchor", "left")
    results = _by_automaton(marked.filter("hot is null"), window).unionByName(_by_window(marked.filter("hot"), window))
    back = cut.select("key", "first", "anchor", "piece").distinct().join(written(results, "repeats").hint("merge"), ["anchor", "piece"])
    spans = F.expr(f"transform(sequence(0, size(runs) div 2 - 1), j -> struct(first + runs[2 * j] as b, first + runs[2 * j + 1] + {window} as e))")
    return back.select("key", spans.alias("s")).groupBy("key").agg(F.flatten(F.collect_set("s")).alias("spans"))


def without_spans(rows: DataFrame, spans: DataFrame, as_it_was: bool = False) -> DataFrame:
    """(row, n_words, n_removed, kept) of rows (row, text): the words of `text` outside its spans, joined by one space;
    with `as_it_was` a text that loses no word stays as it was."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = rows.select("row", F.unhex(F.md5(t)).alias("key"), t.alias("text")).join(spans.hint("merge"), "key", "left").select("row", "text", F.col("spans.b").alias("b"), F.col("spans.e").alias("e"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for t, b, e in zip(part.column("text").cast(pa.binary()).to_pylist(), *(part.column(c).to_pylist() for c in "be"), strict=True):
                    words = t.split()
                    n = len(words)
                    if b:
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, b, 1)
                        np.subtract.at(edge, e, 1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                    rows.append((n, n - len(words), t if as_it_was and n == len(words) else b" ".join(words)))
                n, removed, kept = ([r[c] for r in rows] for c in range(3))
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(run, with_fields([rows.schema["row"]], **RESULT))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, **how) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each document, without every word that a window covers whose words also
    start anywhere else in `docs`.

    A null text has no words; a text shorter than a window loses none; of equal texts of a window or more nothing
    is left. Null and repeated doc_ids stay; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("row"), F.col(text).alias("text"))
    return without_spans(rows, repeated_spans(docs, text, window, **how)).withColumnRenamed("row", "doc_id")


def strip_repeats(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **how) -> DataFrame:
    """`docs` with its columns, texts without repeated windows and their new length in `n_chars`. Documents stay even
    if no word is left; a null text becomes empty. Any other columns may be there, whatever they are called; equal rows
    lose the same words. An empty table stays empty."""
    others = [F.col(quoted(c)) for c in docs.columns if c != text] or [F.lit(0)]
    rows = docs.select(F.struct(*others).alias("row"), F.col(quoted(text)).alias("text"))
    done = without_spans(rows, repeated_spans(docs, text, **how), as_it_was=True)
    new = {text: F.col("kept"), n_chars: F.char_length("kept").cast("long")}
    return done.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def strip_reference(docs: DataFrame, reference: DataFrame, doc_id: str = "doc_id", text: str = "text", reference_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Like `dedup_substrings`, without the words of spans of a window or more that `reference` holds. The
    reference is bounded (BROADCAST_WORDS, else an error): its shards' automata are broadcast."""
    spark = docs.sparkSession
    n_words = F.size(F.filter(F.split(F.coalesce(reference_text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    if (reference.select(F.sum(n_words)).first()[0] or 0) > BROADCAST_WORDS:
        raise ValueError("the reference is too large to broadcast; union it to the documents and use dedup_substrings")
    shards, size = [SuffixAutomaton()], 0
    for (t,) in reference.select(reference_text).toLocalIterator():
        words = (t or "").encode().split()
        if size and size + len(words) > SHARD_WORDS:
            shards.append(SuffixAutomaton())
            size = 0
        shards[-1].add(words)
        size += len(words)
    sent = spark.sparkContext.broadcast(shards)

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                words = (t or "").encode().split()
                gone = np.zeros(len(words), bool)
                for automaton in sent.value:
                    for i, n in enumerate(automaton.matches(words)):
                        if n >= window:
                            gone[i - n + 1 : i + 1] = True
                rows.append((len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode()))
            yield pa.record_batch([batch.column(0), *(pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, with_fields([renamed(docs, doc_id, "doc_id")], **RESULT))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
