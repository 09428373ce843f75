"""N-gram Jaccard join by a MinHash LSH forest.

Each different text has a signature in every tree of the forest; a tree is the texts in the order of their
signatures, so texts that share a prefix stand side by side, like the subtree of a prefix trie. The matching
starts with the longest prefix. Under each prefix a text is linked to the leaders there whose whole signature is alike;
from the links' similarities follows which share of alike pairs can have met at that length, and the prefix is
shortened by one until this share reaches the target recall. Links of unlike signatures are dropped at once, so
unlike texts don't chain. What is connected is then verified exactly: every two texts of a component are
compared by their whole shingle sets, in blocks, so no link between texts that met in any tree is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_small_or_shuffled, table, written
from .components import components
from .words import Words, chunks, grams, mixed

SHINGLE, THRESHOLD = 5, 0.8
TREES, SIGNATURE = 24, 8
TARGET_RECALL = 0.9995
#: Standard errors by which a similarity that is read off signatures may lie below the true one.
SLACK = 5.0
#: Texts whose words a task remembers to have given.
SEEN_TEXTS = 500_000
#: Texts of a block; two blocks are compared in one task.
BLOCK = 256
#: Tasks that the texts of one class are dealt to when they are given its id.
CLASS_SALTS = 32
#: Columns of a block's shingle matrix that are held at once.
MATRIX_COLUMNS = 8192


def met(similarity, depth: int, trees: int = TREES):
    """The probability that two texts of this similarity share a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all runs of n words; a text of 1 to n - 1 words has one shingle of all its words."""
    g = grams(w.hash, n)
    inside = w.row[: len(g)] == w.row[n - 1 :] if len(g) else np.zeros(0, bool)
    counts = np.diff(w.first_of_row)
    short = np.flatnonzero((counts > 0) & (counts < n))
    hashes, rows = [g[inside]], [w.row[: len(g)][inside]]
    for size in range(1, n):  # all texts of `size` words at once
        of = short[counts[short] == size]
        if len(of):
            h = np.zeros(len(of), np.uint64)
            for j in range(size):
                h = mixed(h + w.hash[w.first_of_row[of] + j])
            hashes.append(h)
            rows.append(of)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    if len(short):
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


_SALTS = mixed(np.arange(1, 4097, dtype=np.uint64))


def signatures(h: np.ndarray, row: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, 16-bit MinHash values as rows x hashes)."""
    begin = np.append(0, np.flatnonzero(np.diff(row)) + 1)
    low, out = (h >> np.uint64(32)).astype(np.uint32), np.empty((len(begin), hashes), np.uint16)
    for i in range(hashes):
        salt = int(_SALTS[i])
        x = (low ^ np.uint32(salt & 0xFFFFFFFF)) * np.uint32(salt >> 32 | 1)
        least = np.minimum.reduceat(x, begin)
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)  # any bits of the least value tell values apart
    return row[begin], out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """(key, text): equal texts share a key."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(t)).alias("key"), t.alias("text"))


def _once_a_task(keyed: DataFrame) -> DataFrame:
    """The rows of `keyed` without those whose key its task has given before, so that a hot text's copies aren't shuffled."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            new = []
            for k in batch.column(0).to_pylist():
                new.append(k not in seen)
                seen.add(k)
            yield batch.filter(pa.array(new, pa.bool_()))

    return keyed.mapInArrow(run, "key binary, text string")


def forest(keyed: DataFrame, shingle: int, trees: int, signature: int) -> DataFrame:
    """(tree, signature, bits, key) of each text with a word; a task gives a text once. `bits` has a bit of each value of all
    trees, from which similarities are read."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            keys = batch.column(0).to_pylist()
            for at, w in chunks(batch.column(1)):
                h, row = shingles(w, shingle)
                if not len(h):
                    continue
                rows, values = signatures(h, row, trees * signature)
                new = [i for i, r in enumerate(rows.tolist()) if keys[r + at] not in seen]
                seen.update(keys[rows[i] + at] for i in new)
                if not new:
                    continue
                raw, width = values[new].astype(">u2").tobytes(), 2 * signature
                bits = pa.array([x.tobytes() for x in _bits(values[new])], pa.binary())
                each = pa.array(np.repeat(np.arange(len(new)), trees))
                yield pa.record_batch(
                    [
                        pa.array(np.tile(np.arange(trees, dtype=np.int32), len(new))),
                        pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()),
                        bits.take(each),
                        batch.column(0).take(pa.array(np.repeat(rows[new] + at, trees))),
                    ],
                    ["tree", "signature", "bits", "key"],
                )

    return keyed.mapInArrow(run, "tree int, signature binary, bits binary, key binary")


def _bits(values: np.ndarray) -> np.ndarray:
    """The low bits of each row's values as 64-bit words."""
    packed = np.packbits((values & 1).astype(bool), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


class Leaders:
    """The texts of one prefix, one by one. One that is near no leader before it becomes a leader; each is linked to the
    leader nearest to it and to those within `far` that aren't connected yet."""

    def __init__(self, hashes: int, near: float, far: float, whole: bool = False):
        """`whole`: what is compared are all 16-bit values, not one bit of each."""
        self.hashes, self.near, self.far, self.whole = hashes, near, far, whole
        self.kind = np.uint16 if whole else np.uint64

    def start(self, key: bytes, bits: bytes) -> None:
        self.keys, self.raw, self.of = [key], [bits], [0]
        self.matrix = None  # most prefixes have one text

    def add(self, key: bytes, bits: bytes) -> list[tuple[bytes, bytes, float]]:
        n, own = len(self.keys), np.frombuffer(bits, self.kind)
        if self.matrix is None or n > len(self.matrix):
            self.matrix = np.zeros((max(4, 2 * n), len(own)), self.kind)
            self.matrix[:n] = np.frombuffer(b"".join(self.raw), self.kind).reshape(n, -1)
        if self.whole:
            similar = (self.matrix[:n] == own).sum(1) / self.hashes
        else:
            similar = 1 - 2 * np.bitwise_count(self.matrix[:n] ^ own).sum(1) / self.hashes
        close = np.flatnonzero(similar >= self.far)
        links, joined = [], set()
        for i in close[np.argsort(-similar[close], kind="stable")].tolist():
            if self.of[i] not in joined:
                joined.add(self.of[i])
                if self.keys[i] != key:
                    links.append((self.keys[i], key, float(similar[i])))
        if len(joined) > 1:
            least = min(joined)
            self.of = [least if x in joined else x for x in self.of]
        if similar.max() < self.near:
            self.keys.append(key)
            self.raw.append(bits)
            self.of.append(min(joined) if joined else max(self.of) + 1)
            if n < len(self.matrix):
                self.matrix[n] = own
            else:
                self.matrix = None
        return links


def prefix_links(trees: DataFrame, depth: int, threshold: float, hashes: int) -> DataFrame:
    """(a, b, similarity): links of each text to leaders under its prefix, in the order of each tree.

    A text that is alike to no leader before it becomes one. A text is connected to every leader that could be near a text
    alike to it: distance is a metric, so where two texts are alike, one of them is within twice the distance of the
    other's leader. Similarities are read off the signatures' bits, with some slack.

    The order is dealt out by ranges of (tree, signature, key), so a prefix that many texts share is cut anywhere; the
    leaders of the first and last prefix of each range are then linked in the same way, by all values of their
    signatures: these lie further apart, where one bit of each value can't tell them from texts that share nothing.
    """
    ranged = trees.repartitionByRange("tree", "signature", "key").sortWithinPartitions("tree", "signature", "key")
    width, apart = 2 * depth, 1 - threshold

    def beyond(distance: float) -> float:
        """The least similarity that may be read off one bit of each value where the distance is this or less."""
        same = 1 - distance / 2
        return 1 - distance - SLACK * 2 * (same * (1 - same) / hashes) ** 0.5

    def beyond_whole(distance: float) -> float:
        """The same of whole values. At a threshold of 0.8 this is over 0, where texts that share nothing lie."""
        same = max(0.0, 1 - distance)
        return same - SLACK * (same * (1 - same) / hashes) ** 0.5

    names, schema = ["a", "b", "similarity", "tree", "prefix", "bits"], "a binary, b binary, similarity double, tree int, prefix binary, bits binary"
    types = [pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]

    def linked(far: float, ends: bool):
        def run(batches):
            leaders, group, first = Leaders(hashes, threshold, far, whole=not ends), None, True
            rows: list[tuple] = []

            def end() -> None:
                rows.extend((k, None, None, group[0], group[1], w) for k, w in zip(leaders.keys, leaders.raw, strict=True))

            def out() -> pa.RecordBatch:
                done = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)
                rows.clear()
                return done

            for batch in batches:
                for t, s, w, k in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    here = (t, s[:width])
                    if here == group:
                        rows += [(a, b, x, None, None, None) for a, b, x in leaders.add(k, w)]
                        continue
                    if ends and group is not None and first:
                        end()
                        first = False
                    group = here
                    leaders.start(k, w)
                if len(rows) > 5000:
                    yield out()
            if ends and group is not None:
                end()
            yield out()

        return run

    found = written(ranged.mapInArrow(linked(beyond(2 * apart), True), schema), "links")
    # a leader of a range stands for texts near it, so between leaders the distance may be twice as much again
    ends = found.filter("prefix is not null").select("tree", F.col("prefix").alias("signature"), F.col("a").alias("key"))
    met_again = ends.groupBy("tree", "signature").agg(F.count("*").alias("n")).filter("n > 1").select("tree", "signature")
    several = ends.join(met_again, ["tree", "signature"], "left_semi")
    # every task that has a text gives its signatures again, so each is first taken once by text and tree
    once = join_small_or_shuffled(trees, several.select("key").distinct(), "key", "left_semi").groupBy("key", "tree").agg(F.min("signature").alias("signature"))
    values = once.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("tree", F.hex("signature").alias("s")))).alias("parts"))
    several = several.join(values.select("key", F.unhex(F.array_join(F.col("parts.s"), "")).alias("bits")), "key").select("tree", "signature", "bits", "key")
    across = several.repartition("tree", "signature").sortWithinPartitions("tree", "signature", "key").mapInArrow(linked(beyond_whole(4 * apart), False), schema)
    links = found.filter("prefix is null").unionByName(across).filter("a != b")
    return links.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def estimated_recall(links: DataFrame, depth: int, threshold: float, trees: int) -> float:
    """The share of alike pairs that have met at this depth, from the links that did: one of similarity s stands for
    1 / met(s) pairs. A link's similarity is no less than the threshold here."""
    s = F.greatest(F.col("similarity"), F.lit(threshold))
    p = 1 - F.pow(1 - F.pow(s, F.lit(depth)), F.lit(trees))
    n, pairs = links.filter(F.col("similarity") >= threshold).agg(F.count("*"), F.sum(1 / p)).first()
    return n / pairs if n else 1.0


def candidate_links(trees_: DataFrame, threshold: float, trees: int, signature: int, target: float) -> DataFrame:
    """`prefix_links` at the longest prefix whose estimated recall reaches the target."""
    for depth in range(signature, 0, -1):
        links = written(prefix_links(trees_, depth, threshold, trees * signature), "candidates")
        if depth == 1 or estimated_recall(links, depth, threshold, trees) >= target:
            return links
    raise ValueError("a signature has one value or more")


def _shingle_sets(keyed: DataFrame, shingle: int) -> DataFrame:
    """(key, root, size, shingles): sorted different shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            for at, w in chunks(batch.column("text")):
                h, row = shingles(w, shingle)
                n = len(w.first_of_row) - 1
                bounds = np.searchsorted(row, np.arange(n + 1))
                sets = [np.unique(h[bounds[i] : bounds[i + 1]]).tobytes() for i in range(n)]
                part = batch.slice(at, n)
                yield pa.record_batch([part.column("key"), part.column("root"), part.column("size"), part.column("copies"), pa.array(sets, pa.binary())], ["key", "root", "size", "copies", "shingles"])

    return keyed.select("key", "root", "size", "copies", "text").mapInArrow(run, "key binary, root binary, size long, copies long, shingles binary")


def similar(sets: list[np.ndarray], threshold: float, columns: int = MATRIX_COLUMNS) -> np.ndarray:
    """Which two of the sets have this Jaccard similarity or more, as a square matrix."""
    sizes = np.array([len(s) for s in sets])
    value, column = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(column)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[column] > 1
    column, row = column[shared], row[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [at, at + columns])
        m = np.zeros((len(sets), min(columns, int(column[hi - 1]) - at + 1)), np.float32)
        m[row[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    either = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * either - 1e-9


def _verified(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(key, other, links): for each text of two blocks its similar texts, their copies included, and one of them."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).select("root", "i", "j", "own", "key", "copies", "shingles")
    placed = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")

    def compare(i: int, j: int, rows: list[tuple]):
        alike = similar([np.frombuffer(r[3], np.uint64) for r in rows], threshold)
        np.fill_diagonal(alike, False)
        own = np.array([r[0] for r in rows])
        if i != j:  # pairs within a block are met in (i, i) and (j, j)
            alike &= own[:, None] != own[None, :]
        links = alike @ np.array([r[2] for r in rows], np.int64)
        # every text with the first one of its component here: together they connect all similar texts
        seen: dict[int, int] = {}
        for k in np.flatnonzero(links):
            stack = [int(k)] if int(k) not in seen else []
            while stack:
                x = stack.pop()
                if x not in seen:
                    seen[x] = int(k)
                    stack += [int(y) for y in np.flatnonzero(alike[x]) if int(y) not in seen]
        return [(rows[x][1], rows[r][1], int(links[x])) for x, r in seen.items()]

    def run(batches):
        group, rows, out = None, [], []

        def close():
            if len(rows) > 1:
                out.extend(compare(group[1], group[2], rows))

        def flush():
            done = list(out)
            out.clear()
            return pa.record_batch([pa.array([r[0] for r in done], pa.binary()), pa.array([r[1] for r in done], pa.binary()), pa.array([r[2] for r in done], pa.int64())], ["key", "other", "links"])

        for batch in batches:
            for root, i, j, own, key, copies, sets in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if (root, i, j) != group:
                    close()
                    group, rows = (root, i, j), []
                    if len(out) > 5000:
                        yield flush()
                rows.append((own, key, copies, sets))
        close()
        yield flush()

    return placed.mapInArrow(run, "key binary, other binary, links long")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
    trees: int = TREES, signature: int = SIGNATURE, target_recall: float = TARGET_RECALL, block: int = BLOCK,
) -> DataFrame:
    """One row a document: (doc_id, class_id, n_links, key, root). A class is a component of texts linked by a Jaccard
    similarity of `threshold` or more of their word shingles; class_id is its least doc_id. n_links counts the other
    documents that the document's text is linked to, copies included. `key` is the text's md5, `root` the key
    that tells its class from all others, with or without ids (null for documents without words).

    Words are taken as they stand. Documents without words (null, empty or blank) are alike to none, not even to each
    other: class_id is their own doc_id. Null and repeated doc_ids stay; a class without any id has a null class_id.
    An empty table stays empty; long texts are shingled whole, one at a time; other columns are not read. At thresholds
    under 0.8 leaders of different task ranges can't be told from unlike ones by their distance, and more texts are compared.
    """
    keyed = _keyed(docs, text)
    copies = docs.select(F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("key"), F.col(doc_id).alias("doc_id"))
    texts = written(copies.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "texts")
    links = candidate_links(written(forest(keyed, shingle, trees, signature), "forest"), threshold, trees, signature, target_recall)
    candidates = written(components(links.select("a", "b")), "components")
    sizes = candidates.groupBy("root").agg(F.count("*").alias("size"))
    members = candidates.join(sizes.hint("merge"), "root").join(texts.hint("merge"), F.col("node") == F.col("key")).select("key", "root", "size", "copies")
    # each text once, from whichever of its copies comes first
    with_text = members.hint("merge").join(_once_a_task(keyed), "key").dropDuplicates(["key"])
    found = written(_verified(_shingle_sets(with_text, shingle), threshold, block), "verified")
    classes = components(found.select(F.col("key").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("key"), "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = classes.join(links.hint("merge"), "key")
    known = written(texts.join(linked.hint("merge"), "key", "left"), "known")
    # a class of many texts is met in several tasks, each with a copy of its one row
    named = known.filter("root is not null").groupBy("root").agg(F.min("least").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(CLASS_SALTS - 1))))
    several = known.filter("root is not null").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(CLASS_SALTS)).cast("int")).join(named.hint("merge"), ["root", "salt"])
    per_text = several.select("key", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links")).unionByName(
        known.filter("root is null").select("key", F.col("key").alias("root"), F.col("least").alias("class_id"), (F.col("copies") - 1).alias("n_links"))
    )
    blank = ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("key"), blank.alias("blank"))
    return own.join(per_text.hint("merge"), "key").select(
        "doc_id",
        F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("blank"), F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
        "key",
        F.when(~F.col("blank"), F.col("root")).alias("root"),
    )


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the least doc_id, one without id last, then the least text digest, with
    the columns of `docs`. Documents without words stay."""
    classes = near_duplicates(docs, doc_id, text)
    best = classes.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x"))
    best = best.select("x.key", F.col("x.doc_id").alias("best_id"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.unhex(F.md5(t)).alias("key"), (~t.rlike(r"[^\x20\x09-\x0D]")).alias("blank"))
    stay = rows.filter("blank").select("row")
    # a text is in one class, so its key tells the class; of rows with that id and text one stays
    chosen = rows.filter("not blank").join(best.hint("merge"), "key").filter("doc_id <=> best_id").dropDuplicates(["key"]).select("row")
    return stay.unionByName(chosen).select("row.*")
