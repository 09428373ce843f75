"""Best-fit packing, resampling and whitening against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import best_fit, resampling, whitening
from lintlake.llm.tokens import DEFAULT_TOKENIZER
from tests.llm.test_llm import SCHEMA, rows_of


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


def bins_one_by_one(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(rooms, n)
        bins += i == len(rooms)
        room = capacity - n if i == len(rooms) else rooms.pop(i) - n
        if room:
            insort(rooms, room)
    return bins


def test_tree_finds_the_tightest_bin():
    tree = best_fit.CapacityTree(100)
    assert tree.tightest(1) is None
    for room in (40, 7, 99):
        tree.put(room, 0, 1)
    assert [tree.tightest(n) for n in (1, 7, 8, 40, 41, 99, 100)] == [7, 7, 40, 40, 99, 99, None]
    tree.take(40)
    assert tree.tightest(8) == 99


@pytest.mark.parametrize("seed", range(30))
def test_steps_are_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 16, 64, 1000])
    counts = {r.randint(1, capacity): r.choice([1, 2, 3, r.randint(1, 400)]) for _ in range(r.randint(0, 40))}
    assert best_fit.steps(counts, capacity)[1] == bins_one_by_one([n for n, k in counts.items() for _ in range(k)], capacity)


def check_bins(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by) == bins_one_by_one([r.length for r in rows], capacity)


@pytest.mark.parametrize("capacity", [1024, 100])
def test_best_fit_of_documents(odd, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(DEFAULT_TOKENIZER)
    got = best_fit.best_fit(best_fit.token_pieces(odd, capacity=capacity), capacity=capacity).collect()
    check_bins(got, capacity)
    want = Counter()
    for r in rows_of():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(r[0], n, a, np.array(ids[a:b], "<u4").tobytes(), len(ids))] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids), r.doc_tokens) for r in got) == want


def test_best_fit_keeps_any_columns(spark):
    rows = [(1 + i % 5, "x", i, i) for i in range(200)]
    pieces = spark.createDataFrame(rows, "length int, `a.b` string, `at` int, `offset` int").repartition(4)
    got = best_fit.best_fit(pieces, capacity=9)
    assert got.columns == ["length", "a.b", "at", "sequence_id", "offset"]
    assert sorted((r.length, r.at) for r in got.collect()) == sorted((a, c) for a, _, c, _ in rows)
    check_bins(got.collect(), 9)
    assert best_fit.best_fit(pieces.limit(0)).count() == 0
    for wrong in (0, 10, None):
        with pytest.raises(Exception, match="lengths are 1 to 9"):
            best_fit.best_fit(spark.createDataFrame([(wrong,)], "length int"), capacity=9).count()


def test_op11(spark, small):
    from lintlake.llm.queries import queries

    got = queries()["op11_best_fit"](spark, small).collect()
    check_bins(got, 1024)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.piece, r.start, r.length, r.doc_tokens))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == list(range(len(parts)))
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
        assert sum(p[2] for p in parts) == parts[0][3]
        assert all(p[2] == 1024 for p in parts[1:])


def plain_weights(texts, target, longest, buckets):
    def runs(t):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)

    s, t = (Counter(zlib.crc32(f) % buckets for x in xs for f in runs(x)[0]) for xs in (texts, target))
    odds = lambda b: (t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))
    return [(runs(x)[1], len(runs(x)[0]), sum(math.floor(1000 * math.log(odds(zlib.crc32(f) % buckets))) for f in runs(x)[0])) for x in texts]


@pytest.mark.parametrize(("longest", "buckets", "broadcast"), [(1, 10_000, 20_000), (2, 500, 20_000), (3, 10_000, 5)])
def test_weights(spark, odd, monkeypatch, longest, buckets, broadcast):
    monkeypatch.setattr(resampling, "BROADCAST_ROWS", broadcast)  # nearly all strings by shuffle, too
    monkeypatch.setattr(resampling, "COUNTED", 300)
    target = ["Alpha beta, gamma1 delta2", None, "ünïcödé wörds"]
    got = resampling.weights(odd, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets)
    texts = [r[1] for r in rows_of()]
    want = plain_weights(texts, target, longest, buckets)
    assert Counter((r.row.doc_id, r.row.text, r.n_words, r.n_features, r.weight) for r in got.collect()) == Counter((r[0], r[1], *w) for r, w in zip(rows_of(), want, strict=True))
    assert got.select("row.*").columns == odd.columns


def plain_ranks(rows, percent, least):
    """rows: (place, id, words, weight)."""
    score = {}
    for place, key, _, weight in rows:
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score[place] = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    fit = sorted((r for r in rows if r[2] >= least), key=lambda r: (-score[r[0]], r[1] is None, r[1] or 0, r[0]))
    return score, {r[0]: i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}


def test_resample_ranks(spark):
    r = random.Random(3)
    rows = [(i, None if i % 50 == 0 else r.randrange(300), r.randrange(40), r.choice([0, 0, 5000, -700])) for i in range(900)] + [(900 + i, 7, 30, 0) for i in range(500)]
    weighted = spark.createDataFrame(rows, "at long, doc_id long, n_words long, weight long").repartition(6).select(F.struct("doc_id", F.col("at").alias("place")).alias("row"), "at", "n_words", F.lit(1).alias("n_features"), "weight")
    for percent, least in ((10, 20), (100, 1), (1, 41)):
        got = resampling.resample(weighted, percent=percent, least_words=least).collect()
        score, rank = plain_ranks(rows, percent, least)
        assert {g.row.place: (g.score, g["rank"]) for g in got} == {p: (score[p], rank.get(p)) for p in score}
    assert resampling.resample(weighted.limit(0)).count() == 0


def test_op12(spark, small):
    from lintlake.llm.queries import queries

    docs, target = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    weights = plain_weights([d.text for d in docs], [b.text for b in target], 1, 10_000)
    score, rank = plain_ranks([(d.doc_id, d.doc_id, w[0], w[2]) for d, w in zip(docs, weights, strict=True)], 10, 20)
    got = queries()["op12_resampling"](spark, small).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d.doc_id, w[1], w[2], score[d.doc_id], rank.get(d.doc_id)) for d, w in zip(docs, weights, strict=True)), key=repr)


def test_resampling_of_empty_tables(spark, odd):
    none = spark.createDataFrame([], "text string, `a.b` int")
    assert resampling.resample(resampling.weights(none, none), doc_id="a.b").count() == 0
    assert resampling.weights(odd, none).count() == odd.count()


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [math.nan] * 12), (903, [math.inf] + [0.0] * 11), (904, []), (905, [0.5] * 5), (906, [1e30] * 12)]
    return [*rows, rows[3], rows[3], (None, rows[4][1])], bad


def test_whitening(spark):
    good, bad = vectors()
    df = spark.createDataFrame(good + bad, "vec_id long, `a.b` array<double>").withColumn("grid", F.lit("mine")).withColumn("big", F.when(F.col("vec_id") != 3, F.lit((1 << 62) + 1))).repartition(5)
    rows, fitted = whitening.whiten(df, "a.b", components=8)
    x = np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100_000
    n = len(x)
    off = n * x - x.sum(0)
    covariance = (off / n).T @ (off / n) / n
    e, u = np.linalg.eigh(covariance)
    assert fitted.n == n
    assert fitted.sums == x.sum(0).tolist()
    assert np.allclose(fitted.eigenvalues, e[::-1], rtol=1e-9)
    assert fitted.trace == pytest.approx(np.trace(covariance))
    want = (off / n) @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    by_id = {good[i][0]: (int((off[i].astype(object) ** 2).sum()), np.abs(want[i])) for i in range(n)}
    got = rows.collect()
    assert Counter(r.vec_id for r in got) == Counter(i for i, _ in good)
    assert rows.columns == ["vec_id", "a.b", "grid", "big", "deviation", "whitened"]
    assert {r.big for r in got} == {None, (1 << 62) + 1}
    for r in got:
        assert r.deviation == by_id[r.vec_id][0]
        assert np.allclose(np.abs(r.whitened), by_id[r.vec_id][1], atol=1e-9)
    assert whitening.identity_error(rows, fitted) < 1e-9


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")
    rows, fitted = whitening.whiten(flat)
    assert fitted.flat.tolist() == [False, True, True]
    assert [z is None for z in rows.first().whitened] == [False, True, True]
    assert whitening.identity_error(rows, fitted) < 1e-9
    one, of_one = whitening.whiten(flat.limit(1))
    assert one.first().deviation == 0
    assert whitening.identity_error(one, of_one) is None
    none, nothing = whitening.whiten(flat.limit(0))
    assert (none.count(), nothing) == (0, None)


def test_large_sums_of_squares():
    v = np.array([[3, -(1 << 51), 12345678901], [0, 0, 0]], np.int64)
    assert whitening._squares(v) == [sum(int(x) ** 2 for x in r) for r in v]


def test_op13(spark, small):
    from lintlake.llm.queries import queries

    got = queries()["op13_whitening"](spark, small).collect()
    assert len(got) == 8 * spark.read.parquet(f"{small}/embeddings.parquet").count()
    assert {r.component for r in got} == set(range(1, 9))
    assert {r.identity_error for r in got} == {got[0].identity_error}
    assert got[0].identity_error < 1e-4
    assert all(r.deviation == int(r.deviation_exact) for r in got)


def test_weights_hands_out_few_rows_at_once(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.weights(d, d).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
