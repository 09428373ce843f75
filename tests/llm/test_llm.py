"""Training-data operators against brute force, on a table of odd rows and on the small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lintlake.llm import bpe, gif, licenses, near_duplicates, packing, quality, queries, sharding, substrings, token_counts, tokens, toxicity
from lintlake.llm.components import components
from lintlake.llm.tokens import DEFAULT_TOKENIZER

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, row int, words int, class_id int, signature string, hash string, depth int, "
    "score string, counts string, m string, kept string, `a b` string, ids string, decoded string, base_failed string, shard string, overflow string, `a.b` string, `_` string, cell string, bytes string"
)


CLASHES = ("x",) * 14


def rows_of():
    r = random.Random(7)
    words = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(400)) for _ in range(n))
    base, passage = words(300), words(60)
    near = base.split(" ")
    near[150] = "changed"
    texts = [
        None, "", "   \n\t", "one", "one", "one two", base, base, " ".join(near), words(120) + " " + passage + " " + words(80), passage + "\n" + words(100), "a " * 400, "x y z " * 200,
        words(30_000), "Ünïcödé     wörds 🙂 " * 20, "<|endoftext|> don't  stop\r\n\r\n  now", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", words(60), words(60) + " ####",
    ]
    rows = [(i, t, "en", "h1" if i % 2 else None, len(t or ""), "k", 1, 2, 3, "s", "h", 9, *CLASHES) for i, t in enumerate(texts)]
    return [*rows, (None, base, *[None] * 24), rows[6]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(DEFAULT_TOKENIZER)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, small, duck, name):
    got = queries.queries()[name](spark, small)
    names = sorted(got.columns)
    answer = duck.sql(queries.oracle_sql()[name])
    at = [answer.columns.index(c) for c in names]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in answer.fetchall()), key=repr)


def test_token_counts(odd, none, library):
    n = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in rows_of()]
    got = {r.n_tokens: r for r in token_counts.context_answers(token_counts.length_histogram(odd), stripe=64).collect()}
    assert {k: r.n_docs for k, r in got.items() if r.n_docs} == Counter(n)
    for k, r in got.items():
        assert (r.docs_ge, r.tokens_ge, r.truncated_tokens) == (sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n))
    for q in token_counts.QUANTILES:
        assert [k for k, r in got.items() if q in r.quantiles] == [next(x for x in sorted(n) if sum(y <= x for y in n) >= q * len(n))]
    assert {r.docs_ge for r in token_counts.context_answers(token_counts.length_histogram(none)).collect()} == {0}


def test_gif_round_trip(odd, none):
    media = gif.texts_to_gifs(odd)
    got = gif.stored_features(media).collect()
    want = Counter()
    for r in rows_of():
        raw = (r[1] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        want[(r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert gif.stored_features(gif.texts_to_gifs(none)).count() == 0


def test_gif_rules(spark):
    rng = np.random.default_rng(1)
    palette = rng.integers(0, 256, (256, 3), dtype=np.uint8)
    first, second = rng.integers(0, 256, (40, 30), dtype=np.uint8), np.zeros((10, 10), np.uint8)
    data = gif.encode_gif([first, second], palette, delay_cs=7, disposal=2)
    frames = gif.decode_gif(data)
    assert [f.delay_cs for f in frames] == [7, 7]
    assert np.array_equal(frames[0].screen[:, :, :3], palette[first])
    assert not frames[1].screen[20:, :].any()  # the first frame was cleared
    keep = gif.decode_gif(gif.encode_gif([first, second], palette, disposal=1))
    assert np.array_equal(keep[1].screen[20:, :, :3], palette[first][20:])
    rows = gif.gif_frames(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no gif")), (3, None)], "id int, media binary"), "id").collect()
    assert sorted((r.key, r.frame, r.start_cs, r.error is None) for r in rows if r.key == 1) == [(1, 0, 0, True), (1, 1, 7, True)]
    assert all(r.error for r in rows if r.key != 1)


def test_stored_feature_is_of_the_composed_screens(spark):
    text = "".join(chr(32 + i % 90) for i in range(192 * 700))  # a frame of 512 rows, then one of 188
    first = np.frombuffer(text.encode(), np.uint8)
    screens = [first[: 192 * 512], np.concatenate([first[192 * 512 :], first[192 * 188 : 192 * 512]])]
    want = [0] * 65
    for screen in screens:
        for grey, n in Counter(screen.tolist()).items():
            want[grey // 64 * 21] += n
    row = gif.stored_features(gif.texts_to_gifs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (row.feature, row.n_frames, row.duration_cs) == (",".join(map(str, want)), 2, 20)
    # disposal and transparency count, and the digest is of the raw samples
    a, b = np.full((4, 4), 200, np.uint8), np.zeros((2, 2), np.uint8)
    cleared = gif.encode_gif([a, b], gif.GREYS, disposal=2)
    seen = cleared[:-1].replace(b"\x21\xf9\x04\x08", b"\x21\xf9\x04\x09") + b"\x3b"
    rows = spark.createDataFrame([(1, 20, bytearray(cleared)), (2, 20, bytearray(seen))], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in gif.stored_features(rows).collect()}
    cells = lambda r: {i: n for i, n in enumerate(map(int, r.feature.split(","))) if n}
    assert cells(got[1]) == {63: 16, 0: 4, 64: 12} and cells(got[2]) == {63: 16, 64: 16}
    assert got[1].payload_sha256 == hashlib.sha256(a.tobytes() + b.tobytes()).hexdigest()
    assert got[1].tail_crc32 == zlib.crc32((a.tobytes() + b.tobytes())[-16:])


@pytest.mark.parametrize("bits", [2, 5, 8])
def test_lzw_against_a_plain_decoder(bits):
    data = bytes(random.Random(bits).choices(range(1 << bits), k=9000)) + bytes(5000)
    assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, len(data)) == data


def test_quality_keeps_columns(odd, none):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {6, 8, 9, 13, 17} <= ids
    assert not ids & {0, 1, 2, 3, 11, 12}
    assert quality.keep_good(none).count() == 0


def test_host_rates_shrink(spark):
    rows = [("big", i < 200) for i in range(1000)] + [("tiny", True)] + [(f"h{h}", i < 10) for h in range(20) for i in range(50)]
    judged = spark.createDataFrame(rows, "source string, base_failed boolean").withColumn("soft_failures", F.lit(0))
    rates = {r.host: r.host_rate for r in quality.host_rates(judged).collect()}
    assert rates["big"] == pytest.approx(0.2, abs=0.01)
    assert rates["tiny"] < 0.6  # one document says little


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("you are an idiot", 1), ("what an idiot", 0), ("he is not an idiot", 4), ('she said he is an "idiot"', 5), ("I will kill you", 3), ("to kill time", 2), ("all is well", None),
        ("trash trash trash", 0), ("an idiot you are not", 4), ('"You idiot", she said.', 5), ("idiot that you are", 1), ("not so. an idiot", 0),
    ],
)
def test_grammar(text, kind):
    counts = toxicity.Grammar().counts(text)
    assert counts == [int(i == kind) for i in range(6)]


def plain_kinds(text):
    """The grammar said again without machines: each sentence's clauses are looked at whole."""
    out = [0] * 6
    lexicon = [(toxicity.INSULTS, "i"), (toxicity.THREATS, "t"), (toxicity.TARGETS, "y"), (toxicity.NEGATIONS, "n"), (toxicity.REPORTS, "r")]
    of = lambda w: "," if w in ",:" else next((s for words, s in lexicon if w in words), "o")
    for sentence in re.split(r"[.!?;\n]+", text.lower()):
        signs = [of(w) for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[,:]", sentence)]
        for i, s in enumerate(signs):
            lo = max((j + 1 for j in range(i) if signs[j] == ","), default=0)
            hi = min((j for j in range(i, len(signs)) if signs[j] == ","), default=len(signs))
            if s not in "it" or s in signs[lo:i]:
                continue
            close = lambda sign, n: sign in signs[max(lo, i - n) : min(hi, i + n + 1)]
            if "r" in signs[:i] or "r" in signs[hi:]:
                out[5] += 1
            elif close("n", 3):
                out[4] += 1
            else:
                out[(0 if s == "i" else 2) + close("y", 5)] += 1
    return out


def test_grammar_against_plain_rules():
    r = random.Random(4)
    grammar = toxicity.Grammar()
    words = "idiot trash kill you they not never said wrote tree sun , : . a b c d e".split()
    for _ in range(3000):
        text = " ".join(r.choices(words, k=r.randrange(1, 25)))
        assert grammar.counts(text) == plain_kinds(text), text


def test_further_arcs_count():
    """A text with more threats scores higher, however many there are."""
    counts = np.zeros((6, len(toxicity.KINDS)))
    counts[:, toxicity.KINDS.index("threat_target")] = [0, 1, 4, 5, 40, 400]
    scores = toxicity.weigh(counts, toxicity.PRIOR)
    assert (np.diff(scores) > 0).all()


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = odd.select("doc_id", F.lit(0).alias("toxic"))
    model = toxicity.learn(odd, labels)
    scored = toxicity.score(odd, *model)
    assert set(scored.columns) == set(odd.columns) and scored.count() == odd.count()
    assert all(0 <= r.score <= 1 and len(r.counts) == 6 for r in scored.collect())
    kept = toxicity.keep_civil(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.score(none, *model).count() == 0
    assert np.array_equal(toxicity.learn(none, none.select("doc_id", F.lit(1).alias("toxic")))[1], toxicity.PRIOR)


def test_lexicon_counts_copies_once(spark):
    r = random.Random(6)
    clean = [f"c{r.choice('abcdefgh')}{r.choice('abcdefgh')}x" for _ in range(3000)]
    rows = [(i, " ".join(r.sample(clean, 30)), 0) for i in range(300)]
    copy = " ".join(r.sample(clean, 30)) + " qqqjunk"
    rows += [(1000 + i, copy if i % 2 else copy + f" z{i}", 1) for i in range(60)]  # copies and near copies
    rows += [(2000 + i, " ".join([*r.sample(clean, 15), "zorgle", *r.sample(clean, 15)]), 1) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = toxicity.learn(d.select("doc_id", "text"), d.select("doc_id", "toxic"))[0]
    assert any("zorgle".startswith(w.rstrip("*")) for w in learned) and not any("qqqjunk".startswith(w.rstrip("*")) for w in learned)


def test_toxicity_sends_a_text_to_its_workers_once(spark, none):
    d = spark.createDataFrame([(i, f"you idiot {i}" if i % 2 else f"a fine day {i}", "x") for i in range(2500)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = toxicity.keep_civil(d, labels)
    assert kept.columns == d.columns
    assert 1000 < kept.count() < 2500
    line = next(x for x in kept._jdf.queryExecution().analyzed().toString().splitlines() if "struct(" in x)
    assert line.count("text") == 2, line  # the field and its name
    scored = toxicity.score(d.drop("score"), [], toxicity.PRIOR)
    assert scored.count() == 2500
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_toxicity_learns_and_keeps_out_held_out_rows(spark, none):
    r = random.Random(3)
    clean = lambda: [r.choice("one two three four five six".split()) for _ in range(40)]
    docs = [(i, " ".join(clean() + ["glorbak", r.choice(["you", "glorbak"])] * (i % 4 == 0))) for i in range(800)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.learn(d, labels)
    assert any(w in ("glorbak", "glor*") for w in model[0])
    assert all((x.score >= 0.5) == (x.doc_id % 4 == 0) for x in toxicity.score(d, *model).collect())
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(toxicity.learn(d, flipped)[1], model[1])
    assert {x.doc_id: zlib.crc32(str(x.doc_id).encode()) % 5 == 0 for x in d.limit(50).collect()} == {
        x.doc_id: x.h for x in d.limit(50).select("doc_id", toxicity.is_held_out("doc_id").alias("h")).collect()
    }
    assert toxicity.keep_civil(none, labels).count() == 0


def jaccard_classes(rows):
    sets = {}
    for _, t, *_ in rows:
        w = (t or "").encode().split()
        sets[t or ""] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    texts = [t for t in sets if sets[t]]
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    links = Counter()
    copies = Counter(t or "" for _, t, *_ in rows)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[top(a)] = top(b)
                links[a] += copies[b]
                links[b] += copies[a]
    least = {}
    for k, t, *_ in rows:
        if k is not None and sets[t or ""]:
            least[top(t)] = min(k, least.get(top(t), k))
    return Counter((k, least[top(t)], links[t] + copies[t] - 1) if sets[t or ""] else (k, k, 0) for k, t, *_ in rows)


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(odd, none, block):
    got = near_duplicates.near_duplicates(odd, block=block).select("doc_id", "class_id", "n_links")
    assert Counter(map(tuple, got.collect())) == jaccard_classes(rows_of())
    assert near_duplicates.near_duplicates(none).count() == 0


def thue_morse(a, b, n):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


def test_long_words_differ(spark):
    """Words that a sum by powers takes for equal."""
    one, two = thue_morse("a", "b", 4096), thue_morse("b", "a", 4096)
    texts = [" ".join([w, *(f"w{i}" for i in range(40))][-35:] + [w]) for w in (one, two)] + [" ".join([w] * 3) for w in (one, two)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, near_duplicates.near_duplicates(d).select("doc_id", "class_id", "n_links").collect())) == jaccard_classes(list(enumerate(texts)))
    alone = spark.createDataFrame([(i, " ".join([w, *(f"w{i}" for i in range(34))])) for i, w in enumerate((one, two))], "doc_id long, text string")
    assert [r.n_removed for r in substrings.dedup_substrings(alone).collect()] == [0, 0]


def test_prefixes_are_shortened(spark):
    """Pairs at the threshold need shorter prefixes than copies that differ in one word."""
    def links(edits):
        r, rows = random.Random(edits), []
        for g in range(150):
            words = [f"w{r.randrange(10**6)}" for _ in range(100)]
            rows.append((2 * g, " ".join(words)))
            for at in range(edits):
                words[at] = f"e{g}"
            rows.append((2 * g + 1, " ".join(words)))
        keyed = near_duplicates._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "text")
        trees = near_duplicates.written(near_duplicates.forest(keyed, 5, 24, 8), "forest")
        recall = [near_duplicates.estimated_recall(near_duplicates.written(near_duplicates.prefix_links(trees, d, 0.8, 192), "links"), d, 0.8, 24) for d in (8, 6)]
        return recall
    close, far = links(1), links(7)
    assert close[0] > 0.9995 and far[0] < 0.9995 < far[1]


def test_unlike_texts_of_one_prefix_stay_unlinked(spark):
    """Depth 0: all texts share the prefix, over all ranges. Only alike ones may be linked, in whichever range they are."""
    r, rows = random.Random(5), []
    for i in range(2000):
        rows.append((i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))))
    pairs = []
    for i in range(0, 200, 2):  # near copies lie in other ranges than their texts, as signatures differ
        words = rows[i][1].split(" ")
        words[30 + i % 20] = "changed"
        pairs.append((rows[i][1], " ".join(words)))
        rows.append((5000 + i, " ".join(words)))
    keyed = near_duplicates._keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "text")
    trees = near_duplicates.written(near_duplicates.forest(keyed, 5, 24, 8).filter("tree = 3"), "forest")
    links = near_duplicates.prefix_links(trees, 0, 0.8, 192).collect()
    key = {t: hashlib.md5(t.encode()).digest() for _, t in rows}
    alike = {frozenset((key[a], key[b])) for a, b in pairs}
    assert alike <= {frozenset((bytes(x.a), bytes(x.b))) for x in links}
    assert len(links) < 1.5 * len(alike)  # of 2,200,000 pairs; within a range one bit of each value may mislead


def test_leaders_keep_alike_texts_connected():
    r = random.Random(8)
    bits = [np.array([r.getrandbits(64) for _ in range(3)], np.uint64) for _ in range(4)]
    rows = []
    for i in range(300):
        own = bits[i % 4].copy()
        for _ in range(r.randrange(12)):
            own[r.randrange(3)] ^= np.uint64(1 << r.randrange(64))
        rows.append((str(i).encode(), own.tobytes()))
    leaders, root = near_duplicates.Leaders(192, 0.8, 0.4), {k: k for k, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    leaders.start(*rows[0])
    n = 0
    for row in rows[1:]:
        for a, b, _ in leaders.add(*row):
            n += 1
            root[top(a)] = top(b)
    similar = lambda x, y: 1 - 2 * sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), strict=True)) / 192
    assert all(top(a) == top(b) for a, x in rows for b, y in rows if similar(x, y) >= 0.8)
    assert n < len(rows)


def test_near_duplicate_recall(spark):
    r = random.Random(5)
    rows = []
    for g in range(120):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows.append((2 * g, " ".join(words)))
        for at in r.sample(range(200), 3):
            words[at] = "edited"
        rows.append((2 * g + 1, " ".join(words)))
    got = Counter(map(tuple, near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id", "n_links").collect()))
    assert sum((got & jaccard_classes(rows)).values()) >= 0.99 * len(rows)


def test_keep_one(odd, none):
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r.doc_id for r in kept.collect())
    # a copy without id goes like any other: of each class one document stays
    assert ids[6] == 1 and not ids[7] and not ids[8] and not ids[None] and ids[3] == 1 and not ids[4] and ids[0] == ids[1] == 1
    assert near_duplicates.keep_one(none).count() == 0


def test_keep_one_of_each_class_whatever_its_ids(spark):
    r = random.Random(3)
    text = [" ".join(f"t{r.randrange(10**6)}" for _ in range(100)) for _ in range(5)]
    near = text[3].rsplit(" ", 1)[0] + " other"
    rows = [(1, text[0]), (1, text[1]), (2, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (None, near), (None, text[4]), (9, text[4]), (None, " "), (None, None)]
    kept = [(x.doc_id, x.text) for x in near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    either = [x for x in kept if x[1] in (text[3], near)]
    assert len(either) == 1 and either[0][0] is None
    assert Counter(x for x in kept if x not in either) == Counter([(1, text[0]), (1, text[1]), (None, text[2]), (9, text[4]), (None, " "), (None, None)])


def test_components(spark):
    r = random.Random(1)
    chain = [(f"a{i:04}", f"a{i + 1:04}") for i in range(300)] + [("b", "c"), ("c", "b"), ("d", "d")]
    r.shuffle(chain)
    got = {x.node: x.root for x in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"a{i:04}": "a0000" for i in range(301)} | {"b": "b", "c": "b"}


def brute_substrings(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = Counter()
    for (k, *_), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if n[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out[(k, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode())] += 1
    return out


@pytest.mark.parametrize("hot", [0, 2000])
def test_substrings(odd, none, hot):
    got = substrings.dedup_substrings(odd, hot_pieces=hot)
    assert Counter(map(tuple, got.collect())) == brute_substrings(rows_of(), 35)
    assert substrings.dedup_substrings(none).count() == 0


def test_suffix_automaton():
    r = random.Random(2)
    texts = ["".join(r.choices("ab", k=r.randrange(1, 30))) for _ in range(40)]
    automaton = substrings.SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    automaton.count()
    for t in texts[:10] + ["abba", "c"]:
        for least in (1, 2, 5):
            places = lambda s: sum(x[i:].startswith(s) for x in texts for i in range(len(x)))
            want = [max(n for n in range(i + 2) if not n or places(t[i + 1 - n : i + 1]) >= least) for i in range(len(t))]
            assert list(automaton.matches(t, least)) == want


def test_strip_reference(spark, odd):
    passage = next(t for i, t, *_ in rows_of() if i == 9).split()
    got = {r.doc_id: r for r in substrings.strip_reference(odd, spark.createDataFrame([(" ".join(passage[110:190]),)], "text string")).collect()}
    assert got[9].n_removed == 80 and got[17].n_removed == 0


def test_strip_repeats(odd, none):
    out = substrings.strip_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[15].text == rows_of()[15][1] and rows[6].text == "" and rows[9].n_chars == len(rows[9].text)
    assert substrings.strip_repeats(none).count() == 0


def test_packing(odd, none, library):
    pieces = packing.pack_documents(odd, pool_tokens=4096).collect()
    want = Counter()
    for r in rows_of():
        want[(r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    by_doc = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for (doc, n), ps in by_doc.items():
        copies = sum(c for (d, ids), c in want.items() if d == doc and len(ids) == 4 * n)
        assert sum(p.length for p in ps) == n * copies
        if copies == 1:
            assert (doc, b"".join(p.ids for p in ps)) in want
    for s in {p.sequence_id for p in pieces}:
        own = sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
        assert sum(p.length for p in own) == own[0].window <= 2048
    assert packing.pack_documents(none).count() == 0


def test_bpe(odd, none, library):
    got = bpe.decode(bpe.encode(odd)).collect()
    want = Counter()
    for r in rows_of():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert bpe.decode(bpe.encode(none)).count() == 0


def plain_shards(sizes, limit):
    """Shards of (hash, size) rows: a bucket splits on its next bit only while it is over the limit."""
    out, todo = {}, [("", sizes)]
    while todo:
        prefix, rows = todo.pop()
        if sum(n for _, n in rows) <= limit or len(prefix) == sharding.HASH_BITS:
            out[prefix] = rows
            continue
        for bit in "01":
            part = [(h, n) for h, n in rows if format(h, f"0{sharding.HASH_BITS}b")[len(prefix)] == bit]
            if part:
                todo.append((prefix + bit, part))
    return out


@pytest.mark.parametrize("limit", [700, 5000, 10**9])
def test_sharding_against_a_plain_directory(spark, limit):
    r = random.Random(limit)
    rows = spark.createDataFrame([(i, r.randrange(400)) for i in range(500)], "k long, n long")
    hashed = [(x.h, x.n) for x in rows.select(sharding.hash_of("k").alias("h"), "n").collect()]
    got = sharding.shard_sizes(sharding.assign_shards(rows, "n", ["k"], limit=limit, first_bits=3, round_bits=2), "n").collect()
    assert {(x.shard, x.depth, x.shard_rows, x.shard_bytes) for x in got} == {(p, len(p), len(v), sum(n for _, n in v)) for p, v in plain_shards(hashed, limit).items()}


def test_sharding(odd, none):
    rows = odd.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("t"), "hash", "shard", "depth")
    out = sharding.assign_shards(rows, "n", ["doc_id", "t"], limit=5000, first_bits=2, round_bits=2)
    sizes = sharding.shard_sizes(out, "n").collect()
    assert out.count() == odd.count()
    assert all(s.shard_bytes <= 5000 or s.shard_rows == 1 for s in sizes)
    shards = [s.shard for s in sizes if not s.overflow]
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert sharding.assign_shards(none.select("doc_id", F.lit(1).alias("n")), "n", ["doc_id"]).count() == 0


def test_sharding_keeps_all_columns(odd):
    out = sharding.assign_shards(odd, "n_chars", ["doc_id", "a.b"], limit=5000, first_bits=2, round_bits=2)
    assert out.columns == [*(c for c in odd.columns if c not in ("depth", "shard", "overflow")), "depth", "overflow", "shard"]
    assert {(r["a.b"], r["_"], r.cell, r.hash, r.bytes) for r in out.collect()} == {("x",) * 3 + ("h", "x"), (None,) * 5}


@pytest.mark.parametrize("size", [100, 300, 999, 1000, 1500])
def test_pages_of_equal_rows_keep_the_limit(spark, size):
    rows = spark.range(50).select(F.lit(1).alias("k"), F.lit(size).alias("n"))
    sizes = sharding.shard_sizes(sharding.assign_shards(rows, "n", ["k"], limit=1000, first_bits=2), "n").collect()
    assert sum(s.shard_rows for s in sizes) == 50 and all(s.shard_bytes <= 1000 or s.shard_rows == 1 for s in sizes)


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    rows = odd.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    out = sharding.assign_shards(rows, "n", ["doc_id", "text"], limit=5000)
    sharding.write_shards(out, str(tmp_path / "shards"))
    back = sharding.read_shards(spark, str(tmp_path / "shards"), out.schema)
    assert Counter((r.doc_id, r.text, r.shard, r.depth) for r in back.collect()) == Counter((r.doc_id, r.text, r.shard, r.depth) for r in out.collect())


def test_licenses(odd, none):
    rows = {r.doc_id: r for r in licenses.scan(odd).collect()}
    for doc, text, *_ in rows_of()[:19]:
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))) if w]
        places = [i for p, _ in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels = {label for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
        r = rows[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(none).count() == 0


def test_licenses_find_altered_notices(spark):
    text = "zz permission is hereby now granted free of charge to any person obtaining a copy of this great software and associated documentation files yy"
    rows = licenses.scan(spark.createDataFrame([(1, text), (2, "permission is hereby refused"), (3, "under cc by " * 4), (4, "under cc by zz zz zz " * 400)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.n_base) for r in rows] == [("mit", 0), ("", 0), ("", 0), ("", 0)]


def test_quality_replaces_its_columns(odd, none):
    judged = quality.judge(quality.measure(odd))
    assert set(judged.columns) == {*odd.columns, "soft_failures"} and judged.count() == odd.count()
    kept = quality.verdicts(judged)
    assert kept.filter("kept").count() == quality.keep_good(odd).count()
    assert quality.verdicts(quality.judge(quality.measure(none))).count() == 0


def test_decode_replaces_its_column(odd, none):
    got = bpe.decode(bpe.encode(odd).withColumn("decoded", F.lit("x")).withColumn("a b", F.lit(1)))
    assert got.columns == ["doc_id", "ids", "a b", "decoded"] and got.count() == odd.count()
    both = bpe.encode_and_decode(odd)
    assert Counter(map(tuple, both.collect())) == Counter((r.doc_id, r.ids, r.decoded) for r in got.collect())
    assert bpe.encode_and_decode(none).count() == 0


def test_bpe_of_odd_texts(library):
    r = random.Random(9)
    parts = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "é", "🙂", "don't", "<|endoftext|>", "\u3000", "\x1c", "7", "123", "_", "#", "Ünï", "ab", " ab", "\xa0", "'s"]
    texts = ["".join(r.choices(parts, k=r.randrange(30))) for _ in range(20_000)]
    enc, fast = bpe.PairIndexEncoder(DEFAULT_TOKENIZER, full=100_000), tokens.Encoder(DEFAULT_TOKENIZER, full=100_000)
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        want = [np.array(x.ids, "<u2").tobytes() for x in library.encode_batch(part, add_special_tokens=False)]
        assert want == list(enc.batch(part)) == list(fast.batch(part))
        assert enc.cache.bytes <= 100_000


def test_bpe_of_a_long_word(library):
    text = "".join(random.Random(2).choices("abcdefghij", k=5_000_000))
    raw = next(bpe.PairIndexEncoder(DEFAULT_TOKENIZER).batch([text]))
    ids = np.frombuffer(raw, "<u2")
    assert raw == np.array(library.encode(text, add_special_tokens=False).ids, "<u2").tobytes() and ids.size > 10**6


def test_gif_header_that_asks_for_too_much():
    with pytest.raises(gif.GifError):
        gif.decode_gif(b"GIF89a\xff\xff\xff\xff\0\0\0\x3b")


def plain_repeat_words(words):
    n = Counter(zip(words, words[1:], words[2:]))
    return len({j for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)})


def plain_pipeline(rows, toxic_words, library):
    """The five stages over (doc_id, text, source) in plain Python: (doc_id, ids) that are packed."""
    good, hosts = [], {}
    for row in rows:
        text = row[1] or ""
        words = text.split()
        lines = [x for x in text.split("\n") if x.split()]
        soft = (sum(text.count(c) for c in "#*$%&|<>") > 0.1 * len(words)) + (len(lines) - len(set(lines)) > 0.3 * len(lines)) + (not 2 <= len("".join(words)) / max(1, len(words)) <= 15)
        base = len(words) < 50 or 100 * plain_repeat_words(words) > 50 * len(words)
        hosts.setdefault(row[2], []).append(base or soft > 0)
        good.append((row, base, soft))
    # hosts of these rows are far from 0.5 on either side, whatever the prior adds
    bad = {h for h, failed in hosts.items() if sum(failed) > 0.5 * len(failed)}
    rows = [r for r, base, soft in good if not base and soft <= (0 if r[2] in bad else 1)]
    rows = [r for r in rows if not any(w in (r[1] or "") for w in toxic_words)]
    classes = {}
    sets = [{tuple(r[1].split()[i : i + 5]) for i in range(len(r[1].split()) - 4)} for r in rows]
    for i, r in enumerate(rows):
        home = next((c for c, members in classes.items() if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in members)), i)
        classes.setdefault(home, []).append(i)
    rows = [min((rows[j] for j in members), key=lambda r: (r[0] is None, r[0] or 0)) for members in classes.values()]
    out = Counter()
    for (doc, n, removed, kept), k in brute_substrings([(r[0], r[1]) for r in rows], 35).items():
        text = next(r[1] for r in rows if r[0] == doc and len(r[1].split()) == n) if not removed else kept
        out[(doc, np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes())] += k
    return out


def test_pipeline_against_brute_force(spark, library, tmp_path):
    r = random.Random(12)
    words = lambda n: [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.choice('klmnp')}{r.randrange(900)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(60):
        text = words(r.randrange(60, 200))
        if i % 6 == 0:  # toxic: enough of them, each in other words, to be learned from
            for _ in range(3):
                text.insert(r.randrange(len(text)), "idiot")
        rows.append((i, " ".join(text), f"h{i % 3}"))
        labels.append((i, 0, int(i % 6 == 0)))
    passage, near = words(70), rows[1][1].split()
    near[30] = "changed"
    rows += [
        (100, rows[1][1], "h1"), (101, " ".join(near), "h1"), (None, rows[2][1], "h2"), (None, " ".join(words(80)), "h2"), (2, " ".join(words(90)), "h2"),
        (102, " ".join(words(50) + passage + words(40)), "h0"), (103, " ".join(words(60) + passage), "h0"), (104, " ".join(words(20)), "h0"), (105, None, "h0"), (106, "", None),
        (107, "x y z " * 100, "h0"), *((200 + i, " ".join(words(10)), "bad") for i in range(20)), (220, "# # " * 20 + " ".join(words(100)), "bad"), (221, "# # " * 20 + " ".join(words(100)), "h1"),
    ]
    spark.createDataFrame([(a, t, "en", h, len(t or "")) for a, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = plain_pipeline(rows, ["idiot"], library)
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: p.start)
    got = Counter()
    parts = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids)
        parts.setdefault((p.doc_id, p.doc_tokens), []).append(p.ids)
    for (doc, _), ids in parts.items():
        got[(doc, b"".join(ids))] += 1
    assert got == want


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        kept = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path / name))
            assert kept.columns == docs.columns
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.count() == 0 if name == "none" else {6, 13, 17} & {r.doc_id for r in out.collect()}
