"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a sentence's words side by side: insult, threat, target, negation and reported speech. Target,
negation and reported speech reach both ways, so each is a pair of machines, one that reads forwards and one that reads
backwards. Composed, the forward and the backward machines are two tables of states, and an arc is a pair of their states
at an insult or threat. Every arc has a kind and the kind's weight; a clause scores the weights of its arcs, a text its
clauses. An insult that a clause repeats is one arc. The weights are those of a logistic model fitted to labelled
rows. The lexicon of the insult transducer is the list below and the words and stems that labelled rows show to be insults.
"""

from __future__ import annotations

import re
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bind, join_small_or_shuffled, quoted, slices, small_batches, table, with_fields, written

#: Labelled rows that are learned from at most, those with the least hashes of doc_id; the model's only sample.
MAX_LABELLED = 20_000
#: A learned insult: in this many toxic rows, so many times likelier than in clean ones, of its rows this share is toxic,
#: and the log-likelihood ratio of that is this much beyond chance.
LEARNED_ROWS, LEARNED_RATIO, LEARNED_PURITY, LEARNED_EVIDENCE = 5, 50.0, 0.99, 30.0
#: Letters of a learned stem, which any word may begin with.
STEM_LETTERS = (4, 5, 6)

#: The transducers' words.
INSULTS = (
    "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile dumb dumbass fool fools "
    "jerk creep filth vermin retard bastard asshole bitch whore slut pig coward garbage "
    "dummkopf trottel abschaum versager widerlich erbärmlich arschloch hurensohn "
    "imbécile crétin connard salope ordure abruti débile "
    "idiota imbécil estúpido estúpida basura cabrón gilipollas escoria"
).split()
THREATS = "kill hurt destroy beat crush punish burn stab shoot strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u he she they them people everyone him her du dich dein deine ihr euch sie tu toi te vous votre ton ta usted ustedes tú ti ellos".split()
NEGATIONS = "not no never nobody isn't aren't don't cannot nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTS = "said says say called calls wrote writes quoted claims claimed reported sagte schrieb nannte a-dit écrit appelé dijo escribió llamó".split()

KINDS = ("insult", "insult_target", "threat", "threat_target", "negated", "reported")
#: Words that a target or a negation reaches, either way.
TARGET_REACH, NEGATION_REACH = 5, 3
#: A bias and the weights of arcs by kind, towards which the fit is drawn.
PRIOR = np.array([-2.0, 1.5, 2.5, 0.2, 2.0, 0.1, 0.1])
PRIOR_STRENGTH = 0.5

_SENTENCE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[,:]")

# ---- transducers: (states, step); step(state, symbol) gives the next state and what it says of the word ----

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)


def _first(symbol: int):
    """Says 1 at the first word of its class in a clause."""
    return 2, lambda seen, s: (0, 0) if s == BREAK else (int(seen or s == symbol), int(s == symbol and not seen))


def _near(symbol: int, reach: int):
    """Says 1 while a word of its class lies at most `reach` words behind in the clause."""
    return reach + 1, lambda left, s: (0, 0) if s == BREAK else (reach, 1) if s == symbol else (max(0, left - 1), int(left > 0))


def _since(symbol: int):
    """Says 1 from a word of its class to the end of the sentence."""
    return 2, lambda on, s: (int(on or s == symbol), int(on or s == symbol))


def _beyond_break(symbol: int):
    """Says 1 once a word of its class and then a break have been read."""
    return 3, lambda at, s: (2, 1) if at == 2 or (at == 1 and s == BREAK) else (int(at or s == symbol), 0)


def compose(*machines) -> tuple[list[list[int]], list[list[int]]]:
    """[state][symbol] of the next state, and of what the machines say as bits, over all states of all machines."""
    states = list(product(*(range(n) for n, _ in machines)))
    number = {s: i for i, s in enumerate(states)}
    nxt, says = [], []
    for state in states:
        steps = [[step(s, symbol) for (_, step), s in zip(machines, state, strict=True)] for symbol in range(7)]
        nxt.append([number[tuple(n for n, _ in row)] for row in steps])
        says.append([sum(said << i for i, (_, said) in enumerate(row)) for row in steps])
    return nxt, says


#: State 0 is the start of both.
FORWARD = compose(_first(INSULT), _first(THREAT), _near(TARGET, TARGET_REACH), _near(NEGATION, NEGATION_REACH), _since(REPORT))
BACKWARD = compose(_near(TARGET, TARGET_REACH), _near(NEGATION, NEGATION_REACH), _beyond_break(REPORT))


def _kind(forward: int, backward: int) -> int:
    """The kind of an arc from what both tables say there; -1 where no insult or threat begins."""
    insult, threat, target, negated, reported = (forward >> i & 1 for i in range(5))
    target, negated, reported = target | backward & 1, negated | backward >> 1 & 1, reported | backward >> 2 & 1
    return (5 if reported else 4 if negated else (0 if insult else 2) + target) if insult or threat else -1


KIND_OF_ARC = [[_kind(f, b) for b in range(8)] for f in range(32)]


def arcs(symbols: list[int]) -> list[int]:
    """The kinds of a sentence's arcs."""
    nxt, says = BACKWARD
    state, behind = 0, [0] * len(symbols)
    for i in range(len(symbols) - 1, -1, -1):
        behind[i] = says[state][symbols[i]]
        state = nxt[state][symbols[i]]
    nxt, says = FORWARD
    state, found = 0, []
    for symbol, b in zip(symbols, behind, strict=True):
        kind = KIND_OF_ARC[says[state][symbol]][b]
        if kind >= 0:
            found.append(kind)
        state = nxt[state][symbol]
    return found


class Grammar:
    def __init__(self, learned=()):
        self.symbol = {",": BREAK, ":": BREAK}
        self.stems = {w[:-1] for w in learned if w.endswith("*")}
        learned = [w for w in learned if not w.endswith("*")]
        for symbol, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, [*INSULTS, *learned])):
            self.symbol.update(dict.fromkeys(words, symbol))
        self.triggers = ahocorasick.Automaton()
        for w, s in self.symbol.items():
            if s in (INSULT, THREAT):
                self.triggers.add_word(w, w)
        for w in self.stems:
            self.triggers.add_word(w, w)
        self.triggers.make_automaton()

    def of(self, word: str) -> int:
        s = self.symbol.get(word)
        return s if s is not None else INSULT if any(word[:n] in self.stems for n in STEM_LETTERS) else OTHER

    def counts(self, text: str | None) -> list[int]:
        """Arcs of each kind in the sentences of a text."""
        out = [0] * len(KINDS)
        low = (text or "").lower()
        if next(self.triggers.iter(low), None) is None:
            return out
        for sentence in _SENTENCE.split(low):
            if next(self.triggers.iter(sentence), None) is not None:
                for kind in arcs([self.of(w) for w in _WORD.findall(sentence)]):
                    out[kind] += 1
        return out


def _features(counts: np.ndarray) -> np.ndarray:
    """A one and log2(1 + arcs) of each kind: every further arc says more, but less than the one before."""
    return np.concatenate([np.ones((len(counts), 1)), np.log2(1 + counts)], 1)


def weigh(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1: the weights of a text's arcs added to the bias, through the logistic function."""
    return 1 / (1 + np.exp(-np.clip(_features(counts) @ weights, -30, 30)))


def fit(counts: np.ndarray, labels: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights by Newton steps, drawn to PRIOR; without rows PRIOR itself."""
    x, w = _features(counts), PRIOR.copy()
    for _ in range(rounds):
        p = weigh(counts, w)
        slope = x.T @ (p - labels) + PRIOR_STRENGTH * (w - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + PRIOR_STRENGTH * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-6:
            break
    return w


def is_held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """(learned insults, a stem with a star, and weights) from labelled rows that aren't held out, at most `max_labelled` of them. Rows whose label
    is null don't count."""
    chosen = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).filter("_id is not null and _toxic is not null").filter(~is_held_out("_id"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_toxic").limit(max_labelled)
    # as many rows as the parameter says; written, since they are read three times
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(quoted(text)).cast("string").alias("_text")).join(F.broadcast(chosen), "_id").select("_text", F.col("_toxic").cast("int").alias("_toxic"))
    rows = written(rows, "labelled")
    learned = _lexicon(rows)

    def run(batches):
        grammar = Grammar(learned)
        for batch in batches:
            yield pa.record_batch([pa.array([grammar.counts(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["counts", "toxic"])

    seen = rows.mapInArrow(run, "counts array<int>, toxic int").groupBy("counts", "toxic").count().collect()  # at most max_labelled rows
    counts = np.array([r["counts"] for r in seen], float).reshape(len(seen), len(KINDS))
    n = np.array([r["count"] for r in seen], int)
    return learned, fit(np.repeat(counts, n, 0), np.repeat(np.array([r["toxic"] for r in seen], float), n))


def _in_context(words: F.Column) -> F.Column:
    """(word, context) of each word; the context is a hash of its neighbours."""
    return bind(words, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.coalesce(F.get(w, i - 1), F.lit("")), F.coalesce(F.get(w, i + 1), F.lit(""))).alias("context"))))


def _lexicon(rows: DataFrame) -> list[str]:
    """Words, and stems with a star, that the toxic and clean texts among `rows` show to be insults. However many pass the
    tests are taken; a word under a stem that passes is left to the stem."""
    texts = rows.groupBy(F.md5("_text").alias("key"), "_toxic").agg(F.any_value(F.lower("_text")).alias("_text"))
    n1, n0 = (int(n or 0) for n in texts.agg(F.sum("_toxic"), F.sum(1 - F.col("_toxic"))).first())
    if not n1:
        return []
    stems = [F.when(F.char_length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEM_LETTERS]
    forms = F.explode(F.array_compact(F.array("word", *stems))).alias("word")
    words = F.regexp_extract_all("_text", F.lit(r"(\p{L}{3,})"))

    def passing(seen: DataFrame, evidence: float) -> DataFrame:
        counted = seen.groupBy("word").agg(F.sum(F.col("n") * F.col("_toxic")).alias("toxic"), F.sum(F.col("n") * (1 - F.col("_toxic"))).alias("clean"))
        both, share = F.col("toxic") + F.col("clean"), n1 / (n1 + n0)
        ratio = F.col("toxic") / n1 / ((F.col("clean") + 0.5) / max(1, n0))
        part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
        chance = 2 * (part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share)))
        return counted.filter((F.col("toxic") >= LEARNED_ROWS) & (ratio >= LEARNED_RATIO) & (F.col("toxic") >= LEARNED_PURITY * both) & (chance >= evidence)).select("word")

    once = texts.select("key", "_toxic", F.explode(F.array_distinct(words)).alias("word")).select("key", "_toxic", forms).groupBy("word", "_toxic").agg(F.countDistinct("key").alias("n"))
    likely = written(passing(once, LEARNED_EVIDENCE), "likely")
    # of those that pass by texts, a text counts only if it is the first to have the word between its neighbours:
    # near copies of a text are no further evidence
    places = texts.select("key", "_toxic", F.explode(_in_context(words)).alias("x")).select("key", "_toxic", "x.*").select("key", "_toxic", "context", forms)
    among = join_small_or_shuffled(places, likely, "word", "left_semi")
    seen = among.groupBy("word", "context", "_toxic").agg(F.min("key").alias("key")).groupBy("word", "_toxic").agg(F.countDistinct("key").alias("n"))
    passed = {r.word for r in passing(seen, LEARNED_EVIDENCE).collect()}  # of a bounded sample of rows, and each in several of these
    return sorted(w for w in passed if not any(w[:n] + "*" in passed for n in STEM_LETTERS if n < len(w.rstrip("*"))))


def _scored(docs: DataFrame, names: list[str], learned: list[str], weights: np.ndarray, text: str) -> DataFrame:
    """(row, counts, score): the columns `names` of `docs` as a struct. A text that is among them is not sent to the workers a second time."""
    own = names.index(text) if text in names and docs.schema[text].dataType == T.StringType() else None
    row = F.struct("*") if names == docs.columns else F.struct(*(F.col(quoted(c)) for c in names))
    left = docs.select(row.alias("row"), *([F.col(quoted(text)).cast("string").alias("text")] if own is None else []))
    small_batches(docs.sparkSession)

    def run(batches):
        grammar = Grammar(learned)
        for batch in batches:
            texts = batch.column(1) if own is None else pc.struct_field(batch.column(0), [own])
            for part in slices(pa.record_batch([batch.column(0), texts], ["row", "text"]), 1):
                counts = [grammar.counts(t) for t in part.column(1).to_pylist()]
                scores = weigh(np.array(counts, float).reshape(-1, len(KINDS)), weights)
                yield pa.record_batch([part.column(0), pa.array(counts, pa.list_(pa.int32())), pa.array(scores)], ["row", "counts", "score"])

    return left.mapInArrow(run, with_fields([left.schema["row"]], counts=T.ArrayType(T.IntegerType()), score=T.DoubleType()))


def score(docs: DataFrame, learned: list[str], weights: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with `counts` (arcs by kind) and `score` from 0 to 1. A null or empty text has no sentence. Columns that were
    called `counts` or `score` are replaced, others stay, whatever they are called; texts of any length are read whole,
    in slices bounded in bytes. Equal rows score alike; an empty table stays empty."""
    names = [c for c in docs.columns if c not in ("counts", "score")]
    scored = _scored(docs, names, learned, weights, text)
    return scored.select(*(F.col("row").getField(c).alias(c) for c in names), "counts", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), *model)
    return scored.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "counts")


def keep_civil(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that score under 0.5, with the columns of `docs`; repeated rows stay or go together, a null text
    stays."""
    return _scored(docs, docs.columns, *learn(docs, labels, text=text), text).filter("score < 0.5").select("row.*")
