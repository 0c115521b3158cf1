"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Four layers, each a finite-state transducer over the layer below:

* Characters to arcs. An Aho-Corasick automaton over the lower-cased text emits
  insult and threat arcs: whole words and word beginnings. Seed arcs are listed
  below; further arcs are learned from labelled documents (a word or word
  beginning that marks toxic documents far more than others) with their log-odds
  as weights.
* Clauses. A line with an arc is read whole, however long, as symbols: I(nsult),
  T(hreat), Y (target), N(egation), R(eported speech), clause marks, other words.
* Symbols to patterns. The clause automaton reads the symbols once and carries
  the state (target seen, words since a negation, reported speech open). A clause
  mark ends target and negation. Reported speech ends with its sentence, with its
  closing quotation mark, or at a comma that does not follow the verb; a colon or
  an opening quotation mark hands it on, inside the quotation over whole
  sentences. At an insult or threat the automaton emits one of eight patterns:
  plain, targeted, negated or reported, of insults or threats, with the arc's weight.
* Patterns to score. A document's score is a logistic function of the pattern
  sums, fitted on labelled documents that the arcs were not learned from. The
  weights are drawn towards ``FIXED_WEIGHTS``, so patterns that the labels do not
  show keep those, and a targeted pattern never weighs less than a plain one.

Nothing scores an isolated word: weights enter through matched clauses only.
Training uses a sample of at most ``TRAIN_DOCS`` labelled documents, in the
order of a hash of id and text; scoring covers every whole text. Only rows whose
crc32(id as text) mod 3 is not 1 give labels. Inputs of a score are the text alone.

Defined cases: a null or empty text has the base score; rows with null ids are
not held out and give no labels; labels with null or other values than 0 and 1
are ignored; without labels of both kinds the seed arcs and fixed weights serve;
the grammar holds at most ``MAX_ARCS`` learned arcs; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlytics.llm.common import lean, stored

THRESHOLD = 0.7
#: Most labelled documents that training looks at; half for arcs, half for weights.
TRAIN_DOCS = 24_000
#: A learned arc: in so many toxic documents at least, with these log-odds (less a standard error) at least, at most so many arcs.
ARC_DOCS = 3
ARC_ODDS = 1.2
#: Clean documents that every arc is taken to occur in besides those counted; largest share of one word in a word beginning.
CLEAN_PRIOR = 1.5
FAMILY_SHARE = 0.6
MAX_ARCS = 4000
PREFIXES = range(3, 9)

# Seed words of the grammar, in the four languages of the corpus.
INSULTS = (
    "idiot moron stupid scum trash loser pathetic worthless clown disgusting dumb imbecile fool vermin filth "
    "dummkopf abschaum versager trottel widerlich imbécile crétin ordure minable débile imbécil basura escoria patético inútil"
).split()
THREATS = (
    "kill hurt destroy punish beat murder hunt töten vernichten verletzen tuer détruire frapper matar destruir golpear"
).split()
TARGETS = frozenset(
    "you your yourself he she they them him her du dich dir ihr euch sie tu toi vous ton votre ils elles tú usted ustedes ellos ellas".split()
)
NEGATIONS = frozenset("not no never nobody none nor nicht kein keine niemals nie ne pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORTS = frozenset(
    "said says say wrote writes quoted claimed reported called sagte sagt schrieb schreibt behauptete dit disait écrit écrivait dijo dice escribió".split()
)

PATTERNS = ("plain insult", "targeted insult", "negated insult", "reported insult", "plain threat", "targeted threat", "negated threat", "reported threat")
#: Weights without labels: intercept, length of the text, then one weight per pattern.
FIXED_WEIGHTS = (-3.0, 0.0, 2.4, 2.8, 0.6, 0.6, 1.0, 3.0, 0.4, 0.6)
#: A negation reaches so many words ahead.
NEGATION_REACH = 3

WORD = re.compile(r"\w+")
SYMBOL = re.compile(r"\w+|[.!?;:,()\[\]\"“”„«»]")
QUOTES = frozenset('"“”„«»')


@dataclass
class Grammar:
    """Arcs: word or word beginning -> (kind "I" or "T", whole word, weight); weights of the patterns."""

    arcs: dict[str, tuple[str, bool, float]]
    weights: tuple[float, ...] = FIXED_WEIGHTS


def seed_arcs() -> dict[str, tuple[str, bool, float]]:
    return {w: ("I", True, 3.0) for w in INSULTS} | {w: ("T", True, 3.0) for w in THREATS}


class Matcher:
    """The composed transducers of a grammar."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.arcs = grammar.arcs
        self.weights = np.array(grammar.weights)
        self.found = ahocorasick.Automaton()
        for arc in grammar.arcs:
            self.found.add_word(arc, arc)
        if grammar.arcs:
            self.found.make_automaton()

    def arcs_in(self, low: str) -> dict[int, tuple[str, str, float]]:
        """Word start -> (kind, arc, weight): the longest arc that matches at the start of a word."""
        out: dict[int, tuple[str, str, float]] = {}
        if not self.arcs or not low:
            return out
        for end, arc in self.found.iter(low):
            start = end - len(arc) + 1
            if start and (low[start - 1].isalnum() or low[start - 1] == "_"):
                continue
            kind, whole, weight = self.arcs[arc]
            if whole and end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_"):
                continue
            old = out.get(start)
            if old and "T" in (old[0], kind):  # a word of threat stays one under an arc learned for its beginning
                kind = "T"
                old = ("T", *old[1:])
                out[start] = old
            if old is None or (weight, len(arc)) > (old[2], len(old[1])):
                out[start] = (kind, arc, weight)
        return out

    def clauses(self, low: str) -> Iterator[tuple[int, list[tuple[str, str, float]]]]:
        """(place, patterns) of every line with an arc."""
        arcs = self.arcs_in(low)
        at = -1
        for start in sorted(arcs):
            if start < at:
                continue  # in the line just read
            left = low.rfind("\n", 0, start) + 1
            at = low.find("\n", start)
            at = len(low) if at < 0 else at
            yield left, self.read(low, left, at, arcs)

    @staticmethod
    def read(low: str, left: int, right: int, arcs: dict[int, tuple[str, str, float]]) -> list[tuple[str, str, float]]:
        """The clause automaton: symbols in; pattern, word and weight out."""
        target = reported = quoted = after_verb = False
        since_negation = NEGATION_REACH + 1
        out: list[tuple[str, str, float]] = []
        late: list[int] = []
        for m in SYMBOL.finditer(low, left, right):
            w = m[0]
            if not (w[0].isalnum() or w[0] == "_"):
                target, since_negation = False, NEGATION_REACH + 1
                late.clear()
                if w in QUOTES:
                    reported = reported and not quoted
                    quoted = reported
                elif w == ",":
                    reported = reported and (quoted or after_verb)
                elif w != ":":
                    reported = reported and quoted
                continue
            since_negation += 1
            after_verb = False
            if m.start() in arcs:
                kind, _, weight = arcs[m.start()]
                noun = "insult" if kind == "I" else "threat"
                if since_negation <= NEGATION_REACH:
                    form = "negated"
                elif reported:
                    form = "reported"
                elif target:
                    form = "targeted"
                else:
                    form = "plain"
                    late.append(len(out))
                out.append((f"{form} {noun}", w, weight))
            elif w in NEGATIONS:
                since_negation = 0
            elif w in REPORTS:
                reported = after_verb = True
            elif w in TARGETS:
                target = True
                for i in late:  # a target behind the insult
                    out[i] = (out[i][0].replace("plain", "targeted"), *out[i][1:])
                late.clear()
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Length of a text with arcs, and its pattern sums, all dampened: log(1 + x).

        Longer texts meet more arcs by chance. A word counts once per pattern: a
        text that repeats a line says it once.
        """
        low = (text or "").lower()
        sums = dict.fromkeys(PATTERNS, 0.0)
        seen = {(p, word): w for _, found in self.clauses(low) for p, word, w in found}
        for (pattern, _), weight in seen.items():
            sums[pattern] += weight
        return np.log1p(np.array([len(low) / 1000 if seen else 0.0, *(sums[p] for p in PATTERNS)]))

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + self.weights[1:] @ self.features(text))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


# ------------------------------------------------------------------ training


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> DataFrame:
    """``toxic, text, half`` of at most ``limit`` labelled rows outside the held-out third, one per distinct text."""
    y = labels.select(F.col(id_col).alias("__y"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1))
    y = y.where(F.col("__y").isNotNull() & ~held_out(F.col("__y"))).groupBy("__y").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("__y", F.lit(11))
    y = y.orderBy(order, "__y").limit(limit)
    x = docs.select(F.col(id_col).alias("__y"), F.col(text_col).alias("text")).join(F.broadcast(y), "__y")
    x = x.select("toxic", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return x.select("toxic", "text", "h", F.pmod("h", F.lit(2)).cast("int").alias("half"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per arc candidate: distinct words ("=word") and word beginnings of each text, by label."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def rows() -> pa.RecordBatch:
        out = [(a, y, n) for y in counts for a, n in counts[y].items()]
        for y in counts:
            counts[y].clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["arc", "toxic", "n"]
        )

    for batch in batches:
        for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words = set(WORD.findall((text or "").lower()))
            # an arc is a sequence of letters: numbers and mixed codes are no vocabulary
            words = {w for w in words if w.isalpha() and len(w) >= 3}
            got = {"=" + w for w in words}
            for w in words:
                got.update(w[:k] for k in PREFIXES if len(w) >= k)
            counts[y].update(got)
        if sum(map(len, counts.values())) > 400_000:
            yield rows()
    if any(counts.values()):
        yield rows()


def learn_arcs(rows: DataFrame) -> dict[str, tuple[str, bool, float]]:
    """Arcs from labelled rows: log-odds of an arc's documents, smoothed. At most MAX_ARCS leave the cluster."""
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").agg(F.count("*")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    n = rows.select("toxic", "text").mapInArrow(lean(_words), "arc string, toxic int, n long")
    by_label = [F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0)).alias(c) for y, c in ((1, "t"), (0, "c"))]
    n = stored(n.groupBy("arc").agg(*by_label).where(F.col("t") >= 1), "arc-counts")
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("c") + CLEAN_PRIOR) / (sizes[0] + 1.0))
    odds = odds - F.sqrt(1 / F.col("t") + 1 / (F.col("c") + CLEAN_PRIOR))  # less one standard error
    # a beginning stands for a family of words: no single word may be most of it
    word = F.substring("arc", 2, 1 << 20)
    heads = n.where(F.col("arc").startswith("=")).select("t", F.explode(F.array_distinct(F.array(*[F.substring(word, 1, k) for k in PREFIXES]))).alias("arc"))
    heads = heads.groupBy("arc").agg(F.max("t").alias("most"))
    best = n.where(F.col("t") >= ARC_DOCS).withColumn("odds", odds).where(F.col("odds") >= ARC_ODDS).join(heads, "arc", "left")
    best = best.where(F.col("arc").startswith("=") | (F.col("most") <= FAMILY_SHARE * F.col("t")))
    best = best.orderBy(F.desc(F.col("odds") * F.log1p("t")), "arc").limit(MAX_ARCS)
    arcs: dict[str, tuple[str, bool, float]] = {}
    for r in sorted(best.collect(), key=lambda r: (r["arc"].startswith("="), r["arc"])):
        name, whole = r["arc"].lstrip("="), r["arc"].startswith("=")
        if whole and name in arcs and arcs[name][2] >= r["odds"]:
            continue
        arcs[name] = ("T" if name in THREATS else "I", whole, round(float(r["odds"]), 4))
    return arcs


def _features(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(grammar)
        for batch in batches:
            x = [m.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps, both labels with equal weight in all.

    Weights are drawn towards ``FIXED_WEIGHTS``. The fit is in what a target adds to
    a plain pattern: like all weights of patterns that addition is never negative.
    """
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    both = np.eye(len(FIXED_WEIGHTS))
    for plain in (2, 6):
        both[plain + 1, plain] = 1.0  # a targeted weight is the plain one and its addition
    prior = np.linalg.solve(both, np.array(FIXED_WEIGHTS))
    z = np.column_stack([np.ones(len(x)), x]) @ both
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[:2] = 1e-3, 0.05
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + penalty * (w - prior)
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        free = (w > 0) | (g < 0)
        free[:2] = True
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w = w - step
        w[2:] = np.maximum(w[2:], 0.0)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(round(float(v), 6) for v in both @ w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> Grammar:
    """A grammar from the labelled rows outside the held-out third."""
    rows = training_rows(docs, labels, id_col, text_col, limit)
    rows = rows.groupBy("h").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"), F.first("half").alias("half"))
    arcs = learn_arcs(rows.where("half = 0"))
    grammar = Grammar(seed_arcs() | arcs)
    got = rows.where("half = 1").select("toxic", "text").mapInArrow(lean(_features(grammar)), "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in got], float)
    if not len(got) or y.min() == y.max():
        return Grammar(grammar.arcs)
    return Grammar(grammar.arcs, fit_weights(np.array([r["x"] for r in got]), y))


# ------------------------------------------------------------------ scoring


def _scores(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(grammar)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                s = [m.score(t.as_py()) for t in part.column("__text")]
                cols = [c for n, c in zip(part.schema.names, part.columns) if n != "__text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64())], names=[*(n for n in part.schema.names if n != "__text"), "score"])

    return run


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    x = src.mapInArrow(lean(_scores(grammar)), "doc_id long, score double")
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns as they are."""
    names = docs.columns
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    x = src.mapInArrow(lean(_scores(grammar)), f"{schema}, score double").where(F.col("score") < THRESHOLD)
    return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    """op1_toxicity: score of every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
