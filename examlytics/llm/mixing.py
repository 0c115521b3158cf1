"""Mixing sources to target weights by iterative proportional fitting (operator 5).

Token counts are summed per cell (source, language, topic) over all documents.
Raking multiplies the cells of every value of a margin by target / current share,
margin after margin, until all three margins fit. A document's weight is its
cell's multiplier; its probability is the weight clipped at one, the rest rescaled
to a token budget: a number of tokens, or by default ``KEPT`` of all tokens, so
that a tiny cell with a large multiplier does not set the rate of the whole
corpus. Expected shares equal the targets but for the cells at one, which are kept
whole and cannot give more; ``probabilities`` without a budget scales the largest
weight to one instead, exact at any cost. Documents are drawn by a hash of id and
seed: the draw is the same on every machine and after every retry.

One narrow pass per table: texts are read once and never shuffled for the query;
cells are summed with map-side partial results, so a source with a third of all
rows is no hot key. The table of cells (not documents) goes to the driver; its
bound is ``MAX_CELLS``, beyond which the call fails rather than drop cells.

Defined cases: null source or language is a value of its own (``""``); a null or
empty text has no tokens, weight 1 and probability 1, so it stays; targets of
values that do not occur are ignored and the rest rescaled; repeated rows are
drawn alike; null ids are drawn by a hash of the text; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlytics.llm.common import stored

MARGINS = ("source", "lang", "topic")
#: Default targets: the present token shares, raised to this power (1 leaves them, 0 makes them equal).
POWERS = {"source": 0.95, "lang": 0.95, "topic": 0.95}
#: Share of all tokens that is drawn where no budget is given.
KEPT = 0.9
MAX_CELLS = 500_000
SEED = 20_240
ROUNDS, TOLERANCE = 200, 1e-9


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """The kind of writing, a topic that every text has: by marks, digits and line length."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    marks = F.regexp_count(t, F.lit(r"[#*$%&|<>{}=;]")) / n
    digits = F.regexp_count(t, F.lit(r"[0-9]")) / n
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return (
        F.when(F.trim(t) == "", "empty")
        .when(marks > 0.05, "markup")
        .when(digits > 0.05, "records")
        .when(n / lines < 40, "lists")
        .when(n < 1000, "notes")
        .otherwise("prose")
    )


def fact_columns(id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> list[Column]:
    """``__u`` (the document's draw in [0, 1)), ``source``, ``lang``, ``topic`` and ``n_tokens`` of a documents table."""
    text = F.col(text_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))))
    return [
        (F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("__u"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        (topic_of(text) if topic is None else F.coalesce(topic, F.lit(""))).alias("topic"),
        tokens_of(text).alias("n_tokens"),
    ]


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id`` and the fact columns of every row, as a written narrow table."""
    return stored(docs.select(F.col(id_col).cast("long").alias("__id"), *fact_columns(id_col, text_col)), "mix-facts")


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[dict]) -> np.ndarray:
    """Multipliers of cells (rows of margin values) so that the token shares of every margin meet its targets."""
    g = np.ones(len(tokens))
    margins = []
    for m, target in enumerate(targets):
        values, inv = np.unique(cells[:, m], return_inverse=True)
        have = np.bincount(inv, weights=tokens, minlength=len(values))
        want = np.array([max(0.0, float(target.get(v, 0.0))) for v in values]) * (have > 0)
        if want.sum() > 0:
            margins.append((inv, want / want.sum() * tokens.sum()))
    for _ in range(ROUNDS):
        moved = 0.0
        for inv, want in margins:
            now = np.bincount(inv, weights=g * tokens, minlength=len(want))
            factor = np.where(now > 0, want / np.maximum(now, 1e-300), 1.0)
            moved = max(moved, float(np.abs(factor[now > 0] - 1).max(initial=0.0)))
            g *= factor[inv]
        if moved < TOLERANCE:
            break
    return g


def probabilities(g: np.ndarray, tokens: np.ndarray, budget: float | None = None) -> np.ndarray:
    """Multipliers scaled to probabilities; with a token budget, clipped at one and recalibrated to it."""
    top = g[tokens > 0].max(initial=0.0)
    if top <= 0:
        return np.ones(len(g))
    if budget is None:
        return np.minimum(1.0, g / top)
    if budget >= tokens[g > 0].sum():
        return (g > 0).astype(float)
    lo, hi = 0.0, 1.0 / max(float(g[(g > 0) & (tokens > 0)].min()), 1e-300)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (np.minimum(1.0, mid * g) * tokens).sum() < budget else (lo, mid)
    return np.minimum(1.0, hi * g)


def cell_weights(narrow: DataFrame, targets: dict[str, dict] | None = None, budget: float | None = None) -> list[tuple]:
    """(source, lang, topic, weight, probability) of every cell; ``budget`` is in tokens, ``KEPT`` of all by default."""
    got = narrow.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")).orderBy(*MARGINS).limit(MAX_CELLS + 1).collect()
    if len(got) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic: merge values of a margin")
    if not got:
        return []
    cells = np.array([[r[m] for m in MARGINS] for r in got], dtype=object)
    tokens = np.array([float(r["tokens"]) for r in got])
    aims = []
    for k, m in enumerate(MARGINS):
        if targets and m in targets:
            aims.append(targets[m])
        else:
            share: dict = {}
            for v, t in zip(cells[:, k], tokens):
                share[v] = share.get(v, 0.0) + t
            aims.append({v: (t / max(tokens.sum(), 1.0)) ** POWERS[m] if t else 0.0 for v, t in share.items()})
    g = rake(cells, tokens, aims)
    p = probabilities(g, tokens, KEPT * float(tokens.sum()) if budget is None else budget)
    return [(*map(str, c), float(w), float(x)) for c, w, x in zip(cells, g, p)]


def with_weights(narrow: DataFrame, weights: list[tuple]) -> DataFrame:
    """``narrow`` with ``weight``, ``probability`` and ``sampled``; the cells (at most MAX_CELLS rows) come as a table."""
    spark = narrow.sparkSession
    table = spark.createDataFrame(weights, "source string, lang string, topic string, weight double, probability double")
    x = narrow.join(F.broadcast(table) if len(weights) <= 10_000 else table, list(MARGINS), "left")
    for c in ("weight", "probability"):  # a text without tokens moves no share: it stays
        x = x.withColumn(c, F.when(F.col("n_tokens") > 0, F.coalesce(c, F.lit(1.0))).otherwise(1.0))
    return x.withColumn("sampled", F.col("__u") < F.col("probability"))


def sample_documents(docs: DataFrame, targets: dict[str, dict] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are. Texts are read twice and not shuffled (up to 10,000 cells)."""
    weights = cell_weights(facts(docs, id_col, text_col), targets, budget)
    names = docs.columns
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    x = with_weights(docs.select(*kept, *fact_columns(id_col, text_col)), weights).where("sampled")
    return x.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    """op5_mixing: weight, probability and draw of every row of ``documents``."""
    narrow = facts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    x = with_weights(narrow, cell_weights(narrow))
    return x.select(F.col("__id").alias("doc_id"), *MARGINS, "n_tokens", "weight", "probability", "sampled")
