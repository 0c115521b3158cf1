"""Quality rules by cross-document line frequency (operator 10).

Every line is normalised (ASCII lower case, white space collapsed) and hashed;
``(host, line)`` pairs are counted over distinct documents. Lines over the
limit of their host are boilerplate and are removed; a document with too little
left is rejected. Base measures of the whole text come with it.

Plan: one pass over the texts writes a narrow table (measures plus one hash and
word count per line). All shuffles run on that table: a count per (host, line)
with map-side sums, a join with the lines over the limit, a sum per document.
Texts are never shuffled, unless the cleaned texts are asked for.

Defined cases: a null text is an empty text (no words, base failed); a null
host is a host of its own; null ids count as one document; repeated rows with
one id count as one document of their lines and each gets its own result row;
lines without a word are neither counted nor removed; empty tables give empty
results. A 64-bit hash stands for a line or a word window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlytics.llm.common import (
    IS_WORD,
    LOWER,
    mix,
    pieces,
    powers,
    prefix_hash,
    row_counts,
    signed,
    span_hash,
    stored,
    word_hashes,
    word_spans,
)

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: A line is boilerplate in more documents of its host than both of these.
MIN_LINE_DOCS = 20
MIN_LINE_SHARE = 0.005
#: A document is depleted with fewer words left, or a smaller share of its words.
MIN_WORDS_LEFT = 50
MIN_SHARE_LEFT = 0.5

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_keys array<long>, line_words array<int>"
)


def _ranges_sum(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags within each row's bytes."""
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]


def _first_seen(key: np.ndarray) -> np.ndarray:
    """True for the first of equal keys."""
    out = np.zeros(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = True
    return out


def measure_piece(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of each text of a piece; lines as flat arrays with ``line_offsets``."""
    n_rows = len(offs) - 1
    start, end, row = word_spans(data, offs)
    n_words, first = row_counts(row, n_rows)
    in_word = IS_WORD[data]
    out = {
        "n_words": n_words,
        "word_chars": _ranges_sum(in_word & ((data & 0xC0) != 0x80), offs),
        "n_symbols": _ranges_sum(SYMBOLS[data], offs),
    }
    # words of repeated three-word windows
    words = word_hashes(data, start, end)
    out["n_repeat_words"] = np.zeros(n_rows, np.int64)
    m = len(words) - 2
    if m > 0:
        at = np.flatnonzero(row[:m] == row[2:])
        c = np.uint64(0xA0761D6478BD642F)
        key = mix(((words[at] * c ^ words[at + 1]) * c ^ words[at + 2]) * c + row[at].astype(np.uint64))
        _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.zeros(len(words), bool)
        rep = at[cnt[inv] > 1]
        for j in range(3):
            hit[rep + j] = True
        out["n_repeat_words"] = np.bincount(row[hit], minlength=n_rows).astype(np.int64)
    # lines: cut at \n and at the ends of texts
    cut = np.flatnonzero(data == 10)
    ls = np.concatenate([offs[:-1], cut + 1])
    le = np.concatenate([offs[1:], cut])
    lrow = np.concatenate([np.arange(n_rows), np.searchsorted(offs, cut, side="right") - 1])
    ls, lrow = ls[by := np.lexsort((ls, lrow))], lrow[by]
    le = np.minimum(np.append(ls[1:] - 1, len(data)), offs[lrow + 1])
    same = np.append(lrow[1:] == lrow[:-1], False)
    le = np.where(same, le, offs[lrow + 1])
    w0, w1 = np.searchsorted(start, ls), np.searchsorted(start, le)
    has = w1 > w0
    ls, le, lrow, w0, w1 = ls[has], le[has], lrow[has], w0[has], w1[has]
    raw = mix(span_hash(prefix_hash(data), ls, le) + lrow.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    out["n_dup_lines"] = np.bincount(lrow[~_first_seen(raw)], minlength=n_rows).astype(np.int64)
    low = word_hashes(LOWER[data], start, end)
    run = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(low * powers(1, len(low)), out=run[1:])
    out["line_keys"] = mix(span_hash(run, w0, w1, 1)) if len(w0) else np.empty(0, np.uint64)
    out["line_words"] = (w1 - w0).astype(np.int32)
    out["line_offsets"] = row_counts(lrow, n_rows)[1]
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in pieces(batch, "__text"):
            m = measure_piece(data, offs)
            cols = [batch.column("__id").slice(a, b - a), batch.column("__host").slice(a, b - a)]
            cols += [pa.array(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            lo = pa.array(m["line_offsets"].astype(np.int32))
            cols += [pa.ListArray.from_arrays(lo, signed(m["line_keys"])), pa.ListArray.from_arrays(lo, pa.array(m["line_words"]))]
            yield pa.RecordBatch.from_arrays(cols, names=["__id", "__host", *[x.split()[0] for x in MEASURES.split(", ")]])


def measures(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: ``__uid``, ``__id``, ``__host``, the base measures and its lines. A written table."""
    src = docs.select(
        F.col(id_col).cast("long").alias("__id"), F.col(host_col).cast("string").alias("__host"), F.col(text_col).alias("__text")
    )
    got = src.mapInArrow(_measure, f"__id long, __host string, {MEASURES}")
    return stored(got.withColumn("__uid", F.monotonically_increasing_id()), "line-measures")


def line_table(measured: DataFrame) -> DataFrame:
    """``__uid, __id, __host, line_no, line_key, line_words`` of lines with a word (``line_no`` counts those only)."""
    pairs = F.arrays_zip("line_keys", "line_words")
    x = measured.select("__uid", "__id", F.coalesce("__host", F.lit("")).alias("__host"), F.posexplode(pairs).alias("line_no", "x"))
    return x.select("__uid", "__id", "__host", "line_no", F.col("x.line_keys").alias("line_key"), F.col("x.line_words").alias("line_words"))


def frequent_lines(measured: DataFrame, min_docs: int = MIN_LINE_DOCS, min_share: float = MIN_LINE_SHARE) -> DataFrame:
    """``__host, line_key, line_docs`` of the lines over the limit of their host."""
    hosts = measured.groupBy(F.coalesce("__host", F.lit("")).alias("__host")).agg(F.count("*").alias("host_docs"))
    seen = line_table(measured).groupBy("__host", "line_key", "__id").agg(F.lit(1).alias("one"))
    docs = seen.groupBy("__host", "line_key").agg(F.count("*").alias("line_docs")).where(F.col("line_docs") > min_docs)
    return docs.join(hosts, "__host").where(F.col("line_docs") > min_share * F.col("host_docs")).select("__host", "line_key", "line_docs")


def verdicts(
    measured: DataFrame,
    min_docs: int = MIN_LINE_DOCS,
    min_share: float = MIN_LINE_SHARE,
    min_words: int = MIN_WORDS_LEFT,
    min_left: float = MIN_SHARE_LEFT,
) -> DataFrame:
    """``measured`` with ``words_removed``, ``lines_removed``, ``base_failed`` and ``kept``."""
    over = frequent_lines(measured, min_docs, min_share)
    gone = (
        line_table(measured)
        .join(over, ["__host", "line_key"])
        .groupBy("__uid")
        .agg(F.sum("line_words").cast("long").alias("words_removed"), F.count("*").alias("lines_removed"))
    )
    x = measured.drop("line_keys", "line_words").join(gone, "__uid", "left").fillna(0, ["words_removed", "lines_removed"])
    left = F.col("n_words") - F.col("words_removed")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = (F.col("words_removed") > 0) & ((left < min_words) | (left < min_left * F.col("n_words")))
    return x.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def clean_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The kept documents, their frequent lines taken out of the text; the columns of ``docs``.

    A document's removed lines travel as an array bounded by its own lines.
    """
    tagged = stored(docs.withColumn("__uid", F.monotonically_increasing_id()), "line-docs")
    src = tagged.select(F.col("__uid").alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    m = src.mapInArrow(_measure, f"__id long, __host string, {MEASURES}")
    ids = tagged.select("__uid", F.col(id_col).cast("long").alias("__doc"))
    m = m.withColumnRenamed("__id", "__uid").join(ids, "__uid").withColumnRenamed("__doc", "__id")
    measured = stored(m, "line-measures")
    keep = verdicts(measured, **limits).where("kept").select("__uid")
    over = frequent_lines(measured, limits.get("min_docs", MIN_LINE_DOCS), limits.get("min_share", MIN_LINE_SHARE))
    cut = line_table(measured).join(over, ["__host", "line_key"]).groupBy("__uid").agg(F.collect_set("line_no").alias("__cut"))
    x = tagged.join(keep, "__uid", "left_semi").join(cut, "__uid", "left")
    # lines without a word keep their place: number only the lines with a word
    has_word = lambda s: s.rlike(r"[^\x20\x09-\x0D]")
    numbered = F.aggregate(
        F.split(F.col(text_col), "\n", -1),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            (acc["n"] + has_word(s).cast("int")).alias("n"),
            F.when(has_word(s) & F.array_contains("__cut", acc["n"]), acc["out"]).otherwise(F.concat(acc["out"], F.array(s))).alias("out"),
        ),
        lambda acc: F.array_join(acc["out"], "\n"),
    )
    return x.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(numbered)).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op10_quality_rules: base measures and the method's verdict for every row of ``documents``."""
    m = measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return verdicts(m).select(
        F.col("__id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lines_removed",
        "words_removed",
    )


_WORDS = r"'[^\x20\x09-\x0D]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: The same rows in DuckDB SQL (rows of ``documents`` are told apart by a row number).
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
dw AS (SELECT rid, regexp_extract_all(text, {_WORDS}) AS words FROM d),
w AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM dw),
tri AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) t WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS j) k GROUP BY rid),
ws AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT rid, line, regexp_extract_all(translate(line, {_LOWER}), {_WORDS}) AS lw FROM ln),
lines AS (SELECT rid, line, array_to_string(lw, ' ') AS norm, len(lw) AS n FROM l WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
freq AS (SELECT host, norm, count(DISTINCT coalesce(doc_id::VARCHAR, '-')) AS line_docs FROM lines JOIN d USING (rid) GROUP BY host, norm),
over_limit AS (SELECT host, norm FROM freq JOIN hosts USING (host)
               WHERE line_docs > {MIN_LINE_DOCS} AND line_docs > {MIN_LINE_SHARE} * host_docs),
gone AS (SELECT rid, count(*) AS lines_removed, sum(n)::BIGINT AS words_removed
         FROM lines JOIN d USING (rid) JOIN over_limit USING (host, norm) GROUP BY rid),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(lines_removed, 0) AS lines_removed, coalesce(words_removed, 0) AS words_removed
  FROM d LEFT JOIN ws USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT (words_removed > 0 AND
         (n_words - words_removed < {MIN_WORDS_LEFT} OR n_words - words_removed < {MIN_SHARE_LEFT} * n_words)) AS kept
FROM b
"""
