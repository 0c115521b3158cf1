"""Question-level statistics over cleaned answer rows (``clean.analysis_rows``).

F1 (flagship), F6/D3 (wrong answers), F7/G5 (correct sample), F8, F9, F12, F16,
R1 (misconception requests).

Scale notes: there are few sub-questions and very many rows, so every statistic
is an aggregate that combines map-side (count, count_if, min_by, max_by) or a
top-k with a literal bound (planned as a partial WindowGroupLimit before the
shuffle). Nothing collects an unbounded group: wrong-answer text is emitted in
numbered chunks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text, percent_text, py_strip
from .joins import join_keys
from .ordered import DEFAULT_BLOCK, number_rows

CORRECT = "Correct"
# Fixed value: the sample text used when the correct pool is too small.
NO_CORRECT_SAMPLE = "No correct answer transcribed"
SAMPLE_SIZE = 10
WRONG_CHUNK = 200


def is_correct(grading: str = "grading") -> Column:
    return F.col(grading) == F.lit(CORRECT)


def is_wrong(grading: str = "grading", answer: str = "answer") -> Column:
    """D3: grading not exactly ``Correct`` (null, '' and 'Not Graded' count) and a non-blank answer."""
    return ~F.col(grading).eqNullSafe(F.lit(CORRECT)) & has_text(answer)


def in_correct_pool(pool: str = "strict", grading: str = "grading", answer: str = "answer") -> Column:
    """``strict`` = grading is ``Correct``; ``reference`` = grading contains
    'correct' in any case (which also admits 'Incorrect')."""
    g = F.col(grading)
    if pool == "strict":
        cond = g == F.lit(CORRECT)
    elif pool == "reference":
        cond = F.coalesce(F.lower(g).contains("correct"), F.lit(False))
    else:
        raise ValueError(f"unknown pool {pool!r}")
    return cond & has_text(answer)


def normalize_answer(c: str = "answer") -> Column:
    """Lower case, Python-style strip, inner whitespace runs collapsed to one space."""
    return F.regexp_replace(py_strip(F.lower(F.col(c))), "\\s+", " ")


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows that belong to a sub-question group (null numbers form none, N5)."""
    if "has_number" in rows.columns:
        return rows.where(F.col("has_number"))
    return rows.where(F.col("sub_question_no").isNotNull())


def common_wrong_answer(rows: DataFrame) -> DataFrame:
    """F16: most frequent normalised wrong answer per sub-question (ties: smallest text).

    Two aggregations, both map-side combined: (sub, answer) counts, then a top-1.
    """
    counts = (
        _grouped(rows)
        .where(is_wrong())
        .groupBy("sub_question_no", normalize_answer().alias("wrong_answer"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    key = F.struct((-F.col("n")).alias("neg_n"), F.col("wrong_answer"))
    return counts.groupBy("sub_question_no").agg(
        F.min_by(F.col("wrong_answer"), key).alias("misconception"),
        F.max(F.col("n")).cast("int").alias("misconception_frequency"),
    )


def question_stats(rows: DataFrame, approx_students: bool = False) -> DataFrame:
    """F1 core: per sub-question, first main number and text in file order,
    attempts, distinct students, correct answers and percent.

    ``approx_students`` swaps the exact distinct count (a second aggregation
    level keyed by (sub-question, student)) for a HyperLogLog sketch that
    merges map-side (F3 option)."""
    g = _grouped(rows)
    students = (
        F.approx_count_distinct("student_name") if approx_students else F.count_distinct("student_name")
    )
    stats = g.groupBy("sub_question_no").agg(
        F.min("row_id").alias("_first"),
        F.count(F.lit(1)).alias("attempts"),
        students.alias("distinct_students"),
        F.count_if(is_correct()).alias("correct_answers"),
    )
    # late fetch: texts in an aggregate would sort every row, a row id is hashed
    first = g.select(F.col("row_id").alias("_row"), "main_question_no", "question")
    stats = stats.join(first, F.col("_first") == F.col("_row"))
    stats = stats.select("main_question_no", "question", "sub_question_no", "attempts", "distinct_students", "correct_answers")
    return stats.withColumns(
        {
            "correct_pct": percent_text("correct_answers", "attempts", 1),
            "correct_pct_value": F.col("correct_answers").cast("double") * 100.0 / F.col("attempts").cast("double"),
        }
    )


def question_analysis(rows: DataFrame) -> DataFrame:
    """the per-sub-question report, with the most common wrong answer (F16)
    standing in for the model's misconception (null/0 where there is none)."""
    stats = question_stats(rows)
    mis = common_wrong_answer(rows)
    out = join_keys(stats, mis, ["sub_question_no"], "left")
    return out.select(
        "main_question_no",
        "question",
        "sub_question_no",
        F.col("attempts").cast("bigint").alias("attempts"),
        F.col("distinct_students").cast("bigint").alias("distinct_students"),
        F.col("correct_answers").cast("bigint").alias("correct_answers"),
        "correct_pct",
        "correct_pct_value",
        "misconception",
        F.coalesce(F.col("misconception_frequency"), F.lit(0)).alias("misconception_frequency"),
    )


def wrong_answers(rows: DataFrame) -> DataFrame:
    """D3 long form: one row per wrong answer."""
    return _grouped(rows).where(is_wrong()).select("sub_question_no", "row_id", "answer")


def numbered_wrong_answers(rows: DataFrame, chunk: int = WRONG_CHUNK, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Wrong answers with their number per sub-question (file order) and the chunk it falls in."""
    w = number_rows(wrong_answers(rows), ["sub_question_no"], "row_id", "wrong_ord", block)
    return w.withColumn("chunk_no", F.floor((F.col("wrong_ord") - 1) / F.lit(chunk)).cast("bigint"))


def wrong_answer_text(rows: DataFrame, chunk: int = WRONG_CHUNK, block: int = DEFAULT_BLOCK) -> DataFrame:
    """wrong answers joined by newline in file order, in numbered chunks of at
    most ``chunk`` lines, so no single row or task holds an unbounded list. The
    replies to the chunks of a sub-question are merged again by R4."""
    items = F.array_sort(F.collect_list(F.struct("wrong_ord", "answer")))
    return numbered_wrong_answers(rows, chunk, block).groupBy("sub_question_no", "chunk_no").agg(
        F.array_join(F.transform(items, lambda x: x["answer"]), "\n").alias("wrong_text"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def sample_key(seed: str) -> Column:
    """Deterministic pseudo-random order of rows: md5 of ``row_id:seed``."""
    return F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":"), F.lit(str(seed))))


def correct_sample(rows: DataFrame, pool: str = "strict", seed: str = "1", size: int = SAMPLE_SIZE) -> DataFrame:
    """A deterministic sample of min(size, correct answers) pool answers per
    sub-question; a group whose pool is smaller than that gets the single
    fallback text. Rows: (sub_question_no, sample_rank, answer).

    The ``<= size`` filter on row_number is a literal, so Spark applies a partial
    group limit before the shuffle and a hot sub-question ships only ``size``
    rows per map task.
    """
    g = _grouped(rows)
    need = g.groupBy("sub_question_no").agg(
        F.count_if(is_correct()).alias("n_correct"),
        F.count_if(in_correct_pool(pool)).alias("n_pool"),
    )
    w = Window.partitionBy("sub_question_no").orderBy(sample_key(seed), F.col("row_id"))
    ranked = (
        g.where(in_correct_pool(pool))
        .select("sub_question_no", "answer", F.row_number().over(w).alias("sample_rank"))
        .where(F.col("sample_rank") <= size)
    )
    need = need.withColumn("n_take", F.least(F.lit(size), F.col("n_correct")))
    ok = need.where(F.col("n_pool") >= F.col("n_take"))
    taken = join_keys(ranked, ok, ["sub_question_no"]).where(F.col("sample_rank") <= F.col("n_take"))
    fallback = need.where(F.col("n_pool") < F.col("n_take")).select(
        "sub_question_no", F.lit(1).cast("int").alias("sample_rank"), F.lit(NO_CORRECT_SAMPLE).alias("answer")
    )
    return taken.select("sub_question_no", F.col("sample_rank").cast("int"), "answer").unionByName(fallback)


def correct_sample_text(rows: DataFrame, pool: str = "strict", seed: str = "1") -> DataFrame:
    """the distinct sampled answers (at most 10) per sub-question, sorted, newline-joined."""
    s = correct_sample(rows, pool, seed).where(F.col("answer").isNotNull() & (F.col("answer") != ""))
    return s.groupBy("sub_question_no").agg(
        F.array_join(F.array_sort(F.collect_set("answer")), "\n").alias("sample_text"),
        F.count_distinct("answer").alias("n_distinct"),
    )


def grading_distribution(rows: DataFrame) -> DataFrame:
    """F8: rows per grading value, null grading dropped."""
    return rows.where(F.col("grading").isNotNull()).groupBy("grading").agg(F.count(F.lit(1)).alias("count"))


def analysis_summary(rows: DataFrame) -> DataFrame:
    """questions analysed (sub-question groups) and total cleaned entries.

    One pass: the distinct count and row count are both global aggregates
    computed from partial per-task results.
    """
    return rows.agg(
        F.count_distinct("sub_question_no").alias("questions_analysed"),
        F.count(F.lit(1)).alias("total_entries"),
    )


def first_and_sample(rows: DataFrame, pool: str = "strict", seed: str = "1", size: int = SAMPLE_SIZE) -> DataFrame:
    """``question`` of the first row and the correct sample text (G5 + F7) per
    sub-question, from one pass over the rows.

    Each row is tagged with what it may be: the first row (``q``), one of the pool
    (``p``), a correct answer that is not counted there (``c``). One rank per
    (sub-question, tag) with a literal bound keeps ``size`` rows of each tag per map
    task (partial group limit). More than ``size`` correct answers take the same
    sample as ``size``, so the bounded counts decide as the whole ones do.
    """
    within = in_correct_pool(pool)
    strict = pool == "strict"
    uncounted = is_correct() & ~F.coalesce(within, F.lit(False)) if strict else is_correct()
    none = F.lit(None).cast("string")
    tag = lambda name, ord_, text: F.struct(F.lit(name).alias("tag"), ord_.alias("ord"), text.alias("text"))
    tags = F.array(
        tag("q", none, F.col("question")),
        F.when(within, tag("p", sample_key(seed), F.col("answer"))),
        F.when(uncounted, tag("c", none, none)),
    )
    t = _grouped(rows).select("sub_question_no", "row_id", F.inline(F.array_compact(tags)))
    w = Window.partitionBy("sub_question_no", "tag").orderBy("ord", "row_id")
    t = t.select("sub_question_no", "tag", "text", F.row_number().over(w).alias("rank")).where(F.col("rank") <= size)
    of = lambda name: F.col("tag") == name
    drawn = F.collect_list(F.when(of("p"), F.struct("rank", "text")))
    g = t.groupBy("sub_question_no").agg(
        F.max(F.when(of("q") & (F.col("rank") == 1), F.col("text"))).alias("question"),
        drawn.alias("_drawn"), F.count_if(of("p")).alias("_pool"), F.count_if(of("c")).alias("_other"),
    )
    take = F.least(F.lit(size).cast("bigint"), F.col("_other") + F.col("_pool") if strict else F.col("_other"))
    taken = F.transform(F.filter("_drawn", lambda s: s["rank"] <= take), lambda s: s["text"])
    text = F.array_join(F.array_sort(F.array_distinct(taken)), "\n")
    return g.select("sub_question_no", "question", F.when(F.col("_pool") < take, F.lit(NO_CORRECT_SAMPLE)).otherwise(text).alias("sample_text"))


def misconception_requests(
    rows: DataFrame, pool: str = "strict", seed: str = "1", chunk: int = WRONG_CHUNK, block: int = DEFAULT_BLOCK
) -> DataFrame:
    """One request row per (sub-question, wrong-answer chunk) with the question,
    the wrong-answer lines and the correct sample text; only sub-questions that
    have wrong answers appear. Three reads of ``rows``: the wrong answers, their
    counts per block, and one pass for the first text and the sample."""
    wrong = wrong_answer_text(rows, chunk, block)
    req = join_keys(wrong, first_and_sample(rows, pool, seed), ["sub_question_no"])
    text = F.concat(
        F.lit("Question: "), F.coalesce(F.col("question"), F.lit("")),
        F.lit("\nWrong answers:\n"), F.col("wrong_text"),
        F.lit("\nCorrect answers sample:\n"), F.col("sample_text"),
    )
    return req.select("sub_question_no", "chunk_no", "question", "n_lines", text.alias("request_text"))


# Fixed value: shape of a misconception reply.
MISCONCEPTION_REPLY = "misconception STRING, count STRING"


def merge_replies(replies: DataFrame) -> DataFrame:
    """R4, first half: replies (``sub_question_no``, raw reply text; one per R1
    chunk) to one misconception per sub-question.

    Replies are parsed like page replies (fence or outermost brackets); a count
    may be written ``4`` or ``4.0`` and is 0 when missing or not a number. Counts
    of equal themes are summed over the chunks, the largest sum wins, ties go to
    the smaller text; replies without a theme only count when there is no other.
    """
    from .pages import json_candidate

    r = replies.select("sub_question_no", F.from_json(json_candidate(F.col("reply")), MISCONCEPTION_REPLY).alias("r"))
    count = F.coalesce(F.col("r.count").try_cast("double"), F.lit(0.0))
    themes = r.groupBy("sub_question_no", F.col("r.misconception").alias("misconception")).agg(
        F.sum(count).try_cast("int").alias("misconception_frequency")
    )
    rank = F.struct(F.col("misconception").isNull(), -F.col("misconception_frequency"), F.col("misconception"))
    best = themes.groupBy("sub_question_no").agg(F.min_by(F.struct("misconception", "misconception_frequency"), rank).alias("b"))
    return best.select("sub_question_no", "b.misconception", "b.misconception_frequency")


def attach_misconceptions(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Merged replies left joined to the F1 statistics, one row per
    sub-question; null/0 where a sub-question got no reply."""
    out = join_keys(question_stats(rows), merge_replies(replies), ["sub_question_no"], "left")
    return out.select(
        "main_question_no", "question", "sub_question_no",
        F.col("attempts").cast("bigint").alias("attempts"),
        F.col("distinct_students").cast("bigint").alias("distinct_students"),
        F.col("correct_answers").cast("bigint").alias("correct_answers"),
        "correct_pct", "correct_pct_value", "misconception",
        F.coalesce(F.col("misconception_frequency"), F.lit(0)).alias("misconception_frequency"),
    )
