"""Cleaning operators: R7 (transcription), G1 (student carry), R6 (question list),
G2/J8 (question-number context), G3 (duplicate audit), G4 (first per text).

Every function is DataFrame -> DataFrame and lazy. File order is the ``row_id``
column (unique, increasing with scan, page and entry order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import py_strip, strip_name_junk
from .ordered import DEFAULT_BLOCK, carry_last

HEADER_TEXT = "Question No"


def carry_student(df: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """G1: ``student_name`` = last non-blank ``student_raw`` so far within the scan.

    Leading pages without a name stay ``''``. Runs blocked by ``row_id`` so a
    single enormous scan is still spread over many tasks.
    """
    d = df.withColumn("_nm", F.when(F.col("student_raw") != "", F.col("student_raw")))
    d = carry_last(d, ["scan_id"], "row_id", "_nm", "_carried", block)
    return d.withColumn("student_name", F.coalesce(F.col("_carried"), F.lit(""))).drop("_nm", "_carried")


def clean_transcription(
    df: DataFrame,
    header_column: str = "question",
    null_number_as: str | None = None,
    strict_page: bool = False,
    number_is_clean: bool = False,
) -> DataFrame:
    """R7 = J7 -> C8 -> J1 -> J2 -> D1 -> D2, in that order; idempotent.

    ``header_column`` is where repeated header rows are detected (the service
    tests the question text, the notebook the number). ``null_number_as='nan'``
    keeps the reference's text for a null number.
    """
    page = F.col("page_no").try_cast("int")
    if strict_page:
        page = F.when(page.isNotNull(), page).otherwise(F.raise_error(F.lit("page_no is not an integer")))
    number = "question_no_raw" if "question_no_raw" in df.columns else "question_no"
    qno = F.col(number) if number_is_clean else N.normalize_question_number(number, null_number_as)
    out = df.withColumns(
        {
            "class_name": strip_name_junk("class_raw") if "class_raw" in df.columns else strip_name_junk("class_name"),
            "subject_name": strip_name_junk("subject_raw")
            if "subject_raw" in df.columns
            else strip_name_junk("subject_name"),
            "page_no": page,
            "question_no": qno,
        }
    )
    not_header = F.coalesce(~F.col(header_column).contains(HEADER_TEXT), F.lit(True))
    return out.where(not_header & F.col("question").isNotNull())


def clean_transcription_notebook(df: DataFrame) -> DataFrame:
    """R7, notebook generation: J7 -> drop null numbers -> header test on the raw
    number -> C8 -> J1 -> J2 -> header test again. The header test looks at the
    number column (a re-read file's header line carries ``Question No`` there);
    rows with a null question text are kept."""
    number = "question_no_raw" if "question_no_raw" in df.columns else "question_no"
    not_header = ~F.coalesce(F.col(number).contains(HEADER_TEXT), F.lit(False))
    d = df.withColumns(
        {
            "class_name": strip_name_junk("class_raw" if "class_raw" in df.columns else "class_name"),
            "subject_name": strip_name_junk("subject_raw" if "subject_raw" in df.columns else "subject_name"),
        }
    ).where(F.col(number).isNotNull() & not_header)
    d = d.withColumns({"page_no": F.col("page_no").try_cast("int"), "question_no": N.normalize_question_number(number)})
    return d.where(~F.coalesce(F.col("question_no").contains(HEADER_TEXT), F.lit(False)))


def analysis_rows(df: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Cleaned answer rows with carried student names, main and sub numbers.

    The common input of every question-level statistic.
    """
    # Normalise the number before the carry's shuffle: computed once per row in
    # the map-side projection, and downstream operators see a plain column.
    pre = df.withColumns(
        {
            "question_no": N.normalize_question_number("question_no_raw"),
            # null exactly when the normalised number is null; a cheap column to
            # filter on, so pushed-down filters do not drag the regex chain along
            "has_number": F.col("question_no_raw").isNotNull(),
        }
    ).drop("question_no_raw")
    t = clean_transcription(carry_student(pre, block), number_is_clean=True)
    return t.select(
        "scan_id",
        "page_no",
        "entry_ord",
        "row_id",
        "student_name",
        "question_no",
        N.main_question_number("question_no").alias("main_question_no"),
        N.sub_question_number("question_no").alias("sub_question_no"),
        "question",
        "answer",
        "grading",
        "class_name",
        "subject_name",
        "has_number",
    )


def context_numbers(
    df: DataFrame,
    keys: Sequence[str] = ("file_id",),
    order: str = "row_ord",
    cell: str = "question_no",
    out: str = "question_no_clean",
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """G2 + J8: bracket every letter run after the number, carrying the last
    leading number of the file into rows that have none.

    Blank cells (null, whitespace, ``nan``) give ``''`` and do not change the
    context; cells without a number and without any earlier number are kept as
    delimited text.
    """
    raw = F.col(cell)
    stripped = py_strip(raw)
    blank = raw.isNull() | (stripped == "") | (F.lower(stripped) == "nan")
    s = N.delimit_cell(raw)
    main = N.leading_number(s)
    d = df.withColumns(
        {
            "_blank": blank,
            "_s": s,
            "_main": F.when(~blank & (main != ""), main),
        }
    )
    d = carry_last(d, list(keys), order, "_main", "_ctx", block)
    parts = N.letter_parts("_s")
    value = (
        F.when(F.col("_blank"), F.lit(""))
        .when(F.col("_main").isNotNull(), F.concat(F.col("_main"), parts))
        .when(F.col("_ctx").isNotNull() & N.has_letters("_s"), F.concat(F.col("_ctx"), parts))
        .otherwise(F.col("_s"))
    )
    return d.withColumn(out, value).drop("_blank", "_s", "_main", "_ctx")


def first_per_text(df: DataFrame, text: str = "question", order: str = "row_id") -> DataFrame:
    """Keep the first row (file order) for every distinct ``text``; nulls dropped.

    ``order`` is unique. Its smallest value per text is a hash aggregate with
    map-side partial results, so a text repeated by a third of all rows is reduced
    before the shuffle; the rows themselves are fetched by it afterwards.
    """
    first = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("_text")).agg(F.min(order).alias("_first"))
    return df.join(first, (F.col(order) == F.col("_first")) & (F.col(text) == F.col("_text")), "left_semi")


def discover_question_columns(columns: Sequence[str]) -> dict[str, str]:
    """C3 (driver side, over column names only): a name containing ``question``
    and ``no`` is the number, one containing ``question`` without ``no`` the
    text. Raises when either is missing or ambiguous (e.g. "Question Notes"
    also contains "no")."""
    number = [c for c in columns if "question" in c.lower().strip() and "no" in c.lower().strip()]
    text = [c for c in columns if "question" in c.lower().strip() and "no" not in c.lower().strip()]
    if len(number) != 1 or len(text) != 1:
        raise ValueError(f"need exactly one question-number and one question column, got {number} / {text}")
    return {number[0]: "question_no", text[0]: "question"}


def clean_question_list(df: DataFrame, number: str = "question_no", text: str = "question") -> DataFrame:
    """R6 = D2 -> J6 -> G4 -> J3 -> I1 (that order); dedup by text precedes J3,
    so one number can repeat with different texts."""
    q = df.where(F.col(number).isNotNull() & F.col(text).isNotNull()).withColumn(number, N.integer_text(number))
    q = first_per_text(q, text=text)
    q = q.withColumn(number, N.base_question_number(number))
    return q.select(number, text).distinct()


def notebook_question_list(df: DataFrame, number: str = "question_no", text: str = "question") -> DataFrame:
    """R6, notebook generation: rows with a number and a text, whole numbers
    written as integers, duplicates dropped; one text may keep several numbers."""
    q = df.where(F.col(number).isNotNull() & F.col(text).isNotNull())
    return q.select(N.integer_text(number).alias(number), text).distinct()


def page_rejects(df: DataFrame, page: str = "page_no") -> DataFrame:
    """Rows whose page number is given but is no integer (``clean_transcription`` nulls it)."""
    return df.where(F.col(page).isNotNull() & F.col(page).try_cast("int").isNull())


def duplicate_answers(df: DataFrame, keys: Sequence[str] = ("scan_id", "student_name", "question_no")) -> DataFrame:
    """Every row whose (scan, student, number) occurs more than once; null keys
    match null keys.

    Counted with a map-side-combined groupBy and joined back null-safely, instead
    of a window, so a hot key is pre-aggregated and AQE can split the probe side.
    """
    keys = list(keys)
    alias = {k: f"_k{i}" for i, k in enumerate(keys)}
    counts = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("dup_count"))
        .where(F.col("dup_count") > 1)
        .select(*[F.col(k).alias(a) for k, a in alias.items()], "dup_count")
    )
    cond = [F.col(k).eqNullSafe(F.col(a)) for k, a in alias.items()]
    return df.join(counts, on=cond, how="inner").drop(*alias.values())

