"""Page-grain operators: R3/D8 response ingest and rejects, C1/C2 flatten, G1 on
pages, F15 first/last question number, D5/D12 page range, F9 scan summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions.text import has_text, py_strip
from .clean import HEADER_TEXT
from .ordered import DEFAULT_BLOCK, carry_last

# Entries are maps, so that a missing field and a null field stay different.
PAGE_RESULT = T.StructType(
    [
        T.StructField("studentName", T.StringType()),
        T.StructField("entries", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    ]
)

# Markdown code fence around a reply, and the bracket-removal
# patterns of the two code generations (the service's is over-escaped and only
# removes backslash-delimited spans).
FENCE = "(?s)```(json)?\\s*(.*?)\\s*```"
SERVICE_BRACKETS = "\\\\(.*?\\\\)"
NOTEBOOK_BRACKETS = "\\(.*?\\)"
JSON_SPAN = "(?s)^[^{\\[]*(\\{.*\\}|\\[.*\\])"
NA = "N/A"
UNKNOWN = "Unknown"


def json_candidate(raw: Column) -> Column:
    """The JSON text inside a reply: a fenced block if there is one, else the
    span from the earliest ``{`` or ``[`` to the last matching closing bracket
    (greedy match); null when there is none.

    ``raw`` appears a fixed, small number of times, so filters that Catalyst
    pushes below this projection (copying the expression) stay small.
    """
    span = F.regexp_extract(raw, JSON_SPAN, 1)
    # a plain substring test first: replies without a fence skip the fence regex
    fenced = (F.instr(raw, "```") > 0) & raw.rlike(FENCE)
    return F.when(fenced, F.regexp_extract(raw, FENCE, 2)).otherwise(F.nullif(span, F.lit("")))


def parse_responses(df: DataFrame, raw: str = "raw_content") -> DataFrame:
    """R3 + D8: parse reply text into ``result`` and tag ``reject_reason`` (null
    for a valid page): ``invalid_json``, ``missing_keys`` (no ``studentName`` or
    no ``entries``), or ``bad_entries`` (``entries`` is not a list of objects).
    Every page is either rejected, or empty, or gives answer rows."""
    cand = json_candidate(F.col(raw))
    found = F.size(F.array_intersect(F.json_object_keys(cand), F.array(F.lit("studentName"), F.lit("entries"))))
    d = df.withColumns({"_found": found, "result": F.from_json(cand, PAGE_RESULT)})
    entries = F.col("result.entries")
    reason = (
        F.when(F.col("_found").isNull() | (F.col("_found") < 0), F.lit("invalid_json"))
        .when(F.col("_found") < 2, F.lit("missing_keys"))
        .when(entries.isNull() | F.exists(entries, lambda e: e.isNull()), F.lit("bad_entries"))
    )
    return d.withColumn("reject_reason", reason).drop("_found")


def response_rejects(df: DataFrame) -> DataFrame:
    """Pages that gave no valid result, with the reason."""
    return parse_responses(df).where(F.col("reject_reason").isNotNull()).select("scan_id", "page_no", "reject_reason")


def _entry_fields(e: Column, class_name: str | None, subject_name: str | None) -> list[Column]:
    """The columns of one entry; a missing field is ``''``, a null field stays null."""
    def field(k: str) -> Column:
        return F.when(F.map_contains_key(e, k), F.try_element_at(e, F.lit(k))).otherwise(F.lit(""))

    return [
        field("questionNo").alias("question_no_raw"),
        field("question").alias("question"),
        field("answer").alias("answer"),
        field("grading").alias("grading"),
        F.lit(class_name or UNKNOWN).alias("class_name"),
        F.lit(subject_name or UNKNOWN).alias("subject_name"),
    ]


def explode_pages(pages: DataFrame, class_name: str | None = None, subject_name: str | None = None) -> DataFrame:
    """C1 + C2 without the name carry: parsed valid pages -> one row per entry.
    Row-local, so it also runs on a stream."""
    p = parse_responses(pages).where(F.col("reject_reason").isNull())
    rows = p.select(
        "scan_id", "page_no", F.col("result.studentName").alias("student_raw"),
        F.posexplode("result.entries").alias("entry_ord", "e"),
    )
    return rows.select(
        "scan_id", "page_no", F.col("entry_ord").cast("int").alias("entry_ord"), "student_raw",
        *_entry_fields(F.col("e"), class_name, subject_name),
    )


def carried_pages(df: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """G1 on pages: ``scan_id, page_no, student_raw, student_name, entries`` of the
    valid pages. A page with both keys but unusable entries is no valid page, yet
    its student name is carried on, as the name is read first."""
    pages = parse_responses(df).where(F.col("reject_reason").isNull() | (F.col("reject_reason") == "bad_entries"))
    pages = pages.select(
        "scan_id", "page_no", F.col("result.studentName").alias("student_raw"), F.col("result.entries").alias("entries"),
        F.col("reject_reason").isNull().alias("_ok"),
    )
    pages = pages.withColumn("_nm", F.when(F.col("student_raw") != "", F.col("student_raw")))
    pages = carry_last(pages, ["scan_id"], "page_no", "_nm", "_carried", block)
    return pages.where("_ok").withColumn("student_name", F.coalesce("_carried", F.lit(""))).drop("_nm", "_carried", "_ok")


def flatten_pages(
    df: DataFrame,
    class_name: str | None = None,
    subject_name: str | None = None,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """C1 + C2 + G1: valid pages -> one row per entry, carrying the last non-blank
    student name of the scan. Class and subject default to ``Unknown``."""
    rows = carried_pages(df, block).select(
        "scan_id", "page_no", "student_raw", "student_name", F.posexplode("entries").alias("entry_ord", "e")
    )
    return rows.select(
        "scan_id", "page_no", F.col("entry_ord").cast("int").alias("entry_ord"), "student_raw", "student_name",
        *_entry_fields(F.col("e"), class_name, subject_name),
    )


def page_placeholders(df: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Valid pages without entries, as records with the student name only."""
    return carried_pages(df, block).where(F.size("entries") == 0).select("scan_id", "page_no", "student_name")


def page_question_bounds(df: DataFrame, number: str = "question_no_raw") -> DataFrame:
    """first and last all-digit question number per page, in entry order, for
    both code generations (service: bracket parts kept; notebook: removed);
    ``N/A`` when a page has none. One map-side-combined aggregate per page."""
    svc = py_strip(F.regexp_replace(F.col(number), SERVICE_BRACKETS, ""))
    nb = py_strip(F.regexp_replace(F.col(number), NOTEBOOK_BRACKETS, ""))
    d = df.select("scan_id", "page_no", "entry_ord", svc.alias("_svc"), nb.alias("_nb"))

    def ends(c: str) -> list[Column]:
        o = F.when(N.is_digits(c), F.col("entry_ord"))
        return [
            F.coalesce(F.min_by(c, o), F.lit(NA)).alias(f"first_{c[1:]}"),
            F.coalesce(F.max_by(c, o), F.lit(NA)).alias(f"last_{c[1:]}"),
        ]

    out = d.groupBy("scan_id", "page_no").agg(*ends("_svc"), *ends("_nb"))
    return out.select(
        "scan_id",
        "page_no",
        F.col("first_svc").alias("first_service"),
        F.col("last_svc").alias("last_service"),
        F.col("first_nb").alias("first_notebook"),
        F.col("last_nb").alias("last_notebook"),
    )


def page_range(df: DataFrame, start: int | None = 1, end: int | None = None, max_pages: int | None = None) -> DataFrame:
    """D5 + D12: keep pages ``max(1,start) .. min(end, last page)`` and at most
    ``max_pages``. Clamping ``end`` to the scan's last page never excludes a page
    that exists, so no per-scan total (and no shuffle) is needed: this is a pure,
    pushed-down filter."""
    lo = max(1, start or 1)
    cond = F.col("page_no") >= F.lit(lo)
    if end is not None:
        cond = cond & (F.col("page_no") <= F.lit(end))
    if max_pages is not None:
        cond = cond & (F.col("page_no") <= F.lit(max_pages))
    return df.where(cond)


def job_summary(df: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """F9 from the landed replies: every landed page counts as processed, also one
    that was refused or has no entries; entries before cleaning; over cleaned rows
    the distinct students and questions, non-blank answers (null counts, N3) and
    graded answers. A scan without any entry has zeros.

    Each distinct count is a plain aggregate at its own grain, so no row is
    repeated per distinct: pages by (scan, page), students by (scan, name) over
    pages with a kept entry, questions by (scan, number) over entries.
    """
    def kept(question: Column) -> Column:
        return question.isNotNull() & ~F.coalesce(question.contains(HEADER_TEXT), F.lit(False))

    pages = df.groupBy("scan_id", "page_no").agg(F.lit(1).alias("_one"))
    pages = pages.groupBy("scan_id").agg(F.count(F.lit(1)).alias("pages_processed"), F.min("page_no").alias("start_page"))
    # a missing question is an empty text (C1), a null one drops the entry
    any_kept = F.exists("entries", lambda e: ~F.map_contains_key(e, "question") | F.coalesce(kept(F.try_element_at(e, F.lit("question"))), F.lit(False)))
    students = carried_pages(df, block).where(any_kept).groupBy(F.col("scan_id").alias("_s"), "student_name").agg(F.lit(1).alias("_one"))
    students = students.groupBy("_s").agg(F.count("student_name").alias("students_found"))
    answered = F.col("answer").isNull() | has_text("answer")
    graded = F.col("grading").isin("Correct", "Incorrect")
    keep = kept(F.col("question"))
    numbers = explode_pages(df).withColumn("question_no", N.normalize_question_number("question_no_raw"))
    numbers = numbers.groupBy(F.col("scan_id").alias("_q"), "question_no").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(keep).alias("_kept"),
        F.count_if(keep & answered).alias("_answered"), F.count_if(keep & graded).alias("_graded"),
    )
    numbers = numbers.groupBy("_q").agg(
        F.sum("_n").alias("total_entries"), F.count_if((F.col("_kept") > 0) & F.col("question_no").isNotNull()).alias("total_questions"),
        F.sum("_answered").alias("total_answers"), F.sum("_graded").alias("graded_answers"),
    )
    out = pages.join(students, F.col("scan_id") == F.col("_s"), "left").join(numbers, F.col("scan_id") == F.col("_q"), "left")
    counts = ["total_entries", "students_found", "total_questions", "total_answers", "graded_answers"]
    last = (F.col("start_page") + F.col("pages_processed") - 1).alias("end_page")
    return out.select("scan_id", "pages_processed", "start_page", last, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def scan_summary(df: DataFrame, block: int = DEFAULT_BLOCK) -> DataFrame:
    """per scan, the job summary: entries before cleaning, pages processed,
    start/end page, and over cleaned rows the distinct students and questions,
    non-blank answers (null counts, N3) and graded answers (D6, D7).

    A single aggregation keyed by scan: the cleaning predicate becomes a
    condition inside each aggregate instead of a second pass and a join.
    """
    from .clean import carry_student

    d = carry_student(df, block).withColumn("question_no", N.normalize_question_number("question_no_raw"))
    keep = F.coalesce(~F.col("question").contains(HEADER_TEXT), F.lit(True)) & F.col("question").isNotNull()
    answered = F.col("answer").isNull() | has_text("answer")
    graded = F.col("grading").isin("Correct", "Incorrect")
    agg = d.groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct("page_no").alias("pages_processed"),
        F.min("page_no").alias("start_page"),
        F.count_distinct(F.when(keep, F.col("student_name"))).alias("students_found"),
        F.count_distinct(F.when(keep, F.col("question_no"))).alias("total_questions"),
        F.count_if(keep & answered).alias("total_answers"),
        F.count_if(keep & graded).alias("graded_answers"),
    )
    return agg.withColumn("end_page", F.col("start_page") + F.col("pages_processed") - 1)


def image_rows(files: DataFrame) -> DataFrame:
    """Page images read back from ``write_page_files`` as ``page_id``, the derived
    image name, the bytes' length and their base64 text on one line."""
    page = F.regexp_extract("path", "/(?:part-)?page_id=(-?[0-9]+)(?:/|\\.txt$)", 1).cast("bigint")
    body = F.substring("content", F.lit(1), (F.col("length") - 1).cast("int"))
    return files.select(
        page.alias("page_id"),
        F.concat(F.lit("page_"), page.cast("string"), F.lit(".png")).alias("image_name"),
        (F.col("length") - 1).alias("n_bytes"),
        F.translate(F.base64(body), "\r\n", "").alias("b64"),
    )
