"""Exam-shaped inputs derived from the driver tables.

Each function is the DataFrame form of one adapter in FIXTURES.md §3; the SQL
form used by the DuckDB oracle lives in ``examlytics.plans.oracle``. Every
adapter is a narrow projection (plus one page-grain aggregate), so its cost grows
linearly with the source table and it never shuffles more than the page grain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread, table

ROWS_PER_SCAN = 250
ROWS_PER_PAGE = 5


def _s(c: Column) -> Column:
    return c.cast("string")


def transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer rows (C1 output): 250 rows per scan, 5 per page, 4 pages per paper."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id")
    eid = F.col("event_id")
    e = ev.select(
        "*",
        F.floor(eid / 250.0).cast("bigint").alias("scan_id"),
        (F.floor((eid % 250) / 5.0).cast("int") + 1).alias("page_no"),
        (eid % 5).cast("int").alias("entry_ord"),
        ((eid % 20).cast("int") + 1).alias("m"),
    )
    m = F.col("m")
    q = e.select(
        "*",
        F.when(m % 3 == 0, "a").when(m % 3 == 1, "b").otherwise("c").alias("l"),
        F.when(m % 2 == 0, "i").otherwise("ii").alias("r"),
        _s(m).alias("ms"),
    )
    scan, page, ms, l, r = F.col("scan_id"), F.col("page_no"), F.col("ms"), F.col("l"), F.col("r")
    uid = F.col("user_id")
    et = F.col("event_type")
    student = F.when(((page - 1) % 4 != 0) | ((page == 1) & (scan % 5 == 0)), F.lit("")).otherwise(
        F.concat(F.lit("Student "), _s((scan * 13 + F.floor((page - 1) / 4.0).cast("bigint")) % 97))
    )
    qno = (
        F.when(uid % 6 == 0, F.concat(ms, F.lit("("), l, F.lit(")("), r, F.lit(")")))
        .when(uid % 6 == 1, F.concat(ms, F.lit("."), l, F.lit("."), r))
        .when(uid % 6 == 2, F.concat(ms, l, F.lit("("), r, F.lit(")")))
        .when(uid % 6 == 3, F.concat(ms, F.lit(".("), l, F.lit(")."), r))
        .when(uid % 6 == 4, F.concat(ms, F.lit(" ("), l, F.lit(") ("), r, F.lit(")")))
        .otherwise(F.concat(ms, F.lit("."), l))
    )
    question = (
        F.when(eid % 97 == 0, F.lit("Question No"))
        .when(eid % 89 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Question text "), ms, l))
    )
    answer = (
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
        .when(eid % 13 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("answer "), _s(F.floor("value").cast("bigint") % 5)))
    )
    grading = (
        F.when(et.isin("purchase", "signup"), F.lit("Correct"))
        .when(et == "error", F.lit("Incorrect"))
        .when(et == "view", F.lit("Not Graded"))
        .otherwise(F.when(uid % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("")))
    )
    subject = (
        F.when(scan % 5 == 0, "SST").when(scan % 5 == 1, "Mathematics").when(scan % 5 == 2, "Science")
        .when(scan % 5 == 3, "English").otherwise("CRE")
    )
    return q.select(
        "scan_id",
        "page_no",
        "entry_ord",
        eid.alias("row_id"),
        student.alias("student_raw"),
        qno.alias("question_no_raw"),
        question.alias("question"),
        answer.alias("answer"),
        grading.alias("grading"),
        F.concat(F.lit("(P"), _s(scan % 7), F.lit(")")).alias("class_raw"),
        F.concat(F.lit("["), subject, F.lit("]")).alias("subject_raw"),
        F.col("ts").alias("landed_at"),
    )


def exam_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page grain (one row per scanned page)."""
    return (
        transcription(spark, sf_dir)
        .groupBy("scan_id", "page_no")
        .agg(
            F.max("student_raw").alias("student_raw"),
            F.count(F.lit(1)).alias("n_entries"),
            F.max("landed_at").alias("landed_at"),
        )
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed model reply text per page: bare, fenced, with prose, truncated, with missing
    keys or fields, and with entries that are empty, null, text or a mixed list."""
    t = transcription(spark, sf_dir)

    def quoted(c: str) -> Column:
        return F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("null"))

    js = F.concat(
        F.lit('{"questionNo": "'), F.col("question_no_raw"), F.lit('", "question": '), quoted("question"),
        F.lit(', "answer": '), quoted("answer"), F.lit(', "grading": '), quoted("grading"), F.lit("}"),
    )
    j = t.select("scan_id", "page_no", "entry_ord", "student_raw", js.alias("js"))
    parts = [F.max(F.when(F.col("entry_ord") == k, F.col("js"))) for k in range(5)]
    sep = F.lit(", ")
    obj = F.concat(
        F.lit('{"studentName": "'), F.max("student_raw"), F.lit('", "entries": ['),
        parts[0], sep, parts[1], sep, parts[2], sep, parts[3], sep, parts[4], F.lit("]}"),
    )
    p = j.groupBy("scan_id", "page_no").agg(obj.alias("obj"), F.max("student_raw").alias("student"))
    key = F.col("scan_id") * 50 + F.col("page_no")
    fence = F.lit("```")
    nl = F.lit("\n")

    def only(entries: str) -> Column:
        return F.concat(F.lit('{"studentName": "'), F.col("student"), F.lit('", "entries": ' + entries + "}"))

    raw = (
        F.when(key % 17 == 0, F.substring("obj", 1, 40))
        .when(key % 19 == 0, F.lit('{"studentName": "X"}'))
        .when(key % 23 == 0, only("[]"))
        .when(key % 29 == 0, only("null"))
        .when(key % 31 == 0, only('"none"'))
        .when(key % 37 == 0, only('[{"questionNo": "1"}, "text"]'))
        .when(key % 41 == 0, only('[{"questionNo": "1(a)"}, {"answer": null}]'))
        .when(F.col("page_no") % 5 == 1, F.concat(fence, F.lit("json"), nl, F.col("obj"), nl, fence))
        .when(F.col("page_no") % 5 == 2, F.concat(F.lit("Here is the result: "), F.col("obj"), F.lit(" Done.")))
        .when(F.col("page_no") % 5 == 4, F.concat(fence, nl, F.col("obj"), nl, fence))
        .otherwise(F.col("obj"))
    )
    return p.select("scan_id", "page_no", raw.alias("raw_content"))


def number_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question-number cells in file order, one file per 250 rows."""
    eid = F.col("event_id")
    ms = ((eid % 20).cast("int") + 1).cast("string")
    l = F.when(eid % 3 == 0, "a").when(eid % 3 == 1, "b").otherwise("c")
    r = F.when(eid % 2 == 0, "i").otherwise("ii")
    k = eid % 8
    cell = (
        F.when(k == 0, l)
        .when(k == 1, F.concat(ms, l, F.lit(" "), r))
        .when(k == 2, F.concat(l, r))
        .when(k == 3, F.lit(""))
        .when(k == 4, F.concat(F.lit("Either "), l))
        .when(k == 5, F.concat(ms, F.lit("."), l, F.lit("."), r))
        .when(k == 6, F.lit("*"))
        .otherwise(F.lit(None).cast("string"))
    )
    return spread(table(spark, sf_dir, "events").select("event_id"), "event_id").select(
        F.floor(eid / 250.0).cast("bigint").alias("file_id"), eid.alias("row_ord"), cell.alias("question_no")
    )


def import_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import file whose headers are aliases; two columns map to grading; unknown column foo."""
    t = transcription(spark, sf_dir).where(F.col("scan_id") % 2 == 0)
    rid = F.col("row_id")
    return t.select(
        F.col("student_raw").alias("Student Name"),
        F.col("question_no_raw").alias("questionNo"),
        F.col("question").alias("Question"),
        F.when(rid % 5 == 0, F.lit("nan")).otherwise(F.col("answer")).alias("answer"),
        F.col("grading").alias("marks"),
        F.when(rid % 3 == 0, F.lit("Incorrect")).otherwise(F.lit("")).alias("score"),
        F.when(rid % 7 == 0, F.lit("page?")).otherwise(F.col("page_no").cast("string")).alias("Page_Number"),
        F.lit("x").alias("foo"),
    )


def import_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import file with other headers; rows with row_id % 50 = 1 are all-blank records."""
    t = transcription(spark, sf_dir).where(F.col("scan_id") % 2 == 1)
    blank = F.col("row_id") % 50 == 1
    return t.select(
        F.when(blank, F.lit(None).cast("string")).otherwise(F.col("student_raw")).alias("student_name"),
        F.when(blank, F.lit("")).otherwise(F.col("question_no_raw")).alias("Question Number"),
        F.when(blank, F.lit("NaN")).otherwise(F.col("grading")).alias("grade"),
        F.when(blank, F.lit(None).cast("string")).otherwise(F.col("subject_raw")).alias("Subject  Name"),
    )


def exam_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_regionkey") == 4, F.lit(99)).otherwise(F.col("n_regionkey")).alias("exam_type_id"),
        F.when(k % 4 == 0, "Midterm").when(k % 4 == 1, "End of Term").when(k % 4 == 2, "Mocks")
        .otherwise("Quiz").alias("type_name"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of every supplier; exams whose id is a multiple of three have none."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        F.when(n % 3 == 0, n + 1).otherwise(n).alias("exam_id"),
        F.concat(F.col("s_name"), F.lit(".pdf")).alias("filename"),
        F.when(k % 4 == 0, "queued").when(k % 4 == 1, "processing").when(k % 4 == 2, "completed")
        .otherwise("failed").alias("status"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.col("c_nationkey").alias("exam_id"),
        F.when(k % 4 == 0, "transcription").when(k % 4 == 1, "analysis").when(k % 4 == 2, "transcription_analysis")
        .otherwise("other").alias("report_type"),
    )


def exam_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patches per exam: both fields, one field twice (the later wins), or one set to null."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    first = n.select(
        k.alias("id"),
        F.lit(1).alias("patch_ord"),
        F.when(k % 3 == 1, "exam_type_id").otherwise("name").alias("set_field"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("New "), F.col("n_name"))).alias("name"),
        F.lit(3).cast("int").alias("exam_type_id"),
    )
    second = n.select(
        k.alias("id"),
        F.lit(2).alias("patch_ord"),
        F.when(k % 3 == 2, "exam_type_id").when(k % 4 == 0, "name").otherwise("none").alias("set_field"),
        F.concat(F.lit("Newer "), F.col("n_name")).alias("name"),
        F.when(k % 2 == 0, F.lit(None).cast("int")).otherwise(F.lit(2)).cast("int").alias("exam_type_id"),
    )
    return first.unionByName(second)


def topic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic replies: 15 numbers, some repeated, some question numbers missing."""
    m = (F.col("n_nationkey") % 15 + 1).cast("int")
    letter = F.when(m % 3 == 0, "a").when(m % 3 == 1, "b").otherwise("c")
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("result_ord"),
        F.concat(m.cast("string"), F.lit("("), letter, F.lit(")")).alias("question_no"),
        F.concat(F.lit("Topic "), F.col("n_regionkey").cast("string")).alias("topic"),
        (F.col("n_regionkey") / 4.0).cast("double").alias("confidence"),
        F.when(F.col("n_nationkey") % 4 != 1, F.concat(F.lit("Because of "), F.col("n_name"))).alias("explanation"),
        (F.col("n_nationkey") % 5 != 2).alias("batch_ok"),
    )


def topic_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.col("p_name")
    subject = (
        F.when(k % 41 == 0, F.lit(None).cast("string")).when(k % 6 == 0, "SST").when(k % 6 == 1, "Mathematics").when(k % 6 == 2, "Science")
        .when(k % 6 == 3, "English").when(k % 6 == 4, "CRE").otherwise("Art")
    )
    question = (
        F.when(k % 7 == 0, F.lit("Convert fractions to decimals"))
        .when(k % 7 == 1, F.concat(F.lit("Name the forces and energy in a "), name))
        .when(k % 7 == 2, F.concat(F.lit("Grammar of the sentence "), name))
        .when(k % 7 == 3, F.lit("Prayer and worship in church"))
        .when(k % 7 == 4, F.concat(F.lit("Describe history and geography of "), name))
        .when(k % 7 == 5, F.concat(F.lit("Draw the geometry of "), name))
        .otherwise(F.concat(F.lit("What is a "), name))
    )
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"), k.cast("string").alias("question_no"), subject.alias("subject"), question.alias("question")
    )


def incoming_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    a = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.when(k % 2 == 0, "Mocks").otherwise("Quiz").alias("type_name"), k.cast("int").alias("in_ord")
    )
    s = F.col("s_suppkey")
    b = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Exam "), F.col("s_name")).alias("name"),
        F.when(s % 3 == 0, "Midterm").when(s % 3 == 1, "End of Term").otherwise("Quiz").alias("type_name"),
        (F.lit(1000) + s).cast("int").alias("in_ord"),
    )
    return a.unionByName(b)


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages.html`` as binary stands in for landed page images."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content"))
