"""Bulk import of report rows with flexible headers (R8 = A4 -> C4 -> C5 -> C6 ->
skip blank -> C7 -> B7, with the F13 tally).

Header mapping is metadata work over column *names* (a handful per file), done
on the driver; every value is handled by Spark expressions, and files with
different headers meet in one ``unionByName``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import CORRUPT

# Header aliases (normalised spelling -> canonical column).
KEY_MAP = {
    "studentname": "student_name",
    "student name": "student_name",
    "questionno": "question_no",
    "question no": "question_no",
    "question number": "question_no",
    "pagenumber": "page_number",
    "page number": "page_number",
    "classname": "class_name",
    "class name": "class_name",
    "subjectname": "subject_name",
    "subject name": "subject_name",
    "question": "question",
    "answer": "answer",
    "grading": "grading",
    "grade": "grading",
    "marks": "grading",
    "score": "grading",
}

# Columns of the reporting table, and values that count as blank.
REPORT_COLUMNS = [
    "exam_id", "student_name", "class_name", "subject_name", "question_no", "question", "answer", "page_number",
    "grading",
]
BLANK_VALUES = ["", "nan", "NaN"]
DEFAULT_SUBJECT = "SST"


def normalize_header(name: str) -> str:
    """J11 (driver side, over a column name): lower, strip, collapse ``_``/space runs."""
    return re.sub(r"[_\s]+", " ", str(name).lower().strip())


def map_header(name: str) -> str:
    n = normalize_header(name)
    return KEY_MAP.get(n, n.replace(" ", "_"))


def header_mapping(columns: Iterable[str]) -> dict[str, list[str]]:
    """C4 + C6: canonical column -> source columns in file order; unknown
    columns are ignored."""
    out: dict[str, list[str]] = {}
    for c in columns:
        target = map_header(c)
        if target in REPORT_COLUMNS and target != "exam_id":
            out.setdefault(target, []).append(c)
    return out


def _value(c: str):
    v = F.col(f"`{c}`").cast("string")
    return F.when(v.isNull() | v.isin(*BLANK_VALUES), F.lit(None).cast("string")).otherwise(v)


def canonical_records(df: DataFrame, source: str, keep_blank: bool = False) -> DataFrame:
    """C4 + C5 + C6 for one file: canonical string columns (blank values dropped;
    when several headers map to one column the last non-blank wins) plus
    ``source_file``; all-blank records removed before anything is counted, or kept
    with ``blank`` true."""
    mapping = header_mapping(df.columns)
    cols = []
    for target in REPORT_COLUMNS[1:]:
        srcs = mapping.get(target, [])
        expr = F.coalesce(*[_value(s) for s in reversed(srcs)]) if srcs else F.lit(None).cast("string")
        cols.append(expr.alias(target))
    d = df.select(F.lit(source).alias("source_file"), *cols)
    some = F.coalesce(*[F.col(c) for c in REPORT_COLUMNS[1:]]).isNotNull()
    return d.withColumn("blank", ~some) if keep_blank else d.where(some)


def unknown_columns(columns: Iterable[str]) -> list[str]:
    """Source columns that map to no reporting column."""
    return [c for c in columns if map_header(c) not in REPORT_COLUMNS]


def import_records(
    files: list[tuple[str, DataFrame]],
    exam_id: int,
    default_subject: str = DEFAULT_SUBJECT,
    default_class: str | None = None,
    strict_columns: bool = False,
    keep_blank: bool = False,
) -> DataFrame:
    """Union of every file's canonical records with C7 defaults applied;
    ``accepted`` is false where the page number is not an integer (the row the
    reporting table would refuse). With ``strict_columns`` every record of a
    file that has a column outside the reporting table is refused (the
    stricter importer's behaviour); by default such columns are ignored. With
    ``keep_blank`` all-blank records stay, marked ``blank`` and not accepted."""
    recs = None
    for name, df in files:
        r = canonical_records(df, name, keep_blank)
        refused = strict_columns and bool(unknown_columns(df.columns))
        r = r.withColumn("_file_ok", F.lit(not refused))
        recs = r if recs is None else recs.unionByName(r)
    page = F.col("page_number")
    out = recs.withColumns(
        {
            "exam_id": F.lit(exam_id).cast("bigint"),
            "subject_name": F.coalesce(F.col("subject_name"), F.lit(default_subject)),
            "class_name": F.coalesce(F.col("class_name"), F.lit(default_class).cast("string")),
            "accepted": F.col("_file_ok") & (page.isNull() | page.try_cast("int").isNotNull()),
            "page_number": page.try_cast("int"),
        }
    )
    if keep_blank:
        return out.withColumn("accepted", F.col("accepted") & ~F.col("blank")).select("source_file", *REPORT_COLUMNS, "accepted", "blank")
    return out.select("source_file", *REPORT_COLUMNS, "accepted")


def header_target(name: Column) -> Column:
    """J11 + C4 as an expression: the canonical column of a header cell, null for unknown ones."""
    n = F.btrim(F.regexp_replace(F.btrim(F.lower(name), F.lit(" \t\n\r\f\x0b")), "[_\\s]+", " "))
    known = F.create_map(*[F.lit(x) for pair in KEY_MAP.items() for x in pair])
    own = F.replace(n, F.lit(" "), F.lit("_"))
    plain = F.when(own.isin(*REPORT_COLUMNS[1:]), own)
    return F.coalesce(F.try_element_at(known, n), plain, F.when(name == CORRUPT, F.lit(CORRUPT)))


def folder_records(
    cells: DataFrame,
    exam_id: int,
    default_subject: str = DEFAULT_SUBJECT,
    default_class: str | None = None,
    strict_columns: bool = False,
) -> DataFrame:
    """R8 over a folder read in one scan (``files.read_folder_cells`` with
    ``header_target``): the same records as ``import_records`` of its files, with
    every file's header resolved inside the query. A corrupt JSON line is a
    record of its own that is not accepted, with its text as the answer."""
    corrupt = F.exists("cells", lambda c: c["name"].eqNullSafe(F.lit(CORRUPT)))
    d = cells.select("source_file", F.filter("cells", lambda c: c["name"].isNotNull() & c["value"].isNotNull() & ~c["value"].isin(*BLANK_VALUES)).alias("_c"),
                     F.exists("cells", lambda c: c["name"].isNull()).alias("_unknown"), corrupt.alias("_corrupt"))

    def last(target: str) -> Column:
        wanted = [target, CORRUPT] if target == "answer" else [target]
        return F.try_element_at(F.filter("_c", lambda c: c["name"].isin(*wanted)), F.lit(-1))["value"]

    d = d.select("source_file", "_unknown", "_corrupt", *[last(t).alias(t) for t in REPORT_COLUMNS[1:]])
    d = d.where(F.coalesce(*[F.col(c) for c in REPORT_COLUMNS[1:]]).isNotNull())
    page = F.col("page_number")
    out = d.withColumns(
        {
            "exam_id": F.lit(exam_id).cast("bigint"),
            "subject_name": F.coalesce(F.col("subject_name"), F.lit(default_subject)),
            "class_name": F.coalesce(F.col("class_name"), F.lit(default_class).cast("string")),
            "accepted": (page.isNull() | page.try_cast("int").isNotNull()) & ~(F.lit(strict_columns) & F.col("_unknown")) & ~F.col("_corrupt"),
            "page_number": page.try_cast("int"),
        }
    )
    return out.select("source_file", *REPORT_COLUMNS, "accepted")


def import_tally(records: DataFrame) -> DataFrame:
    """per file and overall (``source_file`` = ``ALL``): records counted and
    records inserted; one rollup aggregate."""
    agg = records.rollup("source_file").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("accepted")).alias("inserted"),
        F.grouping("source_file").alias("_g"),
    )
    return agg.select(
        F.when(F.col("_g") == 1, F.lit("ALL")).otherwise(F.col("source_file")).alias("source_file"), "total", "inserted"
    )
