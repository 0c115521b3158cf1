"""Goldens for the scalar functions (FIXTURES.md §2)."""

from conftest import col_values

from examlytics.functions import numbers as N
from examlytics.functions import text as TX


def test_fix_and_standardize(spark):
    cases = {
        "12.a.iv": "12(a)(iv)", "12.a": "12(a)", "12.(a).ii": "12(a)(ii)", "12.(a)(ii)": "12(a)(ii)",
        "12 (a) (ii)": "12(a)(ii)", "12a(ii)": "12(a)(ii)", "12a": "12(a)", "12aii": "12(a)ii", "1. a": "1.a",
        "12.A.i": "12.A.i", "12.0": "12.0", "12.ab.i": "12(ab)(i)", "41(b)(ii)": "41(b)(ii)",
    }
    got = col_values(spark, list(cases), N.normalize_question_number)
    assert got == list(cases.values())
    assert col_values(spark, [None], lambda c: N.normalize_question_number(c, null_as="nan")) == ["nan"]
    assert col_values(spark, [None], N.normalize_question_number) == [None]


def test_base_number(spark):
    cases = {"12(a)(ii)": "12(a)", "12(i)": "12", "3 iv": "3", "3_ii": "3", "v": "", "12(x)": "12",
             "12(c)": "12(c)", "12(a) ii": "12(a)", "mi": "m"}
    assert col_values(spark, list(cases), N.base_question_number) == list(cases.values())


def test_main_sub(spark):
    vals = ["41(b)(ii)", "12", "12(a", "(a)"]
    assert col_values(spark, vals, N.main_question_number) == ["41", "12", "12", ""]
    assert col_values(spark, vals, N.sub_question_number) == ["41(b)", "12", "12(a)", "(a)"]


def test_integer_text(spark):
    cases = {"007": "7", "12": "12", "11(a)": "11(a)", "12.0": "12", "1.05": "1.05"}
    assert col_values(spark, list(cases), N.integer_text) == list(cases.values())


def test_py_strip_matches_python(spark):
    vals = ["\t a 　", "\x1c\x1dz\x85", "  ", "x", " y "]
    assert col_values(spark, vals, TX.py_strip) == [v.strip() for v in vals]


def test_strip_name_junk(spark):
    assert col_values(spark, ["(A)", "[B]", "'Math'", "Science"], TX.strip_name_junk) == ["A", "B", "Math", "Science"]


def test_percent_text(spark):
    from pyspark.sql import functions as F

    pairs = [(1, 16, "6.2"), (3, 16, "18.8"), (183, 489, "37.4"), (1, 3, "33.3"), (0, 5, "0.0"), (5, 5, "100.0"),
             (3, 2000, "0.2"), (0, 0, "0.0")]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a long, b long")
    got = [r[0] for r in df.select(TX.percent_text("a", "b", 1)).collect()]
    assert got == [t for *_, t in pairs]
    two = df.select(TX.percent_value(F.lit(2675), F.lit(100000), 2)).first()[0]
    assert two == 2.68  # 2.675 half-even on the exact decimal


def test_header_normaliser():
    from examlytics.operators.importer import header_mapping, map_header

    assert map_header("Subject  Name") == "subject_name"
    assert map_header("Page_Number") == "page_number"
    assert map_header("questionNo") == "question_no"
    m = header_mapping(["Student Name", "marks", "score", "foo"])
    assert m == {"student_name": ["Student Name"], "grading": ["marks", "score"]}
