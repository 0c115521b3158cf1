"""Operator goldens and properties on small hand-made frames."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from examlytics.operators import analysis as A
from examlytics.operators import catalog as CT
from examlytics.operators import clean as C
from examlytics.operators import importer as IM
from examlytics.operators import pages as P
from examlytics.operators.ordered import carry_last, number_rows
from examlytics.sinks import writers as W


def test_student_carry_forward(spark):
    names = ["", "A", "", "", "B", ""]
    df = spark.createDataFrame(
        [(0, i + 1, i, n) for i, n in enumerate(names)], "scan_id long, page_no int, row_id long, student_raw string"
    )
    out = [r.student_name for r in C.carry_student(df, block=2).orderBy("row_id").collect()]
    assert out == ["", "A", "A", "A", "B", "B"]


def test_blocked_windows_match_plain_window(spark):
    # one hot key with many rows plus small keys; tiny blocks force many block boundaries
    rows = [(0 if i % 3 else i % 7, i, f"v{i}" if i % 11 == 0 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, o long, v string")
    w = Window.partitionBy("k").orderBy("o")
    want = df.select(
        "k", "o", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"),
        F.row_number().over(w).alias("rn"),
    )
    got = number_rows(carry_last(df, ["k"], "o", "v", "c", block=16), ["k"], "o", "rn", block=16)
    assert sorted(got.select("k", "o", "c", "rn").collect()) == sorted(want.collect())


def test_context_numbers(spark):
    cells = ["a", "54c i", "b", "", "Either a", "55.a.i", "bii", "56 2a", "*", None, "57", "12.0"]
    want = ["a", "54(c)(i)", "54(b)", "", "54(Either)(a)", "55(a)(i)", "55(bii)", "56(a)", "*", "", "57", "12"]
    df = spark.createDataFrame([(0, i, c) for i, c in enumerate(cells)], "file_id long, row_ord long, question_no string")
    got = [r.question_no_clean for r in C.context_numbers(df, block=4).orderBy("row_ord").collect()]
    assert got == want


def test_clean_transcription_golden_and_idempotent(spark):
    df = spark.createDataFrame(
        [("(A)", "'Math'", "1. a", "1", 1), ("[B]", "Science", "Question No", "2", 2)],
        "class_raw string, subject_raw string, question string, question_no_raw string, page_no int",
    )
    once = C.clean_transcription(df)
    r = once.collect()
    assert [(x.class_name, x.subject_name, x.question) for x in r] == [("A", "Math", "1. a")]
    twice = C.clean_transcription(once.drop("class_raw", "subject_raw", "question_no_raw"))
    assert sorted(twice.select(*[c for c in twice.columns]).collect()) == sorted(
        once.drop("class_raw", "subject_raw", "question_no_raw").collect()
    )


def test_page_bounds_both_modes(spark):
    df = spark.createDataFrame(
        [(0, 1, 0, "45(a)"), (0, 1, 1, "46"), (0, 1, 2, "47(b)"), (0, 2, 0, "x(a)")],
        "scan_id long, page_no int, entry_ord int, question_no_raw string",
    )
    got = {(r.page_no): tuple(r)[2:] for r in P.page_question_bounds(df).collect()}
    assert got[1] == ("46", "46", "45", "47")
    assert got[2] == ("N/A", "N/A", "N/A", "N/A")


def test_page_range(spark):
    df = spark.range(1, 11).select(F.col("id").cast("int").alias("page_no"))

    def pages(s, e):
        return sorted(r.page_no for r in P.page_range(df, s, e).collect())

    assert pages(0, None) == list(range(1, 11))
    assert pages(3, 99) == list(range(3, 11))
    assert pages(2, 4) == [2, 3, 4]


def test_response_parsing(spark):
    obj = '{"studentName": "A", "entries": [{"questionNo": "1", "question": "q", "answer": "x", "grading": "Correct"}]}'
    raws = ["```json\n" + obj + "\n```", "Result: " + obj + " done", obj[:30], '{"studentName": "X"}', "[1, 2]"]
    df = spark.createDataFrame([(0, i + 1, r) for i, r in enumerate(raws)], "scan_id long, page_no int, raw_content string")
    reasons = [r.reject_reason for r in P.parse_responses(df).orderBy("page_no").collect()]
    assert reasons == [None, None, "invalid_json", "missing_keys", "invalid_json"]
    rows = P.flatten_pages(df).collect()
    assert len(rows) == 2 and {r.student_name for r in rows} == {"A"}


def test_import_blank_and_alias_rules(spark):
    df = spark.createDataFrame(
        [("A", "1", "Correct", "", "x", "nan")],
        "`Student Name` string, questionNo string, marks string, score string, foo string, answer string",
    )
    r = IM.import_records([("f", df)], exam_id=7).collect()[0]
    assert (r.student_name, r.question_no, r.grading, r.answer, r.exam_id, r.subject_name) == (
        "A", "1", "Correct", None, 7, "SST"
    )


def test_question_column_discovery():
    import pytest

    assert C.discover_question_columns(["Question No", "Question Text"]) == {
        "Question No": "question_no", "Question Text": "question"}
    with pytest.raises(ValueError):
        C.discover_question_columns(["Question Notes", "Question No"])


def test_notebook_clean_drops_header_row_before_normalising(spark):
    df = spark.createDataFrame(
        [("Question No", "Question", 0, "ClassName", "SubjectName"), ("12.a", "q", 3, "(P1)", "[SST]")],
        "question_no string, question string, page_no int, class_name string, subject_name string",
    )
    out = C.clean_transcription_notebook(df).collect()
    assert [(r.question_no, r.class_name, r.subject_name) for r in out] == [("12(a)", "P1", "SST")]


def test_import_strict_columns_refuses_file(spark):
    df = spark.createDataFrame([("A", "1", "x")], "`Student Name` string, questionNo string, foo string")
    lax = IM.import_records([("f", df)], exam_id=1).collect()[0]
    strict = IM.import_records([("f", df)], exam_id=1, strict_columns=True).collect()[0]
    assert lax.accepted and not strict.accepted


def test_report_order_natural(spark):
    from examlytics.sinks.writers import report_order

    df = spark.createDataFrame([("10(b)",), ("2(a)",), ("1(c)",)], "sub_question_no string")
    assert [r[0] for r in report_order(df).collect()] == ["1(c)", "10(b)", "2(a)"]
    assert [r[0] for r in report_order(df, natural=True).collect()] == ["1(c)", "2(a)", "10(b)"]


def shuffled_by_key_alone(df):
    """Sub-plans below an exchange on the key without a block."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for i, x in enumerate(lines):
        if re.search(r"Exchange hashpartitioning\((k#\d+L|_k0#\d+L, _n0#\d+), \d+\)", x):
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            out.append("\n".join(lines[i:end]))
    return out


def test_blocked_scans_never_shuffle_rows_by_key_alone(spark, tmp_path):
    rows = spark.createDataFrame([(0, i, None, "x") for i in range(10)], "k long, o long, v string, payload string")
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))  # a pruned scan: payload is only read where whole rows pass
    shuffled = lambda x: any("payload" in y for y in shuffled_by_key_alone(x))
    assert shuffled(df.withColumn("c", F.last("v", True).over(Window.partitionBy("k").orderBy("o"))))
    assert not shuffled(carry_last(df, ["k"], "o", "v", "c", block=4))
    assert not shuffled(number_rows(df, ["k"], "o", "c", block=4))


def test_null_keys_are_a_key(spark):
    rows = [(None if i % 3 == 0 else "s", i, f"v{i}" if i % 5 == 0 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.last("v", True).over(w).alias("c"), F.row_number().over(w).alias("rn"))
    for levels in (1, 2, 3, 4):
        got = number_rows(carry_last(df, ["k"], "o", "v", "c", 3, levels), ["k"], "o", "rn", 3, levels)
        assert sorted(map(str, got.select("k", "o", "c", "rn").collect())) == sorted(map(str, want.collect()))


def test_every_page_is_rejected_empty_or_read(spark):
    bodies = [
        '{"studentName": "A", "entries": []}', '{"studentName": "", "entries": null}', '{"studentName": "B", "entries": "x"}',
        '{"studentName": "", "entries": [{"questionNo": "1"}, "t"]}', '{"studentName": "", "entries": [{"questionNo": 2, "answer": null}]}',
        "nothing", '{"entries": []}',
    ]
    df = spark.createDataFrame([(0, i + 1, b) for i, b in enumerate(bodies)], "scan_id long, page_no int, raw_content string")
    rejects = {r.page_no: r.reject_reason for r in P.response_rejects(df).collect()}
    assert rejects == {2: "bad_entries", 3: "bad_entries", 4: "bad_entries", 6: "invalid_json", 7: "missing_keys"}
    assert [tuple(r) for r in P.page_placeholders(df).collect()] == [(0, 1, "A")]
    rows = P.flatten_pages(df).collect()
    # page 3 is refused, its name goes on; missing fields are empty, null stays null
    assert [(r.page_no, r.student_name, r.question_no_raw, r.question, r.answer, r.grading) for r in rows] == [(5, "B", "2", "", None, "")]


def test_patches_combine(spark):
    from examlytics.operators.catalog import apply_patches

    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, name string, exam_type_id int")
    patches = spark.createDataFrame(
        [(1, 1, "name", "x", None), (1, 2, "exam_type_id", None, None), (2, 1, "name", "old", None), (2, 2, "name", "new", None), (9, 1, "name", "z", 1)],
        "id long, patch_ord int, set_field string, name string, exam_type_id int",
    )
    got = {tuple(r) for r in apply_patches(base, patches, ["name", "exam_type_id"]).collect()}
    assert got == {(1, "x", None), (2, "new", 2), (3, "c", 3)}


def test_replies_merge_to_one_row(spark):
    from examlytics.operators.analysis import merge_replies

    replies = [("1(a)", '{"misconception": "m", "count": 4.0}'), ("1(a)", '{"misconception": "n", "count": "5"}'), ("1(a)", '```json\n{"misconception": "m", "count": 3}\n```'),
               ("2", '{"misconception": "z"}'), ("2", "no reply"), ("3", "no reply")]
    got = {r.sub_question_no: (r.misconception, r.misconception_frequency) for r in merge_replies(spark.createDataFrame(replies, "sub_question_no string, reply string")).collect()}
    assert got == {"1(a)": ("m", 7), "2": ("z", 0), "3": (None, 0)}


def test_reports_append_and_dedupe(spark, tmp_path):
    from examlytics.sinks.writers import append_reports

    df = spark.createDataFrame([("A", "1", "3"), ("A", "1", "3"), ("B", None, "x")], "`Student Name` string, questionNo string, `Page Number` string")
    records = IM.import_records([("f", df)], exam_id=1)
    for path, keys, want in (("all", None, 4), ("once", ["exam_id", "student_name", "question_no"], 1)):
        for _ in range(2):
            append_reports(records, str(tmp_path / path), str(tmp_path / f"{path}-rejects"), keys)
        assert spark.read.parquet(str(tmp_path / path)).count() == want
        assert spark.read.parquet(str(tmp_path / f"{path}-rejects")).count() == 2


def test_lenient_lines(spark, tmp_path):
    from examlytics.sources.files import read_question_list_lenient

    (tmp_path / "q.txt").write_text("Question No,Question\n1,a, b\n\n  \n2\n")
    got = read_question_list_lenient(spark, str(tmp_path / "q.txt"), ("Question No", "Question")).collect()
    assert [tuple(r) for r in got] == [("1", "a, b"), ("2", None)]


def test_clusters_must_name_a_shared_folder():
    import pytest

    from examlytics.session import ensure_checkpoint_dir

    class Fake:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1000]"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Fake)


def test_get_or_create_first_type_wins_and_domain(spark):
    from examlytics.operators.catalog import get_or_create_exams

    existing = spark.createDataFrame([(1, "Old")], "id long, name string")
    incoming = spark.createDataFrame(
        [("Old", "Mocks", 1), ("New", "Midterm", 2), ("New", "Mocks", 3), ("Bad", "Quiz", 4), ("Next", "Mocks", 5)],
        "name string, type_name string, in_ord int",
    )
    got = {(r.name, r.status): (r.exam_id, r.type_name) for r in get_or_create_exams(existing, incoming).collect()}
    assert got[("Old", "existing")] == (1, "Mocks")
    assert got[("New", "created")] == (2, "Midterm")
    assert got[("Next", "created")] == (3, "Mocks")
    assert got[("Bad", "rejected")] == (None, "Quiz")


def test_import_tally_rollup(spark):
    a = spark.createDataFrame([("A", "1"), ("B", "x")], "`Student Name` string, `Page Number` string")
    b = spark.createDataFrame([("C",), (None,)], "student_name string")
    recs = IM.import_records([("a", a), ("b", b)], exam_id=1)
    got = {r.source_file: (r.total, r.inserted) for r in IM.import_tally(recs).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "ALL": (3, 2)}


def test_failed_requests_have_no_replies(spark):
    from examlytics.operators import topics as TP

    b = spark.createDataFrame([("SST", 1, "1"), ("SST", 1, "2"), ("SST", 2, "1"), (None, 1, "1"), ("SST", 3, "9")], "subject string, batch_no long, question_no string")
    st = spark.createDataFrame([("SST", 1, True), ("SST", 2, False), (None, 1, True)], "subject string, batch_no long, ok boolean")
    rep = spark.createDataFrame(
        [("SST", 1, 5, "1", "late", 0.1, "x"), ("SST", 1, 1, "1", "History", 0.9, None), (None, 1, 1, "1", "Any", 0.5, "why"), ("SST", 3, 1, "9", "lost", 1.0, "")],
        "subject string, batch_no long, result_ord long, question_no string, topic string, confidence double, explanation string",
    )
    got = {(r.subject, r.batch_no, r.question_no): (r.topic, r.confidence, r.explanation) for r in TP.settle_topic_requests(b, st, rep).collect()}
    assert got == {
        ("SST", 1, "1"): ("History", 0.9, ""),
        ("SST", 1, "2"): (TP.FAILED, 0.0, TP.NO_MATCH),
        ("SST", 2, "1"): (TP.FAILED, 0.0, TP.API_ERROR),
        (None, 1, "1"): ("Any", 0.5, "why"),
        ("SST", 3, "9"): (TP.FAILED, 0.0, TP.API_ERROR),
    }


def test_one_scan_reads_a_folder_of_many_files(spark, tmp_path):
    from examlytics.sources import files as FS

    for i in range(150):
        head = "Student Name,Question No,marks,score" if i % 2 else "answer,QuestionNo,foo"
        line = f'"A, ""{i}""",{i}(a),5,nan' if i % 2 else f"text {i},{i}.b,z"
        (tmp_path / f"f{i:03}.csv").write_text(f"{head}\n{line}\n\n{line}\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.jsonl").write_text('{"student name": "J", "page number": "p7"}\n{broken\n{"grade": " ", "class_name": "P5", "other": 1}\n')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "only_head.csv").write_text("answer,marks\n")
    (tmp_path / "notes.txt").write_text("answer\nno\n")
    cells = FS.read_folder_cells(spark, str(tmp_path), IM.header_target)
    got = IM.folder_records(cells, exam_id=4).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_file, []).append(r)
    assert len(by) == 151 and all(len(v) == 2 for k, v in by.items() if k != "x.jsonl")
    odd, even = by["f003.csv"][0], by["f004.csv"][0]
    assert (odd.student_name, odd.question_no, odd.grading, odd.answer, odd.accepted) == ('A, "3"', "3(a)", "5", None, True)
    assert (even.answer, even.question_no, even.student_name, even.subject_name) == ("text 4", "4.b", None, "SST")
    lines = sorted(((r.student_name, r.answer, r.class_name, r.accepted) for r in by["x.jsonl"]), key=str)
    assert lines == [("J", None, None, False), (None, "{broken", None, False), (None, None, "P5", True)]
    tally = {r.source_file: (r.total, r.inserted) for r in IM.import_tally(IM.folder_records(cells, exam_id=4)).collect()}
    assert tally["ALL"] == (303, 301) and tally["x.jsonl"] == (3, 1)
    strict = IM.folder_records(cells, exam_id=4, strict_columns=True).where("accepted").select("source_file").distinct().count()
    assert strict == 75  # files without unknown columns
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 3  # lines, headers, JSON lines: not one per file


def test_csv_fields(spark):
    from examlytics.sources import files as FS

    want = {"": [""], ",b": ["", "b"], 'a,"b,""c""",': ["a", 'b,"c"', ""], '"x"': ["x"], ' a ,b"c': [" a ", 'b"c'], '""': [""], '"' + "long, " * 5000 + '"': ["long, " * 5000]}
    got = spark.createDataFrame([(k,) for k in want], "line string").select("line", FS.csv_fields("line").alias("f")).collect()
    assert {r.line: r.f for r in got} == want


def test_headers_map_alike(spark):
    names = ["Student Name", " student_name ", "QUESTION__NO", "questionNo", "Score", "page  number", "class_name", "exam_id", "foo", "", "Answer\t"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(IM.header_target(F.col("n"))).collect()]
    assert got == [t if (t := IM.map_header(n)) in IM.REPORT_COLUMNS[1:] else None for n in names]


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    from examlytics.sinks import writers as W

    def records(exam, names):
        rows = [(exam, n, None, "SST", str(i), None, None, None, "Correct", n != "no") for i, n in enumerate(names)]
        return spark.createDataFrame(rows, "exam_id long, student_name string, class_name string, subject_name string, question_no string, question string, answer string, page_number int, grading string, accepted boolean")

    path = str(tmp_path / "t")
    keys = ["student_name", "question_no", "class_name"]
    W.commit_reports(records(1, ["a", "b", "no"]), path, "x")
    W.commit_reports(records(1, ["a", "b", "no"]), path, "x")
    W.commit_reports(records(2, ["a"]), path, "x")  # another exam's partition of the same batch
    assert W.read_reports(spark, path).count() == 3
    W.commit_reports(records(1, ["a", "c"]), path, "y", dedupe_keys=keys)
    W.commit_reports(records(1, ["a", "c"]), path, "y", dedupe_keys=keys)
    assert sorted(r.student_name for r in W.read_reports(spark, path, 1).collect()) == ["a", "b", "c"]
    W.commit_reports(records(1, ["a"]), path, "x")  # a corrected batch replaces the old one
    assert sorted(r.student_name for r in W.read_reports(spark, path, 1).collect()) == ["a", "c"]
    assert W.read_reports(spark, path, 2).count() == 1


def test_ordered_files_follow_each_other(spark, tmp_path):
    from examlytics.sinks import writers as W

    keys = [f"{i}({c})" for i in range(1, 40) for c in "ab"] + [None, "x"]
    df = spark.createDataFrame([(k,) for k in keys], "sub_question_no string").repartition(7)
    for natural in (False, True):
        W.write_ordered(df, str(tmp_path / str(natural)), natural=natural)
        got = [r.sub_question_no for r in W.read_ordered(spark, str(tmp_path / str(natural))).orderBy("position").collect()]
        assert got == [r[0] for r in W.report_order(df, natural=natural).collect()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_values_need_no_sorted_aggregate(spark):
    rows = [(i, f"{i % 3}", f"{i % 3}(a)", f"q{i % 3}-{i}", "S", "x", "Correct") for i in range(30)]
    df = spark.createDataFrame(
        rows, "row_id long, main_question_no string, sub_question_no string, question string, student_name string, answer string, grading string"
    )
    stats = A.question_stats(df)
    assert {(r.sub_question_no, r.question, r.attempts) for r in stats.collect()} == {(f"{i}(a)", f"q{i}-{i}", 10) for i in range(3)}
    first = C.first_per_text(df.select("row_id", "main_question_no", "answer"), text="main_question_no")
    assert sorted(r.row_id for r in first.collect()) == [0, 1, 2]
    assert "SortAggregate" not in _plan(stats) + _plan(first)


def test_job_summary_counts_every_landed_page(spark):
    good = '{"studentName": "A", "entries": [{"questionNo": "1.a", "question": "x", "answer": "", "grading": "Correct"}, {"questionNo": "2", "question": null}]}'
    rows = [
        (1, 3, good), (1, 4, '{"studentName": "", "entries": []}'), (1, 5, "no json"),
        (1, 6, '{"studentName": "B", "entries": [{"questionNo": "1(a)", "question": "Question No", "answer": "y"}]}'),
        (1, 7, '{"studentName": "", "entries": [{"questionNo": "1(a)", "answer": null, "grading": "Incorrect"}]}'),
        (2, 1, "no json"), (2, 2, None),
    ]
    df = spark.createDataFrame(rows, "scan_id long, page_no int, raw_content string")
    out = P.job_summary(df)
    got = {r.scan_id: r.asDict() for r in out.collect()}
    want = dict(scan_id=1, pages_processed=5, start_page=3, end_page=7, total_entries=4, students_found=2, total_questions=1, total_answers=1, graded_answers=2)
    assert got[1] == want
    assert got[2] == dict.fromkeys(want, 0) | dict(scan_id=2, pages_processed=2, start_page=1, end_page=2)
    assert "Expand" not in _plan(out)


def test_strict_forms_fail_the_job(spark):
    pages = spark.createDataFrame([("1", "x", "c", "s", "p?")], "question_no string, question string, class_name string, subject_name string, page_no string")
    assert [r.page_no for r in C.clean_transcription(pages).collect()] == [None]
    with pytest.raises(Exception, match="page_no is not an integer"):
        C.clean_transcription(pages, strict_page=True).collect()
    exams = spark.createDataFrame([(1, "E", 1)], "id long, name string, exam_type_id long")
    for bad in ("Quiz", None):
        incoming = spark.createDataFrame([("N", "Mocks", 1), ("O", bad, 2)], "name string, type_name string, in_ord int")
        assert CT.get_or_create_exams(exams, incoming).count() == 2
        with pytest.raises(Exception, match="exam type outside the domain"):
            CT.get_or_create_exams(exams, incoming, strict=True).collect()


def test_counts_come_with_the_write(spark, tmp_path):
    a = spark.createDataFrame([("S", "1", "3"), ("T", "2", "x"), (None, "", "NaN"), ("U", "3", None)], "student_name string, question_no string, page_number string")
    records = IM.import_records([("a", a)], exam_id=1, keep_blank=True)
    got = W.write_counted(records, str(tmp_path / "out"), ["a", "b"])
    assert got == {"a": dict(total=3, accepted=2, refused=1, blank=1), "b": dict(total=0, accepted=0, refused=0, blank=0)}
    assert sorted(r.student_name for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["S", "U"]
    assert IM.import_records([("a", a)], exam_id=1).count() == 3


def test_first_text_and_sample_of_one_pass(spark):
    """The tagged pass against the plain operators, both pools, small and large pools, blanks and nulls."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(900):
        sub = rng.choice(["1(a)", "1(b)", "2", "3", "4", None])
        grading = rng.choice(["Correct", "Incorrect", "Not Graded", "", None]) if sub not in ("3", "4") else "Correct" if sub == "3" else "Wrong"
        answer = rng.choice(["", " ", None]) if sub == "3" else rng.choice([None, "", "x", f"a{i % 37}", f"b{i % 5}"])
        rows.append((sub, i, rng.choice([None, f"q{i}"]), grading, answer))
    df = spark.createDataFrame(rows, "sub_question_no string, row_id long, question string, grading string, answer string")
    first = {}
    for sub, i, q, *_ in rows:
        if sub is not None:
            first.setdefault(sub, q)
    for pool in ("strict", "reference"):
        for seed in ("1", "7"):
            want = {r.sub_question_no: r.sample_text for r in A.correct_sample_text(df, pool, seed).collect()}
            got = {r.sub_question_no: (r.question, r.sample_text) for r in A.first_and_sample(df, pool, seed).collect()}
            assert got == {s: (q, want.get(s, "")) for s, q in first.items()}, (pool, seed)
    assert A.first_and_sample(df.where("row_id < 0")).collect() == []


def test_requests_read_their_source_three_times(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", i, "q", "Wrong" if i % 3 else "Correct", f"a{i}", True) for i in range(50)],
        "sub_question_no string, row_id long, question string, grading string, answer string, has_number boolean",
    )
    df.write.parquet(str(tmp_path / "rows"))
    req = A.misconception_requests(spark.read.parquet(str(tmp_path / "rows")), chunk=7, block=4)
    req.collect()
    plan = req._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert len(re.findall(r"FileScan parquet", final)) <= 3
    assert req.count() == 5


def test_page_files_share_folders_and_tasks(spark, tmp_path, monkeypatch):
    from examlytics.sources import files as FS

    monkeypatch.setattr(W, "FOLDER_FILES", 50)
    path = str(tmp_path / "pages")
    pages = spark.range(-20, 980).selectExpr("id AS page_id", "CAST(concat('page ', id) AS binary) AS content").repartition(2)
    assert W.write_page_files(pages, path, "page_id", "content") == 1000
    assert len(list((tmp_path / "pages").rglob("part-*"))) == 1000 and len(list((tmp_path / "pages").iterdir())) <= 25
    files = FS.read_page_images(spark, path, "part-*")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).rdd.getNumPartitions()
    least = 4 * spark.sparkContext.defaultParallelism
    assert files.rdd.getNumPartitions() <= max(least, -(-raw // FS.TASK_PARTITIONS))
    assert {(r.page_id, r.n_bytes) for r in P.image_rows(files).collect()} == {(k, len(f"page {k}")) for k in range(-20, 980)}
    # a second write takes the place of the first
    assert W.write_page_files(pages.where("page_id < 0"), path, "page_id", "content") == 20
    assert FS.read_page_images(spark, path, "part-*").count() == 20


def test_page_files_come_back_as_rows(spark, tmp_path):
    import base64

    from examlytics.sources import files as FS
    from examlytics.streaming import ingest as ST

    text = {1: "plain", 2: "", 3: None, -4: "two\nlines\n", 5: "ü" * 100_000, 10**12: "<html>\r\n</html>"}
    df = spark.createDataFrame([(k, None if t is None else bytearray(t.encode())) for k, t in text.items()], "page_id long, content binary")
    path, out, ckpt = (str(tmp_path / n) for n in ("pages", "out", "ckpt"))
    W.write_page_files(df, path, "page_id", "content")
    want = {k: (f"page_{k}.png", len((t or "").encode()), base64.b64encode((t or "").encode()).decode()) for k, t in text.items()}
    read = lambda d: {r.page_id: (r.image_name, r.n_bytes, r.b64) for r in d.collect()}
    assert read(P.image_rows(FS.read_page_images(spark, path, "part-*"))) == want
    run = lambda: ST.append_stream(P.image_rows(FS.stream_page_images(spark, path, "part-*", 2)), out, ckpt)
    assert read(run()) == want
    # a page that lands later is the only new row of the next run
    W.write_page_files(spark.createDataFrame([(9, bytearray(b"late"))], "page_id long, content binary"), path + "/later", "page_id", "content")
    again = run()
    assert again.count() == len(want) + 1 and read(again) == want | {9: ("page_9.png", 4, base64.b64encode(b"late").decode())}
