"""The query catalog: each entry is ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables through the adapters and composes library
operators; nothing is collected. Keys match ``examlytics.plans.oracle.ORACLE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import analysis as A
from ..operators import clean as C
from ..sources import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.analysis_rows(X.transcription(spark, sf_dir))


@query
def question_analysis(spark, sf_dir):
    """Flagship: F1 with F16 over cleaned rows with carried names."""
    return A.question_analysis(rows(spark, sf_dir))


@query
def question_number_fix(spark, sf_dir):
    t = X.transcription(spark, sf_dir)
    return t.select(
        "row_id",
        "question_no_raw",
        N.fix_question_number("question_no_raw").alias("fixed_no"),
        N.normalize_question_number("question_no_raw").alias("question_no"),
    )


@query
def main_sub_base_numbers(spark, sf_dir):
    t = X.transcription(spark, sf_dir).select(
        "row_id", N.normalize_question_number("question_no_raw").alias("question_no")
    )
    return t.select(
        "row_id",
        "question_no",
        N.main_question_number("question_no").alias("main_question_no"),
        N.sub_question_number("question_no").alias("sub_question_no"),
        N.base_question_number("question_no").alias("base_question_no"),
        N.integer_text(N.main_question_number("question_no")).alias("main_integer_text"),
    )


@query
def clean_transcription(spark, sf_dir):
    t = C.clean_transcription(C.carry_student(X.transcription(spark, sf_dir)))
    return t.select(
        "scan_id", "page_no", "entry_ord", "row_id", "student_name", "question_no", "question", "answer",
        "grading", "class_name", "subject_name",
    )


@query
def student_carry_forward(spark, sf_dir):
    """G1 at page grain."""
    from ..operators.ordered import carry_last

    p = X.exam_pages(spark, sf_dir).withColumn("_nm", F.when(F.col("student_raw") != "", F.col("student_raw")))
    p = carry_last(p, ["scan_id"], "page_no", "_nm", "_c")
    return p.select("scan_id", "page_no", "student_raw", F.coalesce("_c", F.lit("")).alias("student_name"))


@query
def grading_distribution(spark, sf_dir):
    return A.grading_distribution(rows(spark, sf_dir))


@query
def wrong_answers(spark, sf_dir):
    return A.wrong_answers(rows(spark, sf_dir))


@query
def common_wrong_answer(spark, sf_dir):
    return A.common_wrong_answer(rows(spark, sf_dir))


@query
def analysis_summary(spark, sf_dir):
    return A.analysis_summary(rows(spark, sf_dir))


# ---------------------------------------------------------------- pages

from ..operators import pages as P  # noqa: E402


@query
def response_ingest(spark, sf_dir):
    """R3 + D8 + C1 + C2 + G1: landed reply text -> answer rows of the valid pages."""
    return P.flatten_pages(X.raw_responses(spark, sf_dir))


@query
def response_rejects(spark, sf_dir):
    """Pages without a valid result, with the reason."""
    return P.response_rejects(X.raw_responses(spark, sf_dir))


@query
def page_placeholders(spark, sf_dir):
    """Valid pages without entries, with the carried student name."""
    return P.page_placeholders(X.raw_responses(spark, sf_dir))


@query
def page_question_bounds(spark, sf_dir):
    return P.page_question_bounds(X.transcription(spark, sf_dir))


@query
def page_range(spark, sf_dir):
    t = X.transcription(spark, sf_dir).select("scan_id", "page_no", "entry_ord", "row_id")
    return P.page_range(t, start=3, end=40)


@query
def job_summary(spark, sf_dir):
    """F9 over the landed replies; refused pages and pages without entries count as processed."""
    return P.job_summary(X.raw_responses(spark, sf_dir))


@query
def scan_summary(spark, sf_dir):
    return P.scan_summary(X.transcription(spark, sf_dir))


# ---------------------------------------------------------------- more analysis


@query
def wrong_answer_text(spark, sf_dir):
    return A.wrong_answer_text(rows(spark, sf_dir))


@query
def correct_sample(spark, sf_dir):
    return A.correct_sample(rows(spark, sf_dir), pool="strict")


@query
def correct_sample_reference(spark, sf_dir):
    return A.correct_sample(rows(spark, sf_dir), pool="reference")


@query
def correct_sample_text(spark, sf_dir):
    return A.correct_sample_text(rows(spark, sf_dir), pool="strict")


@query
def misconception_requests(spark, sf_dir):
    return A.misconception_requests(rows(spark, sf_dir))


@query
def duplicate_answers(spark, sf_dir):
    """G3 per scan, over rows of which every ninth was entered twice."""
    r = rows(spark, sf_dir).select("scan_id", "row_id", "student_name", "question_no")
    again = r.where(F.col("row_id") % 9 == 0).withColumn("row_id", F.col("row_id") + F.lit(10**12))
    return C.duplicate_answers(r.unionByName(again))


@query
def unique_questions(spark, sf_dir):
    return C.clean_question_list(rows(spark, sf_dir).select("row_id", "question_no", "question"))


@query
def question_number_context(spark, sf_dir):
    return C.context_numbers(X.number_context(spark, sf_dir))


@query
def duplicate_answers_global(spark, sf_dir):
    """G3 with the notebook's keys (student, number) across every scan."""
    r = rows(spark, sf_dir).select("scan_id", "row_id", "student_name", "question_no")
    return C.duplicate_answers(r, keys=("student_name", "question_no"))


# ---------------------------------------------------------------- topics

from ..operators import topics as TP  # noqa: E402


def unique_question_list(spark, sf_dir):
    return C.clean_question_list(rows(spark, sf_dir).select("row_id", "question_no", "question"))


@query
def topic_batches(spark, sf_dir):
    b = TP.topic_batches(X.topic_questions(spark, sf_dir))
    return b.select("row_id", "question_no", "subject", "q_rank", "batch_no")


@query
def topic_requests(spark, sf_dir):
    return TP.topic_requests(X.topic_questions(spark, sf_dir))


@query
def topic_assign(spark, sf_dir):
    return TP.assign_topics(X.topic_questions(spark, sf_dir))


@query
def topic_merge_fanout(spark, sf_dir):
    return TP.merge_topics_fanout(unique_question_list(spark, sf_dir), X.topic_results(spark, sf_dir))


@query
def topic_lookup_first(spark, sf_dir):
    return TP.lookup_topics_first(unique_question_list(spark, sf_dir), X.topic_results(spark, sf_dir))


@query
def topic_statistics(spark, sf_dir):
    return TP.topic_statistics(TP.assign_topics(X.topic_questions(spark, sf_dir)))


# ---------------------------------------------------------------- catalog

from ..operators import catalog as CT  # noqa: E402


@query
def exam_with_type(spark, sf_dir):
    return CT.exam_with_type(X.exams(spark, sf_dir), X.exam_types(spark, sf_dir))


@query
def valid_exams(spark, sf_dir):
    return CT.valid_children(X.exams(spark, sf_dir), X.exam_types(spark, sf_dir), "exam_type_id")


@query
def orphan_exams(spark, sf_dir):
    return CT.orphan_children(X.exams(spark, sf_dir), X.exam_types(spark, sf_dir), "exam_type_id")


@query
def deletable_types(spark, sf_dir):
    return CT.deletable(X.exam_types(spark, sf_dir), X.exams(spark, sf_dir), "exam_type_id")


@query
def delete_blockers(spark, sf_dir):
    return CT.delete_blockers(X.exam_types(spark, sf_dir), X.exams(spark, sf_dir), "exam_type_id")


@query
def deletable_exams(spark, sf_dir):
    return CT.deletable(X.exams(spark, sf_dir), X.uploads(spark, sf_dir), "exam_id")


@query
def report_rollup(spark, sf_dir):
    return CT.report_rollup(X.exams(spark, sf_dir), X.reports(spark, sf_dir), X.uploads(spark, sf_dir))


@query
def exam_get_or_create(spark, sf_dir):
    return CT.get_or_create_exams(X.exams(spark, sf_dir), X.incoming_exams(spark, sf_dir))


@query
def exam_patch(spark, sf_dir):
    return CT.apply_patches(X.exams(spark, sf_dir), X.exam_patches(spark, sf_dir), ["name", "exam_type_id"])


# ---------------------------------------------------------------- importer

from ..operators import importer as IM  # noqa: E402

IMPORT_EXAM_ID = 1


def import_files(spark, sf_dir):
    return [("import_a", X.import_a(spark, sf_dir)), ("import_b", X.import_b(spark, sf_dir))]


@query
def import_reports(spark, sf_dir):
    return IM.import_records(import_files(spark, sf_dir), exam_id=IMPORT_EXAM_ID)


@query
def import_tally(spark, sf_dir):
    return IM.import_tally(IM.import_records(import_files(spark, sf_dir), exam_id=IMPORT_EXAM_ID))


# ---------------------------------------------------------------- sources and sinks (round trips)

from pyspark.sql import types as T  # noqa: E402

from ..sinks import writers as W  # noqa: E402
from ..sources import files as FS  # noqa: E402

_KEYS = [("scan_id", T.LongType()), ("entry_ord", T.IntegerType()), ("row_id", T.LongType())]
_CLEAN_COLS = [
    "scan_id", "page_no", "entry_ord", "row_id", "student_name", "question_no", "question", "answer", "grading",
    "class_name", "subject_name",
]


def _csv_roundtrip(spark, sf_dir, sep):
    src = W.to_display(clean_transcription(spark, sf_dir))
    schema = FS.transcription_schema(_KEYS)
    path = W.output_root(spark, "csv")
    W.write_csv(src.select(*schema.fieldNames()), path, sep=sep)
    return FS.to_snake(FS.read_csv(spark, path, schema, sep=sep)).select(*_CLEAN_COLS)


@query
def csv_roundtrip(spark, sf_dir):
    """A1 + B1: cleaned transcription -> headered CSV -> read back with its schema."""
    return _csv_roundtrip(spark, sf_dir, ",")


@query
def pipe_roundtrip(spark, sf_dir):
    """B2: the same through a pipe-delimited file."""
    return _csv_roundtrip(spark, sf_dir, "|")


@query
def jsonl_roundtrip(spark, sf_dir):
    """A3 + B3: JSON lines, nulls omitted on write, restored by the schema on read."""
    src = clean_transcription(spark, sf_dir)
    path = W.output_root(spark, "jsonl")
    W.write_jsonl(src, path)
    return FS.read_jsonl(spark, path, src.schema).drop("_corrupt_record").select(*_CLEAN_COLS)


@query
def ndjson_report(spark, sf_dir):
    """The question analysis as one JSON text per row, parsed back."""
    src = question_analysis(spark, sf_dir)
    path = W.output_root(spark, "ndjson")
    W.write_ndjson(src, path)
    parsed = spark.read.text(path).select(F.from_json("value", src.schema).alias("r"))
    return parsed.select("r.*")


@query
def report_bundle(spark, sf_dir):
    """Analysis and raw rows written as one report; the analysis part read back."""
    path = W.output_root(spark, "report")
    parts = W.write_report_bundle(question_analysis(spark, sf_dir), clean_transcription(spark, sf_dir), path)
    return spark.read.parquet(parts["Question_Analysis"])


@query
def report_table_append(spark, sf_dir):
    """The import files appended one after the other to the reporting table
    partitioned by exam; the accepted records of both, read back."""
    path = W.output_root(spark, "exam_reports")
    for exam_id, file in enumerate(import_files(spark, sf_dir), IMPORT_EXAM_ID):
        W.append_reports(IM.import_records([file], exam_id=exam_id), path)
    back = spark.read.option("basePath", path).parquet(path)
    return back.withColumn("exam_id", F.col("exam_id").cast("bigint")).select(*IM.REPORT_COLUMNS)


@query
def report_table_rejects(spark, sf_dir):
    """The records that the reporting table refuses, written beside it and read back."""
    path = W.output_root(spark, "exam_reports")
    W.append_reports(import_reports(spark, sf_dir), f"{path}/table", rejects=f"{path}/rejects")
    return spark.read.parquet(f"{path}/rejects").select("source_file", *IM.REPORT_COLUMNS)


@query
def page_base64(spark, sf_dir):
    """Page bytes <-> base64 text, with the derived image name."""
    p = X.page_images(spark, sf_dir)
    b64 = F.translate(F.base64("content"), "\r\n", "")
    out = p.select(
        "page_id",
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".png")).alias("image_name"),
        b64.alias("b64"),
        F.length("content").alias("n_bytes"),
        "content",
    )
    return out.withColumn("decoded_ok", F.unbase64("b64") == F.col("content")).drop("content")


# ---------------------------------------------------------------- streaming (availableNow over landed files)

from ..streaming import ingest as ST  # noqa: E402


@query
def stream_ingest(spark, sf_dir):
    """K1: page replies land as files (every tenth page delivered twice) and are
    ingested exactly once per (scan, page)."""
    pages = X.raw_responses(spark, sf_dir).join(
        X.exam_pages(spark, sf_dir).select("scan_id", "page_no", "landed_at"), ["scan_id", "page_no"]
    )
    feed = pages.unionByName(pages.where(F.col("page_no") % 10 == 0))
    landing, out, ckpt = ST.paths(W.output_root(spark, "stream_ingest"))
    ST.land_in_time_order(feed, landing, 4)
    return ST.ingest_pages(spark, landing, out, ckpt, feed.schema)


@query
def stream_carry_forward(spark, sf_dir):
    """K2: pages of a scan land out of order across files, every seventh twice and
    with gaps (pages that never land); names are carried in page order by a
    stateful stream over several triggers."""
    pages = X.exam_pages(spark, sf_dir).select("scan_id", "page_no", "student_raw", "landed_at")
    pages = pages.where((F.col("scan_id") * 50 + F.col("page_no")) % 11 != 3)
    feed = pages.unionByName(pages.where(F.col("page_no") % 7 == 0))
    landing, out, ckpt = ST.paths(W.output_root(spark, "stream_carry"))
    ST.land_in_time_order(feed, landing, 4)
    return ST.carry_names_stream(spark, landing, out, ckpt, pages.schema, files_per_trigger=2)


@query
def stream_question_stats(spark, sf_dir):
    """K3: running per-sub-question attempts and correct answers over landed rows."""
    t = X.transcription(spark, sf_dir).select("scan_id", "row_id", "question_no_raw", "question", "grading")
    landing, out, ckpt = ST.paths(W.output_root(spark, "stream_stats"))
    ST.land(t, landing, 4, "scan_id")
    return ST.question_stats_stream(spark, landing, out, ckpt, t.schema)


@query
def page_image_files(spark, sf_dir):
    """Page images land as files, one per page, and are read back with the
    binaryFile source: length and base64 text by page."""
    from ..sources.files import read_page_images

    path = W.output_root(spark, "page_images")
    W.write_page_files(X.page_images(spark, sf_dir), path, "page_id", "content")
    return P.image_rows(read_page_images(spark, path, "part-*"))


#: Triggers that take the page images that have landed, at most.
IMAGE_TRIGGERS = 10


@query
def stream_page_images(spark, sf_dir):
    """A6 + K1: the same files as a stream, each page once over several triggers:
    of 1,000 files at least, and no more triggers than a fixed number, as each writes its logs."""
    from ..sources import files as FS

    landing, out, ckpt = ST.paths(W.output_root(spark, "stream_images"))
    n = W.write_page_files(X.page_images(spark, sf_dir), landing, "page_id", "content")
    files = FS.stream_page_images(spark, landing, "part-*", max(1000, -(-n // IMAGE_TRIGGERS)))
    return ST.append_stream(P.image_rows(files), out, ckpt)


# ---------------------------------------------------------------- more sources, names, lookups, R4


@query
def question_list_lenient(spark, sf_dir):
    """A1b + C3: a question list written as plain lines whose text holds unquoted
    commas (every fourth row), read back with the last column absorbing them."""
    from ..sources.files import read_question_list_lenient

    q = X.topic_questions(spark, sf_dir)
    text = F.when(F.col("row_id") % 4 == 0, F.concat(F.col("question"), F.lit(", "), F.col("subject"))).otherwise(
        F.col("question")
    )
    header = ("Question No", "Question Text")
    lines = q.select(F.concat_ws(",", F.col("question_no"), text).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([(",".join(header),)], "value string"))
    path = W.output_root(spark, "question_list")
    lines.write.mode("overwrite").text(path)
    return read_question_list_lenient(spark, path, header)


@query
def notebook_reimport(spark, sf_dir):
    """A2 + R7 (notebook generation): a headered file read back headerless, so its
    header line arrives as a data row (page number null) and is removed by the
    header test on the number column; cleaning again changes nothing."""
    src = W.to_display(clean_transcription(spark, sf_dir))
    schema = FS.transcription_schema(_KEYS)
    path = W.output_root(spark, "notebook_csv")
    W.write_csv(src.select(*schema.fieldNames()), path)
    raw = FS.to_snake(FS.read_csv(spark, path, schema, header=False))
    cleaned = C.clean_transcription_notebook(raw)
    return cleaned.select(*_CLEAN_COLS)


@query
def import_from_files(spark, sf_dir):
    """A4 + R8: both import files landed as CSV in one folder (one sub-folder per
    file, different headers), read with header names as text, then imported."""
    root = W.output_root(spark, "import_files")
    files = []
    for name, df in import_files(spark, sf_dir):
        W.write_csv(df, f"{root}/{name}", null_token=None)
        files.append((name, spark.read.option("header", True).option("escape", '"').option("pathGlobFilter", "*.csv")
                      .csv(f"{root}/{name}")))
    return IM.import_records(files, exam_id=IMPORT_EXAM_ID)


@query
def report_names(spark, sf_dir):
    """Per scan, the auto exam name and the output file names, stamped with
    the scan's last landing time."""
    from ..functions.text import report_name, stamp_name

    t = C.clean_transcription(X.transcription(spark, sf_dir))
    per = t.groupBy("scan_id").agg(
        F.min_by("class_name", "row_id").alias("class_name"),
        F.min_by("subject_name", "row_id").alias("subject_name"),
        F.max("landed_at").alias("stamp"),
    )
    base = F.concat(F.lit("scan"), F.col("scan_id").cast("string"))
    return per.select(
        "scan_id",
        stamp_name("Exam_", F.col("stamp")).alias("exam_name"),
        F.concat(base, F.lit("_transcription.csv")).alias("transcription_file"),
        F.concat(base, F.lit("_analysis")).alias("analysis_report"),
        report_name("class_name", "subject_name", F.col("stamp")).alias("report_name"),
    )


@query
def exam_by_id(spark, sf_dir):
    """Point lookup; the predicate reaches the parquet scan."""
    return X.exams(spark, sf_dir).where(F.col("id") == 7)


@query
def misconception_attach(spark, sf_dir):
    """R1 -> R4: one reply per request chunk (its commonest wrong answer as fenced
    JSON text with prose and a count such as ``4.0``, standing in for the model's
    reply), merged to one row per sub-question and attached to F1."""
    r = rows(spark, sf_dir)
    w = A.numbered_wrong_answers(r)
    n = w.groupBy("sub_question_no", "chunk_no", A.normalize_answer().alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("sub_question_no", "chunk_no").agg(
        F.min_by("theme", F.struct((-F.col("n")).alias("n"), F.col("theme"))).alias("misconception"),
        F.concat(F.max("n").cast("string"), F.lit(".0")).alias("count"),
    )
    reply = F.concat(F.lit("Result:\n```json\n"), F.to_json(F.struct("misconception", "count")), F.lit("\n```"))
    return A.attach_misconceptions(r, top.select("sub_question_no", reply.alias("reply")))


# ---------------------------------------------------------------- nested type, strict modes, notebook list, bundles, folders


@query
def exam_nested_type(spark, sf_dir):
    """The nested type of every exam, read out of the nested column."""
    e = CT.exam_with_nested_type(X.exams(spark, sf_dir), X.exam_types(spark, sf_dir))
    return e.select("id", "name", F.col("exam_type.id").alias("type_id"), F.col("exam_type.name").alias("type_label"))


@query
def import_strict_columns(spark, sf_dir):
    """The stricter importer refuses every record of a file with unknown columns."""
    return IM.import_records(import_files(spark, sf_dir), exam_id=IMPORT_EXAM_ID, strict_columns=True)


@query
def page_number_rejects(spark, sf_dir):
    """Import rows whose page number is no integer."""
    files = [IM.canonical_records(df, name) for name, df in import_files(spark, sf_dir)]
    both = files[0].unionByName(files[1]).withColumnsRenamed({"page_number": "page_no", "question_no": "questionNo"})
    return C.page_rejects(both).groupBy("page_no", "questionNo").agg(F.count(F.lit(1)).alias("n"))


@query
def notebook_questions(spark, sf_dir):
    """R6, notebook generation."""
    return C.notebook_question_list(rows(spark, sf_dir).select("question_no", "question"))


@query
def topic_bundle(spark, sf_dir):
    """B4 + H2: categorised questions and topic statistics written as one bundle; both read back."""
    q = TP.assign_topics(X.topic_questions(spark, sf_dir))
    parts = W.write_topic_bundle(q, TP.topic_statistics(q), W.output_root(spark, "topics"))
    n = spark.read.parquet(parts["Question_Categories"]).groupBy("topic").agg(F.count(F.lit(1)).alias("questions_read"))
    return spark.read.parquet(parts["Topic_Statistics"]).join(n, "topic", "left")


@query
def report_raw_part(spark, sf_dir):
    """The raw part of the report bundle, read back."""
    path = W.output_root(spark, "report")
    parts = W.write_report_bundle(question_analysis(spark, sf_dir), clean_transcription(spark, sf_dir), path)
    return spark.read.parquet(parts["Raw_Transcription"]).select(*_CLEAN_COLS)


@query
def folder_import_tally(spark, sf_dir):
    """A4 + F13: a folder with both import files, a file of another kind and an
    empty one; imported by file name and tallied."""
    root = W.output_root(spark, "import_folder")
    for name, df in import_files(spark, sf_dir):
        W.land_single_file(df, f"{root}/{name}.csv")
    for name in ("notes.txt", "empty.csv"):
        W.land_empty_file(spark, f"{root}/{name}")
    return IM.import_tally(IM.import_records(FS.read_import_folder(spark, root), exam_id=IMPORT_EXAM_ID))


# ---------------------------------------------------------------- request ledger, one-scan folder, exactly-once batches, sketches, ordered files


def topic_ledger_tables(spark, sf_dir):
    """Questions with their requests, a status per request (every fifth failed,
    every eleventh without one) and the replies of the answered ones: some
    numbers missing, some twice, some without explanation."""
    b = TP.topic_batches(X.topic_questions(spark, sf_dir))
    sent = b.select("subject", "batch_no").distinct()
    status = sent.where("batch_no % 11 <> 7").select("*", (F.col("batch_no") % 5 != 2).alias("ok"))
    a = TP.assign_topics(b).where("batch_no % 5 <> 2 and q_rank % 7 <> 3")
    why = F.when(F.col("q_rank") % 4 != 1, F.concat(F.lit("Because of "), F.col("topic")))
    first = a.select("subject", "batch_no", "question_no", (F.col("q_rank") * 2).alias("result_ord"), "topic", "confidence", why.alias("explanation"))
    again = first.where("result_ord % 10 = 0").withColumns({"result_ord": F.col("result_ord") + 1, "topic": F.lit("Second opinion")})
    return b, status, first.unionByName(again)


@query
def topic_ledger(spark, sf_dir):
    """The outcome of every question through the request it was sent in."""
    out = TP.settle_topic_requests(*topic_ledger_tables(spark, sf_dir))
    return out.select("row_id", "question_no", "subject", "batch_no", "topic", "confidence", "explanation")


def folder_cells(spark, sf_dir):
    """One import file landed as CSV and one as JSON lines, in parts, beside a file of another kind and an empty one."""
    (a, csv), (b, lines) = import_files(spark, sf_dir)
    root = W.output_root(spark, "import_scan")
    W.write_csv(csv, f"{root}/{a}.csv", null_token=None)
    W.write_jsonl(lines, f"{root}/{b}.jsonl")
    for name in ("notes.txt", "empty.csv"):
        W.land_empty_file(spark, f"{root}/{name}")
    return FS.read_folder_cells(spark, root, IM.header_target)


@query
def folder_scan_import(spark, sf_dir):
    """A4 + R8: a folder of CSV and JSONL files imported by one scan."""
    return IM.folder_records(folder_cells(spark, sf_dir), exam_id=IMPORT_EXAM_ID)


@query
def folder_scan_tally(spark, sf_dir):
    """A4 + F13: the same folder tallied by file."""
    return IM.import_tally(folder_scan_import(spark, sf_dir))


@query
def report_batch_commit(spark, sf_dir):
    """Two imports committed as batches; one is repeated, and sent again as
    another batch whose records are all in the table. One copy of each is read back."""
    path = W.output_root(spark, "report_batches")
    (a, b) = import_files(spark, sf_dir)
    for batch, exam_id, file in (("a", 1, a), ("b", 2, b), ("a", 1, a)):
        W.commit_reports(IM.import_records([file], exam_id=exam_id), path, batch)
    W.commit_reports(IM.import_records([a], exam_id=1), path, "late", dedupe_keys=IM.REPORT_COLUMNS)
    return W.read_reports(spark, path)


@query
def stream_student_sketches(spark, sf_dir):
    """K3 + F3: attempts, correct answers and sketched distinct students over several triggers."""
    t = X.transcription(spark, sf_dir).select("scan_id", "row_id", "question_no_raw", "question", "grading", "student_raw")
    landing, out, ckpt = ST.paths(W.output_root(spark, "stream_sketches"))
    ST.land(t, landing, 6, "scan_id")
    merged = ST.question_sketches(spark, ST.question_sketches_stream(spark, landing, out, ckpt, t.schema, files_per_trigger=2))
    return merged.withColumn("students", F.hll_sketch_estimate("students"))


@query
def report_file_order(spark, sf_dir):
    """H1: the analysis written in text order and in natural order; both read back in the order of the files."""
    a = question_analysis(spark, sf_dir).select("sub_question_no", "attempts")
    path, out = W.output_root(spark, "ordered"), None
    for name, natural in (("text", False), ("natural", True)):
        W.write_ordered(a, f"{path}/{name}", natural=natural)
        back = W.read_ordered(spark, f"{path}/{name}").withColumn("file_order", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out.select("file_order", "position", "sub_question_no", "attempts")


@query
def import_counted_write(spark, sf_dir):
    """C5 + C8 + F13: per file, what the import wrote, refused and left out as blank, counted by the write itself."""
    records = IM.import_records(import_files(spark, sf_dir), exam_id=IMPORT_EXAM_ID, keep_blank=True)
    path = W.output_root(spark, "counted") + "/reports"
    counts = W.write_counted(records, path, ["import_a", "import_b"])
    read = spark.read.parquet(path).groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_read"))
    schema = "source_file string, total long, accepted long, refused long, blank long"
    return spark.createDataFrame([(s, *c.values()) for s, c in counts.items()], schema).join(read, "source_file", "left")


@query
def clean_transcription_strict(spark, sf_dir):
    """C8, strict: a page number that is no integer would fail the job."""
    t = C.clean_transcription(C.carry_student(X.transcription(spark, sf_dir)), strict_page=True)
    return t.select(*_CLEAN_COLS)


@query
def exam_create_strict(spark, sf_dir):
    """D10, strict, over the incoming exams whose type is in the domain; another type would fail the job."""
    incoming = X.incoming_exams(spark, sf_dir).where(F.col("type_name").isin(*CT.EXAM_TYPES))
    return CT.get_or_create_exams(X.exams(spark, sf_dir), incoming, strict=True)
