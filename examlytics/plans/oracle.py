"""DuckDB oracle SQL, one string per key of ``examlytics.plans.queries.QUERIES``.

Each string prepends the adapters it needs (FIXTURES.md §3) as CTEs and then
states the operator in plain SQL. Column names and types match the Spark side.
"""

from __future__ import annotations

from . import sqlparts as S
from .adapters_sql import ADAPTERS

_DEPS = {
    "exam_pages": ["transcription"],
    "raw_responses": ["transcription"],
    "import_a": ["transcription"],
    "import_b": ["transcription"],
}


def with_adapters(body: str, *names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n].strip()})" for n in order)
    return f"WITH {ctes}\nSELECT * FROM (\n{body}\n) AS q"


# ---------------------------------------------------------------- shared CTEs

NAMED = """named AS (
  SELECT *, coalesce(last_value(nullif(student_raw, '') IGNORE NULLS) OVER (
      PARTITION BY scan_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS student_name
  FROM transcription)"""

CLEAN = f"""clean AS (
  SELECT scan_id, CAST(page_no AS INTEGER) AS page_no, entry_ord, row_id, student_name,
         {S.normalize_qno('question_no_raw')} AS question_no, question, answer, grading,
         {S.strip_junk('class_raw')} AS class_name, {S.strip_junk('subject_raw')} AS subject_name
  FROM named
  WHERE coalesce(NOT contains(question, 'Question No'), true) AND question IS NOT NULL)"""

ROWS = f"""arows AS (
  SELECT scan_id, page_no, entry_ord, row_id, student_name, question_no,
         {S.main_qno('question_no')} AS main_question_no, {S.sub_qno('question_no')} AS sub_question_no,
         question, answer, grading, class_name, subject_name
  FROM clean)"""

BASE = f"{NAMED},\n{CLEAN},\n{ROWS}"
GROUPED = "(SELECT * FROM arows WHERE sub_question_no IS NOT NULL)"
WRONG = f"(grading IS DISTINCT FROM 'Correct' AND {S.has_text('answer')})"


def _q(body: str, *names: str) -> str:
    return with_adapters(body, *(names or ("transcription",)))


ORACLE: dict[str, str] = {}

ORACLE["question_analysis"] = _q(f"""
WITH {BASE},
stats AS (
  SELECT sub_question_no, arg_min_null(main_question_no, row_id) AS main_question_no,
         arg_min_null(question, row_id) AS question, count(*) AS attempts,
         count(DISTINCT student_name) AS distinct_students, count_if(grading = 'Correct') AS correct_answers
  FROM {GROUPED} g GROUP BY sub_question_no),
wc AS (
  SELECT sub_question_no, {S.normalize_answer('answer')} AS wrong_answer, count(*) AS n
  FROM {GROUPED} g WHERE {WRONG} GROUP BY 1, 2),
mis AS (
  SELECT sub_question_no, wrong_answer AS misconception, CAST(n AS INTEGER) AS misconception_frequency
  FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_no ORDER BY n DESC, wrong_answer) AS rn FROM wc) t
  WHERE rn = 1)
SELECT s.main_question_no, s.question, s.sub_question_no, s.attempts, s.distinct_students, s.correct_answers,
       {S.percent_text('s.correct_answers', 's.attempts', 1)} AS correct_pct,
       CAST(s.correct_answers AS DOUBLE) * 100.0 / CAST(s.attempts AS DOUBLE) AS correct_pct_value,
       m.misconception, coalesce(m.misconception_frequency, 0) AS misconception_frequency
FROM stats s LEFT JOIN mis m USING (sub_question_no)""")

ORACLE["question_number_fix"] = _q(f"""
SELECT row_id, question_no_raw, {S.fix_qno('question_no_raw')} AS fixed_no,
       {S.normalize_qno('question_no_raw')} AS question_no
FROM transcription""")

ORACLE["main_sub_base_numbers"] = _q(f"""
WITH n AS (SELECT row_id, {S.normalize_qno('question_no_raw')} AS question_no FROM transcription)
SELECT row_id, question_no, {S.main_qno('question_no')} AS main_question_no,
       {S.sub_qno('question_no')} AS sub_question_no, {S.base_qno('question_no')} AS base_question_no,
       {S.integer_text(S.main_qno('question_no'))} AS main_integer_text
FROM n""")

ORACLE["clean_transcription"] = _q(f"""
WITH {NAMED}, {CLEAN[:]}
SELECT scan_id, page_no, entry_ord, row_id, student_name, question_no, question, answer, grading,
       class_name, subject_name
FROM clean""")

ORACLE["student_carry_forward"] = _q(f"""
SELECT scan_id, page_no, student_raw,
       coalesce(last_value(nullif(student_raw, '') IGNORE NULLS) OVER (
         PARTITION BY scan_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS student_name
FROM exam_pages""", "exam_pages")

ORACLE["grading_distribution"] = _q(f"""
WITH {BASE}
SELECT grading, count(*) AS count FROM arows WHERE grading IS NOT NULL GROUP BY grading""")

ORACLE["wrong_answers"] = _q(f"""
WITH {BASE}
SELECT sub_question_no, row_id, answer FROM {GROUPED} g WHERE {WRONG}""")

ORACLE["common_wrong_answer"] = _q(f"""
WITH {BASE},
wc AS (
  SELECT sub_question_no, {S.normalize_answer('answer')} AS wrong_answer, count(*) AS n
  FROM {GROUPED} g WHERE {WRONG} GROUP BY 1, 2)
SELECT sub_question_no, wrong_answer AS misconception, CAST(n AS INTEGER) AS misconception_frequency
FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_no ORDER BY n DESC, wrong_answer) AS rn FROM wc) t
WHERE rn = 1""")

ORACLE["analysis_summary"] = _q(f"""
WITH {BASE}
SELECT count(DISTINCT sub_question_no) AS questions_analysed, count(*) AS total_entries FROM arows""")


# ---------------------------------------------------------------- pages

# the kinds of replies of raw_responses, by page
_K = "(scan_id * 50 + page_no)"
_READ = f"{_K} % 17 <> 0 AND {_K} % 19 <> 0"
_BAD = f"({_K} % 23 <> 0 AND ({_K} % 29 = 0 OR {_K} % 31 = 0 OR {_K} % 37 = 0))"
_EMPTY = f"({_K} % 23 = 0)"
_SHORT = f"({_K} % 41 = 0)"


def _entries(extra: str) -> str:
    """Answer rows of the valid pages of ``named``; short pages have two entries with missing fields."""
    return f"""
SELECT scan_id, page_no, entry_ord, student_raw, {extra}
  CASE WHEN NOT {_SHORT} THEN question_no_raw WHEN entry_ord = 0 THEN '1(a)' ELSE '' END AS question_no_raw,
  CASE WHEN NOT {_SHORT} THEN question ELSE '' END AS question,
  CASE WHEN NOT {_SHORT} THEN answer WHEN entry_ord = 0 THEN '' END AS answer,
  CASE WHEN NOT {_SHORT} THEN grading ELSE '' END AS grading,
  'Unknown' AS class_name, 'Unknown' AS subject_name
FROM named WHERE NOT {_BAD} AND NOT {_EMPTY} AND (NOT {_SHORT} OR entry_ord < 2)"""


_PAGE_NAMED = f"""
WITH named AS (
  SELECT *, coalesce(last_value(nullif(student_raw, '') IGNORE NULLS) OVER (
         PARTITION BY scan_id ORDER BY page_no, entry_ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS student_name
  FROM transcription WHERE {_READ})"""

ORACLE["response_ingest"] = _q(_PAGE_NAMED + _entries("student_name,"))

ORACLE["page_placeholders"] = _q(f"""{_PAGE_NAMED}
SELECT scan_id, page_no, max(student_name) AS student_name FROM named WHERE {_EMPTY} GROUP BY scan_id, page_no""")

ORACLE["response_rejects"] = _q(f"""
WITH p AS (SELECT DISTINCT scan_id, page_no FROM transcription)
SELECT scan_id, page_no,
       CASE WHEN {_K} % 17 = 0 THEN 'invalid_json' WHEN {_K} % 19 = 0 THEN 'missing_keys' ELSE 'bad_entries' END AS reject_reason
FROM p WHERE NOT ({_READ}) OR {_BAD}""")

_SVC = S.py_strip("regexp_replace(question_no_raw, '\\\\[(].*?\\\\[)]', '', 'g')")
_NB = S.py_strip("regexp_replace(question_no_raw, '[(][^)]*[)]', '', 'g')")
ORACLE["page_question_bounds"] = _q(f"""
WITH d AS (SELECT scan_id, page_no, entry_ord, {_SVC} AS svc, {_NB} AS nb FROM transcription)
SELECT scan_id, page_no,
  coalesce(arg_min(svc, entry_ord) FILTER (WHERE regexp_matches(svc, '^[0-9]+$')), 'N/A') AS first_service,
  coalesce(arg_max(svc, entry_ord) FILTER (WHERE regexp_matches(svc, '^[0-9]+$')), 'N/A') AS last_service,
  coalesce(arg_min(nb, entry_ord) FILTER (WHERE regexp_matches(nb, '^[0-9]+$')), 'N/A') AS first_notebook,
  coalesce(arg_max(nb, entry_ord) FILTER (WHERE regexp_matches(nb, '^[0-9]+$')), 'N/A') AS last_notebook
FROM d GROUP BY scan_id, page_no""")

ORACLE["page_range"] = _q("""
SELECT scan_id, page_no, entry_ord, row_id FROM transcription
WHERE page_no >= 3 AND page_no <= 40""")

ORACLE["scan_summary"] = _q(f"""
WITH {NAMED},
d AS (
  SELECT *, {S.normalize_qno('question_no_raw')} AS question_no,
         (coalesce(NOT contains(question, 'Question No'), true) AND question IS NOT NULL) AS keep
  FROM named)
SELECT scan_id, count(*) AS total_entries, count(DISTINCT page_no) AS pages_processed, min(page_no) AS start_page,
       count(DISTINCT CASE WHEN keep THEN student_name END) AS students_found,
       count(DISTINCT CASE WHEN keep THEN question_no END) AS total_questions,
       count_if(keep AND (answer IS NULL OR {S.has_text('answer')})) AS total_answers,
       count_if(keep AND grading IN ('Correct', 'Incorrect')) AS graded_answers,
       min(page_no) + count(DISTINCT page_no) - 1 AS end_page
FROM d GROUP BY scan_id""")

# ---------------------------------------------------------------- more analysis

ORACLE["wrong_answer_text"] = _q(f"""
WITH {BASE},
w AS (SELECT sub_question_no, row_id, answer,
             row_number() OVER (PARTITION BY sub_question_no ORDER BY row_id) AS wrong_ord
      FROM {GROUPED} g WHERE {WRONG})
SELECT sub_question_no, CAST((wrong_ord - 1) // 200 AS BIGINT) AS chunk_no,
       string_agg(answer, chr(10) ORDER BY wrong_ord) AS wrong_text, count(*) AS n_lines
FROM w GROUP BY 1, 2""")


def _sample_sql(pool: str) -> str:
    if pool == "strict":
        cond = f"grading = 'Correct' AND {S.has_text('answer')}"
    else:
        cond = f"coalesce(contains(lower(grading), 'correct'), false) AND {S.has_text('answer')}"
    return f"""
WITH {BASE},
g AS {GROUPED},
need AS (SELECT sub_question_no, count_if(grading = 'Correct') AS n_correct, count_if({cond}) AS n_pool,
                least(10, count_if(grading = 'Correct')) AS n_take
         FROM g GROUP BY sub_question_no),
ranked AS (SELECT sub_question_no, answer,
                  row_number() OVER (PARTITION BY sub_question_no
                                     ORDER BY md5(CAST(row_id AS VARCHAR) || ':1'), row_id) AS rn
           FROM g WHERE {cond})
SELECT r.sub_question_no, CAST(r.rn AS INTEGER) AS sample_rank, r.answer
FROM ranked r JOIN need n USING (sub_question_no)
WHERE n.n_pool >= n.n_take AND r.rn <= n.n_take
UNION ALL
SELECT sub_question_no, 1 AS sample_rank, 'No correct answer transcribed' AS answer FROM need WHERE n_pool < n_take"""


ORACLE["correct_sample"] = _q(_sample_sql("strict"))
ORACLE["correct_sample_reference"] = _q(_sample_sql("reference"))

ORACLE["correct_sample_text"] = _q(f"""
WITH s AS ({_sample_sql('strict')})
SELECT sub_question_no, string_agg(DISTINCT answer, chr(10) ORDER BY answer) AS sample_text,
       count(DISTINCT answer) AS n_distinct
FROM s WHERE answer IS NOT NULL AND answer <> '' GROUP BY sub_question_no""")

ORACLE["misconception_requests"] = _q(f"""
WITH {BASE},
w AS (SELECT sub_question_no, row_id, answer,
             row_number() OVER (PARTITION BY sub_question_no ORDER BY row_id) AS wrong_ord
      FROM {GROUPED} g WHERE {WRONG}),
wt AS (SELECT sub_question_no, CAST((wrong_ord - 1) // 200 AS BIGINT) AS chunk_no,
              string_agg(answer, chr(10) ORDER BY wrong_ord) AS wrong_text, count(*) AS n_lines
       FROM w GROUP BY 1, 2),
st AS (SELECT sub_question_no, arg_min_null(question, row_id) AS question FROM {GROUPED} g GROUP BY 1),
smp AS ({_sample_sql('strict').replace('WITH ' + BASE + ',', 'WITH ')}),
stxt AS (SELECT sub_question_no, string_agg(DISTINCT answer, chr(10) ORDER BY answer) AS sample_text
         FROM smp WHERE answer IS NOT NULL AND answer <> '' GROUP BY 1)
SELECT wt.sub_question_no, wt.chunk_no, st.question, wt.n_lines,
       'Question: ' || coalesce(st.question, '') || chr(10) || 'Wrong answers:' || chr(10) || wt.wrong_text
       || chr(10) || 'Correct answers sample:' || chr(10) || coalesce(stxt.sample_text, '') AS request_text
FROM wt JOIN st USING (sub_question_no) LEFT JOIN stxt USING (sub_question_no)""")

ORACLE["duplicate_answers"] = _q(f"""
WITH {BASE},
r AS (SELECT scan_id, row_id, student_name, question_no FROM arows
      UNION ALL SELECT scan_id, row_id + 1000000000000, student_name, question_no FROM arows WHERE row_id % 9 = 0),
c AS (SELECT scan_id, student_name, question_no, count(*) AS dup_count FROM r GROUP BY ALL HAVING count(*) > 1)
SELECT r.scan_id, r.row_id, r.student_name, r.question_no, c.dup_count
FROM r JOIN c ON r.scan_id IS NOT DISTINCT FROM c.scan_id AND r.student_name IS NOT DISTINCT FROM c.student_name
             AND r.question_no IS NOT DISTINCT FROM c.question_no""")

ORACLE["unique_questions"] = _q(f"""
WITH {BASE},
q AS (SELECT {S.integer_text('question_no')} AS question_no, question, row_id FROM arows
      WHERE question_no IS NOT NULL AND question IS NOT NULL),
f AS (SELECT question, arg_min_null(question_no, row_id) AS question_no FROM q GROUP BY question)
SELECT DISTINCT {S.base_qno('question_no')} AS question_no, question FROM f""")

ORACLE["question_number_context"] = _q(f"""
WITH d AS (
  SELECT file_id, row_ord, question_no,
         (question_no IS NULL OR {S.py_strip('question_no')} = '' OR lower({S.py_strip('question_no')}) = 'nan') AS blank,
         {S.delimit_cell('question_no')} AS s
  FROM number_context),
m AS (SELECT *, CASE WHEN NOT blank AND regexp_extract(s, '^([0-9]+)', 1) <> '' THEN regexp_extract(s, '^([0-9]+)', 1) END AS main
      FROM d),
c AS (SELECT *, last_value(main IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_ord
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctx FROM m)
SELECT file_id, row_ord, question_no,
  CASE WHEN blank THEN ''
       WHEN main IS NOT NULL THEN main || {S.letter_parts('s')}
       WHEN ctx IS NOT NULL AND regexp_matches(s, '[A-Za-z]') THEN ctx || {S.letter_parts('s')}
       ELSE s END AS question_no_clean
FROM c""", "number_context")

ORACLE["duplicate_answers_global"] = _q(f"""
WITH {BASE},
r AS (SELECT scan_id, row_id, student_name, question_no FROM arows),
c AS (SELECT student_name, question_no, count(*) AS dup_count FROM r GROUP BY ALL HAVING count(*) > 1)
SELECT r.scan_id, r.row_id, r.student_name, r.question_no, c.dup_count
FROM r JOIN c ON r.student_name IS NOT DISTINCT FROM c.student_name
             AND r.question_no IS NOT DISTINCT FROM c.question_no""")

# ---------------------------------------------------------------- topics

from ..operators import topics as _TP  # noqa: E402

_TAX = "taxonomy(subject, topic, topic_ord) AS (VALUES " + ", ".join(
    f"({S.lit(s)}, {S.lit(t)}, {i})" for s, ts in _TP.SUBJECT_TOPICS.items() for i, t in enumerate(ts, 1)
) + ")"
_TAXW = f"""{_TAX},
taxw AS (SELECT subject, topic, topic_ord,
                list_filter(list_distinct(regexp_extract_all(lower(topic), '([a-z]+)', 1)), lambda w: w <> 'and') AS words
         FROM taxonomy)"""

UNIQUE_Q = f"""uq0 AS (SELECT {S.integer_text('question_no')} AS question_no, question, row_id FROM arows
      WHERE question_no IS NOT NULL AND question IS NOT NULL),
uq1 AS (SELECT question, arg_min_null(question_no, row_id) AS question_no FROM uq0 GROUP BY question),
uq AS (SELECT DISTINCT {S.base_qno('question_no')} AS question_no, question FROM uq1)"""

ORACLE["topic_batches"] = _q("""
WITH b AS (SELECT row_id, question_no, subject,
                  row_number() OVER (PARTITION BY subject ORDER BY row_id) AS q_rank FROM topic_questions)
SELECT row_id, question_no, subject, q_rank, (q_rank - 1) // 30 + 1 AS batch_no FROM b""", "topic_questions")

ORACLE["topic_requests"] = _q(f"""
WITH {_TAX},
b AS (SELECT subject, question_no, question,
             row_number() OVER (PARTITION BY subject ORDER BY row_id) AS q_rank FROM topic_questions),
r AS (SELECT subject, (q_rank - 1) // 30 + 1 AS batch_no,
             string_agg('- Question No: ' || question_no || ', Question: ' || question, chr(10) ORDER BY q_rank)
               AS questions_text, count(*) AS n_questions
      FROM b GROUP BY 1, 2),
tl AS (SELECT subject, string_agg(topic, ', ' ORDER BY topic_ord) AS topic_list FROM taxonomy GROUP BY subject)
SELECT r.subject, r.batch_no, r.n_questions, r.questions_text, tl.topic_list FROM r LEFT JOIN tl USING (subject)""",
                               "topic_questions")

_ASSIGN = f"""{_TAXW},
qw AS (SELECT row_id, question_no, subject, question,
              list_distinct(regexp_extract_all(lower(question), '([a-z]+)', 1)) AS qwords FROM topic_questions),
sc AS (SELECT q.row_id, t.topic, t.topic_ord, len(list_intersect(t.words, q.qwords)) AS hits, len(t.words) AS n_words
       FROM qw q JOIN taxw t ON q.subject = t.subject),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY hits DESC, topic_ord) AS rn FROM sc) x
         WHERE rn = 1),
assigned AS (
  SELECT q.row_id, q.question_no, q.subject, q.question,
         CASE WHEN b.row_id IS NULL THEN '{_TP.NOT_AVAILABLE}' WHEN b.hits > 0 THEN b.topic ELSE '{_TP.FAILED}' END
           AS topic,
         CASE WHEN b.hits > 0 THEN CAST(b.hits AS DOUBLE) / CAST(b.n_words AS DOUBLE) ELSE 0.0 END AS confidence
  FROM qw q LEFT JOIN best b USING (row_id))"""

ORACLE["topic_assign"] = _q(f"WITH {_ASSIGN}\nSELECT * FROM assigned", "topic_questions")

ORACLE["topic_statistics"] = _q(f"""
WITH {_ASSIGN},
per AS (SELECT topic, count(*) AS question_count FROM assigned GROUP BY topic)
SELECT topic, question_count,
       {S.percent_value('question_count', 'sum(question_count) OVER ()', 2)} AS percentage
FROM per""", "topic_questions")

ORACLE["topic_merge_fanout"] = _q(f"""
WITH {BASE}, {UNIQUE_Q}
SELECT uq.question_no, uq.question, t.topic, t.confidence
FROM uq LEFT JOIN topic_results t ON uq.question_no = t.question_no""", "transcription", "topic_results")

ORACLE["topic_lookup_first"] = _q(f"""
WITH {BASE}, {UNIQUE_Q},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY result_ord) AS rn
                     FROM topic_results) x WHERE rn = 1)
SELECT uq.question_no, uq.question,
       CASE WHEN f.batch_ok THEN f.topic ELSE 'Classification Failed' END AS topic,
       CASE WHEN f.batch_ok THEN f.confidence ELSE 0.0 END AS confidence,
       CASE WHEN f.question_no IS NULL THEN 'No matching question number found'
            WHEN f.batch_ok THEN coalesce(f.explanation, '') ELSE 'API error occurred' END AS explanation
FROM uq LEFT JOIN f ON uq.question_no = f.question_no""", "transcription", "topic_results")

# ---------------------------------------------------------------- catalog

from ..operators.catalog import EXAM_TYPES as _TYPES  # noqa: E402

ORACLE["exam_with_type"] = _q("""
SELECT e.id, e.name, e.exam_type_id, e.type_name, t.name AS exam_type_name
FROM exams e LEFT JOIN exam_types t ON e.exam_type_id = t.id""", "exams", "exam_types")

ORACLE["valid_exams"] = _q("""
SELECT * FROM exams e WHERE EXISTS (SELECT 1 FROM exam_types t WHERE t.id = e.exam_type_id)""", "exams", "exam_types")

ORACLE["orphan_exams"] = _q("""
SELECT * FROM exams e WHERE NOT EXISTS (SELECT 1 FROM exam_types t WHERE t.id = e.exam_type_id)""",
                             "exams", "exam_types")

ORACLE["deletable_types"] = _q("""
SELECT * FROM exam_types t WHERE NOT EXISTS (SELECT 1 FROM exams e WHERE e.exam_type_id = t.id)""",
                                "exams", "exam_types")

ORACLE["delete_blockers"] = _q("""
SELECT t.id, t.name, count(*) AS n_dependants FROM exam_types t JOIN exams e ON e.exam_type_id = t.id
GROUP BY t.id, t.name""", "exams", "exam_types")

ORACLE["deletable_exams"] = _q("""
SELECT * FROM exams e WHERE NOT EXISTS (SELECT 1 FROM uploads u WHERE u.exam_id = e.id)""", "exams", "uploads")

ORACLE["report_rollup"] = _q("""
WITH r AS (SELECT exam_id, count(*) AS total_reports,
                  count_if(coalesce(contains(report_type, 'transcription'), false)) AS transcription_reports,
                  count_if(NOT coalesce(contains(report_type, 'transcription'), false)
                           AND coalesce(contains(report_type, 'analysis'), false)) AS analysis_reports
           FROM reports GROUP BY exam_id),
u AS (SELECT exam_id, count(*) AS uploads FROM uploads GROUP BY exam_id)
SELECT e.id, e.name, coalesce(r.total_reports, 0) AS total_reports,
       coalesce(r.transcription_reports, 0) AS transcription_reports,
       coalesce(r.analysis_reports, 0) AS analysis_reports, coalesce(u.uploads, 0) AS uploads
FROM exams e LEFT JOIN r ON r.exam_id = e.id LEFT JOIN u ON u.exam_id = e.id""", "exams", "reports", "uploads")

_DOMAIN = ", ".join(S.lit(t) for t in _TYPES)
ORACLE["exam_get_or_create"] = _q(f"""
WITH rej AS (SELECT name, type_name, CAST(NULL AS BIGINT) AS exam_id, 'rejected' AS status, in_ord
             FROM incoming_exams WHERE type_name IS NULL OR type_name NOT IN ({_DOMAIN})),
f AS (SELECT name, arg_min(type_name, in_ord) AS type_name, min(in_ord) AS in_ord
      FROM incoming_exams WHERE type_name IN ({_DOMAIN}) GROUP BY name),
found AS (SELECT f.*, CAST(e.id AS BIGINT) AS eid FROM f LEFT JOIN exams e ON f.name = e.name),
mx AS (SELECT CAST(coalesce(max(id), 0) AS BIGINT) AS m FROM exams)
SELECT name, type_name, eid AS exam_id, 'existing' AS status, in_ord FROM found WHERE eid IS NOT NULL
UNION ALL
SELECT name, type_name, (SELECT m FROM mx) + row_number() OVER (ORDER BY in_ord) AS exam_id, 'created' AS status, in_ord
FROM found WHERE eid IS NULL
UNION ALL
SELECT * FROM rej""", "exams", "incoming_exams")

ORACLE["exam_patch"] = _q("""
WITH last AS (
  SELECT id, set_field, name, exam_type_id,
         row_number() OVER (PARTITION BY id, set_field ORDER BY patch_ord DESC) AS rn FROM exam_patches)
SELECT e.id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE e.name END AS name,
       CASE WHEN t.id IS NOT NULL THEN t.exam_type_id ELSE e.exam_type_id END AS exam_type_id, e.type_name
FROM exams e
LEFT JOIN last n ON n.id = e.id AND n.set_field = 'name' AND n.rn = 1
LEFT JOIN last t ON t.id = e.id AND t.set_field = 'exam_type_id' AND t.rn = 1""", "exams", "exam_patches")

# ---------------------------------------------------------------- importer


def _nb(x: str) -> str:
    v = f"CAST({x} AS VARCHAR)"
    return f"CASE WHEN {v} IS NULL OR {v} IN ('', 'nan', 'NaN') THEN NULL ELSE {v} END"


_IMPORT = f"""
a AS (SELECT 'import_a' AS source_file, {_nb('"Student Name"')} AS student_name, CAST(NULL AS VARCHAR) AS class_name,
             CAST(NULL AS VARCHAR) AS subject_name, {_nb('"questionNo"')} AS question_no, {_nb('"Question"')} AS question,
             {_nb('"answer"')} AS answer, {_nb('"Page_Number"')} AS page_number,
             coalesce({_nb('"score"')}, {_nb('"marks"')}) AS grading FROM import_a),
b AS (SELECT 'import_b' AS source_file, {_nb('"student_name"')} AS student_name, CAST(NULL AS VARCHAR) AS class_name,
             {_nb('"Subject  Name"')} AS subject_name, {_nb('"Question Number"')} AS question_no,
             CAST(NULL AS VARCHAR) AS question, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS page_number,
             {_nb('"grade"')} AS grading FROM import_b),
ab AS (SELECT * FROM a UNION ALL SELECT * FROM b),
recs AS (
  SELECT source_file, CAST(1 AS BIGINT) AS exam_id, student_name, class_name,
         coalesce(subject_name, 'SST') AS subject_name, question_no, question, answer,
         TRY_CAST(page_number AS INTEGER) AS page_number, grading,
         (page_number IS NULL OR TRY_CAST(page_number AS INTEGER) IS NOT NULL) AS accepted
  FROM ab
  WHERE coalesce(student_name, class_name, subject_name, question_no, question, answer, page_number, grading) IS NOT NULL)"""

ORACLE["import_reports"] = _q(f"WITH {_IMPORT}\nSELECT * FROM recs", "import_a", "import_b")

ORACLE["import_tally"] = _q(f"""
WITH {_IMPORT}
SELECT coalesce(source_file, 'ALL') AS source_file, count(*) AS total, count_if(accepted) AS inserted
FROM recs GROUP BY ROLLUP (source_file)""", "import_a", "import_b")

# ---------------------------------------------------------------- round trips: equal to their input

ORACLE["csv_roundtrip"] = ORACLE["clean_transcription"]
ORACLE["pipe_roundtrip"] = ORACLE["clean_transcription"]
ORACLE["jsonl_roundtrip"] = ORACLE["clean_transcription"]
ORACLE["ndjson_report"] = ORACLE["question_analysis"]
ORACLE["report_bundle"] = ORACLE["question_analysis"]
ORACLE["report_table_append"] = _q(f"""
WITH {_IMPORT}
SELECT CAST(CASE source_file WHEN 'import_a' THEN 1 ELSE 2 END AS BIGINT) AS exam_id, student_name, class_name, subject_name,
       question_no, question, answer, page_number, grading
FROM recs WHERE accepted""", "import_a", "import_b")
ORACLE["report_table_rejects"] = _q(f"WITH {_IMPORT}\nSELECT * EXCLUDE (accepted) FROM recs WHERE NOT accepted", "import_a", "import_b")

ORACLE["page_base64"] = """
SELECT page_id, 'page_' || CAST(page_id AS VARCHAR) || '.png' AS image_name, to_base64(encode(html)) AS b64,
       CAST(octet_length(encode(html)) AS INTEGER) AS n_bytes, true AS decoded_ok
FROM pages"""

ORACLE["page_image_files"] = """
SELECT page_id, 'page_' || CAST(page_id AS VARCHAR) || '.png' AS image_name,
       CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, to_base64(encode(coalesce(html, ''))) AS b64
FROM pages"""
ORACLE["stream_page_images"] = ORACLE["page_image_files"]

# ---------------------------------------------------------------- streaming: equal to the batch result

ORACLE["stream_ingest"] = _q(f"WITH named AS (SELECT * FROM transcription WHERE {_READ})" + _entries(""))

ORACLE["stream_carry_forward"] = _q("""
SELECT scan_id, page_no, student_raw,
       coalesce(last_value(nullif(student_raw, '') IGNORE NULLS) OVER (
         PARTITION BY scan_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS student_name
FROM exam_pages WHERE (scan_id * 50 + page_no) % 11 <> 3""", "exam_pages")

ORACLE["stream_question_stats"] = _q(f"""
WITH {BASE}
SELECT sub_question_no, count(*) AS attempts, count_if(grading = 'Correct') AS correct_answers
FROM arows WHERE sub_question_no IS NOT NULL GROUP BY sub_question_no""")

# ---------------------------------------------------------------- more sources, names, lookups, R4

ORACLE["question_list_lenient"] = _q("""
SELECT question_no,
       CASE WHEN row_id % 4 = 0 THEN question || ', ' || subject ELSE question END AS question
FROM topic_questions""", "topic_questions")

ORACLE["notebook_reimport"] = ORACLE["clean_transcription"]
ORACLE["import_from_files"] = ORACLE["import_reports"]

ORACLE["report_names"] = _q(f"""
WITH {NAMED}, {CLEAN[:-1].replace('student_name,', 'student_name, landed_at,', 1)})
SELECT scan_id, 'Exam_' || strftime(max(landed_at), '%Y-%m-%d_%H-%M') AS exam_name,
       'scan' || CAST(scan_id AS VARCHAR) || '_transcription.csv' AS transcription_file,
       'scan' || CAST(scan_id AS VARCHAR) || '_analysis' AS analysis_report,
       'exam_report_' || arg_min_null(class_name, row_id) || '_' || arg_min_null(subject_name, row_id) || '_'
         || strftime(max(landed_at), '%d_%m_%Y_%H_%M') AS report_name
FROM clean GROUP BY scan_id""")

ORACLE["exam_by_id"] = _q("SELECT * FROM exams WHERE id = 7", "exams")
ORACLE["misconception_attach"] = _q(f"""
WITH {BASE},
stats AS (
  SELECT sub_question_no, arg_min_null(main_question_no, row_id) AS main_question_no,
         arg_min_null(question, row_id) AS question, count(*) AS attempts,
         count(DISTINCT student_name) AS distinct_students, count_if(grading = 'Correct') AS correct_answers
  FROM {GROUPED} g GROUP BY sub_question_no),
w AS (
  SELECT sub_question_no, {S.normalize_answer('answer')} AS theme,
         (row_number() OVER (PARTITION BY sub_question_no ORDER BY row_id) - 1) // 200 AS chunk_no
  FROM {GROUPED} g WHERE {WRONG}),
n AS (SELECT sub_question_no, chunk_no, theme, count(*) AS n FROM w GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_no, chunk_no ORDER BY n DESC, theme) AS rn FROM n) t
        WHERE rn = 1),
themes AS (SELECT sub_question_no, theme, CAST(sum(n) AS INTEGER) AS n FROM top GROUP BY 1, 2),
mis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sub_question_no ORDER BY n DESC, theme) AS rn FROM themes) t
        WHERE rn = 1)
SELECT s.main_question_no, s.question, s.sub_question_no, s.attempts, s.distinct_students, s.correct_answers,
       {S.percent_text('s.correct_answers', 's.attempts', 1)} AS correct_pct,
       CAST(s.correct_answers AS DOUBLE) * 100.0 / CAST(s.attempts AS DOUBLE) AS correct_pct_value,
       m.theme AS misconception, coalesce(m.n, 0) AS misconception_frequency
FROM stats s LEFT JOIN mis m USING (sub_question_no)""")


# ---------------------------------------------------------------- nested type, strict modes, notebook list, bundles, folders

ORACLE["exam_nested_type"] = _q("""
SELECT e.id, e.name, t.id AS type_id, t.name AS type_label FROM exams e LEFT JOIN exam_types t ON t.id = e.exam_type_id""",
                                "exams", "exam_types")
ORACLE["import_strict_columns"] = _q(f"""
WITH {_IMPORT}
SELECT * REPLACE (accepted AND source_file <> 'import_a' AS accepted) FROM recs""", "import_a", "import_b")
ORACLE["page_number_rejects"] = _q("""
SELECT "Page_Number" AS page_no, "questionNo", count(*) AS n FROM import_a
WHERE "Page_Number" IS NOT NULL AND TRY_CAST("Page_Number" AS INTEGER) IS NULL GROUP BY 1, 2""", "import_a")
ORACLE["notebook_questions"] = _q(f"""
WITH {BASE}
SELECT DISTINCT {S.integer_text('question_no')} AS question_no, question FROM arows
WHERE question_no IS NOT NULL AND question IS NOT NULL""")
ORACLE["topic_bundle"] = _q(f"""
WITH {_ASSIGN},
per AS (SELECT topic, count(*) AS question_count FROM assigned GROUP BY topic)
SELECT topic, question_count, {S.percent_value('question_count', 'sum(question_count) OVER ()', 2)} AS percentage,
       question_count AS questions_read
FROM per""", "topic_questions")
ORACLE["report_raw_part"] = ORACLE["clean_transcription"]
ORACLE["folder_import_tally"] = _q(f"""
WITH {_IMPORT}
SELECT coalesce(source_file || '.csv', 'ALL') AS source_file, count(*) AS total, count_if(accepted) AS inserted
FROM recs GROUP BY ROLLUP (source_file)""", "import_a", "import_b")


# ---------------------------------------------------------------- ledger, one-scan folder, batches, sketches, ordered files

ORACLE["topic_ledger"] = _q(f"""
WITH {_ASSIGN},
b AS (SELECT row_id, question_no, subject, row_number() OVER (PARTITION BY subject ORDER BY row_id) AS q_rank FROM topic_questions),
s AS (SELECT *, (q_rank - 1) // 30 + 1 AS batch_no FROM b)
SELECT s.row_id, s.question_no, s.subject, s.batch_no,
       CASE WHEN batch_no % 11 = 7 OR batch_no % 5 = 2 OR q_rank % 7 = 3 THEN 'Classification Failed' ELSE a.topic END AS topic,
       CASE WHEN batch_no % 11 = 7 OR batch_no % 5 = 2 OR q_rank % 7 = 3 THEN 0.0 ELSE a.confidence END AS confidence,
       CASE WHEN batch_no % 11 = 7 OR batch_no % 5 = 2 THEN 'API error occurred'
            WHEN q_rank % 7 = 3 THEN 'No matching question number found'
            WHEN q_rank % 4 <> 1 THEN 'Because of ' || a.topic ELSE '' END AS explanation
FROM s JOIN assigned a USING (row_id)""", "topic_questions")

_LANDED = "CASE source_file WHEN 'import_a' THEN 'import_a.csv' ELSE 'import_b.jsonl' END"
ORACLE["folder_scan_import"] = _q(f"WITH {_IMPORT}\nSELECT {_LANDED} AS source_file, * EXCLUDE (source_file) FROM recs", "import_a", "import_b")
ORACLE["folder_scan_tally"] = _q(f"""
WITH {_IMPORT}
SELECT coalesce({_LANDED.replace('source_file', 'f')}, 'ALL') AS source_file, total, inserted
FROM (SELECT source_file AS f, count(*) AS total, count_if(accepted) AS inserted FROM recs GROUP BY source_file) x
UNION ALL SELECT 'ALL', count(*), count_if(accepted) FROM recs""", "import_a", "import_b")
ORACLE["report_batch_commit"] = ORACLE["report_table_append"]

ORACLE["stream_student_sketches"] = _q(f"""
WITH {BASE}
SELECT sub_question_no, count(*) AS attempts, count_if(grading = 'Correct') AS correct_answers,
       count(DISTINCT nullif(student_raw, '')) AS students
FROM arows JOIN (SELECT row_id, student_raw FROM transcription) t USING (row_id)
WHERE sub_question_no IS NOT NULL GROUP BY sub_question_no""")

ORACLE["report_file_order"] = _q(f"""
WITH {BASE},
a AS (SELECT sub_question_no, count(*) AS attempts FROM {GROUPED} g GROUP BY 1)
SELECT 'text' AS file_order, row_number() OVER (ORDER BY sub_question_no) AS position, * FROM a
UNION ALL
SELECT 'natural', row_number() OVER (ORDER BY try_cast(nullif(regexp_extract(sub_question_no, '^([0-9]+)', 1), '') AS BIGINT) NULLS LAST, sub_question_no), *
FROM a""")


ORACLE["clean_transcription_strict"] = ORACLE["clean_transcription"]
ORACLE["exam_create_strict"] = f"SELECT * FROM ({ORACLE['exam_get_or_create']}) WHERE status <> 'rejected'"
ORACLE["import_counted_write"] = _q(f"""
WITH {_IMPORT}
SELECT source_file, count(*) AS total, count_if(accepted) AS accepted, count_if(NOT accepted) AS refused,
       CASE WHEN source_file = 'import_b' THEN (SELECT count(*) FROM import_b WHERE student_name IS NULL AND "Subject  Name" IS NULL) ELSE 0 END AS blank,
       count_if(accepted) AS rows_read
FROM recs GROUP BY source_file""", "import_a", "import_b")

ORACLE["job_summary"] = _q(f"""
{_PAGE_NAMED},
d AS ({_entries("student_name,")}),
k AS (SELECT *, {S.normalize_qno('question_no_raw')} AS question_no,
             (coalesce(NOT contains(question, 'Question No'), true) AND question IS NOT NULL) AS keep FROM d),
p AS (SELECT scan_id, count(DISTINCT page_no) AS pages_processed, min(page_no) AS start_page FROM transcription GROUP BY scan_id),
e AS (SELECT scan_id, count(*) AS total_entries, count(DISTINCT CASE WHEN keep THEN student_name END) AS students_found,
             count(DISTINCT CASE WHEN keep THEN question_no END) AS total_questions,
             count_if(keep AND (answer IS NULL OR {S.has_text('answer')})) AS total_answers,
             count_if(keep AND grading IN ('Correct', 'Incorrect')) AS graded_answers
      FROM k GROUP BY scan_id)
SELECT p.scan_id, p.pages_processed, p.start_page, p.start_page + p.pages_processed - 1 AS end_page,
       coalesce(total_entries, 0) AS total_entries, coalesce(students_found, 0) AS students_found,
       coalesce(total_questions, 0) AS total_questions, coalesce(total_answers, 0) AS total_answers,
       coalesce(graded_answers, 0) AS graded_answers
FROM p LEFT JOIN e USING (scan_id)""")


def _bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is HUGEINT; Spark's is BIGINT. Wrap every call."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(tok) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append(sql[i:j])
        inner = sql[j + len(tok):k]
        out.append(f"CAST(count_if({_bigint_counts(inner)}) AS BIGINT)")
        i = k + 1


ORACLE = {k: _bigint_counts(v) for k, v in ORACLE.items()}
