"""Adapter SQL (FIXTURES.md §3) for the DuckDB oracle, in dependency order.

The Spark side builds the same tables with the DataFrame API in
``examlytics.sources.fixtures``.
"""
ADAPTERS: dict[str, str] = {}

ADAPTERS['transcription'] = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(floor(event_id / 250.0) AS BIGINT) AS scan_id,
         CAST(floor((event_id % 250) / 5.0) AS INT) + 1 AS page_no,
         CAST(event_id % 5 AS INT) AS entry_ord,
         CAST(event_id % 20 AS INT) + 1 AS m
  FROM events),
q AS (
  SELECT *, CASE m % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS l,
         CASE m % 2 WHEN 0 THEN 'i' ELSE 'ii' END AS r,
         CAST(m AS STRING) AS ms
  FROM e)
SELECT scan_id, page_no, entry_ord, event_id AS row_id,
  CASE WHEN (page_no - 1) % 4 <> 0 OR (page_no = 1 AND scan_id % 5 = 0) THEN ''
       ELSE 'Student ' || CAST((scan_id * 13 + CAST(floor((page_no - 1) / 4.0) AS BIGINT)) % 97 AS STRING) END AS student_raw,
  CASE user_id % 6
    WHEN 0 THEN ms || '(' || l || ')(' || r || ')'
    WHEN 1 THEN ms || '.' || l || '.' || r
    WHEN 2 THEN ms || l || '(' || r || ')'
    WHEN 3 THEN ms || '.(' || l || ').' || r
    WHEN 4 THEN ms || ' (' || l || ') (' || r || ')'
    ELSE ms || '.' || l END AS question_no_raw,
  CASE WHEN event_id % 97 = 0 THEN 'Question No' WHEN event_id % 89 = 0 THEN NULL
       ELSE 'Question text ' || ms || l END AS question,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '   '
       ELSE 'answer ' || CAST(CAST(floor(value) AS BIGINT) % 5 AS STRING) END AS answer,
  CASE event_type WHEN 'purchase' THEN 'Correct' WHEN 'signup' THEN 'Correct'
       WHEN 'error' THEN 'Incorrect' WHEN 'view' THEN 'Not Graded'
       ELSE CASE WHEN user_id % 2 = 0 THEN NULL ELSE '' END END AS grading,
  '(P' || CAST(scan_id % 7 AS STRING) || ')' AS class_raw,
  '[' || CASE scan_id % 5 WHEN 0 THEN 'SST' WHEN 1 THEN 'Mathematics' WHEN 2 THEN 'Science'
       WHEN 3 THEN 'English' ELSE 'CRE' END || ']' AS subject_raw,
  ts AS landed_at
FROM q
"""

ADAPTERS['exam_pages'] = """
SELECT scan_id, page_no, MAX(student_raw) AS student_raw, COUNT(*) AS n_entries,
       MAX(landed_at) AS landed_at
FROM transcription GROUP BY scan_id, page_no
"""

ADAPTERS['raw_responses'] = """
WITH j AS (
  SELECT scan_id, page_no, entry_ord, student_raw,
    '{"questionNo": "' || question_no_raw || '", "question": ' || coalesce('"' || question || '"', 'null')
    || ', "answer": ' || coalesce('"' || answer || '"', 'null')
    || ', "grading": ' || coalesce('"' || grading || '"', 'null') || '}' AS js
  FROM transcription),
p AS (
  SELECT scan_id, page_no, '{"studentName": "' || MAX(student_raw) || '", "entries": ['
    || MAX(CASE WHEN entry_ord = 0 THEN js END) || ', ' || MAX(CASE WHEN entry_ord = 1 THEN js END) || ', '
    || MAX(CASE WHEN entry_ord = 2 THEN js END) || ', ' || MAX(CASE WHEN entry_ord = 3 THEN js END) || ', '
    || MAX(CASE WHEN entry_ord = 4 THEN js END) || ']}' AS obj, '{"studentName": "' || MAX(student_raw) || '", "entries": ' AS head
  FROM j GROUP BY scan_id, page_no)
SELECT scan_id, page_no,
  CASE WHEN (scan_id * 50 + page_no) % 17 = 0 THEN substr(obj, 1, 40)
       WHEN (scan_id * 50 + page_no) % 19 = 0 THEN '{"studentName": "X"}'
       WHEN (scan_id * 50 + page_no) % 23 = 0 THEN head || '[]}'
       WHEN (scan_id * 50 + page_no) % 29 = 0 THEN head || 'null}'
       WHEN (scan_id * 50 + page_no) % 31 = 0 THEN head || '"none"}'
       WHEN (scan_id * 50 + page_no) % 37 = 0 THEN head || '[{"questionNo": "1"}, "text"]}'
       WHEN (scan_id * 50 + page_no) % 41 = 0 THEN head || '[{"questionNo": "1(a)"}, {"answer": null}]}'
       WHEN page_no % 5 = 1 THEN repeat(chr(96), 3) || 'json' || chr(10) || obj || chr(10) || repeat(chr(96), 3)
       WHEN page_no % 5 = 2 THEN 'Here is the result: ' || obj || ' Done.'
       WHEN page_no % 5 = 4 THEN repeat(chr(96), 3) || chr(10) || obj || chr(10) || repeat(chr(96), 3)
       ELSE obj END AS raw_content
FROM p
"""

ADAPTERS['number_context'] = """
WITH e AS (
  SELECT event_id, CAST(floor(event_id / 250.0) AS BIGINT) AS file_id,
         CAST(CAST(event_id % 20 AS INT) + 1 AS STRING) AS ms,
         CASE event_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS l,
         CASE event_id % 2 WHEN 0 THEN 'i' ELSE 'ii' END AS r
  FROM events)
SELECT file_id, event_id AS row_ord,
  CASE event_id % 8 WHEN 0 THEN l WHEN 1 THEN ms || l || ' ' || r WHEN 2 THEN l || r WHEN 3 THEN ''
       WHEN 4 THEN 'Either ' || l WHEN 5 THEN ms || '.' || l || '.' || r WHEN 6 THEN '*'
       ELSE CAST(NULL AS STRING) END AS question_no
FROM e
"""

ADAPTERS['import_a'] = """
SELECT student_raw AS "Student Name", question_no_raw AS "questionNo", question AS "Question",
       CASE WHEN row_id % 5 = 0 THEN 'nan' ELSE answer END AS "answer",
       grading AS "marks", CASE WHEN row_id % 3 = 0 THEN 'Incorrect' ELSE '' END AS "score",
       CASE WHEN row_id % 7 = 0 THEN 'page?' ELSE CAST(page_no AS STRING) END AS "Page_Number", 'x' AS "foo"
FROM transcription WHERE scan_id % 2 = 0
"""

ADAPTERS['import_b'] = """
SELECT CASE WHEN row_id % 50 = 1 THEN NULL ELSE student_raw END AS "student_name",
       CASE WHEN row_id % 50 = 1 THEN '' ELSE question_no_raw END AS "Question Number",
       CASE WHEN row_id % 50 = 1 THEN 'NaN' ELSE grading END AS "grade",
       CASE WHEN row_id % 50 = 1 THEN NULL ELSE subject_raw END AS "Subject  Name"
FROM transcription WHERE scan_id % 2 = 1
"""

ADAPTERS['exam_types'] = """
SELECT r_regionkey AS id, r_name AS name FROM region
"""

ADAPTERS['exams'] = """
SELECT n_nationkey AS id, n_name AS name,
       CASE WHEN n_regionkey = 4 THEN 99 ELSE n_regionkey END AS exam_type_id,
       CASE n_nationkey % 4 WHEN 0 THEN 'Midterm' WHEN 1 THEN 'End of Term' WHEN 2 THEN 'Mocks' ELSE 'Quiz' END AS type_name
FROM nation
"""

ADAPTERS['uploads'] = """
SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS exam_id, s_name || '.pdf' AS filename,
       CASE s_suppkey % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status
FROM supplier
"""

ADAPTERS['reports'] = """
SELECT c_custkey AS id, c_nationkey AS exam_id,
       CASE c_custkey % 4 WHEN 0 THEN 'transcription' WHEN 1 THEN 'analysis'
            WHEN 2 THEN 'transcription_analysis' ELSE 'other' END AS report_type
FROM customer
"""

ADAPTERS['exam_patches'] = """
SELECT n_nationkey AS id, 1 AS patch_ord,
       CASE WHEN n_nationkey % 3 = 1 THEN 'exam_type_id' ELSE 'name' END AS set_field,
       CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE 'New ' || n_name END AS name,
       CAST(3 AS INT) AS exam_type_id
FROM nation
UNION ALL
SELECT n_nationkey, 2, CASE WHEN n_nationkey % 3 = 2 THEN 'exam_type_id' WHEN n_nationkey % 4 = 0 THEN 'name' ELSE 'none' END,
       'Newer ' || n_name, CAST(CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 2 END AS INT)
FROM nation
"""

ADAPTERS['topic_results'] = """
WITH n AS (SELECT n_nationkey, n_regionkey, n_name, CAST(n_nationkey % 15 + 1 AS INT) AS m FROM nation)
SELECT n_nationkey AS result_ord,
       CAST(m AS STRING) || '(' || CASE m % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END || ')' AS question_no,
       'Topic ' || CAST(n_regionkey AS STRING) AS topic, CAST(n_regionkey / 4.0 AS DOUBLE) AS confidence,
       CASE WHEN n_nationkey % 4 <> 1 THEN 'Because of ' || n_name END AS explanation, n_nationkey % 5 <> 2 AS batch_ok
FROM n
"""

ADAPTERS['topic_questions'] = """
SELECT p_partkey AS row_id, CAST(p_partkey AS STRING) AS question_no,
       CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN 'SST' WHEN p_partkey % 6 = 1 THEN 'Mathematics'
            WHEN p_partkey % 6 = 2 THEN 'Science' WHEN p_partkey % 6 = 3 THEN 'English' WHEN p_partkey % 6 = 4 THEN 'CRE'
            ELSE 'Art' END AS subject,
       CASE p_partkey % 7 WHEN 0 THEN 'Convert fractions to decimals' WHEN 1 THEN 'Name the forces and energy in a ' || p_name
            WHEN 2 THEN 'Grammar of the sentence ' || p_name WHEN 3 THEN 'Prayer and worship in church'
            WHEN 4 THEN 'Describe history and geography of ' || p_name WHEN 5 THEN 'Draw the geometry of ' || p_name
            ELSE 'What is a ' || p_name END AS question
FROM part
"""

ADAPTERS['incoming_exams'] = """
SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'Mocks' ELSE 'Quiz' END AS type_name, n_nationkey AS in_ord FROM nation
UNION ALL
SELECT 'Exam ' || s_name, CASE s_suppkey % 3 WHEN 0 THEN 'Midterm' WHEN 1 THEN 'End of Term' ELSE 'Quiz' END,
       CAST(1000 + s_suppkey AS INT) FROM supplier
"""
