"""Topic operators: taxonomy, G6/R2 batches and requests, R5 lexical assignment,
E1/E2 merge of topic replies, F10 topic statistics.

The taxonomy is a fixed 38-row table, so it is the one thing broadcast by
construction; everything that grows with the data is joined by key and left to
AQE's runtime size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import percent_value
from .joins import join_keys
from .ordered import DEFAULT_BLOCK, number_rows

# Topics per subject, in the reference's order.
SUBJECT_TOPICS = {
    "SST": [
        "Physical and Human Geography",
        "Civics and Governance",
        "History and Heritage",
        "Economic Activities and Development",
        "Social Systems and Practices",
        "Environmental Conservation and Management",
    ],
    "Mathematics": [
        "Numbers and Numeration",
        "Basic Operations",
        "Fractions and Decimals",
        "Measurement",
        "Geometry and Shapes",
        "Money and Consumer Math",
        "Statistics and Data Handling",
        "Algebra and Patterns",
    ],
    "Science": [
        "Living Things and Life Processes",
        "Human Body Systems",
        "Plants and Animals",
        "Materials and Their Properties",
        "Energy and Forces",
        "Earth and Space",
        "Environmental Science",
        "Health and Safety",
    ],
    "English": [
        "Reading Comprehension",
        "Grammar and Language Structure",
        "Vocabulary Development",
        "Writing Skills",
        "Speaking and Listening",
        "Literature Appreciation",
        "Spelling and Punctuation",
        "Creative Writing",
    ],
    "CRE": [
        "Biblical Stories and Characters",
        "Christian Values and Morals",
        "Prayer and Worship",
        "Church History",
        "Religious Ceremonies and Celebrations",
        "Christian Living",
        "Biblical Geography",
        "Faith and Beliefs",
    ],
}

# Outcome texts.
FAILED = "Classification Failed"
NOT_AVAILABLE = "Topic classification not available for this subject"
NO_MATCH = "No matching question number found"
API_ERROR = "API error occurred"
BATCH_SIZE = 30
STOP_WORDS = ["and"]
WORD_RE = "([a-z]+)"


def taxonomy(spark: SparkSession) -> DataFrame:
    """(subject, topic, topic_ord): the fixed 38-row table."""
    rows = [(s, t, i) for s, ts in SUBJECT_TOPICS.items() for i, t in enumerate(ts, 1)]
    schema = T.StructType(
        [T.StructField("subject", T.StringType()), T.StructField("topic", T.StringType()),
         T.StructField("topic_ord", T.IntegerType())]
    )
    return spark.createDataFrame(rows, schema)


def words(c):
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(WORD_RE), 1))


def subject_topic_arrays(spark: SparkSession) -> DataFrame:
    """One row per subject with its topics as an ordered array of
    (topic_ord, topic, words): 5 tiny rows, safe to broadcast."""
    t = taxonomy(spark).withColumn(
        "words", F.array_except(words(F.col("topic")), F.array(*[F.lit(w) for w in STOP_WORDS]))
    )
    return t.groupBy("subject").agg(
        F.array_sort(F.collect_list(F.struct("topic_ord", "topic", "words"))).alias("topics")
    )


def assign_topics(questions: DataFrame, subject: str = "subject", text: str = "question") -> DataFrame:
    """R5 (offline stand-in for the model's topic call): score every topic of the
    question's subject by the number of distinct shared lower-case words; best
    score wins, ties by taxonomy order; confidence = hits / topic words. No
    shared word -> ``Classification Failed``; subject without topics ->
    ``Topic classification not available for this subject``.

    The subject -> topics table is broadcast (fixed size); scoring is an
    in-row array expression, so there is no shuffle of the questions at all.
    """
    spark = questions.sparkSession
    tax = F.broadcast(subject_topic_arrays(spark).withColumnRenamed("subject", "_subject"))
    q = questions.join(tax, F.col(subject) == F.col("_subject"), "left").withColumn("_qw", words(F.col(text)))
    scored = F.transform(
        "topics",
        lambda t: F.struct(
            F.size(F.array_intersect(t["words"], F.col("_qw"))).alias("hits"),
            (-t["topic_ord"]).alias("neg_ord"),
            t["topic"].alias("topic"),
            F.size(t["words"]).alias("n_words"),
        ),
    )
    q = q.withColumn("_best", F.array_max(scored))
    best = F.col("_best")
    topic = (
        F.when(F.col("topics").isNull(), F.lit(NOT_AVAILABLE))
        .when(best["hits"] > 0, best["topic"])
        .otherwise(F.lit(FAILED))
    )
    conf = F.when(F.col("topics").isNotNull() & (best["hits"] > 0),
                  best["hits"].cast("double") / best["n_words"].cast("double")).otherwise(F.lit(0.0))
    return q.withColumns({"topic": topic, "confidence": conf}).drop("_subject", "topics", "_qw", "_best")


def topic_batches(questions: DataFrame, key: str = "subject", order: str = "row_id",
                  size: int = BATCH_SIZE, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Number questions per subject in order and cut them into batches of
    ``size`` (batch = ceil(rank / size)); skew-safe numbering, no global window."""
    d = number_rows(questions, [key], order, "q_rank", block)
    return d.withColumn("batch_no", (F.floor((F.col("q_rank") - 1) / F.lit(size)) + 1).cast("bigint"))


def topic_requests(questions: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """R2: one request per (subject, batch) with the question lines in order and
    the subject's topic list; at most ``size`` lines per row by construction."""
    spark = questions.sparkSession
    b = topic_batches(questions, size=size)
    line = F.concat(F.lit("- Question No: "), F.col("question_no"), F.lit(", Question: "), F.col("question"))
    req = b.groupBy("subject", "batch_no").agg(
        F.array_sort(F.collect_list(F.struct("q_rank", line.alias("line")))).alias("_l"),
        F.count(F.lit(1)).alias("n_questions"),
    )
    req = req.withColumn("questions_text", F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).drop("_l")
    tl = F.broadcast(
        taxonomy(spark).groupBy("subject").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_ord", "topic"))),
                                     lambda x: x["topic"]), ", ").alias("topic_list")
        )
    )
    return req.join(tl, "subject", "left")


def merge_topics_fanout(questions: DataFrame, results: DataFrame, key: str = "question_no") -> DataFrame:
    """Left merge of questions with topic replies on the number; a number
    repeated in the replies fans out (as the reference's merge does)."""
    r = results.select(F.col(key).alias("_rk"), "topic", "confidence")
    return questions.join(r, questions[key] == r["_rk"], "left").drop("_rk")


def lookup_topics_first(questions: DataFrame, results: DataFrame, key: str = "question_no") -> DataFrame:
    """First reply per number (by reply order), with its explanation passed
    through, or the fallback ``Classification Failed`` / 0 / ``No matching
    question number found``. A reply of a failed batch (``batch_ok`` false) gives
    ``Classification Failed`` / 0 / ``API error occurred``."""
    ok = F.coalesce(F.col("batch_ok"), F.lit(True))
    reply = F.struct(
        F.when(ok, F.col("topic")).otherwise(F.lit(FAILED)).alias("topic"),
        F.when(ok, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(ok, F.coalesce("explanation", F.lit(""))).otherwise(F.lit(API_ERROR)).alias("explanation"),
    )
    first = results.groupBy(F.col(key).alias("_rk")).agg(F.min_by(reply, F.col("result_ord")).alias("_r"))
    j = questions.join(first, questions[key] == first["_rk"], "left")
    return j.select(
        *questions.columns,
        F.coalesce(F.col("_r.topic"), F.lit(FAILED)).alias("topic"),
        F.coalesce(F.col("_r.confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("_r.explanation"), F.lit(NO_MATCH)).alias("explanation"),
    )


def settle_topic_requests(batches: DataFrame, statuses: DataFrame, replies: DataFrame,
                          keys: tuple[str, ...] = ("subject", "batch_no"), number: str = "question_no") -> DataFrame:
    """E2 through the request ledger: every question of a request gets its outcome.

    ``batches`` are the questions with the request they were sent in (G6),
    ``statuses`` one row per request (``keys``, ``ok``), ``replies`` the reply rows
    (``keys``, ``result_ord``, number, topic, confidence, explanation). A question
    of an answered request gets the first reply of that request with its number,
    or ``No matching question number found``. Every question of a failed request,
    or of one without a status, gets ``API error occurred``: such a request has no
    reply rows, so this follows from the request, not from the replies.
    Null keys match null keys.
    """
    k = list(keys)
    answered = statuses.groupBy(*k).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("_ok"))
    reply = F.struct("topic", "confidence", F.coalesce("explanation", F.lit("")).alias("explanation"))
    first = replies.groupBy(*k, number).agg(F.min_by(reply, F.col("result_ord")).alias("_r"))
    d = join_keys(batches, answered, k, "left")
    d = join_keys(d, first, [*k, number], "left")
    ok, found = F.coalesce("_ok", F.lit(False)), F.col("_r").isNotNull()
    return d.select(
        *batches.columns,
        F.when(ok & found, F.col("_r.topic")).otherwise(F.lit(FAILED)).alias("topic"),
        F.when(ok & found, F.col("_r.confidence")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(~ok, F.lit(API_ERROR)).when(found, F.col("_r.explanation")).otherwise(F.lit(NO_MATCH)).alias("explanation"),
    )


def topic_statistics(assigned: DataFrame) -> DataFrame:
    """questions per topic and their share of all questions (2 decimals,
    half-even). The total is a one-row aggregate, joined to the counts."""
    per = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("question_count")).withColumn("_g", F.lit(0))
    total = F.broadcast(assigned.agg(F.count(F.lit(1)).alias("_total")).withColumn("_g", F.lit(0)))
    share = percent_value("question_count", "_total", 2).alias("percentage")
    return per.join(total, "_g").select("topic", "question_count", share)
