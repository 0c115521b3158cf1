"""The query catalog against its DuckDB oracle (the driver's correctness gate,
run locally at the smallest scale) plus cross-query properties."""

import math

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as E
from examlytics.plans.oracle import ORACLE
from examlytics.plans.queries import QUERIES
from examlytics.session import TABLES


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(round(v, 9)))
    if isinstance(v, (bytes, bytearray)):
        return (1, bytes(v).hex())
    return (1, str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sub_question_no" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMALL)
    scols = sdf.columns
    srows = sorted(tuple(_norm(v) for v in r) for r in sdf.collect())
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    idx = [dcols.index(c) for c in scols]
    drows = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert srows == drows


def test_attempts_add_up(spark):
    from pyspark.sql import functions as F

    qa = QUERIES["question_analysis"](spark, SMALL)
    rows = QUERIES["clean_transcription"](spark, SMALL).where(F.col("question_no").isNotNull())
    assert qa.agg(F.sum("attempts")).first()[0] == rows.count()
    assert qa.where(F.col("correct_answers") > F.col("attempts")).count() == 0


def test_rejects_plus_accepted_equal_pages(spark):
    from examlytics.sources import fixtures as X

    key = ["scan_id", "page_no"]
    pages = X.raw_responses(spark, SMALL).select(*key)
    parts = [QUERIES[q](spark, SMALL).select(*key) for q in ("response_rejects", "page_placeholders")]
    parts.append(QUERIES["response_ingest"](spark, SMALL).select(*key).distinct())
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    assert every.count() == every.distinct().count() == pages.count()
    assert every.exceptAll(pages).isEmpty()
