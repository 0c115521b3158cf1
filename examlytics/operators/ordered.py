"""Ordered, keyed scans that stay balanced when one key is huge.

A plain ``Window.partitionBy(key).orderBy(o)`` sends every row of a key to one
task; if one scan (or file, or subject) holds a third of the data, that task does
a third of the work. These operators split each key into fixed-size blocks of
the order column, run the window inside a block (bounded work per task), and
bring in what comes before the block from a summary with one row per (key,
block). The summary is a map-side combined aggregate over the input (a second,
column-pruned read of it; no row of it is shuffled or sorted by the key), and it
is scanned in blocks of blocks in turn, ``LEVELS`` deep. Results are exact: no
row is dropped, capped or sampled. Null keys are a key of their own.

The block column is computed from the order value, so ``order`` must be an
integral column (page number, row id, row ordinal).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 4096
#: Blocks, blocks of blocks, ...: the last scan of one key sees rows / block ** LEVELS rows.
LEVELS = 3

BEFORE = (Window.unboundedPreceding, -1)


def _blk(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block)).cast("bigint")


def _null_free(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a value and a null flag per key, so that plain equality matches null keys too."""
    types = dict(df.dtypes)
    cols = {}
    for i, k in enumerate(keys):
        empty = F.lit("") if types[k] == "string" else F.lit(0).cast(types[k])
        cols |= {f"_k{i}": F.coalesce(F.col(k), empty), f"_n{i}": F.col(k).isNull()}
    return df.withColumns(cols), list(cols)


def _join_blocks(d: DataFrame, summ: DataFrame, keys: list[str], blk: str) -> DataFrame:
    """Left-join per-block values back on (keys, block).

    The summary is re-grouped on (keys, block) so Catalyst knows it has one row
    per key: when a caller never uses the carried column, the optimizer then
    removes this join (and the whole summary branch) instead of computing it.
    """
    cols = [c for c in summ.columns if c not in (*keys, blk)]
    s2 = summ.groupBy(*keys, blk).agg(*[F.max(c).alias(c) for c in cols])
    return d.join(s2, on=[*keys, blk], how="left")


def _last_value(value: str, order: str) -> Column:
    """The non-null value with the largest order; null if there is none."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def _last_before(summ: DataFrame, keys: list[str], block: int, levels: int) -> DataFrame:
    """``_prev`` = last non-null ``_v`` of the earlier blocks (``_o``) of each key."""
    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy("_o").rowsBetween(*BEFORE)
        return summ.select(*keys, "_o", F.last("_v", ignorenulls=True).over(w).alias("_prev"))
    d = summ.withColumn("_b", _blk("_o", block))
    upper = d.groupBy(*keys, "_b").agg(_last_value("_v", "_o").alias("_v")).withColumnRenamed("_b", "_o")
    upper = _last_before(upper, keys, block, levels - 1).select(*keys, F.col("_o").alias("_b"), F.col("_prev").alias("_up"))
    w = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(*BEFORE)
    inside = d.select(*keys, "_o", "_b", F.last("_v", ignorenulls=True).over(w).alias("_in"))
    out = inside.join(upper, [*keys, "_b"], "left")
    return out.select(*keys, "_o", F.coalesce("_in", "_up").alias("_prev"))


def _sum_before(summ: DataFrame, keys: list[str], block: int, levels: int) -> DataFrame:
    """``_off`` = sum of ``_v`` over the earlier blocks (``_o``) of each key."""
    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy("_o").rowsBetween(*BEFORE)
        return summ.select(*keys, "_o", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_off"))
    d = summ.withColumn("_b", _blk("_o", block))
    upper = d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_v")).withColumnRenamed("_b", "_o")
    upper = _sum_before(upper, keys, block, levels - 1).select(*keys, F.col("_o").alias("_b"), F.col("_off").alias("_up"))
    w = Window.partitionBy(*keys, "_b").orderBy("_o").rowsBetween(*BEFORE)
    inside = d.select(*keys, "_o", "_b", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_in"))
    # a left join: an inner one filters its keys for nulls in one branch only, and the levels no longer share an exchange
    out = inside.join(upper, [*keys, "_b"], "left")
    return out.select(*keys, "_o", (F.col("_in") + F.coalesce("_up", F.lit(0))).alias("_off"))


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str,
    block: int = DEFAULT_BLOCK,
    levels: int = LEVELS,
) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row, per ``keys`` in ``order``.

    Equivalent to ``last(value, ignorenulls=True)`` over
    ``partitionBy(keys).orderBy(order).rowsBetween(unboundedPreceding, 0)``.
    One shuffle of the rows, by (keys, block); the summary is aggregated map-side
    to one row per (keys, block), and its levels reuse that one exchange.
    """
    d, ks = _null_free(df, keys)
    d = d.withColumn("_blk", _blk(order, block))
    summ = d.groupBy(*ks, "_blk").agg(_last_value(value, order).alias("_v")).withColumnRenamed("_blk", "_o")
    summ = _last_before(summ, ks, block, levels - 1).withColumnRenamed("_o", "_blk")
    w = Window.partitionBy(*ks, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.last(value, ignorenulls=True).over(w))
    return _join_blocks(d, summ, ks, "_blk").withColumn(out, F.coalesce("_in", "_prev")).drop(*ks, "_blk", "_in", "_prev")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    block: int = DEFAULT_BLOCK,
    levels: int = LEVELS,
) -> DataFrame:
    """``out`` = 1-based ``row_number()`` per ``keys`` in ``order`` (order must be unique per key)."""
    d, ks = _null_free(df, keys)
    d = d.withColumn("_blk", _blk(order, block))
    counts = d.groupBy(*ks, "_blk").agg(F.count(F.lit(1)).alias("_v")).withColumnRenamed("_blk", "_o")
    offs = _sum_before(counts, ks, block, levels - 1).withColumnRenamed("_o", "_blk")
    d = d.withColumn("_rn", F.row_number().over(Window.partitionBy(*ks, "_blk").orderBy(order)))
    return _join_blocks(d, offs, ks, "_blk").withColumn(out, (F.col("_rn") + F.col("_off")).cast("bigint")).drop(*ks, "_blk", "_rn", "_off")
