"""Sharding by sampled splitters (operator 8), DataFrame functions only.

Records get an ordering key: CRC-32 of the text, then a hash of the id, so equal
texts lie side by side and a large group of copies can still be cut anywhere.

1. A key sample is drawn with probability proportional to record size; its
   quantiles are the range boundaries.
2. Bytes and rows per range are counted; ranges over twice their share are
   subdivided by boundaries sampled inside them.
3. A running sum of bytes inside each range, on top of the bytes of the ranges
   before it, places every record on the line of all bytes; equal parts of that
   line are the shards.
4. Where a group of equal texts of at most ``TOGETHER`` of a shard lies over the end
   of a part, the end moves to the group's nearer end, so the group stays in one
   shard. Larger groups are cut, as sizes would no longer be near equal: a shard
   differs from its equal part by half a record or half such a group at each end.

A range holds about ``RANGE_BYTES``, so the number of ranges and of collected
boundaries grows as bytes / RANGE_BYTES (100 TB: 400,000 boundaries, 3 MB) and
no window is larger than a range, also for a hot source or group of copies.

Defined cases: a null text has the CRC of an empty text and size 16; a null id is
ordered as its hash; identical rows get different slots; an empty table gives
no rows; every other column is carried along, names that clash are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlytics.llm.common import stored

N_SHARDS = 40
RANGE_BYTES = 256 << 20
#: Ranges per shard at least, and sampled keys per range.
RANGES_PER_SHARD = 16
SAMPLES = 16
OVERFULL = 2.0
#: Groups of equal texts up to this share of a shard are never cut.
TOGETHER = 0.05


@dataclass
class Splitters:
    """Sorted range boundaries with the bytes and rows before each range, and of all."""

    bounds: list[int]
    bytes_before: list[int]
    rows_before: list[int]
    total: int


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__size``, ``__crc`` and the ordering key ``__key``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    x = docs.withColumn("__size", F.octet_length(text).cast("long") + 16).withColumn("__crc", F.crc32(text))
    low = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    return x.withColumn("__key", F.shiftleft("__crc", 30) + low)


def _literal(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below the key, by two lookups of about sqrt(n) each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(_literal(bounds[::step]), lambda b: b <= key))
    part = F.slice(_literal(bounds), F.greatest(coarse - 1, F.lit(0)) * step + 1, step)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(part, lambda b: b <= key)))


def _sampled_bounds(keyed: DataFrame, total: int, n_ranges: int, seed: int) -> list[int]:
    """Quantiles of a size-weighted key sample; its expected size is SAMPLES * n_ranges."""
    draw = F.pmod(F.xxhash64("__key", "__size", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = SAMPLES * n_ranges / max(total, 1)
    keys = sorted(r[0] for r in keyed.where(draw < F.col("__size") * rate).select("__key").toLocalIterator())
    return sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []


def splitters(keyed: DataFrame, n_shards: int = N_SHARDS, range_bytes: int = RANGE_BYTES, max_rounds: int = 4) -> Splitters:
    """Boundaries for ``keyed`` (``__key``, ``__size``), overfull ranges subdivided."""
    total, rows = keyed.agg(F.coalesce(F.sum("__size"), F.lit(0)), F.count("*")).first()
    n_ranges = max(n_shards * RANGES_PER_SHARD, -(-total // range_bytes))
    bounds = _sampled_bounds(keyed, total, n_ranges, 1)
    share = total / n_ranges
    for round_no in range(max_rounds + 1):
        got = keyed.groupBy(range_of(F.col("__key"), bounds).alias("r")).agg(
            F.sum("__size").alias("b"), F.count("*").alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi")
        )
        per = {r["r"]: r for r in got.collect()}
        over = [r for r in per.values() if r["b"] > OVERFULL * share and r["lo"] < r["hi"]]
        if not over or round_no == max_rounds:
            break
        inside = keyed.where(range_of(F.col("__key"), bounds).isin([r["r"] for r in over]))
        size = sum(r["b"] for r in over)
        more = _sampled_bounds(inside, size, max(2 * len(over), int(2 * size / share)), 2 + round_no)
        bounds = sorted({*bounds, *more, *(r["lo"] + 1 for r in over)})
    b_before, n_before, b, n = [], [], 0, 0
    for r in range(len(bounds) + 1):
        b_before.append(b)
        n_before.append(n)
        if r in per:
            b, n = b + per[r]["b"], n + per[r]["n"]
    return Splitters(bounds, b_before, n_before, total)


def place(keyed: DataFrame, sp: Splitters, id_col: str = "doc_id") -> DataFrame:
    """``keyed`` with the record's byte and number on the line of all records, ``__before`` and ``__at``."""
    x = keyed.withColumn("__range", range_of(F.col("__key"), sp.bounds))
    order = Window.partitionBy("__range").orderBy("__key", "__crc", id_col, "__size")
    x = x.withColumn("__sum", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__n", F.row_number().over(order))
    before = F.element_at(_literal(sp.bytes_before), F.col("__range") + 1) + F.col("__sum") - F.col("__size")
    at = F.element_at(_literal(sp.rows_before), F.col("__range") + 1) + F.col("__n") - 1
    return x.withColumn("__before", before).withColumn("__at", at)


def shard_ends(placed: DataFrame, total: int, n_shards: int = N_SHARDS) -> list[int]:
    """Doubled byte positions where the shards 1, 2, ... begin; at most one group a shard end reaches the driver."""
    end = F.col("__before") + F.col("__size")
    part = lambda at: F.floor(at * n_shards / F.lit(max(total, 1)))
    groups = placed.groupBy("__crc").agg(F.min("__before").alias("a"), F.max(end).alias("b"))
    groups = groups.where((part(F.col("a")) != part(F.col("b"))) & ((F.col("b") - F.col("a")) * n_shards <= TOGETHER * total))
    ends = [2 * s * total // n_shards for s in range(1, n_shards)]
    for r in groups.collect():
        for i, e in enumerate(ends):
            if 2 * r["a"] < e < 2 * r["b"]:
                ends[i] = 2 * (r["a"] if e - 2 * r["a"] <= 2 * r["b"] - e else r["b"])
    return ends


def shard_of(ends: list[int]) -> Column:
    """The shard of a record: the part of the line that its middle lies in."""
    return range_of(2 * F.col("__before") + F.col("__size"), ends).cast("int")


def first_rows(placed: DataFrame, ends: list[int]) -> list[int]:
    """The number of the first record of every shard."""
    got = {r[0]: r[1] for r in placed.groupBy(shard_of(ends)).agg(F.min("__at")).collect()}
    out, following = [], 0
    for s in reversed(range(len(ends) + 1)):
        following = got.get(s, following)
        out.append(following)
    return out[::-1]


def _sharded(placed: DataFrame, ends: list[int], first: list[int]) -> DataFrame:
    slot = F.col("__at") - F.element_at(_literal(first), F.col("__shard") + 1)
    return placed.withColumn("__shard", shard_of(ends)).withColumn("__slot", slot.cast("long"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``, ranges kept together.

    The boundaries come from a written narrow table; texts are shuffled once.
    """
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    keyed = with_key(docs, id_col, text_col)
    narrow = stored(keyed.select(id_col, "__size", "__crc", "__key"), "shard-keys")
    sp = splitters(narrow, n_shards)
    placed = stored(place(narrow, sp, id_col).select("__crc", "__size", "__before", "__at"), "shard-places")
    ends = shard_ends(placed, sp.total, n_shards)
    return _sharded(place(keyed, sp, id_col), ends, first_rows(placed, ends)).select(
        *docs.columns, F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op8_sharding: shard and slot of every row of ``documents`` by the law ``bytes``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keyed = with_key(docs).select("doc_id", "__size", "__crc", "__key")
    narrow = stored(keyed, "shard-keys")
    sp = splitters(narrow)
    placed = stored(place(narrow, sp).select("doc_id", "__crc", "__size", "__before", "__at"), "shard-places")
    ends = shard_ends(placed, sp.total)
    return _sharded(placed, ends, first_rows(placed, ends)).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
