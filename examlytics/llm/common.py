"""Helpers shared by the operators: shared scratch tables, byte kernels, components.

The byte kernels work on the UTF-8 buffer of an Arrow string column, a few
megabytes at a time, so a task's memory does not depend on the batch size.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlytics.session import ensure_checkpoint_dir

#: Bytes of text handled at once by the byte kernels.
PIECE_BYTES = 1 << 21

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value per byte, two independent lanes.
BYTE_VALUES = _RNG.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in BASES)

#: Separators of words: space and \x09-\x0D.
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# ------------------------------------------------------------------ tables


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, in the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: later jobs read files that survive a lost executor.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored``: its own scratch folder and nothing else."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark removes them once the driver has collected their plans as garbage,
    which a driver with free memory may put off until the job's end.
    """
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Hand the free memory of this process back to the machine.

    Workers are reused: without this, one keeps what its largest task so far took,
    beside the memory of all that run after it.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library than glibc


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, in a worker trimmed before and after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return task


# ------------------------------------------------------------------ pieces of an Arrow column


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``a:b`` of a string column as (a, b, bytes, offsets), about ``limit`` bytes each.

    Nulls are empty texts. A text longer than ``limit`` is a piece of its own.
    """
    col = batch.column(column)
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


class Cache(dict):
    """Filled by each process for itself: it travels empty with the functions that use it."""

    def __reduce__(self):
        return Cache, ()


_POWERS = Cache()


def powers(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a lane's base (or its inverse) modulo 2^64."""
    have = _POWERS.get((lane, inverse))
    if have is None or len(have) < n:
        size = max(n, PIECE_BYTES + 1024)
        have = np.full(size, (INVERSES if inverse else BASES)[lane], dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[(lane, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray, lane: int = 0) -> np.ndarray:
    """P with P[j] - P[i] = B^i * hash(data[i:j]), modulo 2^64."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    vals = BYTE_VALUES[lane][data]
    vals *= powers(lane, len(data))
    np.add.accumulate(vals, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of data[start:end] from a prefix hash; equal bytes, equal hash. Not mixed."""
    return (prefix[end] - prefix[start]) * powers(lane, len(prefix), inverse=True)[start]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    n = len(data)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    w = IS_WORD[data]
    first = np.empty(n, bool)
    first[0] = w[0]
    np.logical_and(w[1:], ~w[:-1], out=first[1:])
    last = np.empty(n, bool)
    last[-1] = w[-1]
    np.logical_and(w[:-1], ~w[1:], out=last[:-1])
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    return start, end, row


def row_counts(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Items per row and the first item of each row (items are in row order)."""
    n = np.bincount(row, minlength=n_rows).astype(np.int64)
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum(n, out=first[1:])
    return n, first


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word (mixed)."""
    return mix(span_hash(prefix_hash(data), start, end))


def shingle_hashes(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of a row, and their rows.

    A row with 1 to k-1 words gives its whole word sequence as one shingle; a
    row without words gives none.
    """
    n, first = row_counts(row, n_rows)
    c = np.uint64(0xA0761D6478BD642F)
    m = len(words) - k + 1
    if m > 0:
        h = words[:m] * c
        for j in range(1, k):
            h = (h ^ words[j : j + m]) * c
            h ^= h >> np.uint64(29)
        full = row[:m] == row[k - 1 :]
        h, r = mix(h[full]), row[:m][full]
    else:
        h, r = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        s = np.empty(len(short), np.uint64)
        for i, x in enumerate(short):
            v = np.uint64(n[x])
            for w in words[first[x] : first[x + 1]]:
                v = mix(np.array([v ^ w]) * c)[0]
            s[i] = v
        h, r = np.concatenate([h, s]), np.concatenate([r, short])
        by = np.argsort(r, kind="stable")
        h, r = h[by], r[by]
    return h, r


def signed(x: np.ndarray) -> pa.Array:
    """uint64 hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ------------------------------------------------------------------ connected components


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of ``links`` (a, b).

    Alternates two joins-free regroupings: every node sends its larger
    neighbours to its smallest one, then its smaller neighbours (and itself)
    to the smallest. Links only ever shrink; each round is a written table.
    Groups are reduced by ``min`` with map-side partial sums, so a node with
    very many neighbours is never gathered in one row.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "links")
    last = None
    for _ in range(max_rounds):
        # larger neighbours of u go to the smallest neighbour of u
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # smaller neighbours of u go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        mark = small.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")
        ).first()
        drop_stored(edges)
        edges = small
        if tuple(mark) == last and mark[0] == mark[2]:
            break
        last = tuple(mark)
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
