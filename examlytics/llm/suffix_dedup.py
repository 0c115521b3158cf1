"""Exact repeated-passage removal with a logarithmic family of suffix indexes (operator 4).

Every byte covered by a ``length``-byte string that also starts anywhere else
(same document included) is removed. Matches never cross documents.

A full suffix array of the corpus would move many times its size. The index
holds a sparse one: suffixes start at anchors that the content itself picks, so
equal strings have equal anchors. For each window of ``length`` bytes the anchor
is the position of its smallest ``GRAM``-byte hash (leftmost on ties); windows
side by side that share an anchor form a region. Equal windows have the same
anchor offset, hence belong to regions of the same anchor string.

* A batch's suffix array is its regions sorted by (anchor string, region
  string), with the number of occurrences: a run.
* A new run is merge-scanned against itself and the existing levels on the
  anchor string; anchor strings met twice are candidates for long matches.
* Runs of equal rank merge into one of the next rank, so n batches leave at most
  log2(n) + 1 levels, and a suffix is rewritten log2(n) times.

Candidates are then settled exactly: a region string that occurs twice repeats
with all its windows; the different regions of one anchor string are compared
window by window where the anchor's regions meet. Strings are compared by two independent 64-bit
hashes, about 2e-16 false matches at 1e11 windows.

Defined cases: a null text is empty; a text shorter than ``length`` has no
window and keeps its bytes; repeated rows are documents of their own (each
repeats the other); a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlytics.llm.common import drop_stored, mix, pieces, prefix_hash, release, signed, span_hash, stored

LENGTH = 200
GRAM = 32
#: Batches that one call to ``remove_repeats`` adds to the index.
BATCHES = 4
#: An anchor string with more different regions is crowded: its windows are dealt out one by one.
CROWD = 10_000


# ------------------------------------------------------------------ regions of a piece


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for every i, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
    return x


def regions(data: np.ndarray, offs: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Regions of all texts of a piece: row, first window, number of windows, hashes.

    ``gram`` is the hash of the anchor string; ``r1``, ``r2`` those of the whole
    region with the anchor's place in it.
    """
    p1, p2 = prefix_hash(data, 0), prefix_hash(data, 1)
    n, k = len(data), GRAM
    empty = {c: np.empty(0, np.int64) for c in ("row", "first", "windows", "gram", "r1", "r2", "at")}
    sizes = np.diff(offs)
    if n < length or not (sizes >= length).any():
        return empty
    at = np.arange(n - k + 1)
    gram = mix(span_hash(p1, at, at + k))
    # rank by the upper 32 bits, then the leftmost place
    rank = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    best = (sliding_min(rank, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows that lie in one text
    start = np.arange(n - length + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)[: n - length + 1]
    inside = start + length <= offs[row + 1]
    start, best, row = start[inside], best[inside], row[inside]
    head = np.empty(len(start), bool)
    head[0] = True
    np.logical_or(best[1:] != best[:-1], row[1:] != row[:-1], out=head[1:])
    f = np.flatnonzero(head)
    windows = np.diff(np.append(f, len(start)))
    first, anchor = start[f], best[f]
    end = first + windows - 1 + length
    place = (anchor - first).astype(np.uint64) * np.uint64(1 << 32) + windows.astype(np.uint64)
    return {
        "row": row[f],
        "first": first - offs[row[f]],
        "windows": windows,
        "gram": gram[anchor],
        "r1": mix(span_hash(p1, first, end) + mix(place)),
        "r2": mix(span_hash(p2, first, end, 1) + mix(place + np.uint64(1))),
        "at": first,
    }


def _regions(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in pieces(batch, "__text"):
                r = regions(data, offs, length)
                rows = pa.array(r["row"].astype(np.int64))
                uid, crc = (batch.column(c).slice(a, b - a).take(rows) for c in ("uid", "crc"))
                yield pa.RecordBatch.from_arrays(
                    [uid, crc, pa.array(r["first"].astype(np.int32)), pa.array(r["windows"].astype(np.int32)), signed(r["gram"]), signed(r["r1"]), signed(r["r2"])],
                    names=["uid", "crc", "first", "windows", "gram", "r1", "r2"],
                )

    return run


REGION = "uid long, crc int, first int, windows int, gram long, r1 long, r2 long"


# ------------------------------------------------------------------ the index


class SuffixIndex:
    """The family of levels. ``add`` indexes a batch of regions and returns its candidate anchor strings.

    A level is a written table (gram, r1, r2, n) sorted within its partitions;
    ``levels`` holds (rank, table). The batch side of the merge-scan and the
    levels are joined on the anchor string, so neither side is broadcast or
    gathered.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []

    @staticmethod
    def _run(parts: DataFrame) -> DataFrame:
        x = parts.groupBy("gram", "r1", "r2").agg(F.sum("n").alias("n"))
        return stored(x.sortWithinPartitions("gram", "r1", "r2"), "suffix-run")

    def add(self, batch: DataFrame) -> DataFrame:
        run = self._run(batch.select("gram", "r1", "r2", F.lit(1).cast("long").alias("n")))
        grams = run.groupBy("gram").agg(F.sum("n").alias("n"))
        hits = grams.where("n > 1").select("gram")
        for _, level in self.levels:
            hits = hits.unionByName(grams.select("gram").join(level.select("gram"), "gram", "left_semi"))
        hits = stored(hits.distinct(), "suffix-hits")
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            merged = self._run(level.unionByName(run))
            drop_stored(level)
            drop_stored(run)
            run, rank = merged, rank + 1
        self.levels.append((rank, run))
        return hits

    def drop(self) -> None:
        """Delete the levels' tables."""
        for _, level in self.levels:
            drop_stored(level)
        self.levels = []

    def regions(self) -> DataFrame:
        """All indexed regions with their numbers of occurrences."""
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out if len(self.levels) == 1 else out.groupBy("gram", "r1", "r2").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ windows of open regions


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the open regions of documents (``open``: gram, first, windows, crowded)."""
        for batch in batches:
            spans = batch.column("open").to_pylist()
            texts = batch.column("__text")
            out: list[tuple] = []
            for i, regions_ in enumerate(spans):
                raw = (texts[i].as_py() or "").encode()
                for s in regions_:
                    out.append((i, s["gram"], s["first"], s["windows"], s["crowded"], raw[s["first"] : s["first"] + s["windows"] - 1 + length]))
            if out:
                row, gram, first, windows, crowded, raw = (list(x) for x in zip(*out))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").take(row),
                        batch.column("crc").take(row),
                        pa.array(gram, pa.int64()),
                        pa.array(first, pa.int32()),
                        pa.array(windows, pa.int32()),
                        pa.array(crowded, pa.bool_()),
                        pa.array(raw, pa.binary()),
                    ],
                    names=["uid", "crc", "gram", "first", "windows", "crowded", "raw"],
                )

    return run


CONTEXT = "uid long, crc int, gram long, first int, windows int, crowded boolean, raw binary"


def window_hashes(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, w1, w2) of every window of the regions of a batch."""
    raw = [x.as_buffer() for x in batch.column("raw")]
    data = np.frombuffer(b"".join(raw), np.uint8)
    windows = np.asarray(batch.column("windows")).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(windows + length - 1)])[:-1]
    row = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = base[row] + within
    p1, p2 = prefix_hash(data, 0), prefix_hash(data, 1)
    first = np.asarray(batch.column("first")).astype(np.int64)[row] + within
    return row, first, mix(span_hash(p1, at, at + length)), mix(span_hash(p2, at, at + length, 1))


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per window, for crowded anchors."""
        for batch in batches:
            for s in range(0, batch.num_rows, 2000):
                part = batch.slice(s, 2000)
                row, first, w1, w2 = window_hashes(part, length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid").take(at), part.column("crc").take(at), pa.array(first.astype(np.int32)), signed(w1), signed(w2)],
                    names=["uid", "crc", "first", "w1", "w2"],
                )

    return run


def _repeats(length: int):
    """Byte ranges covered by windows that occur in two regions of an anchor string; rows come sorted by ``gram``."""

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        row, first, w1, w2 = window_hashes(batch, length)
        order = np.lexsort((w2, w1))
        a, b = w1[order], w2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        hit = np.zeros(len(row), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        row, first = row[hit], first[hit]
        # windows side by side are one range
        head = np.ones(len(row), bool)
        head[1:] = (row[1:] != row[:-1]) | (first[1:] != first[:-1] + 1)
        h = np.flatnonzero(head)
        last = np.append(h[1:], len(row)) - 1
        at = pa.array(row[h])
        return pa.RecordBatch.from_arrays(
            [batch.column("uid").take(at), batch.column("crc").take(at), pa.array(first[h].astype(np.int32)), pa.array((first[last] + length).astype(np.int32))],
            names=["uid", "crc", "s", "e"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                gram = np.asarray(batch.column("gram"))
                ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
                n = sum(x.num_rows for x in held)
                if n >= 4096 and held[-1].column("gram")[-1].as_py() != gram[0]:
                    yield spans(held)
                    held, n = [], 0
                # take whole anchors until 4096 rows are there; the last anchor may go on in the next batch
                fit = ends[:-1][ends[:-1] + n >= 4096]
                cut = int(fit[0]) if len(fit) else len(gram)
                held.append(batch.slice(0, cut))
                batch = batch.slice(cut)
        if held:
            yield spans(held)

    return run


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of byte ranges [s, e), sorted and disjoint."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        texts, spans = batch.column("__text"), batch.column("spans")
        total, gone, runs, digest, kept = [], [], [], [], []
        for i in range(n):
            raw = texts[i].as_py()
            raw = raw.encode() if raw else b""
            cut = merged_spans([(x["s"], x["e"]) for x in spans[i].as_py() or []])
            h, at = hashlib.sha256(), 0
            for s, e in [*cut, (len(raw), len(raw))]:
                h.update(raw[at:s])
                at = e
            total.append(len(raw))
            gone.append(sum(e - s for s, e in cut))
            runs.append(len(cut))
            digest.append(h.hexdigest())
            kept.append([{"s": s, "e": e} for s, e in cut])
        span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, span)],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


CUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<s:int,e:int>>"


# ------------------------------------------------------------------ plan


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """``uid, crc, s, e``: byte ranges of ``docs`` (``uid, crc, __text``) covered by repeated strings, not merged."""
    found = docs.mapInArrow(_regions(length), REGION).withColumn("batch", F.pmod(F.xxhash64("uid"), F.lit(batches)).cast("int"))
    all_regions = stored(found, "regions", "batch")
    index = SuffixIndex(docs.sparkSession)
    hits = [index.add(all_regions.where(F.col("batch") == b)) for b in range(batches)]
    candidates = hits[0]
    for h in hits[1:]:
        candidates = candidates.unionByName(h)
    known = index.regions().join(candidates.distinct(), "gram", "left_semi")
    # whole: the region string occurs twice, all its windows repeat; open: its anchor string has other regions too
    shapes = known.groupBy("gram").agg(F.count("*").alias("shapes")).where("shapes > 1")
    known = known.join(shapes, "gram", "left").where("n > 1 or shapes is not null")
    known = stored(known.select("r1", "r2", (F.col("n") > 1).alias("whole"), F.col("shapes").isNotNull().alias("open"), (F.coalesce("shapes", F.lit(0)) > CROWD).alias("crowded")), "repeated-regions")
    index.drop()
    release(docs.sparkSession)
    x = stored(all_regions.drop("batch").join(known, ["r1", "r2"]), "region-status")
    drop_stored(all_regions)
    release(docs.sparkSession)
    whole = x.where("whole").select("uid", "crc", F.col("first").alias("s"), (F.col("first") + F.col("windows") - 1 + length).alias("e"))
    # of open regions, one occurrence of each string is compared window by window with its anchor's others
    place = F.struct("uid", "crc", "gram", "first", "windows", "crowded")
    rep = x.where("open").groupBy("r1", "r2").agg(F.min(place).alias("x")).select("x.*")
    per_doc = rep.groupBy("uid", "crc").agg(F.collect_list(F.struct("gram", "first", "windows", "crowded")).alias("open"))
    ctx = stored(docs.join(per_doc, ["uid", "crc"]).mapInArrow(_contexts(length), CONTEXT), "open-regions")
    release(docs.sparkSession)
    near = ctx.where("not crowded").repartition("gram").sortWithinPartitions("gram").mapInArrow(_repeats(length), "uid long, crc int, s int, e int")
    windows = ctx.where("crowded").mapInArrow(_windows(length), "uid long, crc int, first int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    far = windows.join(twice, ["w1", "w2"], "left_semi").select("uid", "crc", F.col("first").alias("s"), (F.col("first") + length).alias("e"))
    return whole.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, removed`` (byte spans) for every row of ``docs``.

    A row is known by its id and the CRC of its text (a null id: by a hash of the
    text), so rows that repeat an id keep apart and identical rows share spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(
        F.col(id_col).cast("long").alias("__id"),
        text.alias("__text"),
        F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("uid"),
        (F.crc32(text) - 2147483648).cast("int").alias("crc"),
    )
    spans = repeated_spans(src.select("uid", "crc", "__text"), length, batches)
    per_doc = spans.groupBy("uid", "crc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return src.join(per_doc, ["uid", "crc"], "left").select("__id", "__text", "spans").mapInArrow(_cut, CUT)


def query(spark, sf_dir: str) -> DataFrame:
    """op4_suffix_dedup: bytes of ``documents`` that repeat a 200-byte string."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
