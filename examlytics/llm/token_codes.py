"""Token ids in files of directly addressable codes (operator 13).

Every id is split into chunks of bits. Level 0 holds the lowest chunk of all ids;
its continuation bitmap marks the ids that have more, and only those have an
entry on the next level. A rank directory over each bitmap (set bits before every
512th bit) gives an entry's place on the next level, so any token is read from
one chunk per level, and any run of tokens from one contiguous run per level;
no block is decoded. Chunk widths are chosen for each file: the split with the
fewest bits, by dynamic programming over how many ids need more than k bits.

Spark sorts the documents by id (range partitions, a salt behind the id), every
task encodes its documents and closes a file after ``FILE_TOKENS`` ids, prefix
sums over the files' sizes give every file its first token, and Spark's text
writer, which writes bytes as they are, puts each file into the folder
``start=<first token>/n_tokens=<tokens>``. So a lost task is repeated and commits
whole files, on any file system that Spark knows. A document is never cut; a
file holds at least one.

Readers: ``read_documents`` (digests or ids of every document), ``tokens_at`` (the
ids at given places of the whole corpus).

Defined cases: null and empty texts have only the end id; rows without id come
first; rows that repeat an id follow each other in the order of their texts'
hashes; an empty table writes and gives no files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from examlytics.llm.common import drop_stored, lean, pieces, scratch, stored
from examlytics.llm.subwords import encode_rows, public_path

#: A file is closed after the document that reaches so many ids.
FILE_TOKENS = 4 << 20
MAGIC = b"TOKDAC01"
END_ID = 2
#: Bytes of text encoded at once: distinct words are encoded once in each piece.
PIECE_BYTES = 12 << 20
RANK_BITS = 512
#: Bits of the part of a file's number that counts the files of one task.
SEQUENCE_BITS = 24
#: Width and entries of a level; number, documents, tokens and levels of a file.
LEVEL = "<BQ"
HEAD = "<qQQB"


# ------------------------------------------------------------------ the code


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, lowest chunk first, that need the fewest bits for these ids."""
    lengths = np.zeros(65, np.int64)
    for a in range(0, len(ids), 1 << 17):
        lengths += np.bincount(np.maximum(np.frexp(ids[a : a + (1 << 17)].astype(float))[1], 1), minlength=65)
    lengths = lengths[: max(2, int(np.flatnonzero(lengths)[-1]) + 1 if len(ids) else 2)]
    top = len(lengths) - 1
    bits = len(ids) - np.cumsum(lengths)  # ids that need more than k bits
    best: list[tuple[float, list[int]]] = [(0.0, [])] * (top + 1)  # cost of the bits from k on
    for k in range(top - 1, -1, -1):
        options = []
        for nxt in range(k + 1, top + 1):
            flag = 0.0 if nxt == top else 1 + 64 / RANK_BITS  # continuation bit and its share of the directory
            options.append((bits[k] * (nxt - k + flag) + best[nxt][0], [nxt - k, *best[nxt][1]]))
        best[k] = min(options)
    return best[0][1]


def _kind(width: int) -> np.dtype:
    """The little-endian number that ``width`` bits fit in."""
    return np.dtype(next(f"<u{n}" for n in (1, 2, 4, 8) if 8 * n >= width))


def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bits, one after the other, lowest bit first."""
    out, kind = [], _kind(width)
    for a in range(0, len(values), 1 << 17):  # a multiple of 8 numbers ends at a whole byte
        part = values[a : a + (1 << 17)].astype(kind)
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Numbers ``a:b`` of ``width`` bits."""
    first, kind = a * width, _kind(width)
    bits = np.unpackbits(raw[first >> 3 : (b * width + 7) >> 3], bitorder="little")[first & 7 :][: (b - a) * width]
    wide = np.zeros((b - a, 8 * kind.itemsize), np.uint8)
    wide[:, :width] = bits.reshape(b - a, width)
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view(kind).astype(np.int64)


def build(number: int, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes but for the magic and the place of its first token, which stand before."""
    widths = best_widths(ids)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    keys = np.array([i or 0 for i in doc_ids], "<i8")
    first = np.zeros(len(doc_ids) + 1, "<u8")
    np.cumsum(counts, out=first[1:])
    out = [struct.pack(HEAD, number, len(doc_ids), len(ids), len(widths)), keys.tobytes(), known.tobytes(), first.tobytes()]
    rest = ids if ids.dtype.kind == "u" else ids.astype(np.uint64)
    kind = rest.dtype.type
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        out.append(struct.pack(LEVEL, width, len(rest)))
        out.append(pack(rest & kind((1 << width) - 1), width))
        if not last:
            more = (rest >> kind(width)) > 0
            padded = np.zeros(-(-len(rest) // RANK_BITS) * RANK_BITS, np.uint8)
            padded[: len(rest)] = more
            out.append(np.packbits(padded, bitorder="little").tobytes())
            ones = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint64)
            out.append((np.cumsum(ones) - ones).astype("<u8").tobytes())
            rest = rest[more] >> kind(width)
    return b"".join(out)


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        self.start = int.from_bytes(content[8:16], "big")
        at = 16 + struct.calcsize(HEAD)
        self.number, self.n_docs, self.n_tokens, levels = struct.unpack_from(HEAD, content, 16)

        def part(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        keys, known = part(self.n_docs, "<i8"), part(self.n_docs, "u1")
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.first = part(self.n_docs + 1, "<u8").astype(np.int64)
        self.levels = []
        for k in range(levels):
            width, n = struct.unpack_from(LEVEL, content, at)
            at += struct.calcsize(LEVEL)
            chunks = part((n * width + 7) >> 3, "u1")
            blocks = -(-n // RANK_BITS) if k < levels - 1 else 0
            bitmap, directory = part(blocks * RANK_BITS // 8, "u1"), part(blocks, "<u8")
            self.levels.append((width, n, chunks, bitmap, directory))
        if content[at:] not in (b"", b"\n") or (levels and self.levels[0][1] != self.n_tokens):
            raise ValueError("a damaged token file")

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i`` of a level's bitmap."""
        _, n, _, bitmap, directory = self.levels[level]
        if i >= n and n % RANK_BITS == 0:
            return self.levels[level + 1][1]
        block = i // RANK_BITS
        inside = bitmap[block * RANK_BITS // 8 : (i + 7) >> 3]
        ones = np.unpackbits(inside, bitorder="little")[: i - block * RANK_BITS]
        return int(directory[block]) + int(ones.sum())

    def token(self, i: int) -> int:
        """The id at place ``i`` of the file."""
        return int(self.tokens(i, i + 1)[0])

    def tokens(self, a: int, b: int) -> np.ndarray:
        """The ids at places ``a:b``: a contiguous run on every level."""
        if not 0 <= a <= b <= self.n_tokens:
            raise IndexError(f"{a}:{b} of {self.n_tokens}")
        out, place, shift = np.zeros(b - a, np.int64), np.arange(b - a), 0
        for k, (width, _, chunks, bitmap, _) in enumerate(self.levels):
            if a == b:
                break
            out[place] |= unpack(chunks, width, a, b) << shift
            shift += width
            if k < len(self.levels) - 1:
                more = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
                place = place[more]
                a = self.rank(k, a)
                b = a + len(place)
        return out


# ------------------------------------------------------------------ writer

BODY = "file long, n_docs long, n_tokens long, body binary"
BODY_ARROW = pa.schema([("file", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])


def _encoder(path: str, end_id: int, file_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sequence = TaskContext.get().partitionId(), 0
        keys: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            number = (task << SEQUENCE_BITS) + sequence
            whole = np.concatenate(ids)
            ids.clear()
            body = build(number, keys, np.concatenate(counts), whole)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, len(keys), held, body)], schema=BODY_ARROW)

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b, data, offs in pieces(batch, "text", PIECE_BYTES):
                flat, n = encode_rows(path, data, offs)
                upto = np.cumsum(n)
                flat, n = np.insert(flat.astype(np.uint32), upto, end_id), n + 1
                first, ends = 0, np.cumsum(n)
                while first < b - a:  # cut the piece where a file is full
                    done = ends[first - 1] if first else 0
                    last = min(b - a, int(np.searchsorted(ends, done + file_tokens - held)) + 1)
                    keys += doc_ids[a + first : a + last]
                    counts.append(n[first:last])
                    ids.append(flat[done : ends[last - 1]])
                    held += int(ends[last - 1] - done)
                    first = last
                    if held >= file_tokens:
                        yield closed()
                        keys, counts, ids, held, sequence = [], [], [], 0, sequence + 1
        if keys:
            yield closed()

    return encode


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the documents' ids into a new folder."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    x = x.withColumns({"tie": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("salt")]
    x = x.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    bodies = stored(x.mapInArrow(lean(_encoder(tokenizer_path, end_id, file_tokens)), BODY), "token-bodies")
    # tokens before a file: those of earlier tasks (a sum per task) and of earlier files of its task
    sizes = bodies.select("file", "n_tokens", F.shiftright("file", SEQUENCE_BITS).alias("task"))
    tasks = sizes.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("upto"))
    inside = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(tasks, "task")
    starts = starts.select("file", (F.col("upto") + F.col("own")).alias("start"))
    place = F.unhex(F.lpad(F.hex("start"), 16, "0"))
    content = F.concat(F.lit(bytearray(MAGIC)), place, F.col("body")).cast("string")  # the same bytes; the text writer copies them
    files = bodies.join(starts, "file").select("start", "n_tokens", content.alias("value"))
    files.write.partitionBy("start", "n_tokens").option("lineSep", "\n").text(folder)
    drop_stored(bodies)


# ------------------------------------------------------------------ readers

DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"
DOCUMENTS_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def _documents(with_ids: bool, run: int = 1 << 20):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                f = TokenFile(content.as_py())
                d = 0
                while d < f.n_docs:  # a run of documents at a time
                    upto = max(d + 1, int(np.searchsorted(f.first, f.first[d] + run, side="right")) - 1)
                    edges = f.first[d : upto + 1] - f.first[d]
                    ids = f.tokens(int(f.first[d]), int(f.first[upto])).astype("<u4")
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                    lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(upto - d, pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[d:upto], pa.int64()), pa.array(f.start + f.first[d:upto]), pa.array(np.diff(edges)), pa.array(crc, pa.int64()), lists],
                        schema=DOCUMENTS_ARROW,
                    )
                    d = upto

    return read


def read_documents(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """A row per document: its id, the place of its first token, its ids (if asked for), their number and CRC-32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(lean(_documents(with_ids)), DOCUMENTS)


def _at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, wanted in zip(batch.column("content"), batch.column("wanted")):
            f = TokenFile(content.as_py())
            places = wanted.values.to_numpy()
            found = [f.token(int(p) - f.start) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(found, pa.int32())], names=["place", "token"])


def tokens_at(spark: SparkSession, folder: str, places: DataFrame, bucket: int = FILE_TOKENS) -> DataFrame:
    """(place, token) for every distinct place of ``places`` inside the corpus.

    Spans of files (from the folders' names) and places meet in buckets of
    ``bucket`` tokens. A file holds a bounded number of tokens, so the distinct
    places of one file are bounded too; one chunk per level is read for each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    if "start" not in files.columns:  # no file was written
        return spark.createDataFrame([], "place long, token int")
    lo, hi = F.col("start").cast("long"), F.col("start").cast("long") + F.col("n_tokens").cast("long")
    spans = files.select("path", lo.alias("lo"), hi.alias("hi"))  # folder names only
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    want = places.select(F.col(places.columns[0]).cast("long").alias("place")).distinct().withColumn("bucket", F.floor(F.col("place") / bucket))
    held = want.join(spans, "bucket").where("place >= lo and place < hi")
    held = held.groupBy(F.col("lo").alias("start")).agg(F.collect_list("place").alias("wanted"))
    return files.select(lo.alias("start"), "content").join(held, "start").select("content", "wanted").mapInArrow(_at, "place long, token int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_token_codes: every document encoded, written to files of directly addressable codes and read back."""
    folder = scratch(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_path("word_bpe_49k.json"))
    return read_documents(spark, folder, with_ids=False).drop("ids")
