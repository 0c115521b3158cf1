"""Alignment of two tokenizers over the same texts (operator 12).

Both tokenizers cover the bytes of a space and the text; the byte offsets where
a token of A and a token of B both end cut the tokens into groups. The common
offsets are found by galloping intersection: the shorter list of token ends
drives, and every driving end is looked up in the longer list by exponential
search from the place of an earlier driver and binary search inside the last
step. The searches of a piece run side by side: drivers at large strides are
located first, and the drivers between two located ones start at the left one
and are bounded by the right one, so the work stays that of galloping, a
logarithm of the gap for each driver. Common ends slice the groups, and the
differences of their ranks in both lists give each group's range of tokens.

``align`` returns groups and ids of every document. ``link_table`` counts for every
pair of ids in how many documents it is linked and gives each document its links'
counts. A task handles a few megabytes of text at a time; such a batch is one row
that holds its dictionary of distinct pairs and every document's pairs as places
in it, so what is shuffled is a batch's dictionary, not every document's links.
Pair counts are summed map-side; a pair or id of very many documents is a sum,
never a gathered group.

Defined cases: null and empty texts, and texts whose tokens do not give back the
bytes, have no tokens, groups or links; rows that repeat an id are documents of
their own, as are rows without id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examlytics.llm import subwords
from examlytics.llm.common import pieces, stored

#: Bytes of text in a batch.
BATCH_BYTES = 2 << 20
#: Groups with more pairs of tokens than this are counted by distinct ids instead of written out.
LARGE_GROUP = 4096


# ------------------------------------------------------------------ galloping intersection


def gallop(drivers: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each driver the first place in ``low:high`` of ``longer`` that is not smaller (or ``high``).

    Exponential steps from ``low``, then binary search inside the last step.
    """
    low, high = low.copy(), high.copy()
    active = np.flatnonzero(low < high)
    step = 1
    while len(active):
        probe = np.minimum(low[active] + step - 1, high[active] - 1)
        smaller = longer[probe] < drivers[active]
        high[active[~smaller]] = probe[~smaller]
        low[active[smaller]] = probe[smaller] + 1
        active = active[smaller]
        active = active[low[active] < high[active]]
        step *= 2
    active = np.flatnonzero(low < high)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        smaller = longer[middle] < drivers[active]
        low[active[smaller]] = middle[smaller] + 1
        high[active[~smaller]] = middle[~smaller]
        active = active[low[active] < high[active]]
    return low


def locate(drivers: np.ndarray, rank: np.ndarray, size: np.ndarray, longer: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of all drivers. ``rank`` is a driver's place in its list of ``size``; ``low:high`` its list's range of ``longer``."""
    place = np.empty(len(drivers), np.int64)
    start = np.flatnonzero(rank == 0)
    place[start] = gallop(drivers[start], longer, low[start], high[start])
    stride = 1
    while stride < (int(size.max()) if len(size) else 0):
        stride *= 2
    while stride:
        now = np.flatnonzero(rank & (2 * stride - 1) == stride)
        right = np.where(rank[now] + stride < size[now], now + stride, -1)
        upto = np.where(right >= 0, place[np.maximum(right, 0)], high[now])
        place[now] = gallop(drivers[now], longer, place[now - stride], upto)
        stride //= 2
    return place


def common_ends(a_ends: np.ndarray, a_n: np.ndarray, b_ends: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a_ends`` and ``b_ends`` of equal ends, row by row; both ascend over all rows."""
    a_first, b_first = np.cumsum(a_n) - a_n, np.cumsum(b_n) - b_n
    found = []
    for d_ends, d_n, d_first, l_ends, l_n, l_first, mine in (
        (a_ends, a_n, a_first, b_ends, b_n, b_first, a_n <= b_n),
        (b_ends, b_n, b_first, a_ends, a_n, a_first, a_n > b_n),
    ):
        n = np.where(mine, d_n, 0)
        total = int(n.sum())
        row = np.repeat(np.arange(len(n)), n)
        rank = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        at = d_first[row] + rank
        drivers, high = d_ends[at], (l_first + l_n)[row]
        place = locate(drivers, rank, n[row], l_ends, l_first[row], high)
        hit = place < high
        hit[hit] = l_ends[place[hit]] == drivers[hit]
        found.append((at[hit], place[hit]))
    (a1, b1), (b2, a2) = found
    a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


# ------------------------------------------------------------------ a piece of texts


class Aligned(NamedTuple):
    """Ids of both tokenizers over some rows; tokens per row; the last token of every group; groups' rows."""

    a_ids: np.ndarray
    a_n: np.ndarray
    b_ids: np.ndarray
    b_n: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    row: np.ndarray


class Tokenizers:
    """A byte-level vocabulary (A) and a piece model (B), with the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = subwords.load_json(a_path, plain_specials=True), subwords.load_pieces(b_path)
        self.a_bytes, self.b_bytes = subwords.json_token_bytes(a_path), subwords.piece_token_bytes(b_path)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """B adds the space that stands in front of every text here."""
        return self.b.encode([t[1:] for t in texts], num_threads=1)

    def align(self, data: np.ndarray, offs: np.ndarray) -> Aligned:
        """Rows are a space and a text, or empty."""
        n_rows = len(offs) - 1
        starts = subwords.chunk_starts(data, offs)
        if not len(starts):
            z = np.empty(0, np.int64)
            return Aligned(z, np.zeros(n_rows, np.int64), z, np.zeros(n_rows, np.int64), z, z, z)
        codes, chunks = subwords.distinct_chunks(data, starts)
        a = subwords.encode_joined(self.encode_a, self.a_len, chunks)
        b = subwords.encode_joined(self.encode_b, self.b_len, chunks)
        # rows whose tokens do not give back their bytes have no tokens
        same = _gives_back(self.a_bytes, self.a_len, a, chunks) & _gives_back(self.b_bytes, self.b_len, b, chunks)
        row = np.searchsorted(offs, starts, side="right") - 1
        if not same.all():
            differs = np.zeros(n_rows, bool)
            differs[row[~same[codes]]] = True
            keep = ~differs[row]
            starts, codes, row = starts[keep], codes[keep], row[keep]
        out = []
        for ids, length in ((a, self.a_len), (b, self.b_len)):
            at = ids.places(codes)
            ends = np.cumsum(length[ids.values])  # within the distinct chunks
            before = np.concatenate([[0], ends])[ids.first[:-1]]
            n = ids.counts[codes]
            out += [ids.values[at], np.bincount(row, weights=n, minlength=n_rows).astype(np.int64), ends[at] + np.repeat(starts - before[codes], n)]
        a_ids, a_n, a_ends, b_ids, b_n, b_ends = out
        a_last, b_last = common_ends(a_ends, a_n, b_ends, b_n)
        return Aligned(a_ids, a_n, b_ids, b_n, a_last, b_last, np.repeat(np.arange(n_rows), a_n)[a_last])


def _gives_back(token_bytes: list[bytes], lengths: np.ndarray, ids: subwords.Ragged, chunks: pa.Array) -> np.ndarray:
    """Whether the tokens of each chunk give its bytes."""
    size = pc.binary_length(chunks).to_numpy()
    tokens = [token_bytes[i] for i in ids.values.tolist()]
    upto = np.append(0, np.cumsum(lengths[ids.values]))
    if np.array_equal(np.diff(upto[ids.first]), size) and b"".join(tokens) == b"".join(chunks.to_pylist()):
        return np.ones(len(size), bool)
    return np.array([b"".join(tokens[lo:hi]) == t for lo, hi, t in zip(ids.first[:-1], ids.first[1:], chunks.to_pylist())], bool)


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return subwords.once(("aligned", a_path, b_path), lambda: Tokenizers(a_path, b_path))


def _spaced(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``text`` as a space and the text; empty where there is none."""
    text = batch.column("text").cast(pa.large_string())
    text = pc.fill_null(text, "")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string()))
    empty = pc.equal(pc.binary_length(text), 0)
    return pa.RecordBatch.from_arrays([pc.if_else(empty, pa.scalar("", pa.large_string()), spaced)], names=["text"])


def _cuts(last: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Ends of groups as ranks within their rows."""
    return last + 1 - (np.cumsum(n) - n)[row]


# ------------------------------------------------------------------ groups of every document

ALIGNED = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"


def _ragged(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _aligner(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, b_path)
        for batch in batches:
            keys = batch.column("doc_id")
            for a, b, data, offs in pieces(_spaced(batch), "text", BATCH_BYTES):
                x = both.align(data, offs)
                groups = np.bincount(x.row, minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [keys[a:b], _ragged(x.a_ids, x.a_n), _ragged(x.b_ids, x.b_n), _ragged(_cuts(x.a_last, x.row, x.a_n), groups), _ragged(_cuts(x.b_last, x.row, x.b_n), groups)],
                    names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"],
                )

    return run


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ids of both tokenizers and, group by group, the rank after its last token in each list.

    Group g holds A's tokens ``a_cuts[g-1]:a_cuts[g]`` and B's ``b_cuts[g-1]:b_cuts[g]``.
    """
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(_aligner(a_path, b_path), ALIGNED)


# ------------------------------------------------------------------ links and their counts

BATCHES = (
    "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pairs array<long>, docs array<long>, sizes array<int>, places binary, times binary"
)


def document_links(x: Aligned, n_rows: int, b_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct links of every row, row by row: the row, the pair of ids as one number, how many occurrences."""
    a0, b0 = np.append(-1, x.a_last[:-1]) + 1, np.append(-1, x.b_last[:-1]) + 1
    na, nb = x.a_last + 1 - a0, x.b_last + 1 - b0
    small = np.flatnonzero(na * nb <= LARGE_GROUP)
    n = na[small] * nb[small]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    g = np.repeat(small, n)
    pair = x.a_ids[a0[g] + inside // nb[g]] * b_size + x.b_ids[b0[g] + inside % nb[g]]
    rows, times = [x.row[g]], [np.ones(len(pair), np.int64)]
    pair = [pair]
    for k in np.flatnonzero(na * nb > LARGE_GROUP).tolist():
        ua, ca = np.unique(x.a_ids[a0[k] : a0[k] + na[k]], return_counts=True)
        ub, cb = np.unique(x.b_ids[b0[k] : b0[k] + nb[k]], return_counts=True)
        pair.append((ua[:, None] * b_size + ub).ravel())
        times.append(np.outer(ca, cb).ravel())
        rows.append(np.full(len(pair[-1]), x.row[k]))
    code = np.concatenate(pair)
    if not len(code):
        return code, code, code
    key = np.concatenate(rows) << 32 | code  # a pair needs fewer than 32 bits
    if len(times) > 1:
        order = np.argsort(key, kind="stable")
        key, count = key[order], np.concatenate(times)[order]
    else:
        key, count = np.sort(key), times[0]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(count, first)


def group_digests(x: Aligned, n_rows: int, a_size: int, b_size: int) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for every row; '' for rows without tokens."""
    texts = subwords.once(
        ("digits", a_size, b_size),
        lambda: np.array([b"%d%s" % (i, s) for n, signs in ((a_size, b",|"), (b_size, b",;")) for i in range(n) for s in (signs[:1], signs[1:])], object),
    )
    a_code, b_code = x.a_ids * 2, 2 * a_size + x.b_ids * 2
    a_code[x.a_last] += 1
    b_code[x.b_last] += 1
    # A's tokens of a group, then B's: each is moved by the other list's tokens that stand before it
    na, nb = np.diff(x.a_last, prepend=-1), np.diff(x.b_last, prepend=-1)
    out = np.empty(len(a_code) + len(b_code), np.int64)
    out[np.arange(len(a_code)) + np.repeat(x.b_last + 1 - nb, na)] = a_code
    out[np.arange(len(b_code)) + np.repeat(x.a_last + 1, nb)] = b_code
    words = texts[out]
    ends = np.cumsum(x.a_n + x.b_n).tolist()
    digests, first = [], 0
    for end in ends:
        digests.append(hashlib.sha256(b"".join(words[first:end].tolist())[:-1]).hexdigest() if end > first else "")
        first = end
    return digests


def _linker(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(a_path, b_path)
        a_size, b_size = len(both.a_len), len(both.b_len)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys = batch.column("doc_id")
            for a, b, data, offs in pieces(_spaced(batch), "text", BATCH_BYTES):
                n_rows = b - a
                x = both.align(data, offs)
                row, code, times = document_links(x, n_rows, b_size)
                pairs, places, docs = np.unique(code, return_inverse=True, return_counts=True)
                n_links = np.bincount(row, weights=times, minlength=n_rows).astype(np.int64)
                lists = [
                    keys[a:b], pa.array(x.a_n), pa.array(x.b_n), pa.array(np.bincount(x.row, minlength=n_rows)), pa.array(n_links),
                    pa.array(group_digests(x, n_rows, a_size, b_size)), pa.array(pairs), pa.array(docs), pa.array(np.bincount(row, minlength=n_rows).astype(np.int32)),
                ]
                one = [pa.array([number])] + [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
                one += [pa.array([places.astype("<u4").tobytes()]), pa.array([times.astype("<u8").tobytes()])]
                yield pa.RecordBatch.from_arrays(one, names=[f.split()[0] for f in BATCHES.split(", ")])
                number += 1

    return run


LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
PER_ROW = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            col = {n: batch.column(n)[r] for n in batch.schema.names}
            rows = {n: col[n].values for n in PER_ROW}
            sizes = col["sizes"].values.to_numpy()
            places = np.frombuffer(col["places"].as_py(), "<u4")
            times = np.frombuffer(col["times"].as_py(), "<u8").astype(np.int64)
            found = col["found"].values
            count, best = np.zeros(len(col["pairs"].values), np.int64), np.zeros(len(col["pairs"].values), bool)
            if found is not None:
                at = found.field("place").to_numpy()
                count[at] = found.field("n").to_numpy()
                best[at] = found.field("best").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            total = np.zeros((2, len(sizes)), np.int64)
            np.add.at(total[0], row, times * best[places])
            np.add.at(total[1], row, times * count[places])
            names = LINKED.split(", ")
            made = {"n_best": pa.array(total[0]), "count_sum": pa.array(total[1])}
            yield pa.RecordBatch.from_arrays([{**rows, **made}[n.split()[0]] for n in names], names=[n.split()[0] for n in names])


def link_batches(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of batches: their documents' digests, distinct pairs and links."""
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(x.mapInArrow(_linker(a_path, b_path), BATCHES), "token-links")


def pair_counts(batches: DataFrame, b_size: int) -> DataFrame:
    """(pair, a_id, b_id, n, best): documents that hold the pair linked; whether no pair of its A id has more."""
    counts = batches.select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy("pairs").agg(F.sum("docs").alias("n"))
    counts = counts.select(F.col("pairs").alias("pair"), F.expr(f"pairs div {b_size}").alias("a_id"), F.expr(f"pairs % {b_size}").alias("b_id"), "n")
    most = counts.groupBy("a_id").agg(F.max("n").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def link_table(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the numbers of tokens, groups and links, what its links count, and its groups' digest."""
    batches = link_batches(docs, a_path, b_path, id_col, text_col)
    counts = pair_counts(batches, subwords.load_pieces(b_path).vocab_size()).select("pair", "n", "best")
    asked = batches.select("batch", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(counts, "pair").groupBy("batch").agg(F.collect_list(F.struct("place", "n", "best")).alias("found"))
    back = batches.drop("docs").join(found, "batch", "left")
    return back.mapInArrow(_finish, LINKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12_token_alignment: every document under both public vocabularies."""
    paths = subwords.public_path("byte_bpe_50k.json"), subwords.public_path("piece_bpe_32k.model")
    return link_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths)
