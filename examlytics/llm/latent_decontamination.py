"""Benchmark decontamination by latent semantic retrieval (operator 7).

1. Words (lower case, punctuation as white space) are hashed to ``TERMS`` terms;
   inverse document frequencies come from all documents.
2. One randomised SVD of the TF-IDF matrix of the corpus's passages gives ``RANK``
   latent axes, far fewer than terms: a random block is multiplied by A^T A, made
   orthonormal, multiplied again, and the small Rayleigh-Ritz problem gives the
   singular values. Every passage of every document takes part, the benchmark none.
   The words' terms are written once, two bytes each; partial products are made
   where they are and summed in Spark, so terms x rank numbers reach the driver,
   whatever the corpus holds.
3. Every passage of every document and every item is projected on the axes, each
   axis divided by its singular value (else the few axes of what all passages
   share would decide every cosine). Passages are windows of as many blocks of
   ``STEP`` words as hold the item, one from each block on. A window is a candidate
   if the cosine of the two latent vectors reaches ``MIN_COSINE``. All candidates
   go on.
4. A candidate is a leak if the longest common subsequence of words covers
   ``MIN_LCS`` of the item, or ``MIN_LCS_ANSWER`` of it with the item's answer
   (its last sentence; a short one: its last words) covered to ``MIN_ANSWER``.

The benchmark is read in blocks of ``ITEM_BLOCK`` items, each searched in one pass
over the corpus with the items' latent vectors broadcast (and taken back when its
leaks are written), so the size of the benchmark is no limit to memory or disk.

Defined cases: null or empty texts, documents and items, match nothing; an item
of fewer than ``SHORT`` words leaks only when its words occur in full, in order;
equal items and repeated rows are matched each; null ids pass through; empty
tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlytics.llm.common import PIECE_BYTES, drop_stored, lean, pieces, release, row_counts, stored, word_hashes, word_spans

TERMS = 1 << 14
ITEM_BLOCK = 2_000
#: Latent axes.
RANK = 128
#: Words of a passage for the axes, passages multiplied at once, and from how many words in them a term is a row of a matrix.
FIT_WORDS = 64
FIT_ROWS = 2048
MANY = 96
STEP = 8
MIN_COSINE = 0.4
MIN_LCS, MIN_LCS_ANSWER, MIN_ANSWER = 0.65, 0.55, 0.8
SHORT = 8
ANSWER_WORDS = 8
CHUNK_WORDS = 1 << 15
#: Words hashed, sums of rows made and blocks searched at once (more of them for long items): about what a core's cache holds.
HASH_WORDS = 1 << 12
SUM_ROWS = 512
CHUNK_BLOCKS = 1024
#: Leading bits of a word's hash that lead to its place among the items' words.
BITS = 16

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not (chr(b).isalnum())]] = 32
PLAIN_BYTES = PLAIN.tobytes()


# ------------------------------------------------------------------ words and passages


def words_of(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, word hashes, rows) of a text column, lower case and without punctuation."""
    whole = batch.column(column)
    step = max(1, len(whole) * PIECE_BYTES // max(1, whole.nbytes))  # rows lowered at once
    for at in range(0, len(whole), step):
        low = pc.utf8_lower(whole.slice(at, step).cast(pa.large_string()).fill_null(""))
        for a, b, data, offs in pieces(pa.RecordBatch.from_arrays([low], names=["t"]), "t"):
            plain = np.frombuffer(data.tobytes().translate(PLAIN_BYTES), np.uint8)
            start, end, row = word_spans(plain, offs)
            words = np.empty(len(start), np.uint64)
            for i in range(0, len(start), HASH_WORDS):  # a hash does not depend on the word's place
                first, last = start[i : i + HASH_WORDS], end[i : i + HASH_WORDS]
                words[i : i + HASH_WORDS] = word_hashes(plain[first[0] : last[-1]], first - first[0], last - first[0])
            yield at + a, at + b, words, row


def terms(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(TERMS)).astype(np.int64)


def _text_words(text: str) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([pa.array([text], pa.large_string())], names=["t"])
    return next((w for _, _, w, _ in words_of(batch, "t")), np.empty(0, np.uint64))


# ------------------------------------------------------------------ corpus statistics and the SVD


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of a piece's words, one after the other, and how many each of its documents has."""
    for batch in batches:
        for a, b, words, row in words_of(batch, "text"):
            t, n = terms(words).astype("<u2"), row_counts(row, b - a)[0].astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (t, n)], names=["terms", "counts"])


def passage_terms(docs: DataFrame) -> DataFrame:
    """(terms, counts) of the column ``text``: two bytes a word, in records of a piece each."""
    return docs if "terms" in docs.columns else docs.select("text").mapInArrow(lean(_passages), "terms binary, counts binary")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for t, n in zip(batch.column("terms"), batch.column("counts")):
            yield np.frombuffer(t.as_buffer(), "<u2"), np.frombuffer(n.as_buffer(), "<i8")


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, docs = np.zeros(TERMS, np.int64), 0
    for t, n in _records(batches):
        docs += len(n)
        first = np.append(0, np.cumsum(n))
        for i in range(0, len(n), 64):
            k = n[i : i + 64]
            seen = np.zeros((64, TERMS), np.uint8)  # of 64 documents at a time
            seen[np.repeat(np.arange(len(k)), k), t[first[i] : first[i + len(k)]]] = 1
            df += seen.sum(axis=0, dtype=np.uint8)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], names=["term", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of every term, over all documents."""
    n = passage_terms(docs).mapInArrow(lean(_document_frequency), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in n.collect()}
    df = np.zeros(TERMS)
    for t, c in got.items():
        if t >= 0:
            df[t] = c
    return np.maximum(np.log((1.0 + got.get(-1, 0)) / (1.0 + df)), 0.05).astype(np.float32)


def random_block(rank: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).standard_normal((TERMS, rank)).astype(np.float32)


def spread_back(t: np.ndarray, passage: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of some words and, for each, the sum of the rows of ``y`` that its words' passages have.

    Terms are taken by falling count: the j-th words of all terms that have so many
    are added at once; terms of many words are rows of a matrix of counts instead.
    """
    order = np.argsort(t, kind="stable")
    ts, ps = t[order], passage[order]
    head = np.flatnonzero(np.append(True, ts[1:] != ts[:-1]))
    n = np.diff(np.append(head, len(ts)))
    by = np.argsort(-n, kind="stable")
    head, n = head[by], n[by]
    out = np.zeros((len(head), y.shape[1]), np.float32)
    many = int(np.searchsorted(-n, -MANY))
    if many:
        k, size = n[:many], len(y)
        word = np.arange(int(k.sum())) + np.repeat(head[:many] - np.cumsum(k) + k, k)
        held = np.bincount(np.repeat(np.arange(many), k) * size + ps[word], minlength=many * size)
        out[:many] = held.reshape(many, size).astype(np.float32) @ y
    one = np.empty((SUM_ROWS, y.shape[1]), y.dtype)
    for a in range(many, len(head), SUM_ROWS):
        few, rest, k = out[a : a + SUM_ROWS], head[a : a + SUM_ROWS], n[a : a + SUM_ROWS]
        for j in range(int(k[0])):
            have = int(np.searchsorted(-k, -j))
            few[:have] += y.take(ps[rest[:have] + j], axis=0, out=one[:have], mode="clip")
    return ts[head], out


def _gram_product(idf: np.ndarray, block):
    """Partial A^T (A q) of the passages of a partition, A their row-normalised TF-IDF matrix, and their number.

    The block q is drawn in the task in the first round (``block`` is then its
    rank) and a broadcast in half precision later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = random_block(block) if isinstance(block, int) else block.value.astype(np.float32)
        e = np.vstack([idf[:, None] * q, np.zeros((1, q.shape[1]), np.float32)])  # the last row, of no term, fills up short passages
        square = np.append(idf**2, 0).astype(np.float64)
        total, passages = np.zeros(q.shape, np.float32), 0
        for words, n in _records(batches):
            per = -(-n // FIT_WORDS)
            starts = np.repeat(np.cumsum(n) - n - FIT_WORDS * (np.cumsum(per) - per), per) + FIT_WORDS * np.arange(int(per.sum()))
            edges = np.append(starts, len(words))
            passages += len(starts)
            for a in range(0, len(starts), FIT_ROWS):
                at = edges[a : a + FIT_ROWS + 1]
                t, size = words[at[0] : at[-1]], np.diff(at)
                grid = side_by_side(t, size, FIT_WORDS, len(e) - 1)
                y = block_sums(e, grid)
                y /= square.take(grid).sum(axis=1)[:, None].astype(np.float32)
                which, sums = spread_back(t, np.repeat(np.arange(len(size)), size), y)
                for i in range(0, len(which), SUM_ROWS):
                    some = which[i : i + SUM_ROWS]
                    total[some] += sums[i : i + SUM_ROWS] * idf[some, None]
        if not passages:
            return
        step = TERMS // 64
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(64)),
                pa.array([passages] + [0] * 63, pa.int64()),
                pa.array([total[i * step : (i + 1) * step].tobytes() for i in range(64)], pa.binary()),
            ],
            names=["part", "passages", "m"],
        )

    return run


PRODUCT = "part long, passages long, m binary"


def _sum_products(part: pa.Table) -> pa.Table:
    """The sum of the tasks' products for one part of the terms."""
    m = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in part.column("m")).astype(np.float32)
    return pa.table({"part": part.column("part")[:1], "passages": [pc.sum(part.column("passages")).as_py()], "m": pa.array([m.tobytes()], pa.binary())})


def latent_axes(docs: DataFrame, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the passages of ``docs``, each divided by its singular value.

    The tasks' products are summed in Spark, so one table of terms x rank reaches the
    driver in each round. A block on its way to the tasks is a broadcast of its own,
    taken back after its round.
    """
    spark, q = docs.sparkSession, None
    step = TERMS // 64
    # few tasks, as each sends a table; how many follows from the cluster, not from the corpus
    held = passage_terms(docs).coalesce(max(2, 2 * spark.sparkContext.defaultParallelism))
    for k in range(2):
        sent = spark.sparkContext.broadcast(q.astype(np.float16)) if k else None
        passages, y = 0, np.zeros((TERMS, rank))
        products = held.mapInArrow(lean(_gram_product(idf, sent or rank)), PRODUCT)
        for x in products.groupBy("part").applyInArrow(_sum_products, PRODUCT).collect():
            y[x["part"] * step : (x["part"] + 1) * step] += np.frombuffer(x["m"], np.float32).reshape(-1, rank)
            passages += x["passages"]
        if not k:
            q = np.linalg.qr(y)[0].astype(np.float32)
        if sent:
            sent.destroy()
    values, turn = np.linalg.eigh((q.T @ y + y.T @ q) / (2 * max(passages, 1)))
    real = values > 1e-6 * max(values[-1], 1e-30)  # fewer axes where the corpus has fewer
    return ((q @ turn[:, real]) / np.sqrt(values[real])).astype(np.float32)


# ------------------------------------------------------------------ items


def window_blocks(n_words: int) -> int:
    """Blocks per window for an item: enough to hold it at any alignment; few different sizes for long ones."""
    need = -(-(n_words + STEP - 1) // STEP)
    scale = 1
    while need > 16 * scale:
        scale *= 2
    return -(-need // scale) * scale


def answer_of(text: str) -> str:
    """An item's answer: its last sentence; if that is short, its last words."""
    last = re.split(r"(?<=[.!?])\s+", text.strip())[-1]
    return last if len(re.findall(r"\w+", last)) >= ANSWER_WORDS // 2 else " ".join(text.split()[-ANSWER_WORDS:])


def prepare_items(rows: list, table: np.ndarray) -> list[dict]:
    """Word hashes, answer and unit latent vector of each benchmark item with words."""
    out = []
    for item_id, text in rows:
        words = _text_words(text or "")
        if not len(words):
            continue
        v = table[terms(words)].sum(axis=0)
        v /= max(float(np.linalg.norm(v)), 1e-9)
        out.append({"id": item_id, "words": words, "answer": _text_words(answer_of(text)), "v": v, "blocks": window_blocks(len(words))})
    return out


def places(a: np.ndarray) -> dict[int, int]:
    """Word -> bit set of its places."""
    out: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        out[x] = out.get(x, 0) | (1 << i)
    return out


def lcs(place: dict[int, int], size: int, b: list[int]) -> int:
    """Length of the longest common subsequence of a sequence (its places) and b, by bit-parallel rows."""
    full = (1 << size) - 1
    s = full
    for x in b:
        m = place.get(x)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return size - s.bit_count()


# ------------------------------------------------------------------ search


def first_in_block(words: np.ndarray, block: np.ndarray) -> np.ndarray:
    """True for a word's first place in its block, so a run of one word counts once per block."""
    ok = np.ones(len(words), bool)
    for d in range(1, STEP):
        ok[d:] &= ~((words[d:] == words[:-d]) & (block[d:] == block[:-d]))
    return ok


@dataclass
class Words:
    """The words of a block of items: ``holds[k, j]``: word ``known[k]`` stands in item j (the last row: no known word)."""

    known: np.ndarray
    holds: np.ndarray
    least: np.ndarray  # words of an item that a leak shares at least
    margin: np.ndarray  # words around a window that are looked at too

    def __post_init__(self):
        """Where the known words of each leading ``BITS`` bits begin, and how many such words there are at most."""
        self.begin = np.searchsorted(self.known, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS))
        self.most = int(np.diff(np.append(self.begin, len(self.known))).max())
        self.upto = np.append(self.known, np.uint64(2**64 - 1))

    def codes(self, words: np.ndarray) -> np.ndarray:
        at = self.begin[words >> np.uint64(64 - BITS)]
        for _ in range(self.most):
            at += self.upto[at] < words
        return np.where(self.upto[at] == words, at, len(self.known))


def side_by_side(values: np.ndarray, size: np.ndarray, width: int, filler: int) -> np.ndarray:
    """A row per block with its ``size`` values, one block after the other, and ``filler`` behind them."""
    grid = np.full((len(size), width), filler)
    grid[np.arange(width) < size[:, None]] = values
    return grid


def block_sums(table: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Sums of the table's rows by block; a row of ``grid`` names those of a block."""
    sums = np.zeros((len(grid), table.shape[1]), table.dtype)
    one = np.empty((min(len(grid), SUM_ROWS), table.shape[1]), table.dtype)
    for a in range(0, len(grid), SUM_ROWS):
        part = sums[a : a + SUM_ROWS]
        for k in np.ascontiguousarray(grid[a : a + SUM_ROWS].T):
            part += table.take(k, axis=0, out=one[: len(part)], mode="clip")
    return sums


def reached(dot: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The flat places where ``dot`` is at least ``least``; eight places without one are passed over at once."""
    hit = np.zeros(-(-dot.size // 8) * 8, bool)
    np.greater_equal(dot, least, out=hit[: dot.size].reshape(dot.shape))
    at = (8 * np.flatnonzero(hit.view(np.uint64) != 0)[:, None] + np.arange(8)).ravel()
    return at[hit[at]]


def run_sums(rows: np.ndarray, column: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of ``rows[lo:hi, column]``, from sums of one, two, four and eight rows (small numbers: bytes)."""
    steps = [rows]
    for k in (1, 2, 4):
        steps.append(steps[-1].copy())
        steps[-1][:-k] += steps[-2][k:]
    out, lo = np.zeros(len(lo), np.int64), lo.copy()
    for k, sums in reversed(list(enumerate(steps))):
        go = np.flatnonzero(hi - lo >= 1 << k)
        while len(go):
            out[go] += sums[lo[go], column[go]]
            lo[go] += 1 << k
            go = go[hi[go] - lo[go] >= 1 << k]
    return out


def candidates(words: np.ndarray, codes: np.ndarray, first: np.ndarray, table: np.ndarray, vectors: np.ndarray, by_size: dict[int, np.ndarray], of: Words):
    """(block starts, block rows, windows, items, cosines) of some whole texts.

    Windows near an item in the latent space, but for those whose blocks hold
    fewer of its words than any leak does.
    """
    n = np.diff(first)
    n_blocks = -(-n // STEP)
    block_first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n_blocks, out=block_first[1:])
    block_row = np.repeat(np.arange(len(n)), n_blocks)
    starts = first[block_row] + (np.arange(block_first[-1]) - block_first[block_row]) * STEP
    size = np.diff(np.append(starts, len(words)))
    block = np.repeat(np.arange(len(starts)), size)
    # the terms of a block side by side; the table's last row, of no term, stands for repeated words and fills up short blocks
    grid = side_by_side(np.where(first_in_block(words, block), terms(words), len(table) - 1), size, STEP, len(table) - 1)
    held = side_by_side(codes, size, STEP, len(of.holds) - 1)
    around = -(-of.margin // STEP)
    last = block_first[block_row + 1]
    groups = [(w, ks, vectors[ks]) for w, ks in sorted(by_size.items())]
    out = []
    most = max(by_size)
    per = max(CHUNK_BLOCKS, 4 * most)
    for s in range(0, len(starts), per):
        top = min(len(starts), s + per + most)  # windows may reach into the next chunk
        sums = block_sums(table, grid[s:top])
        at = np.arange(s, min(s + per, len(starts)))
        left = last[at] - at
        window, wide, near = np.zeros((len(at), table.shape[1]), np.float32), 0, []
        for w, ks, v in groups:
            for k in range(wide, w):  # a window grows by its next block, if its text has one
                m = max(0, min(len(at), len(sums) - k))
                window[:m] += sums[k : k + m]
                past = np.flatnonzero(left[:m] <= k)
                window[past] -= sums[past + k]
            wide = w
            length = np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window)), 1e-9)
            dot = window @ v.T
            i, j = np.divmod(reached(dot, (MIN_COSINE * length)[:, None]), len(ks))
            near.append((at[i], ks[j], np.minimum(w, left[i]), dot[i, j] / length[i]))
        window_at, item, blocks, cos = (np.concatenate(x) for x in zip(*near))
        if not len(item):
            continue
        lo = np.maximum(window_at - around[item], block_first[block_row[window_at]])
        hi = np.minimum(window_at + blocks + around[item], last[window_at])
        low, span = int(lo.min()), int(hi.max() - lo.min()) + 1
        # words are counted in the blocks in and around such windows, no others
        need = np.cumsum(np.bincount(lo - low, minlength=span) - np.bincount(hi - low, minlength=span)) > 0
        begin = (np.cumsum(need) - 1)[lo - low]
        known = block_sums(of.holds, held[low + np.flatnonzero(need)])
        enough = run_sums(known, item, begin, begin + hi - lo) >= of.least[item]
        out.append((window_at[enough], item[enough], cos[enough]))
    if not out:
        return starts, block_row, *(np.empty(0, np.int64) for _ in range(3))
    return starts, block_row, *(np.concatenate(x) for x in zip(*out))


def _search(sent):
    """The search of a partition; ``sent`` is a broadcast of the terms' latent vectors (terms x axes), the items' and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, items = sent.value
        yield from _found(batches, half.astype(np.float32), items)

    return run


def _found(batches: Iterator[pa.RecordBatch], table: np.ndarray, items: list[dict]) -> Iterator[pa.RecordBatch]:
    vectors = np.stack([it["v"] for it in items]).astype(np.float32)
    table = np.vstack([table, np.zeros((1, table.shape[1]), np.float32)])
    sizes = np.array([it["blocks"] for it in items])
    by_size = {int(w): np.flatnonzero(sizes == w) for w in np.unique(sizes)}
    ids = [it["id"] for it in items]
    length = np.array([len(it["words"]) for it in items])
    known = np.unique(np.concatenate([it["words"] for it in items]))
    times = np.zeros((len(items), len(known) + 1), np.int32)
    for j, it in enumerate(items):
        np.add.at(times[j], np.searchsorted(known, it["words"]), 1)
    least = np.where(length < SHORT, 1.0, min(MIN_LCS, MIN_LCS_ANSWER)) * length
    of = Words(known, np.ascontiguousarray(times.T > 0).view(np.uint8), least, length // 8)
    checks = [(places(it["words"]), len(it["words"]), places(it["answer"]), len(it["answer"])) for it in items]

    def judge(item: int, near: list[int]) -> tuple[int, float, float] | None:
        place, m, answer, k = checks[item]
        got = lcs(place, m, near)
        share = got / m
        if share < (1.0 if m < SHORT else MIN_LCS_ANSWER):
            return None
        covered = lcs(answer, k, near) / max(k, 1)
        if share >= MIN_LCS or covered >= MIN_ANSWER:
            return got, share, covered
        return None

    def shared(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many of the words ``lo:hi`` the item has too, for every candidate.

        A word counts as often as it stands in both, so no common subsequence is longer.
        """
        out = np.zeros(len(item), np.int64)
        part = np.cumsum(hi - lo) // CHUNK_WORDS
        for k in np.split(np.arange(len(item)), np.flatnonzero(np.diff(part)) + 1):
            size = hi[k] - lo[k]
            which = np.repeat(np.arange(len(k)), size)
            c = codes[np.arange(len(which)) + np.repeat(lo[k] - np.cumsum(size) + size, size)]
            pair, n = np.unique(which * len(of.holds) + c, return_counts=True)
            which, c = pair // len(of.holds), pair % len(of.holds)
            out[k] = np.bincount(which, np.minimum(n, times[item[k][which], c]), minlength=len(k))
        return out

    def matches(words: np.ndarray, first: np.ndarray, table: np.ndarray) -> Iterator[tuple]:
        """Leaks of some whole texts; windows of one item that overlap give one row, that of the largest cosine that leaks."""
        codes = of.codes(words)
        starts, block_row, at, item, cos = candidates(words, codes, first, table, vectors, by_size, of)
        order = np.lexsort((at, block_row[at], item)) if len(at) else at
        at, item, cos = at[order], item[order], cos[order]
        if len(at):
            lows = np.maximum(first[block_row[at]], starts[at] - of.margin[item])
            highs = np.minimum(first[block_row[at] + 1], starts[at] + sizes[item] * STEP + of.margin[item])
            enough = shared(codes, lows, highs, item) >= least[item]
            at, item, cos, lows, highs = (x[enough] for x in (at, item, cos, lows, highs))
        k = 0
        while k < len(at):
            row, w = block_row[at[k]], sizes[item[k]]
            z = k + 1
            while z < len(at) and item[z] == item[k] and block_row[at[z]] == row and at[z] - at[z - 1] <= w:
                z += 1
            for x in k + np.argsort(-cos[k:z], kind="stable"):
                lo, hi = lows[x], highs[x]
                got = judge(item[k], words[lo:hi].tolist())
                if got:
                    yield int(row), ids[item[k]], float(cos[x]), *got, int(lo - first[row]), int(hi - first[row])
                    break
            k = z

    for batch in batches:
        for a, b, words, row in words_of(batch, "text"):
            got = list(matches(words, row_counts(row, b - a)[1], table)) if len(words) else []
            if got:
                rows, *rest = zip(*got)
                types = (pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a).take(pa.array(rows)), *(pa.array(c, t) for c, t in zip(rest, types))],
                    names=[x.split()[0] for x in MATCH.split(", ")],
                )


MATCH = "doc_id long, item_id long, cosine double, lcs_words int, lcs_share double, answer_share double, first_word int, end_word int"


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per leaked passage: document, item and the evidence."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    if src.isEmpty() or items.isEmpty():
        return spark.createDataFrame([], MATCH)
    passages = stored(passage_terms(src), "passage-terms")
    idf = inverse_frequencies(passages)
    axes = latent_axes(passages, idf)
    drop_stored(passages)
    paths = []
    rows = items.orderBy("id", F.xxhash64("text")).toLocalIterator()
    table = (idf[:, None] * axes).astype(np.float16)
    while block := [(r["id"], r["text"]) for r in islice(rows, ITEM_BLOCK)]:
        ready = prepare_items(block, table.astype(np.float32))
        if ready:
            sent = spark.sparkContext.broadcast((table, ready))
            paths.append(stored(src.mapInArrow(lean(_search(sent)), MATCH), "leaks").scratch_path)
            sent.destroy()
        release(spark)
    return spark.read.schema(MATCH).parquet(*paths) if paths else spark.createDataFrame([], MATCH)


def remove_leaking(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a leaked passage; a row is known by a hash of id and text, so repeated ids are judged apart."""
    tagged = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col)))
    bad = stored(leaks(tagged, benchmark, "__key", text_col).select(F.col("doc_id").alias("__key")).distinct(), "leaking")
    return tagged.join(bad, "__key", "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op7_latent_decontamination: every passage of ``benchmark`` found in ``documents``."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
