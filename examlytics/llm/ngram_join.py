"""N-gram Jaccard join with signature trees (operator 6).

Documents whose sets of word 5-shingles have a Jaccard similarity of 0.8 or
more are linked, and linked documents share a component.

1. One pass over the texts gives each document its set key (exact copies share
   it), the size of its set, a signature bitmap and its prefix: the smallest
   ``n - ceil(0.8 n) + 1`` shingle hashes. Two linked sets always share a
   shingle of their prefixes, so the sets of one prefix shingle form a block and
   the blocks together hold every link. Blocks with the same members are one.
2. Every block gets a signature tree. Its nodes hold OR-combined bitmaps, the
   range of set sizes and the largest number of shingles that a bitmap hides. A
   dual traversal drops a pair of nodes when the largest possible overlap,
   ``popcount(A & B) + hidden``, is below what the sizes ask for, or when both
   lie in one component. A block of more than ``BLOCK`` sets is dealt as pairs
   of sub-blocks, so a common shingle never meets in one task.
3. A group of near copies would give the square of its size in pairs. Where far
   more pairs than sets survive, the first round gives only the pairs of the
   sets with most partners and every set's best pair; they are verified on the
   whole shingle sets and joined to components. The second round goes over those
   blocks again and gives every pair that lies between two components.
4. Verified pairs of both rounds give the components by smallest reachable id.

Exact: nothing is sampled or capped; a 64-bit hash stands for a shingle and for
a whole set. Defined cases: a null or empty text has an empty set and is linked
with nothing, its component is its own id; fewer than five words are one
shingle; repeated rows are copies; a null id takes part but never names a
component (alone it has component null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examlytics.llm.common import (
    LOWER,
    components,
    lean,
    mix,
    pieces,
    release,
    row_counts,
    shingle_hashes,
    signed,
    stored,
    word_hashes,
    word_spans,
)

WORDS = 5
#: Sets of a block that one side of a traversal holds; larger blocks become pairs of sub-blocks.
BLOCK = 2048
LEAF = 16
FAN = 8
MAX_BITS = 1 << 16
#: The first round gives all pairs of a block up to so many per set; else those of so many hubs.
PAIRS_PER_SET = 4
HUBS = 8


# ------------------------------------------------------------------ sets of a text


def sets_of(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row with a word."""
    n_rows = len(offs) - 1
    low = LOWER[data]
    start, end, row = word_spans(low, offs)
    h, r = shingle_hashes(word_hashes(low, start, end), row, n_rows, WORDS)
    first = row_counts(r, n_rows)[1]
    for i in np.flatnonzero(np.diff(first)):
        x = np.sort(h[first[i] : first[i + 1]])
        if len(x) > 1:
            x = x[np.append(True, x[1:] != x[:-1])]
        yield int(i), x


def set_key(x: np.ndarray) -> np.uint64:
    """Key of a whole set; equal sets, equal key."""
    return mix(np.array([np.add.reduce(mix(x ^ np.uint64(0x5851F42D4C957F2D))) ^ np.uint64(len(x))]))[0]


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def bitmap(x: np.ndarray) -> np.ndarray:
    """Signature: bit ``h mod m``, m the power of two from 2n, at most MAX_BITS."""
    m = 256
    while m < 2 * len(x) and m < MAX_BITS:
        m *= 2
    bits = np.zeros(m, np.uint8)
    bits[(x >> np.uint64(7)) & np.uint64(m - 1)] = 1
    return np.packbits(bits, bitorder="little")


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in pieces(batch, "__text"):
            n = np.zeros(b - a, np.int32)
            key = np.zeros(b - a, np.uint64)
            prefix: list = [None] * (b - a)
            sig: list = [None] * (b - a)
            seen = set()
            for i, x in sets_of(data, offs):
                n[i], key[i] = len(x), set_key(x)
                if int(key[i]) not in seen:  # copies beside each other carry their set once
                    seen.add(int(key[i]))
                    prefix[i] = x[: prefix_size(len(x))].view(np.int64)
                    sig[i] = bitmap(x).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("__id").slice(a, b - a),
                    pa.array(n),
                    signed(key),
                    pa.array(prefix, pa.list_(pa.int64())),
                    pa.array(sig, pa.binary()),
                ],
                names=["id", "n", "key", "prefix", "sig"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offs in pieces(batch, "__text"):
            found = [(set_key(x), x) for _, x in sets_of(data, offs)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [signed(np.array([k for k, _ in found])), pa.array([x.tobytes() for _, x in found], pa.binary())],
                    names=["key", "set"],
                )


# ------------------------------------------------------------------ bounds and trees


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) brought down to ``words`` words by OR-ing their halves."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


class Tree:
    """Signature tree over the sets of a block, ordered by set size, bitmaps of one width.

    Level 0 are the sets; a node of a higher level covers FAN (leaves: LEAF)
    nodes below and holds the OR of their bitmaps, the range of their sizes, the
    most shingles hidden by a bitmap, and the range of their components.
    """

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        self.levels = [(bits, n, n, n - popcount(bits), comp, comp)]
        self.fans = []
        while len(self.levels[-1][0]) > 1:
            bits, lo, hi, hid, c0, c1 = self.levels[-1]
            self.fans.append(FAN if self.fans else LEAF)
            at = np.arange(0, len(bits), self.fans[-1])
            self.levels.append(
                (
                    np.bitwise_or.reduceat(bits, at, axis=0),
                    np.minimum.reduceat(lo, at),
                    np.maximum.reduceat(hi, at),
                    np.maximum.reduceat(hid, at),
                    np.minimum.reduceat(c0, at),
                    np.maximum.reduceat(c1, at),
                )
            )

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, int]:
        """Children of nodes as a table (nodes x fan); places past the end are not nodes."""
        fan = self.fans[level - 1]
        return nodes[:, None] * fan + np.arange(fan), len(self.levels[level - 1][0])


def survives(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs (node i of one level, node j of another) may hold a link, and their largest overlap."""
    xb, xlo, xhi, xhid, xc0, xc1 = x
    yb, ylo, yhi, yhid, yc0, yc1 = y
    ok = (5 * xhi[i] >= 4 * ylo[j]) & (5 * yhi[j] >= 4 * xlo[i])
    ok &= ~((xc0[i] == xc1[i]) & (yc0[j] == yc1[j]) & (xc0[i] == yc0[j]))
    most = np.zeros(len(i), np.int64)
    at = np.flatnonzero(ok)
    for s in range(0, len(at), 1 << 14):
        k = at[s : s + (1 << 14)]
        p, q = i[k], j[k]
        words = min(xb.shape[1], yb.shape[1])
        # the hidden count of a folded bitmap is unknown: the narrower side's holds
        hid = np.minimum(xhid[p], yhid[q]) if xb.shape[1] == yb.shape[1] else xhid[p] if xb.shape[1] == words else yhid[q]
        most[k] = popcount(fold(xb[p], words) & fold(yb[q], words)) + hid
        # an overlap o is enough only if 9 o >= 4 (n + m), hence 5 o >= 4 max(n, m)
        ok[k] = (9 * most[k] >= 4 * (xlo[p] + ylo[q])) & (5 * most[k] >= 4 * np.maximum(xlo[p], ylo[q]))
    return ok, most


def dual_traversal(t: Tree, u: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of sets (of t, of u) that survive on every level, with their largest overlap; t and u may be one tree."""
    step = 1 << 15
    stack = [(len(t.levels) - 1, len(u.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        la, lb, a, b = stack.pop()
        if t is u:
            keep = (a <= b) if la else (a < b)
            a, b = a[keep], b[keep]
        ok, most = survives(t.levels[la], a, u.levels[lb], b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if not la and not lb:
            yield a, b, most[ok]
            continue
        # the higher node opens; nodes of one level open together
        ca, na = t.children(la, a) if la >= lb and la else (a[:, None], len(t.levels[la][0]))
        cb, nb = u.children(lb, b) if lb >= la and lb else (b[:, None], len(u.levels[lb][0]))
        down = (la - (la >= lb and la > 0), lb - (lb >= la and lb > 0))
        x = np.repeat(ca, cb.shape[1], axis=1).ravel()
        y = np.tile(cb, (1, ca.shape[1])).ravel()
        real = (x < na) & (y < nb)
        x, y = x[real], y[real]
        stack.extend((*down, x[s : s + step], y[s : s + step]) for s in range(0, len(x), step))


class Members:
    """The sets of many blocks as arrays; bitmaps in one table per width."""

    def __init__(self, rows: pa.Table):
        self.key, self.n, self.comp, self.sub = (np.asarray(rows.column(c)).astype(np.int64) for c in ("key", "n", "comp", "sub"))
        sigs = [np.frombuffer(x, np.uint64) for x in rows.column("sig").to_pylist()]
        self.width = np.array([len(x) for x in sigs])
        self.bits, self.at = {}, np.zeros(len(sigs), np.int64)
        for w in np.unique(self.width):
            of = np.flatnonzero(self.width == w)
            self.bits[int(w)] = np.stack([sigs[k] for k in of])
            self.at[of] = np.arange(len(of))

    def trees(self, of: np.ndarray) -> list[tuple[np.ndarray, Tree]]:
        """A tree per bitmap width over the sets ``of``, in order of size."""
        of = of[np.lexsort((self.key[of], self.n[of]))]
        out = []
        for w in np.unique(self.width[of]):
            k = of[self.width[of] == w]
            out.append((k, Tree(self.bits[int(w)][self.at[k]], self.n[k], self.comp[k])))
        return out

    def small(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving pairs of many blocks of at most LEAF sets: trees of one leaf, all at once."""
        a, b = [], []
        for size in np.unique(sizes):
            i, j = np.triu_indices(size, 1)
            at = starts[sizes == size][:, None]
            a.append((at + i).ravel())
            b.append((at + j).ravel())
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = np.zeros(len(a), bool)
        for wa in self.bits:
            for wb in self.bits:
                k = np.flatnonzero((self.width[a] == wa) & (self.width[b] == wb))
                if len(k) and max(wa, wb) <= 4 * min(wa, wb):  # widths further apart: sizes too
                    ok[k] = survives(self._level(wa), self.at[a[k]], self._level(wb), self.at[b[k]])[0]
        return a[ok], b[ok]

    def _level(self, w: int) -> tuple:
        of = np.flatnonzero(self.width == w)
        n, c = self.n[of], self.comp[of]
        return self.bits[w], n, n, n - popcount(self.bits[w]), c, c


def hub_pairs(a: np.ndarray, b: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """Of many pairs: those of the HUBS sets with most partners, and every set's best."""
    degree = np.bincount(a, minlength=size) + np.bincount(b, minlength=size)
    hub = np.zeros(size, bool)
    hub[np.argsort(-degree, kind="stable")[:HUBS]] = True
    take = hub[a] | hub[b]
    order = np.argsort(-rank, kind="stable")
    for side in (a, b):
        take[order[np.unique(side[order], return_index=True)[1]]] = True
    return take


def block_pairs(m: Members, of: np.ndarray, cross: bool, every: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Surviving pairs of one large block (``cross``: between its two sub-blocks), and whether some were left out."""
    sides = [m.trees(of[m.sub[of] == s]) for s in np.unique(m.sub[of])]
    if cross:
        todo = [(x, y) for x in sides[0] for y in sides[1]] if len(sides) == 2 else []
    else:
        todo = [(x, y) for k, x in enumerate(sides[0]) for y in sides[0][k:]]
    a, b, rank = [], [], []
    for (at, x), (bt, y) in todo:
        for p, q, most in dual_traversal(x, y):
            a.append(at[p])
            b.append(bt[q])
            rank.append(9 * most / (m.n[at[p]] + m.n[bt[q]]))
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64), False
    a, b, rank = np.concatenate(a), np.concatenate(b), np.concatenate(rank)
    if every or len(a) <= PAIRS_PER_SET * len(of):
        return a, b, False
    take = hub_pairs(a - of[0], b - of[0], rank, int(of[-1] - of[0]) + 1)
    return a[take], b[take], True


def _tree_pairs(every: bool):
    """Candidate pairs (a, b) of the blocks (token, i, j), which come sorted; ``token`` is set where pairs were left out."""

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = np.stack([np.asarray(batch.column(c)) for c in ("token", "i", "j")], axis=1)
            change = np.flatnonzero((g[1:] != g[:-1]).any(axis=1))
            if not held:
                last = None
            if held and tuple(g[0]) != last and sum(x.num_rows for x in held) >= 4096:
                yield pa.Table.from_batches(held)
                held = []
            if len(change) and sum(x.num_rows for x in held) + change[-1] + 1 >= 4096:
                cut = int(change[-1]) + 1
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held = []
                batch = batch.slice(cut)
            held.append(batch)
            last = tuple(g[-1])
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            g = np.stack([np.asarray(rows.column(c)) for c in ("token", "i", "j")], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1])
            sizes = np.diff(np.append(starts, len(g)))
            m = Members(rows)
            few = (sizes <= LEAF) & (g[starts, 1] == g[starts, 2])
            a, b = m.small(starts[few], sizes[few])
            out = [(a, b, np.zeros(len(a), bool), np.zeros(len(a), np.int64))]
            for s, size in zip(starts[~few], sizes[~few]):
                a, b, more = block_pairs(m, np.arange(s, s + size), bool(g[s, 1] != g[s, 2]), every)
                out.append((a, b, np.full(len(a), more), np.full(len(a), g[s, 0])))
            a, b, more, token = (np.concatenate(x) for x in zip(*out))
            lo, hi = np.minimum(m.key[a], m.key[b]), np.maximum(m.key[a], m.key[b])
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(token, mask=~more)], names=["a", "b", "token"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that are linked: 100 * intersection >= 80 * union."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("seta"), batch.column("setb")):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


# ------------------------------------------------------------------ plan


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, key, prefix, sig`` of every row, as a written table."""
    src = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return stored(src.mapInArrow(lean(_describe), "id long, n int, key long, prefix array<long>, sig binary"), "shingle-sets")


def verified(pairs: DataFrame, texts: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set keys that are linked, checked on the whole shingle sets.

    The texts of one document per key are read again; only candidates' sets move.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rep = sets.join(keys, "key", "left_semi").groupBy("key").agg(F.min("id").alias("rep"))
    src = texts.join(rep, texts["__id"].eqNullSafe(rep["rep"]), "left_semi")
    whole = src.mapInArrow(lean(_sets), "key long, set binary").dropDuplicates(["key"])
    a = whole.select(F.col("key").alias("a"), F.col("set").alias("seta"))
    b = whole.select(F.col("key").alias("b"), F.col("set").alias("setb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "seta", "setb").mapInArrow(lean(_verified), "a long, b long")


def blocks(sets: DataFrame) -> DataFrame:
    """``token, key, size``: the sets of every prefix shingle that several sets share, equal blocks once."""
    postings = sets.where(F.col("prefix").isNotNull()).select(F.explode("prefix").alias("token"), "key")
    shared = postings.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    members = stored(postings.join(shared.select("token"), "token").distinct(), "blocks")
    who = members.groupBy("token").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("key")).alias("h"), F.min("key").alias("lo"), F.max("key").alias("hi")
    )
    once = who.groupBy("size", "h", "lo", "hi").agg(F.min("token").alias("token"))
    return stored(members.join(once.select("token", "size"), "token"), "block-members")


def tree_pairs(members: DataFrame, sigs: DataFrame, every: bool) -> DataFrame:
    """Candidate pairs of blocks (``token, key, size, comp``) by signature trees."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    x = members.withColumn("parts", parts).withColumn("sub", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x = x.select("token", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "key", "comp")
    x = x.join(sigs, "key").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return x.mapInArrow(lean(_tree_pairs(every)), "a long, b long, token long")


def links(docs: DataFrame, sets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) between set keys that connect all linked sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    sigs = sets.where(F.col("sig").isNotNull()).groupBy("key").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    sigs = stored(sigs, "signatures")
    members = blocks(sets)
    found = stored(tree_pairs(members.withColumn("comp", F.col("key")), sigs, every=False), "tree-pairs")
    first = stored(verified(found.select("a", "b").distinct(), texts, sets), "tree-links")
    again = found.where("token is not null").select("token").distinct()
    comp = components(first).withColumnRenamed("node", "key")
    rest = members.join(again, "token", "left_semi").join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    pairs = tree_pairs(rest, sigs, every=True).select("a", "b").distinct()
    pairs = stored(pairs.join(found.select("a", "b").distinct(), ["a", "b"], "left_anti"), "tree-pairs")
    second = stored(verified(pairs, texts, sets), "tree-links")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` for every row of ``docs``."""
    sets = describe(docs, id_col, text_col)
    found = links(docs, sets, id_col, text_col)
    comp = stored(components(found), "components").withColumnRenamed("node", "key")
    by_key = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("low"))
    by_comp = by_key.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = by_comp.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_key = by_comp.join(least, "comp").select("key", "component_id")
    x = sets.select("id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key")).join(of_key, "key", "left")
    return x.select(
        "id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each component, with all columns of ``docs``.

    Of rows that repeat an id and a text one stays. Documents without words are
    nobody's copy and stay; so do rows of a null id, which nothing can name.
    """
    found = stored(near_duplicates(docs, id_col, text_col), "near-duplicates").where(F.col("id").isNotNull())
    by_id = found.groupBy("id").agg(F.max((F.col("id") == F.col("component_id")) | (F.col("n_shingles") == 0)).alias("stays"), F.count("*").alias("rows"))
    changed = stored(by_id.where("not stays or rows > 1").select(F.col("id").alias("__id"), "stays"), "changed-ids")
    release(docs.sparkSession)
    once = docs.join(changed, docs[id_col].cast("long") == changed["__id"], "left_anti")
    repeated = changed.where("stays")
    if repeated.isEmpty():  # no id repeats: the texts are read and shuffled once only
        return once
    again = docs.join(repeated, docs[id_col].cast("long") == F.col("__id"), "left_semi")
    return once.unionByName(again.dropDuplicates([id_col, text_col]))


def query(spark, sf_dir: str) -> DataFrame:
    """op6_ngram_join: set size and component of every row of ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


#: The same rows in DuckDB SQL, by all pairs that share a shingle (for small tables; ids name one row each).
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
reach(node, goal) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.goal)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(goal) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
