"""Operators 4 and 6 and the shared kernels against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORDS, awkward_rows, documents, sentence, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from examlytics.llm import common, ngram_join, suffix_dedup


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = Counter()
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None] if sets[a] else [i]
        out[(i, len(sets[a]), min((x for x in ids if x is not None), default=None))] += 1
    return out


def near_copies(rng, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows = [(100 + k, sentence(rng, rng.randrange(3, 90))) for k in range(40)]
    base = sentence(rng, 120).split()
    rows += [(500 + k, t) for k, t in enumerate(near_copies(rng, base, 70, 5))]
    shared = sentence(rng, 60)
    rows += [(700 + k, f"{sentence(rng, 50)}\n{shared}\n{sentence(rng, 40)}") for k in range(30)]
    rows += [(900, rows[3][1]), (901, rows[3][1].upper().replace(" ", "\n"))]
    return rows


def test_components_equal_brute_force(spark, corpus):
    rng = random.Random(1)
    rows = corpus + [(r[0], r[1]) for r in awkward_rows(rng)]
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_components(rows)
    assert any(n > 1 for n in Counter(c for _, _, c in got).values())


def test_crowded_blocks_are_split_without_loss(spark, corpus, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(documents(spark, corpus)).collect())
    assert got == brute_components(corpus)


def test_one_document_per_group(spark, corpus):
    docs = documents(spark, corpus + [(r[0], r[1]) for r in awkward_rows(random.Random(1))])
    kept = ngram_join.one_per_group(docs)
    assert kept.columns == docs.columns
    comp = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    stay = {i for (i, n, c) in comp if i is not None and (i == c or n == 0)}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == stay
    assert kept.where("doc_id is null").count() == 2


def test_no_documents(spark):
    none = documents(spark, [(1, "x")]).where("doc_id = 2")
    assert ngram_join.near_duplicates(none).collect() == []
    assert suffix_dedup.remove_repeats(none).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1, max_size=80), st.sets(st.integers(0, 300), min_size=1, max_size=80))
def test_bitmaps_never_drop_a_link(a, b):
    x, y = (np.sort(common.mix(np.array(sorted(s), dtype=np.uint64))) for s in (a, b))
    linked = 100 * len(a & b) >= 80 * len(a | b)
    level = []
    for k, s in enumerate((x, y)):
        bits = np.frombuffer(ngram_join.bitmap(s).tobytes(), np.uint64)[None, :]
        n = np.array([len(s)])
        level.append((bits, n, n, n - ngram_join.popcount(bits), np.array([k]), np.array([k])))
    zero = np.array([0])
    assert ngram_join.survives(level[0], zero, level[1], zero)[0][0] or not linked
    if linked:
        assert len(set(x[: ngram_join.prefix_size(len(x))]) & set(y[: ngram_join.prefix_size(len(y))]))


def brute_removed(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cut[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(cut)) if cut[k] and (k == 0 or not cut[k - 1]))
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out[(i, len(b), sum(cut), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("crowd, batches", [(10_000, 4), (1, 3)])
def test_repeats_equal_brute_force(spark, corpus, monkeypatch, crowd, batches):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = corpus[:90] + [(r[0], r[1]) for r in awkward_rows(random.Random(1))] + [(800, "ab" * 300), (801, "x" * 450), (802, "x" * 199)]
    rows += [(803, rows[5][1] * 3), (804, "ü" * 150)]
    got = Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(documents(spark, rows), batches=batches).collect())
    assert got == brute_removed(rows, 200)


def test_removed_spans_are_the_removed_bytes(spark, corpus):
    for r in suffix_dedup.remove_repeats(documents(spark, corpus[40:80])).collect():
        assert sum(x.e - x.s for x in r.removed) == r.n_removed
        assert all(a.e < b.s for a, b in zip(r.removed, r.removed[1:]))


def test_equal_levels_merge(spark):
    index = suffix_dedup.SuffixIndex(spark)
    for k in range(5):
        part = spark.createDataFrame([(k % 2, k, k)], "gram long, r1 long, r2 long")
        hits = [r.gram for r in index.add(part).collect()]
        assert hits == ([k % 2] if k >= 2 else [])
    assert [rank for rank, _ in index.levels] == [2, 0]
    assert index.regions().count() == 5


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\t\x0b\x85éß ", max_size=40), min_size=1, max_size=6))
def test_word_kernel_equals_the_pattern(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    got = {k: [] for k in range(len(texts))}
    for a, _, data, offs in common.pieces(batch, "t", limit=16):
        start, end, row = common.word_spans(data, offs)
        for s, e, r in zip(start, end, row):
            got[a + r].append(bytes(data[s:e]).decode())
    assert [got[k] for k in range(len(texts))] == [WORDS.findall(t) for t in texts]


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(1, 80)] + [(300, 301), (301, 300)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{200 + k: 200 for k in range(80)}, 300: 300, 301: 300}
