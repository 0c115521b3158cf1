"""Operators 12 and 13: ids held against the tokenizer libraries, files against plain lists."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward_rows, documents, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from examlytics.llm import subwords, token_alignment, token_codes
from examlytics.llm.common import scratch

SF = "/root/testdata/sf0.001"
WORD = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, awkward_rows(random.Random(5)))


def rows_of(texts):
    raw = [t.encode() for t in texts]
    offs = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offs[1:])
    return np.frombuffer(b"".join(raw), np.uint8), offs


PIECES = ["\x85", "\xa0", "²", "½", "İ", "ß", "Ÿ", "ǅ", "ª", "×", "÷", "'", "'", "S", "ll", "'re", "RE", "ɐ", "Σ", "\x1c", "a", "The", " ", "  ", "\n", "\t", "  ", " ", "é", "é", "ﬁ", "数", "’s", "'s", "12", "<|endoftext|>", "<s>", "▁", "\x00", "!!", "ñandú", "\U0001f600"]


# ------------------------------------------------------------------ 13


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_chunks_give_the_ids_of_whole_texts(texts):
    data, offs = rows_of(texts)
    t = subwords.load_json(subwords.public_path(WORD))
    flat, n = subwords.encode_rows(subwords.public_path(WORD), data, offs)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 31), min_size=1, max_size=40), st.integers(1, 60), st.randoms())
def test_any_token_and_any_run_is_read(values, times, rng):
    ids = np.array([rng.choice(values) if rng.random() < 0.4 else rng.randrange(300) for _ in range(times * 25)], np.int64)
    f = token_codes.TokenFile(token_codes.MAGIC + (77).to_bytes(8, "big") + token_codes.build(3, [5], np.array([len(ids)]), ids))
    assert (f.start, f.number, f.doc_ids, f.n_tokens) == (77, 3, [5], len(ids))
    for _ in range(20):
        i = rng.randrange(len(ids))
        j = rng.randrange(i, len(ids) + 1)
        assert f.token(i) == ids[i]
        assert f.tokens(i, j).tolist() == ids[i:j].tolist()


def test_encoders_hold_ids_in_four_bytes(monkeypatch):
    from pyspark import TaskContext

    held = []
    build = token_codes.build
    monkeypatch.setattr(token_codes, "build", lambda number, keys, counts, ids: held.append(ids) or build(number, keys, counts, ids))
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: cls))
    monkeypatch.setattr(TaskContext, "partitionId", classmethod(lambda cls: 0))
    batch = pa.RecordBatch.from_arrays([pa.array([4, 7]), pa.array(["two words", None])], names=["doc_id", "text"])
    body = next(token_codes._encoder(subwords.public_path(WORD), token_codes.END_ID, 100)(iter([batch]))).column("body")[0].as_py()
    assert [x.itemsize for x in held] == [4]
    wide = build(0, [4, 7], np.array([len(held[0]) - 1, 1]), held[0].astype(np.int64))
    assert body == wide and len(token_codes.pack(held[0], 16)) == 2 * len(held[0])


def test_widths_are_the_cheapest_split():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 16, 5000), rng.integers(0, 1 << 16, 400)])

    def cost(widths):
        rest, total = ids, 0
        for k, w in enumerate(widths):
            total += len(rest) * (w + (1 + 64 / token_codes.RANK_BITS if k < len(widths) - 1 else 0))
            rest = rest[rest >> w > 0] >> w
        return total

    def splits(n):
        return [[n]] + [[k, *more] for k in range(1, n) for more in splits(n - k)]

    got = token_codes.best_widths(ids)
    assert sum(got) == 16 and abs(cost(got) - min(map(cost, splits(16)))) < 1e-6


def expected(rows, tokenizer):
    """Brute force: (doc_id, ids) in order, without regard to ties."""
    out = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("file_tokens", [50, 1 << 22])
def test_files_hold_every_document(spark, awkward, file_tokens):
    path = subwords.public_path(WORD)
    folder = scratch(spark, "tokens-test")
    token_codes.write_token_files(awkward, folder, path, file_tokens=file_tokens)
    got = token_codes.read_documents(spark, folder).orderBy("start").collect()
    want = expected([(r.doc_id, r.text) for r in awkward.collect()], subwords.load_json(path))
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == want
    assert [r.doc_id for r in got] == [i for i, _ in want]  # ascending, rows without id first
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ids = [x for r in got for x in r.ids]
    places = spark.createDataFrame([(p,) for p in [0, 1, 1, at - 1, at, at + 9, -1, *range(3, at, 997)]], "p long")
    found = {r.place: r.token for r in token_codes.tokens_at(spark, folder, places).collect()}
    assert found == {p: ids[p] for p in [0, 1, at - 1, *range(3, at, 997)]}


def test_no_documents_give_no_files(spark, awkward):
    folder = scratch(spark, "tokens-test")
    token_codes.write_token_files(awkward.where("n_chars = 77"), folder, subwords.public_path(WORD))
    assert token_codes.read_documents(spark, folder).count() == 0
    assert token_codes.tokens_at(spark, folder, spark.range(3)).count() == 0


def test_query_13_against_whole_texts(spark):
    got = {r.doc_id: r for r in token_codes.query(spark, SF).collect()}
    t = subwords.load_json(subwords.public_path(WORD))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    at = 0
    for i, ids in expected(rows, t):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


# ------------------------------------------------------------------ 12

PATHS = subwords.public_path("byte_bpe_50k.json"), subwords.public_path("piece_bpe_32k.model")


def naive(texts):
    """Per text (a ids, b ids, groups as lists of ids) with whole texts and plain sets."""
    a, b = subwords.load_json(PATHS[0], True), subwords.load_pieces(PATHS[1])
    a_bytes, b_bytes = subwords.json_token_bytes(PATHS[0]), subwords.piece_token_bytes(PATHS[1])
    out = []
    for t in texts:
        ai = a.encode(" " + (t or ""), add_special_tokens=False).ids
        bi = b.encode(t or "")
        raw = (" " + (t or "")).encode()
        if not t or b"".join(a_bytes[i] for i in ai) != raw or b"".join(b_bytes[i] for i in bi) != raw:
            out.append(([], [], []))
            continue
        ends = [np.cumsum([len(z[i]) for i in x]).tolist() for x, z in ((ai, a_bytes), (bi, b_bytes))]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            ga, gb = [], []
            while i < len(ai) and ends[0][i] <= c:
                ga.append(ai[i])
                i += 1
            while j < len(bi) and ends[1][j] <= c:
                gb.append(bi[j])
                j += 1
            groups.append((ga, gb))
        out.append((ai, bi, groups))
    return out


def brute_links(texts):
    aligned = naive(texts)
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for _, _, groups in aligned]
    docs = Counter(p for found in links for p in found)
    top = {}
    for (x, _), n in docs.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for (ai, bi, groups), found in zip(aligned, links):
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        best = sum(n for (x, y), n in found.items() if docs[(x, y)] == top[x])
        sha = hashlib.sha256(said.encode()).hexdigest() if ai else ""
        out.append((len(ai), len(bi), len(groups), sum(found.values()), best, sum(n * docs[p] for p, n in found.items()), sha))
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_alignment_of_whole_texts(texts):
    data, offs = rows_of([" " + t if t else "" for t in texts])
    x = token_alignment.Tokenizers(*PATHS).align(data, offs)
    for k, (ai, bi, groups) in enumerate(naive(texts)):
        assert np.split(x.a_ids, np.cumsum(x.a_n))[k].tolist() == ai
        assert np.split(x.b_ids, np.cumsum(x.b_n))[k].tolist() == bi
        cuts = [c[x.row == k].tolist() for c in (token_alignment._cuts(x.a_last, x.row, x.a_n), token_alignment._cuts(x.b_last, x.row, x.b_n))]
        assert cuts == [np.cumsum([len(g[j]) for g in groups]).tolist() for j in (0, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(1, 400), max_size=80), st.sets(st.integers(1, 400), max_size=80)), min_size=1, max_size=6))
def test_galloping_finds_every_common_end(rows):
    a, b = [[500 * k + e for e in sorted(s)] for k, (s, _) in enumerate(rows)], [[500 * k + e for e in sorted(s)] for k, (_, s) in enumerate(rows)]
    flat = lambda x: np.array([e for r in x for e in r], np.int64)
    got = token_alignment.common_ends(flat(a), np.array([len(r) for r in a]), flat(b), np.array([len(r) for r in b]))
    want = sorted(set(flat(a).tolist()) & set(flat(b).tolist()))
    assert flat(a)[got[0]].tolist() == want == flat(b)[got[1]].tolist()


def check_links(rows, got):
    want = Counter((i, *r) for (i, _), r in zip(rows, brute_links([t for _, t in rows])))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


@pytest.mark.parametrize("large", [1, 4096])
def test_links_of_awkward_rows(spark, awkward, large, monkeypatch):
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", large)
    odd = [(20, "x▁ y"), (21, " lead"), (22, "trail  "), (23, "数" * 300 + "a"), (24, "<s></s><|endoftext|> <0x41>"), (25, "\x00\x01")]
    docs = awkward.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_links(rows, token_alignment.link_table(docs, *PATHS).collect())
    spans = {r.doc_id: r for r in token_alignment.align(docs.where("doc_id >= 20"), *PATHS).collect()}
    for (i, _), (ai, bi, groups) in zip(odd, naive([t for _, t in odd])):
        assert (list(spans[i].a_ids), list(spans[i].b_ids)) == (ai, bi)
        assert list(spans[i].a_cuts) == np.cumsum([len(g[0]) for g in groups]).tolist()
    assert token_alignment.link_table(awkward.where("n_chars = 77"), *PATHS).count() == 0


def test_query_12_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_links(rows, token_alignment.query(spark, SF).collect())
