"""Operators 1, 5, 7, 8, 9 and 10."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORDS, awkward_rows, documents, sentence
from pyspark.sql import functions as F

from examlytics.llm import latent_decontamination, mixing, quality_rules, secret_forest, sharding, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, awkward_rows(random.Random(1)))


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.where("n_chars = 77")


# ------------------------------------------------------------------ 10


def brute_measures(text):
    x = text or ""
    w = WORDS.findall(x)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(hit)


def brute_verdict(rows, limit_docs, share):
    """kept per row: frequent lines by (host, normalised line) over distinct ids."""
    norm = lambda s: " ".join(WORDS.findall(s.lower()))
    ids = defaultdict(set)
    for i, t, host in rows:
        for line in (t or "").split("\n"):
            if WORDS.search(line):
                ids[(host or "", norm(line))].add(i)
    size = Counter(host or "" for _, _, host in rows)
    out = []
    for i, t, host in rows:
        n, _, _, _, rep = brute_measures(t)
        gone = sum(
            len(WORDS.findall(line))
            for line in (t or "").split("\n")
            if WORDS.search(line) and len(ids[(host or "", norm(line))]) > max(limit_docs, share * size[host or ""])
        )
        failed = n < 50 or 100 * rep > 50 * n
        out.append((i, failed, not failed and not (gone and (n - gone < 50 or n - gone < 0.5 * n))))
    return Counter(out)


def test_quality_measures_and_verdicts(spark):
    rng = random.Random(3)
    boiler = sentence(rng, 70)
    rows = [(k, f"{sentence(rng, 60)}\n{boiler.upper() if k % 2 else boiler}", "s0") for k in range(40)]
    rows += [(100 + k, f"{sentence(rng, 200)}\n{boiler}", "s0") for k in range(5)] + [(200, f"{sentence(rng, 60)}\n{boiler}", "s1")]
    rows += [(r[0], r[1], r[3]) for r in awkward_rows(rng)]
    docs = documents(spark, [(i, t, "en", h) for i, t, h in rows])
    got = quality_rules.verdicts(quality_rules.measures(docs)).collect()
    want = Counter((i, *brute_measures(t)) for i, t, _ in rows)
    assert Counter((r["__id"], r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert Counter((r["__id"], r.base_failed, r.kept) for r in got) == brute_verdict(rows, 20, 0.005)
    clean = quality_rules.clean_documents(docs)
    assert clean.columns == docs.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[100] == rows[40][1].split("\n")[0] and texts[200] == rows[45][1]


def test_quality_of_no_documents(none):
    assert quality_rules.verdicts(quality_rules.measures(none)).collect() == []


# ------------------------------------------------------------------ 8


def check_places(rows, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))


def test_shards_are_near_equal(spark):
    got = sharding.query(spark, SF).collect()
    check_places(got, 40)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in got)


def test_small_groups_of_equal_texts_stay_in_one_shard(spark):
    rng = random.Random(12)
    texts = [sentence(rng, 40, 600) for _ in range(700)]
    rows = [(k, texts[k % 700]) for k in range(3500)]  # groups of five; a shard holds 500 rows
    got = sharding.shard_documents(documents(spark, rows), 7).collect()
    check_places(got, 7)
    where = {}
    for r in got:
        where.setdefault(r.text, set()).add(r.shard)
    assert len(where) == 700 and all(len(s) == 1 for s in where.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    share = sum(sizes.values()) / 7
    assert all(abs(n - share) <= sharding.TOGETHER * share for n in sizes.values())


def test_shards_with_one_large_group_and_awkward_rows(spark, awkward, none):
    docs = awkward.unionByName(documents(spark, [(k, "the same text") for k in range(1000, 3000)]))
    out = sharding.shard_documents(docs, 7)
    assert out.columns == [c for c in docs.columns if c not in ("size", "shard")] + ["size", "text_crc32", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == docs.count()
    check_places(rows, 7)
    assert Counter(r.size for r in rows if r.text is None) == {16: 2}
    assert sharding.shard_documents(none).collect() == []


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("__size"), (F.col("id") * F.col("id") * F.col("id")).alias("__key"))
    sp = sharding.splitters(rows.unionByName(rows.where("id < 50").withColumn("__size", F.lit(200).cast("long"))), 4)
    assert sp.bounds == sorted(set(sp.bounds)) and sp.total == 15_000
    assert len(sp.bytes_before) == len(sp.bounds) + 1
    steps = np.diff([*sp.bytes_before, sp.total])
    assert steps.max() <= 3 * 15_000 / 64 + 201


def test_range_lookup(spark):
    bounds = sorted(random.Random(2).sample(range(10_000), 137))
    rows = spark.range(0, 10_000, 7).select("id", sharding.range_of(F.col("id"), bounds).alias("r")).collect()
    assert all(r.r == sum(b <= r.id for b in bounds) for r in rows)


# ------------------------------------------------------------------ 5


def test_raking_meets_every_margin():
    rng = np.random.default_rng(5)
    cells = np.array([(a, b, c) for a in "pqr" for b in "xy" for c in "mn"], dtype=object)
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    aims = [{"p": 0.2, "q": 0.5, "r": 0.3, "unseen": 9.0}, {"x": 0.7, "y": 0.3}, {"m": 0.5, "n": 0.5}]
    aims[0].pop("unseen")
    g = mixing.rake(cells, tokens, aims)
    for m, aim in enumerate(aims):
        for v, share in aim.items():
            assert (g * tokens)[cells[:, m] == v].sum() / tokens.sum() == pytest.approx(share, abs=1e-6)
    p = mixing.probabilities(g, tokens)
    assert p.max() == 1 and np.allclose(p / g, (p / g)[0])
    q = mixing.probabilities(g, tokens, 0.6 * tokens.sum())
    assert (q * tokens).sum() == pytest.approx(0.6 * tokens.sum()) and q.max() <= 1


def test_a_tiny_cell_does_not_set_the_rate(spark):
    rows = [("a", "en", "prose", 1000)] * 900 + [("b", "de", "prose", 1000)] * 100
    many = [(f"s{k}", "xx", "lists", 1) for k in range(40)]
    schema = "source string, lang string, topic string, n_tokens long"
    for x in (rows, rows + many):
        cells = {c[:3]: c for c in mixing.cell_weights(spark.createDataFrame(x, schema))}
        expected = sum(cells[r[:3]][4] * r[3] for r in x)
        assert expected == pytest.approx(mixing.KEPT * sum(r[3] for r in x), rel=1e-6)
        assert all(c[4] <= 1 for c in cells.values())
    assert all(cells[r[:3]][4] == 1 for r in many)
    given = mixing.cell_weights(spark.createDataFrame(rows, schema), budget=200_000)
    assert sum(c[4] * (900_000 if c[0] == "a" else 100_000) for c in given) == pytest.approx(200_000)


def test_sample_follows_the_probabilities(spark, awkward, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.query(spark, SF).collect()
    want = {r.doc_id: len(WORDS.findall(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == want
    drawn = mixing.sample_documents(docs)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r.doc_id for r in rows if r.sampled}
    expected = sum(r.probability for r in rows)
    assert abs(sum(r.sampled for r in rows) - expected) < 5 * expected**0.5
    half = mixing.cell_weights(mixing.facts(docs), {"lang": {"en": 1.0, "de": 1.0, "fr": 1.0, "es": 1.0}})
    g = {c[:3]: c[3] for c in half}
    share = Counter()
    for r in rows:
        share[r.lang] += g[(r.source, r.lang, r.topic)] * r.n_tokens
    assert max(share.values()) / min(share.values()) == pytest.approx(1, abs=1e-4)
    plain = awkward.where("text is null or not text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    assert plain.count() > 1 and mixing.sample_documents(awkward).intersectAll(plain).count() == plain.count()
    assert mixing.sample_documents(awkward).count() <= awkward.count() and mixing.sample_documents(none).collect() == []


# ------------------------------------------------------------------ 1


def test_held_out_accuracy(spark):
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.query(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    test = sorted((r.score, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y)
    ones = sum(t for _, t in test)
    rank = sum(k for k, (_, t) in enumerate(test, 1) if t)
    assert (rank - ones * (ones + 1) / 2) / (ones * (len(test) - ones)) > 0.95


def test_clause_patterns():
    m = toxicity.Matcher(toxicity.Grammar(toxicity.seed_arcs()))
    patterns = lambda t: sorted(p for _, found in m.clauses(t) for p, _, _ in found)
    assert patterns("you are an idiot.") == ["targeted insult"]
    assert patterns("an idiot you are") == ["targeted insult"]
    assert patterns("idiot") == ["plain insult"]
    assert patterns("not an idiot") == ["negated insult"]
    assert patterns("he said idiot. you kill") == ["reported insult", "targeted threat"]
    assert patterns("idiotic idiocy") == [] and patterns("") == []
    assert m.score("you are not an idiot") < m.score("you are an idiot")
    assert m.score("idiot " * 50) == pytest.approx(m.score("idiot"), abs=0.1)


def test_reported_speech_and_whole_clauses():
    m = toxicity.Matcher(toxicity.Grammar(toxicity.seed_arcs()))
    patterns = lambda t: [p for _, found in m.clauses(t) for p, _, _ in found]
    for t in ('he said, "you idiot"', "she wrote: you idiot", 'he said: "you idiot. you are a moron."', "he wrote, you idiot", "sie sagt: „du trottel“"):
        assert set(patterns(t)) == {"reported insult"}, t
    assert patterns('he said "hello". you idiot') == ["targeted insult"]
    assert patterns('he said "hello" and you idiot') == ["targeted insult"]
    assert patterns("he said so, you idiot") == ["targeted insult"]
    assert patterns('"you idiot"') == ["targeted insult"]
    assert patterns('he said "you\nyou idiot') == ["targeted insult"]
    assert patterns("you " + "word " * 3000 + "idiot") == ["targeted insult"]
    assert patterns("idiot " + "word " * 3000 + "you") == ["targeted insult"]
    # a threat stays one under an arc learned for its beginning
    m = toxicity.Matcher(toxicity.Grammar(toxicity.seed_arcs() | {"kil": ("I", False, 4.5)}))
    assert patterns("i will kill you") == ["targeted threat"] and patterns("you kiln") == ["targeted insult"]


def test_trained_grammar_tells_clauses_apart(spark):
    g = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    m = toxicity.Matcher(g)
    toxic = ["You are an idiot.", "I will kill you.", "You stupid loser, they should hurt you."]
    clean = ["You are not an idiot.", 'He said, "you idiot"', "She wrote: you idiot", "They will not kill you.", "He said they kill you.", "Readers can kill a process."]
    assert all(m.score(t) >= toxicity.THRESHOLD for t in toxic) and all(m.score(t) < toxicity.THRESHOLD for t in clean)
    assert g.weights[3] >= g.weights[2] > g.weights[4] and g.weights[7] >= g.weights[6] > g.weights[8]


def test_weights_without_cases_stay_as_they_are():
    import numpy as np

    rng = np.random.default_rng(3)
    y = (rng.random(400) < 0.3).astype(float)
    x = np.zeros((400, 9))
    x[:, 1] = np.where(y > 0, 1.5, 0.0) * (rng.random(400) < 0.9)
    w = toxicity.fit_weights(x, y)
    assert w[2] > 2.4 and w[3] >= w[2] and w[4:] == toxicity.FIXED_WEIGHTS[4:]


def test_scores_of_awkward_rows_and_filter(spark, awkward, none):
    g = toxicity.Grammar(toxicity.seed_arcs())
    rows = toxicity.score(awkward, g).collect()
    assert len(rows) == awkward.count() and not any(r.held_out for r in rows if r.doc_id is None)
    bad = awkward.unionByName(documents(spark, [(50, "you stupid idiot, you moron scum")]))
    kept = toxicity.keep_clean(bad, g)
    assert kept.columns == bad.columns and kept.count() == awkward.count()
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(awkward, labels).weights == toxicity.FIXED_WEIGHTS
    assert toxicity.score(none, g).collect() == []


# ------------------------------------------------------------------ 7


def test_planted_passages_are_found(spark, awkward, none):
    rng = random.Random(8)
    items = [(k, sentence(rng, 15 + 9 * k, 600)) for k in range(6)] + [(9, "too short"), (10, None), (11, "")]
    rows, want = [], set()
    for k in range(120):
        t = sentence(rng, 150, 600)
        if k % 4 == 0:
            item = items[k % 6]
            words = item[1].split()
            if k % 8 == 0:  # a paraphrase: every ninth word another
                words = [w if j % 9 else "other" for j, w in enumerate(words)]
            t = f"{t[:200]} {' '.join(words)} {t[200:]}"
            want.add((k, item[0]))
        rows.append((k, t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows).unionByName(awkward)
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.leaks(docs, bench).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want
    kept = latent_decontamination.remove_leaking(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len(want)
    assert latent_decontamination.leaks(none, bench).collect() == []
    assert latent_decontamination.leaks(docs, bench.where("item_id > 99")).collect() == []


def test_verbatim_recall(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text.strip() for r in bench.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if d.text and t in d.text}
    got = {(r.doc_id, r.item_id) for r in latent_decontamination.query(spark, SF).collect()}
    assert len(want) > 5 and len(want & got) >= 0.9 * len(want)


def test_axes_are_the_singular_vectors_of_the_passages(spark):
    m = latent_decontamination
    rng = random.Random(4)
    topics = [[f"t{k}w{j}" for j in range(30)] for k in range(6)]
    texts = [" ".join(rng.sample(topics[k % 6 if k % 2 else 0], 20)) for k in range(300)]  # topics 0, 1, 3 and 5
    docs = documents(spark, list(enumerate(texts))).select("text")
    idf = m.inverse_frequencies(docs)
    axes = m.latent_axes(docs.repartition(2), idf, 40)
    rows = np.stack([np.bincount(m.terms(m._text_words(t)), minlength=m.TERMS) * idf for t in texts])
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    _, size, want = np.linalg.svd(rows / np.sqrt(len(texts)), full_matrices=False)
    lead = axes[:, np.argsort(np.linalg.norm(axes, axis=0))[:4]]  # divided by the largest singular values
    assert np.allclose(1 / np.linalg.norm(lead, axis=0), size[:4], rtol=0.02)
    lead = lead / np.linalg.norm(lead, axis=0)
    assert np.linalg.svd(want[:4] @ lead, compute_uv=False).min() > 0.99


def test_axes_are_fitted_on_every_passage(spark, monkeypatch):
    m = latent_decontamination
    rng = random.Random(3)
    docs = documents(spark, [(k, sentence(rng, rng.choice([3, 9, 70]), 300)) for k in range(9000)])
    fit, got = m.latent_axes, []
    monkeypatch.setattr(m, "latent_axes", lambda *a: got.append(fit(*a)) or got[0])
    m.leaks(docs, spark.createDataFrame([(1, sentence(rng, 20, 300))], "item_id long, text string"))
    want = fit(docs.select("text").repartition(3), m.inverse_frequencies(docs.select("text")))
    size = lambda axes: np.sort(np.linalg.norm(axes, axis=0))[:40]
    assert np.allclose(size(got[0]), size(want), rtol=1e-4)


def test_sums_by_term_of_the_rows_of_its_passages():
    m = latent_decontamination
    rng = np.random.default_rng(2)
    for n in (1, 5, 3000):
        t = np.minimum(rng.geometric(0.05, n), 200).astype("<u2")
        passage, y = np.sort(rng.integers(0, 40, n)), rng.standard_normal((40, 7)).astype(np.float32)
        want = np.zeros((256, 7))
        np.add.at(want, t, y[passage])
        which, sums = m.spread_back(t, passage, y)
        assert sorted(which) == sorted(set(t)) and np.allclose(want[which], sums, atol=1e-3)


def test_words_are_counted_in_blocks_near_a_candidate_only(monkeypatch):
    m = latent_decontamination
    rng = random.Random(9)
    items = [(k, " ".join(f"i{rng.randrange(500)}" for _ in range(20 + 9 * k))) for k in range(8)]
    texts = [sentence(rng, rng.choice([0, 5, 400])) for _ in range(60)]
    texts[7] = f"{sentence(rng, 40)} {items[3][1]} {sentence(rng, 40)}"
    table = np.random.default_rng(1).standard_normal((m.TERMS, m.RANK)).astype(np.float32)
    counted, sums = [], m.block_sums
    monkeypatch.setattr(m, "block_sums", lambda t, grid: (counted.append(len(grid)) if t.dtype == np.uint8 else None, sums(t, grid))[1])
    batch = pa.RecordBatch.from_pydict({"id": list(range(60)), "text": texts})
    found = [r for b in m._found(iter([batch]), table, m.prepare_items(items, table)) for r in b.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["lcs_share"]) for r in found] == [(7, 3, 1.0)]
    assert 0 < sum(counted) < 0.1 * sum(len(t.split()) for t in texts) / m.STEP


def test_search_helpers_against_plain_forms(monkeypatch):
    m = latent_decontamination
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**64, 4000, dtype=np.uint64) >> np.repeat(np.array([0, 50], np.uint64), 2000)  # the last share leading bits
    words[:2] = 0, 2**64 - 1
    for known in (np.unique(words[::3]), np.unique(words[1::3]), words[1:2], words[5:6]):
        place = {int(w): k for k, w in enumerate(known)}
        codes = m.Words(known, np.zeros((len(known) + 1, 1), np.uint8), np.ones(1), np.ones(1, int)).codes(words)
        assert codes.tolist() == [place.get(int(w), len(known)) for w in words]
    rows = rng.integers(0, 9, (70, 5)).astype(np.uint8)
    lo, column = rng.integers(0, 70, 200), rng.integers(0, 5, 200)
    hi = rng.integers(lo, 71)
    assert m.run_sums(rows, column, lo, hi).tolist() == [rows[a:b, c].sum(dtype=int) for a, b, c in zip(lo, hi, column)]
    for shape in ((1, 1), (7, 3), (40, 16)):
        x = rng.standard_normal(shape)
        assert m.reached(x, np.zeros((shape[0], 1))).tolist() == np.flatnonzero(x >= 0).tolist()
    batch = pa.RecordBatch.from_pydict({"t": ["One two; ÜNÏ  three", None, "", "four five " * 30]})
    whole = [x.tolist() for _, _, x, _ in m.words_of(batch, "t")]
    monkeypatch.setattr(m, "HASH_WORDS", 3)
    monkeypatch.setattr(m, "SUM_ROWS", 4)
    assert [x.tolist() for _, _, x, _ in m.words_of(batch, "t")] == whole
    grid = m.side_by_side(np.arange(9), np.array([2, 0, 3, 3, 1]), 3, 9)
    assert grid.tolist() == [[0, 1, 9], [9, 9, 9], [2, 3, 4], [5, 6, 7], [8, 9, 9]]
    table = rng.integers(0, 9, (10, 4)).astype(np.float32)
    assert (m.block_sums(table, grid) == table[grid].sum(axis=1)).all()


def test_recall_against_brute_force_subsequences(spark):
    m = latent_decontamination
    rng = random.Random(12)
    items = [(k, sentence(rng, 18 + 7 * k, 900)) for k in range(30)]
    rows = []
    for k in range(120):
        share = rng.choice([0, 0.1, 0.2, 0.3, 0.45])
        planted = " ".join(sentence(rng, 1, 900) if rng.random() < share else w for w in items[k % 30][1].split())
        rows.append((k, f"{sentence(rng, rng.randrange(40, 200), 900)} {planted} {sentence(rng, 60, 900)}" if k % 4 else sentence(rng, 150, 900)))
    words = {i: m._text_words(t) for i, t in items}
    share = {(d, i): m.lcs(m.places(w), len(w), m._text_words(t).tolist()) / len(w) for d, t in rows for i, w in words.items()}
    got = {(r.doc_id, r.item_id) for r in m.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {p for p, s in share.items() if s >= m.MIN_LCS + 0.05}
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want)
    assert all(share[p] >= m.MIN_LCS_ANSWER for p in got)


def test_paraphrased_items_of_several_blocks(spark, monkeypatch):
    m = latent_decontamination
    monkeypatch.setattr(m, "ITEM_BLOCK", 10)
    rng = random.Random(6)
    items = [(k, sentence(rng, 20 + 12 * k, 600)) for k in range(25)]
    change = lambda t: " ".join("other" if rng.random() < 0.25 else w for w in t.split())
    docs = documents(spark, [(k, f"{sentence(rng, 90, 600)} {change(t)} {sentence(rng, 90, 600)}") for k, t in items])
    got = {(r.doc_id, r.item_id) for r in m.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & {(k, k) for k, _ in items}) >= 23 and all(a == b for a, b in got)


def test_lcs_against_the_table():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert latent_decontamination.lcs(latent_decontamination.places(np.array(a)), len(a), b) == t[-1][-1]


# ------------------------------------------------------------------ 9


def test_secrets_are_told_from_lookalikes(spark, awkward, none):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, want = [], set()
    for k in range(300):
        t = sentence(rng, 12)
        if k % 3 == 0:
            s = hexes(40)
            t = f'{t} token = "{s}" {t}'
            want.add((k, t.index(s)))
        elif k % 3 == 1:
            t = f"{t} mail user{k}@mail1.example.com or 4371 2900 8412 {rng.randrange(10**13, 10**14)} {t}"
        rows.append((k, t))
    docs = documents(spark, rows).unionByName(awkward.where("doc_id is null or doc_id > 400"))
    got = secret_forest.scan(docs).collect()
    found = {(r.doc_id, r.start) for r in got if r.is_secret}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 2
    assert any(not r.is_secret for r in got)
    clean = {r.doc_id: r.text for r in secret_forest.redact(documents(spark, rows), secret_forest.scan(documents(spark, rows))).collect()}
    assert sum("[SECRET]" in t for t in clean.values()) >= 0.95 * len(want)
    assert secret_forest.scan(none).collect() == []
    assert secret_forest.scan(awkward).count() >= 0


def test_dictionary_counts_all_documents(spark, monkeypatch):
    monkeypatch.setattr(secret_forest, "HELD_WORDS", 50)
    rng = random.Random(3)
    letters = "".join(chr(97 + k) for k in range(26))
    texts = [" ".join("".join(rng.choice(letters[:4]) for _ in range(rng.randrange(4, 6))) for _ in range(9)) for _ in range(4_500)]
    texts += [f"{texts[k]} Key{k:012d}abc tail" for k in range(30)] + ["rareword here", "rareword there", "rareword, rareword"]
    want, near = Counter(), Counter()
    for t in texts:
        want.update({w for w in (x.lower() for x in secret_forest.WORD.findall(t)) if 4 <= len(w) <= 12})
        for a, b in secret_forest.candidates(t):
            near.update(w for w in secret_forest.neighbours(t, a, b) if w)
    rows = documents(spark, list(enumerate(texts)))
    for parts in (1, 60):
        src = secret_forest._source(rows.repartition(parts), "doc_id", "source", "text")
        words, around = secret_forest.vocabulary(src)
        assert words == {w for w, n in want.items() if n >= 3} and "rareword" in words
        assert around == sorted(near, key=lambda w: (-near[w], w))[: secret_forest.NEIGHBOURS]


def test_review_labels_are_used(spark):
    docs = documents(spark, [(k, f"key{k} zzz{k:012d}abc and more") for k in range(40)])
    seen = secret_forest.scan(docs).collect()
    labels = spark.createDataFrame([(r.sha256, 1) for r in seen], "sha256 string, secret int")
    assert all(r.is_secret for r in secret_forest.scan(docs, labels).collect())
