"""Secret scan with a random forest against false positives (operator 9).

1. Every whole text is searched for candidates: runs of at least ``MIN_LENGTH``
   code characters with a digit. Offsets count code points.
2. Each candidate gets features: its length, entropy, character classes, shares
   of the transitions between classes, coverage by dictionary words, the words
   around it, and its path (the source).
3. A random forest (Spark ML) is trained on labelled findings and gives each
   candidate the probability that it is a secret; the others are the false
   positives that a pattern alone would report.

Labelled findings are an argument. Without them they are made by ``weak_label``:
a candidate assigned to a credential name is a finding, unless it is of low
entropy, mostly dictionary words or of a known harmless form. The forest sees at
most about ``TRAIN_FINDINGS`` findings, drawn by a hash. The dictionary and the
neighbour words are counted over all documents, with partial sums per task that
are cleared when they reach ``HELD_WORDS`` words; words are dropped only after
the sum over all tasks. Scoring covers every candidate.

Candidates leave their tasks as narrow rows; texts are not shuffled. A document
with very many candidates is many rows, never one. No secret is written out:
results carry offsets and a SHA-256 of the candidate.

Defined cases: null and empty texts have no candidates; a null source is the path
""; a null id is carried; repeated rows give their findings each; with findings of
one label only, that label's probability is given; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examlytics.llm.common import stored

MIN_LENGTH = 12
HELD_WORDS = 200_000
MIN_DOCS = 3
DICTIONARY = 20_000
NEIGHBOURS = 48
TRAIN_FINDINGS = 20_000
PATHS = 8
TREES, DEPTH = 24, 8
THRESHOLD = 0.5

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-.@:=]*[0-9][A-Za-z0-9+/_\-.@:=]*")
EDGES = ".:=-_/@+"
# Names of credentials, and harmless forms.
CREDENTIAL = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)s?[\"']?\s*[:=]+\s*[\"']?$")
HARMLESS = re.compile(
    r"(?:https?:.*|www\..*|[^@]+@[^@]+\.[A-Za-z]+|[0-9.:/\-+]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$"
)
WORD = re.compile(r"[^\W\d_]+")
CLASSES = 4  # lower case, upper case, digit, other


def char_class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) if n else 0.0


def coverage(s: str, words: frozenset[str]) -> float:
    """Share of the candidate's characters that dictionary words cover, longest first."""
    low, i, hit = s.lower(), 0, 0
    while i < len(low):
        for k in range(min(12, len(low) - i), 3, -1):
            if low[i : i + k] in words:
                hit += k
                i += k - 1
                break
        i += 1
    return hit / len(s) if s else 0.0


def shape(s: str, words: frozenset[str]) -> list[float]:
    """Features of a candidate by itself."""
    cls = [char_class(c) for c in s]
    n = len(s)
    moves = [0.0] * (CLASSES * CLASSES)
    for a, b in zip(cls, cls[1:]):
        moves[a * CLASSES + b] += 1
    shares = [cls.count(k) / n for k in range(CLASSES)]
    is_hex = float(all(c in "0123456789abcdefABCDEF" for c in s))
    return [float(n), math.log1p(n), entropy(s), entropy(s) / math.log2(max(n, 2)), *shares, is_hex, coverage(s, words), *(m / max(n - 1, 1) for m in moves)]


def neighbours(text: str, start: int, end: int) -> tuple[str, str]:
    """The nearest word before and behind a candidate."""
    before = WORD.findall(text, max(0, start - 40), start)
    behind = WORD.search(text, end, end + 40)
    return (before[-1].lower() if before else ""), (behind[0].lower() if behind else "")


def weak_label(text: str, start: int, s: str, covered: float) -> int:
    """1 for a candidate assigned to a credential name that looks drawn at random, else 0."""
    named = CREDENTIAL.search(text[max(0, start - 40) : start])
    return int(bool(named) and not HARMLESS.match(s) and entropy(s) >= 2.8 and covered < 0.5)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and candidates per neighbour word, as partial sums."""
    words, near = Counter(), Counter()

    def rows() -> pa.RecordBatch:
        kinds = ["w"] * len(words) + ["n"] * len(near)
        out = [pa.array(kinds, pa.string()), pa.array([*words, *near], pa.string()), pa.array([*words.values(), *near.values()], pa.int64())]
        words.clear()
        near.clear()
        return pa.RecordBatch.from_arrays(out, names=["kind", "word", "n"])

    for batch in batches:
        for text in batch.column("__text"):
            text = text.as_py()
            if text:
                words.update({w for w in (x.lower() for x in set(WORD.findall(text))) if 4 <= len(w) <= 12})
                for start, end in candidates(text):
                    near.update(w for w in neighbours(text, start, end) if w)
                if len(words) + len(near) >= HELD_WORDS:
                    yield rows()
    yield rows()


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a text."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if len(s) < MIN_LENGTH:
            continue
        a = m.start() + len(s) - len(s.lstrip(EDGES))
        b = m.end() - (len(s) - len(s.rstrip(EDGES)))
        if "=" in text[a:b]:  # name=value: the value is the candidate
            a = text.rindex("=", a, b) + 1
        if b - a >= MIN_LENGTH and any(c.isdigit() for c in text[a:b]):
            out.append((a, b))
    return out


FOUND = "id long, source string, start int, end int, sha256 string, shape array<double>, before string, behind string, named int"


def _scan(words: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for i, source, text in zip(*(part.column(c).to_pylist() for c in ("id", "source", "__text"))):
                    for start, end in candidates(text or ""):
                        s = text[start:end]
                        x = shape(s, words)
                        near = neighbours(text, start, end)
                        rows.append((i, source, start, end, hashlib.sha256(s.encode()).hexdigest(), x, *near, weak_label(text, start, s, x[9])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


# ------------------------------------------------------------------ plan


def _source(docs: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("source"), F.col(text_col).cast("string").alias("__text")
    )


def _drawn(df: DataFrame, n_rows: int, most: int, *key: str) -> DataFrame:
    """About ``most`` rows, by a hash of their key."""
    share = min(1.0, most / max(n_rows, 1))
    return df.where(F.pmod(F.xxhash64(*key), F.lit(1 << 30)) < int(share * (1 << 30)))


def vocabulary(src: DataFrame) -> tuple[frozenset[str], list[str]]:
    """The commonest dictionary words, each in ``MIN_DOCS`` documents at least, and neighbour words of all documents."""
    n = src.select("__text").mapInArrow(_vocabulary, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    n = stored(n.where(f"n >= {MIN_DOCS} or kind = 'n'"), "vocabulary")
    top = lambda kind, k: [r["word"] for r in n.where(F.col("kind") == kind).orderBy(F.desc("n"), "word").limit(k).collect()]
    return frozenset(top("w", DICTIONARY)), top("n", NEIGHBOURS)


def features(near: list[str]) -> Column:
    """The whole feature array of a candidate row."""
    before = [(F.col("before") == w).cast("double") for w in near]
    behind = [(F.col("behind") == w).cast("double") for w in near]
    path = F.pmod(F.xxhash64("source"), F.lit(PATHS))
    return F.concat("shape", F.array(*before, *behind, *((path == k).cast("double") for k in range(PATHS))))


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", path_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id, start, end, sha256, probability, is_secret`` of every candidate.

    ``findings`` are labelled findings ``(sha256, secret)`` from reviews; without
    them the weak labels of the candidates serve.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    src = _source(docs, id_col, path_col, text_col)
    words, near = vocabulary(src)
    found = stored(src.mapInArrow(_scan(words), FOUND), "secret-candidates")
    labelled = found.withColumn("label", F.col("named").cast("double"))
    if findings is not None:
        y = findings.select("sha256", F.col("secret").cast("double").alias("label")).where("label in (0, 1)").groupBy("sha256").agg(F.max("label").alias("label"))
        labelled = found.join(y, "sha256")
    # one row per distinct candidate and label, the rarer label whole up to half of the bound
    once = stored(labelled.dropDuplicates(["sha256", "label"]), "findings")
    sizes = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    if not found.take(1):
        scored = found.withColumn("probability", F.lit(0.0))
    elif len(sizes) < 2:
        scored = found.withColumn("probability", F.lit(max(sizes, default=0.0)))
    else:
        parts = [_drawn(once.where(F.col("label") == y), n, TRAIN_FINDINGS // 2, "sha256") for y, n in sorted(sizes.items())]
        train = parts[0].unionByName(parts[1]).select("label", array_to_vector(features(near)).alias("features"))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=9, subsamplingRate=0.8, cacheNodeIds=False, checkpointInterval=-1)
        model = forest.fit(stored(train, "findings"))
        scored = model.transform(found.withColumn("features", array_to_vector(features(near))))
        scored = scored.withColumn("probability", vector_to_array("probability")[1])
    secret = (F.col("probability") >= THRESHOLD).cast("int").alias("is_secret")
    return scored.select(F.col("id").alias("doc_id"), "start", "end", "sha256", "probability", secret)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist()):
            for s, e in sorted({(x["start"], x["end"]) for x in spans or []}, reverse=True):
                text = f"{text[:s]}[SECRET]{text[e:]}"
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with the secrets of ``scan`` replaced; ids must name one text each."""
    spans = scanned.where("is_secret = 1").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")).join(spans, "doc_id", "left")
    return x.select("doc_id", "__text", "spans").mapInArrow(_cut, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op9_secret_forest: every candidate of ``documents`` with its probability of being a secret."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
