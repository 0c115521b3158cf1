"""Small documents with every awkward case, for all operators."""

import random
import re

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, shard string, id string"


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary):x}q" for _ in range(n))


def awkward_rows(rng):
    """Nulls, empty and white texts, ties, repeated rows, a very long text, non-ASCII, clashing columns."""
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (None, "alone with no id here at all"), (4, "one"), (5, "two words"),
        (6, sentence(rng, 30)), (7, "Ünï çødé ﬁn — ñandú x " * 5), (8, sentence(rng, 20_000)), (9, "a\nb\n\na\n  \nb"),
    ]
    texts += [(9, "a\nb\n\na\n  \nb"), (10, texts[6][1]), (None, None)]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, "x", "y", "z", "q") for k, (i, t) in enumerate(texts)]


def documents(spark, rows):
    full = [tuple(r) + ("en", "s0", 0, "x", "y", "z", "q")[len(r) - 2 :] if len(r) < 9 else r for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k=5):
    w = WORDS.findall(lower_ascii(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
