"""Public tokenizers over Arrow columns: every distinct chunk of a piece is encoded once.

Texts are cut before a space that stands between two visible bytes, of which at
least one is ASCII. No tokenizer used here joins tokens across such a place: the
byte-level and the word pattern end a word before it, and no entry of the piece
model holds its space mark after another character (checked when it is loaded).
Words repeat, so a chunk's ids are looked up for all but its first occurrence
in a piece; what is looked up is bounded by the piece. Tests hold the ids
against whole texts given to the libraries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

SPACE_MARK = "▁"


def public_path(name: str) -> str:
    """Where the installed public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def once(key: tuple, make: Callable):
    """``make()``, once in a process for each key.

    What is made is kept in a module of its own: the functions here travel by
    value and are made anew for every task, a worker process is not.
    """
    name = f"{__name__}_loaded"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def load_json(path: str, plain_specials: bool = False):
    """A tokenizer of the ``tokenizers`` library; ``plain_specials`` reads special tokens in texts as plain text."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are parallel already
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain_specials
        return t

    return once(("json", path, plain_specials), make)


def load_pieces(path: str):
    """A ``sentencepiece`` model whose pieces hold the space mark only in front."""

    def make():
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(SPACE_MARK in s.id_to_piece(i).lstrip(SPACE_MARK) for i in range(s.vocab_size())):
            raise ValueError("a piece crosses words; texts cannot be cut before spaces")
        return s

    return once(("pieces", path), make)


def byte_of_character() -> dict[str, int]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, the other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def json_token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""

    def make():
        back = byte_of_character()
        vocab = load_json(path, True).get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return out

    return once(("json bytes", path), make)


def piece_token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a piece model: the mark as space, ``<0xHH>`` as that byte."""

    def make():
        s = load_pieces(path)
        piece = lambda i: bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        return [piece(i) for i in range(s.vocab_size())]

    return once(("piece bytes", path), make)


# ------------------------------------------------------------------ chunks


def chunk_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where chunks start: at every row that is not empty and at every place where a text may be cut."""
    row_starts = offs[:-1][np.diff(offs) > 0]
    if len(data) < 3:
        return row_starts
    at = np.flatnonzero(data[1:-1] == 32) + 1
    before, after = data[at - 1], data[at + 1]
    edge = np.zeros(len(data) + 2, bool)
    edge[offs] = True
    ok = (before > 32) & (after > 32) & ((before < 128) | (after < 128)) & ~edge[at] & ~edge[at + 1]
    return np.sort(np.concatenate([row_starts, at[ok]]))


def distinct_chunks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The code of every chunk and the distinct chunks (bytes) by code."""
    edges = np.append(starts, len(data)).astype(np.int64)
    whole = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    d = whole.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


class Ragged:
    """Lists of numbers, one after the other."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.values, self.counts = values, counts
        self.first = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=self.first[1:])

    @staticmethod
    def of(lists: list) -> Ragged:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        return Ragged(np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts)

    def places(self, which: np.ndarray) -> np.ndarray:
        """The places of the values of the lists ``which``, in that order."""
        n = self.counts[which]
        shift = self.first[which] - (np.cumsum(n) - n)
        return np.repeat(shift, n) + np.arange(int(n.sum()))

    def take(self, which: np.ndarray) -> np.ndarray:
        return self.values[self.places(which)]


def encode_json(tokenizer, texts: list[str]) -> Ragged:
    return Ragged.of([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


# ------------------------------------------------------------------ byte-level and piece vocabularies

#: Chunks put into one text for the library, which has a cost for every text.
JOINED = 512


def encode_joined(encode: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, chunks: pa.Array) -> Ragged:
    """The ids of each of ``chunks`` (bytes that start with a space).

    Plain chunks may follow each other as in a text, so many are encoded as one,
    and the tokens' byte lengths tell where each ends; if they do not meet the
    chunks' ends, and for chunks that are not plain, each is encoded by itself.
    """
    size = np.diff(np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1])
    raw = np.frombuffer(chunks.buffers()[2], np.uint8) if len(chunks) else np.empty(0, np.uint8)
    end = np.cumsum(size)
    second = raw[np.minimum(end - size + 1, len(raw) - 1)] if len(raw) else raw
    plain = (size > 1) & (second > 32) & (second < 128) & (raw[end - 1] > 32)
    texts = chunks.cast(pa.large_string()).to_pylist()
    order = np.flatnonzero(plain)
    alone = [np.flatnonzero(~plain)]
    groups = [order[a : a + JOINED] for a in range(0, len(order), JOINED)]
    which, values, counts = [], [], []
    for group, got in zip(groups, encode(["".join([texts[i] for i in group.tolist()]) for group in groups])):
        ends = np.cumsum(lengths[got])
        want = np.cumsum(size[group])
        last = np.searchsorted(ends, want)
        if len(ends) and ends[-1] == want[-1] and np.array_equal(ends[last], want):
            which.append(group)
            values.append(np.array(got, np.int64))
            counts.append(np.diff(last, prepend=-1))
        else:
            alone.append(group)
    rest = np.concatenate(alone)
    single = Ragged.of(encode([texts[i] for i in rest.tolist()]))
    found = Ragged(np.concatenate([*values, single.values]), np.concatenate([*counts, single.counts]))
    back = np.empty(len(texts), np.int64)
    back[np.concatenate([*which, rest])] = np.arange(len(texts))
    return Ragged(found.take(back), found.counts[back])


# ------------------------------------------------------------------ the word vocabulary

# The word pattern of the vocabulary, for characters up to U+024F.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
WORD_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"
#: Chunks that the library must see whole: other characters, one whose lower case is two, and what may be a special token.
NOT_SIMPLE = "[^\x00-\u024f]|\u0130|<\\|"
WORD_END = "</w>"


def word_model(path: str):
    """The vocabulary's own BPE model behind a splitter at spaces, and which ids end a word."""

    def make():
        full = json.loads(load_json(path).to_str())
        bare = full | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        from tokenizers import Tokenizer

        vocab = full["model"]["vocab"]
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        return Tokenizer.from_str(json.dumps(bare)), ends

    return once(("words", path), make)


def encode_words(path: str, chunks: list[str]) -> Ragged:
    """The ids of each chunk (without line feeds) under a lower-case vocabulary with word ends.

    Simple chunks are lowered and split into words here, as the pattern does; each
    distinct word is then encoded once by the library's model. Lower case and
    normal form of these characters do not depend on their neighbours. All
    other chunks go through the library as they are.
    """
    hard = [i for i, c in enumerate(chunks) if not c.isascii() and re.search(NOT_SIMPLE, c) or "<|" in c]
    own = chunks
    if hard:
        own = list(chunks)
        for i in hard:
            own[i] = ""
    found = re.findall(f"\n|{WORD_PATTERN}", "\n".join([*own, ""]).lower())  # a line feed ends every chunk
    d = pa.array(found, pa.large_string()).dictionary_encode()
    code, words = d.indices.to_numpy().astype(np.int64), d.dictionary.to_pylist()
    feed = words.index("\n")
    cut = np.flatnonzero(code == feed)
    n_parts = np.diff(cut, prepend=-1) - 1
    flat = np.delete(code, cut)
    words[feed] = "a"
    model, ends = word_model(path)
    byte_level = {b: ord(c) for c, b in byte_of_character().items()}
    texts = [" ".join(words[a : a + JOINED]).encode().replace(b" ", b"\n").decode("latin-1") for a in range(0, len(words), JOINED)]
    byte_level[10] = 10  # only between words, which hold no white space
    got = encode_json(model, [t.translate(byte_level) for t in texts])
    last = np.flatnonzero(ends[got.values]) if len(got.values) else np.empty(0, np.int64)
    per_word = Ragged(got.values, np.diff(last, prepend=-1))
    upto = np.append(0, np.cumsum(per_word.counts[flat]))[np.append(0, np.cumsum(n_parts))]
    values, counts = per_word.take(flat), np.diff(upto)
    if not hard:
        return Ragged(values, counts)
    lists = [x for x in np.split(values, np.cumsum(counts)[:-1])]
    for i, e in zip(hard, load_json(path).encode_batch_fast([chunks[i] for i in hard], add_special_tokens=False)):
        lists[i] = e.ids
    return Ragged.of(lists)


def encode_rows(path: str, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every row, one after the other, and how many each row has."""
    n_rows = len(offs) - 1
    data = np.where(data == 10, np.uint8(32), data)  # all white space is the same to this vocabulary
    starts = chunk_starts(data, offs)
    if not len(starts):
        return np.empty(0, np.int64), np.zeros(n_rows, np.int64)
    codes, chunks = distinct_chunks(data, starts)
    ids = encode_words(path, chunks.cast(pa.large_string()).to_pylist())
    row = np.searchsorted(offs, starts, side="right") - 1
    return ids.take(codes), np.bincount(row, weights=ids.counts[codes], minlength=n_rows).astype(np.int64)
