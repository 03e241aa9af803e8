"""Encoding of texts with a byte-level BPE vocabulary, by a trie over the distinct words.

The state at a prefix of a word is the last token of the prefix's encoding. A token ending there is that last token if
it is compatible with the state where it begins, that is, if merging the bytes of both by the vocabulary's rules gives
just these two again; exactly one token is. So states run down a trie of the distinct words: words with a common
prefix share its states, which are computed once. Depth-first order over the trie is the sorted order of the words,
with the states of the current path kept in a list. A word's ids are read off backwards, from token to token. The work
is linear in a word's length, also for words of any length.

Tests compare the ids with two independent libraries.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexflume.functions.arrow import text_slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The splitting pattern that belongs to the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE_WORDS = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The file's place in the installed package of public vocabularies; LEXFLUME_TOKENIZERS names another folder."""
    folder = os.environ.get("LEXFLUME_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


class TrieEncoder:
    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        self.ids: dict[bytes, int] = {}
        for line in data.splitlines():
            if line.strip():
                token, number = line.split()
                self.ids[base64.b64decode(token)] = int(number)
        self.tokens = {number: token for token, number in self.ids.items()}
        self.endings = {token[i:] for token in self.ids for i in range(len(token))}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, ...]] = {"": ()}
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The merge rules as defined: again and again join the adjacent pair of the lowest id."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], 1 << 60))
            joined = parts[best] + parts[best + 1]
            if joined not in self.ids:
                break
            parts[best : best + 2] = [joined]
        return parts

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) > 4_000_000:
                self._fits.clear()
            a, b = self.tokens[left], self.tokens[right]
            found = self._fits[key] = self.merge(a + b) == [a, b]
        return found

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself (it may begin a word)."""
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = len(self.merge(self.tokens[token])) == 1
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Encode new distinct words, walking their trie depth-first."""
        states = [-1]
        before = b""
        for data, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for begin in range(end - 1, -1, -1):
                    ending = data[begin:end]
                    if ending not in self.endings:
                        raise ValueError("the vocabulary lacks single bytes")
                    token = self.ids.get(ending)
                    if token is not None and (self.fits(states[begin], token) if begin else self.stands(token)):
                        states.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks single bytes")
            at, back = len(data), []
            while at:
                back.append(states[at])
                at -= len(self.tokens[states[at]])
            self.known[word] = tuple(reversed(back))
            before = data

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets where each text's begin."""
        pieces = [self.split(t) if t else [] for t in texts]
        if len(self.known) > _CACHE_WORDS:
            self.known = {"": ()}
        self.learn(set(chain.from_iterable(pieces)) - self.known.keys())
        look = self.known.__getitem__
        ids = [list(chain.from_iterable(map(look, p))) for p in pieces]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
        return np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1])), offsets


_encoders: dict[tuple[str, str], TrieEncoder] = {}


def _encoder(data: bytes, pattern: str) -> TrieEncoder:
    key = (hashlib.sha1(data).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = TrieEncoder(data, pattern)
    return _encoders[key]


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(id, ids array<int>) of every row: the token ids of its text as stored, without special tokens.

    The names of special tokens in a text are ordinary text. A null or an empty text gives an empty list; blank texts
    are encoded as they are. Repeated rows and null ids come out as often as they go in. `vocabulary` is the path of a
    byte-level vocabulary in rank format (about 1 MB, sent to the executors once). Other columns aren't read.
    """
    with open(vocabulary or vocabulary_path(), "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(data.value, pattern)
        for batch in batches:
            for rows, texts in text_slices(batch):
                ids, offsets = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, ids array<int>")
