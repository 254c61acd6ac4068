"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Method: distinct words are walked as a prefix trie. For every trie node (a prefix of some word) there is
exactly one token that can end its encoding, its last-token state; the encoding of the prefix is the
encoding of the shorter prefix before that token, plus the token. So each prefix shared by many words is
worked out once, and a word's ids are read off backwards along its path. A token may follow another if no
merge of lower rank crosses the border between them, which the merge tree of the two tokens tells.

A depth-first walk over a trie visits its words in sorted order, so the trie is kept as the sorted list of
words and the stack of states of the current path; a word starts from the states of the prefix it shares
with the word before it.

The plan is one narrow pass (scan, mapInArrow): no shuffle and nothing broadcast but a file path. Each
worker keeps the ids of the words it has met; the table is emptied when it is full, which changes no
result, only work.

Defined results: null and empty texts give an empty list; every row of the input gives one row; texts are
encoded whole; strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memloom.session import ship, spread

#: Words kept by a worker before its table is emptied.
MEMO_WORDS = 1_000_000
#: Bytes of text taken from an Arrow batch at a time.
SLICE_BYTES = 4_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TrieEncoder:
    """Ids of words by one byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte_of = _byte_alphabet()

        def raw(s: str) -> bytes:
            return bytes(byte_of[c] for c in s)

        self.ids: dict[bytes, int] = {}
        for s, i in model["vocab"].items():
            if all(c in byte_of for c in s):
                self.ids[raw(s)] = i
        n = max(self.ids.values()) + 1
        self.size = [1] * n
        for b, i in self.ids.items():
            self.size[i] = len(b)
        # What each token was merged from, and the merge's place in the order; single bytes have none.
        self.left, self.right = list(range(n)), list(range(n))
        self.order = [-1] * n
        self.merged: dict[tuple[int, int], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y = raw(a), raw(b)
            i = self.ids.get(x + y)
            if i is None or self.order[i] >= 0:
                continue
            self.left[i], self.right[i], self.order[i] = self.ids[x], self.ids[y], k
            self.merged[self.ids[x], self.ids[y]] = i
        self.longest = max(self.size)
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` stay apart: undo the two tokens' merges from the latest to the first and
        see whether, at any stage, the parts at the border would have merged before the next merge done."""
        order, right, left, merged = self.order, self.right, self.left, self.merged
        later = None  # order of the earliest merge already undone; a crossing merge must come before it
        later_is_left = False
        while True:
            across = merged.get((a, b))
            if across is not None:
                o = order[across]
                # At equal order the same merge competes with itself: the left one is done first.
                if later is None or o < later or (o == later and not later_is_left):
                    return False
            oa, ob = order[a], order[b]
            if oa < 0 and ob < 0:
                return True
            if oa > ob:
                later, later_is_left, a = oa, True, right[a]
            else:
                later, later_is_left, b = ob, False, left[b]

    def fit(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 4 * MEMO_WORDS:
                self.fits.clear()
            known = self.fits[key] = self._may_follow(a, b)
        return known

    def learn(self, words: list[str]) -> None:
        """Add the ids of new distinct words: a depth-first walk over their trie."""
        ids, size, fit, longest = self.ids, self.size, self.fit, self.longest
        last: list[int] = [-1]  # last-token state of each prefix on the current path
        before = b""
        for w, word in sorted((x.encode("utf-8"), x) for x in words):
            shared, most = 0, min(len(w), len(before))
            while shared < most and w[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                for start in range(max(0, end - longest), end):
                    t = ids.get(w[start:end])
                    if t is not None and (start == 0 or fit(last[start], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token ends {w[:end]!r}")
            before, at, out = w, len(w), []
            while at:
                t = last[at]
                out.append(t)
                at -= size[t]
            self.words[word] = tuple(reversed(out))

    def encode_all(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of texts given as lists of words."""
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        known = self.words
        new = {w for t in texts for w in t if w not in known}
        if new:
            self.learn(list(new))
        flat: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int32)
        for k, t in enumerate(texts):
            flat.extend(chain.from_iterable(map(known.__getitem__, t)))
            ends[k + 1] = len(flat)
        return np.fromiter(flat, dtype=np.int32, count=len(flat)), ends


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """This worker's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


def _word_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= SLICE_BYTES:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _encoded(path: str, batches: Iterator[pa.RecordBatch], count_only: bool) -> Iterator[pa.RecordBatch]:
    enc, find = encoder(path), _word_pattern().findall
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in _slices(texts):
            flat, ends = enc.encode_all([find(t) if t else [] for t in texts[a:b]])
            if count_only:
                last = pa.array(np.diff(ends).astype(np.int64))
            else:
                last = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            keep = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1] + ["n_tokens" if count_only else "ids"]
            yield pa.RecordBatch.from_arrays([*keep, last], names=names)


def _mapped(df: DataFrame, keep: list[str], text: str, vocabulary: str | None, count_only: bool) -> DataFrame:
    path = vocabulary or default_vocabulary()
    ship(df.sparkSession)
    slim = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    out = "n_tokens bigint" if count_only else "ids array<int>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(path, batches, count_only)

    return spread(slim).mapInArrow(work, f"{fields}, {out}" if fields else out)


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``ids`` (ARRAY<INT>), one row per row of ``df``."""
    return _mapped(df, keep, text, vocabulary, count_only=False)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``keep`` columns and ``n_tokens``, one row per row of ``df``."""
    return _mapped(df, keep, text, vocabulary, count_only=True)
