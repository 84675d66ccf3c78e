"""Byte-pair encoding of a whole corpus with a public vocabulary, in numpy rounds.

The words of a batch that were not met before lie in one flat array of symbols. Each
round looks up all neighbouring pairs at once, by binary search over the sorted pair
keys, finds every word's lowest rank and merges that pair wherever it stands in the
word; words without a known pair leave the array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


class Vocabulary:
    """Ranks of byte strings as arrays. ``pairs`` are the sorted keys ``left << 32 | right``, ``merged`` the ids they give.

    The size is that of a vocabulary file, whatever the corpus, so it is sent to all tasks.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.full(256, -1, np.int64)
        for i in range(256):
            self.single[i] = ranks[bytes([i])]
        keys, ids = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pairs, self.merged = np.array(keys, np.int64)[order], np.array(ids, np.int64)[order]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})


NONE = np.int64(1) << 40


def merge_words(words: list[bytes], voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after the other, number of ids of each word)."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    symbols = voc.single[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_words = [], []
    while len(symbols):
        key = symbols[:-1] << 32 | symbols[1:]
        at = np.searchsorted(voc.pairs, key)
        at[at == len(voc.pairs)] = 0
        rank = np.full(len(symbols), NONE)
        rank[:-1] = np.where((voc.pairs[at] == key) & (word[:-1] == word[1:]), voc.merged[at], NONE)
        heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lengths = np.diff(np.r_[heads, len(word)])
        best = np.repeat(np.minimum.reduceat(rank, heads), lengths)
        ended = best == NONE
        if ended.any():
            done_symbols.append(symbols[ended])
            done_words.append(word[ended])
            symbols, word, rank, best = symbols[~ended], word[~ended], rank[~ended], best[~ended]
            if not len(symbols):
                break
        hit = rank == best
        # of a run of hits (the same symbol again and again) every other one merges, from the left
        place = np.arange(len(hit))
        opens = hit & ~np.r_[False, hit[:-1]]
        hit &= (place - np.maximum.accumulate(np.where(opens, place, 0))) % 2 == 0
        symbols = np.where(hit, rank, symbols)
        stay = ~np.r_[False, hit[:-1]]
        symbols, word = symbols[stay], word[stay]
    if not done_symbols:
        return np.empty(0, np.int64), np.zeros(len(words), np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=len(words))


class Encoder:
    """Encodes batches of texts; remembers the ids of words between batches."""

    def __init__(self, voc: Vocabulary):
        import regex

        self.voc, self.find = voc, regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        flat, sizes = merge_words([w.encode() for w in words], self.voc)
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word of the batch, words of each text); afterwards every number is known."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, numbers, counts, new = self.index, [], [], []
        for text in texts:
            found = self.find(text) if text else ()
            counts.append(len(found))
            for w in found:
                n = index.get(w)
                if n is None:
                    n = index[w] = len(index)
                    new.append(w)
                numbers.append(n)
        if new:
            self._learn(new)
        return np.array(numbers, np.int64), np.array(counts, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for an empty or null one."""
        numbers, counts = self.words(texts)
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        into = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        ids = self.flat[np.repeat(self.starts[numbers], sizes) + into].astype(np.int32)
        per_text = np.bincount(np.repeat(np.arange(len(texts)), counts), weights=sizes, minlength=len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_text)[:-1]) if len(texts) else []

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, counts = self.words(texts)
        return np.bincount(np.repeat(np.arange(len(texts)), counts), weights=self.sizes[numbers], minlength=len(texts)).astype(np.int64)


def _pieces(texts: pd.Series, chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch of about ``chars`` characters, at least one text each, so that long texts don't add up."""
    at, total = 0, 0
    for i, n in enumerate(texts.str.len().fillna(0)):
        if i > at and total + n > chars:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(texts):
        yield slice(at, len(texts))


def encode(df: DataFrame, text: str = "text", *, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``ids``, an array of the token ids of ``text`` just as it is; ``text`` is dropped.

    Null and empty texts have an empty list. The strings of special tokens are ordinary
    text. Every row is encoded whole; repeated rows stay. A column already called like
    ``ids`` is replaced. No shuffle; the vocabulary (a file of about 1 MB) is broadcast.
    """
    return _map(df, text, ids, vocabulary, "array<int>", lambda e, texts: e.encode(texts))


def count_tokens(df: DataFrame, text: str = "text", *, tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``tokens``, the number of ids ``encode`` would give (0 for null and empty), in place of ``text``."""
    return _map(df, text, tokens, vocabulary, "bigint", lambda e, texts: e.count(texts))


def _map(df: DataFrame, text: str, name: str, vocabulary: str, kind: str, use) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    voc = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    keep = [c for c in df.columns if c.lower() not in (text.lower(), name.lower())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(voc.value)
        for batch in batches:
            for part in _pieces(batch[text]):
                rows = batch.iloc[part]
                texts = [None if x is None or x != x else x for x in rows[text]]
                out = rows[keep].copy()
                out[name] = list(use(encoder, texts))
                yield out

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.select(*keep, F.col(text).cast("string").alias(text)).mapInPandas(run, ", ".join([*fields, f"`{name}` {kind}"]))
