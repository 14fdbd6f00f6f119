"""Short numbers for common words, and tables of word sequences spread over buckets.

A `Lexicon` holds the commonest words of a corpus, at most `LEXICON_WORDS`, as ranks by
count; it is broadcast. Other words go by their 63-bit hash as a negative number, so every
word has a number and nothing is lost where a corpus has more words than the lexicon.

Sequences meet in buckets given by the hash of their first word. A first word with more
occurrences than a quarter of a bucket is spread over all buckets by its second word.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.hashing import GOLDEN, mixed

LEXICON_WORDS = 1 << 20
BUCKET_ENTRIES = 1_000_000
MEMO_WORDS = 150_000
# fixed value: the seed of Spark's xxhash64
SEED = 42
TOP = np.uint64(1 << 63)
BITS = 21


def word_key(*parts: Column) -> Column:
    """The number of a word that no lexicon holds; equals `key_of` of the same UTF-8 parts."""
    return F.xxhash64(*parts).bitwiseOR(F.lit(-(1 << 63)))


def prefix_seed(prefix: bytes | None = None) -> int:
    return SEED if prefix is None else xxhash.xxh64_intdigest(prefix, SEED)


def key_of(words, seed: int = SEED) -> np.ndarray:
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, len(words))
    return (hashes | TOP).view(np.int64)


@dataclass
class Lexicon:
    keys: np.ndarray  # of the words by rank
    counts: np.ndarray  # of the words by rank
    complete: bool  # no other word has `least` occurrences
    order: np.ndarray  # ranks in the order of their keys

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Ranks of known words, keys of others."""
        if not len(self.keys):
            return keys
        at = np.minimum(np.searchsorted(self.keys, keys, sorter=self.order), len(self.keys) - 1)
        rank = self.order[at]
        return np.where(self.keys[rank] == keys, rank, keys)

    def keys_of(self, numbers: np.ndarray) -> np.ndarray:
        out = numbers.copy()
        known = numbers >= 0
        out[known] = self.keys[numbers[known]]
        return out


def common_words(words: DataFrame, least: int = 1, most: int = LEXICON_WORDS) -> Lexicon:
    """The words of a table (key, f; one row each) with at least `least` occurrences, or the
    commonest of them: whole bands of counts, as many as fit into `most` words."""
    # counts up to 1,024 are bands of their own, larger ones go by powers of two
    band = F.when(F.col("f") <= 1024, F.col("f")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.col("f").cast("double")))).cast("bigint"))
    bands = words.filter(F.col("f") >= least).groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect()
    total, lowest = 0, None
    for r in bands:
        if total + r["count"] > most:
            break
        total, lowest = total + r["count"], r["band"]
    complete = total == sum(r["count"] for r in bands)
    if lowest is None:
        empty = np.zeros(0, np.int64)
        return Lexicon(empty, empty, complete, empty)
    # at most `most` rows of two numbers
    rows = words.filter((F.col("f") >= least) & (band >= lowest)).select("key", F.col("f").cast("bigint").alias("f")).toArrow()
    keys, counts = (rows.column(c).to_numpy() for c in ("key", "f"))
    by_count = np.lexsort((keys, -counts))
    keys, counts = keys[by_count], counts[by_count]
    return Lexicon(keys, counts, complete, np.argsort(keys))


class Coder:
    """Numbers of the words of texts; those of words met before are remembered."""

    def __init__(self, lexicon: Lexicon, seed: int = SEED, most: int = MEMO_WORDS):
        self.lexicon, self.seed, self.most, self.memo = lexicon, seed, most, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo.clear()
        new = list(set(words).difference(self.memo))
        if new:
            self.memo.update(zip(new, self.lexicon.numbers(key_of(new, self.seed)).tolist()))
        return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))


def _packed(columns: list[np.ndarray]) -> np.ndarray | None:
    """Up to three columns of numbers as one that sorts equal rows together, if they fit.

    Negative numbers get places behind the largest one.
    """
    if len(columns) * BITS > 63:
        return None
    top = max(int(c.max()) for c in columns) + 1
    if any(c.min() < 0 for c in columns):
        wide = np.unique(np.concatenate([c[c < 0] for c in columns]))
        columns = [np.where(c < 0, max(top, 0) + np.searchsorted(wide, c), c) for c in columns]
        top = max(top, 0) + len(wide)
    if top > 1 << BITS:
        return None
    packed = columns[0]
    for c in columns[1:]:
        packed = packed << BITS | c
    return packed


def grouped(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where each group starts in it.

    Rows that share their first columns stand together as well.
    """
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    packed = _packed(columns)
    if packed is not None:
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        return order, np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    order = np.lexsort(columns[::-1])
    change = np.zeros(len(order) - 1, bool)
    for c in columns:
        change |= c[order[1:]] != c[order[:-1]]
    return order, np.flatnonzero(np.r_[True, change])


def counted(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns, grouped, and the sums of their weights."""
    order, first = grouped(columns)
    rows = [c[order[first]] for c in columns]
    if weights is None or not len(order):
        return rows, np.diff(np.r_[first, len(order)])
    return rows, np.add.reduceat(weights[order], first)


def bucket_of(first: np.ndarray, second: np.ndarray, lexicon: Lexicon, buckets: int) -> np.ndarray:
    """The bucket of sequences by their first word, or by two words if the first is frequent."""
    hot = frequent_words(lexicon)
    with np.errstate(over="ignore"):
        spread = mixed(first.astype(np.uint64) * np.uint64(GOLDEN))
        finer = mixed(spread + second.astype(np.uint64) * np.uint64(GOLDEN))
    return (np.where((first >= 0) & (first < hot), finer, spread) % np.uint64(buckets)).astype(np.int32)


def frequent_words(lexicon: Lexicon) -> int:
    """The ranks below this have a quarter of a bucket's entries or more."""
    return int(np.searchsorted(-lexicon.counts, -(BUCKET_ENTRIES // 4), "right"))


def bucket_count(entries: int) -> int:
    return max(1, -(-entries // BUCKET_ENTRIES))
