"""Array hashes that tasks compute for words, shingles and substrings.

Plain functions and values only: they travel to the executors by value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# fixed values: odd multipliers of well-known 64-bit mixers
GOLDEN = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
MEMO_WORDS = 200_000
RUN_BYTES = 1 << 22


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """64-bit hashes of words met before."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes(words: list[bytes], memo: Memo) -> np.ndarray:
    """64-bit hash of each word; `memo` is emptied when it holds `MEMO_WORDS` words."""
    if len(memo) > MEMO_WORDS:
        memo.clear()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def word_letters(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text; equal words of a run of texts are hashed once."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        words = pc.ascii_split_whitespace(pc.fill_null(texts.slice(start, stop - start), ""))
        flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False)
        full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # nothing stands before a first space
        spelled = flat.dictionary_encode()
        known = spelled.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
        letters = hashes[spelled.indices.to_numpy()[full]] if len(known) else hashes
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        yield from np.split(letters, np.cumsum(counts)[:-1])
        start = stop


def byte_letters() -> np.ndarray:
    """A fixed random 64-bit letter for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(GOLDEN))


class Substrings:
    """Hash of any substring of one array of letters, by prefix sums."""

    def __init__(self, powers: "Powers", letters: np.ndarray):
        self.back = powers.back(len(letters) + 1)
        self.sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(letters * powers.up(len(letters)), out=self.sums[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self._up = self._back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("_up", GOLDEN), ("_back", pow(GOLDEN, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def up(self, n: int) -> np.ndarray:
        self._grow(n)
        return self._up[:n]

    def back(self, n: int) -> np.ndarray:
        self._grow(n)
        return self._back[:n]
