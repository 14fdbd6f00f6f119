"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are the strings of one automaton whose letters are words.
The words of a document are streamed through it; after each word the automaton gives the
length of the longest suffix that occurs in an item. Where that is `size` or more, the
last `size` words are a window of an item. An item with fewer words is one window.

The automaton is sent to every task, so its size is bounded: items are divided by hash
into blocks of about `BLOCK_WORDS` words, and each block is one pass over the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import id_text, staged

SIZE = 10
BLOCK_WORDS = 1_000_000
# fixed value: a word of the contract, after lower-casing A-Z, in UTF-8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return WORD.findall(raw.lower())  # bytes.lower() changes A-Z only


@dataclass
class Items:
    """Generalised suffix automaton of word sequences, and what its states stand for."""

    size: int
    following: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[str]] = field(default_factory=lambda: [set()])
    short: dict[int, set[str]] = field(default_factory=dict)  # whole short items by state
    window: list[int] = field(default_factory=list)  # state of the last `size` words, or -1
    above: list[int] = field(default_factory=list)  # nearest state with a short item, or -1

    def _new(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.following.append(following)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        copy = self._new(self.length[p] + 1, dict(self.following[q]), self.link[q])
        while p >= 0 and self.following[p].get(word) == q:
            self.following[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        known = self.following[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.following[p]:
            self.following[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.following[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, item: str, words: list[bytes]) -> None:
        state = 0
        for word in words:
            state = self._extend(state, word)
            self.items[state].add(item)
        if 0 < len(words) < self.size:
            self.short.setdefault(state, set()).add(item)

    def close(self) -> "Items":
        """Hands the items down to the shorter suffixes and names the window states."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0 and self.length[self.link[state]] >= self.size:
                self.items[self.link[state]] |= self.items[state]
        self.window, self.above = [-1] * len(self.link), [-1] * len(self.link)
        for state in order:
            up = self.link[state]
            if self.length[state] >= self.size:
                self.window[state] = state if self.length[up] < self.size else self.window[up]
            else:
                self.items[state] = set()
            self.above[state] = state if state in self.short else self.above[up] if up > 0 else -1
        return self

    def plain(self) -> tuple:
        """The fields, which need no package on the executors."""
        return tuple(getattr(self, f.name) for f in fields(self))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words [from, to) inside windows, merged, and the items found."""
        following, link, length, size = self.following, self.link, self.length, self.size
        any_short = bool(self.short)
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        whole: set[str] = set()
        state = matched = 0
        for i, word in enumerate(words):
            to = following[state].get(word)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = following[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            reach = size if matched >= size else 0
            if reach:
                found.add(self.window[state])
            if any_short and self.above[state] >= 0:
                up = self.above[state]
                while up >= 0:
                    if length[up] <= matched:
                        whole |= self.short[up]
                        reach = max(reach, length[up])
                    up = self.above[link[up]] if link[up] > 0 else -1
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, whole.union(*(self.items[s] for s in found))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[Items]:
    """Automata of the items, one block after the other; the driver holds one at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")
    ).filter(F.col("text").isNotNull())
    # no item has more words than characters; this needs no second definition of a word
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    count = max(1, -(-total // block_words))
    for block in range(count):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == block).orderBy("item", "text")
        automaton = Items(size)
        for row in part.toLocalIterator():
            automaton.add(row["item"], words_of(row["text"]))
        yield automaton.close()


SCHEMA = "doc_id bigint, text string, n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, text, n_words, spans (word ranges inside windows) and items of every row.

    Null texts have no words. Items without a text or a word match nothing; items without
    an id share the id ''; repeated items count once by id. An empty benchmark or table
    gives no spans or rows. Of `docs` only id and text are read.
    """
    out = id_text(docs).select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for number, automaton in enumerate(_blocks(benchmark, size, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(automaton.plain())
        base = staged(out, "decontamination") if number else out

        def scanned(batches: Iterator[pa.RecordBatch], shared=shared, first=not number) -> Iterator[pa.RecordBatch]:
            known = Items(*shared.value)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                before = None if first else (batch.column("spans").to_pylist(), batch.column("items").to_pylist())
                counts, spans, items = [], [], []
                for i, text in enumerate(texts):
                    words = words_of(text)
                    hit, names = known.scan(words)
                    if before:
                        hit = _merged(hit + [(s["start"], s["end"]) for s in before[0][i]])
                        names = names.union(before[1][i])
                    counts.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in hit])
                    items.append(sorted(names))
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id"),
                        "text": batch.column("text"),
                        "n_words": pa.array(counts, pa.int64()),
                        "spans": pa.array(spans, SPANS),
                        "items": pa.array(items, pa.list_(pa.string())),
                    }
                )

        out = base.mapInArrow(scanned, SCHEMA)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = find_contamination(docs, benchmark, size)
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_uncontaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_hit: int = 0, max_share: float = 0.0
) -> DataFrame:
    """The rows of `docs`, all columns, with at most `max_hit` words or `max_share` of
    their words inside benchmark windows; null and empty texts stay."""
    for automaton in _blocks(benchmark, size, BLOCK_WORDS):
        shared = docs.sparkSession.sparkContext.broadcast(automaton.plain())

        @F.pandas_udf("boolean")
        def clean(texts, shared=shared):
            known = Items(*shared.value)

            def within(text):
                words = words_of(text)
                hit = sum(b - a for a, b in known.scan(words)[0])
                return hit <= max_hit or hit <= max_share * len(words)

            return texts.map(within).astype(bool)

        docs = docs.filter(clean(F.col("text").cast("string")))
    return docs


def remove_spans(texts_and_spans: DataFrame) -> DataFrame:
    """`find_contamination`'s rows with the hit words, and what stands between them, cut
    from the text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if text is not None and spans:
                    raw = text.encode()
                    at = [m.span() for m in WORD.finditer(raw.lower())]
                    for s in reversed(spans):
                        raw = raw[: at[s["start"]][0]] + raw[at[s["end"] - 1][1] :]
                    text = raw.decode()
                out.append(text)
            columns = {c: batch.column(c) for c in batch.schema.names}
            yield pa.record_batch(columns | {"text": pa.array(out, pa.string())})

    return texts_and_spans.mapInArrow(cut, SCHEMA)


def digest(items: list[str]) -> str:
    """Hash of item ids as the report gives it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
