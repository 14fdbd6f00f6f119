"""Removal of repeated byte strings with a sparse suffix array, sorted deep and shallow.

The sparse array holds the suffixes that start at seeds (`seeds.py`): any `SIZE` equal
bytes share one. Occurrences with all surroundings equal are settled by their class. The
probes, one piece of text around the seed per class, meet by anchor, and there the
suffixes from the seed on and the reversed prefixes before it are sorted by deep-shallow
sorting: multikey quicksort down to `SHALLOW` bytes, then a blind trie for each group that
is still equal.

A string of `SIZE` bytes over the seed is repeated if some other piece shares enough bytes
before and after the seed together. Neighbours in the prefix order are united from the
longest shared prefix down; in each united set the suffixes stay in suffix order, so the
longest match with the other part of the set is next to a suffix. Each such pair of
neighbours gives one maximal match.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import id_text, staged
from tidewatch.llm.hashing import Powers, Substrings, byte_letters
from tidewatch.llm.seeds import FULL, PROBE, document_key, judge_seeds, merged, post_seeds, seeds, verdict_kinds, with_verdicts

SIZE = 200
GRAM = 32
SHALLOW = 24
KEY = 8  # bytes that one step of the quicksort compares
GROUP = 50_000  # pieces of one anchor that a task sorts; larger groups are compared by window hashes
SPAN = "struct<low:int,high:int>"
SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
PIECES = pa.list_(pa.struct([("anchor", pa.int64()), ("at", pa.int32()), ("left", pa.int32()), ("piece", pa.binary())]))
Node = list | tuple  # a leaf lists equal strings; an inner node is (place of the branch, children)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their strings, by insertion into a blind trie."""
    root: Node = [members[0]]
    for i in members[1:]:
        s = strings[i]
        path, node = [], root
        while isinstance(node, tuple):
            path.append(node)
            at, children = node
            node = children.get(s[at] if at < len(s) else -1) or next(iter(children.values()))
        t = strings[node[0]]
        shared = common_prefix(s, t)
        if shared == len(s) == len(t):
            node.append(i)
            continue
        branch = next((k for k, (at, _) in enumerate(path) if at >= shared), len(path))
        mine = s[shared] if shared < len(s) else -1
        if branch < len(path) and path[branch][0] == shared:
            path[branch][1][mine] = [i]
            continue
        below = path[branch] if branch < len(path) else node
        split = (shared, {mine: [i], (t[shared] if shared < len(t) else -1): below})
        if branch:
            at, children = path[branch - 1]
            children[s[at] if at < len(s) else -1] = split
        else:
            root = split
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, tuple):
            waiting += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            order += node
    return order


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Places of the strings in sorted order."""
    order: list[int] = []
    waiting: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while waiting:
        members, depth = waiting.pop()
        if len(members) < 2:
            order += members
        elif depth >= shallow:
            order += blind_trie_order(strings, members)
        else:
            pivot = strings[members[len(members) // 2]][depth : depth + KEY]
            less, same, more = [], [], []
            for i in members:
                key = strings[i][depth : depth + KEY]
                (same if key == pivot else less if key < pivot else more).append(i)
            ended = depth + KEY if len(pivot) == KEY else shallow
            waiting += [(more, depth), (same, ended), (less, depth)]
    return order


def match_group(pieces: list[bytes], lefts: list[int], size: int) -> Iterator[tuple[int, int, int]]:
    """Piece, and bytes before and after the seed, of maximal matches of `size` or more."""
    suffixes = [p[left:] for p, left in zip(pieces, lefts)]
    prefixes = [p[:left][::-1] for p, left in zip(pieces, lefts)]
    if len(pieces) == 2:
        before, after = common_prefix(*prefixes), common_prefix(*suffixes)
        if before + after >= size:
            yield 0, before, after
            yield 1, before, after
        return
    by_suffix = deep_shallow_order(suffixes)
    rank = [0] * len(pieces)
    for r, i in enumerate(by_suffix):
        rank[i] = r
    by_prefix = deep_shallow_order(prefixes)
    ties = sorted(
        ((common_prefix(prefixes[a], prefixes[b]), a, b) for a, b in zip(by_prefix, by_prefix[1:])), key=lambda t: -t[0]
    )
    home = list(range(len(pieces)))
    sets: list[list[int]] = [[r] for r in rank]

    def find(i: int) -> int:
        while home[i] != i:
            home[i] = home[home[i]]
            i = home[i]
        return i

    for before, a, b in ties:
        a, b = find(a), find(b)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        home[b] = a
        sets[b] = []
        for r in small:
            insort(large, r)
        pairs = set()
        for r in small:
            at = bisect_left(large, r)
            if at:
                pairs.add((large[at - 1], r))
            if at + 1 < len(large):
                pairs.add((r, large[at + 1]))
        for r, q in pairs:
            x, y = by_suffix[r], by_suffix[q]
            after = common_prefix(suffixes[x], suffixes[y])
            if before + after >= size:
                yield x, before, after
                yield y, before, after


def _cut(keyed: DataFrame, size: int, gram: int) -> DataFrame:
    """doc_id, text, spans (repeated for certain) and pieces (to sort) of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), byte_letters()
        for batch in batches:
            all_spans, all_pieces = [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, verdicts in zip(texts, batch.column("verdicts").to_pylist()):
                spans, pieces = [], []
                if verdicts:
                    at, anchors, around = seeds(table[np.frombuffer(text, np.uint8)], size, gram, powers)
                    kinds = verdict_kinds(around, verdicts)
                    low, high = np.maximum(at - (size - gram), 0), np.minimum(at + size, len(text))
                    full = (kinds & FULL) > 0
                    spans = merged(list(zip(low[full].tolist(), high[full].tolist())))
                    probes = np.flatnonzero(kinds & PROBE)
                    # a class that occurs twice in this text is one probe
                    probes = probes[np.unique(around[probes], return_index=True)[1]]
                    for i, a, p, lo, hi in zip(probes, anchors.view(np.int64)[probes].tolist(), at[probes].tolist(), low[probes].tolist(), high[probes].tolist()):
                        pieces.append({"anchor": a, "at": p, "left": p - lo, "piece": text[lo:hi]})
                all_spans.append([{"low": a, "high": b} for a, b in spans])
                all_pieces.append(pieces)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text": batch.column("text"),
                    "spans": pa.array(all_spans, SPANS),
                    "pieces": pa.array(all_pieces, PIECES),
                }
            )

    return keyed.mapInArrow(
        cut,
        f"doc_id bigint, text string, spans array<{SPAN}>, "
        "pieces array<struct<anchor:bigint,at:int,left:int,piece:binary>>",
    )


def _sorted_matches(pieces: DataFrame, size: int, group: int) -> DataFrame:
    """row, low and high of every match; pieces of too large groups come back as they are."""

    def out(found: list[tuple], kept: list[tuple]) -> pa.RecordBatch:
        rows = [(r, lo, hi, None, None, None) for r, lo, hi in found] + [(r, at, None, a, left, p) for a, r, at, left, p in kept]
        names = ("row", "low", "high", "anchor", "left", "piece")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(members: list[tuple]) -> list[tuple]:
            found: dict[int, list[tuple[int, int]]] = {}
            if len(members) > 1:
                for i, before, after in match_group([m[4] for m in members], [m[3] for m in members], size):
                    found.setdefault(i, []).append((members[i][2] - before, members[i][2] + after))
            return [(members[i][1], lo, hi) for i, spans in found.items() for lo, hi in merged(spans)]

        held: list[tuple] = []
        large = False  # the anchor at hand is too large to be sorted here
        for batch in batches:
            found, kept = [], []
            for member in zip(*(batch.column(c).to_pylist() for c in ("anchor", "row", "at", "left", "piece"))):
                if held and held[0][0] != member[0]:
                    if large:
                        kept += held
                    else:
                        found += settle(held)
                    held, large = [], False
                held.append(member)
                if len(held) > group:
                    kept += held[:-1]
                    held, large = held[-1:], True
            yield out(found, kept)
        if held:
            yield out([], held) if large else out(settle(held), [])

    return (
        pieces.repartition("anchor")
        .sortWithinPartitions("anchor", "row", "at")
        .mapInArrow(matched, "row bigint, low int, high int, anchor bigint, left int, piece binary")
    )


def _hashed_matches(pieces: DataFrame, size: int) -> DataFrame:
    """row, low and high of repeated windows of the pieces, by grouping window hashes.

    The way for anchors with too many different surroundings for one task.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), byte_letters()
        for batch in batches:
            rows, lows, hashes, checks = [], [], [], []
            for row, at, left, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "low", "left", "piece"))):
                letters = table[np.frombuffer(piece, np.uint8)]
                starts = np.arange(len(piece) - size + 1)
                rows.append(np.full(len(starts), row, np.int64))
                lows.append((starts + (at - left)).astype(np.int32))
                hashes.append(Substrings(powers, letters)(starts, starts + size).view(np.int64))
                checks.append(Substrings(powers, letters ^ (letters >> np.uint64(7)))(starts, starts + size).view(np.int64))
            if rows:
                yield pa.record_batch(
                    dict(zip(("row", "low", "hash", "check"), map(np.concatenate, (rows, lows, hashes, checks))))
                )

    # a window lies in the pieces of each of its seeds, but occurs once
    windows = pieces.mapInArrow(hashed, "row bigint, low int, hash bigint, check bigint").dropDuplicates(["row", "low"])
    repeated = windows.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return windows.join(repeated, ["hash", "check"], "left_semi").select("row", "low", (F.col("low") + size).alias("high"))


def _removed(rows: DataFrame) -> DataFrame:
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, counts, kept, digests = [], [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                spans = merged([(s["low"], s["high"]) for s in spans])
                ends = [0, *(s[1] for s in spans)]
                left = b"".join(text[a:b] for a, b in zip(ends, [*(s[0] for s in spans), len(text)]))
                sizes.append(len(text))
                gone.append(len(text) - len(left))
                counts.append(len(spans))
                kept.append(left)
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "n_spans": pa.array(counts, pa.int64()),
                    "kept_bytes": pa.array(kept, pa.binary()),
                    "kept_sha256": pa.array(digests, pa.string()),
                }
            )

    return rows.select("doc_id", "text", "spans").mapInArrow(
        removed, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary, kept_sha256 string"
    )


def remove_repeated_strings(docs: DataFrame, size: int = SIZE, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes and kept_sha256 of every row.

    A byte goes if a string of `size` bytes over it also starts anywhere else, in the same
    text or another, overlapping or not; strings are judged on the input and lie in one
    text. Null counts as empty; texts shorter than `size` stay whole; of repeated rows all
    lose what they share. What is kept need not be valid UTF-8. Only id and text are read.
    """
    keyed = (
        id_text(docs)
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("_doc", document_key(F.col("doc_id"), F.col("text")))
    )

    def letters(texts: pa.Array) -> Iterator[np.ndarray]:
        table = byte_letters()
        return (table[np.frombuffer(text, np.uint8)] for text in texts.cast(pa.binary()).to_pylist())

    verdicts = staged(judge_seeds(post_seeds(keyed, letters, size, gram), later=False), "string-seeds")
    rows = staged(
        _cut(with_verdicts(keyed, verdicts), size, gram).withColumn("_row", F.monotonically_increasing_id()), "string-rows"
    )
    probes = rows.filter(F.size("pieces") > 0)
    pieces = probes.select(F.col("_row").alias("row"), F.explode("pieces").alias("p")).select("row", "p.*")
    matches = staged(_sorted_matches(pieces, size, group), "string-matches")
    found = matches.filter(F.col("piece").isNull()).select("row", "low", "high")
    large = matches.filter(F.col("piece").isNotNull())
    if not large.isEmpty():
        found = found.unionByName(_hashed_matches(large.select("row", "low", "left", "piece"), size))
    more = found.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("low", "high")).alias("more"))
    sorted_rows = (
        probes.select("_row", "doc_id", "text", "spans")
        .join(more, "_row", "left")
        .select("doc_id", "text", F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))).alias("spans"))
    )
    return _removed(rows.filter(F.size("pieces") == 0).select("doc_id", "text", "spans").unionByName(sorted_rows))


def string_report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return remove_repeated_strings(docs, size).drop("kept_bytes")


def brute_force(texts: list[tuple[int, str | None]], size: int = SIZE) -> dict[int, tuple[int, int, int, str]]:
    """Bytes, removed bytes, spans and digest per id, by a table of all strings (for tests)."""
    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(hash(b[at : at + size]) for b in raw.values() for at in range(len(b) - size + 1))
    out = {}
    for i, b in raw.items():
        spans = merged([(at, at + size) for at in range(len(b) - size + 1) if seen[hash(b[at : at + size])] > 1])
        ends = [0, *(s[1] for s in spans)]
        kept = b"".join(b[x:y] for x, y in zip(ends, [*(s[0] for s in spans), len(b)]))
        out[i] = (len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    return out
