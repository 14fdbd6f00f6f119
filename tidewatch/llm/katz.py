"""Katz backoff language model over words, and the probability of texts under it.

The recursion: P(w | h) is the discounted share of the pair (h, w) among those of h; for a
pair never seen, the mass that h's discounts left, spread over the other words in
proportion to P(w); and P(w) is the discounted share of the word, or for a word never seen
the mass left by the discounts of all. Good-Turing discounts apply to counts up to `CUTOFF`.

    alpha(h) = (1 - sum P(w | h) over seen pairs) / (1 - sum P(w) over the same words)

so P( . | h) adds up to 1 over the known words and one unknown word, for every h.

Pairs of all texts meet once, in buckets by h (`lexicon.py`): there the training counts of a
pair are added up, and the bucket's table keeps the pairs, their counts and who asked for
them. When the counts of counts are known, each row of that table is evaluated by itself.
What a bucket cannot know, the rest of a context that is spread over buckets and the counts
of words outside the lexicon, is joined to the few tokens that need it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, staged
from tidewatch.llm.lexicon import (
    BUCKET_ENTRIES,
    LEXICON_WORDS,
    Lexicon,
    bucket_count,
    bucket_of,
    common_words,
    counted,
    frequent_words,
    grouped,
    key_of,
)

CUTOFF = 5
HELD_OUT_MODULUS, HELD_OUT = 7, 2
SHARD_TOKENS = 500_000
SHARD_TEXTS = 50_000
PIECE_BYTES = 1 << 22
ROW_ENTRIES = 1 << 16
START = -1  # the context of a text's first word
UNIT = float(1 << 30)  # log10 probabilities are added up in units of 2^-30
SUMS, TOKEN, RARE, CONTEXT, FOLLOWER = range(5)


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words and the end, which is the empty word."""
    return [*(text or b"").lower().split(), b""]


def coded(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the tokens of all texts, one after the other, and how many each has."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # nothing stands before a first space
    spelled = flat.dictionary_encode()
    numbers = lexicon.numbers(key_of(spelled.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)))
    ids = numbers[spelled.indices.to_numpy()[full]] if len(numbers) else np.zeros(0, np.int64)
    sizes = np.bincount(text[full], minlength=len(sizes)) + 1
    out = np.full(sizes.sum(), lexicon.numbers(key_of([b""]))[0], np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = ids
    return out, sizes


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `PIECE_BYTES` of text; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def discounts(ranks: list[int], most: int = CUTOFF) -> list[float]:
    """Good-Turing discounts of the counts 1 to k, as Katz renormalises them.

    ranks[r] is how many things have the count r. k is the largest number up to `most` for
    which every discount lies between 0 and 1; where there is none, a count of 1 is halved.
    """
    for k in range(min(most, len(ranks) - 2), 0, -1):
        if all(ranks[1 : k + 2]) and (beyond := (k + 1) * ranks[k + 1] / ranks[1]) < 1:
            found = [((r + 1) * ranks[r + 1] / (r * ranks[r]) - beyond) / (1 - beyond) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in found):
                return found
    return [0.5]


def _kept(counts: np.ndarray, cut: list[float]) -> np.ndarray:
    """What the discounts leave of each count."""
    table = np.array([0.0, *cut])
    return np.where(counts < len(table), table[np.minimum(counts, len(cut))], 1.0) * counts


def _fixed(values: np.ndarray) -> np.ndarray:
    return np.rint(values * UNIT).astype(np.int64)


class Words:
    """P(w) by count; `total` has one more where no count is discounted."""

    def __init__(self, total: int, ranks: list[int]):
        self.cut = discounts(ranks)
        small = sum(r * n * (1 - d) for r, n, d in zip(range(1, len(self.cut) + 1), ranks[1:], self.cut))
        self.total = total if small else total + 1
        self.unknown = (small or 1) / self.total

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _kept(counts, self.cut) / self.total, self.unknown)

    def column(self, count: Column) -> Column:
        kept = count.cast("double")
        for r, d in enumerate(self.cut, 1):
            kept = F.when(count == r, F.lit(d * r)).otherwise(kept)
        return F.when(count > 0, kept / self.total).otherwise(self.unknown)


def training_words(docs: DataFrame) -> DataFrame:
    """key and f: the tokens of the training texts (end included) and their counts."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        keys_only, held, size = Lexicon(none, none, True, none), [], 0

        def flushed():
            (keys,), sums = counted([np.concatenate(held)])
            held.clear()
            return pa.record_batch({"key": keys, "n": sums})

        for batch in batches:
            for piece in pieces_of(batch):
                held.append(coded(piece.column("text"), keys_only)[0])
                size += len(held[-1])
                if size > SHARD_TOKENS:
                    size = 0
                    yield flushed()
        if held:
            yield flushed()

    return docs.filter("NOT held_out").select("text").mapInArrow(tallied, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("f"))


# rows of the pair tables hold long lists
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}
HEAD = "struct<doc_id:bigint,held_out:boolean,n_tokens:bigint,n_known:bigint,base:double>"
HEADS = pa.list_(
    pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64())])
)
POSTS = f"bucket int, shard bigint, h array<bigint>, w array<bigint>, at array<int>, n array<int>, heads array<{HEAD}>"


def _shards(docs: DataFrame, shared, total: int, distinct: int, buckets: int) -> DataFrame:
    """Per shard of texts: one row of `heads`, and per bucket the pairs of words by text.

    `at` is the place of a training text in its shard, or -1 minus the place of another.
    """

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*shared.value)
        held, number, size, texts = [], TaskContext.get().partitionId() << 32, 0, 0

        def shard() -> pa.RecordBatch:
            nonlocal number
            number += 1
            w, sizes = (np.concatenate(x) for x in zip(*(x[:2] for x in held)))
            who, out = (pa.concat_arrays(x) for x in zip(*(x[2:] for x in held)))
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            h = np.r_[START, w[:-1]]
            h[starts] = START
            count = np.where(w >= 0, known.counts[np.maximum(w, 0)], 0) if len(known.counts) else np.zeros(len(w), np.int64)
            log = np.log10((count + 1) / (total + distinct + 1))
            if not known.complete:
                log[w < 0] = 0  # those come from a join
            heads = pa.StructArray.from_arrays(
                [who, out, pa.array(sizes), pa.array(np.add.reduceat(count > 0, starts, dtype=np.int64)), pa.array(np.add.reduceat(log, starts))],
                fields=list(HEADS.value_type),
            )
            place = np.repeat(np.arange(len(sizes)), sizes)
            (h, w, place), n = counted([h, w, place])
            at = np.where(out.to_numpy(zero_copy_only=False)[place], -1 - place, place).astype(np.int32)
            bucket = bucket_of(np.where(h == START, w, h), w, known, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, h, w, at, n = (x[order] for x in (bucket, h, w, at, n.astype(np.int32)))
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            # the first row has the heads, the others the pairs
            lists = pa.array(np.r_[0, 0, cuts[1:], len(bucket)].astype(np.int32))
            posts = {c: pa.ListArray.from_arrays(lists, pa.array(x)) for c, x in (("h", h), ("w", w), ("at", at), ("n", n))}
            first = pa.array(np.r_[0, np.full(len(cuts) + 1, len(sizes))].astype(np.int32))
            return pa.record_batch(
                {
                    "bucket": pa.array(np.r_[number % buckets, bucket[cuts]].astype(np.int32)),
                    "shard": pa.array(np.full(len(cuts) + 1, number, np.int64)),
                    **posts,
                    "heads": pa.ListArray.from_arrays(first, heads),
                }
            )

        for batch in batches:
            for piece in pieces_of(batch):
                held.append((*coded(piece.column("text"), known), piece.column("doc_id"), piece.column("held_out")))
                size, texts = size + len(held[-1][0]), texts + piece.num_rows
                if size > SHARD_TOKENS or texts > SHARD_TEXTS:
                    size = texts = 0
                    yield shard()
                    held.clear()
        if held:
            yield shard()

    return docs.select("doc_id", "held_out", "text").mapInArrow(sharded, POSTS)


TABLE = (
    "bucket int, shard bigint, heads array<{head}>, contexts array<bigint>, pairs array<int>, w array<bigint>, f array<bigint>, "
    "asked array<int>, shards array<bigint>, of array<int>, at array<int>, n array<int>, ranks array<bigint>, spread array<bigint>, least array<bigint>"
).format(head=HEAD)


TABLE_COLUMNS = [x.split()[0] for x in TABLE.replace(HEAD, "").split(", ")]


def pair_tables(posts: DataFrame, shared) -> DataFrame:
    """Rows of whole contexts of a bucket: their pairs with training counts, and who asked.

    contexts[i] has pairs[i] of the following words `w` with count `f`; of those each was
    asked for by `asked` texts: `n` times by the text `at` of the shard shards[of]. `ranks`
    are the counts of counts, `least` the least counts of the contexts in `spread`, which are
    in several buckets. Rows with `heads` pass through.
    """

    kinds = {"bucket": pa.int32(), "shard": pa.int64(), "heads": HEADS}
    kinds |= {c: pa.list_(pa.int64()) for c in ("contexts", "w", "f", "shards", "ranks", "spread", "least")}
    kinds |= {c: pa.list_(pa.int32()) for c in ("pairs", "asked", "of", "at", "n")}
    layout = pa.schema([(c, kinds[c]) for c in TABLE_COLUMNS])

    def united(table: pa.Table) -> pa.Table:
        hot = frequent_words(Lexicon(*shared.value))
        filled = pc.greater(pc.list_value_length(table.column("heads")), 0)
        heads = table.filter(filled).select(["bucket", "shard", "heads"])
        parts = [pa.table({c: heads.column(c) if c in heads.column_names else pa.nulls(heads.num_rows, kinds[c]) for c in TABLE_COLUMNS}, schema=layout)]
        rows = table.filter(pc.invert(filled))
        if rows.num_rows:
            distinct, number = np.unique(rows.column("shard").to_numpy(), return_inverse=True)
            of = np.repeat(number, pc.list_value_length(rows.column("h")).to_numpy()).astype(np.int32)
            h, w, at, n = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "w", "at", "n"))
            order, first = grouped([h, w])
            h, w, at, n, of = (x[order] for x in (h, w, at, n, of))
            f = np.add.reduceat(np.where(at >= 0, n, 0), first, dtype=np.int64)
            h, w, asked = h[first], w[first], np.diff(np.r_[first, len(at)]).astype(np.int32)
            opened = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])  # the first pair of each context
            # whole contexts, until a row has ROW_ENTRIES entries
            filling = first[opened] // ROW_ENTRIES
            cuts = [*np.flatnonzero(np.r_[True, filling[1:] != filling[:-1]]).tolist(), len(opened)]
            pair_ends, entry_ends = np.r_[opened, len(w)], np.r_[first, len(at)]
            for a, b in zip(cuts, cuts[1:]):
                p, q = pair_ends[a], pair_ends[b]
                u, v = entry_ends[p], entry_ends[q]
                contexts, begin = h[opened[a:b]], opened[a:b] - p
                spread = (contexts == START) | ((contexts >= 0) & (contexts < hot))
                least = np.minimum.reduceat(np.where(f[p:q] > 0, f[p:q], np.iinfo(np.int64).max), begin)
                used, of_row = np.unique(of[u:v], return_inverse=True)
                row = {
                    "contexts": contexts,
                    "pairs": np.diff(np.r_[begin, q - p]).astype(np.int32),
                    "w": w[p:q],
                    "f": f[p:q],
                    "asked": asked[p:q],
                    "shards": distinct[used],
                    "of": of_row.astype(np.int32),
                    "at": at[u:v],
                    "n": n[u:v],
                    "ranks": np.bincount(np.minimum(f[p:q], CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2],
                    "spread": contexts[spread],
                    "least": least[spread],
                }
                lists = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kinds[c].value_type)) for c, x in row.items()}
                lists["bucket"] = pa.array([rows.column("bucket")[0].as_py()], pa.int32())
                parts.append(pa.table({c: lists.get(c, pa.nulls(1, kinds[c])) for c in TABLE_COLUMNS}, schema=layout))
        return pa.concat_tables(parts)

    return posts.groupBy("bucket").applyInArrow(united, TABLE)


TERMS = "kind int, h bigint, w bigint, shard bigint, at array<int>, v array<bigint>, x double, y double"


def evaluated(tables: DataFrame, shared, words: Words, cut: list[float], starts: int, bare: set[int]) -> DataFrame:
    """What the buckets know of the texts' log10 probabilities, and what they still need.

    SUMS: v to add to the texts at; TOKEN: v for a text, to which log alpha(h) and log P(w)
    are still to come if h and w are given; RARE: v occurrences in a text of a word outside
    the lexicon; CONTEXT: the mass x that h's discounts leave and the P(w) y of its seen
    words; FOLLOWER: a seen word of h outside the lexicon. `bare` are the spread contexts
    without a discounted pair, `starts` is the number of training texts.
    """

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*shared.value)
        hot = frequent_words(known)
        held: list[tuple[np.ndarray, ...]] = []
        bucket = None
        for batch in batches:
            for i in range(batch.num_rows):
                # the rows of a bucket stand together; their sums are added up before they leave
                if held and (batch.column("bucket")[i].as_py() != bucket or sum(len(x[0]) for x in held) > BUCKET_ENTRIES):
                    yield summed(held)
                    held.clear()
                bucket = batch.column("bucket")[i].as_py()
                row = {c: batch.column(c)[i].values.to_numpy() for c in ("contexts", "pairs", "w", "f", "asked", "shards", "of", "at", "n")}
                yield from _terms(row, known, hot, held)
        if held:
            yield summed(held)

    def out(kind, n, h=None, w=None, shard=None, at=None, v=None, x=None, y=None):
        columns = {"h": (h, pa.int64()), "w": (w, pa.int64()), "shard": (shard, pa.int64()), "at": (at, pa.list_(pa.int32()))}
        columns |= {"v": (v, pa.list_(pa.int64())), "x": (x, pa.float64()), "y": (y, pa.float64())}
        return pa.record_batch(
            {"kind": pa.array(np.full(n, kind, np.int32))} | {c: pa.nulls(n, k) if a is None else a if isinstance(a, pa.Array) else pa.array(a, k) for c, (a, k) in columns.items()}
        )

    def summed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        shard, at, fixed = (np.concatenate(x) for x in zip(*held))
        shards, number = np.unique(shard, return_inverse=True)
        (number, at), sums = counted([number.astype(np.int64), at.astype(np.int64)], fixed)
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        lists = pa.array(np.r_[cuts, len(number)].astype(np.int32))
        return out(
            SUMS, len(cuts), shard=shards[number[cuts]], at=pa.ListArray.from_arrays(lists, pa.array(at.astype(np.int32))),
            v=pa.ListArray.from_arrays(lists, pa.array(sums)),
        )

    def _terms(row: dict[str, np.ndarray], known: Lexicon, hot: int, held: list) -> Iterator[pa.RecordBatch]:
        contexts, w, f = row["contexts"], row["w"], row["f"]
        begin = np.r_[0, np.cumsum(row["pairs"])[:-1]]
        context = np.repeat(np.arange(len(contexts)), row["pairs"])
        add = lambda x: np.add.reduceat(x, begin)
        spread = (contexts == START) | ((contexts >= 0) & (contexts < hot))
        size = add(f)
        if spread.any():
            size[spread] = [starts if c == START else known.counts[c] for c in contexts[spread].tolist()]
        small = add((f > 0) & (f <= len(cut))) > 0
        small[spread] = [c not in bare for c in contexts[spread].tolist()]
        total = size + (~small & (size > 0))
        kept = _kept(f, cut)
        # this bucket's part of what is left: of the one added to a total, its share of the counts
        left = np.where(small, add(f - kept), add(f) / np.maximum(size, 1)) / np.maximum(total, 1)
        common = w >= 0
        count = np.where(common, known.counts[np.maximum(w, 0)], 0) if len(known.counts) else np.zeros(len(w), np.int64)
        single = words(count)
        told = common | known.complete  # P(w) is known here
        seen = f > 0
        mass = add(np.where(seen & told, single, 0.0))
        open_context = spread | (add(seen & ~told) > 0)
        wanted = spread | (open_context & (add(~seen) > 0))
        alpha = np.zeros(len(contexts))
        closed = ~open_context & (size > 0) & (left > 0)
        alpha[closed] = np.log10(left[closed] / (1 - mass[closed]))
        with np.errstate(divide="ignore"):
            value = np.where(seen, np.log10(kept / np.maximum(total, 1)[context]), alpha[context] + np.where(told, np.log10(single), 0.0))
        needs_alpha = ~seen & open_context[context] & (size > 0)[context]
        needs_word = ~seen & ~told
        per = row["asked"]
        place, shard = np.where(row["at"] < 0, -1 - row["at"], row["at"]), row["of"]
        wait = np.repeat(needs_alpha | needs_word, per)
        fixed = np.repeat(_fixed(value), per) * row["n"]

        ready = np.flatnonzero(~wait)
        if len(ready):
            held.append((row["shards"][shard[ready]], place[ready], fixed[ready]))

        def singly(values, which):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32)), pa.array(values[which]))

        late = np.flatnonzero(wait)
        pair = np.repeat(np.arange(len(w)), per)
        if len(late):
            p = pair[late]
            yield out(
                TOKEN, len(late), h=pa.array(contexts[context[p]], mask=~needs_alpha[p]), w=pa.array(w[p], mask=~needs_word[p]),
                shard=row["shards"][shard[late]], at=singly(place.astype(np.int32), late),
                v=pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(late) + 1, 2, dtype=np.int32)), pa.array(np.stack([fixed[late], row["n"][late].astype(np.int64)], 1).ravel())),
            )
        if not known.complete:
            rare = np.flatnonzero(~common[pair])
            if len(rare):
                yield out(RARE, len(rare), w=w[pair[rare]], shard=row["shards"][shard[rare]], at=singly(place.astype(np.int32), rare), v=singly(row["n"].astype(np.int64), rare))
            follower = np.flatnonzero(wanted[context] & seen & ~told)
            if len(follower):
                yield out(FOLLOWER, len(follower), h=contexts[context[follower]], w=w[follower])
        which = np.flatnonzero(wanted & (size > 0))
        if len(which):
            yield out(CONTEXT, len(which), h=contexts[which], x=left[which], y=mass[which])

    asked = tables.filter(F.col("heads").isNull()).select("bucket", "contexts", "pairs", "w", "f", "asked", "shards", "of", "at", "n")
    return asked.mapInArrow(terms, TERMS)


def score_texts(docs: DataFrame, held_out: Column, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The model learns from the rows for which `held_out` is not true. Tokens are the words,
    A-Z lower-cased, and an end. n_known counts tokens that the training texts hold (of
    train_tokens); base_score is the add-one unigram log10 probability of the text, score
    that of the Katz model; both take all unknown words as one. A null or empty text is its
    end alone. Without training texts every probability is 1. Null and repeated ids are rows
    like others, repeated rows count each time; other columns are not read. Words are told
    apart by 63-bit hashes. `docs` must give its rows in a repeatable order, as a scan does.
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    counts = staged(training_words(docs), "katz-words")
    end = int(key_of([b""])[0])
    ranks = [F.count(F.when(F.col("f") == r, 1)).alias(f"r{r}") for r in range(1, CUTOFF + 2)]
    facts = counts.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("total"), F.count("key").alias("distinct"),
        F.coalesce(F.max(F.when(F.col("key") == end, F.col("f"))), F.lit(0)).alias("starts"), *ranks,
    ).first()
    words = Words(facts["total"], [0, *(facts[f"r{r}"] for r in range(1, CUTOFF + 2))])
    lexicon = common_words(counts, 1, lexicon_words)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.keys, lexicon.counts, lexicon.complete, lexicon.order))
    posts = _shards(docs, shared, facts["total"], facts["distinct"], bucket_count(facts["total"]))
    tables = staged(pair_tables(posts, shared), "katz-pairs")
    ranks = [F.coalesce(F.sum(F.col("ranks")[r]), F.lit(0)).alias(f"r{r}") for r in range(1, CUTOFF + 2)]
    found = tables.agg(*ranks).first()
    cut = discounts([0, *found])
    # contexts with a quarter of a bucket's pairs: words of the lexicon and the start of a text
    spread = tables.select(F.explode(F.arrays_zip("spread", "least")).alias("s")).groupBy("s.spread").agg(F.min("s.least").alias("least"))
    bare = {r["spread"] for r in spread.filter(F.col("least") > len(cut)).collect()}
    terms = staged(
        evaluated(tables, shared, words, cut, facts["starts"], bare), "katz-terms", SMALL_BATCHES
    )
    return _assembled(tables, terms, counts, words, facts["total"], facts["distinct"])


def _assembled(tables: DataFrame, terms: DataFrame, counts: DataFrame, words: Words, total: int, distinct: int) -> DataFrame:
    of_kind = lambda kind: terms.filter(F.col("kind") == kind)
    word = counts.select(F.col("key").alias("w"), "f")
    count = F.coalesce(F.col("f"), F.lit(0))
    rare_mass = of_kind(FOLLOWER).select("h", "w").join(word, "w").groupBy("h").agg(F.sum(words.column(count)).alias("rare"))
    context = (
        of_kind(CONTEXT).groupBy("h").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).join(rare_mass, "h", "left")
        .select("h", F.log10(F.col("x") / (1 - F.col("y") - F.coalesce(F.col("rare"), F.lit(0.0)))).alias("alpha"))
    )
    fixed = lambda c: F.round(c * UNIT).cast("bigint")
    late = (
        of_kind(TOKEN)
        .select("h", "w", "shard", F.col("at")[0].alias("at"), F.col("v")[0].alias("v"), F.col("v")[1].alias("n"))
        .join(context, "h", "left")
        .join(word, "w", "left")
        .select(
            "shard", "at",
            (
                F.col("v")
                + F.col("n") * F.coalesce(fixed(F.col("alpha")), F.lit(0))
                + F.when(F.col("w").isNotNull(), F.col("n") * fixed(F.log10(words.column(count)))).otherwise(0)
            ).alias("v"),
        )
    )
    rare = (
        of_kind(RARE).select("w", "shard", F.col("at")[0].alias("at"), F.col("v")[0].alias("n")).join(word, "w", "left")
        .select("shard", "at", F.when(count > 0, F.col("n")).otherwise(0).alias("k"), (F.col("n") * fixed(F.log10((count + 1) / F.lit(total + distinct + 1)))).alias("b"))
    )
    summed = (
        late.select("shard", "at", "v", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("b"))
        .unionByName(rare.withColumn("v", F.lit(0).cast("bigint")))
        .groupBy("shard", "at")
        .agg(F.sum("v").alias("v"), F.sum("k").alias("k"), F.sum("b").alias("b"))
    )
    one = lambda c: F.array(c).alias(c)
    nothing = F.lit(None)
    parts = (
        tables.filter(F.col("heads").isNotNull())
        .select("shard", "heads", nothing.cast("array<int>").alias("at"), *(nothing.cast("array<bigint>").alias(c) for c in "vkb"))
        .unionByName(of_kind(SUMS).select("shard", "at", "v"), allowMissingColumns=True)
        .unionByName(summed.select("shard", one("at"), one("v"), one("k"), one("b")), allowMissingColumns=True)
    )

    def joined(table: pa.Table) -> pa.Table:
        head = table.column("heads").drop_null()[0].values
        n = len(head)
        sums = {c: np.zeros(n, np.int64) for c in "vkb"}
        rows = table.filter(pc.is_null(table.column("heads")))
        for i in range(rows.num_rows):
            at = rows.column("at")[i].values.to_numpy()
            for c, into in sums.items():
                if rows.column(c)[i].is_valid:
                    np.add.at(into, at, rows.column(c)[i].values.to_numpy())
        known = head.field("n_known").to_numpy() + sums["k"]
        return pa.table(
            {
                "doc_id": head.field("doc_id"),
                "held_out": head.field("held_out"),
                "n_tokens": head.field("n_tokens"),
                "n_known": known,
                "train_tokens": np.full(n, total, np.int64),
                "base_score": head.field("base").to_numpy() + sums["b"] / UNIT,
                "score": sums["v"] / UNIT,
            }
        )

    return parts.groupBy("shard").applyInArrow(
        joined, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )


def score_report(docs: DataFrame) -> DataFrame:
    """Scores of all rows by a model of those whose crc32 of the id modulo 7 is not 2."""
    return score_texts(docs, fold(F.col("doc_id"), HELD_OUT_MODULUS) == HELD_OUT)


class BruteForce:
    """The same model from plain dictionaries (for tests)."""

    def __init__(self, texts: list[str | None]):
        rows = [tokens((t or "").encode()) for t in texts]
        self.words = Counter(w for r in rows for w in r)
        self.pairs: dict = defaultdict(Counter)
        for r in rows:
            for h, w in zip([None, *r], r):
                self.pairs[h][w] += 1
        self.total = sum(self.words.values())
        self.single = self._table(self.words, discounts(self._ranks(self.words.values())))
        cut = discounts(self._ranks([f for c in self.pairs.values() for f in c.values()]))
        self.seen = {h: self._table(c, cut) for h, c in self.pairs.items()}

    @staticmethod
    def _ranks(counts) -> list[int]:
        tally = Counter(counts)
        return [0, *(tally[r] for r in range(1, CUTOFF + 2))]

    @staticmethod
    def _table(counts: Counter, cut: list[float]) -> tuple[dict, float]:
        """Probabilities of what was seen, and what is left for the rest."""
        total = sum(counts.values()) + (not any(f <= len(cut) for f in counts.values()))
        table = {w: f * (cut[f - 1] if f <= len(cut) else 1.0) / total for w, f in counts.items()}
        return table, 1 - math.fsum(table.values())

    def p(self, w: bytes | None, h: bytes | None) -> float:
        """P(w | h); w None is the unknown word, h None the start of a text."""
        lower = self.single[0].get(w, self.single[1])
        if h not in self.seen:
            return lower
        table, left = self.seen[h]
        return table[w] if w in table else left / (1 - math.fsum(self.single[0][x] for x in table)) * lower

    def scores(self, text: str | None) -> tuple[int, int, int, float, float]:
        """n_tokens, n_known, train_tokens, base_score and score of a text."""
        row = tokens((text or "").encode())
        base = math.fsum(math.log10((self.words[w] + 1) / (self.total + len(self.words) + 1)) for w in row)
        score = math.fsum(math.log10(self.p(w, h)) for h, w in zip([None, *row], row))
        return len(row), sum(w in self.words for w in row), self.total, base, score
