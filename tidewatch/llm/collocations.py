"""Phrase collocations from weighted acyclic automata.

A count transducer is a deterministic acyclic automaton over words whose arcs stand one
after the other, state by state; a path of `order` arcs is a phrase and its weight the
phrase's count. A shard of documents sorts its phrases and adds them to a transducer in
that order, so a new phrase only ever opens states at the end of the path of the one
before. The transducers of all shards are cut into ranges by their prefix, and in each
range united, adding weights. Parts of a phrase are looked up by composition: its arcs with
those of the transducers of the shorter phrases.

Two facts that hold for all counts save work: a phrase is no more frequent than its words,
nor than the pairs of words in it. So words below the least count end a piece, and the
pairs that reach it, in a Bloom filter of fixed size, rule out most triples. A full filter
rules out nothing; the counts of what is left are always those of all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import staged
from tidewatch.llm.hashing import GOLDEN, mixed
from tidewatch.llm.lexicon import (
    LEXICON_WORDS,
    MEMO_WORDS,
    Coder,
    Lexicon,
    bucket_count,
    bucket_of,
    common_words,
    counted,
    prefix_seed,
    word_key,
)

LEAST = 10
TOP_PHRASES = 2000
COVER_PERCENT = 50
SCALE = 1_000_000
NO_LANG = "und"
SHARD_TOKENS = 1_000_000
SHARD_WORDS = 200_000
FILTER_WORDS = 1 << 21  # of 64 bits
END = -1  # between pieces; keys of words lie far below
# fixed values of the contract: what ends a piece, and what separates words in one
BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n" * 10 + b" ")


def pieces(text: bytes | None) -> list[bytes]:
    r"""Lower-cased words of a text; `\n`, which no word is, ends a piece."""
    return [w for w in (text or b"").lower().translate(BREAKS).replace(b"\n", b" \n ").split(b" ") if w]


@dataclass
class Transducer:
    """Arcs by level: labels, how many arcs leave the state behind each arc, and weights."""

    labels: list[np.ndarray]
    fans: list[np.ndarray]
    weights: np.ndarray

    @classmethod
    def of_sorted(cls, columns: list[np.ndarray], weights: np.ndarray) -> "Transducer":
        """Adds distinct phrases in order: an arc is new where the path to it is."""
        new, labels, starts = np.zeros(len(weights), bool), [], []
        for column in columns:
            new = new | np.r_[True, column[1:] != column[:-1]][: len(column)]
            labels.append(column[new])
            starts.append(np.flatnonzero(new))
        fans = [
            np.diff(np.r_[np.searchsorted(below, above), len(below)]).astype(np.int32) for above, below in zip(starts, starts[1:])
        ]
        return cls(labels, fans, weights)

    def phrases(self) -> list[np.ndarray]:
        """The label columns of all paths, in order."""
        columns = [self.labels[0]]
        for fan, labels in zip(self.fans, self.labels[1:]):
            columns = [np.repeat(c, fan) for c in columns] + [labels]
        return columns

    @classmethod
    def union(cls, parts: list["Transducer"]) -> "Transducer":
        """One transducer of all paths; weights of equal paths are added."""
        columns = [np.concatenate(c) for c in zip(*(p.phrases() for p in parts))]
        return cls.of_sorted(*counted(columns, np.concatenate([p.weights for p in parts])))

    def above(self, least: int) -> tuple[list[np.ndarray], np.ndarray]:
        keep = self.weights >= least
        return [c[keep] for c in self.phrases()], self.weights[keep]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def _range_fields(order: int) -> tuple[str, list[str]]:
    labels = [f"labels{k}" for k in range(order)]
    fans = [f"fan{k}" for k in range(1, order)]
    schema = ", ".join([f"{c} array<bigint>" for c in labels] + [f"{c} array<int>" for c in fans])
    return f"bucket int, {schema}, weights array<bigint>", labels + fans


def _range_batch(buckets: list[int], parts: list[Transducer]) -> pa.RecordBatch:
    order = len(parts[0].labels)
    names = _range_fields(order)[1]
    arrays = [_lists([p.labels[k] for p in parts], pa.int64()) for k in range(order)]
    arrays += [_lists([p.fans[k] for p in parts], pa.int32()) for k in range(order - 1)]
    return pa.record_batch(
        [pa.array(buckets, pa.int32()), *arrays, _lists([p.weights for p in parts], pa.int64())], ["bucket", *names, "weights"]
    )


def _by_range(columns: list[np.ndarray], weights: np.ndarray, lexicon: Lexicon, buckets: int) -> pa.RecordBatch:
    """A shard's sorted phrases as one transducer per range."""
    bucket = bucket_of(columns[0], columns[1], lexicon, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket, columns, weights = bucket[order], [c[order] for c in columns], weights[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    spans = list(zip(cuts.tolist(), np.r_[cuts[1:], len(bucket)].tolist()))
    return _range_batch(
        bucket[cuts].tolist(), [Transducer.of_sorted([c[a:b] for c in columns], weights[a:b]) for a, b in spans]
    )


def _bits(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a pair in the filter."""
    one = mixed(mixed(a.astype(np.uint64) * np.uint64(GOLDEN)) + b.astype(np.uint64) * np.uint64(GOLDEN))
    return (one >> np.uint64(37)).astype(np.int64), (one & np.uint64((FILTER_WORDS << 6) - 1)).astype(np.int64)


def _in_filter(bits: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    hit = np.ones(len(a), bool)
    for place in _bits(a, b):
        hit &= (bits[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return hit


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f and key: the occurrences of each word in each language."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}

        def flushed():
            rows = [(lang, w, n) for lang, words in tally.items() for w, n in words.items()]
            tally.clear()
            langs, words, sums = zip(*rows) if rows else ((), (), ())
            return pa.record_batch(
                {
                    "lang": pa.array(langs, pa.string()),
                    "word": pa.array(words, pa.binary()).cast(pa.string()),
                    "n": pa.array(sums, pa.int64()),
                }
            )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                words = tally.setdefault(lang, Counter())
                words.update(pieces(text))
                words.pop(b"\n", None)
                if sum(map(len, tally.values())) > SHARD_WORDS:
                    yield flushed()
        yield flushed()

    return (
        docs.mapInArrow(tallied, "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("f"))
        .withColumn("key", word_key(F.col("lang"), F.col("word")))
    )


def phrase_counts(
    docs: DataFrame, lexicon: Lexicon, tokens: int, least: int, order: int, pairs: np.ndarray | None = None
) -> DataFrame:
    """k0, k1(, k2) and f of the phrases of `order` words with at least `least` occurrences;
    with `pairs`, a Bloom filter, phrases with a pair of words outside it are not counted."""
    buckets = bucket_count(tokens)
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((lexicon.keys, lexicon.counts, lexicon.complete, lexicon.order))
    filtered = context.broadcast(pairs) if pairs is not None else None
    schema, _ = _range_fields(order)

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*shared.value)
        coders: dict[str, Coder] = {}
        held: list[np.ndarray] = []

        def shard() -> pa.RecordBatch | None:
            ids = np.concatenate(held)
            held.clear()
            inside = ids != END
            if known.complete:
                inside &= ids >= 0  # others are too rare
            ok = inside[:-1] & inside[1:]
            if order == 3:
                if filtered is not None:
                    at = np.flatnonzero(ok)
                    keys = known.keys_of(ids)
                    ok[at] = _in_filter(filtered.value, keys[at], keys[at + 1])
                ok = ok[:-1] & ok[1:]
            at = np.flatnonzero(ok)
            return _by_range(*counted([ids[at + k] for k in range(order)]), known, buckets) if len(at) else None

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                if lang not in coders:
                    if len(coders) >= 64:
                        coders.clear()
                    coders[lang] = Coder(known, prefix_seed(lang.encode()), MEMO_WORDS // 4)
                coder = coders[lang]
                coder.memo[b"\n"] = END
                held += [coder(pieces(text)), np.array([END])]
                size += len(held[-2]) + 1
                if size > SHARD_TOKENS:
                    size, out = 0, shard()
                    if out:
                        yield out
        if held and (out := shard()):
            yield out

    def united(table: pa.Table) -> pa.Table:
        known = Lexicon(*shared.value)
        names = _range_fields(order)[1]
        rows = [table.column(c).combine_chunks() for c in (*names, "weights")]
        parts = [
            Transducer(values[:order], values[order:-1], values[-1])
            for values in ([c[i].values.to_numpy() for c in rows] for i in range(table.num_rows))
        ]
        columns, weights = Transducer.union(parts).above(least)
        out = {f"k{k}": known.keys_of(c) for k, c in enumerate(columns)}
        return pa.table(out | {"f": weights})

    keys = ", ".join(f"k{k} bigint" for k in range(order))
    return docs.mapInArrow(sharded, schema).groupBy("bucket").applyInArrow(united, f"{keys}, f bigint")


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """Bloom filter of the pairs (k0, k1), `FILTER_WORDS` words of 64 bits."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_bits(*(batch.column(c).to_numpy() for c in ("k0", "k1"))))
            yield pa.record_batch({"at": (at >> 6).astype(np.int32), "bit": np.int64(1) << (at & 63)})

    found = pairs.mapInArrow(places, "at int, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    bits = np.zeros(FILTER_WORDS, np.int64)
    bits[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return bits.view(np.uint64)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE a a / (left right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(
    docs: DataFrame,
    least: int = LEAST,
    top: int = TOP_PHRASES,
    cover_percent: int = COVER_PERCENT,
    lexicon_words: int = LEXICON_WORDS,
) -> DataFrame:
    """The `top` phrases of two or three words of each language: lang, rank, phrase, a, l, r,
    n and score.

    a, l and r are the occurrences of the phrase and of the two parts of its lowest-scoring
    cut (of equals the first), n those of all words of the language, score is
    floor(1000000 a a / (l r)). Phrases lie within pieces between any of `.,;:!?` and line
    ends, occur at least `least` times, and are dropped where a longer such phrase that holds
    them has `cover_percent` of their occurrences. Null texts have no words, a null language
    is `und`; repeated rows count each time; ids and other columns are not read. Products are
    exact up to 38 digits; counts up to 10^12 stay within that.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    words = staged(word_counts(texts), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lexicon = common_words(words, least, lexicon_words)
    pairs = staged(phrase_counts(texts, lexicon, tokens, least, 2), "collocation-pairs")
    triples = staged(phrase_counts(texts, lexicon, tokens, least, 3, pair_filter(pairs)), "collocation-triples")

    def single(k: int) -> DataFrame:
        return words.filter(F.col("f") >= least).select(F.col("key").alias(f"k{k}"), F.col("f").alias(f"f{k}"), F.col("word").alias(f"w{k}"), F.col("lang").alias(f"lang{k}"))

    def both(first: int) -> DataFrame:
        return pairs.select(
            F.col("k0").alias(f"k{first}"), F.col("k1").alias(f"k{first + 1}"), F.col("f").alias(f"f{first}{first + 1}")
        )

    covers = (
        triples.select(F.explode(F.array(F.struct("k0", "k1", "f"), F.struct(F.col("k1").alias("k0"), F.col("k2").alias("k1"), "f"))).alias("p"))
        .groupBy("p.k0", "p.k1")
        .agg(F.max("p.f").alias("cover"))
    )
    two = (
        pairs.join(covers, ["k0", "k1"], "left")
        .filter(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("f") * cover_percent))
        .join(single(0).drop("lang0"), "k0")
        .join(single(1).withColumnRenamed("lang1", "lang"), "k1")
        .select(
            "lang", F.concat_ws(" ", "w0", "w1").alias("phrase"), F.col("f").alias("a"), F.col("f0").alias("l"), F.col("f1").alias("r"),
            _score(F.col("f"), F.col("f0"), F.col("f1")).alias("score"),
        )
    )
    cuts = [
        F.struct(_score(F.col("f"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
        for k, left, right in ((1, F.col("f0"), F.col("f12")), (2, F.col("f01"), F.col("f2")))
    ]
    three = (
        triples.join(both(0), ["k0", "k1"])
        .join(both(1), ["k1", "k2"])
        .join(single(0).drop("lang0"), "k0")
        .join(single(1).drop("f1", "lang1"), "k1")
        .join(single(2).withColumnRenamed("lang2", "lang"), "k2")
        .select("lang", F.concat_ws(" ", "w0", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.least(*cuts).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        two.unionByName(three)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# the contract's values, written down apart from the operator
ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS MATERIALIZED (
  SELECT lang, g, CAST(count(*) AS BIGINT) AS f FROM (
    SELECT lang, unnest(w) AS g FROM lists
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists)
  GROUP BY lang, g),
candidates AS MATERIALIZED (SELECT lang, g, f, string_split(g, ' ') AS w FROM grams WHERE f >= 10 AND contains(g, ' ')),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE NOT contains(g, ' ') GROUP BY lang),
parts AS (
  SELECT lang, g, f, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM candidates
  UNION ALL SELECT lang, g, f, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE len(w) = 3),
scored AS (
  SELECT p.lang, p.g, p.f AS a, u.f AS l, v.f AS r,
         CAST((1000000 * CAST(p.f AS HUGEINT) * p.f) // (CAST(u.f AS HUGEINT) * v.f) AS BIGINT) AS score
  FROM parts p JOIN grams u ON u.lang = p.lang AND u.g = p.x JOIN grams v ON v.lang = p.lang AND v.g = p.y
  QUALIFY row_number() OVER (PARTITION BY p.lang, p.g ORDER BY score, p.k) = 1),
covers AS (
  SELECT lang, g, max(f) AS f FROM (
    SELECT lang, w[1] || ' ' || w[2] AS g, f FROM candidates WHERE len(w) = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM candidates WHERE len(w) = 3)
  GROUP BY lang, g),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN covers v ON v.lang = s.lang AND v.g = s.g WHERE v.f IS NULL OR 100 * v.f < 50 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT k.lang, k.rank, k.g AS phrase, k.a, k.l, k.r, t.n, k.score
FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000
"""
