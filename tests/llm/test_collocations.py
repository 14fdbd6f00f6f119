"""Collocations against the check SQL, also with a lexicon that holds few words."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import collocations, lexicon

SCHEMA = "doc_id bigint, text string, lang string, source string, f int, key string, k0 string"


def texts():
    rng = random.Random(9)
    vocabulary = ["a", "b", "É", "été", "C", "c", "x\x00y", "|", "-", "\x1c", "日本"]
    rows = []
    for i in range(120):
        words = [vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.5)))] for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for w in words), rng.choice(["en", "fr", None, "und"])))
    rows += [(200, None, "en"), (201, "", "fr"), (202, " \t\n", None), (202, "a b c " * 40, "en"), (None, "a b c " * 3000, None)]
    return rows + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "z", "q") for i, t, lang in rows], SCHEMA).repartition(3)


def oracle(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    return sorted(con.execute(collocations.ORACLE).fetchall())


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("words", [lexicon.LEXICON_WORDS, 3, 0])
def test_equals_sql_whatever_the_lexicon_holds(spark, words):
    rows = texts()
    got = collocations.collocations(frame(spark, rows), lexicon_words=words).select(*COLUMNS).collect()
    want = oracle(rows)
    assert len(want) > 50 and sorted(map(tuple, got)) == want


def test_nothing_to_count(spark):
    for rows in ([], [(1, None, None)], [(1, "", "en"), (2, "a b", "en")]):
        assert collocations.collocations(frame(spark, rows)).collect() == []


def test_shards_and_ranges_do_not_matter(spark, monkeypatch):
    rows = texts()
    monkeypatch.setattr(collocations, "SHARD_TOKENS", 50)
    monkeypatch.setattr(lexicon, "BUCKET_ENTRIES", 400)
    got = collocations.collocations(frame(spark, rows)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == oracle(rows)


def test_union_of_transducers_adds_weights():
    rng = np.random.default_rng(2)
    parts, total = [], {}
    for _ in range(4):
        rows = rng.integers(0, 4, (30, 3))
        columns, weights = lexicon.counted([rows[:, k] for k in range(3)])
        for row in rows.tolist():
            total[tuple(row)] = total.get(tuple(row), 0) + 1
        parts.append(collocations.Transducer.of_sorted(columns, weights))
        assert [c.tolist() for c in parts[-1].phrases()] == [c.tolist() for c in columns]
        assert len(parts[-1].labels[0]) == len(set(columns[0].tolist()))  # shared prefixes are one arc
    united = collocations.Transducer.union(parts)
    assert dict(zip(zip(*(c.tolist() for c in united.phrases())), united.weights.tolist())) == total


def test_scores_beyond_64_bits_are_exact(spark):
    big = [(3_000_000_000, 3_000_000_001, 4_000_000_007), (10**12, 10**12, 10**12 + 1)]
    df = spark.createDataFrame(big, "a bigint, l bigint, r bigint")
    got = df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in got] == [10**6 * a * a // (x * y) for a, x, y in big]


def test_keys_are_the_same_in_sql_and_in_tasks(spark):
    words = ["a", "", "é" * 40, "日本 x"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(lexicon.word_key(F.lit("fr"), F.col("w")))
    assert [r[0] for r in df.collect()] == lexicon.key_of([w.encode() for w in words], lexicon.prefix_seed(b"fr")).tolist()
    assert lexicon.prefix_seed(b"fr") == xxhash.xxh64_intdigest(b"fr", 42)


def test_counted_with_wide_and_narrow_numbers():
    rng = np.random.default_rng(1)
    for high in (5, 1 << 40):
        for k in (1, 2, 3):
            columns = [rng.integers(0, 3, 100) * high - (high > 5) for _ in range(k)]
            weights = rng.integers(1, 9, 100)
            rows, sums = lexicon.counted(columns, weights)
            want = pd.DataFrame({i: c for i, c in enumerate(columns)} | {"n": weights}).groupby(list(range(k)))["n"].sum()
            assert list(zip(*(c.tolist() for c in rows))) == [x if isinstance(x, tuple) else (x,) for x in want.index]
            assert sums.tolist() == want.tolist()
