"""Katz scores against plain dictionaries, whatever the lexicon, shards and buckets hold."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import katz, lexicon

SCHEMA = "doc_id bigint, text string, lang string, held_out string, score double, key string, f int, h int"


def texts(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "é", "|", "日本", "x\x00y", "\x1c"]
    rows = []
    for i in range(160):
        words = [vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.05)))] for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(w + rng.choice([" ", "\t", "\n ", "\x0b"]) for w in words)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "W1 w2 " * 9000), (304, "never seen Before"), (None, "w1 w1"), (None, None)]
    # a word that is always followed by the same one, more often than counts are discounted
    return rows + rows[:25] + [(400 + k, "lonely lonely pair") for k in range(60)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 0.5, "k", 1, 2) for i, t in rows], SCHEMA).repartition(3).sortWithinPartitions("doc_id")


def compared(got, rows):
    model = katz.BruteForce([t for i, t in rows if not held(i)])
    want = sorted(((str(i), held(i), *model.scores(t)) for i, t in rows), key=str)
    got = sorted(
        ((str(r["doc_id"]), *(r[c] for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))) for r in got), key=str
    )
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (*r[:5], round(r[5], 4))), sorted(want, key=lambda r: (*r[:5], round(r[5], 4)))):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-6) and math.isclose(a[6], b[6], rel_tol=1e-8, abs_tol=1e-5), (a, b)


@pytest.mark.parametrize(("words", "entries"), [(lexicon.LEXICON_WORDS, lexicon.BUCKET_ENTRIES), (60, 3000), (5, 400), (0, 3000)])
def test_equals_dictionaries(spark, monkeypatch, words, entries):
    rows = texts()
    monkeypatch.setattr(lexicon, "BUCKET_ENTRIES", entries)  # small: several buckets and spread contexts
    monkeypatch.setattr(katz, "SHARD_TOKENS", 3000)
    got = katz.score_texts(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, lexicon_words=words).collect()
    compared(got, rows)
    assert any(r["held_out"] for r in got)


def test_report(spark):
    rows = texts(8)
    got = katz.score_report(frame(spark, rows)).collect()
    compared(got, rows)
    held_out = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


@pytest.mark.parametrize("rows", [[], [(2, "a b")], [(1, None)], [(0, "a a"), (1, "a a"), (2, "a a"), (3, "b")]])
def test_small_tables(spark, rows):
    compared(katz.score_report(frame(spark, rows)).collect(), rows)


def test_probabilities_add_up_to_one():
    model = katz.BruteForce([t for i, t in texts() if not held(i)])
    known = [*model.words, None]
    for h in [None, b"w1", b"w200", b"lonely", b"not there"]:
        assert math.isclose(math.fsum(model.p(w, h) for w in known), 1, abs_tol=1e-9)
        assert all(model.p(w, h) > 0 for w in known)


def test_discounts():
    assert katz.discounts([0, 0, 0, 0, 0, 0, 0]) == [0.5]
    assert katz.discounts([0, 5, 0, 0, 0, 0, 0]) == [0.5]
    found = katz.discounts([0, 1000, 400, 200, 110, 70, 50])
    assert len(found) == 5 and all(0 < d < 1 for d in found)
    # Katz: what the discounts free is the share of the things seen once
    freed = sum(r * n * (1 - d) for r, n, d in zip(range(1, 6), [1000, 400, 200, 110, 70], found))
    assert math.isclose(freed, 1000)
