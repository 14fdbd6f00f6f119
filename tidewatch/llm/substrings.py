"""Substring deduplication of word windows by seed and extend.

Seeds are winnowed anchors of `GRAM` words (`seeds.py`), so any `SIZE` equal words share
one. Documents meet at their seeds; a seed is extended both ways as far as a window can
reach. Where the whole surroundings equal those in an earlier document, every window over
the seed is repeated; elsewhere the windows over the seed are compared one by one, by
grouping their hashes. Repeated windows that touch or overlap are maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import id_text, staged
from tidewatch.llm.hashing import Powers, Substrings, word_letters
from tidewatch.llm.seeds import FULL, PROBE, document_key, judge_seeds, merged, post_seeds, seeds, verdict_kinds, with_verdicts

SIZE = 13
GRAM = 5
SPAN = "struct<low:int,high:int>"
SPANS = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
WINDOWS = pa.list_(pa.struct([("hash", pa.int64()), ("check", pa.int64()), ("at", pa.int32())]))


def _extended(keyed: DataFrame, size: int, gram: int) -> DataFrame:
    """_doc, text, spans (repeated for certain) and windows (to compare) of every row."""

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            all_spans, all_windows = [], []
            # rows without verdicts need no letters
            judged = pc.if_else(pc.is_valid(batch.column("verdicts")), batch.column("text"), None)
            for letters, verdicts in zip(word_letters(judged), batch.column("verdicts").to_pylist()):
                spans, windows = [], []
                if verdicts:
                    at, _, around = seeds(letters, size, gram, powers)
                    kinds = verdict_kinds(around, verdicts)
                    low, high = np.maximum(at - (size - gram), 0), np.minimum(at + size, len(letters))
                    full = (kinds & FULL) > 0
                    spans = merged(list(zip(low[full].tolist(), high[full].tolist())))
                    probes = np.flatnonzero(kinds & PROBE)
                    if len(probes):
                        starts = np.unique(np.concatenate([np.arange(low[i], high[i] - size + 1) for i in probes]))
                        one, two = (Substrings(powers, x) for x in (letters, letters ^ (letters >> np.uint64(7))))
                        windows = zip(
                            one(starts, starts + size).view(np.int64).tolist(),
                            two(starts, starts + size).view(np.int64).tolist(),
                            starts.tolist(),
                        )
                all_spans.append([{"low": a, "high": b} for a, b in spans])
                all_windows.append([{"hash": h, "check": c, "at": i} for h, c, i in windows])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "_doc": batch.column("_doc"),
                    "text": batch.column("text"),
                    "spans": pa.array(all_spans, SPANS),
                    "windows": pa.array(all_windows, WINDOWS),
                }
            )

    return keyed.mapInArrow(
        extended,
        f"doc_id bigint, _doc bigint, text string, spans array<{SPAN}>, "
        "windows array<struct<hash:bigint,check:bigint,at:int>>",
    )


def _removed(rows: DataFrame) -> DataFrame:
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, kept, all_spans = [], [], [], []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, spans in zip(texts, batch.column("spans").to_pylist()):
                words = (text or b"").split()
                spans = merged([(s["low"], s["high"]) for s in spans])
                left = list(words)
                for low, high in reversed(spans):
                    del left[low:high]
                sizes.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
                all_spans.append([{"low": a, "high": b} for a, b in spans])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(sizes, pa.int64()),
                    "n_removed": pa.array(gone, pa.int64()),
                    "kept_text": pa.array(kept, pa.string()),
                    "spans": pa.array(all_spans, SPANS),
                }
            )

    return rows.select("doc_id", "text", "spans").mapInArrow(
        removed, f"doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<{SPAN}>"
    )


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and spans (removed word ranges) of every row.

    A word goes if a window of `size` words over it also starts in a document with a
    smaller id; windows are judged on the input. Rows that share an id are one document
    for that rule. Rows without an id come after all others, in the order of their text's
    hash. Null texts have no words; texts shorter than a window stay whole; kept words are
    joined by one space. Only id and text are read.
    """
    keyed = id_text(docs).withColumn("_doc", document_key(F.col("doc_id"), F.col("text")))
    verdicts = staged(judge_seeds(post_seeds(keyed, word_letters, size, gram).drop("n").withColumn("n", F.lit(1)), later=True), "repeat-seeds")
    rows = staged(
        _extended(with_verdicts(keyed, verdicts), size, gram).withColumn("_row", F.monotonically_increasing_id()), "repeat-rows"
    )
    windows = rows.select("_row", "_doc", F.explode("windows").alias("w")).select("_row", "_doc", "w.*")
    shared = (
        windows.groupBy("hash", "check").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).filter("_first < _last")
    )
    repeated = windows.join(shared, ["hash", "check"]).filter("_doc > _first")
    more = repeated.groupBy("_row").agg(
        F.collect_list(F.struct(F.col("at").alias("low"), (F.col("at") + size).alias("high"))).alias("more")
    )
    compared = (
        rows.filter(F.size("windows") > 0)
        .select("_row", "doc_id", "text", "spans")
        .join(more, "_row", "left")
        .select("doc_id", "text", F.concat("spans", F.coalesce("more", F.array().cast(f"array<{SPAN}>"))).alias("spans"))
    )
    settled = rows.filter(F.size("windows") == 0).select("doc_id", "text", "spans")
    return _removed(settled.unionByName(compared))


def repeat_report(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return remove_repeats(docs, size).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, str | None]], size: int = SIZE) -> dict[int, tuple[int, int, str]]:
    """Words, removed words and digest per id, by a table of all windows (for tests)."""
    words = {i: (t or "").encode().split() for i, t in texts}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for at in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][at : at + size]), i)
    out = {}
    for i, w in words.items():
        gone = {
            at + k for at in range(len(w) - size + 1) if first[tuple(w[at : at + size])] < i for k in range(size)
        }
        kept = b" ".join(x for at, x in enumerate(w) if at not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
