"""Best-fit packing of documents into training sequences of several permitted lengths.

Documents longer than the largest length are cut into pieces. Pieces are dealt by hash to
blocks of about `BLOCK_TOKENS` tokens, and each block is packed on its own, longest piece
first. A piece goes to the open bin with the least room that still holds it; if there is
none, a bin is opened. Which size is opened is decided for all sizes jointly: the block is
packed once with the size of least cost per token and once preferring each permitted size,
every bin is downsized to the smallest length that holds its contents, and the cheapest
result is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, id_text, staged

SIZES = (512, 1024, 2048, 4096)
BLOCK_TOKENS = 1_000_000
OVERHEAD = 16  # cost of a sequence, in tokens
LONG_COST = 16_384  # tokens at which the cost of a token in a sequence has doubled


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cost(size: int) -> float:
    """Cost of one sequence: padding costs like text, and long sequences cost more a token."""
    return OVERHEAD + size * (1 + size / LONG_COST)


def _pack(lengths: list[int], sizes: tuple[int, ...], preferred: int | None) -> tuple[float, list[int], list[int], list[int]]:
    """Cost, and per piece its bin and offset, and per bin its final size."""
    left = sum(lengths)
    free: list[tuple[int, int]] = []  # room and bin, by room
    used: list[int] = []
    bins, offsets = [], []
    for n in lengths:
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            fitting = [s for s in sizes if s >= n]
            if preferred is None:
                room = min(fitting, key=lambda s: cost(s) / min(s, left))
            else:
                room = max(preferred, fitting[0])
            b = len(used)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if room > n:
            insort(free, (room - n, b))
    final = [sizes[bisect_left(sizes, u)] for u in used]
    return sum(map(cost, final)), bins, offsets, final


def pack_lengths(lengths: list[int], sizes: tuple[int, ...] = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the size of each bin, of the cheapest packing.

    `lengths` are in descending order and at most the largest size; `sizes` ascend.
    """
    tried = [_pack(lengths, sizes, p) for p in (None, *sizes)]
    return min(tried, key=lambda t: t[0])[1:]


def pack(
    docs: DataFrame,
    sizes: tuple[int, ...] = SIZES,
    tokens: Column | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, n_tokens, bin_id, bin_size, bin_offset.

    `tokens` counts the tokens of a row (words by default). `start` is the piece's first
    token in its document, `bin_offset` its place in the bin. A document without tokens
    (null or empty text) has one row with n_tokens 0 and no bin. Repeated rows are packed
    each for itself; an empty table gives no rows.
    """
    sizes = tuple(sorted(set(sizes)))
    largest = sizes[-1]
    counted = docs if tokens is None else docs.withColumn("_tokens", tokens)
    lengths = (
        id_text(docs).select("doc_id", word_count(F.col("text")).alias("n"))
        if tokens is None
        else counted.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("_tokens", F.lit(0)).cast("bigint").alias("n"))
    )
    lengths = staged(lengths.withColumn("_row", F.monotonically_increasing_id()), "lengths")
    total = lengths.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    last = F.greatest(F.lit(0), F.ceil(F.col("n") / largest) - 1)
    pieces = (
        lengths.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))))
        .withColumn("start", F.col("piece") * largest)
        .withColumn("n_tokens", F.least(F.lit(largest).cast("bigint"), F.col("n") - F.col("start")))
        .withColumn("_block", F.pmod(F.xxhash64("_row", "piece"), F.lit(blocks)))
    )

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "_row", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, offsets, final = pack_lengths(rows["n_tokens"].tolist(), sizes)
        bins = np.array(bins)
        rows["bin_id"] = int(key[0]) * 2**32 + bins
        rows["bin_size"] = np.array(final)[bins]
        rows["bin_offset"] = offsets
        return rows[["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_size", "bin_offset"]]

    schema = "doc_id bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_size int, bin_offset int"
    full = pieces.filter("n_tokens > 0").select("_block", "_row", "doc_id", "piece", "start", "n_tokens")
    none = pieces.filter("n_tokens = 0").select(
        "doc_id", "piece", "start", "n_tokens",
        F.lit(None).cast("bigint").alias("bin_id"), F.lit(0).alias("bin_size"), F.lit(0).alias("bin_offset"),
    )
    return full.groupBy("_block").applyInPandas(packed, schema).unionByName(none)
