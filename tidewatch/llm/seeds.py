"""Seeds of repeated substrings: winnowed anchors and the classes of their surroundings.

A text is an array of letters (hashes of bytes or words); a *window* is `size` letters. Of
the `reach + 1` grams of `gram` letters in each window the least hash is selected, so equal
windows select the same gram at the same place wherever they stand: the *anchor*. The
*surroundings* of an anchor are all letters of windows that can hold it. Occurrences with
equal anchor and surroundings form a class; all their windows around the anchor are equal.

So the windows of all but the first member of a class are settled without looking at them.
Only anchors that occur in different surroundings are left: there one member per class is
a *probe*, and the probes' windows are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.hashing import GOLDEN, Powers, Substrings

CHUNK = 1 << 20
HELD_ROWS = 200_000
FULL, PROBE = 1, 2
# ids stand below this; rows without an id come after all others, by the hash of their text
NO_ID = 1 << 62


def document_key(doc_id: Column, text: Column) -> Column:
    """The id, or for rows without one a number above all ids that is given by the text."""
    return F.coalesce(
        doc_id.cast("bigint"),
        F.lit(NO_ID) + F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(NO_ID - 1)),
    )


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """`pick` (minimum or maximum) over each `width` neighbours, in two passes by blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, 0 if pick is np.maximum else np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - width + 1], ahead[width - 1 : n])


def _seeds_of_chunk(letters: np.ndarray, size: int, gram: int, powers: Powers) -> tuple[np.ndarray, Substrings, np.ndarray]:
    reach = size - gram
    hashes = Substrings(powers, letters)
    grams = hashes(slice(0, len(letters) - gram + 1), slice(gram, None))
    least = _sliding(grams, reach + 1, np.minimum)
    edge = np.zeros(reach, np.uint64)
    selected = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), reach + 1, np.maximum) == grams)
    return selected, hashes, grams[selected]


def seeds(letters: np.ndarray, size: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, anchor hashes and surroundings hashes of all anchors of a text.

    Long texts are handled in chunks that overlap by all that a seed depends on.
    """
    n, reach = len(letters), size - gram
    places, anchors, around = [], [], []
    margin = 2 * size
    for start in range(0, n if n >= size else 0, CHUNK):
        low, high = max(0, start - margin), min(n, start + CHUNK + margin)
        if high - low < size:
            continue
        at, hashes, found = _seeds_of_chunk(letters[low:high], size, gram, powers)
        own = (at + low >= start) & (at + low < start + CHUNK)
        at, found = at[own], found[own]
        a, b = np.maximum(at - reach, 0), np.minimum(at + size, high - low)
        clipped = ((at - a) * (2 * size) + (b - at)).astype(np.uint64) * np.uint64(GOLDEN)
        places.append(at + low)
        anchors.append(found)
        around.append(hashes(a, b) ^ clipped)
    if not places:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    return np.concatenate(places), np.concatenate(anchors), np.concatenate(around)


def post_seeds(keyed: DataFrame, letters: Callable[[pa.Array], Iterable[np.ndarray]], size: int, gram: int) -> DataFrame:
    """anchor, around, doc and n (occurrences in the row), once per class and row.

    `keyed` has `_doc` and `text`; `letters` gives the letters of each text of a column.
    """

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            anchors, around, docs, counts = [], [], [], []
            for doc, of_text in zip(batch.column("_doc").to_pylist(), letters(batch.column("text"))):
                _, a, s = seeds(of_text, size, gram, powers)
                if len(a):
                    order = np.lexsort((s, a))
                    a, s = a[order], s[order]
                    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
                    anchors.append(a[first])
                    around.append(s[first])
                    docs.append(np.full(len(first), doc, np.int64))
                    counts.append(np.diff(np.r_[first, len(a)]).astype(np.int32))
            if anchors:
                yield pa.record_batch(
                    {
                        "anchor": np.concatenate(anchors).view(np.int64),
                        "around": np.concatenate(around).view(np.int64),
                        "doc": np.concatenate(docs),
                        "n": np.concatenate(counts),
                    }
                )

    return keyed.mapInArrow(posted, "anchor bigint, around bigint, doc bigint, n int")


def _judge(rows: list[np.ndarray], many: bool, later: bool) -> pa.RecordBatch:
    """Verdicts on sorted rows of whole anchors; `many`: the first anchor has other classes."""
    anchor, around, doc, n, done = rows
    new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
    new_class = new_anchor | np.r_[True, around[1:] != around[:-1]]
    new_row = new_class | np.r_[True, doc[1:] != doc[:-1]]
    starts = np.flatnonzero(new_class)
    of_class, of_anchor = np.cumsum(new_class) - 1, np.cumsum(new_anchor) - 1
    several = np.bincount(of_anchor[starts]) > 1
    several[0] |= many
    full = doc > doc[starts][of_class] if later else np.add.reduceat(n, starts)[of_class] > 1
    probe = new_class & several[of_anchor]
    out = new_row & ~done & (full | probe)
    return pa.record_batch(
        {"doc": doc[out], "around": around[out], "kind": (full[out] * FULL + probe[out] * PROBE).astype(np.int32)}
    )


def judge_seeds(posts: DataFrame, later: bool, held_rows: int = HELD_ROWS) -> DataFrame:
    """doc, around and kind (FULL, PROBE or their sum) of each class and document that needs it.

    With `later` the windows of a class are FULL for all documents but its smallest, else
    for every document if the class occurs twice anywhere. The rows of a partition stream
    by in the order of anchor, class and document. A task holds the rows of one anchor,
    and of an anchor with more than `held_rows` rows one class's first row.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "around", "doc", "n")]
            rows.append(np.zeros(batch.num_rows, bool))
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut:
                yield _judge([x[:cut] for x in rows], many, later)
                many = False
            held = [x[cut:] for x in rows]
            if len(held[0]) > held_rows:
                last = int(np.searchsorted(held[1], held[1][-1], "left"))
                yield _judge(held, True, later)
                many = True
                total = min(2, int(held[3][last:].sum()))
                whole = len(held[0]) - last
                held = [x[last : last + 1].copy() for x in held]
                held[3][0], held[4][0] = total, True
                if whole == 1 and total == 1 and not later:
                    held[4][0] = False  # it may still become FULL; PROBE twice does no harm
        if held is not None:
            yield _judge(held, many, later)

    return (
        posts.repartition("anchor")
        .sortWithinPartitions("anchor", "around", "doc")
        .mapInArrow(judged, "doc bigint, around bigint, kind int")
    )


def with_verdicts(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The keyed rows with the list of their classes' verdicts (null without any)."""
    lists = verdicts.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("around", "kind")).alias("verdicts"))
    return keyed.join(lists, "_doc", "left")


def verdict_kinds(around: np.ndarray, verdicts: list[dict] | None) -> np.ndarray:
    """Kind of each of a text's seeds, 0 without a verdict."""
    if not verdicts:
        return np.zeros(len(around), np.int32)
    known = {v["around"]: v["kind"] for v in verdicts}
    return np.array([known.get(x, 0) for x in around.view(np.int64).tolist()], np.int32)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out
