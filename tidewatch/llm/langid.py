"""Language identification by cross-parsing.

A suffix automaton of labelled text per language gives the longest match at each place of
a text. The text is parsed greedily into phrases: a phrase is the longest piece that also
occurs in the language's text, and the next one begins after it. Phrases, normalised by
the length of the language's text and of the parsed text, estimate the cross entropy in
bits per symbol; the language with the least wins.

A symbol is a letter in lower case; anything between letters becomes one space. Parsing
starts afresh every `BLOCK` symbols, so that all blocks of a batch of texts are walked
through the automata side by side with array operations. Every symbol is parsed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, id_text

UNDETERMINED = "und"
SAMPLE_ROWS = 200
ROW_CHARS = 2_000
SAMPLE_CHARS = 40_000
MAX_LETTERS = 120
# with more letters than that, the commonest keep a symbol and the others are spelled
COMMON_LETTERS, DIGITS, SPELLED = 80, 40, 4
HELD_OUT_MODULUS = 3
BLOCK = 512
BATCH_CHARS = 4_000_000
SPACE, OTHER_LETTER = 0, 1


@dataclass(frozen=True)
class LanguageModel:
    """`symbols` maps code points; a table holds, per state and symbol, the next state
    times the table's width, or the complement of the state after a new phrase began."""

    languages: tuple[str, ...]
    symbols: np.ndarray
    tables: tuple[np.ndarray, ...]
    bits: tuple[float, ...]


def suffix_automaton(sequence: Iterator[int] | np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in sequence:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


def symbol_table(letters: list[str]) -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, and for letters 2 and up.

    `letters` are those of the sample, commonest first. Up to `MAX_LETTERS` each has a
    symbol, and a letter that no sample holds is 1, which matches nothing. Of more letters,
    `COMMON_LETTERS` have a symbol, and any other is -1 minus its code point, to be spelled
    in `SPELLED` digits: so no two letters are the same, however many there are.
    """
    spelled = len(letters) > MAX_LETTERS
    own = {c: i + 2 for i, c in enumerate(letters[:COMMON_LETTERS] if spelled else letters)}
    table = np.zeros(0x110000, np.int32)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            lower = c.lower()[0]
            table[point] = own.get(lower, -1 - ord(lower) if spelled else OTHER_LETTER)
    return table


def width_of(table: np.ndarray) -> int:
    """Number of symbols in use."""
    return 2 + COMMON_LETTERS + DIGITS if table.min() < 0 else int(table.max(initial=OTHER_LETTER)) + 1


def to_symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row and the bounds of each text among them."""
    joined = "".join(t + " " for t in texts)
    codes = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    kept = codes != SPACE
    kept[1:] |= codes[:-1] != SPACE  # the first space after a letter stays
    sizes = kept.astype(np.int64)
    rare = codes < 0
    sizes[rare] = SPELLED
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(codes, sizes)
    spelled = np.flatnonzero(rare)
    for digit in range(SPELLED):  # the first digits are those that a script has in common
        value = (-1 - codes[spelled]) // DIGITS ** (SPELLED - 1 - digit) % DIGITS
        out[at[spelled] + digit] = 2 + COMMON_LETTERS + value
    return out.astype(np.uint8), at[bounds]


def phrase_counts(
    codes: np.ndarray, bounds: np.ndarray, tables: tuple[np.ndarray, ...], width: int, block: int = BLOCK
) -> np.ndarray:
    """Number of phrases of each text (rows) in each language (columns)."""
    sizes = np.diff(bounds)
    blocks = -(-sizes // block)
    text_of = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(text_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = bounds[:-1][text_of] + nth * block
    lengths = np.minimum(block, bounds[1:][text_of] - starts)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, text_of = starts[order], lengths[order], text_of[order]
    counts = np.ones((len(tables), len(starts)), np.int32)
    states = np.zeros((len(tables), len(starts)), np.int32)
    alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    for step, n in enumerate(alive):
        symbols = codes[starts[:n] + step].astype(np.int32)
        for table, state, count in zip(tables, states, counts):
            found = table.take(state[:n] + symbols)
            missed = found >> 31  # -1 where the phrase ended
            count[:n] -= missed
            state[:n] = found ^ missed
    totals = [np.bincount(text_of, weights=c, minlength=len(sizes)) for c in counts]
    return np.array(totals).T.reshape(len(sizes), len(tables))


def fit_languages(
    docs: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    row_chars: int = ROW_CHARS,
    sample_chars: int = SAMPLE_CHARS,
) -> LanguageModel:
    """Builds one automaton per language from a bounded sample of labelled rows.

    Per language: whole texts of at most `sample_rows` rows with a language and a text whose
    fold (crc32 of the id modulo 3) is not 1, as many as have `sample_chars` characters
    together, one at least. Rows of up to `row_chars` characters come first, in hash order,
    then longer ones by their length.
    """
    first = Window.partitionBy("lang").orderBy(F.greatest("_size", F.lit(row_chars)), "_hash", "doc_id", "text")
    rows = (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("lang").cast("string").alias("lang"),
            F.col("text").cast("string").alias("text"),
        )
        .filter(
            F.col("lang").isNotNull()
            & F.col("text").isNotNull()
            & (F.coalesce(fold(F.col("doc_id"), HELD_OUT_MODULUS), F.lit(0)) != 1)
        )
        .withColumns({"_hash": F.xxhash64("doc_id"), "_size": F.length("text")})
        .withColumn("_n", F.row_number().over(first))  # limited per group in the map tasks
        .filter(F.col("_n") <= sample_rows)
        .withColumn("_sum", F.sum("_size").over(Window.partitionBy("lang").orderBy("_n")))
        .filter((F.col("_sum") <= sample_chars) | (F.col("_n") == 1))
        .orderBy("lang", "_n")
        .select("lang", "text")
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(row["lang"], []).append(row["text"])
    seen = Counter(c.lower()[0] for parts in texts.values() for t in parts for c in t if c.isalpha())
    table = symbol_table(sorted(sorted(seen), key=lambda c: -seen[c]))
    width = width_of(table)
    languages, tables, bits = [], [], []
    for language in sorted(texts):
        codes = to_symbols(texts[language], table)[0]
        if not (codes != SPACE).any():
            continue
        following = suffix_automaton(codes.tolist())
        dense = np.zeros((len(following), width), np.int32)
        for state, targets in enumerate(following):
            dense[state, list(targets)] = list(targets.values())
        dense *= width
        dense = np.where(dense > 0, dense, ~dense[0])
        languages.append(language)
        tables.append(dense.ravel().astype(np.int32))
        bits.append(float(np.log2(len(codes) + 1)))
    return LanguageModel(tuple(languages), table, tuple(tables), tuple(bits))


def identify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    """Language and score of each text; `und` and 0 without a letter or a learned language."""
    found, scores = [], []
    width = width_of(model.symbols)
    start = 0
    while start < len(texts):
        end, chars = start, 0
        while end < len(texts) and (end == start or chars < BATCH_CHARS):
            chars += len(texts[end] or "")
            end += 1
        codes, bounds = to_symbols([t or "" for t in texts[start:end]], model.symbols)
        sizes = np.diff(bounds)
        if model.languages:
            bits = phrase_counts(codes, bounds, model.tables, width) * np.array(model.bits)
            best = bits.argmin(1)
            margin = np.minimum(bits - bits.min(1, keepdims=True), 500)
            score = 1 / np.exp2(-margin).sum(1)
            named = sizes > 0  # spaces are kept after letters only
            found += [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, named)]
            scores += np.where(named, score, 0.0).tolist()
        else:
            found += [UNDETERMINED] * len(sizes)
            scores += [0.0] * len(sizes)
        start = end
    return found, scores


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row, from its whole text.

    `und` with score 0 if the text is null or has no letter, or no language was learned.
    Ties go to the first language by name. Rows without an id are not held out. Only id
    and text are read.
    """
    # bounded by sample_chars a language; plain values need no package on the executors
    plain = (model.languages, model.symbols, model.tables, model.bits)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = identify(batch.column("text").to_pylist(), LanguageModel(*shared.value))
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "lang_pred": pa.array(languages, pa.string()), "score": pa.array(scores, pa.float64())}
            )

    return (
        id_text(docs)
        .mapInArrow(predicted, "doc_id bigint, lang_pred string, score double")
        .select(
            "doc_id",
            F.coalesce(fold(F.col("doc_id"), HELD_OUT_MODULUS) == 1, F.lit(False)).alias("held_out"),
            "lang_pred",
            "score",
        )
    )
