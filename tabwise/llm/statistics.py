"""Numbers about a text's form, from its bytes in array passes.  No word list, language
or source enters, so they mean the same in any language; all are shares or means, so
they mean the same at any length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabwise.llm.common import CHUNK_BYTES, SpanHash, buffer_of, spans

NAMES = (
    "mean_word", "letters", "digits", "upper", "symbols", "marks", "spaces", "lines_per_word",
    "distinct_words", "distinct_pairs", "repeats", "repeated_lines", "symbol_ends",
    "bare_words", "capital_words", "exclamations",
)
#: Words within which different ones are counted: over a whole text their share would
#: fall with its length, and length is no sign of quality.
WINDOW = 64

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LETTER = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_SPACE = (_B == 32) | ((_B >= 9) & (_B <= 13))
_MARK = np.isin(_B, list(b".,;:!?'\"()-"))
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _MARK) & (_B > 32) & (_B < 127)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(row: np.ndarray, group: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Per row, the number of different keys, counted apart in each group."""
    order = np.lexsort((key, group))
    group, key, row = group[order], key[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
    return np.bincount(row[new], minlength=n)


def _of_chunk(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends = spans(~_SPACE[data], offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(row, minlength=n).astype(float)
    hashes = SpanHash(data)
    key = hashes(starts, ends)
    first = np.cumsum(words, dtype=np.int64) - words.astype(np.int64)
    window = (np.arange(len(row)) - first[row]) // WINDOW
    window += row * (int(window.max(initial=0)) + 1)
    distinct = _distinct(row, window, key, n)
    same_row = row[1:] == row[:-1]
    pairs = np.bincount(row[1:][same_row], minlength=n)
    pair_kinds = _distinct(row[1:][same_row], window[1:][same_row], (key[:-1] * np.uint64(31) + key[1:])[same_row], n)
    repeats = np.bincount(row[1:][same_row & (key[1:] == key[:-1])], minlength=n)
    line_starts, line_ends = spans(data != 10, offsets)
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    line_kinds = _distinct(line_row, line_row, hashes(line_starts, line_ends), n)

    def inside(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends] - sums[starts]

    letters, upper = inside(_LETTER), inside(_UPPER)
    count = lambda flags: np.bincount(row[flags], minlength=n)
    share = lambda a, b: a / np.maximum(b, 1.0)
    all_letters = _per_row(_LETTER[data], offsets)
    return np.column_stack((
        share(size - _per_row(_SPACE[data], offsets), words), share(all_letters, size),
        share(_per_row(_DIGIT[data], offsets), size), share(_per_row(_UPPER[data], offsets), all_letters),
        share(_per_row(_SYMBOL[data], offsets), size), share(_per_row(_MARK[data], offsets), size),
        share(_per_row(_SPACE[data], offsets), size), share(lines, words),
        share(distinct, words), share(pair_kinds, pairs), share(repeats, words),
        share(lines - line_kinds, lines), share(count(_SYMBOL[data[ends - 1]]), words),
        share(count(letters == 0), words), share(count((upper == letters) & (letters > 1)), words),
        share(_per_row(data == 33, offsets), words),
    ))


def text_statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text; an empty text has zeros."""
    data, offsets = buffer_of(texts)
    out, start = [np.zeros((0, len(NAMES)))], 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1)
        out.append(_of_chunk(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]))
        start = end
    return np.concatenate(out)


def statistics_of(text: Column) -> Column:
    """The numbers of ``NAMES`` as an array column; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def numbers(texts: pa.Array) -> pa.Array:
        values = text_statistics(texts)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(NAMES)), pa.array(values.ravel())
        )

    return numbers(F.coalesce(text.cast("string"), F.lit("")))
