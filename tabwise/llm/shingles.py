"""Word-shingle sets of texts, as sorted arrays of 63-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tabwise.llm.common import SpanHash, buffer_of, mix, spans

_SPACE = (np.arange(256) == 32) | ((np.arange(256) >= 9) & (np.arange(256) <= 13))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's set: its distinct runs of ``words`` words, A-Z lower-cased, words
    parted by ASCII white space; with fewer words the whole sequence as one; without
    words nothing."""
    data, offsets = buffer_of(texts)
    starts, ends = spans(~_SPACE[data], offsets)
    word = SpanHash(_LOWER[data])(starts, ends)
    first = np.searchsorted(starts, offsets)  # of each text's words
    runs = np.zeros(len(word), np.uint64)
    n = max(0, len(word) - words + 1)
    for k in range(words):
        runs[:n] = mix(runs[:n] + word[k : k + n] + np.uint64(k + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            found = runs[a : b - words + 1] >> np.uint64(1)
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for k in range(b - a):
                whole = mix(whole + word[a + k : a + k + 1] + np.uint64(k + 1))
            found = mix(whole + np.uint64(b - a)) >> np.uint64(1)
        else:
            found = runs[:0]
        found = np.sort(found)
        yield found[np.append(True, found[1:] != found[:-1])] if len(found) > 1 else found
