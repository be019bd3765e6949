"""Collocation mining against counting every phrase."""

import random
import re
from collections import Counter

import pytest

from tabwise.llm import collocations


def plain(rows, threshold, longest, top):
    """(lang, rank, phrase, a, l, r, n, score, cut) rows."""
    counts, totals, pieces = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            pieces.append((lang, re.findall(r"[^\x20\x09]+", piece)))
    for lang, words in pieces:
        totals[lang] += len(words)
        c = counts.setdefault(lang, Counter())
        for k in range(1, longest + 1):
            c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        found = []
        candidates = {p for p, n in c.items() if len(p) > 1 and n >= threshold}
        for p in candidates:
            inside = any(c[q] >= c[p] and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q in candidates)
            if not inside:
                score, cut = min((1000 * c[p] * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -c[p], " ".join(p).encode(), cut, c[p[:cut]], c[p[cut:]]))
        for rank, (score, a, phrase, cut, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score, cut))
    return sorted(out)


def corpus(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4))) for _ in range(40)]
    fixed = [" ".join(rng.choice(words) for _ in range(rng.randrange(2, 8))) for _ in range(15)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words).capitalize() for _ in range(rng.randrange(1, 40))]
        text = "".join(p + rng.choice([" ", "  ", "\t", ". ", ",", "\n", " \x0b", " ", " "]) for p in parts)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize("shards, top", [(3, 50), (1, 2000), (4, 7)])
def test_phrases_equal_plain_counts(spark, monkeypatch, shards, top):
    monkeypatch.setattr(collocations, "SHARDS", shards)
    monkeypatch.setattr(collocations.streams, "__defaults__", (shards,))
    monkeypatch.setattr(collocations.frequent_phrases, "__defaults__", (shards,))
    monkeypatch.setattr(collocations, "STREAM_BYTES", 700)
    rng = random.Random(shards)
    rows = [*corpus(rng, 300), ("en", None), (None, ""), ("de", " . , "), ("en", "x y " * 3000), ("en", "same words here. ") , *[("fr", "same words here. ")] * 30]
    frame = spark.createDataFrame([(lang, text, 1, "clash", 2) for lang, text in rows], "lang string, text string, shard int, key string, n int")
    got = collocations.mine_collocations(frame.repartition(3), threshold=6, top=top).collect()
    assert sorted(map(tuple, got)) == plain(rows, 6, 5, top)


def test_bits_set_by_chance_change_nothing(spark, monkeypatch):
    """All bits set: every phrase is counted at every step."""
    full = collocations._bitmaps
    monkeypatch.setattr(collocations, "_bitmaps", lambda *a: tuple(b | 255 for b in full(*a)))
    rows = corpus(random.Random(11), 150)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine_collocations(frame, threshold=5).collect())) == plain(rows, 5, 5, 2000)


def test_no_words(spark):
    frame = spark.createDataFrame([("en", None), (None, " ")], "lang string, text string")
    assert collocations.mine_collocations(frame).count() == 0
    assert collocations.mine_collocations(frame.limit(0)).count() == 0
