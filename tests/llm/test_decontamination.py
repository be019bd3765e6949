"""Decontamination against plain edit distances of whole items."""

import random
import re

import numpy as np
import pytest

from tabwise.llm import decontaminate

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefghé") for _ in range(RNG.randrange(2, 8))) for _ in range(3000)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def distance(item, text):
    """The least number of word edits from an item to a run of a text."""
    row = np.zeros(len(text) + 1, int)
    symbols = np.array(text, dtype=object)
    places = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty(len(text) + 1, int)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (symbols != word), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def edited(item, rate, rng):
    """Mixed edits of so many words: changed, dropped and put in."""
    w = item.split()
    for _ in range(int(rate * len(w))):
        at = rng.randrange(len(w))
        w[at : at + rng.choice((0, 1, 1))] = [rng.choice(WORDS)] * rng.choice((0, 1, 1))
    return " ".join(w)


@pytest.mark.parametrize("low, high", [(1, 8), (8, 20), (20, 60), (60, 200), (200, 500)])
def test_recall_at_the_edit_limit(spark, low, high):
    """Of all items within their limit, by length, at 15 to 20 % mixed edits."""
    rng = random.Random(low)
    items = [prose(rng.randrange(low, high), rng) for _ in range(60)]
    texts = [prose(rng.randrange(20), rng) + " " + edited(t, rate, rng).upper() + "! " + prose(30, rng) for t in items for rate in (0.15, 0.2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs, bench).collect()}
    due = {}
    for d, text in enumerate(texts):
        found = distance(words(items[d // 2]), words(text))
        if found <= len(words(items[d // 2])) // 5:
            due[d, d // 2] = found
    missed = set(due) - set(got)
    print(f"items of {low} to {high} words: {len(due) - len(missed)} of {len(due)} found")
    assert len(missed) <= 0.1 * len(due) and len(due) >= 20
    for (d, k), r in got.items():
        n = len(words(items[k]))
        run = texts[d].encode()[r["start_byte"] : r["end_byte"]].decode()
        assert r["n_words"] == n and r["distance"] <= n // 5
        assert distance(words(items[k]), words(run)) <= r["distance"]
        assert r["distance"] == due.get((d, k), distance(words(items[k]), words(texts[d])))


def test_small_tables_equal_brute_force(spark):
    rng = random.Random(9)
    items = [prose(rng.randrange(12, 60), rng) for _ in range(20)] + ["one two", "x1", prose(300, rng)]
    texts = []
    for item in items:
        texts += [f"{prose(30, rng)} {edited(item, rate, rng).upper()}. {prose(30, rng)}" for rate in (0, 0.1)]
    texts += [None, "", " ", "one, TWO", "two one", prose(30_000, rng) + "\n" + items[3], items[4] + " " + items[5] + " " + items[4]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, items[6]), (None, "nothing"), (7, items[7]), (7, items[7])]
    docs = spark.createDataFrame([(i, t, 1, "k", [5]) for i, t in rows], "doc_id long, text string, row int, key string, places array<int>").repartition(3)
    bench_rows = [*enumerate(items), (99, None), (98, ""), (97, " .!"), (None, items[8]), (2, items[9]), (2, items[9])]
    bench = spark.createDataFrame([(i, t, 3) for i, t in bench_rows], "item_id long, text string, n int")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench).collect()), key=repr)
    want = []
    for i, t in rows:
        for k, item in bench_rows:
            w = words(item)
            if w and (d := distance(w, words(t))) <= len(w) // 5:
                want.append((i, k, d))
    assert got == sorted(want, key=repr)
    kept = decontaminate.drop_leaks(docs, bench).collect()
    leaky = {t for i, t in rows if any(words(k) and distance(words(k), words(t)) <= len(words(k)) // 5 for _, k in bench_rows)}
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(repr, ((i, t) for i, t in rows if t not in leaky)))
    assert kept[0].asDict().keys() == {"doc_id", "text", "row", "key", "places"}


def test_a_passage_in_a_third_of_all_documents(spark):
    rng = random.Random(5)
    item = prose(50, rng)
    rows = [(i, prose(60, rng) + (" " + item if i % 3 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([(k, item) for k in range(3)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench).collect())
    assert got == [(i, k, 0) for i in range(0, 600, 3) for k in range(3)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, bench).count() == 1
    for d, b in ((docs.limit(0), bench), (docs, bench.limit(0)), (docs, bench.select("item_id", bench.item_id.cast("string").substr(9, 1).alias("text")))):
        assert decontaminate.find_leaks(d, b).count() == 0
        assert decontaminate.drop_leaks(d, b).count() == d.count()
