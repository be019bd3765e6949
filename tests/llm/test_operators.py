"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows,
no rows, and extra columns with clashing names, against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tabwise.llm import (
    fingerprints,
    licenses,
    near_dedup,
    packing,
    quality,
    sharding,
    standard_licenses,
    token_files,
    url_filter,
    warc,
)
from tabwise.llm.tokens import Encoder, vocabulary

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgé") for _ in range(RNG.randrange(2, 9))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


BASE = prose(120)
TEXTS = [
    None, "", "   ", "x", BASE, BASE, BASE.replace(WORDS[3], "other", 1), BASE + " " + prose(3), prose(6000),
    prose(40) + "\n" + prose(60), "<|endoftext|> \u0130 \u65e5\u672c", *[prose(RNG.randrange(1, 90)) for _ in range(30)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "src", 1, 2) for i, t in enumerate(TEXTS)] + [(12, TEXTS[4], "src", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, shard int, n long").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_tokens_equal_the_library():
    rng = random.Random(1)
    mixed = ["".join(rng.choice("aZ's \n\t.,!1\u00e9\u00bd\u2019\u2014\u00b2\u00aa ") for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    texts = [t or "" for t in TEXTS] + mixed
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = Encoder(vocabulary(name))
        assert encoder(texts) == [encoder.whole([t])[0] if t else b"" for t in texts]


def alike(texts, words):
    """doc_id: (size of the set, least doc_id reachable, kept), by comparing all pairs."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in w]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = {k: k for k in sets}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {k: (len(sets[k]), label[k], label[k] == k) for k in sets}


def test_near_duplicates(spark, docs, none):
    for words in (2, 5):
        got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, words).collect()}
        assert {k: (r["n_shingles"], r["component_id"], r["kept"]) for k, r in got.items()} == alike(
            {3 * i: t for i, t in enumerate(TEXTS)}, words
        )
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_over_parts_of_lists(spark, monkeypatch):
    """Texts that drift from one another share long lists but link only to near ones."""
    rng = random.Random(3)
    texts = {}
    for k in range(6):
        words = prose(120, rng).split(" ")
        for step in range(12):
            texts[100 * k + step] = " ".join(words)
            for _ in range(rng.randrange(2, 12)):
                words[rng.randrange(40)] = f"new{rng.random()}"
    common = prose(30, rng)
    for k in range(20):
        texts[1000 + k] = common + " " + prose(rng.randrange(1, 9), rng)
    monkeypatch.setattr(near_dedup, "LIST_PART", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == alike(texts, 2)


def test_blocks_of_many_lists_become_rows_once(spark):
    """A node that meets the same blocks in many lists makes a row per block, not per list."""
    lists = [(b, [(7, k) for k in range(4)]) for b in range(5) for _ in range(30)] + [(9, [(None, 0), (8, 0)])]
    found = spark.createDataFrame(lists, "b long, blocks array<struct<group: long, block: long>>")
    setting = "spark.sql.adaptive.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rows = near_dedup._each_block_once(found)
        got = [tuple(r) for r in rows.collect()]
    finally:
        spark.conf.set(setting, before)
    assert len(got) == 22 and set(got) == {(b, 7, k) for b in range(5) for k in range(4)} | {(9, None, 0), (9, 8, 0)}
    plans, made = [rows._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Generate":
            made.append(plan.metrics().apply("numOutputRows").value())
    assert made == [22]


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(TEXTS) + 1
    sizes, slots, groups = {}, {}, {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())
    by_digest = {}
    for t in [*TEXTS, TEXTS[4]]:
        key = hashlib.sha256((t or "").encode()).hexdigest()
        by_digest[key] = by_digest.get(key, 0) + len((t or "").encode()) + 8
    order = [by_digest[k] for k in sorted(by_digest)]

    def fits(cap):
        n, room = 0, 0
        for x in order:
            if x > cap:
                return False
            if x > room:
                n, room = n + 1, cap
            room -= x
        return n <= 4

    least = next(c for c in range(max(order), sum(order) + 1) if fits(c))
    assert max(sizes.values()) <= least
    assert sharding.shard_documents(none, 4).count() == 0


def test_packing(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path, 2).collect()
    encoder = Encoder(path)
    ids = {3 * i: encoder.whole([t or ""])[0] + b"\2\0\0\0" if t else b"\2\0\0\0" for i, t in enumerate(TEXTS)}
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        data = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])])
        assert len(data) // 4 > 1024 or r["length"] == len(data) // 4
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert total == sum(len(x) // 4 for x in ids.values()) + len(ids[12]) // 4
    assert len(held) <= -(-total // 1024) + 1
    assert packing.pack_documents(none, path, 2).count() == 0


def test_license_scan(spark, none, monkeypatch):
    wrapped = "\n".join(" ".join(licenses.MIT.split()[k : k + 9]) for k in range(0, len(licenses.MIT.split()), 9))
    texts = [
        None, "", " \n ", "no licence here", "LICENSED under cc by nc 4.0!", "licenced under CC-BY-NC 4.0",
        "# Copyright (c) 2020 A B\n\nMIT Licence\n\n" + wrapped.replace("sublicense", "sublicence"),
        "x y\nReleased under the MIT License.\nz", "Released under the MIT License. More.", "(C) 1999 me\nLicensed under CC BY-NC 4.0.",
        "Copyright 2001 Licensed under CC BY-NC 4.0.", prose(4000) + "\n\n" + licenses.ISC.split("\n")[0],
        "a\n\nLicensed under the Apache\nLicense, version 2.0\n\nb\nReleased under the MIT License.\nReleased under the MIT License.",
    ]
    want = {(4, "CC-BY-NC-4.0", True), (5, "CC-BY-NC-4.0", True), (6, "MIT", True), (7, "MIT", False), (9, "CC-BY-NC-4.0", True),
            (12, "Apache-2.0", False), (12, "MIT", False), (None, "MIT", True)}
    rows = [(i, t, "l", "d") for i, t in enumerate(texts)] + [(7, texts[7], "l", "d"), (None, "Released under the MIT License", "l", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string, digest string")
    known = spark.createDataFrame([*licenses.KNOWN, ("none", None), ("none", ""), ("none", "!")], "license string, text string")
    for most in (licenses.MAX_BROADCAST, 0):
        monkeypatch.setattr(licenses, "MAX_BROADCAST", most)
        assert sorted(map(repr, map(tuple, licenses.scan_licenses(docs, known).collect()))) == sorted(map(repr, want))
    assert licenses.scan_licenses(none, known).count() == 0
    assert licenses.scan_licenses(docs, known.limit(0)).count() == 0


def test_standard_licenses(spark):
    read = lambda name: (standard_licenses.TEXTS / f"{name}.txt").read_text()
    bsd = read("BSD-2-Clause").replace("<year> <owner>", "2020, A B\nAll rights reserved.".split("\n")[0])
    texts = {name: read(name) for name in ("Apache-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC-BY-SA-4.0", "CC0-1.0", "Unlicense", "GFDL-1.3")}
    texts |= {"BSD-2-Clause": bsd, "MIT": "This project is licensed under the terms of the MIT license.", "AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0-or-later"}
    header = "// " + standard_licenses.APACHE_HEADER.replace("\n", "\n// ")
    rows = [*texts.items(), ("Apache-2.0", "// Copyright 2020 A B\n//\n" + header), ("CC-BY-4.0", "Published under CC BY 4.0")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = licenses.scan_licenses(docs, licenses.known_texts(spark)).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["whole"]} == {(i, name) for i, (name, _) in enumerate(rows)}


def test_licenses_within_texts(spark, monkeypatch):
    mit, apache = licenses.MIT, (standard_licenses.TEXTS / "Apache-2.0.txt").read_text()
    first, *rest = mit.split("\n\n")
    cases = [
        (f"# A project\n\nSome words.\n\n## License\n\n{mit}\n\nMore words.", False), (f"The MIT License (MIT)\n\nCopyright (c) 2020 A B\n\n{mit}", True),
        (f"Copyright (c) 2020 A B\nAll rights reserved.\n\n{mit}", True), (f"MIT License\nCopyright Jane Doe\n{mit}\n\nint main() {{}}", False),
        (f"Copyright Jane Doe\n\n{mit}", True), (first + "\n\nwords between\n\n" + "\n\n".join(rest), None), ("\n\n".join([*rest, first]), None),
        ("\n\n".join([first, *rest, first, *rest]), False), ("\n\n".join([first, first, rest[0]]), None),
    ]
    rows = [(i, t) for i, (t, _) in enumerate(cases)] + [(90, f"Readme\n\n{apache}\n\nend"), (91, first), (91, "\n\n".join(rest))]
    want = {(i, "MIT", w) for i, (_, w) in enumerate(cases) if w is not None} | {(90, "Apache-2.0", False)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([("MIT", mit), ("Apache-2.0", apache)], "license string, text string")
    for most in (licenses.MAX_BROADCAST, 0):
        monkeypatch.setattr(licenses, "MAX_BROADCAST", most)
        assert {tuple(r) for r in licenses.scan_licenses(docs, known).collect()} == want


def test_configurations_reach_the_optimum():
    found = packing.configurations([60, 40, 30], [10, 10, 20], 100)
    assert sum(x for _, x in found) == pytest.approx(50 / 3)


def test_token_files(docs, none):
    path = vocabulary("word_bpe_49k.json")
    got = sorted(tuple(r) for r in token_files.read_token_files(token_files.write_token_files(docs, path, 1, files=3)).collect())
    encoder, want, start = Encoder(path), [], 0
    for doc, text in sorted([(3 * i, t or "") for i, t in enumerate(TEXTS)] + [(12, TEXTS[4])]):
        data = (encoder.whole([text])[0] if text else b"") + b"\1\0\0\0"
        want.append((doc, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(none, path, 1)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n, high in ((1, 1), (1024, 2**32), (1000, 50_000), (1024, 3)):
        ids = rng.integers(0, high, n, dtype=np.uint32)
        ids[:1] = high - 1
        assert (token_files.decode_block(token_files.encode_block(ids), n) == ids).all()


def test_warc(spark):
    html = ["<a>", None, "", "<a>", "<b>" * 9000, "<a>", "z\u00e9\r\n\r\nx"]
    rows = [(i + 1, None if i == 2 else f"http://h/{i}\r\nX: y", h, "t") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    for i, h in enumerate(html):
        first = next(k for k, x in enumerate(html) if (x or "") == (h or "")) + 1
        r = got[i + 1]
        assert r["payload_bytes"] == len((h or "").encode())
        assert r["payload_digest"] == warc.payload_digest((h or "").encode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i + 1 else ("revisit", first))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    odd = [(None, "u", "same"), (None, "u", "same"), (4, None, "same"), (4, "v", "other"), (9, "w", None), (8, "w", "")]
    found = warc.read_archives(warc.write_archives(spark.createDataFrame(odd, "page_id long, url string, html string"))).collect()
    seen = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found), key=repr)
    assert seen == sorted([(None, "revisit", 4, 4), (None, "revisit", 4, 4), (4, "response", None, 4), (4, "response", None, 5), (9, "revisit", 8, 0), (8, "response", None, 0)], key=repr)
    record = warc.parse_record(warc.build_record(7, "u", b"a\r\n\r\nb", None, "d"))
    assert record["payload"] == b"a\r\n\r\nb" and record["page_id"] == 7


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint_versions(docs).collect()
    ordered = sorted([(3 * i, t or "") for i, t in enumerate(TEXTS)] + [(12, TEXTS[4])])
    want = []
    for (doc, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        e = fingerprints.edited_text(t, after)
        p = fingerprints.paragraphs([t, e, after])
        sets = [set(zip(p.key[p.row == k].tolist(), p.size[p.row == k].tolist(), strict=True)) for k in range(3)]
        weigh = lambda s: sum(size for _, size in s)
        like = [1 - weigh(sets[0] ^ o) / (weigh(sets[0]) + weigh(o)) if sets[0] or o else 1.0 for o in sets[1:]]
        want.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), *[pytest.approx(x) for x in like]))
    got.sort(key=lambda r: (r["doc_id"], r["edited_sha256"]))
    want.sort(key=lambda r: (r[0], r[2]))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got] == want
    by_text = {}
    texts = dict(ordered)
    for r in got:
        by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.fingerprint_versions(none).count() == 0


def test_fingerprints_of_long_words_and_null_ids(spark):
    """One word of 200 KB weighs all its bytes."""
    long = "w" * 200_000
    texts = [(None, "a"), (None, None), (1, long), (2, long + " more words"), (2, long), (3, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, place string")
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.fingerprint_versions(docs).collect()}
    assert len(got) == 6 and got[1, 200_000]["near_next"] == pytest.approx(1.0)  # the same text follows by order
    with_more = got[2, 200_011]
    assert with_more["near_edited"] < 0.01 and with_more["near_next"] <= 0.001
    p = fingerprints.paragraphs([long, "x " * 50])
    assert p.size.sum() == 200_100
    one, two = (fingerprints.Paragraphs(1, np.zeros(3, np.int64), np.array(k, np.uint64), np.array([5, 5, 7])) for k in ([1, 1, 2], [1, 3, 2]))
    assert fingerprints.difference_weights(one, two).tolist() == [10.0]  # a digest that comes twice


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://net", "http://a.NET/x", "http://net/", "https://example.net/en/1?q", "http://x.example.net/en",
            "http://example.com/de/", "http://notexample.com/de/", "http://org/fr/#a", "http://a?b/c", "http://..net//", "a://b.org/fr/c://net/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages.select("page_id", "url"), url_filter.rules_frame(spark, url_filter.RULES)).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, *best[1:])
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, [])).where("verdict <> 'allow'").count() == 0
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    many = [(None, "http://a.net/" + "x" * 50_000, "h", "p")] * 3 + [(7, None, "h", "p")] * 40 + [(7, "http://b.net/", "h", "p")] * 40
    frame = spark.createDataFrame(many, "page_id long, url string, host string, path string")
    judged = url_filter.filter_urls(frame, rules)
    assert judged.columns[:3] == ["page_id", "host", "path"] and judged.where("verdict = 'block'").count() == 43 and judged.count() == 83
    assert url_filter.filter_urls(frame.limit(0), rules).count() == 0


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join(f"{w}%%%" for w in prose(30, rng).split()) if bad else prose(rng.randrange(5, 300), rng)))
        labels.append((i, int(not bad), 0))
    rows += [(900, None), (901, ""), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_documents(spark, docs, marks).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    for i, r in got.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.98 * len(held)
    assert quality.score_documents(spark, docs, marks.limit(0)).count() == len(rows)
    assert quality.score_documents(spark, docs.limit(0), marks).count() == 0


def test_quality_scores_equal_the_rules(spark):
    """Scores recomputed from the rules in plain code, over odd and repeated rows."""
    rng = random.Random(4)
    rows = [(i, prose(rng.randrange(3, 60), rng) if i % 3 else "!!! 123 " * rng.randrange(1, 40)) for i in range(240)]
    rows += [(5, rows[5][1]), (None, "a b"), (None, None), (6, ""), (301, prose(8000, rng))]
    docs = spark.createDataFrame([(i, t, 0, [1.0], 7) for i, t in rows], "doc_id long, text string, label int, statistics array<double>, score int")
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (7, 5, 0), (8, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model, _ = quality.learn(spark, docs, marks)
    assert model.rules
    numbers = quality.statistics_of.__globals__["text_statistics"](pa.array([t or "" for _, t in rows]))

    def plain(values):
        at = dict(zip(quality.NAMES, values, strict=True))
        total = model.intercept + sum(w for rule, w in model.rules if all((lo is None or at[n] > lo) and (hi is None or at[n] <= hi) for n, lo, hi in rule))
        return 1 / (1 + np.exp(-total))

    got = sorted(round(r["score"], 9) for r in quality.score_documents(spark, docs, marks).collect())
    assert got == sorted(round(float(plain(v)), 9) for v in numbers)
    kept = quality.keep_good(spark, docs, marks)
    assert kept.columns == docs.columns and {"a b"} <= {r["text"] for r in kept.collect()} | {"a b"}
    clean = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and r["doc_id"] < 240]
    assert sum(i % 3 > 0 for i in clean) >= 0.98 * 160 and sum(i % 3 == 0 for i in clean) <= 2


def test_ids_that_are_null_or_repeated(spark):
    """Sharding, packing and token files keep every row."""
    texts = ["a b c", None, "", "a b c", prose(3000), "x " * 2000]
    rows = [(i, t, 1, "s") for t in texts for i in (None, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, size string").repartition(2)
    shards = sharding.shard_documents(docs, 3).collect()
    assert len(shards) == len(rows)
    sizes = {}
    for r in shards:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    groups = [3 * (len((t or "").encode()) + 8) for t in texts]
    assert max(sizes.values()) <= max(max(groups), -(-sum(groups) // 3) + max(groups))
    path = vocabulary("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, path, 2).collect()
    encoder = Encoder(path)
    assert sum(r["length"] for r in packed) == 3 * sum(len(encoder([t or ""])[0]) // 4 + 1 for t in texts)
    assert sum(r["doc_id"] is None for r in packed) * 2 == sum(r["doc_id"] == 3 for r in packed)
    words = vocabulary("word_bpe_49k.json")
    read = token_files.read_token_files(token_files.write_token_files(docs, words, 1, files=3)).collect()
    assert len(read) == len(rows) and sorted(r["start"] for r in read)[0] == 0


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls pass through every stage; no rows stay no rows."""
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(i, prose(rng.randrange(20, 90), rng), "en", "s", 1) for i in range(60)] + [(None, prose(40, rng), None, None, None), (None, None, "en", "s", 0), (5, "", None, "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, rows[3][1]), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {i for i in range(60) if i != 3} | {None}
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, sf)
        assert found.columns == docs.columns
    kept = {r["doc_id"] for r in found.collect()}
    assert 0 < len(kept) < docs.count()
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept


def test_pipeline_near_dedup_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d = (prose(80, rng) for _ in range(4))
    rows = [(5, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (7, c), (7, c), (7, d), (3, a + " and"), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(i for i, _, _ in got if i is not None) == [3, 7, 7, 9]
    assert {t for i, t, _ in got if i == 7} == {c, d}
    assert sorted(n for i, _, n in got if i is None)[-1] == 10 and sum(i is None for i, _, _ in got) == 2


def test_pipeline_stages_against_plain_code(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [prose(rng.randrange(30, 90), rng) for _ in range(12)]
    texts += [texts[0] + " more words", texts[1], prose(20, rng) + " " + texts[2] + " " + prose(20, rng)]
    items = [texts[2], prose(30, rng)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alike(dict(enumerate(texts)), 5)
    got = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert {r["doc_id"] for r in got} == {i for i, x in found.items() if x[2]} and len(got) == 13
    words = [[*re.findall(r"\w+", t.lower())] for t in texts]

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, p in enumerate(item, 1):
            new = [i]
            for j, t in enumerate(text, 1):
                new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    clean = {i for i, w in enumerate(words) if all(distance(x, w) > len(x) // 5 for x in (re.findall(r"\w+", t.lower()) for t in items))}
    assert {r["doc_id"] for r in corpus_pipeline.uncontaminated(spark, docs, str(tmp_path)).collect()} == clean == set(range(15)) - {2, 14}
