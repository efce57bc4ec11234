"""Near duplicates, leaks, quality, licences and the pipeline against brute-force forms."""

import bisect
import math
import random
import re
import time

import numpy as np

import corpus_pipeline
from terralith.llm import common, decontaminate, licenses, ngram_join, pieces, quality

WORDS = [f"w{i}" for i in range(400)]
_W = re.compile(rb"[^\x20\x09-\x0D]+")
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text):
    w = _W.findall((text or "").encode().translate(_LOW))
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(i)] if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed=4):
    rng = random.Random(seed)
    rows, base = [], [rng.choices(WORDS, k=rng.randint(5, 90)) for _ in range(25)]
    for text in base:
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = list(text)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(rng.choice([" ", "\n", "\t "]).join(w))
    long = rng.choices(WORDS, k=60)
    rows += [" ".join(long[:k] + rng.choices(WORDS, k=2)) for k in range(50, 60)]  # near the threshold
    rows += ["", " \n", "One two", "one TWO", "one two", "a b c d", "É é x y z", "é é x y z", "the same words here now", "x " * 4000]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def test_words_made_to_collide_under_a_sum_over_bytes_are_told_apart(spark):
    pair = "aababbbbaabbbaababbaaaaaaaabaaabbaabbaaaaabbaaabbbaaaaaaaaab", "abaaaaaabbaaabbabaabbbbbaababbbaaaaaabbbaaaaabbaaaaaabaabbba"
    rows = [(1, pair[0]), (2, pair[1]), (3, pair[0].upper())]
    for k, base in enumerate(("one two three four", "x " * 40)):
        rows += [(10 * k + 10, f"{base} {pair[0]}"), (10 * k + 11, f"{base} {pair[1]}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute_components(rows) and [r[2] for r in got[:3]] == [1, 2, 1]


def test_word_hashes_follow_the_bytes_alone():
    words = [b"a", b"b", b"abcdefgh", b"abcdefghi", b"abcdefgh\x00", b"x" * 255, b"x" * 256, b"x" * 257, b"x" * 300 + b"y", b"x" * 300 + b"z", b"abcdefgha"]
    hashed = []
    for order in (words, words[::-1]):
        data = np.frombuffer(b" ".join(order), np.uint8)
        end = np.cumsum([len(w) + 1 for w in order]) - 1
        got = common.word_hashes(data, end - [len(w) for w in order], end, 99)
        hashed.append(dict(zip(order, got.tolist(), strict=True)))
        assert len(set(got.tolist())) == len(words) and not set(got.tolist()) & set(common.word_hashes(data, end - [len(w) for w in order], end, 98).tolist())
    assert hashed[0] == hashed[1]


def test_repeated_rows_are_verified_once(spark):
    """Two near copies and others, their rows many times over, some doc_ids with more than one text."""
    base = " ".join(WORDS[:60])
    rows = [(1, base), (2, base + " tail"), (3, "quite another text than those"), (1, "another text of the first id")] * 300 + [(None, base + " end"), (4, None)]
    began = time.time()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(1, 56, 1), (2, 57, 1), (3, 1, 3), (1, 2, 1), (None, 57, 1), (4, 0, 4)} and time.time() - began < 300


def test_ngram_join(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as cls", "1 as n", "'en' as lang")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()) == brute_components(rows)


def test_ngram_join_in_blocks(spark, monkeypatch):
    """A group of chained near copies, taken in blocks."""
    monkeypatch.setattr(ngram_join, "GROUP", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    rng = random.Random(8)
    text, rows = rng.choices(WORDS, k=40), []
    for i in range(40):
        text = list(text)
        text[rng.randrange(40)] = rng.choice(WORDS)
        text[rng.randrange(40)] = rng.choice(WORDS)
        rows.append((i, " ".join(text)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_ngram_join_of_one_group(spark, monkeypatch):
    """Nine of ten rows are copies of one text, or near copies of it, or blank."""
    monkeypatch.setattr(common, "HOT_ROWS", 8)
    rng = random.Random(5)
    text = rng.choices(WORDS, k=60)
    rows = [(i, " ".join(text) if i % 10 < 4 else " ".join(text[:55] + rng.choices(WORDS, k=2)) if i % 10 < 7 else None if i % 10 < 9 else " ".join(rng.choices(WORDS, k=30))) for i in range(400)]
    got = ngram_join.NearDuplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.table().collect()) == brute_components(rows)
    got.close()


def test_ngram_join_edges(spark):
    rows = [(None, "a b c d e f"), (7, None), (8, "a b c d e f"), (8, "a b c d e f"), (9, "other words are here now")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, 8), (7, 0, 7), (8, 2, 8), (8, 2, 8), (9, 1, 9)], key=str)
    near = [(None, "a b c d e f g h i j"), (4, "a b c d e f g h i"), (None, "k l m n o p q r s t"), (None, "k l m n o p q r s")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(near, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(None, 6, 4), (4, 5, 4), (None, 6, None), (None, 5, None)], key=str)
    a, b = "a", "b"
    for _ in range(10):  # words that polynomials modulo powers of two can't tell apart
        a, b = a + b, b + a
    got = ngram_join.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 2), (3, 1)]
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in ngram_join.keep_one(df.filter("doc_id > 0").selectExpr("*", "1 as extra")).collect()) == [7, 8, 8, 9]


def test_decontamination(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(3, 30)))) for i in range(12)] + [(50, None), (51, " "), (3, "a second text for item three")]
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 60)))) for i in range(40)]
    for i, text in items[:12]:
        w = text.split()
        docs.append((100 + i, " ".join(rng.choices(WORDS, k=20) + w + rng.choices(WORDS, k=9)).upper()))
        docs.append((200 + i, " ".join(w[: max(1, len(w) - 2)])))
        docs.append((300 + i, " ".join(w[: len(w) // 2] + ["x"] + w[len(w) // 2 :])))
    docs += [(900, None), (901, ""), (None, items[5][1])]
    want = set()
    for d, text in docs:
        for i, item in items:
            a, b = shingles((text or "").lower()), shingles((item or "").lower())
            if b and 4 * len(a & b) >= 3 * len(b):
                want.add((d, i, len(b), len(a & b)))
    d = spark.createDataFrame(docs + docs[-1:], "doc_id bigint, text string").selectExpr("*", "'x' as item_id", "2 as h")
    b = spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    for most in (200_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most)
        got = [tuple(r) for r in decontaminate.find(d, b).collect()]
        assert set(got) == want and len(got) == len(want)
    kept = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert kept == {x for x, _ in docs} - {x for x, *_ in want if x is not None}
    assert decontaminate.find(d, b.limit(0)).count() == 0 and decontaminate.find(d.limit(0), b).count() == 0


def test_decontamination_of_a_long_text(spark, monkeypatch):
    """5 MB with many items in it, while the sketch is dealt by hash."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", 0)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=8 + i % 40))) for i in range(300)]
    filler = " ".join(rng.choices(WORDS, k=4000))
    text = "\n".join(f"{filler} {t}" for _, t in items[:200])
    assert len(text) > 3_000_000
    d = spark.createDataFrame([(1, text), (2, items[250][1]), (3, filler)], "doc_id bigint, text string")
    got = sorted(tuple(r)[:2] for r in decontaminate.find(d, spark.createDataFrame(items, "item_id bigint, text string")).collect())
    assert got == [(1, i) for i in range(200)] + [(2, 250)]


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: ". ".join(" ".join(rng.choices(WORDS, k=9)).capitalize() for _ in range(rng.randint(2, 8))) + "."
    bad = lambda: " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in rng.choices(WORDS, k=rng.randint(20, 90)))
    rows = [(i, bad() if i % 5 == 3 else good(), i % 5 != 3) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "A line.", "x"), (1, rows[1][1], "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 604 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [(r.predicted, rows[r.doc_id][2]) for r in out if r.held_out and r.doc_id < 600]
    assert len(held) > 60 and sum(p == y for p, y in held) / len(held) > 0.97
    assert all(r.held_out == (r.doc_id is not None and quality.crc_fold(r.doc_id) == 0) for r in out)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 450 < kept.count() < 520
    none = quality.score(docs, quality.train(docs, labels.limit(0))).collect()
    assert len({r.score for r in none}) == 1
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_quality_scores_by_hand(spark):
    """Every score is the logistic of the entries that its features look up, one row at a time; ties and repeats score alike."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(WORDS if i % 3 else ["BUY", "NOW!!", "$$$"], k=rng.randint(0, 60)))) for i in range(300)] + [(900, "w1 " * 300_000), (901, ""), (901, ""), (902, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(4, 0), (4, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(sorted(got, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        raw = (text or "").encode()
        x = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        z = model.base + sum(t[bisect.bisect_right(e.tolist(), x[k])] for k, (e, t) in enumerate(zip(model.edges, model.tables)))
        z += sum(t[bisect.bisect_right(ea.tolist(), x[a]), bisect.bisect_right(eb.tolist(), x[b])] for a, b, ea, eb, t in model.pairs)
        assert r.doc_id == doc_id and abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
    assert len(model.pairs) == quality.PAIRS and all(len(t) == len(e) + 1 for e, t in zip(model.edges, model.tables))
    again = quality.train(docs.union(docs).union(docs), labels)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))


def test_licenses(spark):
    texts = ["Some prose.\nReleased under the MIT License.\nMore.", "Licensed under CC BY-NC 4.0.", "the license of my heart\nwe ask permission", None, "", "All rights reserved.\r\nThis work is licensed under the GNU General Public License, version 3.", "x " * 5000 + "\nLicensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id bigint, text string").selectExpr("*", "0 as k", "'a' as line")
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(df).collect())
    want = sorted((i, n, found[0]) for i, t in [*enumerate(texts), (1, texts[1])] for n, line in enumerate(re.split(r"\r\n|\n|\r", t or "")) if (found := licenses.classify(line)))
    assert got == want == [(0, 1, "mit"), (1, 0, "cc-by-nc"), (1, 0, "cc-by-nc"), (5, 0, "proprietary"), (5, 1, "gpl"), (6, 1, "apache")]


def test_wrapped_licenses(spark):
    bsd = "Redistribution and use in source and binary forms, with or without{}modification,{}are permitted provided that the following conditions are met:"
    gpl = "This program is free software: you can redistribute it and/or modify{}it under the terms of the GNU General Public License as published by{}the Free Software Foundation, either version 3 of the License."
    apache = "Licensed under the{}Apache License,{}Version 2.0 (the License);"
    wraps = [(family, text.format(*gaps)) for family, text in (("bsd", bsd), ("gpl", gpl), ("apache", apache)) for gaps in (("\n", " "), (" ", "\n"), ("\r\n * ", "\n * "))]
    wraps += [("bsd", bsd.format(" ", " ").replace(" ", "\n")), ("gpl", gpl.format(" ", " ").replace(" ", "\n# ")), ("proprietary", "(c) Us. All rights\n * reserved.")]
    texts = ["Some prose.\n\n" + t + "\nMore prose follows here." for _, t in wraps]
    # a blank line parts, a line that is found alone stands, two notices in one block are two, words beyond the lines' ends don't count
    texts += ["Redistribution and use in source and binary\n\nforms, with or without modification", "Released under the MIT License.\nLicensed under the\nMPL-2.0\nlicense", "prose " * 300 + gpl.format("\n", "\n") + " prose" * 300]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    n = len(wraps)
    assert [(i, f) for i, _, f in got if i < n] == [(i, f) for i, (f, _) in enumerate(wraps)] and all(k >= 2 for i, k, _ in got if i < n)
    assert [x for x in got if x[0] >= n] == [(n + 1, 0, "mit"), (n + 1, 2, "mpl"), (n + 2, 1, "gpl")]  # a line that names a licence stands alone


def test_license_names(spark):
    """Identifiers and titles, and what isn't a licence."""
    found = {"SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: GPL-2.0-only": "gpl", "MIT License": "mit", "Apache-2.0": "apache", "GNU GENERAL PUBLIC LICENSE": "gpl", "ISC License": "isc", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1": "lgpl", "// SPDX-License-Identifier: Apache-2.0": "apache", "BSD 3-Clause License": "bsd", "Mozilla Public License Version 2.0": "mpl"}
    none = ["His driving license was on the table.", "The general public liked the software.", "They released the hostages.", "a free and open form of the work", *licenses.OTHERS]
    texts = [*found, *none]
    got = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(found.values()))
    assert licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_license_runs_against_all_runs(spark):
    """Every run of lines, the greedy choice among them."""
    rng = random.Random(5)
    parts = ["Licensed under the", "Apache License,", "Version 2.0", "MIT", "License", "Released under the MIT License.", "GNU General Public", "License version 3", "Permission is hereby granted,", "free of charge,", "to any person", "some prose here", "", "--", "distributed under the Boost", "Software License"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(2, 14))) for _ in range(60)] + ["MIT\nLicense\n" * 30]
    want = []
    for i, text in enumerate(texts):
        lines = [" ".join(re.sub(r"[^a-z0-9.\-]+", " ", x.lower()).split(" ")).strip() for x in text.split("\n")]
        single = {k: licenses.classify(x) for k, x in enumerate(lines) if x and re.search(licenses.ANCHORS, x)}
        taken = {k for k, found in single.items() if found}
        want += [(i, k, single[k][0]) for k in taken]
        runs = []
        for a in range(len(lines)):
            between = 0
            for b in range(a + 1, len(lines)):
                if {a, b} & taken or not lines[a] or not lines[b] or between >= licenses.REACH:
                    break
                joined = " ".join([*lines[a].split()[-licenses.REACH :], *lines[a + 1 : b], *lines[b].split()[: licenses.REACH]])
                found = licenses.classify(joined) if re.search(licenses.ANCHORS, joined) else None
                if found:
                    runs.append((-found[2], b - a, a, b, found[0]))
                between += len(lines[b].split())
        for _, _, a, b, family in sorted(runs):
            if not taken & set(range(a, b + 1)):
                taken |= set(range(a, b + 1))
                want.append((i, a, family))
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect())
    assert got == sorted(want) and len(want) > 80


def test_many_license_lines_cost_in_proportion(spark):
    took = {}
    for n in (2_000, 100_000):
        docs = spark.createDataFrame([(1, "MIT License\n" * n)], "doc_id bigint, text string")
        began = time.time()
        assert licenses.scan(docs).count() == n
        took[n] = time.time() - began
    assert took[100_000] < 120


def test_license_anchors():
    """A paragraph that the filter leaves out confirms no template."""
    for text in (t for ts in licenses.TEMPLATES.values() for t in ts):
        grams = licenses._grams(text)
        assert sum(not re.search(licenses.ANCHORS, g) for g in grams) < licenses._share(text) * len(grams) <= len(grams), text


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    good = lambda: ". ".join(" ".join(rng.choices(WORDS, k=9)).capitalize() for _ in range(6)) + "."
    item = " ".join(rng.choices(WORDS, k=25))
    rows = [(i, good()) for i in range(80)] + [(i, " ".join(w.upper() + "$$$" for w in rng.choices(WORDS, k=50))) for i in range(80, 110)]
    rows += [(200, rows[4][1]), (201, rows[5][1] + " end"), (202, good() + " " + item + " " + good())]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 80), 0) for i, _ in rows[:110]], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    left = spark.createDataFrame([r for r in rows if r[0] < 80], "doc_id bigint, text string")
    assert got == sorted(map(tuple, pieces.digests(left).collect()))
