"""Licence scan: a trained paragraph classifier whose predictions a template must confirm.

DataFrame functions only. A paragraph is a line, or neighbouring lines over which a notice is wrapped; lines without letters
and digits end it. Its grams are its lower-cased words of letters, digits, dots and dashes
that hold a letter, and pairs of neighbours. A sparse multinomial logistic regression over the grams names a licence
family or none; it is fitted here, on paragraphs made from the templates below, and on ordinary prose and sentences of other
licences, which make up the unknown class. Scores are divided by a temperature that makes held-back paragraphs likeliest,
half of whose other licences are in no training paragraph, and families below `SURE` are unknown. A prediction holds only if one of the family's templates has enough of its grams in
the paragraph. What doesn't match `ANCHORS` is left out before the model is asked; a template asks for a larger share than
what doesn't match can have of it (`_share`), so this loses nothing.

Single lines are asked first, and what is found stands. Of the neighbouring lines that are left, every run with fewer than `REACH` words between its first and last line is asked, with at most
`REACH` words of those two; a template is shorter, so however it is wrapped, some run holds it. Runs
that overlap make a group; in each the most similar stands first, then the shortest, then the first, where no line is taken
yet. A text of any number of lines, all of them licences, costs in proportion to them.

null and blank texts have no rows; a document has one row for each licence paragraph, so repeated rows repeat them.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralith.llm.common import materialize

#: Short public wordings by which licences are named, and telling sentences of their texts.
TEMPLATES = {
    "agpl": ["licensed under the gnu affero general public license version 3", "released under the agpl-3.0 license", "gnu affero general public license", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"],
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org licenses license-2.0", "spdx-license-identifier apache-2.0", "apache license version 2.0", "apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"],
    "boost": ["distributed under the boost software license version 1.0", "boost software license", "bsl-1.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd 3-clause license", "licensed under the bsd license", "bsd 2-clause license", "bsd 3-clause license", "bsd-3-clause", "bsd-2-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"],
    "cc-by": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "cc-by-4.0"],
    "cc-by-nc": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "cc-by-nc-4.0"],
    "cc-by-sa": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "cc-by-sa-4.0"],
    "cc0": ["released under cc0 1.0 universal public domain dedication", "this work has been dedicated to the public domain under cc0", "cc0-1.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "licensed under the gpl-3.0 license", "gnu general public license", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later"],
    "isc": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx-license-identifier isc"],
    "lgpl": ["licensed under the gnu lesser general public license version 2.1", "licensed under the lgpl-2.1 license", "gnu lesser general public license", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-only", "lgpl-2.1-or-later"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software", "licensed under the mit license", "mit license", "spdx-license-identifier mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mpl-2.0 license", "mozilla public license version 2.0", "mpl-2.0"],
    "proprietary": ["all rights reserved", "this software is proprietary and confidential unauthorized copying of this file is strictly prohibited"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "the unlicense"],
    "zlib": ["zlib license", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
}
#: Sentences of other licences, part of what the unknown class is made of.
OTHERS = [
    "the contributor hereby grants recipient a non-exclusive worldwide royalty-free patent license under licensed patents to make use sell and distribute the contribution",
    "the font software may be modified altered or added to only if the fonts are renamed to names not containing the words reserved font name",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "you may distribute your modified version as source either gratis or for a distributor fee provided that you clearly document how it differs from the standard version",
    "the european commission grants the licensee a worldwide royalty-free non-exclusive sublicensable licence to use the work in any circumstances and for all usage",
    "the licensor offers this database under the open database license and any rights in individual contents are licensed under the database contents license",
    "by opening this package you accept the terms of this end user agreement which limits the number of computers on which the program may be installed",
    "permission to copy this document without fee is granted provided that copies are not made for commercial advantage",
]
_BEFORE = ["", "", "", "licensed under the", "this work is licensed under the", "released under the", "under the terms of the", "spdx-license-identifier"]
_AFTER = ["", "", "", "license", "version 2.0", "version 2.1", "version 3", "version 3.0 or later"]
SURE = 0.5
SAME = 0.6
#: What lower-cased words must match before the model is asked.
ANCHORS = r"licen[cs]e|spdx|redistribut|permission|public domain|rights reserved|proprietary|warrant|gpl-[23]|apache-2|mpl-2|bsd-[23]|cc-by|cc0|bsl-1|endorse|misrepresented|unencumbered"
#: Words that a run may have between its first and last line: half as many again as the longest template's.
REACH = max(len(t.split()) for ts in TEMPLATES.values() for t in ts) * 3 // 2
VOCABULARY = 1200
_STOP = "the of and to in for is on that by with as it was at from are this be or an not have which all a into been nor being may you its any no such other but"
_PROSE = f"{_STOP} new can more about under one out if time there will work use copy person general source public terms free charge file version form rights software reserved released subject kind name names notice code changes document permission granted used following must made copies except express fee forms law marked original provided published purpose required rights".split()


def _grams(text: str) -> list[str]:
    w = [x.strip(".-") for x in re.findall(r"[a-z0-9.\-]+", text.lower())]
    w = [x for x in w if x]
    return sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})


@lru_cache(maxsize=None)
def _share(template: str) -> float:
    """The share of a template's grams that confirms it: `SAME`, and more than what doesn't match `ANCHORS` can have, and more
    than the grams that it has in common with other families, if it has any of its own."""
    grams = _grams(template)
    family = next(f for f, ts in TEMPLATES.items() if template in ts)
    others = {g for f, ts in TEMPLATES.items() if f != family for t in ts for g in _grams(t)}
    common = sum(g in others for g in grams)
    loose = sum(not re.search(ANCHORS, g) for g in grams)
    return max(SAME, (loose + 1) / len(grams), (common + 1) / len(grams) if common < len(grams) else 0)


@lru_cache(maxsize=1)
def train(seed: int = 5) -> dict:
    """Vocabulary, weights (unknown last) and temperature; deterministic."""
    rng = random.Random(seed)
    families = [*TEMPLATES, ""]
    texts, y = [], []
    of = {f: {w for t in ts for w in t.split()} for f, ts in TEMPLATES.items()}
    own = {f: ws - set().union(*(v for g, v in of.items() if g != f)) for f, ws in of.items()}  # words that tell a family aren't left out
    for k, family in enumerate(families):
        for i in range(40 * len(TEMPLATES[family]) if family else 900):
            if family:
                words = TEMPLATES[family][i % len(TEMPLATES[family])].split()
                words = [w for w in words if w in own[family] or rng.random() > 0.06] or words
                if len(words) < 6:  # a name stands alone or in any such phrase
                    words = rng.choice(_BEFORE).split() + words + rng.choice(_AFTER).split()
                words = rng.choices(_PROSE, k=rng.randint(0, 6)) + words + rng.choices(_PROSE, k=rng.randint(0, 12))
            else:
                words = rng.choices(_PROSE, k=rng.randint(3, 40))
                if rng.random() < 0.4:
                    words.insert(rng.randrange(len(words)), rng.choice(["license", "licence", "permission", "licensed", "redistribute", "warranty", "copyright"]))
                if rng.random() < 0.4:  # another licence, whole or in part
                    other = rng.choice(OTHERS[: len(OTHERS) // 2 if i % 5 else None]).split()
                    words += other[: rng.randint(4, len(other))]
            texts.append(set(_grams(" ".join(words))))
            y.append(k)
    counts: dict[str, int] = {}
    for g in texts:
        for x in g:
            counts[x] = counts.get(x, 0) + 1
    kept = {g for ts in (*TEMPLATES.values(), OTHERS) for t in ts for g in _grams(t)} & set(counts)
    vocabulary = sorted(sorted(kept, key=lambda g: (-counts[g], g))[:VOCABULARY])
    at = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, g in enumerate(texts):
        for w in g:
            if w in at:
                x[i, at[w]] = 1
    y = np.array(y)
    one = np.eye(len(families))[y]
    back = np.arange(len(y)) % 5 == 0
    w = np.zeros((x.shape[1], len(families)))
    x = x.astype(np.float32)
    seen, hot = x[~back], one[~back]
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 301):  # Adam
        z = seen @ w.astype(np.float32)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = seen.T @ (p - hot).astype(np.float32) / len(seen) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    z = x[back] @ w

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(-(q[np.arange(len(q)), y[back]] - np.log(np.exp(q).sum(1))).mean())

    best = min((0.1 * k for k in range(1, 31)), key=loss)
    return {"families": families, "vocabulary": vocabulary, "weights": np.round(w / best, 6)}


def classify(text: str) -> tuple[str, float, float] | None:
    """The plain form of the rule for one paragraph: family, confidence, similarity; None for unknown."""
    model = train()
    grams = _grams(text)
    hit = [model["vocabulary"].index(g) for g in grams if g in model["vocabulary"]]
    z = model["weights"][hit].sum(0) + model["weights"][-1]
    p = np.exp(z - z.max())
    p /= p.sum()
    k = int(np.argmax(p))
    family = model["families"][k]
    if not family or p[k] < SURE:
        return None
    shares = [(len(set(_grams(t)) & set(grams)) / len(_grams(t)), _share(t)) for t in TEMPLATES[family]]
    same = max((a for a, b in shares if a >= b), default=0.0)
    return (family, float(p[k]), same) if same else None


def _once(value: Column) -> Column:
    """value as a generated column: later filters aren't moved below it, so it is computed once a row."""
    return F.explode(F.array(value))


def _with(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def grams(text: Column) -> Column:
    """The distinct grams of a paragraph."""
    words = F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9.\-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", "")), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
    return _with(words, lambda w: F.array_distinct(F.concat(w, pairs(w))))


def _runs(docs: DataFrame) -> DataFrame:
    """The runs of two lines and more that hold an anchor, each once: under the first line in which, or from which on, it has one."""
    docs = docs.select("row", "doc_id", F.col("lines").alias("w"))
    held = F.transform("w", lambda x, i: F.when(F.concat_ws(" ", x, F.get(F.col("w"), i + 1)).rlike(ANCHORS), i))
    docs = docs.withColumn("at", _once(F.filter(held, lambda i: i.isNotNull())))
    lo = lambda a, k: F.greatest(F.coalesce(F.get(F.col("at"), k - 1) + 1, F.lit(0)), a - REACH)
    spots = docs.select("row", "doc_id", F.explode(F.transform("at", lambda a, k: F.struct(a.alias("a"), lo(a, k).alias("lo"), F.slice("w", lo(a, k) + 1, a - lo(a, k) + REACH + 2).alias("w")))).alias("s"))
    starts = spots.select("row", "doc_id", (F.col("s.a") - F.col("s.lo")).alias("a"), F.posexplode(F.slice("s.w", F.lit(1), F.col("s.a") - F.col("s.lo") + 1)).alias("i", "_x"), "s.lo", "s.w")
    starts = starts.select("row", "doc_id", (F.col("lo") + F.col("i")).alias("first"), (F.col("a") - F.col("i")).alias("need"), F.slice("w", F.col("i") + 1, REACH + 2).alias("w"))
    # ends: the last lines that the run from here may have; n: words between, or REACH where no line may follow
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().cast("array<int>").alias("ends"))
    size = lambda x: F.size(F.split(x, " "))

    def step(s, x):
        fits = (s.n < REACH) & (x != "")
        n = F.when(fits, F.when(s.k == 0, 0).otherwise(s.n + size(x))).otherwise(REACH)
        return F.struct(n.cast("int").alias("n"), (s.k + 1).cast("int").alias("k"), F.when(fits, F.array_append(s.ends, s.k)).otherwise(s.ends).alias("ends"))

    ends = F.filter(F.aggregate("w", none, step, lambda s: s.ends), lambda j: (j >= F.col("need")) & (j > 0))
    runs = starts.select("row", "doc_id", "first", "w", F.explode(ends).alias("j"))
    words_of = lambda k: F.split(F.get(F.col("w"), k), " ")
    head, tail = words_of(F.lit(0)), words_of(F.col("j"))
    text = F.concat_ws(" ", F.slice(head, F.greatest(F.size(head) - REACH + 1, F.lit(1)), REACH), F.slice("w", F.lit(2), F.col("j") - 1), F.slice(tail, 1, REACH))
    return runs.select("row", "doc_id", "first", (F.col("first") + F.col("j")).alias("last"), _once(text).alias("line")).filter(F.col("line").rlike(ANCHORS))


def _judged(paragraphs: DataFrame) -> DataFrame:
    """Of paragraphs (row, doc_id, first, last, line) those that are a licence's, with family, confidence and similarity."""
    model = train()
    strings = lambda xs: F.from_json(F.lit(json.dumps(list(xs))), "array<string>")  # noqa: E731  folded into one literal
    rows = paragraphs.select("row", "doc_id", "first", "last", _once(grams(F.col("line"))).alias("grams"))
    vocabulary = strings(model["vocabulary"])
    rows = rows.withColumn("hit", _once(F.transform(F.array_intersect("grams", vocabulary), lambda g: F.array_position(vocabulary, g).cast("int"))))

    def total_of(weights: np.ndarray) -> Column:
        table = F.from_json(F.lit(json.dumps([float(v) for v in weights[:-1]])), "array<double>")
        return F.aggregate("hit", F.lit(float(weights[-1])), lambda a, i: a + F.element_at(table, i))

    sums = [total_of(w) for w in model["weights"].T]
    rows = rows.select("row", "doc_id", "first", "last", "grams", _once(F.array(*sums)).alias("z"))
    rows = rows.withColumn("most", _once(F.array_max("z"))).withColumn("k", _once(F.array_position("z", F.col("most")).cast("int"))).filter(F.col("k") <= len(TEMPLATES))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("most")))
    rows = rows.withColumn("confidence", _once(1 / total)).filter(F.col("confidence") >= SURE)
    same = None
    for k, forms in enumerate(TEMPLATES.values(), 1):
        share = [F.when(F.size(F.array_intersect("grams", strings(_grams(t)))) >= _share(t) * len(_grams(t)), F.size(F.array_intersect("grams", strings(_grams(t)))) / float(len(_grams(t)))) for t in forms]
        best = F.greatest(*share) if len(share) > 1 else share[0]
        same = F.when(F.col("k") == k, best) if same is None else same.when(F.col("k") == k, best)
    rows = rows.withColumn("similarity", _once(same)).filter(F.col("similarity").isNotNull())
    return rows.select("row", "doc_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"), F.element_at(strings(TEMPLATES), F.col("k")).alias("family"), "confidence", "similarity")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, paragraph (number from 0 of its first line), family, confidence and similarity of every licence paragraph."""
    docs = documents.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), F.col("`text`").cast("string").alias("text"))
    docs = docs.filter(F.col("text").rlike(f"(?i)({ANCHORS.replace(' ', '[^a-z0-9.-]+')})"))
    words = F.transform(F.split("text", r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9.\-]+", " ")))
    docs = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("lines")), "licensed")  # few of all documents
    lines = docs.select("row", "doc_id", F.posexplode("lines").alias("first", "line"))
    single = materialize(_judged(lines.filter(F.col("line").rlike(ANCHORS)).withColumn("last", F.col("first"))), "single")
    # documents with found lines, these left blank: a run reaches over none
    marks = single.select("row", "first", F.lit(True).alias("found"))
    some = docs.join(marks.select("row").distinct(), "row", "left_semi").select("row", "doc_id", F.posexplode("lines").alias("first", "line")).join(marks, ["row", "first"], "left")
    blanked = some.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("first", F.when(F.col("found"), "").otherwise(F.col("line")).alias("line")))).alias("x")).select("row", "doc_id", F.col("x.line").alias("lines"))
    left = docs.join(marks.select("row").distinct(), "row", "left_anti").union(blanked)
    runs = _judged(_runs(left))
    # groups of runs that overlap
    w = Window.partitionBy("row").orderBy("first", "last")
    opens = F.when(F.col("first") > F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    runs = runs.withColumn("opens", opens).withColumn("group", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = F.struct((-F.col("similarity")).alias("_s"), (F.col("last") - F.col("first")).alias("_n"), "first", "last", "family", "confidence", "similarity")
    every = runs.groupBy("row", "group", "doc_id").agg(F.sort_array(F.collect_list(found)).alias("every"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t.first <= x.last) & (x.first <= t.last))
    kept = F.aggregate("every", F.slice("every", 1, 0), lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    joined = every.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.first", "x.family", "x.confidence", "x.similarity")
    return single.select("doc_id", "first", "family", "confidence", "similarity").union(joined).select("doc_id", F.col("first").cast("bigint").alias("paragraph"), "family", "confidence", "similarity")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
