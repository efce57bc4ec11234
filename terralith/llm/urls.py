"""URL filter: rules by host and path first, gradient-boosted trees on lexical features for the rest.

DataFrame functions only. The trees are fitted on labelled URLs: those given (url, allow 0/1; at most `MAX_TRAIN` of them,
least xxhash64 of the URL first), or `labelled_urls()`, a seeded list of plain and unwanted addresses. The fitted trees are
one expression over columns. Suffix statistics are smoothed shares of allowed URLs: for the last host label, and for the
whole labels and dashed parts of the host, of which the least counts, and the mean; both for the `MAX_PARTS` commonest ones of
the labelled URLs that are in at least `LEAST_SEEN` of them, others have the share of all. No word counts inside another. In training, a URL's statistics come from the other folds. Without labels of both kinds the verdict is the commoner label, and allow without any.

null URLs and those without :// have an empty host and path and no rule, and are judged like any. Repeated rows stay rows.
Of fitting rules the longest wins; of equally long ones block wins.
"""

from __future__ import annotations

import json
import random
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralith.llm import gbt

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MAX_TRAIN = 20_000
#: Suffixes and host parts that are kept, the commonest ones.
MAX_PARTS = 300
LEAST_SEEN = 8
FOLDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["f_bytes", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_dashes", "f_escapes", "f_suffix", "f_part", "f_parts"]


#: Words that unwanted addresses of the generated list use in hosts, and words that any address uses.
UNWANTED = "adult ads bets bonus casino cheap click dating deals download earn escort fast free gambling hack loans lottery malware naked pills poker porn prize replica sex slots spam torrent track unlock viagra warez win x xxx".split()
_PLAIN = "about archive art article blog book category city data docs events forum garden guide health help history home journal kids law library local map media music nature news notes page people photo post press product project recipe report research school science shop sport story team topic travel user video weather wiki work".split()
_SYLLABLES = "an ber con dor el fin gar hal in jo kel lor mar nor on per qui ran sel ther tion un ver wen yor zan th st ou ble ing ed le re".split()


def labelled_urls(n: int = 8000, seed: int = 11) -> list[tuple[str, int]]:
    """(url, 1 to allow or 0), three plain ones for two others. Unwanted addresses are of several kinds, each of which shifts some of the lexical
    features (length, depth, digits, entropy, parameters, labels, suffix, host words) without setting it apart from plain ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(2, 4)))
    code = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    slug = lambda: rng.choice(["-", "-", "_"]).join(rng.choice([word(), rng.choice(_PLAIN), rng.choice(UNWANTED) if rng.random() < 0.1 else word()]) for _ in range(rng.randint(3, 9)))
    few = lambda k: min(int(rng.expovariate(1 / k)), 12)
    out = []
    for k in range(n):
        good = int(k % 5 < 3)
        kind = "" if good else rng.choice(["words", "words", "words", "code", "maze", "query", "number"])
        name = "-".join(rng.choice([word(), word(), rng.choice(_PLAIN)]) for _ in range(1 if rng.random() < 0.8 else 2))
        if good and rng.random() < 0.15:  # plain addresses hold single words of that kind too
            name = "-".join(rng.sample([rng.choice(UNWANTED), rng.choice([word(), rng.choice(_PLAIN)])], 2))
        if kind == "words":
            name = rng.choice(["-", "-", ""]).join([*rng.sample(UNWANTED, 2), *([rng.choice([word(), str(rng.randint(1, 999))])] if rng.random() < 0.3 else [])])
        elif kind == "code":
            name = code(rng.randint(9, 24))
        elif kind == "number":
            name = rng.choice([".".join(str(rng.randint(1, 255)) for _ in range(3)), f"{word()}{rng.randint(1000, 99_999_999)}"])
        labels = [rng.choice(["www", "m", "blog", "news", "docs", word()]) for _ in range(few(0.7) if kind != "maze" else 1 + few(2.5))][:6]
        suffix = rng.choice(["com", "org", "net", "edu", "info", "de", "fr"]) if good or rng.random() < 0.6 else rng.choice(["xyz", "top", "click", "info", "biz", "ru"])
        host = ".".join([*labels, name, *(["example"] if rng.random() < 0.4 else []), suffix])
        steps = [rng.choice([rng.choice(_PLAIN), word(), str(rng.randint(0, 99_999)), rng.choice(["en", "de", "fr", "es", "2019/05"])]) for _ in range(few(2.0 if kind != "maze" else 4.5))]
        if rng.random() < (0.35 if good else 0.15):
            steps.append(slug())
        if good and rng.random() < 0.3:  # numbers of articles, commits, books
            steps.append(rng.choice([code(rng.randint(6, 40)), f"s{rng.randint(10000, 99999)}-{rng.randint(10, 999):03d}-{rng.randint(1000, 99999)}-{rng.randint(1, 9)}", f"{rng.randint(10, 99)}.{rng.randint(1000, 9999)}", f"{rng.choice(_PLAIN).title()}_(%28{word()}%29)", str(rng.randint(10**6, 10**9)), f"{rng.randint(1, 120)}.{rng.randint(0, 99)}", f"{word()}{rng.randint(1, 99)}{rng.choice('abc')}"]))
        if kind in ("code", "maze") and rng.random() < 0.6:
            steps.append(code(rng.randint(12, 40)) + "".join(f"%{rng.randint(32, 255):02x}" for _ in range(few(2))))
        path = "/".join(["", *steps]) + rng.choice(["", "", "/", ".html", ".php"])
        pairs = [f"{rng.choice(['page', 'ref', 'id', 'q', 'lang', 'utm_source', 's'])}={rng.choice([word(), str(rng.randint(1, 999)), code(6)])}" for _ in range(few(0.6) if kind != "query" else 3 + few(3))]
        if good and not pairs and rng.random() < 0.15:
            pairs = [f"{rng.choice(['id', 'v', 'user', 'uri'])}={code(rng.randint(6, 14))}"]
        tail = "?" + "&".join(pairs) if pairs else rng.choice(["", "", "", "#" + word()])
        if kind == "query" and rng.random() < 0.6:
            tail += "&u=" + "".join(f"%{rng.randint(32, 255):02X}" for _ in range(rng.randint(2, 12)))
        out.append((rng.choice(["http://", "https://"]) + host + path + tail, good))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def _rule(rules) -> tuple[Column, Column]:
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0]))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in order]
    name = verdict = None
    for fit, (h, p, v) in zip(fits, order, strict=True):
        name = F.when(fit, h + p) if name is None else name.when(fit, h + p)
        verdict = F.when(fit, v) if verdict is None else verdict.when(fit, v)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _times(c: str) -> Column:
    return F.length("u") - F.length(F.replace(F.col("u"), F.lit(c), F.lit("")))


def lexical(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, ruled (the rule's verdict), suffix and the features but f_suffix."""
    one = pages.select(F.col("`page_id`").cast("bigint").alias("page_id"), F.coalesce(F.col("`url`").cast("string"), F.lit("")).alias("u"))
    host, path = split_url(F.col("u"))
    one = one.select("page_id", "u", host.alias("host"), path.alias("path"))
    name, verdict = _rule(rules)
    size = F.greatest(F.length("u"), F.lit(1)).cast("double")
    share = lambda c: (F.length("u") - F.length(F.replace(F.col("u"), c, F.lit("")))) / size
    entropy = F.aggregate(F.transform(F.array_distinct(F.split("u", "")), share), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    return one.select(
        "page_id",
        "host",
        "path",
        name.alias("rule"),
        verdict.alias("ruled"),
        F.xxhash64("u").alias("key"),
        F.substring_index("host", ".", -1).alias("suffix"),
        F.split("host", r"[.\-]").alias("parts"),
        F.length("u").cast("double").alias("f_bytes"),
        F.length("host").cast("double").alias("f_host"),
        F.length("path").cast("double").alias("f_path"),
        (F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))).cast("double").alias("f_depth"),
        (F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))).cast("double").alias("f_labels"),
        (F.length("u") - F.length(F.translate(F.col("u"), "0123456789", ""))).cast("double").alias("f_digit_count"),
        entropy.alias("f_entropy"),
        (_times("=") + _times("&")).cast("double").alias("f_params"),
        (_times("-") + _times("_")).cast("double").alias("f_dashes"),
        _times("%").cast("double").alias("f_escapes"),
        size.alias("size"),
    ).withColumn("f_digits", F.col("f_digit_count") / F.col("size"))


def _stats(groups: list[list[str]], y: np.ndarray, prior: float) -> dict[str, float]:
    n, good = Counter(), Counter()
    for names, label in zip(groups, y, strict=True):
        n.update(set(names))
        good.update(set(names) if label else ())
    return {s: float((good[s] + 2 * prior) / (n[s] + 2)) for s in sorted(n, key=lambda s: (-n[s], s))[:MAX_PARTS] if n[s] >= LEAST_SEEN}


def _map(stat: dict[str, float]) -> Column:
    return F.from_json(F.lit(json.dumps(stat)), "map<string,double>")


def sample_of(spark: SparkSession, labelled: DataFrame | None, rules, most: int) -> list:
    """The features of the labelled URLs (of `labelled_urls()` if none are given); at most `most` rows of a few numbers."""
    if labelled is None:
        listed = F.from_json(F.lit(json.dumps([{"url": u, "allow": a} for u, a in labelled_urls()])), "array<struct<url:string,allow:int>>")
        labelled = spark.range(1).select(F.inline(listed))
    chosen = labelled.select(F.col("`url`").cast("string").alias("url"), F.col("`allow`").cast("int").alias("allow")).filter("allow in (0, 1) and url is not null").orderBy(F.xxhash64("url"), "url", "allow").limit(most)
    return lexical(chosen.select(F.col("allow").alias("page_id"), "url"), rules).select("page_id", "suffix", "parts", *FEATURES[:-3]).collect()


def prior_of(sample: list) -> float:
    return (sum(r.page_id for r in sample) + 1) / (len(sample) + 2) if sample else 0.9


def fit(sample: list) -> tuple[dict[str, float], dict[str, float], gbt.Forest]:
    """(suffix statistics, host part statistics, trees)."""
    y = np.array([r.page_id for r in sample], dtype=float)
    prior = prior_of(sample)
    host_suffix, host_parts = [[r.suffix] for r in sample], [list(r.parts) for r in sample]
    suffixes, parts = _stats(host_suffix, y, prior), _stats(host_parts, y, prior)
    x = np.array([[*(r[f] for f in FEATURES[:-3]), 0.0, 0.0, 0.0] for r in sample]).reshape(len(sample), len(FEATURES))
    for fold in range(FOLDS):  # a row's own label is in no statistic that it is given
        mine = np.arange(len(y)) % FOLDS == fold
        others = np.flatnonzero(~mine)
        of_suffix, of_part = (_stats([groups[i] for i in others], y[others], prior) for groups in (host_suffix, host_parts))
        for i in np.flatnonzero(mine):
            shares = [of_part.get(n, prior) for n in host_parts[i][:-1]] or [prior]  # the suffix has its own
            x[i, -3:] = of_suffix.get(host_suffix[i][0], prior), min(shares), sum(shares) / len(shares)
    return suffixes, parts, gbt.fit(FEATURES, x, y, trees=60, least=20) if len(y) else gbt.Forest(FEATURES, 2.2)


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, most: int = MAX_TRAIN) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and score, the trees' probability of allow."""
    sample = sample_of(pages.sparkSession, labelled, rules, most)
    prior = prior_of(sample)
    suffixes, parts, forest = fit(sample)
    rows = lexical(pages, rules)
    rows = rows.withColumn("shares", F.transform(F.expr("if(size(parts) > 1, slice(parts, 1, size(parts) - 1), array(''))"), lambda p: F.coalesce(F.element_at(_map(parts), p), F.lit(prior))))
    mean = F.aggregate("shares", F.lit(0.0), lambda a, v: a + v) / F.size("shares")
    rows = rows.withColumns({"f_suffix": F.coalesce(F.element_at(_map(suffixes), F.col("suffix")), F.lit(prior)), "f_part": F.array_min("shares"), "f_parts": mean})
    score = F.lit(1.0) / (1 + F.exp(-F.expr(forest.sql())))
    out = rows.select("page_id", "host", "path", "rule", "ruled", score.alias("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
