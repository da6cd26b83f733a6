"""Importance resampling against brute force, and its quickselect alone."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textmill.llm.importance import features, kth_key, resample
from textmill.llm.common import written

LOWER = {k: k + 32 for k in range(65, 91)}


def own_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, target, percent=25, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in own_features(x)[1]) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for k, (i, x) in enumerate(docs):
        w, f = own_features(x)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], -(1 << 63) if r[0] is None else r[0], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return Counter((r[0], *r[2:]) for r in out)


def corpus(n):
    r = random.Random(n)
    letters = [*"abC .,é中 \t\n09_😀", "target", " of ", "Ünd ", "x" * 70, " " + "é" * 40 + " "]
    texts = [None, "", " .,", "a" * 5000, *("".join(r.choice(letters) for _ in range(r.randrange(400))) for _ in range(n))]
    return [*enumerate(texts), (5, texts[5]), (5, texts[5]), (6, texts[9]), (None, texts[8]), (None, texts[8]), (None, texts[7])]


def test_features_are_checksums_of_whole_runs():
    for size in (10, 40):
        texts = [t for _, t in corpus(size)]
        array = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
        n, ends, found = features(array, 2**31 - 1)
        for k, t in enumerate(texts):
            w, f = own_features(t)
            assert n[k] == len(w) and Counter(found[ends[k] : ends[k + 1]].tolist()) == Counter(zlib.crc32(x.encode()) % (2**31 - 1) for x in f)


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resample(spark, percent):
    docs, target = corpus(150), ["target of of x", None, "Target ünd", ""]
    rows = [(i, t, k, "y", 1) for k, (i, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id int, score string, `a-b` int")
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    done = resample(df, bench, percent=percent, carry=["id", "score", "a-b"])
    got = done.collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == brute(docs, target, percent)
    assert sorted(r["row"]["id"] for r in got) == list(range(len(docs)))
    assert sum((r["weight"]) * (r["n_features"] > 0) for r in got) != 0


def test_resample_without_rows_or_target(spark):
    docs = corpus(30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([], "text string")
    assert Counter(tuple(r) for r in resample(df, bench).collect()) == brute(docs, [])
    assert resample(df.limit(0), bench).collect() == []


def test_quickselect_finds_every_rank_among_ties(spark):
    r = random.Random(1)
    keys = sorted((r.choice([0, 0, 0, r.randrange(5)]), r.choice([-(1 << 63), 3, 4]), k) for k in range(500))
    rows = written(spark.createDataFrame(r.sample(keys, len(keys)), "a long, b long, c long"), "keys")
    for k in (1, 2, 250, 499, 500):
        assert kth_key(rows, ["a", "b", "c"], k, pivots=4) == keys[k - 1]


def test_a_third_of_all_rows_with_one_key(spark):
    """Rows with one id, text and score are drawn up to the exact number."""
    df = spark.createDataFrame([(1, "a b c " * 10)] * 400 + [(k, f"w{k} " * 25) for k in range(2, 802)], "doc_id long, text string")
    got = resample(df, spark.createDataFrame([("a b c",)], "text string")).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert ranks == list(range(1, 301)) and len(got) == 1200
    assert np.diff([r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]).max() <= 0
