import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import resampling as rs

ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def brute(rows, items, percent=25, least=20):
    docs = [(d, *brute_features(t)) for d, t in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs:
        s.update(f)
    for text in items:
        t.update(brute_features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for d, n, f in docs:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is None, x or 0) for x in r])


def items_of(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def corpus(seed, n=200):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "été", "x1", "2-3", "don't", "日本", "mat"]
    return [(d, " ".join(rng.choice(words[d % 5 :]) for _ in range(rng.randint(0, 45)))) for d in range(n)]


@pytest.mark.parametrize("percent", [0, 1, 25, 100])
def test_equals_brute_force(docs_of, spark, percent):
    rows, items = corpus(1), ["the cat sat", "x1 été mat", None, ""]
    got = rs.resample(docs_of(rows), items_of(spark, items), percent)
    assert order(got.collect()) == order(brute(rows, items, percent))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]


def test_cut_falls_among_equal_scores(spark):
    rows = [(n, d, s, 30) for n, (s, d) in enumerate([(5, 9), (5, 3), (5, None), (5, 1), (9, 7), (1, 1), (5, 3)])]
    scores = spark.createDataFrame(rows, "row_no long, doc_id long, score long, n_words long").repartition(2)
    ordered = sorted(rows, key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))
    for wanted in range(1, 8):
        taken = scores.where(rs.drawn(scores, wanted)).collect()
        assert sorted(r.row_no for r in taken) == sorted(r[0] for r in ordered[:wanted])
    assert rs.drawn(scores, 0) is None


def test_bisection_over_wide_and_negative_values(spark):
    rng = random.Random(4)
    values = [rng.randint(-(2**62), 2**62) for _ in range(50)] + [0] * 30
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for wanted in (1, 7, 25, 60, 80):
        cut, above = rs.bisect(rows, "v", wanted)
        assert cut == sorted(values, reverse=True)[wanted - 1]
        assert above == sum(v > cut for v in values)


def test_repeated_rows_take_ranks_of_their_own(docs_of, spark):
    rows = [(1, "one two three four " * 10)] * 40 + [(2, "word " * 30)] * 3
    got = rs.resample(docs_of(rows), items_of(spark, ["one two"]), 50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 22))
    assert order(r[:4] for r in got) == order(r[:4] for r in brute(rows, ["one two"]))


def test_odd_documents(odd_docs, spark):
    docs = odd_docs.selectExpr("*", "1 as score", "2 as rank", "'x' as weight", "3 as row_no", "4 as part", "5 as n_words")
    items = items_of(spark, ["same text twice"]).withColumn("bucket", F.lit(1))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert order(rs.resample(docs, items, 100).collect()) == order(brute(rows, ["same text twice"], 100))
    assert order(rs.resample(docs, items.limit(0)).collect()) == order(brute(rows, []))
    assert rs.resample(docs.limit(0), items).collect() == []
