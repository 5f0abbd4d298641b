"""The resampling operator against its definition, and its ring against runs put together word by word."""

import hashlib
import math
import re
import zlib

import pytest

from graphnet_spark.llm import importance

from .conftest import prose

BENCHMARK = [prose(4, 40), None, "", "Écoute 你好 A1 b", prose(2, 80)]


def features(text, shortest, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(shortest, longest + 1) for i in range(len(words) - k + 1)]


def expected(rows, shortest, longest, buckets, percent):
    found = [(d, *features(t, shortest, longest)) for d, t in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, _, hashes in found:
        for h in hashes:
            s[h % buckets] += 1
    for text in BENCHMARK:
        for h in features(text, shortest, longest)[1]:
            t[h % buckets] += 1
    s_all, t_all = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (s_all + buckets) / ((a + 1) * (t_all + buckets)))) for a, b in zip(s, t)]
    out = []
    for d, n, hashes in found:
        weight = math.floor(sum(gain[h % buckets] for h in hashes) / len(hashes)) if hashes else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(hashes), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("shortest, longest, buckets, percent", [(1, 1, 10_000, 10), (1, 3, 10_000, 35), (2, 4, 100_000, 60), (3, 3, 50, 100)])
def test_equals_the_definition(spark, docs, shortest, longest, buckets, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    long = " ".join(f"W{k % 977}" for k in range(400_000))
    rows.append((77, long))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, long)], "doc_id long, text string"))
    target = spark.createDataFrame([(t,) for t in BENCHMARK], "text string")
    got = [tuple(r) for r in importance.resampled(both, target, shortest, longest, buckets, percent).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(map(tuple, expected(rows, shortest, longest, buckets, percent)), key=key)


def test_equal_scores_go_to_the_smaller_id_over_many_partitions(spark):
    rows = [(k % 40, "x " * 30, k) for k in range(400)] + [(None, "x " * 30, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long").repartition(17)
    got = importance.resampled(docs, spark.createDataFrame([], "text string"), percent=100).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 402))
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)


def test_empty_tables(spark, empty, sf):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.op13_importance_ring(spark, sf(documents=empty, benchmark=none)).count() == 0


def test_query_over_odd_rows(spark, docs, sf):
    path = sf(documents=docs, benchmark=spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string"))
    got = importance.op13_importance_ring(spark, path)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and got.count() == docs.count()
