import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimbook.llm import shards, topk
from reference_forms import top_k

DOCS = "doc_id long, text string, source string, shard string, bucket int"


def _docs(spark, n=500):
    data = [(i, f"text {i % 40} é", "big" if i % 3 else f"s{i % 7}", "x", 1) for i in range(n)]
    data += [(None, "no key", None, None, None), (n, None, "s1", None, None), (n + 1, "", "s1", None, None)]
    data += [(7, "text 7 é", "big", "x", 1)]
    return data, spark.createDataFrame(data, DOCS)


def test_shards_are_equal_and_hold_the_mixture(spark):
    data, df = _docs(spark)
    got = shards.interleave(df, shards=8).collect()
    assert len(got) == len(data)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    slots, mix = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for source, counts in mix.items():
        n = sum(counts.values())
        assert all(abs(counts[s] - n / 8) <= 2 for s in range(8)), source
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[3]["size"] == len("text 3 é".encode()) + 8
    assert by_id[500]["size"] == 8 and by_id[500]["text_crc32"] == 0
    assert by_id[3]["text_crc32"] == zlib.crc32("text 3 é".encode())


def test_shards_repeat_and_follow_the_seed(spark):
    _, df = _docs(spark, 60)
    key = lambda rows: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in rows)
    one = key(shards.interleave(df, 4).collect())
    assert one == key(shards.interleave(df.repartition(5), 4).collect())
    assert one != key(shards.interleave(df, 4, seed=8).collect())


def test_shards_of_few_or_no_rows(spark):
    _, df = _docs(spark, 2)
    assert len(shards.interleave(df.limit(2), 24).collect()) == 2
    assert shards.interleave(df.limit(0), 24).collect() == []


def test_ranks_over_many_buckets(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), (F.col("id") / 5).cast("long").alias("b"))
    bad = shards.ranked(df, ["g"], "b", [F.col("v")], "r").filter("r <> v div 2")
    assert bad.count() == 0


@pytest.mark.parametrize("low", [0.0, 0.5])
def test_top_k_is_exact(spark, monkeypatch, low):
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.uniform(low - 1, 1, 6)]) for i in range(400)]
    rows += [(500, rows[0][1]), (501, None), (600, [None] * 6), (700, [float("nan")] + [0.1] * 5),
             (800, [float("inf")] * 6), (900, [0.0] * 6), (None, rows[100][1]), (1000, [0.5, 0.25]), (1001, [0.5, 0.5]), (1100, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    got = [tuple(r) for r in topk.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()]
    assert sorted(got, key=lambda r: r[:2]) == sorted(top_k(rows), key=lambda r: r[:2])


def test_top_k_stops_early_and_reads_no_more(spark):
    rng = np.random.default_rng(1)
    vectors = rng.integers(-50, 50, (2_000, 3))
    vectors[17] = [900, 900, 900]
    lists = np.argsort(-vectors, axis=0, kind="stable")
    at = topk.threshold_search(vectors, np.arange(2_000), lists, np.array([5, 4, 3]), np.zeros(2_000, bool), 1)
    assert at.tolist() == [17]


def test_top_k_of_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(100, [1.0]), (100, [1.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    got = topk.nearest(df, F.col("vec_id") % 100 == 0, 10).collect()
    assert len(got) == 4 and {r["vec_id"] for r in got} == {100, 3}
    assert topk.nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
