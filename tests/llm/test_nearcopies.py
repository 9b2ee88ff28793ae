import random

from claimbook.llm import nearcopies, stages
from reference_forms import near_copies

SCHEMA = "doc_id long, text string, lang string"


def test_near_copies_with_scattered_edits_go(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for i in range(60):
        base = [word() for _ in range(rng.choice([3, 8, 60, 300]))]
        rows.append((i, " ".join(base)))
        for c in range(rng.randrange(4)):
            other = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 25))):
                other[rng.randrange(len(base))] = word()
            rows.append((100 + 10 * i + c, " ".join(other).upper() + "\n"))
    rows += [(5000, None), (5001, " "), (5002, "")]
    want = near_copies(rows)
    assert len(want) < len(rows) - 20
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA).repartition(5)
    got = [r["doc_id"] for r in stages.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(want)


def test_a_hub_of_near_copies_and_pairs_beside_the_pivot(spark):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for i in range(1, 80):
        other = list(base)
        other[rng.randrange(5, 95)] = f"x{i}"
        other[rng.randrange(5, 95)] = f"y{i}"
        rows.append((i, " ".join(other)))
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    assert {r["doc_id"] for r in nearcopies.first_rows(docs).collect()} == near_copies(rows)


def test_equal_keys_and_null_keys(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one), (1, two), (1, two), (None, one), (None, "only here"), (None, "only here"), (7, two + " end")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["text"]) for r in stages.drop_near_duplicates(spark, docs, "").collect())
    assert got == sorted([("1", one), ("1", two), ("None", "only here")])
    assert nearcopies.first_rows(docs.limit(0)).collect() == []
