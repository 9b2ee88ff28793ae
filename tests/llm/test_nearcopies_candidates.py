"""How the near-duplicate stage finds its pairs: by fingerprints, and by rare shingles where a band stays mixed."""

import random
from itertools import combinations

from claimbook.llm import nearcopies, simhash, stages
from reference_forms import near_copies


def template(n, seed, low, high):
    """A text of 150 words and copies of it with words of their own, close and far ones."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(n):
        other = list(base)
        for at in rng.sample(range(150), rng.randint(low, high)):
            other[at] = f"x{i}_{at}"
        rows.append((i, " ".join(other)))
    return rows


def similar(rows):
    sets = {i: nearcopies.shingles(t) for i, t in rows}
    return {(i, j) for i, j in combinations(sets, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}


def test_rare_shingles_propose_every_similar_pair_and_few_others(spark):
    rows = template(150, 6, 0, 12)
    want = similar(rows)
    docs = spark.createDataFrame([(str(i).rjust(3).encode(), str(i).encode(), t) for i, t in rows], "v binary, label binary, text string")
    sets = docs.mapInArrow(nearcopies._sets(5), "v binary, label binary, n int, shingles array<long>")
    got = {tuple(int(bytes(x)) for x in r) for r in nearcopies.rare_first(sets, 0.8).collect()}
    assert want and want <= got
    assert len(got) < 2 * len(want) < 150 * 149 / 4


def test_pairs_of_one_group_are_not_proposed(spark):
    rows = [(i, t, i < 40) for i, t in template(60, 7, 0, 2)]
    docs = spark.createDataFrame(
        [(str(i).rjust(3).encode(), b"a" if one else str(i).encode(), t) for i, t, one in rows], "v binary, label binary, text string")
    sets = docs.mapInArrow(nearcopies._sets(5), "v binary, label binary, n int, shingles array<long>")
    got = {tuple(int(bytes(x)) for x in r) for r in nearcopies.rare_first(sets, 0.8).collect()}
    assert got >= {p for p in similar([(i, t) for i, t, _ in rows]) if p[1] >= 40} and all(j >= 40 for _, j in got)


def test_a_pattern_with_many_far_copies(spark):
    rows = template(200, 8, 0, 25)
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in stages.drop_near_duplicates(spark, docs, "").collect()} == near_copies(rows)


def test_the_stage_takes_fingerprints_of_its_shingles(spark):
    rows = [(i, f"{'word ' * i}{t}") for i, t in template(30, 9, 0, 2)] + [(90, None), (91, ""), (92, " ")]
    docs = spark.createDataFrame([(str(i).encode(), t) for i, t in rows], "v binary, text string")
    signed = docs.mapInArrow(nearcopies._signed(5), "v binary, fp long, bands array<long>").collect()
    signer = nearcopies._Signer()
    fp = {bytes(r["v"]): r["fp"] & (1 << 64) - 1 for r in signed}
    assert all(fp[str(i).encode()] == simhash.majority(signer.shingles(t or "", 5)) for i, t in rows)
    close = nearcopies.close_fingerprints(spark.createDataFrame(signed, "v binary, fp long, bands array<long>")).collect()
    least = {f: min(v for v in fp if fp[v] == f) for f in fp.values()}
    want = {(min(least[f], least[g]), max(least[f], least[g])) for f, g in combinations(least, 2) if (f ^ g).bit_count() <= 2}
    want |= {(least[f], v) for v, f in fp.items() if least[f] != v}
    assert {(bytes(r["a"]), bytes(r["b"])) for r in close} == want and want
