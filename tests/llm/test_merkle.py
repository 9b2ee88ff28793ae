"""Merkle manifest against a plain tree in lists, and the layout against its definition."""

import zlib
from hashlib import sha256

import pytest

from claimbook.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def record(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n = None if n_chars is None else n_chars + more
    values = [doc_id, source, lang, n, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    out = [list(nodes)]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """Rows of the trial, from trees held as lists."""
    if not rows:
        return []
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, record(r)))
        trees[g] = levels_of([record(r) for r in groups[g]])
    upper = levels_of([trees[g][-1][0] for g in order])
    root, out = upper[-1][0], []
    for at, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node, sibs = record(row, 1 if bad else 0), []
            for tree, spot in ((trees[g], i), (upper, at)):
                for level in tree[:-1]:
                    pair = level[spot - spot % 2 : spot - spot % 2 + 2]
                    mine = spot % 2
                    sibs += pair[:mine] + pair[mine + 1 :]
                    pair[mine] = node
                    node, spot = h(*pair), spot // 2
            out.append((row[0], record(row), trees[g][-1][0], root, h(*sibs), node, node == root))
    return sorted(out, key=str)


CASES = {
    "mixed": [(i, f"text {i} é" * (i % 5), ["de", "en", "fr", None, ""][i % 5 if i % 3 else 1], "web" if i % 4 else None,
               i if i % 6 else None) for i in range(83)],
    "one group": [(i, "same", "en", "web", 4) for i in range(37)],
    "one row": [(7, "x", "en", "web", 1)],
    "null keys and repeats": [(None, None, None, None, None)] * 3 + [(5, "a", "en", "s", 1)] * 6 + [(5, "b", "en", "s", 1)],
    "many groups": [(i, "", f"l{i}", None, 0) for i in range(21)],
    "empty": [],
}


@pytest.mark.parametrize("case, height", [(c, 12) for c in CASES] + [
    ("mixed", 2), ("one group", 1), ("null keys and repeats", 1), ("many groups", 2)])
def test_trial_equals_plain_trees(spark, case, height):
    rows = [r + ("clash", 1) for r in CASES[case]]
    got = merkle.tampering_trial(spark.createDataFrame(rows, SCHEMA), height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(CASES[case])


def test_only_altered_rows_fail(spark):
    rows = [(i, "t", "en", "s", i) for i in range(200)]
    got = merkle.tampering_trial(spark.createDataFrame([r + ("", 0) for r in rows], SCHEMA)).collect()
    failed = {r["doc_id"] for r in got if not r["verified"]}
    assert failed == {i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 0} != set()


@pytest.mark.parametrize("levels", range(1, 14))
def test_layout_halves_the_height_again_and_again(levels):
    def walk(height, depth, index, base, out):
        if height == 1:
            out[depth, index] = base
            return
        top = height // 2
        walk(top, depth, index, base, out)
        for k in range(1 << top):
            below = base + (1 << top) - 1 + k * ((1 << (height - top)) - 1)
            walk(height - top, depth + top, (index << top) + k, below, out)

    want = {}
    walk(levels, 0, 0, 0, want)
    got = {(d, i): int(s) for d, row in enumerate(merkle.slots(levels)) for i, s in enumerate(row)}
    assert got == want
    assert sorted(got.values()) == list(range((1 << levels) - 1))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 13])
def test_siblings_lead_to_the_top(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = merkle._levels(n, 12)
    nodes, top = merkle.lay_out(leaves, levels)
    assert top == levels_of(leaves)[-1][0]
    for i, leaf in enumerate(leaves):
        assert merkle.fold(leaf, merkle.siblings(nodes, levels, n, i)) == top
