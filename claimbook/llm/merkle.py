"""Merkle manifest of a table: blocks of nodes in van Emde Boas order, and proofs against them.

Leaves of a group are ranked by key. Every aligned run of 4,096 leaves is the bottom of one
subtree; the subtree is one stored row, its nodes laid out by halving the height again and
again, so that a walk from leaf to top stays in neighbouring slots whatever the size of a
cache line or page. The tops of the subtrees are the leaves of the next round, until a group
is down to its subroot; the subroots, ordered by group, go through the same rounds to the root.
A task only ever holds one block: 4,096 leaves, whatever share of the rows one group has.

Digests are SHA-256. A node hashes the hexadecimal text of its children.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache, reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.llm.tables import written

HEIGHT = 12
LEFT, RIGHT, ALONE = 1, 2, 0


def record_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (32 bytes) of a record: per field ``-`` if null, else byte count, ``:`` and value."""
    parts = [f.cast("string") for f in fields]
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*framed).cast("binary"), 256))


def digest_of(*texts: str) -> str:
    """SHA-256 of the joined texts, as hexadecimal text."""
    return sha256("".join(texts).encode()).hexdigest()


@lru_cache(maxsize=64)
def slots(levels: int) -> tuple[np.ndarray, ...]:
    """Slot of every node of a complete tree, by depth and then from left to right.

    The upper half of the levels comes first, then one by one the subtrees below it; both
    are laid out in the same way.
    """
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    lower = levels - upper
    first, size = (1 << upper) - 1, (1 << lower) - 1
    starts = first + size * np.arange(1 << upper, dtype=np.int64)
    below = tuple((starts[:, None] + inner[None, :]).ravel() for inner in slots(lower))
    return slots(upper) + below


def _levels(total: int, height: int) -> int:
    """Levels of a block of a group of ``total`` leaves: as many as needed if it is the only one."""
    return height + 1 if total > 1 << height else (total - 1).bit_length() + 1


def lay_out(leaves: Sequence[str], levels: int) -> tuple[bytes, str]:
    """Nodes of a block in van Emde Boas order, 32 bytes a slot, and the digest at its top."""
    nodes = np.zeros(((1 << levels) - 1, 32), np.uint8)
    place, row = slots(levels), list(leaves)
    for depth in range(levels - 1, -1, -1):
        nodes[place[depth][: len(row)]] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
        if depth:
            row = [digest_of(*row[i : i + 2]) for i in range(0, len(row), 2)]
    return nodes.tobytes(), row[0]


def siblings(nodes: bytes, levels: int, n: int, at: int) -> list[tuple[int, str]]:
    """Steps from a leaf to the top of its block: where the sibling stands, and its digest."""
    place, steps = slots(levels), []
    for depth in range(levels - 1, 0, -1):
        other = at ^ 1
        if other < n:
            start = 32 * int(place[depth][other])
            steps.append((LEFT if other < at else RIGHT, nodes[start : start + 32].hex()))
        else:
            steps.append((ALONE, ""))
        at, n = at >> 1, (n + 1) >> 1
    return steps


def fold(leaf: str, steps: Sequence[tuple[int, str]]) -> str:
    """Digest at the end of a path."""
    for side, other in steps:
        leaf = digest_of(other, leaf) if side == LEFT else digest_of(leaf, other)
    return leaf


def _packed(steps: Sequence[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(other) for side, other in steps)


def _unpacked(path: bytes) -> list[tuple[int, str]]:
    steps, at = [], 0
    while at < len(path):
        width = 0 if path[at] == ALONE else 32
        steps.append((path[at], path[at + 1 : at + 1 + width].hex()))
        at += 1 + width
    return steps


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with ``rank`` from 0 and ``total`` within ``grp``, by the columns ``order``.

    Rows are dealt into ranges of group and order and sorted there; a rank is a row's place in
    its range plus the counts of the ranges before, so a group is never in one task. Rows equal
    in all of the order are told apart by their place in the input.
    """
    keyed = rows.withColumn("tie", F.monotonically_increasing_id())
    by = ["grp", *order, "tie"]
    laid = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    laid = written(laid.withColumn("place", F.monotonically_increasing_id()))
    laid = laid.withColumn("part", F.shiftrightunsigned("place", 33))
    pieces = laid.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        "grp", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("total"))
    return laid.join(offsets, ["grp", "part"]).withColumn(
        "rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def _block(rank: Column, height: int) -> Column:
    return F.shiftright(rank, height)


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """One row per block of ``grp, rank, total, leaf``: its nodes and its top."""

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rank = rows["rank"].to_numpy()
        digests, order = rows["leaf"].to_pylist(), np.argsort(rank)
        levels = _levels(rows["total"][0].as_py(), height)
        nodes, top = lay_out([digests[i].hex() for i in order], levels)
        return pa.table({
            "grp": [key[0].as_py()], "block": [key[1].as_py()], "n": pa.array([len(rank)], pa.int32()),
            "levels": pa.array([levels], pa.int32()), "total": [rows["total"][0].as_py()],
            "nodes": pa.array([nodes], pa.binary()), "top": pa.array([bytes.fromhex(top)], pa.binary()),
        })

    keyed = leaves.select("grp", _block(F.col("rank"), height).alias("block"), "rank", "total", "leaf")
    return keyed.groupBy("grp", "block").applyInArrow(
        build, "grp string, block long, n int, levels int, total long, nodes binary, top binary")


def _rounds(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Tables of blocks from the leaves up, until every group has one block."""
    rounds = [written(_blocks(leaves, height))]
    many = F.col("total") > 1 << height
    while not rounds[-1].filter(many).isEmpty():
        tops = rounds[-1].filter(many).select(
            "grp", F.col("block").alias("rank"), F.col("top").alias("leaf"),
            F.expr(f"(total + {(1 << height) - 1}) div {1 << height}").alias("total"))
        rounds.append(written(_blocks(tops, height)))
    return rounds


def _tops(rounds: list[DataFrame], height: int) -> DataFrame:
    """Group and top of the blocks that end a group."""
    ends = [r.filter(F.col("total") <= 1 << height).select("grp", "top") for r in rounds]
    return reduce(DataFrame.unionAll, ends)


def _paths(blocks: DataFrame, height: int) -> DataFrame:
    """Path of every leaf of blocks that have the path ``above`` their top."""

    def walk(batches):
        for batch in batches:
            grps, ranks, paths, subroots = [], [], [], []
            for row in batch.to_pylist():
                for at in range(row["n"]):
                    steps = siblings(row["nodes"], row["levels"], row["n"], at)
                    grps.append(row["grp"])
                    ranks.append((row["block"] << height) + at)
                    paths.append(_packed(steps) + row["above"])
                    subroots.append(row["subroot"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(grps, pa.string()), pa.array(ranks, pa.int64()), pa.array(paths, pa.binary()),
                 pa.array(subroots, pa.binary())], ["grp", "block", "above", "subroot"])

    return blocks.mapInArrow(walk, "grp string, block long, above binary, subroot binary")


@dataclass(frozen=True)
class Manifest:
    """Stored blocks of all groups and of the groups' subroots, and the ranked leaves."""

    leaves: DataFrame
    rounds: list[DataFrame]
    group_rounds: list[DataFrame]
    groups: DataFrame
    root: str | None
    height: int


def build(rows: DataFrame, group: str, key: str, leaf: str, claim: str | None = None, height: int = HEIGHT) -> Manifest:
    """Manifest of rows whose digest is in ``leaf`` (32 bytes), per ``group`` by rising ``key``.

    While a group has several nodes, every two neighbours become their digest, a last one alone
    becomes its own; what is left is the subroot. Subroots, null group first and then by UTF-8
    bytes, become the root in the same way. ``claim`` is a second digest to be proved later
    instead of the leaf (null: the leaf).

    Null keys come first; rows with the same key go by digest, equal rows are each a leaf. An
    empty table has no root. Columns other than those named are left out, so their names do not
    matter.
    """
    narrow = rows.select(
        # a prefix keeps a missing group apart from an empty one, and first
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(key).alias("key"), F.col(leaf).alias("leaf"),
        (F.col(claim) if claim else F.lit(None).cast("binary")).alias("claim"))
    leaves = _numbered(narrow, ["key", "leaf"])
    rounds = _rounds(leaves.select("grp", "rank", "total", "leaf"), height)
    named = _tops(rounds, height).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("leaf"))
    groups = written(_numbered(named, ["name"]))
    group_rounds = _rounds(groups.select("grp", "rank", "total", "leaf"), height)
    top = _tops(group_rounds, height).first()
    return Manifest(leaves, rounds, group_rounds, groups, bytes(top["top"]).hex() if top else None, height)


def _with_paths(manifest: Manifest) -> DataFrame:
    """The lowest blocks with the path above their top and their group's subroot."""
    height = manifest.height
    many = F.col("total") > 1 << height
    nothing = F.lit(b"").alias("above")
    above = None
    for blocks in reversed(manifest.group_rounds):
        ended = blocks.filter(~many).select("*", nothing, F.lit(b"").alias("subroot"))
        if above is not None:
            ended = ended.unionByName(blocks.filter(many).join(above, ["grp", "block"]))
        above = _paths(ended, height)
    of_group = manifest.groups.join(
        above.select(F.col("block").alias("rank"), "above"), "rank"
    ).select(F.col("name").alias("grp"), "above", F.col("leaf").alias("subroot"))
    above = None
    for i, blocks in enumerate(reversed(manifest.rounds)):
        ended = blocks.filter(~many).join(of_group, "grp")
        if above is not None:
            ended = ended.unionByName(blocks.filter(many).join(above, ["grp", "block"]))
        if i == len(manifest.rounds) - 1:
            return ended
        above = _paths(ended, height)
    raise ValueError("a manifest has one round at least")


def prove(manifest: Manifest, key: str = "key") -> DataFrame:
    """Proof of every leaf, folded from its claim: ``key, leaf, subroot, root, proof_sha256,
    folded_root, verified``.

    ``proof_sha256`` is the digest of the siblings on the way to the root, level by level. A
    claim is verified if it leads to the root. An empty manifest gives no rows.
    """
    height, root = manifest.height, manifest.root
    schema = manifest.leaves.select(F.col("key").alias(key)).schema.simpleString()[7:-1]

    def retrieve(_, rows: pa.Table, blocks: pa.Table) -> pa.Table:
        block = {c: blocks[c][0].as_py() for c in ("n", "levels", "nodes", "above", "subroot")}
        above = _unpacked(block["above"])
        leaves, claims = rows["leaf"].to_pylist(), rows["claim"].to_pylist()
        ranks = (rows["rank"].to_numpy() & ((1 << height) - 1)).tolist()
        proofs, folded = [], []
        for at, leaf, claim in zip(ranks, leaves, claims, strict=True):
            steps = siblings(block["nodes"], block["levels"], block["n"], at) + above
            proofs.append(digest_of(*[other for _, other in steps]))
            folded.append(fold((leaf if claim is None else claim).hex(), steps))
        n = len(leaves)
        return pa.table({
            key: rows["key"], "leaf": [v.hex() for v in leaves],
            "subroot": [block["subroot"].hex()] * n, "root": [root] * n, "proof_sha256": proofs,
            "folded_root": folded, "verified": [f == root for f in folded],
        })

    rows = manifest.leaves.withColumn("block", _block(F.col("rank"), height))
    blocks = _with_paths(manifest).select("grp", "block", "n", "levels", "nodes", "above", "subroot")
    return rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(
        retrieve, f"{schema}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean")


def is_tampered(key: str) -> Column:
    """The rows to be altered in a trial: 7 divides the CRC-32 of the decimal key (null: no)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0, F.lit(False))


def tampering_trial(docs: DataFrame, key: str = "doc_id", group: str = "lang", count: str = "n_chars",
                    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
                    height: int = HEIGHT) -> DataFrame:
    """Proofs of all rows against the manifest of the table as it is, some rows being altered.

    ``leaf``, ``subroot``, ``root`` and ``proof_sha256`` belong to the unaltered table. In rows
    that ``is_tampered`` picks, ``count`` is one higher (null stays null) in the record whose
    digest is folded. Nulls are values of their own; empty and long texts, repeated rows and
    keys, an empty table and further columns are as in ``build``.
    """
    altered = [F.when(is_tampered(key), F.col(f) + 1).otherwise(F.col(f)) if f == count else F.col(f) for f in fields]
    rows = docs.select(
        F.col(key).alias("key"), F.col(group).alias("group"), record_digest([F.col(f) for f in fields]).alias("leaf"),
        F.when(is_tampered(key), record_digest(altered)).alias("claim"))
    return prove(build(rows, "group", "key", "leaf", "claim", height), key)


SQL = """
WITH RECURSIVE steps AS (
  SELECT list(v ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_concat([n], range(8)),
               lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) AS r(n))
), summed AS (
  SELECT *, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ord(d))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS tampered
  FROM documents, steps
), framed AS (
  SELECT doc_id, lang, tampered,
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
           || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
         coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS told,
         coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS altered,
         coalesce(octet_length(encode(text)) || ':' || text, '-') AS body
  FROM summed
), leaves AS (
  SELECT doc_id, lang, leaf, claim, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, sha256(head || told || body) AS leaf,
               sha256(head || CASE WHEN tampered THEN altered ELSE told END || body) AS claim FROM framed)
), tree AS (
  SELECT lang, 0 AS lvl, pos AS i, leaf AS h, n FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 2
), subroots AS (
  SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS lvl, pos AS i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM upper_tree WHERE n > 1 GROUP BY lvl, i // 2
), walk AS (
  SELECT l.doc_id, l.lang, l.pos AS start, l.leaf, l.claim AS folded, '' AS sibs, 0 AS lvl, l.pos AS i, s.height, s.subroot, s.pos AS above,
         (SELECT max(lvl) FROM upper_tree) AS top
  FROM leaves AS l JOIN subroots AS s ON l.lang IS NOT DISTINCT FROM s.lang
  UNION ALL
  SELECT doc_id, lang, start, leaf,
         sha256(CASE WHEN spot % 2 = 1 THEN coalesce(sib, '') || folded ELSE folded || coalesce(sib, '') END),
         sibs || coalesce(sib, ''), lvl + 1, spot // 2, height, subroot, above, top
  FROM (
    SELECT w.*, CASE WHEN w.lvl = w.height THEN w.above ELSE w.i END AS spot, coalesce(t.h, u.h) AS sib
    FROM walk AS w
    LEFT JOIN tree AS t ON w.lvl < w.height AND t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.i = xor(w.i, 1)
    LEFT JOIN upper_tree AS u ON w.lvl >= w.height AND u.lvl = w.lvl - w.height
         AND u.i = xor(CASE WHEN w.lvl = w.height THEN w.above ELSE w.i END, 1)
    WHERE w.lvl < w.height + w.top
  )
)
SELECT doc_id, leaf, subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root, sha256(sibs) AS proof_sha256, folded AS folded_root,
       folded = (SELECT h FROM upper_tree WHERE n = 1) AS verified
FROM walk WHERE lvl = height + top
"""
