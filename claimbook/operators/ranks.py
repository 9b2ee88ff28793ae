"""Row numbers within groups of any size, found by counting.

Rows fall into buckets that rise with the wanted order. Bucket counts are summed to offsets in
two levels, so only the rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.functions.semantics import quoted
from claimbook.operators.joins import join_null_safe

ROWS_PER_BUCKET = 4_096
BUCKETS_PER_BLOCK = 1_024


def hashed_rank(
    df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int, name: str = "rank",
    per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the place of each row, from 0, in a seeded random order of its group.

    The order is that of the MD5 of key and seed, then of the key, so it is the same on every
    run and engine. ``key`` should name a row: rows with the same key are next to each other in
    one bucket. A missing group is a group.
    """
    parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in key]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))
    total = df.count()
    buckets = max(1, -(-total // per_bucket))
    unit = F.conv(F.substring("_draw", 1, 8), 16, 10).cast("bigint")
    rows = df.withColumn("_draw", digest).withColumn(
        "_bucket", F.shiftright(unit * F.lit(buckets), 32)
    )
    sizes = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_block", F.floor(F.col("_bucket") / BUCKETS_PER_BLOCK)
    )
    blocks = sizes.groupBy(*groups, "_block").agg(F.sum("_n").alias("_m"))

    def before(value: str, within: Sequence[str], order: str) -> Column:
        rising = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(rising), F.lit(0))

    starts = blocks.select(*groups, "_block", before("_m", groups, "_block").alias("_start"))
    counted = sizes.withColumn("_inner", before("_n", [*groups, "_block"], "_bucket"))
    offsets = join_null_safe(counted, starts, [*groups, "_block"]).select(
        *groups, "_bucket", (F.col("_start") + F.col("_inner")).alias("_offset")
    )
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_draw", *[F.col(quoted(c)) for c in key])
    numbered = rows.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = join_null_safe(numbered, offsets, [*groups, "_bucket"])
    return joined.withColumn(name, F.col("_offset") + F.col("_inside")).drop(
        "_draw", "_bucket", "_inside", "_offset"
    )
