"""Proportional stratified interleaving: shards that all hold the mixture of the sources.

Only DataFrame functions are used. Ranks come from counting: rows fall into many small
buckets, bucket counts are summed to offsets in two levels, and a row number is needed
only inside a bucket, so no task ever holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimbook.llm.tables import written

ROWS_PER_BUCKET = 4_096


def ranked(df: DataFrame, groups: list[str], bucket: str, order: list[Column], name: str,
           total: str | None = None) -> DataFrame:
    """The rows with their rank from 0 within ``groups``, by bucket and then ``order``.

    The row count of the group is added as ``total``, if that is named. Rows meet the counts by
    group and bucket only, so they are never dealt out by a group alone.

    ``bucket`` must rise with the wanted order and hold few rows of a group each. Offsets
    are sums over blocks of 1,024 buckets and over the buckets of a block.
    """
    sizes = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_block", F.expr(f"`{bucket}` div 1024"))
    blocks = sizes.groupBy(*groups, "_block").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*groups, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    starts = blocks.select(*groups, "_block", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_start"),
                           F.sum("_m").over(whole).alias("_total"))
    offsets = (
        sizes.withColumn("_inner", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(starts, [*groups, "_block"])
        .select(*groups, bucket, (F.col("_start") + F.col("_inner")).alias("_offset"), "_total")
    )
    inside = Window.partitionBy(*groups, bucket).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, [*groups, bucket])
        .withColumn(name, F.col("_offset") + F.col("_inside"))
        .withColumnRenamed("_total", total or "_total")
        .drop("_offset", "_inside", "_total")
    )


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7, key: str = "doc_id",
               stratum: str = "source", text: str = "text") -> DataFrame:
    """Every row's shard and its slot in it: ``key, stratum, size, text_crc32, shard, slot``.

    Rows are put in a seeded random order within their source; row r of n (from 0) has the
    fractional rank (2r + 1) / 2n. Sorted by that number, any stretch of rows holds every
    source in proportion, and the list is cut into ``shards`` stretches whose row counts
    differ by one at most. ``size`` is the UTF-8 bytes of the text (null: none) plus 8.

    A null source is a source of its own; null keys and null or empty texts are placed like
    any other. Ties of the fractional rank go to the source that sorts first, ties of the
    random order to the smaller key, then size and text checksum; rows equal in all of
    these are interchangeable. An empty table gives no rows. Columns other than the three
    named do not matter.
    """
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    narrow = written(docs.select(
        F.col(key).alias("key"),
        F.col(stratum).isNotNull().alias("named"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        (F.length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    ).withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.concat(F.lit("null"), F.col("text_crc32"))))))
     .withColumn("unit", F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / float(1 << 32)))
    total = narrow.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    rows = narrow.withColumn("bucket", F.floor(F.col("unit") * buckets))
    tie = [F.col("key"), F.col("size"), F.col("text_crc32")]
    rows = ranked(rows, ["named", "stratum"], "bucket", [F.col("draw"), *tie], "rank", "n").drop("bucket")
    fraction = (2 * F.col("rank") + 1) / (2 * F.col("n"))
    rows = rows.withColumn("fraction", fraction).withColumn(
        "bucket", F.floor(F.col("fraction") * buckets))
    rows = ranked(rows, [], "bucket", [F.col("fraction"), F.col("named"), F.col("stratum"), F.col("rank")], "place")
    shard = F.expr(f"cast((place * {shards}) div {max(1, total)} as int)")
    return rows.withColumn("shard", shard).select(
        F.col("key").alias(key),
        F.when(F.col("named"), F.col("stratum")).alias(stratum), "size", "text_crc32", "shard",
        (F.col("place") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")).alias("slot"),
    )


SQL = """
WITH steps AS (
  SELECT list(v ORDER BY n) AS t
  FROM (SELECT n, list_reduce(list_concat([n], range(8)),
               lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) AS r(n))
), narrow AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         list_transform(range(octet_length(encode(coalesce(text, '')))),
                        lambda i: CAST('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2) AS BIGINT)) AS bytes,
         md5('7:' || doc_id) AS draw
  FROM documents
), summed AS (
  SELECT doc_id, source, size, draw,
         xor(list_reduce(list_concat([4294967295], bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM narrow, steps
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) - 1 AS rank,
         count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
  FROM summed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * rank + 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source, rank) - 1 AS place FROM ranked
), cut AS (SELECT *, (place * 24) // total AS shard FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - (shard * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM cut
"""
