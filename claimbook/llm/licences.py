"""Licence scans: sparse TF-IDF cosine to templates, then inheritance down the directories.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names and the words of their usual notices.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
NOTICE = "(?i)licen[cs]|copyright|spdx|redistribution|permission to use|public domain"
PIECES = "[<>\\n\\r]+"
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
ACCEPTED = 0.75


def _weights(tokens: DataFrame, owner: str) -> DataFrame:
    return tokens.groupBy(owner, "token").agg(F.count(F.lit(1)).alias("tf"))


def _tokens(text: Column) -> Column:
    return F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def similarities(notices: DataFrame, text: str = "notice") -> DataFrame:
    """Best template of each distinct notice: ``notice, licence, cosine`` (4 decimals).

    Weights are tf * (ln((1 + T) / (1 + df)) + 1) with document frequencies over the T
    templates; words in no template weigh as those of df 0. Ties of the rounded cosine go to
    the licence that sorts first. Notices that share no word with a template are left out.
    """
    spark = notices.sparkSession
    templates = spark.createDataFrame(list(TEMPLATES), "licence string, body string")
    words = templates.select("licence", _tokens(F.col("body")).alias("token"))
    total = len(TEMPLATES)
    idf = words.distinct().groupBy("token").agg(
        (F.log((1.0 + total) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    template = _weights(words, "licence").join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = template.groupBy("licence").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_norm"))
    template = template.select("licence", "token", F.col("w").alias("template_w")).join(lengths, "licence")
    seen = _weights(notices.select(F.col(text).alias("notice")).distinct()
                    .select("notice", _tokens(F.col("notice")).alias("token")), "notice")
    seen = seen.join(idf, "token", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.log(F.lit(1.0 + total)) + 1.0))
    norms = seen.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = (
        seen.join(template, "token").groupBy("notice", "licence")
        .agg(F.sum(F.col("w") * F.col("template_w")).alias("dot"), F.first("template_norm").alias("template_norm"))
        .join(norms, "notice")
        .withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("template_norm")), 4))
    )
    lowest = scored.groupBy("notice").agg(F.max("cosine").alias("cosine"))
    return scored.join(lowest, ["notice", "cosine"]).groupBy("notice", "cosine").agg(F.min("licence").alias("licence"))


def scan(files: DataFrame, key: str = "page_id", path: str = "url", text: str = "html",
         accepted: float = ACCEPTED) -> DataFrame:
    """``key, directory, own_licence, cosine, licence, inherited_from`` of every file.

    A file's notices are the pieces of its whole text, cut at angle brackets and line ends,
    that speak of a licence. Its own licence is that of its most similar notice, if the
    cosine reaches ``accepted`` (ties: licence that sorts first). A directory carries the
    licence of the licensed file in it with the highest cosine (ties: smallest key, then
    licence). ``licence`` is the file's own or else that of the nearest directory on its
    path, itself included, that carries one; ``inherited_from`` names that directory.

    Scheme, query and fragment of a path do not count; one trailing slash does not open a
    directory. Null paths have no directory and inherit nothing; null or empty texts have no
    notice. Rows that repeat a key and path are one file. An empty table gives no rows;
    other columns do not matter.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(path), "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    parts = F.filter(F.split(bare, "/"), lambda p: p != "")
    rows = files.select(F.col(key).alias("key"), F.col(text).alias("text"), parts.alias("parts")).withColumn(
        "directory", F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), "/"))
    rows = rows.withColumn("directory", F.when(F.col("directory") != "", F.col("directory")))
    pieces = F.filter(F.split("text", PIECES), lambda p: p.rlike(NOTICE))
    noted = rows.filter(F.col("text").rlike(NOTICE)).select(
        "key", "directory", F.explode(F.transform(pieces, lambda p: F.trim(p))).alias("notice"))
    found = noted.join(similarities(noted), "notice").filter(F.col("cosine") >= accepted)
    own = found.groupBy("key", "directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("best")
    ).select("key", "directory", F.col("best.licence").alias("own_licence"), (-F.col("best.c")).alias("cosine"))
    carried = own.filter(F.col("directory").isNotNull()).groupBy("directory").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "key", F.col("own_licence").alias("l"))).alias("b")
    ).select(F.col("directory").alias("ancestor"), F.col("b.l").alias("carried"))
    names = F.split("directory", "/")
    climbs = rows.filter(F.col("directory").isNotNull()).select("directory").distinct().select(
        "directory", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(names)),
            lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(names, 1, i), "/").alias("ancestor")))).alias("up"))
    nearest = climbs.select("directory", "up.depth", "up.ancestor").join(carried, "ancestor").groupBy("directory").agg(
        F.max(F.struct("depth", "ancestor", "carried")).alias("n")
    ).select("directory", F.col("n.ancestor").alias("ancestor"), F.col("n.carried").alias("carried"))
    listed = rows.select("key", "directory").distinct()
    same = (F.col("l.key").eqNullSafe(F.col("o.key"))) & (F.col("l.directory").eqNullSafe(F.col("o.directory")))
    return (
        listed.alias("l").join(own.alias("o"), same, "left").select("l.key", "l.directory", "own_licence", "cosine")
        .join(nearest, "directory", "left")
        .select(
            F.col("key").alias(key), "directory", "own_licence", "cosine",
            F.coalesce("own_licence", "carried").alias("licence"),
            F.when(F.col("own_licence").isNull(), F.col("ancestor")).alias("inherited_from"),
        )
    )


SQL = f"""
WITH templates(licence, body) AS (VALUES {", ".join(f"('{n}', '{b}')" for n, b in TEMPLATES)}),
tw AS (SELECT licence, token, count(*) AS tf
       FROM (SELECT licence, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS token FROM templates) GROUP BY ALL),
idf AS (SELECT token, ln((1.0 + {len(TEMPLATES)}) / (1.0 + count(*))) + 1.0 AS idf FROM tw GROUP BY token),
tv AS (SELECT licence, token, tf * idf AS w FROM tw JOIN idf USING (token)),
tn AS (SELECT licence, sqrt(sum(w * w)) AS norm FROM tv GROUP BY licence),
parts AS (SELECT page_id, html, list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''),
                 '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '/'), lambda p: p <> '') AS p FROM pages),
files AS (SELECT page_id, html, nullif(array_to_string(p[1:greatest(len(p) - 1, 0)], '/'), '') AS directory FROM parts),
notes AS (SELECT page_id, directory, trim(piece, ' ') AS notice
          FROM (SELECT page_id, directory, unnest(regexp_split_to_array(html, '[<>\n\r]+')) AS piece FROM files)
          WHERE regexp_matches(piece, '{NOTICE}')),
nw AS (SELECT notice, token, count(*) AS tf
       FROM (SELECT notice, unnest(regexp_extract_all(lower(notice), '{TOKEN}')) AS token
             FROM (SELECT DISTINCT notice FROM notes)) GROUP BY ALL),
nv AS (SELECT notice, token, tf * coalesce(idf, ln(1.0 + {len(TEMPLATES)}) + 1.0) AS w FROM nw LEFT JOIN idf USING (token)),
nn AS (SELECT notice, sqrt(sum(w * w)) AS norm FROM nv GROUP BY notice),
sim AS (SELECT notice, licence, round(sum(nv.w * tv.w) / (any_value(nn.norm) * any_value(tn.norm)), 4) AS cosine
        FROM nv JOIN tv USING (token) JOIN nn USING (notice) JOIN tn USING (licence) GROUP BY notice, licence),
found AS (SELECT page_id, directory, licence, cosine FROM notes JOIN sim USING (notice) WHERE cosine >= {ACCEPTED}),
own AS (SELECT page_id, directory, licence AS own_licence, cosine FROM
        (SELECT *, row_number() OVER (PARTITION BY page_id, directory ORDER BY cosine DESC, licence) AS r FROM found) WHERE r = 1),
carried AS (SELECT directory AS ancestor, own_licence AS carried FROM
        (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, page_id, own_licence) AS r
         FROM own WHERE directory IS NOT NULL) WHERE r = 1),
dirs AS (SELECT DISTINCT directory, string_split(directory, '/') AS p FROM files WHERE directory IS NOT NULL),
climbs AS (SELECT directory, i AS depth, array_to_string(p[1:i], '/') AS ancestor
           FROM (SELECT directory, p, unnest(range(1, len(p) + 1)) AS i FROM dirs)),
nearest AS (SELECT directory, ancestor, carried FROM
        (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY depth DESC) AS r
         FROM climbs JOIN carried USING (ancestor)) WHERE r = 1)
SELECT f.page_id, f.directory, o.own_licence, o.cosine, coalesce(o.own_licence, n.carried) AS licence,
       CASE WHEN o.own_licence IS NULL THEN n.ancestor END AS inherited_from
FROM (SELECT DISTINCT page_id, directory FROM files) f
LEFT JOIN own o ON f.page_id IS NOT DISTINCT FROM o.page_id AND f.directory IS NOT DISTINCT FROM o.directory
LEFT JOIN nearest n ON n.directory = f.directory
"""
