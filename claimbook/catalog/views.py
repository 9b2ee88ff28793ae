"""Insurance-shaped views over the star-schema test tables.

Each view exists twice: as a DataFrame and as SQL text for the check engine.
They read whole tables; nulls and categories follow from integer remainders.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimbook.sources.tables import read_table

AS_OF = dt.date(2001, 1, 1)
VALUATION_YEAR = 2002


_LONG, _INT, _DOUBLE, _TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
_STAMP = T.TimestampNTZType()

# Declared types of the tables read here: no footer is opened to plan a query.
SCHEMAS = {
    "nation": {"n_nationkey": _INT, "n_name": _TEXT, "n_regionkey": _INT},
    "customer": {
        "c_custkey": _LONG,
        "c_name": _TEXT,
        "c_nationkey": _INT,
        "c_acctbal": _DOUBLE,
        "c_mktsegment": _TEXT,
    },
    "orders": {
        "o_orderkey": _LONG,
        "o_custkey": _LONG,
        "o_orderstatus": _TEXT,
        "o_totalprice": _DOUBLE,
        "o_orderdate": _STAMP,
        "o_orderpriority": _TEXT,
    },
    "lineitem": {
        "l_orderkey": _LONG,
        "l_partkey": _LONG,
        "l_suppkey": _LONG,
        "l_linenumber": _INT,
        "l_quantity": _DOUBLE,
        "l_extendedprice": _DOUBLE,
        "l_discount": _DOUBLE,
        "l_tax": _DOUBLE,
        "l_returnflag": _TEXT,
        "l_linestatus": _TEXT,
        "l_shipdate": _STAMP,
    },
    "events": {
        "event_id": _LONG,
        "ts": _STAMP,
        "user_id": _LONG,
        "event_type": _TEXT,
        "value": _DOUBLE,
        "props": _TEXT,
    },
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, kind) for n, kind in SCHEMAS[name].items()])
    return read_table(spark, f"{sf_dir}/{name}.parquet", schema)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("hhld_id"),
        F.col("o_orderdate").cast("date").alias("clm_dates"),
        F.col("o_totalprice").alias("pd_amt"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("aft_ind"),
    )


def _pick(index: Column, values) -> Column:
    chain = F.when(index == 0, values[0])
    for i, v in enumerate(values[1:], start=1):
        chain = chain.when(index == i, v)
    return chain


def _part(by: int, whole: Column) -> Column:
    return (F.floor(F.col("k") / F.lit(float(by))) % (whole + 1)).cast("int")


def predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    missing = F.col("c_mktsegment") == "BUILDING"
    staged = (
        base.withColumns(
            {
                "drvr_cnt": (k % 4 + 1).cast("int"),
                "veh_cnt": (k * 7 % 5 + 1).cast("int"),
                "avg_age": F.lit(16.0) + (k * 7919 % 700) / F.lit(10.0),
                "cnt_minr_viol": (k * 11 % 3).cast("int"),
                "cnt_majr_viol": F.when(k % 17 == 0, k % 2 + 1).otherwise(0).cast("int"),
            }
        )
        .withColumns(
            {
                "cnt_female": _part(7, F.col("drvr_cnt")),
                "cnt_married": _part(19, F.col("drvr_cnt")),
                "cnt_auto": _part(3, F.col("veh_cnt")),
                "veh_own_cnt": _part(5, F.col("veh_cnt")),
                "veh_w_coll_cnt": _part(2, F.col("veh_cnt")),
                "veh_w_comp_cnt": _part(13, F.col("veh_cnt")),
                "veh_w_ers_cnt": _part(17, F.col("veh_cnt")),
                "min_age": F.col("avg_age") - k % 3,
                "max_age": F.col("avg_age") + k % 4,
                "hoh_age": F.col("avg_age") + k % 5 - 2,
            }
        )
        .withColumn("veh_lease_cnt", _part(11, F.col("veh_cnt") - F.col("veh_own_cnt")))
    )
    lien = F.col("veh_cnt") - F.col("veh_own_cnt") - F.col("veh_lease_cnt")
    months = {
        f"{who}_mon_lic": F.greatest(F.col(f"{who}_age") - 16, F.lit(0.0)) * 12 + k % mod
        for who, mod in (("min", 6), ("avg", 7), ("max", 8), ("hoh", 9))
    }
    limit = _pick(k * 3 % 4, (25, 50, 100, 250))
    return staged.select(
        k.alias("hhld_id"),
        (F.col("c_nationkey") * 37 + 7).cast("string").alias("zipcode"),
        F.when(missing, "MISSING")
        .when(F.col("c_mktsegment") == "FURNITURE", "OTHER")
        .otherwise(F.col("c_mktsegment"))
        .alias("curnt_insurer"),
        F.when(missing, 0).otherwise(1).alias("inforce_ind"),
        F.when(~missing, _pick(k % 4, (25000.0, 50000.0, 100000.0, 250000.0))).alias("prior_bi"),
        F.when(~missing, (k % 11) / F.lit(2.0)).alias("time_w_carr"),
        F.when(k % 22 != 0, F.lit(300.0) + (F.col("c_acctbal") + 1000) / 20).alias("credit_score"),
        "veh_cnt",
        "veh_own_cnt",
        "veh_lease_cnt",
        F.when(k % 10 == 0, lien).alias("veh_lien_cnt"),
        "cnt_auto",
        (F.col("veh_cnt") - F.col("cnt_auto")).alias("cnt_mtrcyc"),
        "veh_w_coll_cnt",
        "veh_w_comp_cnt",
        "veh_w_ers_cnt",
        "drvr_cnt",
        "cnt_female",
        (F.col("drvr_cnt") - F.col("cnt_female")).alias("cnt_male"),
        "cnt_married",
        (F.col("drvr_cnt") - F.col("cnt_married")).alias("cnt_single"),
        F.when(k % 3 == 0, F.floor(k / F.lit(17.0)) % 2).otherwise(0).cast("int").alias("cnt_yth"),
        (F.col("cnt_married") > 0).alias("hoh_married"),
        "min_age",
        "avg_age",
        "max_age",
        "hoh_age",
        *[m.alias(n) for n, m in months.items()],
        "cnt_minr_viol",
        (F.col("cnt_minr_viol") / F.col("drvr_cnt")).alias("avg_minr_viol"),
        "cnt_majr_viol",
        (F.col("cnt_majr_viol") / F.col("drvr_cnt")).alias("avg_majr_viol"),
        F.when(k % 29 == 0, 1).otherwise(0).alias("cnt_lic_susp"),
        F.when(k % 7 < 2, 1).otherwise(0).alias("fire_ind"),
        F.when(k % 9 < 5, 1).otherwise(0).alias("homeowner_ind"),
        limit.alias("curnt_bi_low"),
        limit.alias("curnt_bi_upp"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = (
        table(spark, sf_dir, "orders")
        .filter(
            (F.col("o_orderdate") >= F.lit(AS_OF))
            & (F.col("o_orderpriority") == "1-URGENT")
            & (F.col("o_orderstatus") == "F")
        )
        .groupBy("o_custkey")
        .agg(F.sum("o_totalprice").alias("total"))
    )
    loss = F.coalesce(F.col("total") / 100, F.lit(0.0))
    premium = (F.lit(100) + F.col("c_custkey") % 150).cast("double")
    return (
        table(spark, sf_dir, "customer")
        .select("c_custkey")
        .join(later, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("hhld_id"),
            loss.alias("loss_amount"),
            premium.alias("premium"),
            (loss / premium).alias("loss_ratio"),
            F.when(F.col("total").isNotNull(), 1).otherwise(0).alias("future_clm_ind"),
        )
    )


def zip_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_regionkey") != 2)
        .select(
            F.lpad((F.col("n_nationkey") * 37 + 7).cast("string"), 5, "0").alias("zipcode"),
            F.col("n_name").alias("state"),
        )
    )


def _loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate"
    )
    dates = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return items.join(dates, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("line"),
        F.col("o_orderdate").cast("date").alias("loss_date"),
        F.col("l_shipdate").cast("date").alias("shipped"),
        F.least(F.lit(1000000.0), F.col("l_extendedprice") * 10).alias("paid_loss"),
        (F.col("l_extendedprice") * 10 * F.col("l_discount")).alias("open_loss"),
    )


def _evaluated() -> Column:
    days = F.abs(F.datediff("shipped", "loss_date")) % 1700
    return F.date_add("loss_date", days)


def _reserve() -> Column:
    return F.least(F.lit(1000000.0) - F.col("paid_loss"), F.col("open_loss"))


def loss_run_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _loss_rows(spark, sf_dir).select(
        k.cast("string").alias("claim_number"),
        F.concat(F.lit("claimant "), (F.col("line") % 2).cast("string")).alias("claimant_name"),
        _pick(k % 3, ("BI", "PD", "UMBI")).alias("coverage"),
        F.when(k % 5 == 0, "En Route To Pickup").otherwise("Transporting Rider").alias("period"),
        F.col("line").cast("string").alias("feature_identifier"),
        "loss_date",
        _evaluated().alias("evaluation_date"),
        "paid_loss",
        _reserve().alias("reserve_loss"),
    )


def loss_run_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _loss_rows(spark, sf_dir).select(
        k.cast("string").alias("Claim Number"),
        F.col("loss_date").alias("Loss Date"),
        F.when(k % 50 == 0, F.col("shipped")).otherwise(_evaluated()).alias("Evaluation Date"),
        F.col("paid_loss").alias("Paid Loss"),
        _reserve().alias("Reserve Loss"),
        F.when(k % 7 < 4, "Transporting Rider")
        .when(k % 7 < 6, "En Route To Pickup")
        .otherwise("Available")
        .alias("Period"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    begin = F.col("ts") - F.make_ym_interval((F.lit(24) + e % 5).cast("int"), F.lit(0))
    length = F.make_dt_interval(mins=(F.floor("value") % 60).cast("int"))
    error = F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .withColumn("begin", begin)
        .select(
            e.cast("string").alias("a.trip_identifier"),
            F.col("user_id").cast("string").alias("a.driver_identifier"),
            (F.col("user_id") % 37).cast("string").alias("a.vehicle_identifier"),
            F.when(error, "canceled").otherwise("completed").alias("a.trip_status"),
            F.when(F.col("event_type").isin("view", "click"), "Eats")
            .when((F.col("event_type") == "signup") & (e % 10 == 0), F.lit("\\N"))
            .otherwise("P2P")
            .alias("b.risk_segment"),
            F.col("begin").alias("a.begintrip_timestamp_local"),
            (F.col("begin") + length).alias("a.endtrip_timestamp_local"),
            F.when(~(error & (e % 4 == 0)), F.col("value") / 10).alias("c.distance_miles_p3"),
            (F.col("value") / 5).alias("c.trip_fare"),
        )
    )


# The same views as SQL text. Order matters: later ones may use earlier ones.
SQL_VIEWS = {
    "claims": """
        SELECT o_custkey AS hhld_id, CAST(o_orderdate AS DATE) AS clm_dates,
               o_totalprice AS pd_amt,
               CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS aft_ind
        FROM orders""",
    "staged": """
        SELECT *, CAST(k // 11 % (veh_cnt - veh_own_cnt + 1) AS INTEGER) AS veh_lease_cnt
        FROM (SELECT *,
                CAST(k // 7 % (drvr_cnt + 1) AS INTEGER) AS cnt_female,
                CAST(k // 19 % (drvr_cnt + 1) AS INTEGER) AS cnt_married,
                CAST(k // 3 % (veh_cnt + 1) AS INTEGER) AS cnt_auto,
                CAST(k // 5 % (veh_cnt + 1) AS INTEGER) AS veh_own_cnt,
                CAST(k // 2 % (veh_cnt + 1) AS INTEGER) AS veh_w_coll_cnt,
                CAST(k // 13 % (veh_cnt + 1) AS INTEGER) AS veh_w_comp_cnt,
                CAST(k // 17 % (veh_cnt + 1) AS INTEGER) AS veh_w_ers_cnt,
                avg_age - k % 3 AS min_age, avg_age + k % 4 AS max_age,
                avg_age + k % 5 - 2 AS hoh_age
              FROM (SELECT c_custkey AS k, c_nationkey, c_acctbal, c_mktsegment,
                      CAST(c_custkey % 4 + 1 AS INTEGER) AS drvr_cnt,
                      CAST(c_custkey * 7 % 5 + 1 AS INTEGER) AS veh_cnt,
                      CAST(16 AS DOUBLE) + (c_custkey * 7919 % 700) / CAST(10 AS DOUBLE) AS avg_age,
                      CAST(c_custkey * 11 % 3 AS INTEGER) AS cnt_minr_viol,
                      CAST(CASE WHEN c_custkey % 17 = 0 THEN c_custkey % 2 + 1 ELSE 0 END
                           AS INTEGER) AS cnt_majr_viol
                    FROM customer))""",
    "predictors": """
        SELECT k AS hhld_id, CAST(c_nationkey * 37 + 7 AS VARCHAR) AS zipcode,
          CASE c_mktsegment WHEN 'BUILDING' THEN 'MISSING' WHEN 'FURNITURE' THEN 'OTHER'
               ELSE c_mktsegment END AS curnt_insurer,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS inforce_ind,
          CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN k % 4 = 0 THEN 25000
               WHEN k % 4 = 1 THEN 50000 WHEN k % 4 = 2 THEN 100000 ELSE 250000 END
               AS DOUBLE) AS prior_bi,
          CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
               ELSE (k % 11) / CAST(2 AS DOUBLE) END AS time_w_carr,
          CASE WHEN k % 22 <> 0 THEN 300 + (c_acctbal + 1000) / 20 END AS credit_score,
          veh_cnt, veh_own_cnt, veh_lease_cnt,
          CASE WHEN k % 10 = 0 THEN veh_cnt - veh_own_cnt - veh_lease_cnt END AS veh_lien_cnt,
          cnt_auto, veh_cnt - cnt_auto AS cnt_mtrcyc,
          veh_w_coll_cnt, veh_w_comp_cnt, veh_w_ers_cnt,
          drvr_cnt, cnt_female, drvr_cnt - cnt_female AS cnt_male,
          cnt_married, drvr_cnt - cnt_married AS cnt_single,
          CAST(CASE WHEN k % 3 = 0 THEN k // 17 % 2 ELSE 0 END AS INTEGER) AS cnt_yth,
          cnt_married > 0 AS hoh_married,
          min_age, avg_age, max_age, hoh_age,
          greatest(min_age - 16, 0) * 12 + k % 6 AS min_mon_lic,
          greatest(avg_age - 16, 0) * 12 + k % 7 AS avg_mon_lic,
          greatest(max_age - 16, 0) * 12 + k % 8 AS max_mon_lic,
          greatest(hoh_age - 16, 0) * 12 + k % 9 AS hoh_mon_lic,
          cnt_minr_viol, CAST(cnt_minr_viol AS DOUBLE) / drvr_cnt AS avg_minr_viol,
          cnt_majr_viol, CAST(cnt_majr_viol AS DOUBLE) / drvr_cnt AS avg_majr_viol,
          CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS cnt_lic_susp,
          CASE WHEN k % 7 < 2 THEN 1 ELSE 0 END AS fire_ind,
          CASE WHEN k % 9 < 5 THEN 1 ELSE 0 END AS homeowner_ind,
          CASE k * 3 % 4 WHEN 0 THEN 25 WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 250 END AS curnt_bi_low,
          CASE k * 3 % 4 WHEN 0 THEN 25 WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 250 END AS curnt_bi_upp
        FROM staged""",
    "outcomes": """
        SELECT c_custkey AS hhld_id, coalesce(total / 100, 0.0) AS loss_amount,
               CAST(100 + c_custkey % 150 AS DOUBLE) AS premium,
               coalesce(total / 100, 0.0) / (100 + c_custkey % 150) AS loss_ratio,
               CASE WHEN total IS NOT NULL THEN 1 ELSE 0 END AS future_clm_ind
        FROM customer LEFT JOIN (
            SELECT o_custkey, sum(o_totalprice) AS total FROM orders
            WHERE o_orderdate >= DATE '2001-01-01' AND o_orderpriority = '1-URGENT'
              AND o_orderstatus = 'F' GROUP BY o_custkey) ON c_custkey = o_custkey""",
    "zip_state": """
        SELECT lpad(CAST(n_nationkey * 37 + 7 AS VARCHAR), 5, '0') AS zipcode, n_name AS state
        FROM nation WHERE n_regionkey <> 2""",
    "loss_rows": """
        SELECT k, line, loss_date, shipped, paid_loss,
               least(CAST(1000000 AS DOUBLE) - paid_loss, open_loss) AS reserve_loss,
               loss_date + CAST(abs(date_diff('day', loss_date, shipped)) % 1700 AS INTEGER)
                 AS evaluated
        FROM (SELECT l_orderkey AS k, l_linenumber AS line,
                CAST(o_orderdate AS DATE) AS loss_date, CAST(l_shipdate AS DATE) AS shipped,
                least(CAST(1000000 AS DOUBLE), l_extendedprice * 10) AS paid_loss,
                l_extendedprice * 10 * l_discount AS open_loss
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "loss_run_primary": """
        SELECT CAST(k AS VARCHAR) AS claim_number,
               'claimant ' || CAST(line % 2 AS VARCHAR) AS claimant_name,
               CASE k % 3 WHEN 0 THEN 'BI' WHEN 1 THEN 'PD' ELSE 'UMBI' END AS coverage,
               CASE WHEN k % 5 = 0 THEN 'En Route To Pickup' ELSE 'Transporting Rider' END AS period,
               CAST(line AS VARCHAR) AS feature_identifier, loss_date,
               evaluated AS evaluation_date, paid_loss, reserve_loss
        FROM loss_rows""",
    "loss_run_excess": """
        SELECT CAST(k AS VARCHAR) AS "Claim Number", loss_date AS "Loss Date",
               CASE WHEN k % 50 = 0 THEN shipped ELSE evaluated END AS "Evaluation Date",
               paid_loss AS "Paid Loss", reserve_loss AS "Reserve Loss",
               CASE WHEN k % 7 < 4 THEN 'Transporting Rider'
                    WHEN k % 7 < 6 THEN 'En Route To Pickup' ELSE 'Available' END AS "Period"
        FROM loss_rows""",
    "trips": """
        SELECT CAST(event_id AS VARCHAR) AS "a.trip_identifier",
               CAST(user_id AS VARCHAR) AS "a.driver_identifier",
               CAST(user_id % 37 AS VARCHAR) AS "a.vehicle_identifier",
               CASE WHEN event_type = 'error' THEN 'canceled' ELSE 'completed' END AS "a.trip_status",
               CASE WHEN event_type IN ('view', 'click') THEN 'Eats'
                    WHEN event_type = 'signup' AND event_id % 10 = 0 THEN '\\N'
                    ELSE 'P2P' END AS "b.risk_segment",
               began AS "a.begintrip_timestamp_local",
               began + to_minutes(CAST(floor(value) AS BIGINT) % 60) AS "a.endtrip_timestamp_local",
               CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN NULL
                    ELSE value / 10 END AS "c.distance_miles_p3",
               value / 5 AS "c.trip_fare"
        FROM (SELECT *, ts - to_years(CAST(24 + event_id % 5 AS INTEGER)) AS began FROM events)""",
    # Shared derivations used by several checks.
    "valued_primary": """
        SELECT *, CASE WHEN maturity <= 3 THEN '3m' WHEN maturity <= 6 THEN '6m'
                       WHEN maturity <= 9 THEN '9m' WHEN maturity <= 12 THEN '1y'
                       WHEN maturity <= 24 THEN '2y' WHEN maturity <= 36 THEN '3y'
                       WHEN maturity <= 48 THEN '4y' ELSE '4y+' END AS maturity_bucket
        FROM (SELECT *, paid_loss + reserve_loss AS incurred_loss,
                least(greatest(paid_loss + reserve_loss - 250000, 0), 1250000) AS ceded_loss,
                CASE WHEN paid_loss + reserve_loss > 250000 THEN 1 ELSE 0 END AS is_ceded,
                round_even(date_diff('day', loss_date, evaluation_date) / CAST(30 AS DOUBLE), 4)
                  AS maturity,
                CAST(year(loss_date) AS INTEGER) AS accident_year
              FROM loss_run_primary)""",
    "flagged_primary": """
        SELECT *, CASE WHEN evaluation_date = max(evaluation_date) OVER w THEN 1 ELSE 0 END AS is_latest,
                  CASE WHEN evaluation_date = min(evaluation_date) OVER w THEN 1 ELSE 0 END AS is_first
        FROM valued_primary
        WINDOW w AS (PARTITION BY claim_number, claimant_name, coverage, loss_date, period)""",
    "excess_named": """
        SELECT "Claim Number" AS claim_number, "Loss Date" AS loss_date,
               "Evaluation Date" AS evaluation_date, "Paid Loss" AS paid_loss,
               "Reserve Loss" AS reserve_loss, "Period" AS period
        FROM loss_run_excess""",
    "valued_excess": """
        SELECT *, CASE WHEN maturity <= 3 THEN '3m' WHEN maturity <= 6 THEN '6m'
                       WHEN maturity <= 9 THEN '9m' WHEN maturity <= 12 THEN '1y'
                       WHEN maturity <= 24 THEN '2y' WHEN maturity <= 36 THEN '3y'
                       WHEN maturity <= 48 THEN '4y' ELSE '4y+' END AS maturity_bucket
        FROM (SELECT *, paid_loss + reserve_loss AS incurred_loss,
                least(paid_loss + reserve_loss, 500000) AS ceded_loss,
                CASE WHEN paid_loss + reserve_loss > 0 THEN 1 ELSE 0 END AS is_ceded,
                round_even(date_diff('day', loss_date, evaluation_date) / CAST(30 AS DOUBLE), 4)
                  AS maturity,
                CAST(year(loss_date) AS INTEGER) AS accident_year
              FROM excess_named)""",
    "flagged_excess": """
        SELECT *, CASE WHEN evaluation_date = max(evaluation_date) OVER w THEN 1 ELSE 0 END AS is_latest,
                  CASE WHEN evaluation_date = min(evaluation_date) OVER w THEN 1 ELSE 0 END AS is_first
        FROM valued_excess WINDOW w AS (PARTITION BY claim_number, loss_date, period)""",
    "moved_excess": """
        SELECT e.* REPLACE (coalesce(fixed, e.loss_date) AS loss_date)
        FROM excess_named e LEFT JOIN (
          SELECT claim_number, min(CAST(first_at - INTERVAL 5 MONTH AS DATE)) AS fixed FROM (
            SELECT claim_number, loss_date, period, min(evaluation_date) AS first_at FROM excess_named
            GROUP BY claim_number, loss_date, period HAVING min(evaluation_date) < loss_date)
          GROUP BY claim_number) f ON e.claim_number = f.claim_number""",
    "valued_moved": """
        SELECT *, CASE WHEN maturity <= 3 THEN '3m' WHEN maturity <= 6 THEN '6m'
                       WHEN maturity <= 9 THEN '9m' WHEN maturity <= 12 THEN '1y'
                       WHEN maturity <= 24 THEN '2y' WHEN maturity <= 36 THEN '3y'
                       WHEN maturity <= 48 THEN '4y' ELSE '4y+' END AS maturity_bucket
        FROM (SELECT *, paid_loss + reserve_loss AS incurred_loss,
                least(paid_loss + reserve_loss, 500000) AS ceded_loss,
                CASE WHEN paid_loss + reserve_loss > 0 THEN 1 ELSE 0 END AS is_ceded,
                round_even(date_diff('day', loss_date, evaluation_date) / CAST(30 AS DOUBLE), 4)
                  AS maturity,
                CAST(year(loss_date) AS INTEGER) AS accident_year
              FROM moved_excess)""",
    "flagged_moved": """
        SELECT *, CASE WHEN evaluation_date = max(evaluation_date) OVER w THEN 1 ELSE 0 END AS is_latest,
                  CASE WHEN evaluation_date = min(evaluation_date) OVER w THEN 1 ELSE 0 END AS is_first
        FROM valued_moved WINDOW w AS (PARTITION BY claim_number, loss_date, period)""",
    "trips_clean": """
        SELECT "a.trip_identifier" || '|' || "a.driver_identifier" || '|' || "a.vehicle_identifier"
                 AS trip_key,
               "a.trip_status" AS trip_status, "b.risk_segment" AS risk_segment,
               "a.begintrip_timestamp_local" AS start_time, "a.endtrip_timestamp_local" AS end_time,
               "c.distance_miles_p3" AS trip_distance_mi, "c.trip_fare" AS trip_fare,
               date_diff('second', "a.begintrip_timestamp_local", "a.endtrip_timestamp_local")
                 / CAST(60 AS DOUBLE) AS trip_minutes
        FROM trips WHERE "c.distance_miles_p3" IS NOT NULL AND "a.trip_status" <> 'canceled'
          AND "b.risk_segment" <> '\\N'""",
    "filled": """
        SELECT * REPLACE (
            coalesce(veh_lien_cnt, veh_cnt - (veh_own_cnt + veh_lease_cnt)) AS veh_lien_cnt,
            coalesce(time_w_carr, 0) AS time_w_carr, coalesce(prior_bi, 0) AS prior_bi,
            round_even(coalesce(credit_score, (SELECT avg(credit_score) FROM predictors)), 0)
              AS credit_score)
        FROM predictors""",
    "clean": """
        SELECT * EXCLUDE (zipcode, curnt_insurer, curnt_bi_low, curnt_bi_upp, hoh_married),
               curnt_bi_low * 1000 AS curnt_bi, CAST(hoh_married AS INTEGER) AS hoh_married_ind,
               CASE curnt_insurer WHEN 'MISSING' THEN 'Missing' WHEN 'OTHER' THEN 'Minor_Insurer'
                    ELSE 'Major_Insurer' END AS prior_insurer_bucket,
               CASE WHEN curnt_insurer NOT IN ('MISSING', 'OTHER') THEN 1 ELSE 0 END
                 AS prior_insurer_major,
               CASE WHEN curnt_insurer = 'OTHER' THEN 1 ELSE 0 END AS prior_insurer_minor,
               CASE WHEN curnt_insurer = 'MISSING' THEN 1 ELSE 0 END AS prior_insurer_missing
        FROM filled""",
    "paid_bucketed": """
        SELECT hhld_id, pd_amt, CASE WHEN aft_ind = 1 THEN '_f' ELSE '_nf' END AS fault,
               CASE WHEN 2001 - year(clm_dates) <= 1 THEN '< 1 yr'
                    WHEN 2001 - year(clm_dates) <= 3 THEN '1-3 yrs'
                    WHEN 2001 - year(clm_dates) <= 5 THEN '3-5 yrs' ELSE '5+ yrs' END AS bucket
        FROM claims WHERE clm_dates < DATE '2001-01-01'""",
}


def _needs(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def with_views(body: str) -> str:
    """Check SQL with the views it uses (and those they use) as WITH clauses."""
    body = body.strip()
    used, text = [], body
    for name in reversed(SQL_VIEWS):
        if _needs(text, name):
            used.append(name)
            text += SQL_VIEWS[name]
    if not used:
        return body
    clauses = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in reversed(used))
    if body.startswith("WITH "):
        return f"WITH {clauses},\n{body.removeprefix('WITH ')}"
    return f"WITH {clauses}\n{body}"
