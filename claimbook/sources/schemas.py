"""Explicit schemas of the delimited inputs (no inference pass over the data)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "DOUBLE": T.DoubleType(),
    "INT": T.IntegerType(),
    "STRING": T.StringType(),
}


def _schema(fields: str) -> T.StructType:
    """Schema from ``name TYPE, name TYPE``; needs no running session."""
    pairs = [field.strip().rsplit(" ", 1) for field in fields.split(",")]
    return T.StructType([T.StructField(n.strip("`"), _TYPES[kind]) for n, kind in pairs])


CLAIMS = _schema("hhld_id BIGINT, clm_dates DATE, pd_amt DOUBLE, aft_ind INT")

OUTCOMES = _schema(
    "hhld_id BIGINT, loss_amount DOUBLE, premium DOUBLE, loss_ratio DOUBLE, future_clm_ind INT"
)

ZIP_STATE = _schema("zipcode STRING, state STRING")

PREDICTORS = _schema(
    "hhld_id BIGINT, zipcode STRING, curnt_insurer STRING, inforce_ind INT, prior_bi DOUBLE,"
    "time_w_carr DOUBLE, credit_score DOUBLE, veh_cnt INT, veh_own_cnt INT, veh_lease_cnt INT,"
    "veh_lien_cnt INT, cnt_auto INT, cnt_mtrcyc INT, veh_w_coll_cnt INT, veh_w_comp_cnt INT,"
    "veh_w_ers_cnt INT, drvr_cnt INT, cnt_female INT, cnt_male INT, cnt_married INT,"
    "cnt_single INT, cnt_yth INT, hoh_married BOOLEAN, min_age DOUBLE, avg_age DOUBLE,"
    "max_age DOUBLE, hoh_age DOUBLE, min_mon_lic DOUBLE, avg_mon_lic DOUBLE,"
    "max_mon_lic DOUBLE, hoh_mon_lic DOUBLE, cnt_minr_viol INT, avg_minr_viol DOUBLE,"
    "cnt_majr_viol INT, avg_majr_viol DOUBLE, cnt_lic_susp INT, fire_ind INT,"
    "homeowner_ind INT, curnt_bi_low INT, curnt_bi_upp INT"
)

# Date columns of the loss runs and timestamp columns of the trips arrive as
# text with a clock part and are parsed by ``parse_dates``.
LOSS_RUN_PRIMARY = _schema(
    "claim_number STRING, claimant_name STRING, coverage STRING, period STRING,"
    "feature_identifier STRING, loss_date STRING, evaluation_date STRING,"
    "paid_loss DOUBLE, reserve_loss DOUBLE"
)

LOSS_RUN_EXCESS = _schema(
    "`Claim Number` STRING, `Loss Date` DATE, `Evaluation Date` DATE,"
    "`Paid Loss` DOUBLE, `Reserve Loss` DOUBLE, `Period` STRING"
)

TRIPS = _schema(
    "`a.trip_identifier` STRING, `a.driver_identifier` STRING, `a.vehicle_identifier` STRING,"
    "`a.trip_status` STRING, `b.risk_segment` STRING, `a.begintrip_timestamp_local` STRING,"
    "`a.endtrip_timestamp_local` STRING, `c.distance_miles_p3` DOUBLE, `c.trip_fare` DOUBLE"
)

# Text patterns of the inputs.
DATE_PATTERN = "M/d/yyyy"
DATE_TIME_PATTERN = "M/d/yyyy H:mm"
