"""First and latest valuations kept as a small state that new runs are merged into.

A state has one row per claim: the date of its latest and of its first valuation, the sums of
the rows at each of the two, and its row count. Two states are merged claim by claim, so a new
run is reduced to its own state and joined to the stored one; old runs are never read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENDS = ("latest", "first")


def snapshot_state(
    df: DataFrame, keys: Sequence[str], at: str, measures: Mapping[str, Column]
) -> DataFrame:
    """State of one run: ``keys``, ``latest_at``, ``first_at``, their sums, and ``n_rows``.

    ``measures`` maps a name to the row expression to sum; the sums are called
    ``latest_<name>`` and ``first_<name>``. Rows without a date are left out; rows tied on a
    date are summed. A missing key is a key.
    """
    per_date = (
        df.filter(F.col(at).isNotNull())
        .groupBy(*keys, F.col(at).alias("_at"))
        .agg(*[F.sum(e).alias(f"_m{i}") for i, e in enumerate(measures.values())], F.count(F.lit(1)).alias("_n"))
    )
    return per_date.groupBy(*keys).agg(
        F.max("_at").alias("latest_at"),
        F.min("_at").alias("first_at"),
        *[F.max_by(f"_m{i}", "_at").alias(f"latest_{m}") for i, m in enumerate(measures)],
        *[F.min_by(f"_m{i}", "_at").alias(f"first_{m}") for i, m in enumerate(measures)],
        F.sum("_n").alias("n_rows"),
    )


def _sum(a: Column, b: Column) -> Column:
    """Sum that skips a missing part, missing if both are."""
    return F.coalesce(a + b, a, b)


def merge_states(stored: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of the rows behind either state, one join of one row per claim.

    At the same date the sums of both count. Both states must have the same columns.
    """
    other = fresh.select(*[F.col(c).alias("_b_" + c) for c in stored.columns])
    match = reduce(and_, [F.col(k).eqNullSafe(F.col("_b_" + k)) for k in keys])
    joined = stored.withColumn("_a", F.lit(True)).join(other.withColumn("_b", F.lit(True)), match, "full")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    out = {k: F.when(in_a, F.col(k)).otherwise(F.col("_b_" + k)) for k in keys}
    for end, ahead in zip(ENDS, (lambda x, y: x > y, lambda x, y: x < y), strict=True):
        at = f"{end}_at"
        a, b = F.col(at), F.col("_b_" + at)
        only_a, only_b = ~in_b | (in_a & ahead(a, b)), ~in_a | (in_b & ahead(b, a))
        for c in [c for c in stored.columns if c.startswith(end + "_")]:
            mine, theirs = F.col(c), F.col("_b_" + c)
            tied = mine if c == at else _sum(mine, theirs)
            out[c] = F.when(only_a, mine).when(only_b, theirs).otherwise(tied)
    out["n_rows"] = F.coalesce("n_rows", F.lit(0)) + F.coalesce("_b_n_rows", F.lit(0))
    return joined.select(*[out[c].alias(c) for c in stored.columns])


def state_totals(
    state: DataFrame, keys: Sequence[str], at: str, measures: Sequence[str], which: str = "latest"
) -> DataFrame:
    """The table that ``totals_at`` gives for all rows behind the state."""
    if which not in ENDS:
        raise ValueError("which is 'latest' or 'first'")
    return state.select(
        *keys, F.col(f"{which}_at").alias(at), *[F.col(f"{which}_{m}").alias(m) for m in measures]
    )


class SnapshotStore:
    """A state in a folder, and the names of the runs it holds.

    Each run added makes a new version of the state; it counts once the run's name is in the
    log, so a failed attempt leaves the last version in force and is simply repeated. A run that
    is in the log is refused. Earlier versions stay until ``forget_old`` removes them. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], at: str, measures: Mapping[str, Column]):
        self.spark, self.path, self.keys, self.at = spark, path.rstrip("/"), list(keys), at
        self.measures = dict(measures)

    def _place(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def runs(self) -> list[tuple[int, str]]:
        """Version and name of every run added, in order; one short row per run."""
        files, place = self._place("log")
        if not files.exists(place):
            return []
        log = self.spark.read.schema("version int, run string").parquet(f"{self.path}/log")
        return sorted((r["version"], r["run"]) for r in log.collect())

    def state(self) -> DataFrame | None:
        """The state of all runs added so far, None before the first."""
        known = self.runs()
        return self.spark.read.parquet(f"{self.path}/v{known[-1][0]}") if known else None

    def add(self, run: str, rows: DataFrame) -> DataFrame:
        """Merge the rows of a run and return the new state."""
        known = self.runs()
        if run in {name for _, name in known}:
            raise ValueError(f"run {run!r} has been added before")
        fresh = snapshot_state(rows, self.keys, self.at, self.measures)
        version = known[-1][0] + 1 if known else 1
        merged = merge_states(self.state(), fresh, self.keys) if known else fresh
        merged.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        entry = self.spark.createDataFrame([(version, run)], "version int, run string")
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return self.state()

    def totals(self, which: str = "latest") -> DataFrame:
        """Sums per claim at its latest (or first) valuation over all runs added."""
        state = self.state()
        if state is None:
            raise ValueError("no run has been added")
        return state_totals(state, self.keys, self.at, list(self.measures), which)

    def forget_old(self) -> None:
        """Delete all versions but the one in force."""
        for version, _ in self.runs()[:-1]:
            files, place = self._place(f"v{version}")
            files.delete(place, True)
