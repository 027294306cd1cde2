"""Dashboards: range filters, resolved carbon, daily trends and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days of the range keys; an unknown key counts as 30d.
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90}
FEW_POINTS = "More analytics will appear as additional documents are processed."


def date_range(df: DataFrame, key: str, now: Column, start: str | None = None, end: str | None = None, at: str = "saved_at") -> DataFrame:
    """DSH1: rows of the range; a custom end counts to the end of its day."""
    key = (key or "30d").strip().lower()
    lo, hi = None, now
    if key == "today":
        lo = F.date_trunc("day", now)
    elif key == "custom":
        lo = F.to_timestamp(F.lit(start)) if start else None
        if end:
            hi = F.to_timestamp(F.lit(end)) + F.expr("interval 1 day") - F.expr("interval 1 microsecond")
        elif lo is None:
            lo = now - F.expr("interval 30 days")
    else:
        lo = now - F.expr(f"interval {RANGE_DAYS.get(key, 30)} days")
    df = df.filter(F.col(at).isNotNull() & (F.col(at) <= hi))
    return df.filter(F.col(at) >= lo) if lo is not None else df


def resolve_carbon(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """DSH2: a document's actual, baseline, saved and efficiency, from its job where its own are missing.

    docs and jobs: doc_id, chunks, actual, baseline, saved, efficiency; jobs also status. Documents
    without chunks or any figure, and those whose job failed, go.
    """
    names = ("chunks", "actual", "baseline", "saved", "efficiency")
    j = jobs.select("doc_id", F.col("status"), *[F.col(c).alias(f"job_{c}") for c in names])
    lacking = (F.coalesce("chunks", F.lit(0)) <= 0) | (F.coalesce("actual", F.lit(0.0)) <= 0) | (F.coalesce("baseline", F.lit(0.0)) <= 0)
    failed = F.coalesce(F.lower("status").isin("error", "failed", "cancelled", "canceled"), F.lit(False))
    df = docs.join(j, "doc_id", "left").filter(~(lacking & failed))
    or_job = lambda c, empty: F.when(lacking & empty, F.coalesce(f"job_{c}", c, F.lit(0))).otherwise(F.coalesce(c, F.lit(0))).cast("double")
    df = df.select(
        *[c for c in docs.columns if c not in names],
        F.when(lacking, F.coalesce(F.nullif("job_chunks", F.lit(0)), "chunks", F.lit(0))).otherwise(F.col("chunks")).alias("chunks"),
        or_job("actual", F.coalesce("actual", F.lit(0.0)) <= 0).alias("actual"),
        or_job("baseline", F.coalesce("baseline", F.lit(0.0)) <= 0).alias("baseline"),
        or_job("saved", F.coalesce("saved", F.lit(0.0)) == 0).alias("saved"),
        or_job("efficiency", F.coalesce("efficiency", F.lit(0.0)) == 0).alias("efficiency"),
    )
    df = df.filter("chunks > 0 and not (actual <= 0 and baseline <= 0 and saved = 0)")
    df = df.withColumn("baseline", F.when((F.col("baseline") <= 0) & (F.col("saved") > 0) & (F.col("efficiency") > 0), F.col("saved") / (F.col("efficiency") / 100)).otherwise(F.col("baseline")))
    df = df.withColumn("actual", F.when((F.col("actual") <= 0) & (F.col("baseline") > 0), F.greatest(F.lit(0.0), F.col("baseline") - F.greatest(F.lit(0.0), F.col("saved")))).otherwise(F.col("actual")))
    df = df.filter("baseline > 0").withColumn("saved", F.greatest(F.lit(0.0), F.col("baseline") - F.col("actual")))
    return df.withColumn("efficiency", F.least(F.lit(100.0), F.try_divide(F.col("saved"), F.col("baseline")) * 100))


def _sums(intensity: float):
    return (
        F.count("*").alias("docs"), F.sum("saved").alias("saved"), F.sum("baseline").alias("baseline"), F.sum("actual").alias("actual"),
        F.avg("efficiency").alias("efficiency"), (F.sum("actual") / intensity).alias("energy_kwh"),
    )


def daily_trend(resolved: DataFrame, intensity: float = 700.0, at: str = "saved_at") -> DataFrame:
    """DSH3: an owner's carbon and energy by day."""
    return resolved.groupBy("owner_id", F.to_date(at).alias("day")).agg(*_sums(intensity))


def dashboard_totals(resolved: DataFrame, intensity: float = 700.0, at: str = "saved_at") -> DataFrame:
    """DSH4: daily rows and owner totals in one pass, with a note where there are few points."""
    df = resolved.withColumn("day", F.to_date(at)).rollup("owner_id", "day").agg(*_sums(intensity), F.grouping("day").alias("is_total"), F.countDistinct("day").alias("points"))
    df = df.filter("owner_id is not null")
    return df.withColumn("note", F.when((F.col("is_total") == 1) & ((F.col("docs") <= 1) | (F.col("points") < 2)), F.lit(FEW_POINTS)))
