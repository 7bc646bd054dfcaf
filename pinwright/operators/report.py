"""Run summaries. All are grouped counts with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(results: DataFrame) -> DataFrame:
    """Totals and passes per tier plus the overall line (tier is null).

    ``results(tier, status)`` with status PASS, FAIL or ERROR.
    """
    return (
        results.rollup("tier")
        .agg(F.count(F.lit(1)).alias("total"),
             F.count_if(F.col("status") == "PASS").alias("passed"),
             F.count_if(F.col("status") == "FAIL").alias("failed"),
             F.count_if(F.col("status") == "ERROR").alias("errors"))
        .withColumn("pass_rate", F.bround(F.col("passed") / F.greatest("total", F.lit(1)), 3))
    )


def accuracy_summary(results: DataFrame, by) -> DataFrame:
    """Times of fetched parts and share of (partly) right ones.

    ``results(status, seconds)``; parts that could not be fetched carry
    FETCH_FAIL or FETCH_ERROR.
    """
    timed = ~F.col("status").isin("FETCH_FAIL", "FETCH_ERROR")
    good = F.count_if(F.col("status") == "PASS") + F.count_if(F.col("status").startswith("PARTIAL"))
    fetched = F.count(F.lit(1)) - F.count_if(~timed)
    return results.groupBy(*by).agg(
        F.avg(F.when(timed, F.col("seconds"))).alias("avg_seconds"),
        F.min(F.when(timed, F.col("seconds"))).alias("min_seconds"),
        F.max(F.when(timed, F.col("seconds"))).alias("max_seconds"),
        fetched.alias("fetched"),
        F.when(fetched > 0, good / fetched * 100).otherwise(0.0).alias("accuracy"),
    )


def case_report(cases: DataFrame) -> DataFrame:
    """Per phase: passed, failed as expected, regressions.

    ``cases(phase, status, expected)``.
    """
    failed = F.col("status") != "PASS"
    return cases.groupBy("phase").agg(
        F.count_if(~failed).alias("passed"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("expected") == "FAIL")).alias("expected_fail"),
        F.count_if(failed & (F.col("expected") != "FAIL")).alias("regression"),
    )
