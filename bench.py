"""Headline queries, timed one after another; prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local cores, BENCH_SHARED the folder for
staged tables. Each query runs to the no-op sink, so the whole result is computed and
nothing is collected. Besides seconds it records the rows read, the bytes shuffled and
whether the last plan holds a nested-loop join.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pinwright.plans.registry import QUERIES  # noqa: E402
from pinwright.sources.shared import release  # noqa: E402

HEADLINE = [
    "pin_diff", "run_summary", "symbol_search", "symbol_top_matches", "symbol_match",
    "footprint_match", "datasheet_pins", "table_pins", "header_detection", "package_table",
    "text_pins", "package_candidates", "context_packing", "pin_type_inference", "suffix_split",
    "source_candidates", "merged_pins", "pin_mapping", "grid_layout", "bounding_box",
    "symbol_entries", "quota_stream", "job_fold_stream",
]


def totals(spark: SparkSession) -> tuple[int, int]:
    """Rows read and bytes shuffled so far, from Spark's own stage records."""
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
    every = [stages.apply(i) for i in range(stages.size())]
    return sum(x.inputRecords() for x in every), sum(x.shuffleWriteBytes() for x in every)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pinwright-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED", os.path.abspath("spark-warehouse/bench")))
        .config("spark.ui.retainedStages", "100000")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf}/part.parquet").write.format("noop").mode("overwrite").save()
    seconds, plans = {}, {}
    for name in names:
        rows, moved = totals(spark)
        start = time.perf_counter()
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        after = totals(spark)
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans[name] = {"rows_read": after[0] - rows, "shuffle_mb": round((after[1] - moved) / 1e6, 2),
                       "nested_loop": "NestedLoop" in plan or "Cartesian" in plan}
        release(spark)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "plans": plans, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
