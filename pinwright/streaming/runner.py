"""Running streams to completion and reading their results.

Results go to tables in the shared folder, one directory per batch
number, so a replayed batch overwrites its own output (exactly once) and a lost
executor costs only a recomputation. State is Spark's own, in its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    """Session settings the streams rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_updates(stream: DataFrame, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """Drain a stream and return the last emitted row per key."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "updates")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
     .foreachBatch(keep).trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(_with_batch(stream)).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def run_rows(stream: DataFrame) -> DataFrame:
    """Drain an append stream into a Parquet sink and return its rows."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "rows")
    (stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _with_batch(stream: DataFrame):
    return T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
