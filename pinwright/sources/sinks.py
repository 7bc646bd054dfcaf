"""Writing results: library upsert, dated status rows, file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered


def upserted(current: DataFrame, new: DataFrame) -> DataFrame:
    """Library after replacing symbols of the same name and appending the rest.

    Of several new symbols of one name the last one, by ``ord``, stays.
    """
    kept = current.join(new.select("lib", "name").distinct(), ["lib", "name"], "left_anti")
    return kept.unionByName(ordered.last_per_key(new, ["lib", "name"], ["ord"]).select(kept.columns))


def upsert_library(spark: SparkSession, folder: str, new: DataFrame) -> None:
    """Apply an upsert to a Parquet library partitioned by ``lib``.

    Only the libraries touched are rewritten (dynamic partition overwrite). The
    merged rows are written beside the library first, since a table cannot be
    overwritten while it is read.
    """
    staged = f"{folder}/staged"
    touched = new.select("lib").distinct()
    current = spark.read.parquet(f"{folder}/symbols").join(touched, "lib", "left_semi")
    upserted(current, new).write.mode("overwrite").parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("lib").parquet(f"{folder}/symbols")


def status_rows(diff: DataFrame, run_date) -> DataFrame:
    """Status per part with the match rate in percent, to one decimal."""
    return diff.select("doc_id", F.col("status").alias("test_status"),
                       F.bround(F.col("match_rate") * 100, 1).alias("match_percent"),
                       F.lit(run_date).cast("date").alias("run_date"))


def append_status(diff: DataFrame, folder: str, run_date) -> None:
    status_rows(diff, run_date).write.mode("append").partitionBy("run_date").parquet(folder)


def write_files(files: DataFrame, folder: str, order: str | None = None, between: str = "\n") -> None:
    """Write each row (name, content) as one file of its own name to a shared folder.

    Names may hold folders; content is text or bytes. Spark's own text sink names its files itself. A file is written under a passing name
    in its own folder and then moved, so a repeated task replaces whole files only. With ``order``, a column, the rows of one name are one file in that
    order, with ``between`` between them; they are written one after another and no file is held whole.
    """
    import uuid

    import pyarrow as pa
    import pyarrow.fs  # noqa: F401

    def run(batches):
        disk, base = pa.fs.FileSystem.from_uri(folder)
        disk.create_dir(base, recursive=True)
        name = out = passing = None
        known = {""}  # folders that this task has made

        def done():
            if out is not None:
                out.close()
                disk.move(passing, f"{base}/{name}")

        for batch in batches:
            for key, value in zip(*batch.columns):
                key, content = key.as_py(), value.as_py()
                if order is None or key != name:
                    done()
                    inside, slash, _ = key.rpartition("/")
                    if inside not in known:
                        disk.create_dir(f"{base}/{inside}", recursive=True)
                        known.add(inside)
                    name, passing = key, f"{base}/{inside}{slash}.{uuid.uuid4().hex}"
                    out = disk.open_output_stream(passing)
                else:
                    out.write(between.encode())
                out.write(content.encode() if isinstance(content, str) else content or b"")
            yield batch.select([0])
        done()

    rows = files if order is None else files.repartition("name").sortWithinPartitions("name", order)
    rows.select("name", "content").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Paths, names and sizes of written files, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
                        F.col("length").alias("size_bytes"))
