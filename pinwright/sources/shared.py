"""Where intermediate tables go: the folder the cluster shares."""

from __future__ import annotations

import io
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"
#: Spark removes a query's shuffle files when it ends, not whenever the driver next
#: collects garbage; a written table never needs them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_given: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder set in ``spark.checkpoint.dir``.

    Where it is unset, a session with a local master uses its warehouse, which all of
    its threads see. On a cluster that is an error: executors could not see each other's files.
    """
    base = spark.conf.get(FOLDER, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {FOLDER} to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staged"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    _given.append(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")
    return _given[-1]


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Queries that run inside drop their shuffle files when they end."""
    before = spark.conf.get(CLEANUP, None)
    if before is None:  # an older Spark
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage where an intermediate result is read several times; the
    files outlive any executor.
    """
    folder = shared_folder(df.sparkSession, label)
    with shuffle_cleanup(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of one frame that ``staged`` gave, after all that is made of it has been written."""
    folders = {path.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for path in df.inputFiles()}
    for folder in [f for f in _given if f.split(":", 1)[-1].lstrip("/") in folders]:
        _given.remove(folder)
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Delete all that this process has staged; no frame that reads it is usable after."""
    while _given:
        _delete(spark, _given.pop())


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, wherever the session was started.

    A zip of it goes to the shared folder once per Spark context, as with ``--py-files``.
    """
    from pyarrow.fs import FileSystem

    context = spark.sparkContext
    if getattr(context, "_pinwright_shipped", False):
        return
    package, held = Path(__file__).parents[1], io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    disk, folder = FileSystem.from_uri(shared_root(spark).replace("file:///", "/").replace("file:/", "/"))
    disk.create_dir(folder, recursive=True)
    name = f"{package.name}-{uuid.uuid4().hex}.zip"
    with disk.open_output_stream(f"{folder}/{name}") as out:
        out.write(held.getvalue())
    context.addPyFile(f"{shared_root(spark)}/{name}")
    context._pinwright_shipped = True
