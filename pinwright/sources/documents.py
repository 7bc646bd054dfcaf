"""Documents and ground truth as input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lookups as L

TRUTH_SCHEMA = (
    "pn string, family string, tier int, manufacturer string, "
    "pins array<struct<number:string, name:string, type:string>>"
)


def scan_documents(spark: SparkSession, folder: str, glob: str = "*.pdf", magic: str = "%PDF-") -> DataFrame:
    """Stored documents of admissible size and header: (path, length, content).

    The size test is pushed to the source, so files of other sizes are not opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return admit_documents(files, magic).select("path", "length", "content")


def admit_documents(files: DataFrame, magic: str = "%PDF-") -> DataFrame:
    """Files of 1,000 bytes to 50 MB whose content starts with the header.

    ``files(length, content)`` with binary content.
    """
    return files.filter(F.col("length").between(L.MIN_DOCUMENT_BYTES, L.MAX_DOCUMENT_BYTES)).filter(
        F.substring("content", 1, len(magic)) == F.lit(magic.encode()))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth parts from JSON, one object per line, with a fixed schema.

    Lines are split over tasks. A damaged line is set aside by its text, it does not end the others; a part
    without a number is none.
    """
    rows = spark.read.schema(f"{TRUTH_SCHEMA}, _damaged string").option("columnNameOfCorruptRecord", "_damaged").json(path)
    return rows.filter("_damaged IS NULL AND pn IS NOT NULL").drop("_damaged")


def select_truth(parts: DataFrame, tier: int | None = None, number: str | None = None) -> DataFrame:
    """Pin rows of the chosen ground-truth parts; a missing tier counts as 1."""
    d = parts.withColumn("tier", F.coalesce("tier", F.lit(1)))
    if tier is not None:
        d = d.filter(F.col("tier") == tier)
    if number:
        d = d.filter(F.contains(F.upper("pn"), F.lit(number.upper())))
    return d.select("pn", "family", "tier", F.posexplode("pins").alias("pin_pos", "_p")).select(
        "pn", "family", "tier", "pin_pos", "_p.number", "_p.name", "_p.type")


def linked_truth(components: DataFrame, pins: DataFrame) -> DataFrame:
    """Ground truth from two linked tables, one row per (part, pin).

    ``components(id, pn, family, pin_count)``, ``pins(component_ids, pin_id,
    number, name, type)``. Parts without number or pins drop out; a missing pin
    count is the number of linked pins.
    """
    links = pins.withColumn("id", F.explode("component_ids")).drop("component_ids")
    named = components.filter("pn <> ''")
    rows = named.join(links, "id")
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(counts, "id").select(
        "id", "pn", "family", F.coalesce("pin_count", "_n").alias("expected_pins"), "pin_id",
        F.coalesce("number", F.lit("")).alias("number"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("type", F.lit("unspecified")).alias("type"))
