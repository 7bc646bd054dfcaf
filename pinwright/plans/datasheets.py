"""Whole flows composed from the operators; each is one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import ordered
from ..operators import pins as P
from ..operators import tables as T
from ..operators import text as X
from ..sources.shared import staged


def pins_from_tables(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pins of the best table group per document, checked and with an EP row.

    ``wanted(doc_id, expected_count, package, base)``.
    """
    groups = T.table_groups(T.layouts(T.detect_headers(cells)))
    rows = staged(T.read_pins(cells, groups), "pins")
    best = staged(T.best_pins(rows, T.score_groups(rows, groups, wanted)), "best")
    kept = P.quality_gate(best)
    return P.add_exposed_pad(kept, ["table_seq", "layout", "row_idx", "num_pos"],
                             F.struct(F.col("table_seq"), F.col("layout"),
                                      F.floor(F.col("row_idx") / ordered.BLOCK)))


def identify_packages(docs: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Package of a document: by the part number's suffix, else from its text."""
    own = docs.withColumn("_s", X.package_of_suffix(F.col("part_number")))
    found = X.package_of_text(X.mentioned_packages(own.filter("_s is null")), hints)
    text = found.select("doc_id", F.struct("name", "pin_count").alias("_t"))
    return own.join(text, "doc_id", "left").select(
        "doc_id",
        F.coalesce("_s.name", "_t.name").alias("name"),
        F.coalesce("_s.pin_count", "_t.pin_count").alias("pin_count"),
        F.when(F.col("_s").isNotNull(), "suffix").when(F.col("_t").isNotNull(), "text").alias("source"),
    ).filter("name is not null")


def accuracy_run(extracted: DataFrame, truth: DataFrame, tiers: DataFrame) -> DataFrame:
    """Verdict per document with its tier; documents without pins are errors."""
    diff = P.pin_diff(extracted, truth)
    return tiers.join(diff, "doc_id", "left").withColumn(
        "status", F.when(F.coalesce("extracted_count", F.lit(0)) == 0,
                         R.result_status(F.lit(0))).otherwise(F.col("status")))
