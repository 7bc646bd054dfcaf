"""Line de-duplication against levelled sorted runs of line hashes.

Batches come in ascending document ids. A batch looks its line hashes up in the runs
of the batches before it (a merge join against sorted, bucketed tables), drops the
lines found there or in an earlier document of its own, and leaves the hashes that
were new as another run. Whenever a level holds ``fanout`` runs they are merged into
one run of the next level, so a hash is rewritten once per level and a batch reads
``fanout`` runs per level at most.

A line is known by 128 bits of its key. Only pairs of document and hash are
shuffled; the texts meet the hashes to drop once, at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pinwright.llm.frames import ASCII_SPACE, join_hot, others, quoted, slices
from pinwright.sources.shared import shared_folder, staged

MIN_CHARS = 10
KEY = ["h1", "h2"]
_STRIP = ASCII_SPACE.encode()


def line_hash(line: bytes, least: int = MIN_CHARS) -> tuple[int, int] | None:
    """The hash of a line's key; None if the key is too short to count."""
    key = line.strip(_STRIP).lower()  # of bytes: A-Z only
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    whole = xxhash.xxh3_128_intdigest(key)
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def line_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, h1, h2): the distinct counting line keys of each document with an id."""
    source = docs.where("doc_id IS NOT NULL").select("doc_id", F.col(quoted(text)).alias("_text"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", *KEY)])
    arrow = to_arrow_schema(schema)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(key, *h) for key, t in zip(*(c.to_pylist() for c in part.columns))
                        for h in {line_hash(x) for x in (t or "").encode().split(b"\n")} - {None}]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=arrow)

    return source.mapInArrow(run, schema)


@dataclass
class LineRuns:
    """Runs of known line hashes: tables bucketed and sorted by hash, by level."""

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self):
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (hashes.select(*KEY).repartition(self.buckets, *KEY).write
         .bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .option("path", shared_folder(self.spark, "line-run")).saveAsTable(name))
        return name

    def add(self, hashes: DataFrame) -> None:
        """Add a run at level 0 and merge levels that are full."""
        run, level = self.write(hashes), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for name in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(name))
            run = self.write(merged)  # hashes of a level are disjoint: nothing to combine
            self.levels[level] = []
            level += 1

    def new(self, hashes: DataFrame) -> DataFrame:
        """The rows whose hash is in no run."""
        for level in self.levels:
            for name in level:
                hashes = hashes.join(self.spark.table(name), KEY, "left_anti")
        return hashes


def duplicate_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, text: str = "text") -> DataFrame:
    """(doc_id, h1, h2): lines to drop, those that a smaller document id holds too.

    ``batches`` cuts the documents into ranges of about equal size; it steers the
    work of one step, never the result.
    """
    spark = docs.sparkSession
    bounds = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000)).first()[0]
    batch = sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in bounds or []), F.lit(0))
    folder = shared_folder(spark, "line-hashes")
    line_hashes(docs, text).withColumn("batch", batch).write.partitionBy("batch").parquet(folder)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", *KEY)]
                          + [T.StructField("batch", T.IntegerType())])
    hashes = spark.read.schema(schema).parquet(folder)
    runs = LineRuns(spark, fanout)
    dropped = []
    for step in range(batches):
        mine = hashes.where(F.col("batch") == step).drop("batch")
        firsts = staged(mine.groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")), "line-firsts")
        new = staged(runs.new(firsts), "line-new")
        runs.add(new)
        # Found in a run: no owner here. Otherwise only keys of several documents matter.
        known = firsts.join(new, KEY, "left_anti").select(*KEY, F.lit(None).cast("long").alias("owner"), "n")
        repeated = staged(known.unionByName(new.where("n > 1")), "line-repeated")
        hits = join_hot(mine, repeated, KEY)
        dropped.append(staged(hits.where("owner IS NULL OR doc_id <> owner").drop("owner"), "line-drops"))
    out = dropped[0]
    for more in dropped[1:]:
        out = out.unionByName(more)
    return out


def drop_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, text: str = "text") -> DataFrame:
    """Replace the text of each row by its lines that stay; add n_lines and n_dropped.

    Keys of at least 10 code points held by several documents stay only in the one
    with the smallest id, there in all their lines; rows of one id are one document.
    Rows without an id neither lose lines nor cost others theirs. A null or empty
    text is one empty line. Input columns named n_lines or n_dropped are replaced.
    """
    drops = (duplicate_lines(docs, batches, fanout, text).groupBy("doc_id")
             .agg(F.collect_set(F.struct(*KEY)).alias("_drop")))
    kept = others(docs, (text, "n_lines", "n_dropped", "_drop"))
    source = docs.select(*[F.col(quoted(c)) for c in kept], F.col(quoted(text)).alias("_text"))
    source = source.join(drops, "doc_id", "left").select(*[F.col(quoted(c)) for c in kept], "_text", "_drop")
    width = len(kept)
    schema = T.StructType([*source.schema[:width], T.StructField(text, T.StringType()),
                           T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(rows) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, width):
                out = []
                for whole, drop in zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist()):
                    lines = (whole or "").encode().split(b"\n")
                    gone = {(d["h1"], d["h2"]) for d in drop or ()}
                    stay = [x for x in lines if line_hash(x) not in gone] if gone else lines
                    out.append((b"\n".join(stay).decode(), len(lines), len(lines) - len(stay)))
                made = [pa.array(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip([*part.columns[:width], *made], arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: A first holder keeps its lines, so a line goes if some smaller id has the key too.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, lower_ascii AS k FROM (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE owner < doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
                       FILTER (WHERE owner IS NULL OR owner >= doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN owners USING (k) GROUP BY doc_id
"""
