"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two such points is never more than the Hamming distance of
the fingerprints. The 32 axes are dealt into ``bits + 2`` blocks: a distance of at
most ``bits`` leaves two blocks or more untouched, so two fingerprints that link lie
in the same grid cell of at least one pair of blocks. Rows meet by cell, pass the
Manhattan bound, and then the exact distance.

The counts are kept in unary code inside one long (0, 01 or 11 per segment), which
makes the Manhattan distance the bit count of an exclusive or.

A cell with more than ``cell_limit`` different fingerprints is not paired. All its fingerprints go
to a finer grid: with a block more, a distance of at most ``bits`` leaves a block more untouched, and
cells agree in three blocks of ``bits + 3``, then in four of ``bits + 4``, and so on. In the last grid every cell is paired,
so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pinwright.llm.components import connected_components
from pinwright.llm.frames import annotate, join_hot, texts
from pinwright.sources.shared import staged

#: Blocks that a cell holds, grid after grid.
LEVELS = (2, 3, 4, 5)
SEED = 42
EVEN = 0x5555555555555555
_hash = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: str, size: int = 4) -> int:
    """The fingerprint as a signed number; words are split at ASCII white space."""
    words = text.encode().lower().split()  # of bytes: A-Z only
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:max(1, len(words) - size + 1)].tolist()
    ends = ends[min(size, len(words)) - 1:].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        raw = b"".join(_hash(whole[a:b]) for a, b in zip(starts[at:at + (1 << 16)], ends[at:at + (1 << 16)]))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``fp`` to every row; null and empty texts have zero."""
    return annotate(docs, lambda column: [np.array([fingerprint(t) for t in texts(column)], np.int64)],
                    [T.StructField("fp", T.LongType())], carry, text)


def unary(fp: Column) -> Column:
    """Two-bit popcounts in unary code: low bit for one or more, high bit for two."""
    low = fp.bitwiseAND(F.lit(EVEN))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def block_masks(bits: int, untouched: int = 2) -> list[int]:
    """One mask over the unary code for each choice of ``untouched`` blocks of axes, as signed longs."""
    n = bits + untouched
    cuts = [round(i * 32 / n) for i in range(n + 1)]
    masks = [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(cuts, cuts[1:])]
    chosen = (sum(c) for c in combinations(masks, untouched))  # blocks do not overlap
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def in_cells(nodes: DataFrame, bits: int, untouched: int = 2) -> DataFrame:
    """(grid, cell, fp): each fingerprint in its cell of every grid."""
    code = unary(F.col("fp"))
    grids = F.array(*[F.struct(F.lit(k).cast("int").alias("grid"), code.bitwiseAND(F.lit(m)).alias("cell"))
                      for k, m in enumerate(block_masks(bits, untouched))])
    return nodes.select("fp", F.explode(grids).alias("g")).select("g.grid", "g.cell", "fp")


def np_unary(fp: np.ndarray) -> np.ndarray:
    fp = fp.view(np.uint64)
    low, high = fp & np.uint64(EVEN), (fp >> np.uint64(1)) & np.uint64(EVEN)
    return low | high | (low & high) << np.uint64(1)


def forest(group: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group, all that links of at most ``bits`` connect.

    ``group`` is sorted. Every pair of a group is tested; only a spanning set is kept.
    """
    code, raw = np_unary(fp), fp.view(np.uint64)
    left, right = [], []
    at, step = np.arange(len(fp) - 1), 1
    while True:
        at = at[at + step < len(fp)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(code[at] ^ code[at + step]) <= bits]
        near = near[np.bitwise_count(raw[near] ^ raw[near + step]) <= bits]
        left.append(near)
        right.append(near + step)
        step += 1
    if not left:
        return fp[:0], fp[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(fp))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own], fp[label[own]]


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def cell_links(cells: DataFrame, bits: int) -> DataFrame:
    """Links inside cells; the rows of a cell stand together, sorted."""
    arrow = to_arrow_schema(LINK)
    dealt = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)])
                    for h, c in zip(held, batch.columns)]
            border = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0))
            if len(border):
                stop = border[-1] + 1
                yield linked([h[:stop] for h in held])
                held = [h[stop:] for h in held]
        yield linked(held)

    def linked(rows: list[np.ndarray]) -> pa.RecordBatch:
        group = np.zeros(len(rows[0]), np.int64)
        group[1:] = np.cumsum((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
        a, b = forest(group, rows[2], bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)

    return dealt.mapInArrow(run, LINK)


def near_components(prints: DataFrame, bits: int = 4, cell_limit: int = 4096) -> DataFrame:
    """Add ``component_id`` to rows with ``doc_id`` and ``fp``.

    The component of a row is the smallest doc_id that links of at most ``bits``
    differing bits reach, itself included. Equal fingerprints link, zero as any other.
    Rows without an id share in links but give no id; a component without any has null.
    ``prints`` is read several times and should be a written table.
    """
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "fingerprints")
    links, left = [], nodes
    for untouched in LEVELS:
        cells = in_cells(left, bits, untouched)
        if untouched == LEVELS[-1]:
            links.append(cell_links(cells, bits))
            break
        full = staged(cells.groupBy("grid", "cell").agg(F.count("*").alias("n"))
                      .where(F.col("n") > cell_limit).drop("n"), "full-cells")
        links.append(cell_links(cells.join(full, ["grid", "cell"], "left_anti"), bits))
        if full.isEmpty():
            break
        left = staged(cells.join(full, ["grid", "cell"], "left_semi").select("fp").distinct(), "crowded")
    links = reduce(DataFrame.unionByName, links)
    roots = connected_components(links, "a", "b")
    placed = staged(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")), "placed")
    owners = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = staged(placed.join(owners, "root").select("fp", "component_id", "n"), "components")
    return join_hot(prints, placed, ["fp"])


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = staged(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")), "simhash")
    return near_components(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
