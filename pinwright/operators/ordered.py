"""Order-dependent building blocks that survive one very large group.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends a whole key to one task.
Here every group is cut into blocks by an expression that never decreases along
the order (``floor(pos / BLOCK)`` by default): the window runs inside a block,
and what must cross a block border (a running total, the last known value) is a
one-row-per-block aggregate computed with map-side combine. Groups that fit one
block contribute nothing to the carry table, so on ordinary data the carry join
is empty and adaptive execution turns it into a no-op broadcast.

First/last/top-k per key never use an unlimited window either: ``min_by`` /
``max_by`` aggregate partially before the shuffle, and ``row_number() <= k`` is
pruned per input partition by Spark's window group limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536          # positions per block
HOT_ROWS = 1_000_000    # rows from which a key counts as hot in ``positions``


def _order_struct(order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def block_of(pos: str, size: int = BLOCK) -> Column:
    return F.floor(F.col(pos) / F.lit(size))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the lowest order value per key (payload may differ)."""
    return _edge(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the highest order value per key."""
    return _edge(df, keys, order, F.max_by)


def _edge(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    grouped = df.groupBy(*keys).agg(pick(row, _order_struct(order)).alias("_row"))
    return grouped.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key; pruned before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                out: str, block: Column) -> DataFrame:
    """Inclusive running sum of ``value`` along ``order`` within each key."""
    return _running(df, keys, order, value, out, block, F.sum,
                    lambda a, b: a + F.coalesce(b, F.lit(0)))


def running_min(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                out: str, block: Column) -> DataFrame:
    """Inclusive running minimum of ``value`` along ``order`` within each key."""
    return _running(df, keys, order, value, out, block, F.min, F.least)


def _running(df, keys, order, value, out, block, agg, combine):
    keyed = df.withColumn("_blk", block).withColumn("_val", value)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = (
        keyed.groupBy(*keys, "_blk").agg(agg("_val").alias("_total"))
        .withColumn("_carry", agg("_total").over(blocks))
        .filter("_carry is not null").drop("_total")
    )
    return (
        keyed.withColumn(out, agg("_val").over(inner))
        .join(carry, [*keys, "_blk"], "left")
        .withColumn(out, combine(F.col(out), F.col("_carry")))
        .select(*[c for c in df.columns if c != out], out)
    )


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                out: str, block: Column) -> DataFrame:
    """Last non-null ``value`` strictly before each row along ``order``."""
    keyed = df.withColumn("_blk", block).withColumn("_val", value)
    inner = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = (
        keyed.groupBy(*keys, "_blk")
        .agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), _order_struct(order)))
             .alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(blocks))
        .filter("_carry is not null").drop("_tail")
    )
    return (
        keyed.withColumn("_in", F.last("_val", ignorenulls=True).over(inner))
        .join(carry, [*keys, "_blk"], "left")
        .withColumn(out, F.coalesce("_in", "_carry"))
        .select(*[c for c in df.columns if c != out], out)
    )


def rank_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
            block: Column) -> DataFrame:
    """1-based rank within the key, for a key that already has positions."""
    return running_sum(df, keys, order, F.lit(1), out, block).withColumn(
        out, F.col(out).cast("int"))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              blocks: Sequence[Column], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number rows 1..n along ``order``, splitting only the hot keys.

    ``blocks`` are coarse expressions that never decrease along ``order``. Keys
    above ``hot_rows`` are found by a column-pruned count; there are at most
    rows/hot_rows of them, which bounds the broadcast. All other keys stay in
    one block and need a single shuffle.
    """
    hot = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    )
    flagged = df.join(F.broadcast(hot), list(keys), "left")
    numbered = flagged.withColumn("_cut", F.when(F.col("_hot"), F.struct(*[
        b.alias(f"b{i}") for i, b in enumerate(blocks)])))
    inner = Window.partitionBy(*keys, "_cut").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(
        Window.unboundedPreceding, -1)
    carry = (
        numbered.filter("_hot").groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_carry", F.sum("_n").over(across))
        .filter("_carry is not null").drop("_n")
    )
    left = numbered.withColumn(out, F.row_number().over(inner))
    return (
        left.join(carry, [*keys, "_cut"], "left")
        .withColumn(out, (F.col(out) + F.coalesce("_carry", F.lit(0))).cast("int"))
        .select(*[c for c in df.columns if c != out], out)
    )
