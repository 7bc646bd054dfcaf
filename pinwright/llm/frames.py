"""Shared helpers of the text operators: row-wise Arrow passes and small pieces of SQL.

A row-wise pass never holds more than one slice of about ``SLICE_BYTES`` of text,
or one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 2_000_000
#: The white space of the contracts; ``bytes.split`` and ``bytes.strip`` use just these.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def quoted(name: str) -> str:
    """A column name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def others(df: DataFrame, taken: Sequence[str]) -> list[str]:
    """Columns whose names do not clash with the computed ones (case aside)."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], n: str = "n",
             share: float = 1 / 1000) -> DataFrame:
    """Inner join on keys that are unique on the right, where ``n`` counts their left rows.

    Keys with more than ``share`` of all rows are sent by broadcast: 1 / share rows at
    most, whatever the data. No other key is large enough to hold up a task.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = right.where(F.col(n) > total * share).drop(n)
    if hot.isEmpty():
        return left.join(right.drop(n), keys)
    hot = F.broadcast(hot)
    rest = right.where(F.col(n) <= total * share).drop(n)
    return left.join(hot, keys).unionByName(
        left.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about SLICE_BYTES of text."""
    size = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def annotate(docs: DataFrame, fn: Callable[[pa.Array], list], fields: list[T.StructField],
             carry: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Add columns computed from one text column, row by row, in Arrow batches.

    ``fn`` maps an array of texts to one array per field. Only ``carry`` and the
    text cross over to Python; an input column named like a computed one is
    replaced by it.
    """
    carry = [c for c in carry if c.lower() not in {f.name.lower() for f in fields}]
    source = docs.select(*[F.col(quoted(c)) for c in carry],
                         *([] if text in carry else [F.col(quoted(text)).alias("_text")]))
    at = carry.index(text) if text in carry else len(carry)
    schema = T.StructType([source.schema[i] for i in range(len(carry))] + fields)
    arrow = to_arrow_schema(schema)
    width = len(carry)

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a)
                        for a in fn(part.column(at))]
                columns = [*part.columns[:width], *made]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty."""
    return [x or "" for x in column.to_pylist()]


class Memo(dict):
    """A bounded dictionary that makes what it lacks; long keys are not kept."""

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value
