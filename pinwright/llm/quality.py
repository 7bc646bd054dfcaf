"""Quality rules: word and line counts, and compression bands.

Text that repeats itself compresses too well, and text without any regularity
(keys, encoded bytes, random strings) compresses too badly. How well plain prose
compresses depends on its length, so the limits are a table by length; a document
is judged whole and in fixed chunks, since a bad half is diluted in the whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from pinwright.llm.frames import annotate, texts

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits on compressed bytes / bytes: (from this many bytes on, least, most).

    They stand about a third below and above what plain prose of the length gives.
    ``chunk`` holds for full chunks of ``chunk_bytes``; a document fails if more than
    ``bad_share`` of its chunks are outside it. Shorter texts have no chunks.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (100, 0.35, 1.35), (200, 0.35, 1.05), (350, 0.33, 0.90), (500, 0.31, 0.84),
        (1000, 0.29, 0.76), (2000, 0.27, 0.70), (4000, 0.25, 0.66), (8000, 0.24, 0.64),
        (16000, 0.23, 0.62))
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.70)
    bad_share: float = 0.5
    level: int = 3


class _Numbering(dict):
    def __missing__(self, key):
        value = self[key] = len(self)
        return value


def _ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal pairs get equal numbers."""
    pairs = left * (int(right.max()) + 1) + right
    return np.unique(pairs, return_inverse=True)[1]


def repeated_words(docs_words: list[list[bytes]]) -> np.ndarray:
    """Per document, the words in windows of 8 that are found twice or more in it.

    Windows are numbered exactly by doubling: pairs of words, of pairs, of fours.
    """
    sizes = np.array([len(w) for w in docs_words], np.int64)
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(len(sizes), np.int64)
    number = _Numbering()
    ids = np.fromiter((number[w] for ws in docs_words for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    two = _ranks(ids[:-1], ids[1:])
    four = _ranks(two[:-2], two[2:])
    eight = _ranks(four[:-4], four[4:])
    starts = np.flatnonzero(doc[:total - WINDOW + 1] == doc[WINDOW - 1:])
    keys = _ranks(doc[starts], eight[starts]) if len(starts) else starts
    again = starts[np.bincount(keys)[keys] > 1] if len(starts) else starts
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(sizes))


def within_bands(raw: bytes, bands: Bands, zip_) -> bool:
    size = len(raw)
    if not size:
        return True
    ratio = len(zip_.compress(raw)) / size
    _, least, most = [b for b in bands.whole if size >= b[0]][-1]
    if not least <= ratio <= most:
        return False
    step = bands.chunk_bytes
    chunks = [len(zip_.compress(raw[i:i + step])) / step for i in range(0, size - step + 1, step)]
    bad = sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in chunks)
    return bad <= bands.bad_share * len(chunks)


def measure(column: pa.Array, bands: Bands) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, in_bands."""
    whole = texts(column)
    raws = [t.encode() for t in whole]
    words = [r.split() for r in raws]
    zip_ = zstandard.ZstdCompressor(level=bands.level)
    dup = []
    for r in raws:
        lines = [x for x in r.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return [
        np.array([len(w) for w in words], np.int64),
        np.array([len(t) - sum(map(r.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
                  for t, r in zip(whole, raws)], np.int64),
        np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raws], np.int64),
        np.array(dup, np.int64), repeated_words(words),
        np.array([within_bands(r, bands, zip_) for r in raws], bool)]


METRICS = [T.StructField(n, T.LongType()) for n in
           ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def quality_rules(docs: DataFrame, bands: Bands = Bands(), text: str = "text",
                  carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add the counts, ``base_failed`` (too few or too many repeated words) and ``kept``.

    One row per input row. A null or empty text has no words and is not kept; input
    columns named like a computed one are replaced.
    """
    carry = tuple(c for c in carry if c.lower() not in ("base_failed", "kept"))
    made = annotate(docs, lambda column: measure(column, bands),
                    [*METRICS, T.StructField("in_bands", T.BooleanType())], carry, text)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (made.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & F.col("in_bands")).drop("in_bands"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
