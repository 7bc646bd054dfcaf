"""How far the sources of a language lie apart, through count-level bitmaps.

Every kept term of a language has an id: a slice, and a place in it. For each group
(language and source) and each count that occurs in it, a bitset holds the terms with
just that count there. The terms that have count a in one group and count b in another
are the AND of two bitsets, and their number is its popcount: a joint cell. A term's share
depends on its count alone, so a divergence is the sum over the cells of their size
times one value of f. Terms that a group lacks have no bitset: the cells with a zero are
the complement, a level's size less its positive cells. Sums are kept as two longs each.

Ids run by falling frequency inside a slice, so rare terms, which have few levels, share
words of 64, and the many levels of frequent terms meet inside a few words only.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pinwright.llm.frames import quoted, slices, texts
from pinwright.sources.shared import staged

#: Bytes of terms: A-Z lower-cased, a-z and all bytes of other characters; the rest parts them.
TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms and sources that meet in one task, on average; both only shape the work.
SLICE_TERMS, SOURCE_BLOCK = 2048, 32
#: Different terms that a task holds before it sends its counts on.
HELD = 600_000
WHOLE = 1_000_000_000

COUNTED = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")]
                       + [T.StructField(c, T.LongType()) for c in ("n", "n_docs")])


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences and rows of ``docs`` with the term.

    Null texts, languages and sources are empty. Every group has a row with an empty term
    and zeros as well, so that one without terms is not lost. Each row of ``docs`` counts as a document.
    """
    named = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    arrow = to_arrow_schema(COUNTED)

    def emitted(held: dict):
        for (lang, source), (n, n_docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), 1 << 14):
                some = terms[at:at + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()),
                     pa.array([n[t] for t in some], pa.int64()), pa.array([n_docs[t] for t in some], pa.int64())], schema=arrow)

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            for part in slices(batch, 2):
                for lang, source, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2))):
                    if (lang, source) not in held:
                        held[lang, source] = Counter({b"": 0}), Counter({b"": 0})
                    n, n_docs = held[lang, source]
                    terms = whole.encode().translate(TERM).split()
                    n.update(terms)
                    n_docs.update(set(terms))
                if sum(len(n) for n, _ in held.values()) > HELD:
                    yield from emitted(held)
                    held = {}
        yield from emitted(held)

    found = docs.select(*named, F.col(quoted(text)).alias("_text")).mapInArrow(run, COUNTED)
    # A task's counts are sums already, so they are dealt out as they are.
    return found.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: str, total: str, kinds: str) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kinds)), exact: in longs where the product fits one."""
    more, under = F.col(count) + 1, F.greatest(F.col(total) + F.col(kinds), F.lit(1))
    wide = F.lit(WHOLE).cast("decimal(10,0)") * more.cast("decimal(19,0)")
    return F.lit(1) + F.when(more < 9 * WHOLE, F.call_function("div", F.lit(WHOLE) * more, under)).otherwise(
        F.call_function("div", wide, under.cast("decimal(20,0)")))


def f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def bitsets(kept: DataFrame) -> DataFrame:
    """(lang, slice, word, source, n, bits): a bit for each term of the word with count n there."""
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    return (kept.groupBy("lang", "slice", F.expr("place div 64").alias("word"), "source", "n")
            .agg(F.bit_or(bit).alias("bits")))


PART = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "item")]
                    + [T.StructField(c, T.LongType()) for c in ("high", "low")])


def halves(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sums of runs of longs as two longs each, so that none overflows."""
    return [np.add.reduceat(values >> 32, first), np.add.reduceat(values & 0xFFFFFFFF, first)]


def joint_cells(levels: DataFrame, blocks: int) -> DataFrame:
    """(lang, source, item, high, low): what the positive joint cells of a slice add to a pair's sum.

    A cell (a, b) of n terms adds n (f(a, b) - f(a, 0) - f(0, b) + f(0, 0)): its own f, less what its terms
    have as part of a level against zero. The sources are dealt into ``blocks``, and a task takes one slice of two
    blocks, so that it stays bounded for any number of sources.
    """
    arrow = to_arrow_schema(PART)

    def change(p, q, p0, q0):
        return (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0

    def cells(key, table):
        low, high = key[2].as_py(), key[3].as_py()
        names, of = np.unique(np.asarray(table["source"].to_pylist(), object), return_inverse=True)
        block, word, p, p0 = (table[c].to_numpy() for c in ("block", "word", "p", "p0"))
        bits = table["bits"].to_numpy().view(np.uint64)
        order, found = np.argsort(word, kind="stable"), []
        for rows in np.split(order, np.flatnonzero(np.diff(word[order])) + 1):
            left, right = (rows[block[rows] == x] for x in (low, high))
            both = np.bitwise_count(bits[left][:, None] & bits[right][None, :])
            if low == high:
                both[of[left][:, None] >= of[right][None, :]] = 0
            i, j = np.nonzero(both)
            x, y, n = left[i], right[j], both[i, j].astype(np.int64)
            found.append((of[x] * len(names) + of[y], n * change(p[x], p[y], p0[x], p0[y]), n * change(p[y], p[x], p0[y], p0[x])))
        pair, there, back = map(np.concatenate, zip(*found))
        order = np.argsort(pair, kind="stable")
        pair, there, back = pair[order], there[order], back[order]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        x, y = (pa.array(names[k], pa.string()) for k in np.divmod(pair[first], len(names)))
        made = [pa.Table.from_arrays([pa.array([key[0].as_py()] * len(first), pa.string()), g, h, *map(pa.array, halves(v, first))],
                                     schema=arrow) for g, h, v in ((x, y, there), (y, x, back)) if len(first)]
        return pa.concat_tables([arrow.empty_table(), *made])

    block = F.pmod(F.xxhash64("source"), F.lit(blocks))
    met = (levels.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
           .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")))
    return (met.select("lang", "slice", "low", "high", "block", "word", "source", "bits", "p", "p0")
            .groupBy("lang", "slice", "low", "high").applyInArrow(cells, PART))


def source_divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of ``lang`` and ``source``.

    Part ``pair`` has each other source of the language with the sum of f over all kept terms;
    part ``term`` the ``top`` terms whose share is above the language's, with their f. Ranks run
    from 1, by falling value, then by item in byte order. Kept are the terms in at least ``least_docs`` rows
    of their language; a row counts as a document, repeated or without an id. Nulls count as empty, very long
    texts as any other, and an empty table gives no rows. Other columns of ``docs`` are not looked at.
    """
    counted = staged(term_counts(docs, text), "term-counts")
    group = ["lang", "source"]
    real = counted.where("term <> ''")
    kept = staged(real.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("n_docs").alias("n_docs"))
                  .where(F.col("n_docs") >= least_docs).drop("n_docs"), "kept-terms")
    size = max(1, -(-kept.count() // SLICE_TERMS))
    by_count = Window.partitionBy("lang", "slice").orderBy(F.desc("total"), "term")
    ids = (kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(size)))
           .withColumn("place", F.row_number().over(by_count) - 1))
    rows = staged(real.drop("n_docs").join(ids, ["lang", "term"]), "kept-counts")

    whole = kept.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("kinds"))
    sums = rows.groupBy(*group).agg(F.sum("n").alias("group_total"))
    zero = {"group_total": 0, "lang_total": 0, "kinds": 0}
    groups = staged(counted.where("term = ''").select(*group).join(sums, group, "left").join(whole, "lang", "left")
                    .fillna(zero).withColumn("none", F.lit(0)).withColumn("p0", share("none", "group_total", "kinds")).drop("none"), "groups")

    levels = staged(bitsets(rows).join(groups, group).select(
        *group, "slice", "word", "n", "bits", "p0", share("n", "group_total", "kinds").alias("p")), "count-levels")
    sizes = staged(levels.groupBy(*group, "p", "p0").agg(F.sum(F.bit_count("bits")).alias("size")), "level-sizes")
    blocks = max(1, -(-groups.select("source").distinct().count() // SOURCE_BLOCK))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select(*group, "p0", "kinds").join(other, "lang").where("source <> item")

    def added(rows: DataFrame, n: str, value: Column) -> DataFrame:
        whole = F.col(n) * value
        return rows.select(*group, "item", F.shiftright(whole, 32).alias("high"), whole.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))

    ours = added(pairs.drop("p0").join(sizes, group), "size", f(p, q0) - f(p0, q0))
    their_sizes = sizes.select("lang", F.col("source").alias("item"), "size", F.col("p").alias("q"), F.col("p0").alias("q0"))
    theirs = added(pairs.drop("q0").join(their_sizes, ["lang", "item"]), "size", f(p0, q) - f(p0, q0))
    summed = (joint_cells(levels, blocks).unionByName(ours).unionByName(theirs).unionByName(added(pairs, "kinds", f(p0, q0)))
              .groupBy(*group, "item").agg((F.sum("high") * F.lit(1 << 32) + F.sum("low")).alias("value")))

    in_rows = rows.join(groups, group).select(
        *group, F.col("term").alias("item"), share("n", "group_total", "kinds").alias("p"), share("total", "lang_total", "kinds").alias("q"))
    terms = in_rows.where("p > q").select(*group, "item", f(p, q).alias("value"))

    ranked = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    columns = [*group, "part", "item", "value", "rank"]
    return (summed.select("*", F.lit("pair").alias("part"), ranked).select(*columns)
            .unionByName(terms.select("*", F.lit("term").alias("part"), ranked).where(F.col("rank") <= top).select(*columns)))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
kinds AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS lang_total FROM kept GROUP BY lang),
counts AS (
  SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n
  FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS group_total FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(s.group_total, 0) AS group_total, coalesce(k.v, 0) AS v, coalesce(k.lang_total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN sums s ON g.lang = s.lang AND g.source = s.source LEFT JOIN kinds k ON g.lang = k.lang),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.group_total + g.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 1) // (g.lang_total + g.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM every)
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 200
"""
