"""Benchmark decontamination: which documents hold which test items.

An item is in a document if enough of the item's word shingles are (containment, not
resemblance, as a short item inside a long document resembles it hardly at all).
Items are parted by size. Each part keeps of every item the shingles with the
least hash values, a bottom sketch just long enough for its size: if an item of n
shingles may lack f of them, any f + 1 of its shingles include one that the document
has. So the search over sketches loses nothing at the limit, and it looks at a fifth
of the items' shingles. What it finds is verified by exact containment, shingle
strings included.

Built-in functions only: words are hashed once, and shingles are hashes of five
neighbouring word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinwright.llm.frames import quoted
from pinwright.sources.shared import staged

SHINGLE = 5
#: Upper ends of the size parts, in shingles; larger items double from the last one.
PARTS = (4, 8, 16, 32, 64, 128, 256, 512, 1024)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; null has none."""
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(cut, lambda w: w != "")


def hashed_words(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words and their hashes), for texts with a word."""
    return (rows.select(F.col(quoted(key)).alias(key), words_of(F.col(quoted(text))).alias("_w"))
            .where(F.size("_w") > 0).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))))


def runs_of(size: int) -> Column:
    """(at, size, sh): the hashes of all runs of ``size`` words; none in a shorter text."""
    made = F.transform(F.sequence(F.lit(0), F.size("_w") - size), lambda i: F.struct(
        i.alias("at"), F.lit(size).alias("size"), F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(size)]).alias("sh")))
    return F.when(F.size("_w") >= size, made).otherwise(F.array().cast("array<struct<at:int,size:int,sh:bigint>>"))


def with_shingles(rows: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, _w, at, size, sh): the runs of each of ``sizes`` words of a text with their places."""
    runs = runs_of(sizes[0]) if len(sizes) == 1 else F.concat(*map(runs_of, sizes))
    return hashed_words(rows, key, text).select(key, "_w", F.explode(runs).alias("_s")).select(key, "_w", "_s.*")


def shingle_text() -> Column:
    return F.array_join(F.slice("_w", F.col("at") + 1, F.col("size")), " ")


def item_shingles(items: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, size, sh, shingle, n): the different shingles of each item and their number.

    An item of fewer than ``size`` words is one run of its own length.
    """
    each = with_shingles(items.where("item_id IS NOT NULL"), "item_id", "text", list(range(1, size + 1)))
    each = each.where(F.col("size") == F.least(F.size("_w"), F.lit(size)))
    each = each.select("item_id", "size", "sh", shingle_text().alias("shingle")).distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("n"))
    return each.join(sizes, "item_id")


def sketches(shingles: DataFrame, least: float) -> DataFrame:
    """(item_id, sh): the bottom sketch of each item, as long as its size part needs."""
    from pyspark.sql import Window

    top = F.lit(None).cast("long")
    for end in reversed(PARTS):
        top = F.when(F.col("n") <= end, F.lit(end)).otherwise(top)
    top = F.coalesce(top, F.pow(F.lit(2), F.ceil(F.log2("n")))).cast("long")
    length = top - F.ceil(top * least) + 1
    order = Window.partitionBy("item_id").orderBy(F.xxhash64(F.lit("sketch"), "sh"), "shingle")
    return (shingles.withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= length).select("item_id", "sh").distinct())


def find_items(docs: DataFrame, items: DataFrame, least: float = 0.8, size: int = SHINGLE,
               text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for containment of at least ``least``.

    ``docs`` has doc_id and a text column, ``items`` has item_id and text. Rows of one id are one
    document or one item; rows without an id, and texts without a word, are in nothing
    and contain nothing. An item of fewer than five words is one run of its own length, and is looked for among
    the documents' runs of that length; no other lengths than those of items are listed.
    The items' tables are written first, so that their size is known: Spark sends them
    to every task if they are below its broadcast limit, and shuffles otherwise.
    """
    spelled = staged(item_shingles(items, size), "item-shingles")
    index = staged(sketches(spelled, least), "item-sketches")
    sizes = sorted(r["size"] for r in spelled.select("size").distinct().collect()) or [size]  # five at most
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.col(quoted(text)).alias("text"))
    found = staged(with_shingles(texts, "doc_id", "text", sizes).select("doc_id", "sh")
                   .join(index, "sh").select("doc_id", "item_id").distinct(), "item-candidates")
    near = staged(found.select("doc_id").distinct(), "candidate-documents")
    held = with_shingles(texts.join(near, "doc_id", "left_semi"), "doc_id", "text", sizes).select(
        "doc_id", "sh", shingle_text().alias("shingle"))  # few words a row, in case it is shuffled
    same = held.join(spelled, ["sh", "shingle"])
    counted = (same.select("doc_id", "item_id", "n", "shingle").distinct()
               .groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared")))
    return (counted.join(found, ["doc_id", "item_id"], "left_semi")
            .where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(least)))
            .select("doc_id", "item_id", F.col("n").alias("n_item"), "n_shared",
                    (F.col("n_shared") / F.col("n")).alias("containment")))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
WITH c AS (
  SELECT 'd' AS kind, doc_id AS id, lower(text) AS t FROM documents
  UNION ALL SELECT 'i', item_id, lower(text) FROM benchmark),
v AS (SELECT kind, id, regexp_replace(regexp_replace(t, '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '') AS t FROM c),
w AS (SELECT kind, id, string_split_regex(t, '[^\p{L}\p{N}]+') AS ws FROM v WHERE t <> ''),
p AS (SELECT kind, id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS pos FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT kind, id, array_to_string(list_slice(ws, pos, pos + 4), ' ') AS sh FROM p),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_item, count(*) AS n_shared, count(*) / n.n AS containment
FROM s d JOIN s i ON d.sh = i.sh AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING count(*) >= ceil(n.n * 0.8)
"""
