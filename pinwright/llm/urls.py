"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

The pages that a rule decides are the labelled URLs. Length, depth, digit ratio,
entropy, parameter counts and the block rate of the host's suffix describe a URL; the
trees are trained on a bounded sample of the labelled ones, and judge what no rule
fits. Suffix statistics cover all labelled pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.ml.functions import vector_to_array

from pinwright.llm.frames import join_hot, others, quoted
from pinwright.sources.shared import staged

BLOCK, ALLOW = "block", "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_chars", "host_chars", "host_depth", "path_depth", "digit_ratio", "entropy",
            "n_params", "n_marks", "suffix_rate", "suffix_weight"]


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("net/", BLOCK), Rule("example.net/en/", ALLOW), Rule("example.com/de/", BLOCK), Rule("org/fr/", ALLOW))
#: The labelled rows that the trees are trained on, at most.
SAMPLE_ROWS = 8192


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The rule that fits, the longest if several do; a struct of rule and verdict."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")),
                         lambda c: (size - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, n: s + F.when(n > 0, n * F.log2(n)).otherwise(0.0))
    return F.when(size > 0, F.log2(size.cast("double")) - bits / size).otherwise(0.0)


def described(pages: DataFrame, url: str, rules: tuple[Rule, ...]) -> DataFrame:
    u = F.coalesce(F.col(quoted(url)), F.lit(""))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    rows = pages.withColumn("host", host_of(u)).withColumn("path", path_of(u))
    rows = rows.withColumn("_hit", longest_rule(F.col("host"), F.col("path"), rules))
    number = lambda c: c.cast("double")
    return (rows.withColumn("url_chars", number(F.length(u))).withColumn("host_chars", number(F.length("host")))
            .withColumn("host_depth", number(F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))))
            .withColumn("path_depth", number(F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"), F.lit("")))))
            .withColumn("digit_ratio", number(F.length(F.regexp_replace(u, "[^0-9]", ""))) / F.greatest(F.length(u), F.lit(1)))
            .withColumn("entropy", entropy(u))
            .withColumn("n_params", number(F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))))
            .withColumn("n_marks", number(F.length(F.regexp_replace(u, "[^-_%~@=+]", ""))))
            .withColumn("suffix", F.substring_index("host", ".", -2))
            .withColumn("label", F.when(F.col("_hit.verdict") == BLOCK, 1.0).when(F.col("_hit.verdict") == ALLOW, 0.0)))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(suffix, suffix_rate, suffix_weight, n): smoothed block rate over all labelled pages."""
    blocked, labelled = F.coalesce(F.sum("label"), F.lit(0.0)), F.count("label")
    return rows.groupBy("suffix").agg(
        ((blocked + 1.0) / (labelled + 2.0)).alias("suffix_rate"),
        F.log1p(labelled.cast("double")).alias("suffix_weight"), F.count("*").alias("n"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
               rounds: int = 12, depth: int = 3, url: str = "url", key: str = "page_id") -> DataFrame:
    """Add host, path, rule, verdict and block_score (null where a rule decides).

    One row per input row. A url that is null or has no ``://`` has an empty host and path,
    no rule, and the trees' verdict. The sample is the labelled rows with the least hashes
    of key and url. If they hold no two classes, their one class is the verdict of all the rest
    (allow, if there is none). Input columns named like a computed one are replaced.
    """
    made = ("host", "path", "rule", "verdict", "block_score", "suffix", "label", "_hit", "_features", "_prediction", "_raw", "_probability", *FEATURES)
    keep = [c for c in others(pages, made)]
    rows = described(pages.select(*[F.col(quoted(c)) for c in keep]), url, rules)
    statistics = staged(suffix_statistics(rows), "suffix-statistics")
    rows = join_hot(rows, statistics, ["suffix"])
    sample = staged(rows.where("label IS NOT NULL").orderBy(F.xxhash64(quoted(key), quoted(url)), quoted(key))
                    .limit(sample_rows).select("label", *FEATURES), "labelled-urls")
    classes = sample.agg(F.min("label"), F.max("label")).first()
    if classes[0] == classes[1]:
        judged = rows.withColumn("block_score", F.lit(classes[0] or 0.0))
    else:
        judged = boosted(sample, rounds, depth).transform(rows)
        judged = judged.withColumn("block_score", vector_to_array("_probability")[1])
    decided = F.col("_hit").isNotNull()
    verdict = F.when(decided, F.col("_hit.verdict")).when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW)
    return judged.select(*[F.col(quoted(c)) for c in keep], "host", "path", F.col("_hit.rule").alias("rule"),
                         verdict.alias("verdict"), F.when(~decided, F.col("block_score")).alias("block_score"))


def boosted(sample: DataFrame, rounds: int, depth: int):
    """Gradient-boosted trees; the sample is bounded, so it is one ordered partition."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    trees = (GBTClassifier(labelCol="label", featuresCol="_features", maxIter=rounds, maxDepth=depth,
                           stepSize=0.3, seed=7)
             .setPredictionCol("_prediction").setRawPredictionCol("_raw").setProbabilityCol("_probability"))
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"), trees]).fit(
        sample.coalesce(1).sortWithinPartitions("label", *FEATURES))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
