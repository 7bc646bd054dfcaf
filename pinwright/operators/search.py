"""Library search: ranked name matching rewritten as keyed joins.

The rules score every (query, entry) pair. Evaluated literally that is a nested
loop over queries x library; here each textual test becomes an equi-join:

* "query inside text" joins on the query's rarest n-gram (n <= 3) and checks the
  containment as a residual; exact and prefix hits are special cases of it,
* the trailing-wildcard rule joins the query's prefixes with the name's stem.

All tests run on *distinct* texts, so repeated part numbers and names cost
nothing, and the result fans out to library entries once at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import rules as R
from ..sources.shared import staged
from . import ordered

# Scores of the match tiers and the pin-count adjustment.
SYMBOL_SCORES = {1: 100.0, 2: 80.0, 3: 85.0, 4: 50.0, 5: 20.0, 6: 15.0}
FOOTPRINT_SCORES = {1: 100.0, 2: 50.0, 3: 40.0}
COUNT_BONUS, COUNT_MALUS = 10.0, 5.0


def _grams(text: Column, n: int) -> Column:
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    cut = F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))


def contains_join(queries: DataFrame, query: str, texts: DataFrame, text: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Pairs (by, query, text) where the text contains the query.

    Joined on the query's rarest gram among the texts, so popular fragments do
    not blow up the candidate set. Only a number per text travels with its grams; the
    text is fetched for the candidates at the end, and every candidate is checked. Queries of
    one or two characters go by grams of their own size, so that other texts'
    short grams are never listed for the long ones; the empty query is inside every text.
    """
    by = list(by)
    qs = queries.select(*by, F.col(query).alias("_q")).filter("_q is not null").distinct()
    ts = texts.select(*by, F.col(text).alias("_t")).filter("_t is not null").distinct().withColumn(
        "_id", F.xxhash64("_t"))
    long_q, short_q = qs.filter(F.length("_q") >= 3), qs.filter(F.length("_q").isin(1, 2))

    def listed(sizes, wanted):
        grams = F.concat(*[_grams(F.col("_t"), n) for n in sizes])
        return ts.select(*by, "_id", F.explode(grams).alias("_gram")).join(
            wanted.select(*by, "_gram").distinct(), [*by, "_gram"], "left_semi")

    q_grams = long_q.withColumn("_gram", F.explode(_grams(F.col("_q"), 3)))
    t_grams = listed((3,), q_grams)
    seen = t_grams.groupBy(*by, "_gram").agg(F.count(F.lit(1)).alias("_seen"))
    key = (
        q_grams.join(seen, [*by, "_gram"])
        .groupBy(*by, "_q")
        .agg(F.min_by("_gram", F.struct("_seen", "_gram")).alias("_gram"))
    )
    found = key.join(t_grams, [*by, "_gram"]).select(*by, "_q", "_id")
    shorts = short_q.withColumn("_gram", F.col("_q"))
    found = found.unionByName(shorts.join(listed((2, 1), shorts), [*by, "_gram"]).select(*by, "_q", "_id"))
    pairs = found.join(ts, [*by, "_id"]).filter(F.contains("_t", F.col("_q"))).select(*by, "_q", "_t")
    empty = qs.filter("_q = ''")
    if by:
        every = ts.join(empty, by)
    else:  # one query at most: a yes or no, read once, instead of a join without a key
        every = ts.filter(empty.agg(F.count(F.lit(1)) > 0).scalar()).withColumn("_q", F.lit(""))
    return pairs.unionByName(every.select(*by, "_q", "_t")).select(*by, F.col("_q").alias(query), F.col("_t").alias(text))


def wildcard_pairs(queries: DataFrame, query: str, names: DataFrame, name: str) -> DataFrame:
    """Pairs where a name ending in X stands for the (slightly longer) query."""
    qs = queries.select(F.col(query).alias("_q")).filter("_q <> ''").distinct()
    prefixes = qs.withColumn("_stem", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("_q")), lambda n: F.substring(F.col("_q"), F.lit(1), n))))
    stems = (
        names.select(F.col(name).alias("_t")).distinct()
        .withColumn("_stem", R.wildcard_stem(F.col("_t"))).filter("_stem is not null")
    )
    return (
        prefixes.join(stems, "_stem")
        .filter(F.length("_q") <= F.length("_t") + 1)
        .select(F.col("_q").alias(query), F.col("_t").alias(name))
    )


def _score(tier: Column, table: dict) -> Column:
    return R.case_chain([(tier == k, v) for k, v in table.items()], F.lit(None).cast("double"))


def _adjusted(base: Column, wanted: Column, have: Column) -> Column:
    w = F.coalesce(wanted, F.lit(0))
    return base + F.when((w > 0) & (have == w), COUNT_BONUS).when(w > 0, -COUNT_MALUS).otherwise(0.0)


def search_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Scored symbols per request.

    ``requests(query, pin_count)`` holds upper-case query texts and ``symbols``
    the library index. Returns (query, pin_count, ord, lib, name,
    entry_pin_count, score); every request appears once however often asked.
    """
    req = requests.select("query", "pin_count").distinct()
    texts = req.select("query").distinct()
    lib = symbols.select(
        "ord", "lib", "name", F.col("pin_count").alias("entry_pin_count"),
        F.upper("name").alias("_name"), F.upper("description").alias("_desc"),
        F.upper("keywords").alias("_keys"),
    )
    q, n = F.col("query"), F.col("_name")
    inside = contains_join(texts, "query", lib, "_name").withColumn(
        "_tier", F.when(n == q, 1).when(F.startswith(n, q), 2).otherwise(4))
    wild = wildcard_pairs(texts, "query", lib, "_name").withColumn("_tier", F.lit(3))
    named = inside.unionByName(wild).join(lib.select("_name", "ord"), "_name")
    described = contains_join(texts, "query", lib, "_desc").withColumn("_tier", F.lit(5)).join(
        lib.select("_desc", "ord"), "_desc")
    keyed = contains_join(texts, "query", lib, "_keys").withColumn("_tier", F.lit(6)).join(
        lib.select("_keys", "ord"), "_keys")
    cols = ["query", "ord", "_tier"]
    hits = (
        named.select(cols).unionByName(described.select(cols)).unionByName(keyed.select(cols))
        .groupBy("query", "ord").agg(F.min("_tier").alias("_tier"))
    )
    return (
        hits.join(lib.select("ord", "lib", "name", "entry_pin_count"), "ord")
        .join(req, "query")
        .withColumn("score", _adjusted(_score(F.col("_tier"), SYMBOL_SCORES),
                                       F.col("pin_count"), F.col("entry_pin_count")))
        .filter("score > 0")
        .select("query", "pin_count", "ord", "lib", "name", "entry_pin_count", "score")
    )


def top_symbols(requests: DataFrame, symbols: DataFrame, k: int) -> DataFrame:
    """The best ``k`` symbols per request: ``top_matches(search_symbols(...), k)`` with bounded work.

    Any hit on a name beats any on a description or on keywords, so those are searched, in one
    pass, only for queries with fewer than ``k`` hits on names. A score depends on
    the tier and on the pin count alone, so within a tier the first ``k`` entries of each pin
    count hold all that can be among the best; nothing else leaves a search. That also holds for the
    entries of one text, before they meet the queries. An entry left out there has ``k`` others of its pin
    count before it, in this tier or in an earlier one, so no later tier brings it back among the best.
    """
    asked = requests.select("query", "pin_count").distinct()
    entry = ["ord", "lib", "name", "entry_pin_count"]
    lib = symbols.withColumnRenamed("pin_count", "entry_pin_count")

    def listed(column: str, tier: int) -> DataFrame:
        return lib.select(F.upper(column).alias("_text"), F.lit(tier).alias("_of"), *entry).filter("_text is not null")

    def first_entries(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        return pairs.join(ordered.top_per_key(texts, ["_text", "_of", "entry_pin_count"], [F.asc("ord")], k, "_r"), "_text")

    def kept(hits: DataFrame) -> DataFrame:
        return ordered.top_per_key(hits.select("query", "_tier", *entry), ["query", "_tier", "entry_pin_count"],
                                   [F.asc("ord")], k, "_r").drop("_r")

    queries = asked.select("query").distinct()
    names = listed("name", 0)
    q, n = F.col("query"), F.col("_text")
    inside = contains_join(queries, "query", names, "_text").withColumn(
        "_tier", F.when(n == q, 1).when(F.startswith(n, q), 2).otherwise(4))
    wild = wildcard_pairs(queries, "query", names, "_text").withColumn("_tier", F.lit(3))
    tiers = inside.unionByName(wild).groupBy("query", "_text").agg(F.min("_tier").alias("_tier"))
    named = staged(kept(first_entries(tiers, names)), "named-hits")

    # A query has k hits on names or more exactly where k of them were kept.
    full = named.groupBy("query").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    still = staged(queries.join(full, "query", "left_anti"), "open-queries")
    others = listed("description", 5).unionByName(listed("keywords", 6))
    more = first_entries(contains_join(still, "query", others, "_text"), others).withColumn("_tier", F.col("_of"))
    more = kept(more.join(named.select("query", "ord"), ["query", "ord"], "left_anti"))
    best = F.min(F.struct("_tier", "lib", "name", "entry_pin_count")).alias("_e")  # an entry may be in both
    hits = named.unionByName(more.groupBy("query", "ord").agg(best).select("query", "ord", "_e.*"))
    scored = hits.join(asked, "query").withColumn(
        "score", _adjusted(_score(F.col("_tier"), SYMBOL_SCORES), F.col("pin_count"), F.col("entry_pin_count")))
    return top_matches(scored.select("query", "pin_count", *entry, "score"), k)


def search_symbols_plain(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """The same search as one scored pairing; for checking on small inputs only."""
    req = requests.select("query", "pin_count").distinct()
    name, q = F.upper("name"), F.col("query")
    tier = (
        F.when(name == q, 1).when(F.startswith(name, q), 2).when(R.wildcard_match(name, q), 3)
        .when(F.contains(name, q), 4).when(F.contains(F.upper("description"), q), 5)
        .when(F.contains(F.upper("keywords"), q), 6)
    )
    pairs = req.join(symbols.withColumnRenamed("pin_count", "entry_pin_count"), tier.isNotNull())
    return (
        pairs.withColumn("score", _adjusted(_score(tier, SYMBOL_SCORES), F.col("pin_count"),
                                            F.col("entry_pin_count")))
        .filter("score > 0")
        .select("query", "pin_count", "ord", "lib", "name", "entry_pin_count", "score")
    )


def search_footprints(requests: DataFrame, footprints: DataFrame) -> DataFrame:
    """Scored footprints per request: exact, contained, contained without - and _."""
    def bare(c):
        return F.regexp_replace(c, "[-_]", "")

    req = requests.select("query", "pin_count").distinct()
    texts = req.select("query").distinct().withColumn("_bare_q", bare(F.col("query")))
    lib = footprints.select("ord", "lib", "name", "pad_count", F.upper("name").alias("_name"))
    names = lib.select("_name").distinct().withColumn("_bare_n", bare(F.col("_name")))
    pairs = contains_join(texts, "_bare_q", names, "_bare_n")
    q, n = F.col("query"), F.col("_name")
    return (
        pairs.join(texts, "_bare_q").join(names, "_bare_n")
        .withColumn("_tier", F.when(n == q, 1).when(F.contains(n, q), 2).otherwise(3))
        .join(lib, "_name").join(req, "query")
        .withColumn("score", _adjusted(_score(F.col("_tier"), FOOTPRINT_SCORES),
                                       F.col("pin_count"), F.col("pad_count")))
        .filter("score > 0")
        .select("query", "pin_count", "ord", "lib", "name", "pad_count", "score")
    )


def top_matches(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` entries per request; ties keep library order."""
    return ordered.top_per_key(scored, ["query", "pin_count"], [F.desc("score"), F.asc("ord")], k)


def entry_lookup(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Entry of a (lib, name) pair; the first in library order wins."""
    return requests.join(ordered.first_per_key(entries, ["lib", "name"], ["ord"]), ["lib", "name"])


def name_overlap(pairs: DataFrame, doc_pins: DataFrame, entry_pins: DataFrame) -> DataFrame:
    """Share of a document's pins whose name occurs in the entry, per (doc_id, ord)."""
    names = doc_pins.groupBy("doc_id", F.upper("name").alias("_n")).agg(
        F.count(F.lit(1)).alias("_c"))
    known = entry_pins.select("ord", F.upper("name").alias("_n")).distinct().withColumn(
        "_hit", F.lit(1))
    return (
        pairs.join(names, "doc_id").join(known, ["ord", "_n"], "left")
        .groupBy("doc_id", "ord")
        .agg((F.sum(F.when(F.col("_hit") == 1, F.col("_c")).otherwise(0)) / F.sum("_c"))
             .alias("overlap"))
    )


def match_symbols(docs: DataFrame, symbols: DataFrame, doc_pins: DataFrame,
                  entry_pins: DataFrame, generics=L.GENERIC_SYMBOLS) -> DataFrame:
    """Best library symbol per document by the five-step cascade.

    ``docs(doc_id, part_number, component_type, pin_count)``. Steps: exact score,
    base number, close match by pin names, best initial hit, generic by class.
    """
    d = docs.withColumn("_pn", F.upper(R.strip(F.col("part_number"))))
    # The suffix patterns are slow: each distinct number is split once, by all tasks, and the result kept.
    numbers = d.select("_pn").filter("_pn is not null").distinct().repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_pn")
    bases = staged(R.split_suffix(numbers, "_pn", "_base", "_code").drop("_code"), "bases")
    d = d.join(bases.hint("merge"), "_pn", "left")
    asked = staged(d.select(F.col("_pn").alias("query"), "pin_count").union(
        d.filter("_base <> _pn").select("_base", "pin_count")).distinct(), "asked")
    # At most ten rows per distinct request, read three times below.
    best = staged(top_symbols(asked, symbols, 10), "matches")
    head = best.filter("rank = 1").select(
        "query", "pin_count", F.struct("ord", "lib", "name", "score").alias("_top"))
    d = (
        d.join(head.select(F.col("query").alias("_pn"), "pin_count",
                           F.col("_top").alias("_full")), ["_pn", "pin_count"], "left")
        .join(head.select(F.col("query").alias("_base"), "pin_count",
                          F.col("_top").alias("_short")), ["_base", "pin_count"], "left")
        .withColumn("_short", F.when(F.col("_base") != F.col("_pn"), F.col("_short")))
    )
    use_base = F.col("_short").isNotNull() & (
        F.col("_full").isNull() | (F.col("_short.score") > F.col("_full.score")))
    d = d.withColumn("_query", F.when(use_base, F.col("_base")).otherwise(F.col("_pn"))).withColumn(
        "_first", F.when(use_base, F.col("_short")).otherwise(F.col("_full")))
    def pick(tier, col):
        return F.struct(F.lit(tier).alias("tier"), F.col(f"{col}.ord").alias("ord"),
                        F.col(f"{col}.lib").alias("lib"), F.col(f"{col}.name").alias("name"),
                        F.col(f"{col}.score").alias("score"))

    d = d.withColumn("_direct", F.when(F.col("_full.score") >= 100, pick(1, "_full"))
                     .when(F.col("_short.score") >= 80, pick(2, "_short")))
    # Only documents still unsolved reach the pin-name comparison.
    open_docs = d.filter("_direct is null and _first is not null and pin_count > 0")
    near = (
        open_docs.select("doc_id", F.col("_query").alias("query"), "pin_count")
        .join(best, ["query", "pin_count"]).filter("entry_pin_count = pin_count")
        .select("doc_id", "ord", "lib", "name", "score", "rank")
    )
    close = (
        near.join(name_overlap(near.select("doc_id", "ord"), doc_pins, entry_pins), ["doc_id", "ord"])
        .filter("overlap > 0.5")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(F.lit(3).alias("tier"), F.col("ord"), F.col("lib"), F.col("name"),
                               (F.col("score") * F.col("overlap")).alias("score")),
                      "rank").alias("_close"))
    )
    listed = symbols.sparkSession.createDataFrame(
        [(c, i, lib, n) for i, (c, lib, n) in enumerate(generics)],
        "component_type string, pos int, lib string, name string")
    generic = (
        entry_lookup(listed, symbols.select("ord", "lib", "name")).groupBy("component_type")
        .agg(F.min_by(F.struct(F.lit(5).alias("tier"), F.col("ord"), F.col("lib"), F.col("name"),
                               F.lit(10.0).alias("score")), "pos").alias("_generic"))
    )
    chosen = F.coalesce("_direct", "_close", F.when(F.col("_first").isNotNull(), pick(4, "_first")),
                        "_generic")
    return (
        d.join(close, "doc_id", "left").join(F.broadcast(generic), "component_type", "left")
        .withColumn("_m", chosen)
        .select("doc_id", F.col("_m.tier").alias("tier"), F.col("_m.ord").alias("symbol_ord"),
                F.col("_m.lib").alias("symbol_lib"), F.col("_m.name").alias("symbol_name"),
                F.coalesce("_m.score", F.lit(0.0)).alias("symbol_score"))
    )


def footprint_map(spark) -> DataFrame:
    """The package-to-footprint table (145 fixed rows) with its list position."""
    rows = [(i, k, *v.split(":", 1)) for i, (k, v) in enumerate(L.PACKAGE_FOOTPRINTS.items())]
    return spark.createDataFrame(rows, "pos int, key string, map_lib string, map_name string")


def match_footprints(packages: DataFrame, footprints: DataFrame) -> DataFrame:
    """Best footprint per document by the four-step cascade.

    ``packages(doc_id, name, code, pin_count)`` with one chosen package per
    document. Steps: package table, code table, ranked search terms, family name.
    """
    known = F.broadcast(
        footprint_map(footprints.sparkSession).join(
            footprints.select(F.col("lib").alias("map_lib"), F.col("name").alias("map_name")).distinct(),
            ["map_lib", "map_name"], "left_semi"))
    p = packages.select("doc_id", "name", "code", "pin_count")
    by_name = known.select(F.upper("key").alias("_uname"), F.struct("map_lib", "map_name").alias("_by_name"))
    by_code = known.select(F.col("key").alias("code"), F.struct("map_lib", "map_name").alias("_by_code"))
    d = staged(
        p.withColumn("_uname", F.upper("name")).join(F.broadcast(by_name), "_uname", "left")
        .join(F.broadcast(by_code), "code", "left").drop("_uname"), "packages")
    unsolved = d.filter("_by_name is null and _by_code is null")
    terms = unsolved.select(
        "doc_id", "pin_count",
        F.posexplode(R.footprint_terms(F.col("name"), F.col("pin_count"))).alias("_pos", "_term"),
    ).withColumn("query", F.upper(R.strip(F.col("_term"))))
    family = F.regexp_replace(F.col("name"), r"[-_]?\d+$", "")
    broad = unsolved.withColumn("_family", family).filter("_family <> name").select(
        "doc_id", "pin_count", F.upper(R.strip(F.col("_family"))).alias("query"))
    asked = terms.select("query", "pin_count").union(broad.select("query", "pin_count"))
    best = staged(top_matches(search_footprints(asked, footprints), 5), "matches")
    gap = F.abs(F.col("pad_count") - F.col("pin_count"))
    hit = (
        terms.join(best.filter("rank = 1"), ["query", "pin_count"])
        .withColumn("_s", F.when((gap == 0) | (F.col("pin_count") == 0), F.col("score"))
                    .when(gap <= 2, F.col("score") * 0.9))
        .filter("_s is not null").groupBy("doc_id")
        .agg(F.min_by(F.struct("lib", "name", "_s"), "_pos").alias("_search"))
    )
    wide = (
        broad.join(best, ["query", "pin_count"]).filter("pad_count = pin_count")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct("lib", "name", (F.col("score") * 0.8).alias("_s")), "rank")
             .alias("_broad"))
    )

    def pick(tier, col, lib, name, score):
        return F.when(F.col(col).isNotNull(), F.struct(
            F.lit(tier).alias("tier"), F.col(f"{col}.{lib}").alias("lib"),
            F.col(f"{col}.{name}").alias("name"), score.alias("score")))

    return (
        d.join(hit, "doc_id", "left").join(wide, "doc_id", "left")
        .withColumn("_m", F.coalesce(
            pick(1, "_by_name", "map_lib", "map_name", F.lit(100.0)),
            pick(2, "_by_code", "map_lib", "map_name", F.lit(95.0)),
            pick(3, "_search", "lib", "name", F.col("_search._s")),
            pick(4, "_broad", "lib", "name", F.col("_broad._s"))))
        .select("doc_id", F.col("_m.tier").alias("tier"),
                F.coalesce("_m.lib", F.lit("")).alias("footprint_lib"),
                F.coalesce("_m.name", F.lit("")).alias("footprint_name"),
                F.coalesce("_m.score", F.lit(0.0)).alias("footprint_score"))
    )


def lookup_keys(df: DataFrame, pn: str) -> DataFrame:
    """Rows (.., key_pos, key): search keys of a part number, best first.

    Base number, full number, then prefixes of both down to 80 % of the base
    number (never under five characters).
    """
    def clean(c):
        return F.regexp_replace(F.lower(c), "[-/]", "")

    work = R.split_suffix(df, pn, "_base", "_c").drop("_c")
    first = clean(F.when(F.col("_base") == "", R.strip(F.col(pn))).otherwise(F.col("_base")))
    work = work.withColumn("_k1", first).withColumn("_k2", clean(R.strip(F.col(pn)))).withColumn(
        "_min", F.greatest(F.lit(5), F.floor(F.length("_k1") * 0.8).cast("int")))

    def shorter(k):
        n = F.length(k) - 1
        lens = F.when(n >= F.col("_min"), F.sequence(n, F.col("_min"), F.lit(-1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(lens, lambda m: F.substring(F.col(k), F.lit(1), m))

    keys = F.array_distinct(F.concat(F.array("_k1", "_k2"), shorter("_k1"), shorter("_k2")))
    return work.select(*df.columns, F.posexplode(keys).alias("key_pos", "key"))


def cached_document(parts: DataFrame, pn: str, files: DataFrame, keep) -> DataFrame:
    """First stored document whose name holds a key of the part number.

    ``files(file_pos, file_name, size_bytes)`` in listing order; keys are tried best first
    and the scan stops at the first key shorter than four characters. Files of no more than
    the least admissible size are passed over, and the next one is tried.
    """
    keyed = lookup_keys(parts, pn)
    stop = keyed.filter(F.length("key") < 4).groupBy(*keep).agg(F.min("key_pos").alias("_stop"))
    keyed = keyed.join(stop, list(keep), "left").filter("_stop is null or key_pos < _stop")
    cores = files.filter(F.col("size_bytes") > L.MIN_DOCUMENT_BYTES).withColumn("_core", F.regexp_replace(F.lower("file_name"), "[-_]", ""))
    found = (
        contains_join(keyed, "key", cores, "_core")
        .join(cores.groupBy("_core").agg(F.min_by("file_name", "file_pos").alias("_name"),
                                         F.min("file_pos").alias("_pos")), "_core")
        .groupBy("key").agg(F.min_by("_name", "_pos").alias("file_name"))
    )
    return keyed.join(found, "key").groupBy(*keep).agg(
        F.min_by(F.struct("key", "file_name"), "key_pos").alias("_hit")
    ).select(*keep, "_hit.key", "_hit.file_name")
