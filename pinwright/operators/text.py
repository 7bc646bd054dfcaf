"""Facts read from running text. A document text is one row, so these rules work
on arrays inside the row and need no shuffle; only choices between strategies of
one document group rows again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import rules as R
from ..sources.shared import staged
from . import ordered


def description_line(text: Column, part_number: Column) -> Column:
    """First usable line naming the part, else the first long plain line."""
    lines = F.transform(F.split(text, "\n", -1), R.strip)
    pn = F.upper(part_number)
    skip = "|".join(w.replace("&", "\\&") for w in L.DESCRIPTION_SKIP)
    titled = F.filter(lines, lambda s: F.contains(F.upper(s), pn) & (F.length(s) > 20)
                      & (F.length(s) < 200) & ~F.lower(s).rlike(skip))
    plain = F.filter(F.slice(lines, 1, 30), lambda s: (F.length(s) > 30)
                     & ~F.startswith(s, F.lit("www.")) & ~F.startswith(s, F.lit("http")))
    return F.coalesce(R.first_of(titled), F.substring(R.first_of(plain), 1, 200), F.lit(""))


def component_class(lower_text: Column) -> Column:
    """Class of the first keyword group found in a lower-case text; else 'ic'."""
    return R.case_chain(
        [(R.contains_any(lower_text, words), name) for name, words in L.COMPONENT_KEYWORDS], "ic")


def full_text(pages: DataFrame, chunk: int = 256) -> DataFrame:
    """Page texts of a document joined by line breaks in page order.

    Joined in two steps, chunks of pages first, so that no task gathers more
    than the finished text. Source documents are at most 50 MB.
    """
    def joined(parts):
        ordered_parts = F.sort_array(F.collect_list(parts))
        return F.array_join(F.transform(ordered_parts, lambda p: p["t"]), "\n")

    part = pages.groupBy("doc_id", F.floor(F.col("page_num") / chunk).alias("_chunk")).agg(
        joined(F.struct("page_num", F.coalesce("text", F.lit("")).alias("t"))).alias("_t"))
    return part.groupBy("doc_id").agg(
        joined(F.struct("_chunk", F.col("_t").alias("t"))).alias("full_text"))


def page_tier(page_num: Column, text: Column) -> Column:
    """0 first two pages, 1 pages about pins, 2 the rest."""
    up = F.upper(text)
    about = F.contains(up, F.lit("PIN")) & R.contains_any(up, ["NAME", "FUNCTION", "DESCRIPTION"])
    return F.when(page_num <= 2, 0).when(about, 1).otherwise(2)


def packed_pages(pages: DataFrame, budget: int = L.CONTEXT_BUDGET,
                 least: int = L.CONTEXT_MIN_REMAINDER) -> DataFrame:
    """Pages that fit a text budget: (doc_id, tier, page_num, kept text).

    Pages count by tier and number until one overflows; that page is cut to the
    rest when more than ``least`` characters remain, and packing stops there.
    """
    tiered = pages.withColumn("tier", page_tier(F.col("page_num"), F.col("text"))).withColumn(
        "_len", F.length("text"))
    block = F.struct(F.col("tier"), F.floor(F.col("page_num") / 4096))
    summed = ordered.running_sum(tiered, ["doc_id"], ["tier", "page_num"], F.col("_len"), "_sum", block)
    before = F.col("_sum") - F.col("_len")
    rest = F.lit(budget) - before
    # The first page past the budget is the only one whose predecessors still fit.
    first_over = (
        summed.filter(F.col("_sum") > budget).groupBy("doc_id")
        .agg(F.min(F.struct("tier", "page_num")).alias("_over"))
    )
    return (
        summed.join(first_over, "doc_id", "left")
        .withColumn("_at", F.struct("tier", "page_num"))
        .withColumn("kept", F.when(F.col("_over").isNull() | (F.col("_at") < F.col("_over")), F.col("text"))
                    .when((F.col("_at") == F.col("_over")) & (rest > least),
                          F.substring(F.col("text"), F.lit(1), rest.cast("int"))))
        .filter("kept is not null").select("doc_id", "tier", "page_num", "kept")
    )


def pack_context(pages: DataFrame, budget: int = L.CONTEXT_BUDGET,
                 least: int = L.CONTEXT_MIN_REMAINDER) -> DataFrame:
    """One context text per document; its length is bounded by the budget."""
    kept = packed_pages(pages, budget, least)
    parts = F.sort_array(F.collect_list(F.struct("tier", "page_num", "kept")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(
        F.lit("--- Page "), p["page_num"].cast("string"), F.lit(" ---\n"), p["kept"])),
        "\n\n").alias("context"))


ANSWER_SCHEMA = (
    "packages array<struct<name string, pin_count int, package_code string, dimensions string>>, "
    "pins array<struct<number string, name string, type string, description string>>, "
    "description string"
)


def parsed_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("_a", F.from_json("answer", ANSWER_SCHEMA, {"mode": "PERMISSIVE"}))


def answer_packages(answers: DataFrame) -> DataFrame:
    """Packages of model answers; name and a non-zero count are required."""
    return (
        parsed_answers(answers).select("doc_id", F.posexplode("_a.packages").alias("cand_pos", "_p"))
        .filter("_p.name <> '' and coalesce(_p.pin_count, 0) <> 0")
        .select("doc_id", "cand_pos", "_p.name", "_p.pin_count",
                F.coalesce("_p.package_code", F.lit("")).alias("code"),
                F.coalesce("_p.dimensions", F.lit("")).alias("dimensions"))
    )


def answer_pins(answers: DataFrame) -> DataFrame:
    """Pins of model answers: cleaned, typed, first occurrence per number."""
    typed = F.replace(F.lower(F.coalesce("_p.type", F.lit(""))), F.lit(" "), F.lit("_"))
    rows = (
        parsed_answers(answers).select("doc_id", F.posexplode("_a.pins").alias("row_pos", "_p"))
        .select("doc_id", "row_pos", F.col("_p.number").alias("number"),
                R.clean_pin_name(F.col("_p.name")).alias("name"),
                F.when(typed.isin(L.ANSWER_TYPES), typed).otherwise("passive").alias("pin_type"),
                F.coalesce("_p.description", F.lit("")).alias("description"))
        .filter("number <> '' and name <> ''")
    )
    return ordered.first_per_key(rows, ["doc_id", "number"], ["row_pos"])


# --- packages in text -----------------------------------------------------------------

def _first_named(rows: DataFrame) -> DataFrame:
    return ordered.first_per_key(rows, ["doc_id", "name"], ["pos"])


def orderable_packages(docs: DataFrame) -> DataFrame:
    """Packages from orderable numbers in the text, else from CODE (FAMILY, n).

    ``docs(doc_id, base, text)``. The pattern is the base number followed by one
    of the package codes, longest first.
    """
    codes = "|".join(sorted(L.CODE_PACKAGES, key=len, reverse=True))
    escaped = F.regexp_replace("base", r"([^A-Za-z0-9])", r"\\$1")
    pattern = F.concat(F.lit("(?i)"), escaped, F.lit(f"({codes})R?(?:-Q[0-9]+)?"))
    named = {c: n for c, (n, _) in L.CODE_PACKAGES.items()}
    counts = {c: k for c, (_, k) in L.CODE_PACKAGES.items()}
    d = docs.filter("base <> ''")
    # Few texts name their base at all: a plain substring test comes first, as for the families.
    named_at_all = F.contains(F.upper("text"), F.upper("base"))
    found = d.withColumn("_m", F.when(named_at_all | F.col("text").isNull(), F.regexp_extract_all("text", pattern, F.lit(1)))
                         .otherwise(F.array().cast("array<string>")))
    code = F.upper("_c")
    ordering = (
        R.numbered(found, ["doc_id"], F.col("_m"), "pos", "_c")
        .select("doc_id", "pos", R.lookup(named, code).alias("name"),
                R.lookup(counts, code).alias("pin_count"), code.alias("code"))
    )
    inline = "(?i)" + L.PACKAGE_INLINE
    from .tables import family_of_code
    entry = F.upper(F.regexp_extract("_e", inline, 1))
    count = F.regexp_extract("_e", inline, 3).cast("int")
    listed = (
        found.filter(F.size("_m") == 0)
        .select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(inline), F.lit(0))).alias("pos", "_e"))
        .select("doc_id", "pos",
                F.concat(F.coalesce(family_of_code(entry), F.upper(F.regexp_extract("_e", inline, 2))),
                         F.lit("-"), count.cast("string")).alias("name"),
                count.alias("pin_count"), entry.alias("code"))
    )
    return _first_named(ordering.unionByName(listed))


def _mentions(rank: int, pattern: str, name: str) -> Column:
    """Matches of one package pattern as (rank, at, name, count) structs."""
    counted = "{0}" in name

    def entry(m, i):
        full = F.concat(F.lit(name.replace("{0}", "")), m) if counted else F.lit(name)
        count = m if counted else F.lit(None).cast("string")
        return F.struct(F.lit(rank).alias("rank"), i.alias("at"), full.alias("name"), count.alias("count"))

    found = F.transform(
        F.regexp_extract_all("text", F.lit("(?i)" + pattern), F.lit(1 if counted else 0)), entry)
    # Few texts name a given family at all: a plain substring test comes first.
    return F.when(F.contains("_up", F.lit(_family_word(pattern))), found).otherwise(
        F.array().cast("array<struct<rank:int,at:int,name:string,count:string>>"))


def _family_word(pattern: str) -> str:
    """The longest run of capitals every match of a package pattern contains."""
    plain = re.sub(r"\(\?<?!.*?\)|\[[^\]]*\]|\\.|\(\?:.*?\)", " ", pattern)
    return max(re.findall(r"[A-Z]+(?!\?)", plain), key=len)


def mentioned_packages(docs: DataFrame) -> DataFrame:
    """Every package mention in the text: (doc_id, pos, name, pin_count).

    Order is pattern rank first, then place in the text, as a single number.
    """
    hits = F.concat(*[_mentions(rank, pat, name) for rank, (pat, name) in enumerate(L.PACKAGE_PATTERNS)])
    count = F.coalesce("_h.count", F.lit("0")).cast("int")
    return (
        R.numbered(docs.select("doc_id", "text", F.upper("text").alias("_up")), ["doc_id"], hits, "pos", "_h")
        .select("doc_id", "pos", F.col("_h.name").alias("name"),
                F.when(count == 0, F.coalesce(R.lookup(L.FIXED_PIN_COUNTS, F.col("_h.name")), F.lit(0)))
                .otherwise(count).alias("pin_count"))
    )


def package_of_suffix(part_number: Column) -> Column:
    """Package (name, pin_count, code) whose code ends the number, R allowed."""
    pn = F.upper(R.strip(part_number))
    table = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(k).alias("pin_count"), F.lit(c).alias("code"))
        for c, (n, k) in L.CODE_PACKAGES.items()])
    return R.first_of(F.filter(table, lambda t: F.endswith(pn, t["code"])
                               | F.endswith(pn, F.concat(t["code"], F.lit("R")))))


def package_of_text(mentions: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """First mention per document, preferring one with the hinted pin count."""
    m = mentions
    if hints is None:
        m = m.withColumn("_hint", F.lit(0))
    else:
        m = m.join(hints.select("doc_id", F.col("pin_count").alias("_hint")), "doc_id", "left")
    fits = (F.col("_hint") > 0) & (F.col("pin_count") == F.col("_hint"))
    row = F.struct("name", "pin_count")
    return m.groupBy("doc_id").agg(
        F.min_by(row, F.when(fits, F.col("pos"))).alias("_fit"), F.min_by(row, "pos").alias("_any")
    ).withColumn("_p", F.coalesce("_fit", "_any")).select("doc_id", "_p.name", "_p.pin_count")


def first_strategy(*strategies: DataFrame) -> DataFrame:
    """Rows of the first strategy that found anything, per document."""
    tagged = [s.withColumn("tier", F.lit(i + 1)) for i, s in enumerate(strategies)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    union = staged(union, "strategies")  # read twice
    lowest = union.groupBy("doc_id").agg(F.min("tier").alias("_t"))
    return union.join(lowest, "doc_id").filter("tier = _t").drop("_t")


def all_packages(docs: DataFrame, from_tables: DataFrame | None = None) -> DataFrame:
    """Package candidates: information tables, orderable numbers, text patterns.

    ``docs(doc_id, base, maker, text)``. Orderable numbers are tried for one
    maker (or an unknown one) only.
    """
    cols = ["doc_id", "pos", "name", "pin_count", "code"]
    listed = docs.filter(F.upper(F.coalesce("maker", F.lit(""))).isin("TI", "TEXAS INSTRUMENTS", ""))
    orderable = orderable_packages(listed).select(cols)
    mentions = _first_named(mentioned_packages(docs)).withColumn("code", F.lit("")).select(cols)
    tiers = [orderable, mentions]
    if from_tables is not None:
        tiers.insert(0, from_tables.withColumn("pos", F.col("row_idx")).select(cols))
    return first_strategy(*tiers)


# --- pins in text -----------------------------------------------------------------------

def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _after_first(text: Column, pattern: str) -> Column:
    """Text behind the first match, null without one."""
    head = F.regexp_substr(text, F.lit(pattern))
    return F.when(head.isNotNull(), F.substring(
        text, F.regexp_instr(text, F.lit(pattern)) + F.length(head), F.length(text)))


# Kinds of raw matches; the tens digit is the strategy.
DUAL, SINGLE, EPAD, PARAGRAPH, NAMED, LISTED = 11, 12, 13, 20, 30, 31


def _raw_matches(docs: DataFrame) -> DataFrame:
    """One row per raw pattern match: (doc_id, headed, fet, bjt, kind, at, m, tail).

    Documents without any match keep one row with a null kind.
    """
    t = F.col("text")

    def tagged(kind, matches, tails=None):
        def entry(m, i):
            tail = F.lit("") if tails is None else F.get(tails, i)
            return F.struct(F.lit(kind).alias("kind"), i.alias("at"), m.alias("m"), tail.alias("tail"))
        return F.coalesce(F.transform(matches, entry),
                          F.array().cast("array<struct<kind:int,at:int,m:string,tail:string>>"))

    up = F.upper(t)

    def says(*words):
        return R.contains_any(up, words)

    d = docs.select(
        "doc_id", "text",
        F.coalesce(_after_first(t, L.SECTION_HEAD), _after_first(t, L.SECTION_HEAD_SPLIT)).alias("_after"),
        ((says("N-CHANNEL", "NMOS") | says("P-CHANNEL", "PMOS")) & says("MOSFET", "FET", "DRAIN")).alias("fet"),
        (says("NPN", "PNP") & says("TRANSISTOR", "BJT", "COLLECTOR")).alias("bjt"))
    end = F.regexp_instr(F.col("_after"), F.lit(L.SECTION_END))
    # Line breaks inside parentheses are closed up before paragraphs are read.
    joined = t
    for _ in range(5):
        joined = F.regexp_replace(joined, r"\((?=[^)]*\))([^)]*)\n([^)]*)\)", "($1 $2)")
    d = d.select(
        "doc_id", "text", "fet", "bjt", F.col("_after").isNotNull().alias("headed"),
        F.when(end > 0, F.substring(F.col("_after"), F.lit(1), end - 1)).otherwise(F.col("_after")).alias("_sec"),
        F.when(t.rlike(r"(?i)PIN\s+FUNCTIONS"), joined).alias("_joined"))
    sec, para = F.col("_sec"), F.col("_joined")
    d = d.select("*", _found(sec, L.LINE_DUAL).alias("_dual"), _found(sec, L.LINE_SINGLE).alias("_single"))
    dual = (F.size("_dual") >= 3) & (F.size("_dual") >= F.size("_single") * 0.5)
    tails = F.regexp_extract_all(para, F.lit(L.NAMED_PINS + r"(?=([\s\S]{0,200}))"), F.lit(4))
    raw = F.concat(
        F.when(dual, tagged(DUAL, F.col("_dual"))).otherwise(tagged(SINGLE, F.col("_single"))),
        tagged(EPAD, _found(sec, L.LINE_EPAD)),
        tagged(PARAGRAPH, _found(para, L.NAMED_PINS), tails),
        tagged(NAMED, _found(t, L.GENERIC_NAMED)),
        tagged(LISTED, _found(t, L.GENERIC_LINE)),
    )
    return d.select("doc_id", "headed", "fet", "bjt", F.explode_outer(raw).alias("_e")).select(
        "doc_id", "headed", "fet", "bjt", "_e.*")


def _parsed(raw: DataFrame) -> DataFrame:
    """Raw matches to pin candidates; what no strategy accepts is dropped."""
    kind, m = F.col("kind"), F.col("m")

    def group(table):
        return R.case_chain([(kind == k, R.strip(F.regexp_extract(m, pat, g))) for k, (pat, g) in table.items()],
                            F.lit(None).cast("string"))

    tail = R.strip(F.col("tail"))
    sentence = F.when(F.contains(tail, F.lit(".")), F.concat(
        R.strip(F.substring_index(tail, ".", 1)), F.lit("."))).otherwise(F.substring(tail, 1, 80))
    shift = F.when(kind == EPAD, 1_000_000).when(kind == LISTED, 10_000_000).otherwise(0)
    rows = raw.filter("kind is not null").select(
        "doc_id", "kind", F.floor(kind / 10).cast("int").alias("strategy"),
        ((F.col("at") + shift) * 2).alias("pos"),
        group({DUAL: (L.LINE_DUAL, 2), SINGLE: (L.LINE_SINGLE, 1), PARAGRAPH: (L.NAMED_PINS, 2),
               NAMED: (L.GENERIC_NAMED, 1), LISTED: (L.GENERIC_LINE, 1)}).alias("numbers"),
        group({DUAL: (L.LINE_DUAL, 3), SINGLE: (L.LINE_SINGLE, 2), PARAGRAPH: (L.NAMED_PINS, 1),
               NAMED: (L.GENERIC_NAMED, 2), LISTED: (L.GENERIC_LINE, 2)}).alias("name"),
        F.when(kind == PARAGRAPH, sentence).otherwise(group({
            DUAL: (L.LINE_DUAL, 4), SINGLE: (L.LINE_SINGLE, 3), EPAD: (L.LINE_EPAD, 1),
            LISTED: (L.GENERIC_LINE, 3)})).alias("description"),
        F.when(kind == PARAGRAPH, F.regexp_extract(m, L.NAMED_PINS, 3)).alias("pad"))
    number = R.strip(F.substring_index("numbers", ",", 1))
    others = F.when(F.contains("numbers", F.lit(",")), F.regexp_replace(
        F.regexp_replace("numbers", r"^[^,]*,\s*", ""), r"\s*,\s*", ",")).otherwise("")
    accepted = (
        F.when(kind.isin(DUAL, SINGLE), _small(number) & ~F.col("name").rlike(r"^[0-9.]+[A-Z]$"))
        .when(kind == PARAGRAPH, ~F.upper("name").isin(L.COMMON_WORDS))
        .when(kind.isin(NAMED, LISTED), _small(number) & (F.length("name") <= 20)
              & ~F.col("name").rlike(r"^[0-9.]+$"))
        .otherwise(True))
    rows = rows.filter(accepted)
    pins = rows.filter(kind != EPAD).select(
        "doc_id", "strategy", "pos", number.alias("number"), "name", F.coalesce("description", F.lit("")).alias("description"),
        others.alias("alt_numbers"), F.lit(None).cast("string").alias("fixed"))
    pads = rows.filter((kind == EPAD) | (F.coalesce("pad", F.lit("")) != "")).select(
        "doc_id", "strategy", (F.col("pos") + 1).alias("pos"), F.lit("EP").alias("number"),
        F.when(kind == EPAD, "GND").otherwise(F.col("name")).alias("name"),
        F.when((kind == EPAD) & (F.col("description") != ""), F.col("description")).otherwise("Exposed pad").alias("description"),
        F.lit("").alias("alt_numbers"), F.lit("power_in").alias("fixed"))
    return pins.unionByName(pads)


def pins_from_text(docs: DataFrame, hint: int = 0, hints: DataFrame | None = None) -> DataFrame:
    """Pins read from running text: (doc_id, pos, number, name, …, strategy, confidence).

    ``hint`` is the expected number of pins, and ``hints(doc_id, pin_count)`` one per document,
    which goes first: more than four expected pins rule the standard pinout of a transistor
    out, and fewer low numbers than expected call for it.

    Four strategies per document, the first with pins wins: a headed pin section
    (one or two number columns), named paragraphs "NAME (Pin n):", generic
    lines, and the standard pinout of transistors, which also replaces pins that
    look like misread text. First occurrence per number is kept.
    """
    # The texts are read once; their matches are a small table used three times.
    raw = staged(_raw_matches(docs), "matches")
    parsed = _parsed(raw)
    value = F.when(F.col("number").rlike(r"^\d+$"), F.col("number").try_cast("bigint"))
    per_strategy = parsed.groupBy("doc_id", "strategy").agg(
        F.max(F.coalesce(value > 50, F.lit(False))).alias("_high"),
        F.max(F.upper("name").isin(L.JUNK_NAMES)).alias("_junk"),
        F.count_if(value <= 4).alias("_low"))
    best = per_strategy.groupBy("doc_id").agg(
        F.min_by(F.struct("strategy", (F.col("_high") | F.col("_junk")).alias("junk"), F.col("_low").alias("low")),
                 "strategy").alias("_b"))
    flags = raw.groupBy("doc_id").agg(F.max("headed").alias("headed"), F.max("fet").alias("fet"), F.max("bjt").alias("bjt"))
    if hints is None:
        flags = flags.withColumn("_hint", F.lit(hint))
    else:
        counts = hints.select("doc_id", F.col("pin_count").alias("_hint"))
        flags = flags.join(counts, "doc_id", "left").withColumn("_hint", F.coalesce("_hint", F.lit(hint)))
    misread = F.coalesce(F.col("_b.junk") | (F.col("_b.low") < F.col("_hint")), F.lit(True)) & (F.col("_hint") <= 4)
    chosen = flags.join(best, "doc_id", "left").select(
        "doc_id", F.when(F.col("headed"), 0.5).otherwise(0.3).alias("confidence"),
        F.col("_b.strategy").alias("_s"),
        F.when(misread & F.col("fet"), "fet").when(misread & F.col("bjt"), "bjt").alias("_template"))
    read = parsed.join(chosen.filter("_template is null"), "doc_id").filter("strategy = _s").drop("_s", "_template")
    pinouts = docs.sparkSession.createDataFrame(
        [(t, i, n, name, kind, text) for t, rows in (("fet", L.FET_PINS), ("bjt", L.BJT_PINS))
         for i, (n, name, kind, text) in enumerate(rows)],
        "_template string, pos int, number string, name string, fixed string, description string")
    standard = chosen.filter("_template is not null").join(F.broadcast(pinouts), "_template").select(
        "doc_id", F.lit(4).alias("strategy"), "pos", "number", "name", "description",
        F.lit("").alias("alt_numbers"), "fixed", "confidence")
    every = ordered.first_per_key(read.unionByName(standard), ["doc_id", "number"], ["pos"])
    return every.select(
        "doc_id", "pos", "number", "name",
        F.coalesce("fixed", R.infer_pin_type(F.col("name"), F.col("description"))).alias("pin_type"),
        "description", "alt_numbers", "strategy", "confidence")


def _small(number: Column) -> Column:
    """A pin number up to 200; longer digit strings are compared by length."""
    n = F.regexp_replace(number, "^0+(?=.)", "")
    return (F.length(n) <= 3) & (n.try_cast("int") <= 200)
