"""Pin-level joins, merges and checks.

Pins travel in long form, one row per pin; arrays are only built at a sink. Row
order is the ``row_pos`` column. Per-key choices use ``min_by``/``max_by``
aggregates, which combine on the map side, so one very large document does not
end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import names as N
from ..functions import rules as R
from ..functions.names import judged_pairs
from ..sources.shared import staged
from . import ordered
from .search import contains_join


def first_pins(pins: DataFrame) -> DataFrame:
    """First pin per (document, number)."""
    return ordered.first_per_key(pins, ["doc_id", "number"], ["row_pos"])


def quality_report(pins: DataFrame) -> DataFrame:
    """Per document: mean name length, share of ordinary names, keep or reject."""
    good = F.count_if(R.is_standard_pin_name(F.col("name")))
    return (
        pins.groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("pins"), F.avg(F.length("name")).alias("mean_length"),
             good.alias("standard"))
        .withColumn("kept", (F.col("mean_length") <= 20)
                    & ~((F.col("pins") >= 3) & (F.col("standard") < F.col("pins") * 0.4)))
    )


def quality_gate(pins: DataFrame) -> DataFrame:
    """Pins of the documents whose table reads like a pin table."""
    kept = quality_report(pins).filter("kept").select("doc_id")
    return pins.join(kept, "doc_id", "left_semi")


def pin_mapping(pins: DataFrame, entry_pins: DataFrame) -> DataFrame:
    """Document pin number to library pin number: by name, else the same number.

    Repeated names on the library side: the last one wins. Repeated numbers on
    the document side: the last row decides.
    """
    by_name = entry_pins.groupBy("doc_id", F.upper("name").alias("_n")).agg(
        F.max_by("number", "pin_pos").alias("_by_name"))
    numbers = entry_pins.select("doc_id", "number").distinct().withColumn("_known", F.lit(True))
    mapped = (
        pins.select("doc_id", "row_pos", "number", F.upper("name").alias("_n"))
        .join(by_name, ["doc_id", "_n"], "left").join(numbers, ["doc_id", "number"], "left")
        .select("doc_id", "row_pos", F.col("number").alias("ds_number"),
                F.coalesce("_by_name", "number").alias("sym_number"),
                F.when(F.col("_by_name").isNotNull(), "name")
                .when(F.col("_known"), "number").otherwise("kept").alias("via"))
    )
    return mapped.groupBy("doc_id", "ds_number").agg(
        F.min("row_pos").alias("row_pos"),
        F.max_by(F.struct("sym_number", "via"), "row_pos").alias("_m"),
    ).select("doc_id", "row_pos", "ds_number", "_m.sym_number", "_m.via")


def name_overlap_ratio(pins: DataFrame, entry_pins: DataFrame) -> DataFrame:
    """Share of a document's pins whose name the library entry also has."""
    ours = pins.groupBy("doc_id", F.upper("name").alias("_n")).agg(F.count(F.lit(1)).alias("_c"))
    theirs = entry_pins.select("doc_id", F.upper("name").alias("_n"), F.lit(1).alias("_hit")).distinct()
    return (
        ours.join(theirs, ["doc_id", "_n"], "full")
        .groupBy("doc_id")
        .agg(F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_c"))) / F.sum("_c"), F.lit(0.0))
             .alias("overlap"))
    )


def resolve_inheritance(entries: DataFrame) -> DataFrame:
    """One-level inheritance: an entry without pins takes its parent's count.

    ``entries(lib, key, parent_key, own_pins, ...)``; only parents in the same
    library that do not inherit themselves count.
    """
    parents = entries.filter("parent_key is null").groupBy("lib", F.col("key").alias("parent_key")).agg(
        F.max("own_pins").alias("_inherited"))
    return (
        entries.join(parents, ["lib", "parent_key"], "left")
        .withColumn("pin_count", F.when(
            F.col("parent_key").isNotNull() & (F.col("own_pins") == 0),
            F.coalesce("_inherited", "own_pins")).otherwise(F.col("own_pins")))
        .drop("_inherited")
    )


def inherited_properties(properties: DataFrame, links: DataFrame) -> DataFrame:
    """Property rows of every entry after inheritance: the child's value first.

    ``properties(lib, key, prop, value)``, ``links(lib, key, parent_key)``.
    """
    wanted = links.filter("parent_key is not null")
    from_parent = wanted.join(
        properties.select("lib", F.col("key").alias("parent_key"), "prop",
                          F.col("value").alias("_parent")), ["lib", "parent_key"]
    ).select("lib", "key", "prop", "_parent")
    return (
        properties.join(from_parent, ["lib", "key", "prop"], "full")
        .select("lib", "key", "prop", F.coalesce("value", "_parent").alias("value"),
                F.when(F.col("value").isNull(), "parent").otherwise("own").alias("source"))
    )


def default_footprints(matches: DataFrame, entries: DataFrame) -> DataFrame:
    """Unmatched footprints fall back on the symbol's own ``lib:name`` at 50."""
    first = ordered.first_per_key(
        entries.select(F.col("lib").alias("symbol_lib"), F.col("name").alias("symbol_name"),
                       "ord", "footprint"), ["symbol_lib", "symbol_name"], ["ord"])
    parts = F.split("footprint", ":", 2)
    usable = (F.col("footprint_lib") == "") & F.contains("footprint", F.lit(":"))
    usable = F.coalesce(usable, F.lit(False))
    return matches.join(first.drop("ord"), ["symbol_lib", "symbol_name"], "left").select(
        "doc_id",
        F.when(usable, F.element_at(parts, 1)).otherwise(F.col("footprint_lib")).alias("footprint_lib"),
        F.when(usable, F.element_at(parts, 2)).otherwise(F.col("footprint_name")).alias("footprint_name"),
        F.when(usable, 50.0).otherwise(F.col("footprint_score")).alias("footprint_score"),
    )


def add_thermal_pads(pins: DataFrame, thermal: DataFrame) -> DataFrame:
    """Thermal pads missing from a document join it as hidden ground pins.

    ``thermal(doc_id, number)`` lists the pads of the matched footprint.
    """
    added = thermal.select("doc_id", "number").join(
        pins.select("doc_id", "number"), ["doc_id", "number"], "left_anti"
    ).select("doc_id", "number", F.lit("GND").alias("name"), F.lit("power_in").alias("pin_type"),
             F.lit("Thermal pad").alias("description"), F.lit(True).alias("is_hidden"))
    return pins.select("doc_id", "number", "name", "pin_type", "description",
                       F.lit(False).alias("is_hidden")).unionByName(added)


def auto_select_package(candidates: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Package whose code equals the number's suffix, else the only candidate.

    Documents without a suffix row still get their only candidate.
    """
    hit = (F.col("code") != "") & (F.upper("code") == F.upper("suffix"))
    return (
        # By merging: one row per document is too much to broadcast, whatever its packed files measure.
        candidates.join(suffixes.hint("merge"), "doc_id", "left")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("candidates"),
             F.min_by("name", F.when(hit, F.col("cand_pos"))).alias("_by_code"),
             F.min("name").alias("_only"))
        .select("doc_id", "candidates",
                F.coalesce("_by_code", F.when(F.col("candidates") == 1, F.col("_only")))
                .alias("selected"))
    )


def overlay_edits(pins: DataFrame, edits: DataFrame, fields) -> DataFrame:
    """Reviewed values replace extracted ones, field by field, by position."""
    named = edits.select("doc_id", "row_pos", *[F.col(f).alias(f"_e_{f}") for f in fields])
    joined = pins.join(named, ["doc_id", "row_pos"], "left")
    return joined.select(*[
        F.coalesce(f"_e_{c}", c).alias(c) if c in fields else F.col(c) for c in pins.columns])


def apply_to_symbol(entry_pins: DataFrame, pins: DataFrame, mapping: DataFrame) -> DataFrame:
    """Library pins take name and type of the document pin mapped to them.

    ``pins(doc_id, row_pos, number, name, pin_type)`` lists alternates as rows of
    their own. When two document pins map to one library pin, the later wins.
    """
    by_number = pins.groupBy("doc_id", F.col("number").alias("ds_number")).agg(
        F.max_by(F.struct("name", "pin_type"), "row_pos").alias("_pin"))
    inverted = (
        mapping.join(by_number, ["doc_id", "ds_number"])
        .groupBy("doc_id", F.col("sym_number").alias("number"))
        .agg(F.max_by("_pin", "row_pos").alias("_pin"))
    )
    return entry_pins.join(inverted, ["doc_id", "number"], "left").select(
        "doc_id", "number",
        F.coalesce("_pin.name", "name").alias("name"),
        F.coalesce("_pin.pin_type", "pin_type").alias("pin_type"),
        F.col("_pin").isNotNull().alias("updated"),
    )


def clone_or_build(merged: DataFrame, entries: DataFrame) -> DataFrame:
    """Clone the matched symbol only when its pin count equals the physical pins.

    ``merged(doc_id, alt_count)`` are merged pins, ``entries(doc_id, pin_count)``
    the matched index entry (absent when nothing matched).
    """
    physical = merged.groupBy("doc_id").agg(F.sum(F.lit(1) + F.col("alt_count")).alias("physical_pins"))
    return physical.join(entries, "doc_id", "left").select(
        "doc_id", "physical_pins", "pin_count",
        F.when(F.col("pin_count") == F.col("physical_pins"), "clone").otherwise("build").alias("action"))


def infer_models(footprints: DataFrame, files: DataFrame) -> DataFrame:
    """3D model file by naming rule: ``.wrl`` when listed, else ``.step``, else none."""
    stem = F.concat(F.col("lib"), F.lit(".3dshapes/"), F.col("name"))
    listed = files.select("path").distinct()
    return (
        footprints.withColumn("_wrl", F.concat(stem, F.lit(".wrl")))
        .withColumn("_step", F.concat(stem, F.lit(".step")))
        .join(listed.select(F.col("path").alias("_wrl"), F.lit(True).alias("_has_wrl")), "_wrl", "left")
        .join(listed.select(F.col("path").alias("_step"), F.lit(True).alias("_has_step")), "_step", "left")
        .select("lib", "name", F.when(F.col("_has_wrl"), F.col("_wrl"))
                .when(F.col("_has_step"), F.col("_step")).alias("model"))
    )


# --- comparison with known pins -----------------------------------------------------

def _side(pins: DataFrame, pos: str, side: str) -> DataFrame:
    """One row per number a pin goes by; alternates follow it and are not listed pins."""
    alternates = F.col("alt_numbers") if "alt_numbers" in pins.columns else F.array().cast("array<string>")
    numbers = F.concat(F.array("number"), F.coalesce(alternates, F.array().cast("array<string>")))
    return pins.select("doc_id", "name", F.col(pos).alias("_p"), F.posexplode(numbers).alias("_i", "number")).select(
        "doc_id", "number", "name", F.struct("_p", "_i").alias("pos"), F.lit(side).alias("_side"),
        F.when(F.col("_i") == 0, 1).otherwise(0).alias("_listed"))


def diff_rows(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Pin-by-pin outcome: ok, renamed, missing, extra or thermal.

    ``extracted(doc_id, number, name, row_pos[, alt_numbers])``, ``expected(…, pin_pos)``.
    Every alternate number of an extracted pin is found under its name, while the
    counts of listed pins leave alternates out. For each number the last name wins
    and the first place counts; a null name is a name, not a missing pin. Both
    sides meet in one aggregate, and names are compared once per distinct pair. Few rows share
    a number, so they are dealt out first and sorted once: an aggregate of names sorts, and before
    the shuffle it would do so with all rows of a task beside those that the task numbers.
    """
    both = _side(extracted, "row_pos", "a").unionByName(_side(expected, "pin_pos", "b")).repartition("doc_id", "number")

    def of(side, value):
        return F.when(F.col("_side") == side, value)

    met = both.groupBy("doc_id", "number").agg(*[
        agg for s in ("a", "b") for agg in (
            F.max_by(F.struct("name"), of(s, F.col("pos")))["name"].alias(f"{s}_name"),
            F.min(of(s, F.col("pos"))).alias(f"{s}_pos"),
            F.sum(of(s, F.col("_listed"))).alias(f"{s}_listed"))])
    label = F.upper("number").isin(L.THERMAL_LABELS) | F.upper(R.strip(F.col("a_name"))).isin(
        L.THERMAL_LABELS)
    side = (
        F.when(F.col("a_listed").isNull(), "missing")
        .when(F.col("b_listed").isNull(), F.when(label, "thermal").otherwise("extra"))
        .when(F.upper(R.strip(F.col("a_name"))).eqNullSafe(F.upper(R.strip(F.col("b_name")))), "ok")
        .otherwise("differs")
    )
    rows = staged(met.withColumn("side", side), "diff")
    judged = judged_pairs(rows.filter("side = 'differs'"), "a_name", "b_name")
    return rows.join(judged, ["a_name", "b_name"], "left").withColumn(
        "status", F.when(F.col("side") != "differs", F.col("side"))
        .when(F.col("same"), "ok").otherwise("renamed")).drop("same")


def reconcile_thermal(rows: DataFrame) -> DataFrame:
    """(doc_id, number) of missing pins taken over by thermal pads.

    A thermal pad under a label ("EP") takes the first free missing pin of
    equivalent name; pads choose in order. Names meet by the keys of their forms, once per
    document and name, and pads whose names agree with the same names of gaps are one class.
    Where no other class agrees with a class's gaps, its n pads take its first n gaps: a count
    and a numbering, without any pair of a pad and a gap. Other classes of a document choose in turn
    (``_in_turn``).
    """
    pads = rows.filter("side = 'thermal'").select("doc_id", "a_pos", "a_name")
    gaps = rows.filter("side = 'missing'").select("doc_id", "number", "b_pos", "b_name")

    every = pads.select(F.col("a_name").alias("_name")).union(gaps.select("b_name")).filter("_name is not null").distinct()
    named = staged(every.withColumn("_forms", N.name_forms(F.col("_name"))).withColumn("_keys", N.match_keys(F.col("_forms"))), "thermal-names")

    def keyed(side: DataFrame, name: str) -> DataFrame:
        keys = named.select(F.col("_name").alias(name), F.explode("_keys").alias("_k"))
        return side.select("doc_id", name).distinct().join(keys, name)

    def formed(name: str, out: str) -> DataFrame:
        return named.select(F.col("_name").alias(name), F.col("_forms").alias(out))

    meeting = staged(keyed(pads, "a_name").join(keyed(gaps, "b_name"), ["doc_id", "_k"])
                     .select("doc_id", "a_name", "b_name").distinct(), "thermal-meetings")
    same = meeting.select("a_name", "b_name").distinct().join(formed("a_name", "_fa"), "a_name").join(
        formed("b_name", "_fb"), "b_name").filter(N.same_pin_name(F.col("_fa"), F.col("_fb")))
    agree = meeting.join(same.select("a_name", "b_name"), ["a_name", "b_name"])
    classes = agree.groupBy("doc_id", "a_name").agg(F.sort_array(F.collect_set("b_name")).alias("_names"))
    members = classes.select("doc_id", "_names").distinct().select("doc_id", "_names", F.explode("_names").alias("b_name"))
    several = members.groupBy("doc_id", "b_name").agg((F.count(F.lit(1)) > 1).alias("_several"))
    kinds = members.join(several, ["doc_id", "b_name"]).groupBy("doc_id", "_names").agg(F.max("_several").alias("_shared"))
    asked = pads.join(classes, ["doc_id", "a_name"]).join(kinds, ["doc_id", "_names"])
    asked = staged(asked.select("doc_id", "_names", "_shared", "a_pos"), "thermal-pads")
    # A class of its own is known by its first name, which no other class has.
    counts = asked.filter("not _shared").groupBy("doc_id", "_names").agg(F.count(F.lit(1)).alias("_pads")).select(
        "doc_id", "_pads", F.array_min("_names").alias("_class"), F.explode("_names").alias("b_name"))
    numbered = ordered.positions(gaps.join(counts, ["doc_id", "b_name"]), ["doc_id", "_class"], ["b_pos"],
                                 [F.floor(F.col("b_pos._p") / ordered.BLOCK)], "_nth")
    alone = numbered.filter("_nth <= _pads").select("doc_id", "number")
    return alone.unionByName(_in_turn(asked.filter("_shared"), gaps))


def _in_turn(pads: DataFrame, gaps: DataFrame) -> DataFrame:
    """(doc_id, number) of the gaps taken by pads of classes that share names of gaps.

    ``pads(doc_id, _names, a_pos)``, ``gaps(doc_id, number, b_pos, b_name)``. Gaps of one name are taken in their order,
    so all that a turn changes is a counter per name: pads and gaps of a document are
    listed once, and the work is pads times names. No name needs more gaps than there are pads.
    """
    turns = pads.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a_pos", "_names"))).alias("_turns"))
    asked = pads.select("doc_id", F.explode("_names").alias("b_name")).groupBy("doc_id", "b_name").agg(F.count(F.lit(1)).alias("_pads"))
    numbered = ordered.positions(gaps.join(asked, ["doc_id", "b_name"]), ["doc_id", "b_name"], ["b_pos"],
                                 [F.floor(F.col("b_pos._p") / ordered.BLOCK)], "_nth").filter("_nth <= _pads")
    listed = (
        numbered.groupBy("doc_id", "b_name").agg(F.sort_array(F.collect_list(F.struct("b_pos", "number"))).alias("_gaps"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("b_name", "_gaps"))).alias("_kinds"))
    )
    kinds = F.col("_kinds")

    def turn(taken: Column, pad: Column) -> Column:
        def offer(n: Column, i: Column) -> Column:
            kind = F.get(kinds, i)
            mine = F.array_contains(pad["_names"], kind["b_name"]) & (n < F.size(kind["_gaps"]))
            return F.when(mine, F.struct(F.get(kind["_gaps"], n)["b_pos"].alias("b_pos"), i.alias("i")))

        best = F.array_min(F.transform(taken, offer))["i"]
        return F.transform(taken, lambda n, i: F.when(i == best, n + 1).otherwise(n))

    taken = F.aggregate("_turns", F.transform(kinds, lambda _: F.lit(0)), turn)
    return (
        turns.join(listed, "doc_id").withColumn("_taken", taken)
        .select("doc_id", F.explode(F.arrays_zip("_kinds", "_taken")).alias("_z"))
        .select("doc_id", F.explode(F.slice("_z._kinds._gaps", F.lit(1), F.col("_z._taken"))).alias("_g"))
        .select("doc_id", "_g.number")
    )


def pin_diff(extracted: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """Per document: missing, extra and renamed pins, match rate and verdict."""
    rows = diff_rows(extracted, expected)
    counts = rows.groupBy("doc_id").agg(
        F.coalesce(F.sum("a_listed"), F.lit(0)).alias("extracted_count"),
        F.coalesce(F.sum("b_listed"), F.lit(0)).alias("expected_count"),
        F.count("b_listed").alias("_expected"),
        F.count_if(F.col("status") == "missing").alias("_missing"),
        F.count_if(F.col("status") == "extra").alias("extra"),
        F.count_if(F.col("status") == "renamed").alias("renamed"),
    )
    taken = reconcile_thermal(rows).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_taken"))
    missing = F.col("missing")
    rate = F.bround(
        1.0 - (missing + F.col("renamed")) / F.greatest(F.col("_expected"), F.lit(1)), 3)
    if strict:
        passed = (missing == 0) & (F.col("extra") == 0) & (F.col("renamed") == 0)
    else:
        passed = (F.col("match_rate") >= 0.7) & (missing <= 2)
    return (
        counts.join(taken, "doc_id", "left")
        .withColumn("missing", F.col("_missing") - F.coalesce("_taken", F.lit(0)))
        .withColumn("match_rate", rate)
        .withColumn("status", F.when((F.col("_expected") > 0) & passed, "PASS").otherwise("FAIL"))
        .select("doc_id", "extracted_count", "expected_count", "missing", "extra", "renamed",
                "match_rate", "status")
    )


def set_compare(pins: DataFrame, truth: DataFrame) -> DataFrame:
    """Pin numbers missing from, extra in or common to both sides; one shuffle."""
    both = pins.select("doc_id", "number", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        truth.select("doc_id", "number", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return (
        both.groupBy("doc_id", "number").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
        .select("doc_id", "number", F.when(F.col("_a") == 0, "missing")
                .when(F.col("_b") == 0, "extra").otherwise("common").alias("side"))
    )


def expected_packages(expected: DataFrame, candidates: DataFrame, pins: DataFrame) -> DataFrame:
    """PASS / PARTIAL (n/m) / FAIL / NO_DATA per part, with a LOW_PINS flag.

    ``expected(doc_id, text)`` (no rows: nothing expected), ``candidates(doc_id,
    name)``, ``pins(doc_id, pin_count, min_pins)`` with one row per part.
    """
    low = F.lower
    hits = contains_join(expected.select("doc_id", low("text").alias("_e")), "_e",
                         candidates.select("doc_id", low("name").alias("_n")), "_n", by=["doc_id"])
    hits = hits.select("doc_id", "_e").distinct().withColumn("_found", F.lit(1))
    wanted = (
        expected.select("doc_id", low("text").alias("_e")).join(hits, ["doc_id", "_e"], "left")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("_want"), F.count("_found").alias("_have"))
    )
    got = candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_cands"))
    want, have = F.coalesce("_want", F.lit(0)), F.coalesce("_have", F.lit(0))
    status = (
        F.when(want == 0, F.when(F.coalesce("_cands", F.lit(0)) > 0, "PASS").otherwise("NO_DATA"))
        .when(have == want, "PASS")
        .when(have > 0, F.concat(F.lit("PARTIAL ("), have.cast("string"), F.lit("/"),
                                 want.cast("string"), F.lit(")")))
        .otherwise("FAIL")
    )
    short = (F.col("min_pins") > 0) & (F.col("pin_count") < F.col("min_pins"))
    return (
        pins.join(wanted, "doc_id", "left").join(got, "doc_id", "left")
        .select("doc_id", F.concat(status, F.when(short, " LOW_PINS").otherwise("")).alias("status"))
    )


def rule_checks(results: DataFrame, pins: DataFrame) -> DataFrame:
    """Issue rows (doc_id, rule, detail) of a finished result.

    ``results(doc_id, symbol, footprint, score, expect_symbol, expect_footprint,
    min_pins)``, ``pins(doc_id, row_pos, number, name, pin_type)``.
    """
    count = pins.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("number", F.when(F.contains("name", F.lit("±")), F.col("row_pos"))).alias("_pm"))
    r = results.join(count, "doc_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))

    def issue(cond, rule, detail):
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))

    def lacks(text, part):
        return ~F.contains(F.upper(text), F.upper(part))

    issues = F.array_compact(F.array(
        issue(lacks("symbol", "expect_symbol"), "symbol", F.col("symbol")),
        issue(F.col("score") < 50, "score", F.col("score").cast("int").cast("string")),
        issue(lacks("footprint", "expect_footprint"), "footprint", F.col("footprint")),
        issue(F.col("_n") < F.col("min_pins"), "pins", F.col("_n").cast("string")),
        issue(F.col("_pm").isNotNull(), "plus_minus", F.col("_pm")),
    ))
    whole = r.select("doc_id", F.explode(issues).alias("_i")).select("doc_id", "_i.rule", "_i.detail")
    power = (
        pins.filter(F.upper("name").isin(L.POWER_NAMES) & (F.col("pin_type") == "no_connect"))
        .join(results.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", F.lit("power_no_connect").alias("rule"), F.col("number").alias("detail"))
    )
    return whole.unionByName(power)


# --- merging ------------------------------------------------------------------------

def merge_pins(pins: DataFrame, power_only: bool = False) -> DataFrame:
    """Same-name pins merged under the first one, in long form.

    Every input pin stays one row: ``primary_number`` names the pin it was merged
    into and ``is_primary`` marks that pin. With ``power_only`` just power inputs
    merge and other pins stay as they are.
    """
    key = F.upper("name")
    if power_only:
        key = F.when(F.col("pin_type") == "power_in", key).otherwise(
            F.concat(F.lit("\x00"), F.col("row_pos").cast("string")))
    keyed = pins.withColumn("_g", key)
    first = keyed.groupBy("doc_id", "_g").agg(
        F.min_by("number", "row_pos").alias("primary_number"), F.min("row_pos").alias("primary_pos"))
    return keyed.join(first, ["doc_id", "_g"]).select(
        "doc_id", "row_pos", "number", "name", "pin_type", "primary_number", "primary_pos",
        (F.col("row_pos") == F.col("primary_pos")).alias("is_primary"))


def merged_heads(pins: DataFrame, power_only: bool = False) -> DataFrame:
    """One row per merged pin with the number of pins folded into it."""
    key = F.upper("name")
    if power_only:
        key = F.when(F.col("pin_type") == "power_in", key).otherwise(
            F.concat(F.lit("\x00"), F.col("row_pos").cast("string")))
    return (
        pins.groupBy("doc_id", key.alias("_g"))
        .agg(F.min_by(F.struct("row_pos", "number", "name", "pin_type"), "row_pos").alias("_p"),
             (F.count(F.lit(1)) - 1).alias("alt_count"))
        .select("doc_id", "_p.row_pos", "_p.number", "_p.name", "_p.pin_type", "alt_count")
    )


def nest_alternates(merged: DataFrame) -> DataFrame:
    """Sink form: merged pins with their alternate numbers as an ordered array."""
    alts = F.sort_array(F.collect_list(F.when(
        ~F.col("is_primary"), F.struct("row_pos", "number"))))
    return merged.groupBy("doc_id", "primary_pos").agg(
        F.min_by(F.struct("number", "name", "pin_type"), "row_pos").alias("_p"), alts.alias("_a")
    ).select("doc_id", F.col("primary_pos").alias("row_pos"), "_p.*",
             F.transform("_a", lambda x: x["number"]).alias("alt_numbers"))


def add_exposed_pad(pins: DataFrame, order=("row_pos",), block: Column | None = None) -> DataFrame:
    """Documents whose descriptions mention a pad but list none get an EP pin.

    The wording may run across two neighbouring descriptions, so the last
    non-blank description before each row is looked at as well.
    """
    low = F.lower("description")
    block = ordered.block_of(order[0]) if block is None else block
    seen = ordered.last_before(pins, ["doc_id"], list(order), F.when(R.strip(low) != "", low),
                               "_prev", block)
    split = F.coalesce(F.col("_prev").rlike(r"(power|thermal|exposed)\s*$"), F.lit(False)) & (
        low.rlike(r"^\s*pad"))
    docs = (
        seen.groupBy("doc_id")
        .agg(F.max(F.col("number") == "EP").alias("_ep"),
             F.max(low.rlike(L.PAD_DESCRIPTION) | split).alias("_pad"))
        .filter("_pad and not _ep")
    )
    added = docs.select("doc_id", F.lit("EP").alias("number"), F.lit("GND").alias("name"),
                        F.lit("power_in").alias("pin_type"),
                        F.lit("Exposed thermal pad").alias("description"))
    columns = ["doc_id", "number", "name", "pin_type", "description"]
    if "alt_functions" in pins.columns:
        columns.append("alt_functions")
        added = added.withColumn("alt_functions", F.array().cast("array<string>"))
    return pins.select(*columns).unionByName(added)


def fill_footprint_property(packages: DataFrame, table: DataFrame) -> DataFrame:
    """Footprint property of a copied symbol: by package code, then by name."""
    by_code = F.broadcast(table.select(F.col("key").alias("code"), F.col("footprint").alias("_c")))
    by_name = F.broadcast(table.select(F.col("key").alias("name"), F.col("footprint").alias("_n")))
    return packages.join(by_code, "code", "left").join(by_name, "name", "left").select(
        "doc_id", "cand_pos", "name", "code", F.coalesce("_c", "_n").alias("footprint"))


def lookup_gaps(codes: DataFrame, table: DataFrame, references: DataFrame) -> DataFrame:
    """Codes in use without a footprint, and references that are not ``lib:name``."""
    unmapped = codes.filter("code <> ''").select("code").distinct().join(
        F.broadcast(table.select(F.col("key").alias("code"))), "code", "left_anti"
    ).select(F.lit("code without footprint").alias("problem"), F.col("code").alias("value"))
    malformed = references.filter(~F.contains("footprint", F.lit(":"))).select(
        F.lit("reference without colon").alias("problem"), F.col("footprint").alias("value")).distinct()
    return unmapped.unionByName(malformed)


def registry_upsert(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Library registry after registering ``wanted(name, uri)``, with outcomes."""
    old, new = F.col("uri"), F.col("_new")
    outcome = (
        F.when(new.isNull(), "kept").when(old.isNull(), "added")
        .when(old == new, "unchanged").otherwise("replaced")
    )
    return current.select("name", "uri").join(
        wanted.select("name", F.col("uri").alias("_new")), "name", "full"
    ).select("name", F.coalesce("_new", "uri").alias("uri"), outcome.alias("outcome"))
