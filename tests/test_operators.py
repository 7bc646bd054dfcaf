"""Operators on small inputs: known values, brute force, split groups."""

import re

import pytest
from pyspark.sql import functions as F

from pinwright.functions import lookups as L
from pinwright.functions import names as N
from pinwright.functions import rules as R
from pinwright.operators import geometry as G
from pinwright.operators import ordered, pins, search, text
from pinwright.plans import fixtures as fx
from pinwright.plans.registry import QUERIES
from pinwright.sources import documents, libraries
from pinwright.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("a,b,same", [
    ("~{EN}", "EN", True), ("PA0/WKUP", "PA0", True), ("SO (IO1)", "SO/IO1", True), ("+", "1IN+", True),
    ("V_{CC}", "VCC", True), ("RT(X Y)", "SS", True), ("GPIO26 / ADC0", "GPIO26_ADC0", True), ("A", "B", False),
    ("/A", "/B", False), ("IN–", "VIN-", True), ("EN#", "~{EN}", True), ("OUT", "IN", False),
])
def test_same_names(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert N.judged_pairs(df, "a", "b").first()["same"] is same
    assert (N.equivalent_names(df, "a", df, "b").count() == 1) is same


def test_blocks_match_plain_windows(spark):
    rows = [("k", i, i % 7, None if i % 5 else i) for i in range(1, 400)] + [("z", 1, 3, None)]
    df = spark.createDataFrame(rows, "k string, p int, v int, w int")
    block = F.floor(F.col("p") / 16)
    got = {(r.k, r.p): (r.s, r.m, r.b) for r in ordered.last_before(
        ordered.running_min(ordered.running_sum(df, ["k"], ["p"], F.col("v"), "s", block), ["k"], ["p"],
                            -F.col("v"), "m", block), ["k"], ["p"], F.col("w"), "b", block).collect()}
    for k in ("k", "z"):
        total, low, last = 0, 99, None
        for _, p, v, w in sorted(r for r in rows if r[0] == k):
            total, low = total + v, min(low, -v)
            assert got[(k, p)] == (total, low, last)
            last = w if w is not None else last


def test_hot_key_is_split(spark):
    df = spark.range(500).select(F.lit(1).alias("k"), (F.col("id") % 10).alias("a"), F.col("id").alias("b"))
    df = df.union(spark.createDataFrame([(2, 5, 7)], "k int, a bigint, b bigint"))
    got = ordered.positions(df, ["k"], ["a", "b"], [F.col("a")], "n", hot_rows=100).collect()
    want = {(r.k, r.a, r.b): i for k in (1, 2) for i, r in enumerate(
        sorted((x for x in got if x.k == k), key=lambda r: (r.a, r.b)), 1)}
    assert len(got) == 501 and all(want[(r.k, r.a, r.b)] == r.n for r in got)


def test_tiered_search_equals_plain(spark):
    req = fx.parts(spark, SF).select(F.upper("part_number").alias("query"), "pin_count").union(
        spark.createDataFrame([("", 3), ("T", 3), ("PS", 0), ("RING", 4)], "query string, pin_count int"))
    fast = search.search_symbols(req, fx.symbols(spark, SF)).collect()
    plain = search.search_symbols_plain(req, fx.symbols(spark, SF)).collect()
    assert sorted(map(tuple, fast)) == sorted(map(tuple, plain)) and fast


def test_thermal_pads_choose_in_order(spark):
    a = spark.createDataFrame([(1, "EP", "GND", 1), (1, "TP", "PAD", 2), (1, "2", "X", 3)],
                              "doc_id int, number string, name string, row_pos int")
    b = spark.createDataFrame([(1, "9", "GND", 1), (1, "10", "GNDPAD", 2), (1, "2", "X", 3)],
                              "doc_id int, number string, name string, pin_pos int")
    row = pins.pin_diff(a, b, strict=True).first()
    assert (row.missing, row.extra, row.renamed, row.status) == (0, 0, 0, "PASS")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_top_symbols_equal_the_full_ranking(spark, k):
    import random

    dice = random.Random(k)
    words = ["AB", "ABC", "ABX", "B", "CAB", "XYZ", "", None, "Q1", "Q1X"]
    library = [(i, f"L{i % 3}", dice.choice(words[:6]) + dice.choice(["", "1", "X"]), dice.choice(words),
                dice.choice(words), dice.choice([3, 4, 8, None])) for i in range(300)]
    symbols = spark.createDataFrame(library, "ord long, lib string, name string, description string, keywords string, pin_count int")
    asked = spark.createDataFrame([(q, p) for q in ["A", "AB", "ABC", "Q1", "Q1X", "XYZ", "", "CAB1", "NONE", "Q", None] for p in (0, 3, 5, 8, None)],
                                  "query string, pin_count int")
    got = sorted(map(repr, search.top_symbols(asked, symbols, k).collect()))
    want = sorted(map(repr, search.top_matches(search.search_symbols_plain(asked, symbols), k).collect()))
    assert got == want and got


def _compared(rows):
    """Rows as ``diff_rows`` gives them: (doc_id, number, side, place, name)."""
    place = {"thermal": "a", "missing": "b"}
    return [(d, n, side, (p, 0) if place[side] == "a" else None, (p, 0) if place[side] == "b" else None,
             name if place[side] == "a" else None, name if place[side] == "b" else None)
            for d, n, side, p, name in rows]


COMPARED = "doc_id int, number string, side string, a_pos struct<_p:int,_i:int>, b_pos struct<_p:int,_i:int>, a_name string, b_name string"


def test_thermal_pads_against_one_after_the_other(spark):
    import random

    # Names that agree with several others ("A/B" with "A" and "B") make classes overlap.
    dice, names, rows = random.Random(5), ["AA", "AA/BB", "BB", "BB/CC", "CC", "DD", None], []
    for doc in range(60):
        pool = dice.sample(names, dice.randint(1, len(names)))
        for side, low in (("thermal", 1), ("missing", 100)):
            spots = dice.sample(range(50), dice.randint(0, 12))
            rows += [(doc, str(low + p), side, p, dice.choice(pool)) for p in spots]
    table = spark.createDataFrame(_compared(rows), COMPARED)
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    same = {(r.a, r.b) for r in N.judged_pairs(pairs.dropna(), "a", "b").filter("same").collect()}
    assert ("AA", "AA/BB") in same and ("AA/BB", "BB") in same and ("AA", "BB") not in same
    want = set()
    for doc in range(60):
        free = sorted((p, n, name) for d, n, side, p, name in rows if d == doc and side == "missing")
        for _, a in sorted(((p, name) for d, _, side, p, name in rows if d == doc and side == "thermal"), key=lambda x: x[0]):
            gap = next((g for g in free if (a, g[2]) in same), None)
            if gap:
                free.remove(gap)
                want.add((doc, gap[1]))
    got = [tuple(r) for r in pins.reconcile_thermal(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_many_thermal_pads_in_one_document(spark):
    import time

    n = 30_000
    side = F.when(F.col("id") < n, "thermal").otherwise("missing")
    at = F.struct(F.col("id").cast("int").alias("_p"), F.lit(0).alias("_i"))
    table = spark.range(2 * n).select(
        F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("number"), side.alias("side"),
        F.when(F.col("id") < n, at).alias("a_pos"), F.when(F.col("id") >= n, at).alias("b_pos"),
        F.when(F.col("id") < n, "AA").alias("a_name"), F.when(F.col("id") >= n, "AA").alias("b_name"))
    start = time.monotonic()
    assert pins.reconcile_thermal(table).count() == n
    # Now two kinds of pads whose gaps overlap, so that they choose in turn.
    mixed = table.withColumn("a_name", F.when((F.col("side") == "thermal") & (F.col("a_pos._p") % 2 == 0), "AA/BB").otherwise(F.col("a_name")))
    mixed = mixed.withColumn("b_name", F.when((F.col("side") == "missing") & (F.col("b_pos._p") % 2 == 0), "BB").otherwise(F.col("b_name")))
    assert pins.reconcile_thermal(mixed).count() == n
    assert time.monotonic() - start < 120  # pads times gaps would be 900 million pairs


def test_package_mentions_by_brute_force(spark):
    docs = fx.documents(spark, SF).select("doc_id", "text")
    want = []
    for d in docs.collect():
        for pat, name in L.PACKAGE_PATTERNS:
            want += [(d.doc_id, name.format(*m.groups())) for m in re.finditer(pat, d.text, re.I | re.A)]
    got = text.mentioned_packages(docs).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.name) for r in got] == sorted(want, key=lambda w: w[0])


@pytest.mark.parametrize("body,want", [
    ("Pin 1 – VCC\nPin 2 – GND\nPin 3 – IN", [("1", "VCC"), ("2", "GND"), ("3", "IN")]),
    ("Pin 201 – TEST\nPin 1 – VCC", [("1", "VCC")]), ("Pin 1 – VCC\nPin 1 – VCC2", [("1", "VCC")]),
    ("Pin No. Mnemonic Description\n1 VIN Supply\n2 GND Ground\nEPAD To ground\nTYPICAL use\n7 X no",
     [("1", "VIN"), ("2", "GND"), ("EP", "GND")]),
    ("PIN FUNCTIONS\nSHDN (Pin 1/Pin 3): Off.\nGND (Pins 4, 5,\nExposed Pad Pin 9/Pins 6, 7, Exposed Pad Pin 11): Gnd.",
     [("3", "SHDN"), ("6", "GND"), ("EP", "GND")]),
    ("N-channel MOSFET", [("1", "G"), ("2", "S"), ("3", "D")]), ("plain words", []),
])
def test_pins_from_text(spark, body, want):
    rows = text.pins_from_text(spark.createDataFrame([(1, body)], "doc_id int, text string")).orderBy("pos").collect()
    assert [(r.number, r.name) for r in rows] == want


@pytest.mark.parametrize("count,names", [
    (None, ["VCC", "GND", "IN"]), (2, ["VCC", "GND", "IN"]), (3, ["VCC", "GND", "IN"]), (4, ["G", "S", "D"]), (5, ["VCC", "GND", "IN"]),
])
def test_expected_pins_decide_about_the_standard_pinout(spark, count, names):
    body = "N-channel MOSFET\nPin 1 – VCC\nPin 2 – GND\nPin 3 – IN"
    docs = spark.createDataFrame([(1, body), (2, body)], "doc_id int, text string")
    hints = spark.createDataFrame([(1, count)], "doc_id int, pin_count int")
    rows = text.pins_from_text(docs, hints=hints).orderBy("pos").collect()
    assert [r.name for r in rows if r.doc_id == 1] == names
    assert [r.name for r in rows if r.doc_id == 2] == ["VCC", "GND", "IN"]


def test_library_files(spark, tmp_path):
    lib = tmp_path / "Reg.kicad_sym"
    lib.write_text('(kicad_symbol_lib (symbol "A" (property "Description" "x") (symbol "A_1_1" (pin power_in line '
                   '(at 0 1 90) (length 2.54) (name "V") (number "1")))) (symbol "B" (extends "A")))')
    (tmp_path / "Bad.kicad_sym").write_text('(kicad_symbol_lib (symbol "C"')
    nodes = libraries.shred(libraries.scan_symbol_files(spark, str(tmp_path)))
    got = {(r.name, r.extends, r.own_pins) for r in libraries.symbol_entries(nodes).collect()}
    assert got == {("A", "", 1), ("B", "A", 0)}
    pretty = tmp_path / "Pkg.pretty"
    pretty.mkdir()
    (pretty / "SO-2.kicad_mod").write_text('(footprint "SO-2" (pad "1" smd rect) (pad "" thru_hole oval) (pad 3 np_thru_hole))')
    assert libraries.scan_footprints(spark, str(tmp_path)).collect() == [("Pkg", "SO-2", 2)]


def test_a_scan_of_footprints_takes_no_task_per_few_files(spark, tmp_path):
    """Files are listed and read by as many tasks as the session asks for, however many they are."""
    from pinwright.sources import sinks
    names = [(f"{lib}.pretty/F{i}.kicad_mod", '(pad "1" smd rect)' * (i % 3)) for lib in ("A", "B") for i in range(300)]
    files = spark.createDataFrame([*names, ("A.pretty/note.txt", "x"), ("C/F.kicad_mod", "(pad 1 smd)")], "name string, content string")
    sinks.write_files(files, f"file://{tmp_path}")
    found = libraries.scan_footprints(spark, f"file://{tmp_path}")
    assert {(r.lib, r.name): r.pad_count for r in found.collect()} == {(n[0], n.split("/")[1][:-10]): c.count("pad") for n, c in names}
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_snapshot_is_reused(spark):
    folder, built = shared_folder(spark, "snap"), []

    def build():
        built.append(1)
        return spark.createDataFrame([("L", "A")], "lib string, name string")

    for force in (False, False, True):
        assert libraries.load_snapshot(spark, folder, build, force).count() == 1
    assert len(built) == 2


def test_empty_box(spark):
    none = spark.createDataFrame([], "k int, x double, y double")
    row = G.bounding_boxes(none, ["k"], spark.createDataFrame([(1,)], "k int")).first()
    assert (row.box_x, row.box_y, row.box_w, row.box_h) == (0.0, 0.0, 10.0, 10.0)


# --- streams over several batches -------------------------------------------------

def _in_files(spark, rows, folder, parts):
    """The event table as ``parts`` files in order of time, read one per batch."""
    ordered_rows = rows.sort("ts", "event_id").collect()
    size = -(-len(ordered_rows) // parts)
    for i in range(parts):
        spark.createDataFrame(ordered_rows[i * size:(i + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _streams(spark):
    from pinwright.functions import rules as R
    from pinwright.streaming import jobs, runner, usage

    def mail(df):
        return df.withColumn("email", R.normal_email(F.col("email")))

    def devices(df):
        return mail(df).withColumn("kind", F.when(F.col("event_type") == "signup", "clear").otherwise("ask"))

    def customers(df):
        return df.withColumn("customer_key", R.email_key(F.col("email")))

    return {
        "job_fold": (fx.JOB_COLUMNS, lambda e: runner.run_updates(jobs.fold_jobs(e), ["job_id"])),
        "job_expiry": (fx.JOB_COLUMNS, lambda e: runner.run_rows(jobs.expired_jobs(e))),
        "token_use": (fx.USAGE_COLUMNS, lambda e: runner.run_rows(usage.single_use_tokens(e.filter("mode = 'consume'")))),
        "quota": (fx.USAGE_COLUMNS, lambda e: runner.run_rows(usage.quota(mail(e)))),
        "device_binding": (fx.USAGE_COLUMNS, lambda e: runner.run_rows(usage.device_binding(devices(e)))),
        "customer_creation": (fx.USAGE_COLUMNS, lambda e: runner.run_rows(usage.customer_creation(customers(e)))),
        "customer_keys": (fx.USAGE_COLUMNS, lambda e: runner.run_rows(usage.unique_creations(e))),
    }


@pytest.mark.parametrize("name", ["job_fold", "job_expiry", "token_use", "quota", "device_binding",
                                  "customer_creation", "customer_keys"])
def test_streams_give_the_same_rows_in_several_batches(spark, tmp_path, name):
    from pinwright.streaming import runner

    runner.prepare(spark)
    columns, drain = _streams(spark)[name]
    events = spark.read.parquet(f"{SF}/events.parquet")
    if name == "customer_keys":  # within one day, so that no watermark passes between batches
        events = events.sort("ts", "event_id").limit(200).withColumn("ts", F.lit("2024-01-01 10:00:00").cast(events.schema["ts"].dataType))
    results = []
    for parts in (1, 4):
        stream = _in_files(spark, events, str(tmp_path / str(parts)), parts)
        results.append(sorted(map(repr, drain(stream.selectExpr(*columns)).collect())))
    assert results[0] and results[0] == results[1]
    if name == "job_expiry":
        jobs_seen = [r.split(",")[0] for r in results[1]]
        assert len(jobs_seen) == len(set(jobs_seen))


def test_marks_of_expired_jobs_end(spark, tmp_path):
    from pinwright.streaming import jobs, runner

    runner.prepare(spark)
    keep = 3600
    # Job k has an event in hour k; job 0 comes back after five hours, when its mark has ended.
    rows = [(h * 4, h, h * 3600 + m * 60) for h in range(12) for m in (0, 5)] + [(99, 0, 5 * 3600), (98, 1, 3600 + 50 * 60)]
    events = spark.createDataFrame(rows, "event_id long, job_id long, s long").selectExpr(
        "event_id", "job_id", "CAST(timestamp_seconds(1704067200 + s) AS timestamp_ntz) AS ts")
    results = []
    for parts in (1, 6):
        stream = _in_files(spark, events, str(tmp_path / f"marks{parts}"), parts).withColumn("ts", F.col("ts").cast("timestamp"))
        folder = shared_folder(spark, "marks")
        query = (jobs.expired_jobs(stream, keep_seconds=keep).writeStream.outputMode("append").format("parquet")
                 .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        results.append(sorted((r.job_id, r.created_ms // 1000 - 1704067200) for r in spark.read.parquet(f"{folder}/out").collect()))
    assert results[0] == results[1] == sorted([(h, h * 3600) for h in range(11)] + [(0, 5 * 3600)])
    assert held[-1] < 12 and held[-1] <= max(held[:-1])


def test_a_null_pin_name_is_a_name(spark):
    got = spark.createDataFrame([(1, "1", None, 1, ["4", "5"]), (1, "2", "GND", 2, None), (1, "9", "X", 3, [])],
                                "doc_id long, number string, name string, row_pos int, alt_numbers array<string>")
    want = spark.createDataFrame([(1, "1", "VCC", 1), (1, "2", None, 2), (1, "4", "VCC", 3), (1, "7", "A", 4)],
                                 "doc_id long, number string, name string, pin_pos int")
    rows = {r.number: r.status for r in pins.diff_rows(got, want).collect()}
    assert rows == {"1": "renamed", "2": "renamed", "4": "renamed", "5": "extra", "7": "missing", "9": "extra"}
    (row,) = pins.pin_diff(got, want).collect()
    assert (row.extracted_count, row.expected_count, row.missing, row.extra, row.renamed) == (3, 4, 1, 2, 3)


def test_alternates_reach_the_lookup(spark):
    got = spark.createDataFrame([(1, "2", "OUT", 1, ["3", "4"]), (1, "1", "VCC", 2, [])],
                                "doc_id long, number string, name string, row_pos int, alt_numbers array<string>")
    want = spark.createDataFrame([(1, str(i), n, i) for i, n in enumerate(["VCC", "OUT", "OUT", "OUT"], 1)],
                                 "doc_id long, number string, name string, pin_pos int")
    (row,) = pins.pin_diff(got, want, strict=True).collect()
    assert (row.extracted_count, row.missing, row.extra, row.renamed, row.status) == (2, 0, 0, 0, "PASS")


def test_same_names_stack_with_their_angle(spark):
    table = spark.createDataFrame(
        [(1, 1, "1", "out", 1.0, 2.0, 90), (1, 2, "2", "OUT", 5.0, 6.0, 0), (1, 3, "3", "OUT", None, None, None),
         (1, 4, "4", "IN", None, None, None), (1, 5, "5", "in", 7.0, 8.0, 180)],
        "doc_id long, pin_pos int, number string, name string, x double, y double, angle int")
    got = {r.number: (r.x, r.y, r.angle) for r in G.stack_same_names(table, "doc_id").collect()}
    assert got == {"1": (1.0, 2.0, 90), "2": (1.0, 2.0, 90), "3": (None,) * 3, "4": (None,) * 3, "5": (7.0, 8.0, 180)}


def test_the_last_new_symbol_of_a_name_stays(spark):
    from pinwright.sources import sinks

    old = spark.createDataFrame([("L", "A", 1, 3), ("L", "B", 2, 4)], "lib string, name string, ord long, pin_count int")
    new = spark.createDataFrame([("L", "B", 5, 8), ("L", "B", 7, 9), ("L", "C", 6, 1)], old.schema)
    assert sorted(map(tuple, sinks.upserted(old, new).collect())) == [("L", "A", 1, 3), ("L", "B", 7, 9), ("L", "C", 6, 1)]


def test_a_document_that_nothing_is_known_of_keeps_its_table(spark):
    cands = spark.createDataFrame([(1, 1, "SOIC-8", "D"), (2, 1, "DIP", ""), (2, 2, "SON", "")],
                                  "doc_id long, cand_pos int, name string, code string")
    none = spark.createDataFrame([], "doc_id long, suffix string")
    got = {r.doc_id: r.selected for r in pins.auto_select_package(cands, none).collect()}
    assert got == {1: "SOIC-8", 2: None}


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    from pinwright.sources.shared import shared_root

    conf = {"spark.sql.warehouse.dir": "file:/w"}
    session = lambda master: N(conf=N(get=lambda k, d=None: conf.get(k, d)), sparkContext=N(master=master))
    with pytest.raises(ValueError):
        shared_root(session("spark://host:7077"))
    assert shared_root(session("local[4]")) == "file:/w/staged"
    conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert shared_root(session("spark://host:7077")) == "hdfs://x/y"


@pytest.mark.parametrize("by", [[], ["g"]])
def test_contains_join_equals_the_plain_form(spark, by):
    import random

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ABC-é") for _ in range(n))
    qs = [(i % 2, q) for i, q in enumerate(["", "A", "é", "AB", "ZZ", "ABC", *[word(rng.randint(1, 6)) for _ in range(40)], None])]
    ts = [(i % 2, t) for i, t in enumerate(["", "A", "BA", None, *[word(rng.randint(0, 12)) for _ in range(60)]])]
    got = search.contains_join(spark.createDataFrame(qs, "g int, q string"), "q",
                               spark.createDataFrame(ts, "g int, t string"), "t", by)
    want = {(*([g] if by else []), q, t) for g, q in qs for h, t in ts
            if q is not None and t is not None and q in t and (not by or g == h)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_search_has_no_pairing_without_a_key(spark, threshold):
    """Also with the empty query, which every entry answers at the prefix score."""
    symbols = fx.symbols(spark, SF).limit(60)
    asked = spark.createDataFrame([("", 0), ("", 5), ("AD8", 4), ("XYZ12", 0), ("S", 0)], "query string, pin_count int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = search.search_symbols(asked, symbols)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(tuple, got.collect()))
        feet = search.search_footprints(asked, fx.footprints(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search("NestedLoop|Cartesian", plan + feet)
    assert rows == sorted(map(tuple, search.search_symbols_plain(asked, symbols).collect()))
    assert sum(r[0] == "" for r in rows) == 120


def test_late_requests_are_judged_on_arrival(spark, tmp_path):
    """The second file brings a request from before the first file's, and the third one comes after the token's life."""
    from pinwright.streaming import runner, usage

    runner.prepare(spark)
    schema = "event_id long, generation_id string, email string, ts timestamp, mode string"
    files = [[(1, "g", "a", "2024-01-01 10:02:00"), (2, "g", "a", "2024-01-01 10:03:00"), (3, "h", "b", "2024-01-01 10:03:00")],
             [(4, "g", "a", "2024-01-01 10:01:00"), (5, "k", "a", "2024-01-01 10:01:30")],
             [(6, "g", "a", "2024-01-01 18:00:00"), (7, "g", "a", "2024-01-01 18:04:59"), (8, "g", "a", "2024-01-01 18:05:01")]]
    for rows in files:
        spark.createDataFrame([(i, g, e, t, "consume") for i, g, e, t in rows], schema.replace("ts timestamp", "ts string")).withColumn(
            "ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tokens = {r.event_id: r.verdict for r in runner.run_rows(usage.single_use_tokens(stream())).collect()}
    yes, no = "accepted", "already_used"
    assert tokens == {1: yes, 2: no, 3: yes, 4: no, 5: yes, 6: yes, 7: no, 8: yes}
    allowed = {r.event_id for r in runner.run_rows(usage.quota(stream())).where("allowed").collect()}
    assert allowed == {1, 2, 3, 4}  # two of the first file, one of the second: the earliest


def test_areas_that_differ_by_rounding_are_equal(spark):
    """0.7 x 0.3 and 2.1 x 0.1 are one area; the product of the second is greater by its last bit."""
    rows = [(7, 1, 0.1, 0.1), (7, 2, 0.7, 0.3), (7, 3, 2.1, 0.1), (7, 4, 0.1, 0.1), (7, 5, 0.1, 0.1)]
    pads = spark.createDataFrame(rows, "footprint_id long, pad_pos int, w double, h double").withColumn(
        "number", F.col("pad_pos").cast("string"))
    assert 2.1 * 0.1 > 0.7 * 0.3
    assert [r["exposed_pad"] for r in G.exposed_pads(pads, "footprint_id").collect()] == ["2"]


def test_the_first_of_equal_areas_is_the_exposed_pad_of_the_map(spark):
    pads = spark.createDataFrame([(7, 1, 0.1, 0.1), (7, 2, 0.7, 0.3), (7, 3, 2.1, 0.1), (7, 4, 0.1, 0.1), (7, 5, 0.1, 0.1)],
                                 "doc_id long, pad_pos int, w double, h double").withColumn("number", F.col("pad_pos").cast("string"))
    rows = spark.createDataFrame([(7, 1, "EP", "GND"), (7, 2, "3", "OUT")], "doc_id long, row_pos int, number string, name string")
    mapped = G.pad_pin_map(rows, G.exposed_pads(pads, "doc_id"))
    assert {r["pad"]: r["primary_pin"] for r in mapped.collect()} == {"EP": "EP", "2": "EP", "3": "3"}


def test_every_order_of_the_tier_is_loaded_as_truth(spark):
    got = QUERIES["truth_load"](spark, SF).select("pn").distinct().count()
    orders = fx.table(spark, SF, "orders").filter("o_orderkey % 3 in (0, 1) and startswith(cast(o_orderkey as string), '1')")
    assert orders.filter("o_orderkey % 37 = 0").count() > 0 and got == orders.select("o_orderkey").distinct().count()


def test_a_damaged_line_does_not_end_the_others(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"pn":"a","pins":[{"number":"1"}]}\n{"pn":"b","pi\n{"family":"x"}\n{"pn":"c","pins":[]}\n')
    assert sorted(r["pn"] for r in documents.read_truth(spark, str(tmp_path)).collect()) == ["a", "c"]


def test_packages_of_documents_are_not_broadcast(spark):
    """A row per document in a few bytes of Parquet is no small table."""
    joined = QUERIES["package_auto_select"](spark, SF)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tokens_are_judged_in_buckets(spark, tmp_path):
    """A batch costs state and calls by bucket, not by id; rows that come out of order keep their ids and verdicts."""
    from pinwright.functions import lookups as L
    from pinwright.streaming import runner, usage

    runner.prepare(spark)
    rows = [(i, None if i % 50 == 0 else f"g{i * 7919 % 200}", 1_000_000 + i * 104729 % 3001) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, generation_id string, s long").select(
        "event_id", "generation_id", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, generation_id string, ts timestamp").parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.generation_id, r.verdict) for r in runner.run_rows(usage.single_use_tokens(stream, buckets=4)).collect()}
    first, want = {}, {}
    for i, g, at in sorted(rows, key=lambda r: (r[2], r[0])):
        fresh = g not in first or at - first[g] > L.TOKEN_SECONDS
        first[g] = at if fresh else first[g]
        want[i] = (g, "accepted" if fresh else "already_used")
    assert got == want
    run = (usage.single_use_tokens(stream, buckets=4).writeStream.format("noop").trigger(availableNow=True)
           .option("checkpointLocation", str(tmp_path / "state")).start())
    run.awaitTermination()
    assert max(s["numRowsTotal"] for p in run.recentProgress for s in p["stateOperators"]) <= 4


def test_headings_are_not_dealt_out_by_their_text(spark):
    """A text that half of all tables have must not be one task's; rare texts are judged in place, with the same result."""
    from pinwright.operators import tables as T

    cells = spark.createDataFrame(
        [(d, 1, 0, r, c, t) for d in range(40) for r, row in enumerate([["Name", "Pin No.", f"Type {d}"], ["VCC", "1", "I"]])
         for c, t in enumerate(row)], "doc_id long, page_num int, table_seq int, row_idx int, col_idx int, text string")
    plans, rows, before = [], [], T.OFTEN
    try:
        for T.OFTEN in (10, 10_000):
            heads = T.detect_headers(cells)
            plans.append(heads._jdf.queryExecution().executedPlan().toString())
            rows.append(sorted((r.doc_id, r.form, str(r.heads)) for r in heads.collect()))
    finally:
        T.OFTEN = before
    assert rows[0] == rows[1] and len(rows[0]) == 40
    assert all("LeftOuter, BuildRight" in p and not re.search(r"Join \[_key[^\]]*\], \[[^\]]*\], Inner", p) for p in plans)


def test_rows_of_one_name_are_one_file(spark, tmp_path):
    from pinwright.sources import sinks

    rows = spark.createDataFrame([(f"{i % 3}.txt", i, f"row {i}") for i in range(300)], "name string, part long, content string")
    sinks.write_files(rows.repartition(7), f"file://{tmp_path}", "part")
    assert {f.name: f.read_text() for f in tmp_path.iterdir() if not f.name.startswith(".")} == {
        f"{k}.txt": "\n".join(f"row {i}" for i in range(k, 300, 3)) for k in range(3)}


def test_gaps_split_each_part_number_once(spark):
    plan = QUERIES["lookup_gaps"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [part_number"):]
    assert "regexp" not in below and "RLIKE" not in below


def test_the_pins_of_a_number_are_sorted_once(spark, monkeypatch):
    """Both sides are dealt out by number before they are aggregated: no task sorts them before the shuffle as well."""
    plans, written = [], pins.staged

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(pins, "staged", kept)
    got = spark.createDataFrame([(1, 1, "1", "VCC"), (1, 2, "1", "VDD"), (1, 3, "2", "GND")], "doc_id long, row_pos int, number string, name string")
    want = spark.createDataFrame([(1, 1, "1", "VDD"), (1, 2, "3", "OUT")], "doc_id long, pin_pos int, number string, name string")
    rows = pins.diff_rows(got, want).collect()
    assert {r["number"]: r["status"] for r in rows} == {"1": "ok", "2": "extra", "3": "missing"}
    assert plans[0].index("Exchange") > plans[0].rindex("partial_max_by")


def test_a_part_number_is_split_once_for_all_its_documents(spark, monkeypatch):
    kept, written = {}, search.staged
    monkeypatch.setattr(search, "staged", lambda df, label: kept.setdefault(label, written(df, label)))
    docs = spark.createDataFrame([(1, "TPS7DBVR", "ic", 3), (2, " tps7dbvr", "ic", 3), (3, "TPS7", "ic", 3), (4, None, "ic", 3)],
                                 "doc_id long, part_number string, component_type string, pin_count int")
    symbols = spark.createDataFrame([(9, "L", "TPS7", "d", "k", 3)], "ord long, lib string, name string, description string, keywords string, pin_count int")
    pins_of = spark.createDataFrame([(1, "VCC")], "doc_id long, name string")
    found = search.match_symbols(docs, symbols, pins_of, pins_of.withColumnRenamed("doc_id", "ord"), [])
    assert {r["doc_id"]: r["symbol_ord"] for r in found.collect()} == {1: 9, 2: 9, 3: 9, 4: None}
    assert {(r["_pn"], r["_base"]) for r in kept["bases"].collect()} == {("TPS7DBVR", "TPS7"), ("TPS7", "TPS7")} and kept["bases"].count() == 2


def test_pads_of_a_large_footprint_map_as_in_the_sql(spark, tmp_path):
    """In a footprint of 12,000 pads the first is a hundredth smaller than the last."""
    import duckdb

    from oracles import ORACLES

    con = duckdb.connect()
    con.execute(f"""copy (select case when i < 3 then 1 else i + 10 end as l_orderkey, 1::bigint as l_partkey,
        case when i = 1 then 23::bigint else 1 end as l_suppkey, 1 + i::int % 7 as l_linenumber,
        case i when 1 then 47.0::double when 12000 then 16 else 1 end as l_quantity, i + 0.5::double as l_extendedprice,
        case i when 12000 then 0.01::double else 0 end as l_discount, 0.0::double as l_tax, 'N' as l_returnflag
        from range(1, 12001) t(i)) to '{tmp_path}/lineitem.parquet'""")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    for name in ("pad_pin_map", "exposed_pad"):
        got = QUERIES[name](spark, str(tmp_path))
        theirs = con.execute(f"select {', '.join(got.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(theirs)


def test_pins_without_a_document_are_mapped(spark):
    rows = spark.createDataFrame([(None, 1, "1", "GND"), (None, 2, "2", "gnd"), (7, 1, None, "A"), (7, 2, "4", "B"), (7, 3, "4", "a")],
                                 "doc_id long, row_pos int, number string, name string")
    none = spark.createDataFrame([], "doc_id long, exposed_pad string")
    assert {(r["doc_id"], r["pad"], r["primary_pin"]) for r in G.pad_pin_map(rows, none).collect()} == {
        (None, "1", "1"), (None, "2", "1"), (7, None, None), (7, "4", "4")}


def test_pins_of_a_layout_are_numbered_once(spark):
    """Heads, folded pins and pads come from one stored table of numbered pins, not from the lines again."""
    assert not [f for f in QUERIES["grid_layout"](spark, SF).inputFiles() if "lineitem" in f]


def test_package_strategies_are_found_once(spark):
    """What the strategies found is stored; the choice among them reads no text again. Bases are found in either case of letters."""
    docs = spark.createDataFrame([(1, "tps1", "", "order TPS1dbv, Tps1PWPR"), (2, "TPS2", "", "none named, SOIC-8"), (3, "TPS3", "", None)],
                                 "doc_id long, base string, maker string, text string")
    found = text.all_packages(docs)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["code"], r["tier"]) for r in found.collect()) == [(1, "DBV", 1), (1, "PWP", 1), (2, "", 2)]


def test_heading_cells_are_stored_by_table(spark):
    """Twelve columns in four forms are one row of a table when they are stored and dealt out, not one for each cell and form."""
    from pinwright.operators import tables as T
    from pinwright.sources import shared

    cells = spark.range(50).selectExpr("id AS doc_id", "explode(sequence(0, 3)) AS row_idx").selectExpr("*", "explode(sequence(0, 11)) AS col_idx").selectExpr(
        "doc_id", "1 AS page_num", "0 AS table_seq", "row_idx", "col_idx",
        """CASE WHEN row_idx = 2 AND col_idx = 0 THEN 'NAME' WHEN row_idx = 2 AND col_idx = 1 THEN 'NO.'
           WHEN row_idx = 1 AND col_idx < 2 THEN '' ELSE concat('x', row_idx, col_idx) END AS text""")
    before = len(shared._given)
    heads = T.detect_headers(cells).collect()
    assert len(heads) == 50 and {(r.form, r.data_start, len(r.heads)) for r in heads} == {(5, 3, 12)}
    (stored,) = [f for f in shared._given[before:] if "headings" in f]
    assert spark.read.parquet(stored).count() == 50
