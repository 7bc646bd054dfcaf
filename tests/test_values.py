"""Known values of the rules, independent of the SQL counterparts."""

import pytest
from pyspark.sql import functions as F

from pinwright.functions import rules as R
from pinwright.operators import pins as P
from pinwright.operators import search, tables as T
from pinwright.plans import datasheets

# Name, type: what a name alone decides, and names that no pattern knows.
NAMES = [
    ("DGND", "power_in"), ("OUTB", "output"), ("GPIO4", "bidirectional"), ("ALERT", "open_collector"),
    ("GATE1", "passive"), ("XTAL", "passive"), ("Q3", "passive"), ("ILIM", "passive"),
]
# Description, type of a pin whose name says nothing; plain "output" needs no "input" beside it.
DESCRIPTIONS = [
    ("regulator output without any", "output"), ("half-bridge output and input", "output"), ("supply voltage", "power_in"),
    ("open drain flag", "open_collector"), ("chip select input", "input"), ("connect to ground plane", "power_in"),
    ("bidirectional data line", "bidirectional"), ("no internal connection", "passive"), ("clock", "passive"),
]


@pytest.mark.parametrize("name,want", NAMES)
def test_pin_types(spark, name, want):
    assert spark.range(1).select(R.infer_pin_type(F.lit(name), F.lit("")).alias("k")).first()["k"] == want


@pytest.mark.parametrize("text,want", DESCRIPTIONS)
def test_pin_type_by_description(spark, text, want):
    assert spark.range(1).select(R.infer_pin_type(F.lit("QQQ"), F.lit(text)).alias("k")).first()["k"] == want


# Cell, numbers: list marks, blanks between them, pad words in any case, and what is no number.
NUMBERS = [
    ("17", ["17"]), ("12 ", ["12"]), ("8; 9 ;10", ["8", "9", "10"]), ("4\n5,6", ["4", "5", "6"]), ("7,,8", ["7", "8"]),
    ("11,EP", ["11", "EP"]), ("EP;3", ["EP", "3"]), ("Power Pad", ["EP"]), ("exposed PAD", ["EP"]),
    ("n/a", []), ("A7", []), ("1-4", []), (" ", []), (None, []),
]


def test_pin_numbers(spark):
    table = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(NUMBERS)], "i int, c string").select(
        "i", R.pin_numbers(F.col("c")).alias("n"))
    assert {r.i: r.n for r in table.collect()} == {i: w for i, (_, w) in enumerate(NUMBERS)}


# Part number, base, code: the first listed suffix, a stripped reel mark, and marks that go in any case.
SUFFIXES = [
    ("XQ100PWPR", "XQ100", "PWP"), ("ABC7RGER", "ABC7", "RGE"), ("LT55DR", "LT55", "D"), ("K1DGKR-Q1", "K1", "DGK"),
    ("ADS1115IDGSR", "ADS1115I", "DGS"), ("X1QDRR", "X1", "QD"), ("QX9-Q1", "QX9", None), ("ZZZ", "ZZZ", None), ("MM5DBVT", "MM5DBVT", None),
]


def test_suffixes(spark):
    rows = R.split_suffix(spark.createDataFrame([(p,) for p, _, _ in SUFFIXES], "v string"), "v").collect()
    assert sorted((r.v, r.base, r.code or "") for r in rows) == sorted((v, b, c or "") for v, b, c in SUFFIXES)


def cells(spark, tables):
    """Cells of the tables of documents: {doc: [(page, rows)]}."""
    rows = [(d, page, seq, r, c, text) for d, ts in tables.items() for seq, (page, body) in enumerate(ts)
            for r, line in enumerate(body) for c, text in enumerate(line)]
    return spark.createDataFrame(
        rows, "doc_id long, page_num int, table_seq int, row_idx int, col_idx int, text string")


# Document, table, row at which the pins begin; none where no heading has both roles.
HEADINGS = {
    10: ([["Terminal", "Signal Name"], ["Pin", "Name"], ["A", "x"], ["7", "RUN"]], 2),
    11: ([["No.", "Name", "Function"], ["3", "RUN", "Starts the motor"]], 1),
    12: ([["Ball map"], ["Name", "No."], ["RUN", "3"]], 2),
    13: ([["Ball map"], ["", "PIN"], ["NAME", "NO."], ["RUN", "3"]], 3),
    14: ([["Parameter", "Typical"], ["Current", "2 A"]], None),
    15: ([["Pin No."]], None),
}


def test_headings(spark):
    got = T.detect_headers(cells(spark, {d: [(1, body)] for d, (body, _) in HEADINGS.items()})).collect()
    assert {r.doc_id: r.data_start for r in got} == {d: s for d, (_, s) in HEADINGS.items() if s is not None}


HEAD = ["No.", "Name", "Type", "Function"]
POWER = [["1", "VDD", "P", "Supply of the core"], ["2", "VSS", "P", "Return"]]
BUS = [["3", "SDA", "I/O", "Data"], ["4", "SCL", "I", "Clock"], ["5", "ALERT", "O", "Flag"]]
DATASHEETS = {  # tables, pins looked for, pins found
    1: ([(1, [HEAD, *POWER, *BUS])], 0, 5),
    2: ([(1, [["Parameter", "Typical"], ["Current", "2 A"]])], 0, 0),
    3: ([(1, [HEAD, POWER[1], POWER[0], POWER[1]])], 0, 2),  # a number twice
    4: ([(6, [HEAD, *POWER]), (7, [HEAD, *BUS])], 0, 5),  # goes on over the page
    5: ([(1, [HEAD, *BUS]), (9, [["Name", "Pin"], ["RUN", "1"], ["STOP", "2"]])], 2, 2),  # the exact count wins
}


@pytest.mark.parametrize("known", [True, False])
def test_pins_of_tables(spark, known):
    """With and without a row of what is looked for; document 5 needs one."""
    wanted = [(d, n, "", "") for d, (_, n, _) in DATASHEETS.items() if known]
    wanted = spark.createDataFrame(wanted, "doc_id long, expected_count int, package string, base string")
    groups = T.table_groups(T.layouts(T.detect_headers(cells(spark, {d: t for d, (t, _, _) in DATASHEETS.items()}))))
    rows = T.read_pins(cells(spark, {d: t for d, (t, _, _) in DATASHEETS.items()}), groups)
    best = T.best_pins(rows, T.score_groups(rows, groups, wanted)).collect()
    found = {d: sum(r.doc_id == d for r in best) for d in DATASHEETS}
    want = {d: n for d, (_, _, n) in DATASHEETS.items()}
    assert {d: found[d] for d in (1, 2, 3, 4)} == {d: want[d] for d in (1, 2, 3, 4)}
    assert found[5] == (want[5] if known else 3)
    first = {r.number: (r.name, r.pin_type) for r in best if r.doc_id == 1}
    assert first["1"] == ("VDD", "power_in") and first["3"] == ("SDA", "bidirectional") and first["5"] == ("ALERT", "output")


def test_flow_over_tables(spark):
    tables = {1: [(1, [HEAD, *POWER, ["3", "VIO", "P", "Supply of the pins; solder the thermal pad to a plane"]])]}
    got = datasheets.pins_from_tables(cells(spark, tables), spark.createDataFrame(
        [], "doc_id long, expected_count int, package string, base string")).collect()
    assert {r.number for r in got} >= {"1", "2", "3"}


PARTS = [  # pins of a datasheet, pins of a symbol, mapping by number: by name in any case, else by number
    ([("1", "run"), ("2", "Stop")], [("8", "STOP"), ("9", "RUN")], {"1": "9", "2": "8"}),
    ([("1", "RUN"), ("EP", "TAB")], [("1", "GO"), ("EP", "PAD")], {"1": "1", "EP": "EP"}),
    ([("4", "RUN")], [("5", "RUN"), ("6", "RUN")], {"4": "6"}),  # of equal names the last one (SURVEY 2.13, 7)
]


def test_overlap_of_names(spark):
    """Half of the names, all, none; and no pins on either side."""
    docs = spark.createDataFrame([(d, n) for d in (1, 2, 3) for n in ("RUN", "STOP", "SDA", "SCL")], "doc_id long, name string")
    entry = spark.createDataFrame([(1, n) for n in ("RUN", "SDA", "GO", "HALT")] + [(2, n) for n in ("SCL", "SDA", "STOP", "RUN")]
                                  + [(3, "X")], "ord long, name string")
    pairs = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (1, 9), (9, 1)], "doc_id long, ord long")
    got = {(r.doc_id, r.ord): r.overlap for r in search.name_overlap(pairs, docs, entry).collect()}
    assert got == {(1, 1): 0.5, (2, 2): 1.0, (3, 3): 0.0, (1, 9): 0.0}


@pytest.mark.parametrize("case", range(len(PARTS)))
def test_mapping(spark, case):
    ours, theirs, want = PARTS[case]
    typed = spark.createDataFrame([(1, i, n, name) for i, (n, name) in enumerate(ours, 1)],
                                  "doc_id long, row_pos int, number string, name string")
    entry = spark.createDataFrame([(1, i, n, name) for i, (n, name) in enumerate(theirs, 1)],
                                  "doc_id long, pin_pos int, number string, name string")
    got = {r.ds_number: r.sym_number for r in P.pin_mapping(typed, entry).collect()}
    assert got == want
