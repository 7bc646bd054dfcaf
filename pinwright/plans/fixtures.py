"""Bindings of the catalogue schemas to the given tables.

Only this module and ``plans.registry`` know the physical tables; every operator
takes DataFrames and column names. Positions are real columns, because the rules
break ties by list order and a table has none of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered
from ..sources.shared import discard, staged


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PREFIX = """CASE p_partkey % 5 WHEN 0 THEN 'TPS' WHEN 1 THEN 'AD8' WHEN 2 THEN 'MCP'
            WHEN 3 THEN 'STM' ELSE 'XYZ' END"""


def parts(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS part_id",
        f"""{PREFIX} || CAST(p_partkey % 400 AS STRING)
            || CASE p_partkey % 7 WHEN 0 THEN 'DBVR' WHEN 1 THEN 'PWP' WHEN 2 THEN 'IDGSR'
               WHEN 3 THEN 'D' WHEN 4 THEN '-Q1' WHEN 5 THEN '-3.3' ELSE '' END AS part_number""",
        """CASE p_type WHEN 'STANDARD' THEN 'mcu' WHEN 'ECONOMY' THEN 'op_amp'
           WHEN 'MEDIUM' THEN 'diode' WHEN 'SMALL' THEN 'adc' ELSE 'ic' END AS component_type""",
        "CAST(p_size % 8 + 3 AS INT) AS pin_count",
    )


def symbols(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS ord",
        "'Lib_' || CAST(p_partkey % 25 AS STRING) AS lib",
        f"""CASE WHEN p_partkey % 14 = 0 THEN 'R' ELSE '' END || {PREFIX}
            || CAST(p_partkey % 400 AS STRING)
            || CASE WHEN p_partkey % 6 = 0 THEN 'X' ELSE '' END AS name""",
        """p_name || CASE WHEN p_partkey % 16 = 2
           THEN ' like XYZ' || CAST((p_partkey % 80) * 5 + 4 AS STRING) ELSE '' END AS description""",
        """p_brand || CASE WHEN p_partkey % 16 = 4
           THEN ' XYZ' || CAST((p_partkey % 80) * 5 + 4 AS STRING) ELSE '' END AS keywords""",
        "CAST(p_size % 8 + 3 AS INT) AS pin_count",
        "CASE WHEN p_partkey % 9 = 0 AND p_partkey >= 50 THEN p_partkey - 50 END AS extends_ord",
    )


def footprints(spark, sf):
    """Footprint index: the package names the rules look for, spread over parts."""
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS ord",
        """CASE p_partkey % 6 WHEN 0 THEN 'Package_TO_SOT_SMD' WHEN 1 THEN 'Package_SO'
           WHEN 2 THEN 'Package_DFN_QFN' WHEN 3 THEN 'Package_SON' WHEN 4 THEN 'Package_QFP'
           ELSE 'Package_DIP' END AS lib""",
        """CASE p_partkey % 6 WHEN 0 THEN 'SOT-23-' WHEN 1 THEN 'TSSOP-' WHEN 2 THEN 'QFN_'
           WHEN 3 THEN 'WSON-' WHEN 4 THEN 'LQFP' ELSE 'DIP-' END
           || CAST(p_partkey % 37 AS STRING)
           || CASE WHEN p_partkey % 6 IN (1, 2) THEN '_P0.65mm' ELSE '' END AS name""",
        "CAST(p_size % 8 + 3 AS INT) AS pad_count",
    )


def packages(spark, sf):
    """Candidate packages of parts: one to three per part, in list order."""
    p = table(spark, sf, "part")
    rows = p.selectExpr(
        "p_partkey AS doc_id",
        "explode(sequence(1, CAST(1 + p_partkey % 3 AS INT))) AS cand_pos",
        "p_size AS size",
    )
    return rows.selectExpr(
        "doc_id", "cand_pos",
        """CASE (doc_id + cand_pos) % 7 WHEN 0 THEN 'SOT-23-5' WHEN 1 THEN 'HTSSOP-16'
           WHEN 2 THEN 'VSSOP-10' WHEN 3 THEN 'SOIC-8' WHEN 4 THEN 'WQFN-' || CAST(doc_id % 37 AS STRING)
           WHEN 5 THEN 'LQFP-' || CAST(doc_id % 37 AS STRING) ELSE 'DIP' END AS name""",
        "CAST(size % 8 + 3 AS INT) AS pin_count",
        """CASE (doc_id + cand_pos) % 7 WHEN 0 THEN 'DBV' WHEN 1 THEN 'PWP' WHEN 2 THEN 'IDGS'
           WHEN 3 THEN 'D' WHEN 4 THEN 'rte' ELSE '' END AS code""",
    )


def pins(spark, sf):
    li = table(spark, sf, "lineitem")
    numbered = ordered.positions(
        li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                  "l_returnflag"),
        ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 64)], "row_pos",
    )
    return numbered.selectExpr(
        "l_orderkey AS doc_id", "row_pos",
        "CASE WHEN l_suppkey % 23 = 0 THEN 'EP' ELSE CAST(l_linenumber AS STRING) END AS number",
        """CASE l_partkey % 8 WHEN 0 THEN 'VCC' WHEN 1 THEN 'GND' WHEN 2 THEN 'OUT' WHEN 3 THEN 'IN'
           WHEN 4 THEN 'EN' WHEN 5 THEN 'FB' WHEN 6 THEN 'SDA' ELSE 'NC' END AS name""",
        """CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_partkey % 8 < 2 THEN 'P'
           WHEN l_partkey % 8 = 2 THEN 'O' WHEN l_partkey % 8 = 6 THEN 'I/O' ELSE 'I' END AS io""",
        """CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE l_returnflag || ' supply voltage' END
           AS description""",
    )


def truth(spark, sf):
    return (
        table(spark, sf, "lineitem").filter("l_suppkey % 13 <> 0")
        .selectExpr(
            "l_orderkey AS doc_id", "CAST(l_linenumber AS STRING) AS number",
            """CASE WHEN l_suppkey % 10 = 0 THEN 'VIN' ELSE
               CASE l_partkey % 8 WHEN 0 THEN 'VCC' WHEN 1 THEN 'GND' WHEN 2 THEN 'VOUT'
               WHEN 3 THEN 'IN' WHEN 4 THEN '~{EN}' WHEN 5 THEN 'FB' WHEN 6 THEN 'SDA'
               ELSE 'N.C.' END END AS name""")
        .groupBy("doc_id", "number").agg(F.max("name").alias("name"))
    )


def cells(spark, sf):
    li = table(spark, sf, "lineitem")
    r = ordered.positions(
        li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"),
        ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 64)], "row_idx",
    )
    body = r.selectExpr(
        "l_orderkey AS doc_id", "CAST(1 + floor(row_idx / 4) AS INT) AS page_num", "row_idx",
        """stack(2,
             0, CASE WHEN l_partkey % 11 = 0 THEN 'POWER AND GROUND'
                     WHEN l_partkey % 2 = 0 THEN 'VCC' ELSE 'OUT' END,
             1, CASE WHEN l_partkey % 11 = 0 THEN NULL
                     WHEN l_partkey % 7 = 0 THEN CAST(l_linenumber AS STRING) || ',Thermal pad'
                     ELSE CAST(l_linenumber AS STRING) END) AS (col_idx, text)""",
    )
    head = li.select(F.col("l_orderkey").alias("doc_id")).distinct().selectExpr(
        "doc_id", "1 AS page_num", "0 AS row_idx",
        """stack(2, 0, CASE WHEN doc_id % 3 = 0 THEN 'SPEC' ELSE 'Name' END,
                    1, CASE WHEN doc_id % 2 = 0 THEN 'Pin No.' ELSE 'NO.' END) AS (col_idx, text)""",
    )
    return body.unionByName(head)


def pads(spark, sf):
    numbered = ordered.positions(
        table(spark, sf, "lineitem").select(
            "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
            "l_quantity", "l_discount", "l_tax", "l_returnflag"),
        ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"],
        [F.floor(F.col("l_orderkey") / 64)], "pad_number",
    )
    return numbered.selectExpr(
        "l_partkey AS footprint_id", "pad_number", "l_quantity / 10 AS w",
        "l_discount * 20 + 0.1D AS h", "l_tax * 100 AS x", "l_discount * 100 AS y",
        """CASE WHEN l_returnflag = 'R' THEN 'F.Cu F.Mask' ELSE 'F.Cu F.Mask F.Paste' END
           AS layers""",
    )


USAGE_COLUMNS = [
    "event_id", "CAST(ts AS TIMESTAMP) AS ts",
    "' User' || CAST(user_id AS STRING) || '@Example.com ' AS email",
    "'m' || CAST(event_id % 3 AS STRING) AS machine_id",
    "'gen' || CAST(event_id - event_id % 3 AS STRING) AS generation_id",
    "CASE WHEN event_type = 'error' THEN 'status' ELSE 'consume' END AS mode",
    "event_type",
]

JOB_COLUMNS = [
    "event_id", "user_id AS job_id", "CAST(ts AS TIMESTAMP) AS ts",
    """CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete'
       ELSE 'status' END AS event""",
    "props AS data",
]


def usage(spark, sf):
    return table(spark, sf, "events").selectExpr(*USAGE_COLUMNS)


def job_events(spark, sf):
    return table(spark, sf, "events").selectExpr(*JOB_COLUMNS)


def stream_of(spark, sf, name):
    """The table as a file stream with the schema of the batch table."""
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, so that one file and a folder of part files both work.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


# --- derived inputs; the expressions are plain SQL that both engines accept ----------

DOC_BASE = "'TPS' || CAST(doc_id % 400 AS STRING)"
DOC_COLUMNS = [
    "doc_id",
    f"""{DOC_BASE} || CASE doc_id % 3 WHEN 0 THEN 'DBVR' WHEN 1 THEN 'PWP' ELSE '' END AS part_number""",
    f"{DOC_BASE} AS base",
    "CASE doc_id % 5 WHEN 0 THEN 'TI' WHEN 1 THEN '' WHEN 2 THEN 'NXP' ELSE 'Texas Instruments' END AS maker",
    f"""CASE doc_id % 9
        WHEN 0 THEN {DOC_BASE} || ' low drop regulator, ' || 'buck converter with enable'
        WHEN 1 THEN 'Order as ' || {DOC_BASE} || 'DGNR, ' || {DOC_BASE} || 'dbv or ' || {DOC_BASE} || 'PWPR-Q1 today'
        WHEN 2 THEN 'Listed: DGS (VSSOP, 20), XY (QFN 16) and D (SOIC, 8)'
        WHEN 3 THEN 'Offered as SOT-23-5, 8-pin SOIC, HTSSOP (16), DPAK and SOT-89; operational amplifier'
        WHEN 4 THEN 'Pin No. Mnemonic Description' || chr(10) || '1 VIN Supply voltage' || chr(10)
             || '2 GND Ground' || chr(10) || '3 OUT Output' || chr(10) || 'EPAD Connect to ground' || chr(10)
             || 'TYPICAL use' || chr(10)
        WHEN 5 THEN 'PIN FUNCTIONS' || chr(10) || 'SHDN (Pin 1/Pin 3): Shutdown input. Low is off.' || chr(10)
             || 'GND (Pins 4, 5,' || chr(10) || 'Exposed Pad Pin 9/Pins 6, 7, Exposed Pad Pin 11): Ground.' || chr(10)
        WHEN 6 THEN 'Pin 1 - VCC' || chr(10) || 'Pin 2: GND' || chr(10) || '3 OUT Switch output' || chr(10)
        WHEN 7 THEN 'N-channel power MOSFET with low drain charge' || chr(10) || 'Pin 77 - NATSISE'
        ELSE 'http://example.org ' || {DOC_BASE} || ' reel' END || chr(10) || text AS text""",
]


def documents(spark, sf):
    return table(spark, sf, "documents").selectExpr(*DOC_COLUMNS)


LINK_HTML = """replace(html, 'href="/', CASE page_id % 3
    WHEN 0 THEN 'href="/l/?uddg=https%3A%2F%2Fwww.ti.com%2Fproduct%2FTPS'
    WHEN 1 THEN 'href="/l/?uddg=https%3A%2F%2Fexample.com%2Fa%2Bb.pdf%3Fq%3D'
    ELSE 'href="/l/?uddg=http%3A%2F%2Fexample.org%2F' END)"""

ANSWER_COLUMNS = [
    "event_id AS doc_id",
    """'{"packages":[{"name":"SOIC-' || CAST(event_id % 5 + 4 AS STRING) || '","pin_count":'
       || CAST(event_id % 5 AS STRING) || ',"package_code":"D"},{"name":"QFN-16","pin_count":16}],"pins":['
       || '{"number":"1","name":" V±","type":"Power In","description":"' || event_type || '"},'
       || '{"number":"' || CAST(event_id % 3 AS STRING) || '","name":"IN–","type":"input"},'
       || '{"number":"' || CAST(user_id % 4 AS STRING) || '","name":"OUT","type":"exotic","description":"x"},'
       || '{"number":"","name":"NONE"}],"description":"d' || CAST(user_id AS STRING) || '"}' AS answer""",
]


def answers(spark, sf):
    return table(spark, sf, "events").selectExpr(*ANSWER_COLUMNS)


def pages_of_conversations(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id AS doc_id", "CAST(turn + 1 AS INT) AS page_num",
        """CASE WHEN turn % 3 = 2 THEN 'Pin name list ' ELSE '' END || text AS text""")


def long_pages(spark, sf):
    """Ten conversations make a document; a page is one turn number of all of them."""
    pages = pages_of_conversations(spark, sf)
    return pages.groupBy(F.expr("doc_id div 10").alias("doc_id"), "page_num").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda p: p["text"]), "\n").alias("text"))


#: Every third pin goes by the number three places on as well.
ALTERNATES = """CASE WHEN row_pos % 3 = 1 THEN array(CAST(row_pos + 3 AS STRING)) ELSE array() END"""


# Heading cells of the table forms: (form, row_idx, col_idx, text).
GRID_HEADS = [
    (0, 0, 0, "Name"), (0, 0, 1, "Pin No."), (0, 0, 2, "I/O"), (0, 0, 3, "Description"),
    (0, 0, 5, "Alternate Functions"), (0, 0, 6, "Additional function"),
    (1, 0, 0, ""), (1, 0, 1, "PIN"), (1, 0, 2, "TYPE"), (1, 0, 3, "DESCRIPTION"),
    (1, 1, 0, "NAME"), (1, 1, 1, "NO."), (1, 1, 2, None), (1, 1, 3, ""),
    (2, 0, 0, "SPEC"), (2, 0, 1, None), (2, 0, 2, ""), (2, 0, 3, ""),
    (2, 1, 0, "Name"), (2, 1, 1, "NO."), (2, 1, 2, "Type"), (2, 1, 3, "Function"),
    (3, 0, 0, "PIN"), (3, 0, 1, ""), (3, 0, 2, ""), (3, 0, 3, ""),
    (3, 1, 0, "NAME"), (3, 1, 1, "ADS1115"), (3, 1, 2, "TYPE"), (3, 1, 3, "DESCRIPTION"),
    (4, 0, 0, "Table 1"), (4, 0, 1, ""),
    (4, 1, 0, ""), (4, 1, 1, "PIN"), (4, 1, 2, "I/O"), (4, 1, 3, "DESC"),
    (4, 2, 0, "NAME"), (4, 2, 1, "NO."), (4, 2, 2, "(1)"), (4, 2, 3, ""),
    (5, 0, 0, "SPEC"), (5, 0, 1, "VALUE"), (5, 0, 2, "UNIT"), (5, 0, 3, "NOTE"),
]
GRID_FORM = "CASE WHEN table_seq = 1 AND doc_id % 4 = 0 THEN 5 ELSE CAST(doc_id % 6 AS INT) END"
GRID_HEAD_ROWS = "CASE form WHEN 0 THEN 1 WHEN 4 THEN 3 WHEN 5 THEN 1 ELSE 2 END"
GRID_CELLS = [
    """CASE WHEN l_partkey % 11 = 0 THEN 'POWER AND GROUND' WHEN l_partkey % 13 = 0 THEN 'Ground'
       WHEN l_partkey % 17 = 0 THEN 'PAD' WHEN l_partkey % 2 = 0 THEN 'VCC'
       ELSE 'OUT' || CAST(l_linenumber AS STRING) END""",
    """CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN '-'
       WHEN l_partkey % 7 = 0 THEN CAST(rn AS STRING) || ',Thermal pad' ELSE CAST(rn AS STRING) END""",
    """CASE WHEN l_partkey % 11 = 0 OR l_suppkey % 3 = 0 THEN '' ELSE
       CASE l_partkey % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE '-' END END""",
    """CASE WHEN l_partkey % 11 = 0 OR l_suppkey % 6 < 4 THEN NULL WHEN l_suppkey % 5 = 0
       THEN 'Exposed pad or supply' ELSE l_returnflag || ' supply voltage' END""",
]

# Alternate functions, in tables of form 0: two columns, partly blank or dashed.
GRID_ALTERNATES = {
    5: """CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN rn % 3 = 0 THEN '-' ELSE ' ALT' || CAST(rn AS STRING) || ' ' END""",
    6: """CASE WHEN l_partkey % 11 = 0 OR rn % 2 = 0 THEN '' ELSE 'T' || CAST(l_linenumber AS STRING) END""",
}


def _numbered_lines(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return ordered.positions(
        li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
        [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 64)], "rn",
    ).withColumnRenamed("l_orderkey", "doc_id")


def grid(spark, sf):
    """Cells of multi-page tables in six heading forms, one table per page."""
    lines = staged(_numbered_lines(spark, sf), "lines")
    rows = lines.selectExpr(
        "*", "CAST(floor((rn - 1) / 4) AS INT) AS table_seq", "(rn - 1) % 4 AS k",
    ).selectExpr("*", f"{GRID_FORM} AS form").selectExpr("*", f"{GRID_HEAD_ROWS} AS head_rows")
    cells_sql = ", ".join(f"{i}, {c}" for i, c in enumerate(GRID_CELLS))
    body = rows.selectExpr("doc_id", "table_seq", "head_rows + k AS row_idx",
                           f"stack({len(GRID_CELLS)}, {cells_sql}) AS (col_idx, text)")
    second = rows.filter("form = 0 and doc_id % 7 = 0").selectExpr(
        "doc_id", "table_seq", "head_rows + k AS row_idx", "4 AS col_idx",
        "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(rn + 100 AS STRING) END AS text")
    alternates_sql = ", ".join(f"{i}, {c}" for i, c in GRID_ALTERNATES.items())
    third = rows.filter("form = 0").selectExpr(
        "doc_id", "table_seq", "head_rows + k AS row_idx", f"stack({len(GRID_ALTERNATES)}, {alternates_sql}) AS (col_idx, text)")
    heads = spark.createDataFrame(GRID_HEADS, "form int, row_idx int, col_idx int, text string")
    tables = rows.select("doc_id", "table_seq", "form").distinct()
    top = tables.join(F.broadcast(heads), "form").select("doc_id", "table_seq", "row_idx", "col_idx", "text")
    top2 = tables.filter("form = 0 and doc_id % 7 = 0").selectExpr(
        "doc_id", "table_seq", "0 AS row_idx", "4 AS col_idx", "'PIN SOT-23' AS text")
    every = body.unionByName(second).unionByName(third).unionByName(top).unionByName(top2)
    # Cells are a stored input of the table rules; derived here, so stored here.
    cells = staged(every.selectExpr("doc_id", "table_seq + 1 AS page_num", "table_seq",
                                    "CAST(row_idx AS INT) AS row_idx", "col_idx", "text"), "cells")
    discard(lines)
    return cells


WANTED_COLUMNS = [
    "o_orderkey AS doc_id", "CAST(o_orderkey % 9 AS INT) AS expected_count",
    "CASE o_orderkey % 3 WHEN 0 THEN 'SOT-23-5' ELSE '' END AS package",
    "CASE o_orderkey % 5 WHEN 0 THEN 'ADS1115' ELSE '' END AS base",
]


def wanted(spark, sf):
    # Nothing is known of every eleventh document.
    return table(spark, sf, "orders").filter("o_orderkey % 11 <> 0").selectExpr(*WANTED_COLUMNS)


PACKAGE_TEXT = """CASE l_partkey % 4 WHEN 0 THEN 'D (SOIC, 8)' WHEN 1 THEN 'DGS (VSSOP, 20)'
                  WHEN 2 THEN 'XY (QFN 16)' ELSE 'see note' END"""
PACKAGE_LABEL = """CASE WHEN rn = 1 THEN CASE doc_id % 3 WHEN 0 THEN 'UC384x' WHEN 1 THEN 'UC38x5' ELSE 'UC3845' END
                   WHEN l_partkey % 5 = 0 THEN 'UC384' || CAST(l_suppkey % 10 AS STRING) ELSE '' END"""
PACKAGE_HEADS = [
    ("CASE doc_id % 4 WHEN 0 THEN 'DEVICE' WHEN 1 THEN 'SPEC' ELSE 'PART NUMBER' END"),
    ("CASE doc_id % 4 WHEN 0 THEN 'PACKAGE SIZE' ELSE 'PACKAGE (PINS)' END"),
    ("CASE doc_id % 4 WHEN 0 THEN 'PACKAGE' ELSE 'BODY SIZE' END"),
]


def package_cells(spark, sf):
    """Device-information tables: label, package and size columns."""
    rows = _numbered_lines(spark, sf)
    body = rows.selectExpr("doc_id", "rn AS row_idx", f"stack(3, 0, {PACKAGE_LABEL}, 1, {PACKAGE_TEXT}, "
                           f"2, {PACKAGE_TEXT}) AS (col_idx, text)")
    heads = ", ".join(f"{i}, {h}" for i, h in enumerate(PACKAGE_HEADS))
    top = rows.select("doc_id").distinct().selectExpr(
        "doc_id", "0 AS row_idx", f"stack(3, {heads}) AS (col_idx, text)")
    return body.unionByName(top).selectExpr("doc_id", "1 AS page_num", "0 AS table_seq", "row_idx", "col_idx", "text")


PACKAGE_PART = "'UC384' || CAST(o_orderkey % 10 AS STRING)"


def package_parts(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", f"{PACKAGE_PART} AS part_number")


# A library file per symbol: the symbol, a derived one, a sub-symbol with two pins.
LIBRARY_TEXT = """'(kicad_symbol_lib (version 1) (symbol "' || name || '" (property "Reference" "U" (at 0 1 0)'
   || ' (effects (font (size 1 1)))) (property "Value" "' || name || '" (effects (hide yes))) (property "Description" "'
   || description || ' ' || chr(92) || '"q' || chr(92) || '" (x)") (property "ki_keywords" "' || keywords || '") (symbol "' || name
   || '_0_1" (rectangle (start -5 ' || CAST(pin_count AS STRING) || ') (end 5 -2.5) (stroke (width 0.254) (type default)) (fill (type background)))'
   || ' (arc (start 0 0) (mid 1 1) (end 2 0) (fill (type none)) (stroke (width 0)))'
   || ' (arc (start ' || CAST(3 + ord % 5 AS STRING) || ' 0) (mid -' || CAST(3 + ord % 5 AS STRING) || ' 0) (end 0 -' || CAST(3 + ord % 5 AS STRING) || '))'
   || CASE ord % 4 WHEN 0 THEN ' (arc (start 9 9) (end 1 1))' WHEN 1 THEN ' (arc (start 0 0) (mid 4 0) (end 8 0))' ELSE '' END
   || ' (circle (center 1 ' || CAST(ord % 7 AS STRING) || ') '
   || CASE WHEN ord % 3 = 0 THEN '(end 4 ' || CAST(ord % 7 + 4 AS STRING) || ')' ELSE '(radius 2.5)' END || ' (fill (type outline)))'
   || ' (text "note ' || CAST(ord % 9 AS STRING) || '" ' || CASE WHEN ord % 5 = 0 THEN '' ELSE '(at 0 -8 900) ' END || '(effects (font (size 1.5 1.25)))))'
   || ' (symbol "' || name || '_' || CAST(ord % 3 AS STRING) || '_1" (polyline (pts (xy -6 0) (xy ' || CAST(ord % 13 AS STRING) || ' 9.5)) (stroke (width 0.1)) (fill (type none))) (pin power_in line (at 0 '
   || CAST(pin_count AS STRING) || ' 90) (length 2.54) (name "VCC") (number "1"))'
   || ' (pin input line (at -5 0 0) (length 2.54) (name "IN") (number "2")))) (symbol "' || name
   || '_B" (extends "' || name || '") (property "Description" "child of ' || name || '")))'
   || CASE WHEN ord % 50 = 0 THEN ' ( ' ELSE '' END"""


def _spread(rows, key):
    """Rows of a small table over all tasks, before long texts are made of them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _made(text):
    """A text made of a row, by way of a generator: what filters the texts is not moved in front of the spreading,
    where one task would make and search them all."""
    return f"explode(array({text})) AS content"


def library_files(spark, sf):
    return _spread(symbols(spark, sf), "ord").selectExpr("CAST(ord AS STRING) AS file", "lib", _made(LIBRARY_TEXT))


FOOTPRINT_TEXT = """'(footprint "F' || CAST(p_partkey AS STRING) || '" (fp_line (start 0 0) (end 1 1) (layer "F.SilkS") (stroke (width 0.12)))'
   || ' (fp_circle (center 0 0) (end ' || CAST(p_size % 6 AS STRING) || ' 1) (layer "' || CASE WHEN p_partkey % 4 = 0 THEN 'F.Mask' ELSE 'F.CrtYd' END || '"))'
   || ' (fp_arc (start 2 0) (mid 0 2) (end -2 0) (layer "F.Fab"))'
   || ' (fp_rect (start -1 -1) (end 3 ' || CAST(p_partkey % 8 AS STRING) || ') (layer "B.SilkS") (fill (type solid)))'
   || ' (fp_poly (pts (xy 0 0) (xy 7 ' || CAST(p_partkey % 3 AS STRING) || ')) (layer "F.Cu"))'
   || ' (fp_text reference "REF' || CAST(p_partkey % 10 AS STRING) || '" (at 0 -3 90) (layer "F.Paste") (effects (font (size 1 1))))'
   || repeat('(pad "1" smd rect (at 1 2 90) (size 1.5 ' || CAST(p_size AS STRING)
             || ') (layers "F.Cu" "F.Mask") (roundrect_rratio 0.25))', CAST(p_size % 4 AS INT))
   || repeat('(pad "" thru_hole circle (at -1 0) (size 2 2) (drill 0.8 0.4) (property pad_prop_heatsink))',
             CAST(p_partkey % 3 AS INT))
   || repeat('(pad 3 np_thru_hole circle (at 0 0) (drill 1))', CAST(p_partkey % 2 AS INT)) || ')'"""


def footprint_files(spark, sf):
    return _spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").selectExpr(
        "CAST(p_partkey AS STRING) AS file", _made(FOOTPRINT_TEXT))


FILE_COLUMNS = [
    "page_id AS file_pos",
    f"""substr(md5(url), 1, 12) || '_' || CASE page_id % 3 WHEN 0 THEN 'tps' WHEN 1 THEN 'mcp-' ELSE 'xyz_' END
        || CAST(page_id * 7 % 400 AS STRING) || '.pdf' AS file_name""",
    "length(html) AS size_bytes",
]


def stored_files(spark, sf):
    return table(spark, sf, "pages").selectExpr(*FILE_COLUMNS)
