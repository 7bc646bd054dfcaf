"""The fixture views as SQL, for the side-by-side check."""

from pinwright.plans import fixtures as fx

PREFIX = """CASE p_partkey % 5 WHEN 0 THEN 'TPS' WHEN 1 THEN 'AD8' WHEN 2 THEN 'MCP' WHEN 3 THEN 'STM' ELSE 'XYZ' END"""
LINES = """SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, l_returnflag,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS rn
    FROM lineitem"""

VIEWS = {
    "fx_parts": f"""SELECT p_partkey AS part_id, {PREFIX} || CAST(p_partkey % 400 AS STRING)
       || CASE p_partkey % 7 WHEN 0 THEN 'DBVR' WHEN 1 THEN 'PWP' WHEN 2 THEN 'IDGSR' WHEN 3 THEN 'D'
          WHEN 4 THEN '-Q1' WHEN 5 THEN '-3.3' ELSE '' END AS part_number,
       CASE p_type WHEN 'STANDARD' THEN 'mcu' WHEN 'ECONOMY' THEN 'op_amp' WHEN 'MEDIUM' THEN 'diode'
          WHEN 'SMALL' THEN 'adc' ELSE 'ic' END AS component_type, CAST(p_size % 8 + 3 AS INT) AS pin_count FROM part""",
    "fx_symbols": f"""SELECT p_partkey AS ord, 'Lib_' || CAST(p_partkey % 25 AS STRING) AS lib,
       CASE WHEN p_partkey % 14 = 0 THEN 'R' ELSE '' END || {PREFIX} || CAST(p_partkey % 400 AS STRING)
         || CASE WHEN p_partkey % 6 = 0 THEN 'X' ELSE '' END AS name,
       p_name || CASE WHEN p_partkey % 16 = 2 THEN ' like XYZ' || CAST((p_partkey % 80) * 5 + 4 AS STRING) ELSE '' END AS description,
       p_brand || CASE WHEN p_partkey % 16 = 4 THEN ' XYZ' || CAST((p_partkey % 80) * 5 + 4 AS STRING) ELSE '' END AS keywords,
       CAST(p_size % 8 + 3 AS INT) AS pin_count,
       CASE WHEN p_partkey % 9 = 0 AND p_partkey >= 50 THEN p_partkey - 50 END AS extends_ord
       FROM part""",
    "fx_footprints": """SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'Package_TO_SOT_SMD' WHEN 1 THEN 'Package_SO'
           WHEN 2 THEN 'Package_DFN_QFN' WHEN 3 THEN 'Package_SON' WHEN 4 THEN 'Package_QFP' ELSE 'Package_DIP' END AS lib,
        CASE p_partkey % 6 WHEN 0 THEN 'SOT-23-' WHEN 1 THEN 'TSSOP-' WHEN 2 THEN 'QFN_' WHEN 3 THEN 'WSON-' WHEN 4 THEN 'LQFP' ELSE 'DIP-' END
           || CAST(p_partkey % 37 AS STRING) || CASE WHEN p_partkey % 6 IN (1, 2) THEN '_P0.65mm' ELSE '' END AS name,
        CAST(p_size % 8 + 3 AS INT) AS pad_count FROM part""",
    "fx_packages": """SELECT p_partkey AS doc_id, CAST(c AS INT) AS cand_pos,
        CASE (p_partkey + c) % 7 WHEN 0 THEN 'SOT-23-5' WHEN 1 THEN 'HTSSOP-16' WHEN 2 THEN 'VSSOP-10' WHEN 3 THEN 'SOIC-8'
          WHEN 4 THEN 'WQFN-' || CAST(p_partkey % 37 AS STRING) WHEN 5 THEN 'LQFP-' || CAST(p_partkey % 37 AS STRING) ELSE 'DIP' END AS name,
        CAST(p_size % 8 + 3 AS INT) AS pin_count,
        CASE (p_partkey + c) % 7 WHEN 0 THEN 'DBV' WHEN 1 THEN 'PWP' WHEN 2 THEN 'IDGS' WHEN 3 THEN 'D' WHEN 4 THEN 'rte' ELSE '' END AS code
        FROM part, (VALUES (1), (2), (3)) t(c) WHERE c <= 1 + p_partkey % 3""",
    "fx_lines": LINES,
    "fx_pins": """SELECT doc_id, rn AS row_pos,
        CASE WHEN l_suppkey % 23 = 0 THEN 'EP' ELSE CAST(l_linenumber AS STRING) END AS number,
        CASE l_partkey % 8 WHEN 0 THEN 'VCC' WHEN 1 THEN 'GND' WHEN 2 THEN 'OUT' WHEN 3 THEN 'IN' WHEN 4 THEN 'EN' WHEN 5 THEN 'FB' WHEN 6 THEN 'SDA' ELSE 'NC' END AS name,
        CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_partkey % 8 < 2 THEN 'P' WHEN l_partkey % 8 = 2 THEN 'O' WHEN l_partkey % 8 = 6 THEN 'I/O' ELSE 'I' END AS io,
        CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE l_returnflag || ' supply voltage' END AS description FROM fx_lines""",
    "fx_truth": """SELECT l_orderkey AS doc_id, CAST(l_linenumber AS STRING) AS number,
        max(CASE WHEN l_suppkey % 10 = 0 THEN 'VIN' ELSE CASE l_partkey % 8 WHEN 0 THEN 'VCC' WHEN 1 THEN 'GND' WHEN 2 THEN 'VOUT' WHEN 3 THEN 'IN'
            WHEN 4 THEN '~{EN}' WHEN 5 THEN 'FB' WHEN 6 THEN 'SDA' ELSE 'N.C.' END END) AS name
        FROM lineitem WHERE l_suppkey % 13 <> 0 GROUP BY l_orderkey, l_linenumber""",
    "fx_cells": """SELECT doc_id, CAST(1 + floor(rn / 4) AS INT) AS page_num, rn AS row_idx, 0 AS col_idx,
          CASE WHEN l_partkey % 11 = 0 THEN 'POWER AND GROUND' WHEN l_partkey % 2 = 0 THEN 'VCC' ELSE 'OUT' END AS text FROM fx_lines
        UNION ALL SELECT doc_id, CAST(1 + floor(rn / 4) AS INT), rn, 1, CASE WHEN l_partkey % 11 = 0 THEN NULL
          WHEN l_partkey % 7 = 0 THEN CAST(l_linenumber AS STRING) || ',Thermal pad' ELSE CAST(l_linenumber AS STRING) END FROM fx_lines
        UNION ALL SELECT DISTINCT doc_id, 1, 0, 0, CASE WHEN doc_id % 3 = 0 THEN 'SPEC' ELSE 'Name' END FROM fx_lines
        UNION ALL SELECT DISTINCT doc_id, 1, 0, 1, CASE WHEN doc_id % 2 = 0 THEN 'Pin No.' ELSE 'NO.' END FROM fx_lines""",
    "fx_pads": """SELECT l_partkey AS footprint_id, CAST(row_number() OVER (PARTITION BY l_partkey
          ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS INT) AS pad_number,
        l_quantity / 10 AS w, l_discount * 20 + 0.1 AS h, l_tax * 100 AS x, l_discount * 100 AS y,
        CASE WHEN l_returnflag = 'R' THEN 'F.Cu F.Mask' ELSE 'F.Cu F.Mask F.Paste' END AS layers FROM lineitem""",
    "fx_usage": """SELECT event_id, ts, ' User' || CAST(user_id AS STRING) || '@Example.com ' AS email,
        'm' || CAST(event_id % 3 AS STRING) AS machine_id, 'gen' || CAST(event_id - event_id % 3 AS STRING) AS generation_id,
        CASE WHEN event_type = 'error' THEN 'status' ELSE 'consume' END AS mode, event_type FROM events""",
    "fx_job_events": """SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'error' THEN 'error'
        WHEN 'purchase' THEN 'complete' ELSE 'status' END AS event, props AS data FROM events""",
    "fx_docs": f"SELECT {', '.join(fx.DOC_COLUMNS)} FROM documents",
    "fx_answers": f"SELECT {', '.join(fx.ANSWER_COLUMNS)} FROM events",
    "fx_conv": """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page_num,
        CASE WHEN turn % 3 = 2 THEN 'Pin name list ' ELSE '' END || text AS text FROM conversations""",
    "fx_wanted": f"SELECT {', '.join(fx.WANTED_COLUMNS)} FROM orders WHERE o_orderkey % 11 <> 0",
    "fx_long": """SELECT doc_id // 10 AS doc_id, page_num, string_agg(text, chr(10) ORDER BY fx_conv.doc_id) AS text FROM fx_conv GROUP BY 1, 2""",
    "fx_files": f"SELECT {', '.join(fx.FILE_COLUMNS)} FROM pages",
    "fx_library": f"SELECT CAST(ord AS STRING) AS file, lib, ord, name, pin_count, description, keywords, {fx.LIBRARY_TEXT} AS content FROM fx_symbols",
    "fx_mods": f"SELECT p_partkey, p_size, CAST(p_partkey AS STRING) AS file, {fx.FOOTPRINT_TEXT} AS content FROM part",
}


def _text(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


VIEWS["fx_grid_rows"] = f"""SELECT *, {fx.GRID_HEAD_ROWS} AS head_rows FROM (SELECT *, {fx.GRID_FORM} AS form FROM (
    SELECT *, CAST(floor((rn - 1) / 4) AS INT) AS table_seq, (rn - 1) % 4 AS k FROM fx_lines) a) b"""
_heads = ", ".join(f"({f}, {r}, {c}, {_text(t)})" for f, r, c, t in fx.GRID_HEADS)
VIEWS["fx_grid"] = (
    "SELECT doc_id, table_seq + 1 AS page_num, table_seq, CAST(row_idx AS INT) AS row_idx, CAST(col_idx AS INT) AS col_idx, text FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, table_seq, head_rows + k AS row_idx, {i} AS col_idx, {c} AS text FROM fx_grid_rows"
        for i, c in enumerate(fx.GRID_CELLS))
    + """ UNION ALL SELECT doc_id, table_seq, head_rows + k, 4, CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(rn + 100 AS STRING) END
          FROM fx_grid_rows WHERE form = 0 AND doc_id % 7 = 0"""
    + "".join(f" UNION ALL SELECT doc_id, table_seq, head_rows + k, {i}, {c} FROM fx_grid_rows WHERE form = 0" for i, c in fx.GRID_ALTERNATES.items())
    + """ UNION ALL SELECT doc_id, table_seq, 0, 4, 'PIN SOT-23' FROM (SELECT DISTINCT doc_id, table_seq FROM fx_grid_rows
          WHERE form = 0 AND doc_id % 7 = 0) z
        UNION ALL SELECT doc_id, table_seq, h.r, h.c, h.t FROM (SELECT DISTINCT doc_id, table_seq, form FROM fx_grid_rows) g
          JOIN (VALUES """ + _heads + ") h(f, r, c, t) ON g.form = h.f) u")
VIEWS["fx_package_cells"] = (
    "SELECT doc_id, 0 AS table_seq, row_idx, col_idx, text FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, rn AS row_idx, {i} AS col_idx, {e} AS text FROM fx_lines"
                         for i, e in enumerate([fx.PACKAGE_LABEL, fx.PACKAGE_TEXT, fx.PACKAGE_TEXT]))
    + "".join(f" UNION ALL SELECT DISTINCT doc_id, 0, {i}, {e} FROM fx_lines" for i, e in enumerate(fx.PACKAGE_HEADS))
    + ") u")

NEEDS = {
    "fx_long": ["fx_conv"],
    "fx_pins": ["fx_lines"], "fx_cells": ["fx_lines"], "fx_library": ["fx_symbols"],
    "fx_grid_rows": ["fx_lines"], "fx_grid": ["fx_grid_rows"], "fx_package_cells": ["fx_lines"],
}


def with_views(body: str, extra: dict | None = None) -> str:
    """Prefix a query with the CTEs it mentions, dependencies first."""
    extra = extra or {}
    wanted: list[str] = []

    def need(name):
        for dep in NEEDS.get(name, []):
            need(dep)
        if name not in wanted:
            wanted.append(name)

    text = body + " " + " ".join(extra.values())
    for name in sorted(VIEWS, key=len, reverse=True):
        if name in text:
            need(name)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in wanted] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
