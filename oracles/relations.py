"""SQL counterparts of search, pin joins, tables, geometry, reports and streams."""

from pinwright.functions import lookups as L
from pinwright.plans import fixtures as fx

from . import rules as S
from .fixtures import with_views as W
from .scalars import TERMS, WILD

q = S.q
O = {}


def within(col, words):
    return f"{col} IN ({', '.join(q(w) for w in words)})"


# --- search: the rules as one scored pairing --------------------------------------------
def symbol_scores(requests):
    tier = f"""CASE WHEN upper(name) = query THEN 100.0 WHEN starts_with(upper(name), query) THEN 80.0
      WHEN {WILD.format(n='upper(name)', q='query')} THEN 85.0 WHEN contains(upper(name), query) THEN 50.0
      WHEN contains(upper(description), query) THEN 20.0 WHEN contains(upper(keywords), query) THEN 15.0 END"""
    return {"req": requests, "scored": f"""SELECT query, pin_count, ord, lib, name, entry_pin_count, CAST(s + CASE WHEN pin_count > 0 AND entry_pin_count = pin_count THEN 10
        WHEN pin_count > 0 THEN -5 ELSE 0 END AS DOUBLE) AS score FROM (SELECT query, r.pin_count, ord, lib, name, e.pin_count AS entry_pin_count, {tier} AS s
        FROM req r, fx_symbols e) z WHERE s IS NOT NULL""",
        "top": "SELECT *, CAST(row_number() OVER (PARTITION BY query, pin_count ORDER BY score DESC, ord) AS INT) AS rank FROM scored"}


_req = "SELECT DISTINCT upper(part_number) AS query, pin_count FROM fx_parts"
O["symbol_search"] = W("SELECT * FROM scored", symbol_scores(_req))
O["symbol_top_matches"] = W("SELECT query, pin_count, rank, ord, score, rank <= 5 AS in_top5, rank = 1 AS is_top FROM top WHERE rank <= 10", symbol_scores(_req))


def footprint_scores(requests):
    return {"freq": requests, "fscored": """SELECT query, pin_count, ord, lib, name, pad_count, CAST(s + CASE WHEN pin_count > 0 AND pad_count = pin_count THEN 10
        WHEN pin_count > 0 THEN -5 ELSE 0 END AS DOUBLE) AS score FROM (SELECT *, CASE WHEN upper(name) = query THEN 100.0 WHEN contains(upper(name), query) THEN 50.0
        WHEN contains(replace(replace(upper(name), '-', ''), '_', ''), replace(replace(query, '-', ''), '_', '')) THEN 40.0 END AS s FROM freq, fx_footprints) z WHERE s IS NOT NULL""",
        "ftop": "SELECT *, row_number() OVER (PARTITION BY query, pin_count ORDER BY score DESC, ord) AS rank FROM fscored"}


O["footprint_search"] = W("SELECT * FROM fscored", footprint_scores("SELECT DISTINCT upper(name) AS query, pin_count FROM fx_packages"))

_generic = ", ".join(f"({q(c)}, {i}, {q(l)}, {q(n)})" for i, (c, l, n) in enumerate(
    L.GENERIC_SYMBOLS + [("op_amp", "Lib_0", "TPS200"), ("ic", "Lib_2", "MCP2")]))
O["symbol_match"] = W("""SELECT d.part_id AS doc_id, coalesce(dt, ct, ft, gt) AS tier, coalesce(d_ord, c_ord, f_ord, g_ord) AS symbol_ord,
    coalesce(d_lib, c_lib, f_lib, g_lib) AS symbol_lib, coalesce(d_name, c_name, f_name, g_name) AS symbol_name, CAST(coalesce(d_score, c_score, f_score, g_score, 0.0) AS DOUBLE) AS symbol_score
  FROM first d LEFT JOIN close c ON c.part_id = d.part_id LEFT JOIN gen g ON g.component_type = d.component_type""", {
    **symbol_scores("SELECT up AS query, pin_count FROM dd UNION SELECT base, pin_count FROM dd"),
    "dd": f"SELECT *, upper(trim(part_number)) AS up, {S.base('part_number')} AS base FROM fx_parts",
    "heads": "SELECT * FROM top WHERE rank = 1",
    "joined": """SELECT dd.*, f.ord AS fo, f.lib AS fl, f.name AS fn, f.score AS fs, s.ord AS so, s.lib AS sl, s.name AS sn, s.score AS ss FROM dd
       LEFT JOIN heads f ON f.query = up AND f.pin_count = dd.pin_count LEFT JOIN heads s ON s.query = base AND base <> up AND s.pin_count = dd.pin_count""",
    "first": """SELECT *, CASE WHEN fs >= 100 THEN 1 WHEN ss >= 80 THEN 2 END AS dt, CASE WHEN fs >= 100 THEN fo WHEN ss >= 80 THEN so END AS d_ord,
       CASE WHEN fs >= 100 THEN fl WHEN ss >= 80 THEN sl END AS d_lib, CASE WHEN fs >= 100 THEN fn WHEN ss >= 80 THEN sn END AS d_name, CASE WHEN fs >= 100 THEN fs WHEN ss >= 80 THEN ss END AS d_score,
       CASE WHEN fs IS NOT NULL OR ss IS NOT NULL THEN 4 END AS ft, CASE WHEN ub THEN so ELSE fo END AS f_ord, CASE WHEN ub THEN sl ELSE fl END AS f_lib, CASE WHEN ub THEN sn ELSE fn END AS f_name,
       CASE WHEN ub THEN ss ELSE fs END AS f_score, CASE WHEN ub THEN base ELSE up END AS iq FROM (SELECT *, (ss IS NOT NULL AND (fs IS NULL OR ss > fs)) AS ub FROM joined) z""",
    "near": "SELECT f.part_id, t.ord, t.lib, t.name, t.score, t.rank FROM first f JOIN top t ON t.query = iq AND t.pin_count = f.pin_count AND t.rank <= 10 AND t.entry_pin_count = f.pin_count WHERE dt IS NULL",
    "ov": """SELECT n.part_id, n.ord, avg(CASE WHEN t.name IS NOT NULL THEN 1.0 ELSE 0.0 END) AS o FROM near n JOIN fx_pins p ON p.doc_id = n.part_id
       LEFT JOIN (SELECT DISTINCT doc_id, upper(name) AS name FROM fx_truth) t ON t.doc_id = n.ord AND t.name = upper(p.name) GROUP BY n.part_id, n.ord""",
    "close": """SELECT part_id, 3 AS ct, ord AS c_ord, lib AS c_lib, name AS c_name, score * o AS c_score FROM (SELECT near.*, o, row_number() OVER (PARTITION BY near.part_id ORDER BY rank) AS rn
       FROM near JOIN ov ON ov.part_id = near.part_id AND ov.ord = near.ord WHERE o > 0.5) z WHERE rn = 1""",
    "gen": f"""SELECT component_type, 5 AS gt, ord AS g_ord, lib AS g_lib, name AS g_name, 10.0 AS g_score FROM (SELECT v.*, s.ord, row_number() OVER (PARTITION BY component_type ORDER BY pos) AS rn
       FROM (VALUES {_generic}) v(component_type, pos, lib, name) JOIN (SELECT lib, name, min(ord) AS ord FROM fx_symbols GROUP BY lib, name) s ON s.lib = v.lib AND s.name = v.name) z WHERE rn = 1""",
})
# CTE order: the part rows come before the requests that read them.
_sql = O["symbol_match"]
_dd = _sql[_sql.index("dd AS ("):_sql.index(",\nheads AS (")]
O["symbol_match"] = _sql.replace(_dd + ",\n", "").replace("req AS (", _dd + ",\nreq AS (", 1)

_map = ", ".join(f"({i}, {q(k)}, {q(v.split(':', 1)[0])}, {q(v.split(':', 1)[1])})" for i, (k, v) in enumerate(L.PACKAGE_FOOTPRINTS.items()))
O["footprint_match"] = W("""SELECT p.doc_id, CASE WHEN n.lib IS NOT NULL THEN 1 WHEN c.lib IS NOT NULL THEN 2 WHEN h.lib IS NOT NULL THEN 3 WHEN w.lib IS NOT NULL THEN 4 END AS tier,
   coalesce(n.lib, c.lib, h.lib, w.lib, '') AS footprint_lib, coalesce(n.name, c.name, h.name, w.name, '') AS footprint_name,
   CAST(CASE WHEN n.lib IS NOT NULL THEN 100 WHEN c.lib IS NOT NULL THEN 95 ELSE coalesce(h.s, w.s, 0) END AS DOUBLE) AS footprint_score
   FROM pk p LEFT JOIN known n ON upper(n.key) = upper(p.name) LEFT JOIN known c ON c.key = p.code
   LEFT JOIN hit h ON h.doc_id = p.doc_id LEFT JOIN wide w ON w.doc_id = p.doc_id""", {
    "chosen": f"""SELECT doc_id, coalesce(arg_min(name, cand_pos) FILTER (WHERE code <> '' AND upper(code) = upper(suffix)), CASE WHEN count(*) = 1 THEN min(name) END) AS selected
       FROM fx_packages LEFT JOIN (SELECT part_id, {S.code('part_number')} AS suffix FROM fx_parts WHERE part_id % 10 <> 0) s ON part_id = doc_id GROUP BY doc_id""",
    "pk": """SELECT doc_id, name, arg_min(code, cand_pos) AS code, arg_min(pin_count, cand_pos) AS pin_count FROM fx_packages JOIN chosen c USING (doc_id) WHERE name = selected GROUP BY doc_id, name""",
    "known": f"SELECT m.* FROM (VALUES {_map}) m(pos, key, lib, name) WHERE (lib, name) IN (SELECT (lib, name) FROM fx_footprints)",
    "terms": TERMS,
    "tq": "SELECT doc_id, pos, upper(trim(term)) AS query, pin_count FROM terms WHERE cand_pos = 1 AND term IS NOT NULL",
    "bq": "SELECT doc_id, upper(regexp_replace(name, '[-_]?\\d+$', '')) AS query, pin_count FROM pk WHERE regexp_replace(name, '[-_]?\\d+$', '') <> name",
    **footprint_scores("SELECT query, pin_count FROM tq UNION SELECT query, pin_count FROM bq"),
    "hit": """SELECT doc_id, arg_min(lib, pos) AS lib, arg_min(name, pos) AS name, arg_min(s, pos) AS s FROM (SELECT doc_id, pos, lib, name, CASE WHEN pad_count = tq.pin_count OR tq.pin_count = 0 THEN score
       WHEN abs(pad_count - tq.pin_count) <= 2 THEN score * CAST(0.9 AS DOUBLE) END AS s FROM tq JOIN ftop t ON t.query = tq.query AND t.pin_count = tq.pin_count AND t.rank = 1) z WHERE s IS NOT NULL GROUP BY doc_id""",
    "wide": """SELECT doc_id, arg_min(lib, rank) AS lib, arg_min(name, rank) AS name, arg_min(score, rank) * CAST(0.8 AS DOUBLE) AS s FROM bq JOIN ftop t ON t.query = bq.query AND t.pin_count = bq.pin_count
       AND t.rank <= 5 AND pad_count = bq.pin_count GROUP BY doc_id"""})

O["cached_document"] = W("""SELECT part_id, key, file_name FROM (SELECT k.part_id, k.key, f.file_name, row_number() OVER (PARTITION BY k.part_id ORDER BY k.pos, f.file_pos) AS rn
   FROM keys k JOIN fx_files f ON f.size_bytes > 1000 AND contains(replace(replace(lower(f.file_name), '-', ''), '_', ''), k.key) WHERE length(k.key) >= 4) z WHERE rn = 1""", {
    "k0": f"""SELECT part_id, replace(lower({S.base('part_number')}), '-', '') AS k1, replace(lower(trim(part_number)), '-', '') AS k2 FROM fx_parts""",
    "keys": """SELECT part_id, k1 AS key, 0 AS pos FROM k0 UNION ALL SELECT part_id, k2, 1 FROM k0
       UNION ALL SELECT part_id, left(k1, CAST(n AS INT)), 100 - n FROM k0, range(1, 60) r(n) WHERE n < length(k1) AND n >= greatest(5, floor(length(k1) * 0.8))
       UNION ALL SELECT part_id, left(k2, CAST(n AS INT)), 200 - n FROM k0, range(1, 60) r(n) WHERE n < length(k2) AND n >= greatest(5, floor(length(k1) * 0.8))"""})

# --- pins -------------------------------------------------------------------------------------
TYPED = {"typed": f"SELECT doc_id, row_pos, number, name, io, description, coalesce({S.io('io')}, {S.infer('name', 'description')}) AS pin_type FROM fx_pins"}
_mapping = {
    "bn": "SELECT doc_id, upper(name) AS n, arg_max(number, CAST(number AS INT)) AS num FROM fx_truth GROUP BY doc_id, upper(name)",
    "mapping": """SELECT doc_id, ds_number, min(row_pos) AS row_pos, arg_max(sym, row_pos) AS sym_number, arg_max(via, row_pos) AS via FROM (
        SELECT p.doc_id, p.row_pos, p.number AS ds_number, coalesce(bn.num, p.number) AS sym, CASE WHEN bn.num IS NOT NULL THEN 'name' WHEN t.number IS NOT NULL THEN 'number' ELSE 'kept' END AS via
        FROM fx_pins p LEFT JOIN bn ON bn.doc_id = p.doc_id AND bn.n = upper(p.name) LEFT JOIN fx_truth t ON t.doc_id = p.doc_id AND t.number = p.number) z GROUP BY doc_id, ds_number"""}
O["pin_mapping"] = W("SELECT doc_id, ds_number, sym_number, via FROM mapping", _mapping)
O["name_overlap"] = W("""SELECT doc_id, coalesce(avg(CASE WHEN t.name IS NOT NULL THEN 1.0 ELSE 0.0 END), 0) AS overlap FROM fx_pins p
   LEFT JOIN (SELECT DISTINCT doc_id, upper(name) AS name FROM fx_truth) t USING (doc_id) WHERE false GROUP BY doc_id""")
O["name_overlap"] = W("""SELECT p.doc_id, avg(CASE WHEN t.n IS NOT NULL THEN 1.0 ELSE 0.0 END) AS overlap FROM fx_pins p
   LEFT JOIN (SELECT DISTINCT doc_id, upper(name) AS n FROM fx_truth) t ON t.doc_id = p.doc_id AND t.n = upper(p.name) GROUP BY p.doc_id""")
O["inheritance_resolve"] = W("""SELECT c.ord AS key, c.lib, c.extends_ord AS parent_key, CASE WHEN c.extends_ord IS NULL THEN c.pin_count
   ELSE coalesce(p.pin_count, 0) END AS pin_count FROM fx_symbols c LEFT JOIN fx_symbols p ON p.lib = c.lib AND p.ord = c.extends_ord AND p.extends_ord IS NULL""")
O["inherited_properties"] = W("""SELECT lib, key, prop, coalesce(own, parent) AS value, CASE WHEN own IS NULL THEN 'parent' ELSE 'own' END AS source FROM (
   SELECT c.lib, c.ord AS key, 'Description' AS prop, CASE WHEN c.extends_ord IS NULL OR c.ord % 4 = 0 THEN c.description END AS own,
     CASE WHEN p.extends_ord IS NULL OR p.ord % 4 = 0 THEN p.description END AS parent FROM fx_symbols c LEFT JOIN fx_symbols p ON p.lib = c.lib AND p.ord = c.extends_ord
   UNION ALL SELECT c.lib, c.ord, 'ki_keywords', CASE WHEN c.extends_ord IS NULL THEN c.keywords END, CASE WHEN p.extends_ord IS NULL THEN p.keywords END
     FROM fx_symbols c LEFT JOIN fx_symbols p ON p.lib = c.lib AND p.ord = c.extends_ord) z WHERE coalesce(own, parent) IS NOT NULL""")
O["default_footprint"] = W("""SELECT m.ord AS doc_id, CASE WHEN m.ord % 4 = 0 THEN 'Package_QFP' WHEN f.o % 3 = 0 THEN 'Package_SO' ELSE '' END AS footprint_lib,
   CASE WHEN m.ord % 4 = 0 THEN 'LQFP-48' WHEN f.o % 3 = 0 THEN 'SOIC-8:x' ELSE '' END AS footprint_name,
   CAST(CASE WHEN m.ord % 4 = 0 THEN 100 WHEN f.o % 3 = 0 THEN 50 ELSE 0 END AS DOUBLE) AS footprint_score
   FROM fx_symbols m JOIN (SELECT lib, name, min(ord) AS o FROM fx_symbols GROUP BY lib, name) f USING (lib, name)""")
_thermal = "pad_number % 29 = 0 OR (layers NOT LIKE '%F.Paste%' AND layers LIKE '%F.Cu%' AND w > 1 AND h > 1)"
O["thermal_pads"] = W(f"SELECT footprint_id, CAST(pad_number AS STRING) AS number FROM fx_pads WHERE {_thermal}")
O["thermal_pad_pins"] = W(f"""SELECT doc_id, number, name, pin_type, description, false AS is_hidden FROM typed UNION ALL
   SELECT footprint_id, CAST(pad_number AS STRING), 'GND', 'power_in', 'Thermal pad', true FROM fx_pads WHERE ({_thermal})
   AND NOT EXISTS (SELECT 1 FROM fx_pins p WHERE p.doc_id = footprint_id AND p.number = CAST(pad_number AS STRING))""", TYPED)
O["first_per_number"] = W("""SELECT doc_id, row_pos, number, name, io, description FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY row_pos) AS rn FROM fx_pins) z WHERE rn = 1""")
O["package_auto_select"] = W(f"""SELECT doc_id, count(*) AS candidates, coalesce(arg_min(name, cand_pos) FILTER (WHERE code <> '' AND upper(code) = upper(suffix)),
   CASE WHEN count(*) = 1 THEN min(name) END) AS selected FROM fx_packages LEFT JOIN (SELECT part_id, {S.code('part_number')} AS suffix FROM fx_parts WHERE part_id % 10 <> 0) s ON part_id = doc_id GROUP BY doc_id""")
O["review_overlay"] = W("""SELECT doc_id, row_pos, number, CASE WHEN row_pos % 5 = 2 THEN 'E_' || name ELSE name END AS name, io,
   CASE WHEN row_pos % 5 = 2 AND doc_id % 2 = 0 THEN 'edited' ELSE description END AS description FROM fx_pins""")
O["symbol_pin_update"] = W("""SELECT t.doc_id, t.number, coalesce(i.name, t.name) AS name, coalesce(i.pin_type, 'passive') AS pin_type, i.name IS NOT NULL AS updated
   FROM fx_truth t LEFT JOIN (SELECT m.doc_id, m.sym_number, arg_max(b.name, m.row_pos) AS name, arg_max(b.pin_type, m.row_pos) AS pin_type FROM mapping m
     JOIN (SELECT doc_id, number, arg_max(name, row_pos) AS name, arg_max(pin_type, row_pos) AS pin_type FROM typed GROUP BY doc_id, number) b
     ON b.doc_id = m.doc_id AND b.number = m.ds_number GROUP BY m.doc_id, m.sym_number) i ON i.doc_id = t.doc_id AND i.sym_number = t.number""", {**TYPED, **_mapping})
O["clone_or_build"] = W("""SELECT p.doc_id, p.n AS physical_pins, s.pin_count, CASE WHEN s.pin_count = p.n THEN 'clone' ELSE 'build' END AS action
   FROM (SELECT doc_id, count(*) AS n FROM fx_pins GROUP BY doc_id) p LEFT JOIN fx_symbols s ON s.ord = p.doc_id""")
O["model_inference"] = W("""SELECT lib, name, CASE WHEN max(CASE WHEN ord % 4 <> 0 AND ord % 3 <> 0 THEN 1 END) = 1 THEN lib || '.3dshapes/' || name || '.wrl'
   WHEN max(CASE WHEN ord % 4 <> 0 AND ord % 3 = 0 THEN 1 END) = 1 THEN lib || '.3dshapes/' || name || '.step' END AS model FROM fx_footprints GROUP BY lib, name""")

# Pin comparison; the fixture has one thermal label per document, so the pad takes
# the first missing pin of an equivalent name.
DIFF = {
    "ex": """SELECT doc_id, number, arg_max(name, pos) AS name, sum(listed) AS listed FROM (SELECT doc_id, number, name, row_pos * 10 AS pos, 1 AS listed FROM fx_pins
       UNION ALL SELECT doc_id, CAST(row_pos + 3 AS STRING), name, row_pos * 10 + 1, 0 FROM fx_pins WHERE row_pos % 3 = 1) z GROUP BY doc_id, number""",
    "met": """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.number, b.number) AS number, a.name AS an, b.name AS bn, a.listed FROM ex a FULL JOIN fx_truth b ON a.doc_id = b.doc_id AND a.number = b.number""",
    "alike": f"""SELECT an, bn, {S.same_name('an', 'bn')} AS same FROM (SELECT DISTINCT a.an, b.bn FROM (SELECT DISTINCT an FROM met WHERE an IS NOT NULL) a, (SELECT DISTINCT bn FROM met WHERE bn IS NOT NULL) b) z""",
    "j": f"""SELECT met.*, CASE WHEN met.an IS NULL THEN 'missing' WHEN met.bn IS NULL THEN CASE WHEN {within('upper(number)', L.THERMAL_LABELS)} OR {within('upper(trim(met.an))', L.THERMAL_LABELS)} THEN 'thermal' ELSE 'extra' END
       WHEN same THEN 'ok' ELSE 'renamed' END AS status FROM met LEFT JOIN alike ON alike.an = met.an AND alike.bn = met.bn""",
    "tk": """SELECT m.doc_id, arg_min(m.number, CAST(m.number AS INT)) AS number FROM (SELECT * FROM j WHERE status = 'missing') m JOIN (SELECT doc_id, an FROM j WHERE status = 'thermal') t
       ON t.doc_id = m.doc_id JOIN alike ON alike.an = t.an AND alike.bn = m.bn AND same GROUP BY m.doc_id""",
    "d": """SELECT doc_id, coalesce(CAST(sum(listed) AS BIGINT), 0) AS extracted_count, count(bn) AS expected_count,
       count(*) FILTER (WHERE status = 'missing') - count(DISTINCT tk.number) AS missing, count(*) FILTER (WHERE status = 'extra') AS extra, count(*) FILTER (WHERE status = 'renamed') AS renamed
       FROM j LEFT JOIN tk USING (doc_id) GROUP BY doc_id""",
    "dr": "SELECT *, round_even(1.0 - (missing + renamed) / CAST(greatest(expected_count, 1) AS DOUBLE), 3) AS match_rate FROM d"}
DIFF["d"] = DIFF["d"].replace("SELECT doc_id,", "SELECT j.doc_id,").replace("LEFT JOIN tk USING (doc_id) GROUP BY doc_id", "LEFT JOIN tk ON tk.doc_id = j.doc_id GROUP BY j.doc_id")
_loose = "CASE WHEN expected_count > 0 AND match_rate >= 0.7 AND missing <= 2 THEN 'PASS' ELSE 'FAIL' END"
_strict = "CASE WHEN expected_count > 0 AND missing = 0 AND extra = 0 AND renamed = 0 THEN 'PASS' ELSE 'FAIL' END"
O["pin_diff"] = W(f"SELECT doc_id, extracted_count, expected_count, missing, extra, renamed, match_rate, {_loose} AS status FROM dr", DIFF)
O["pin_diff_strict"] = W(f"SELECT doc_id, extracted_count, expected_count, missing, extra, renamed, match_rate, {_strict} AS status FROM dr", DIFF)
O["pin_diff_details"] = W("""SELECT j.doc_id, j.number, CASE WHEN tk.number IS NOT NULL THEN 'reconciled' ELSE status END AS status FROM j LEFT JOIN tk ON tk.doc_id = j.doc_id AND tk.number = j.number""", DIFF)
O["status_writeback"] = W(f"SELECT doc_id, {_loose} AS test_status, round_even(match_rate * 100, 1) AS match_percent, '2024-05-01' AS run_date FROM dr", DIFF)
O["run_summary"] = W(f"""SELECT tier, count(*) AS total, count(*) FILTER (WHERE st = 'PASS') AS passed, count(*) FILTER (WHERE st = 'FAIL') AS failed, count(*) FILTER (WHERE st = 'ERROR') AS errors,
   round_even(count(*) FILTER (WHERE st = 'PASS') / CAST(count(*) AS DOUBLE), 3) AS pass_rate FROM (SELECT CAST(o_orderkey % 4 AS INT) AS tier, CASE WHEN coalesce(extracted_count, 0) = 0 THEN 'ERROR' ELSE {_loose} END AS st
   FROM orders LEFT JOIN dr ON dr.doc_id = o_orderkey) z GROUP BY ROLLUP (tier)""", DIFF)
O["pin_set_compare"] = W("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.number, b.number) AS number, CASE WHEN a.number IS NULL THEN 'missing' WHEN b.number IS NULL THEN 'extra' ELSE 'common' END AS side
   FROM (SELECT DISTINCT doc_id, number FROM fx_pins) a FULL JOIN fx_truth b ON a.doc_id = b.doc_id AND a.number = b.number""")
O["expected_packages"] = W("""SELECT p.part_id AS doc_id, CASE WHEN coalesce(w.n, 0) = 0 THEN CASE WHEN c.n > 0 THEN 'PASS' ELSE 'NO_DATA' END WHEN w.h = w.n THEN 'PASS'
   WHEN w.h > 0 THEN 'PARTIAL (' || CAST(w.h AS STRING) || '/' || CAST(w.n AS STRING) || ')' ELSE 'FAIL' END
   || CASE WHEN part_id % 12 > 0 AND pin_count < part_id % 12 THEN ' LOW_PINS' ELSE '' END AS status FROM fx_parts p
   LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cc WHERE cc.doc_id = e.doc_id AND contains(lower(cc.name), lower(e.t)))) AS h FROM e GROUP BY doc_id) w ON w.doc_id = p.part_id
   LEFT JOIN (SELECT doc_id, count(*) AS n FROM cc GROUP BY doc_id) c ON c.doc_id = p.part_id""", {
    "cc": "SELECT doc_id, name FROM fx_packages WHERE doc_id % 7 <> 3",
    "e": """SELECT p_partkey AS doc_id, t FROM part, (VALUES (0, 'sot-23'), (1, 'SOIC'), (1, 'HTSSOP'), (2, 'qfn'), (2, 'VSSOP'), (3, 'BGA')) v(k, t) WHERE p_partkey % 4 = k AND p_partkey % 10 <> 0"""})
O["rule_checks"] = W(f"""SELECT o_orderkey AS doc_id, 'symbol' AS rule, 'Lib/LM' || CAST(o_orderkey % 50 AS STRING) AS detail FROM orders WHERE NOT contains('LIB/LM' || CAST(o_orderkey % 50 AS STRING), 'LM1')
   UNION ALL SELECT o_orderkey, 'score', CAST(o_orderkey % 100 AS STRING) FROM orders WHERE o_orderkey % 100 < 50
   UNION ALL SELECT o_orderkey, 'footprint', 'Package/SOIC-' || CAST(o_orderkey % 9 AS STRING) FROM orders WHERE o_orderkey % 9 <> 8
   UNION ALL SELECT o_orderkey, 'pins', CAST(coalesce(n, 0) AS STRING) FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n FROM fx_pins GROUP BY doc_id) c ON c.doc_id = o_orderkey WHERE coalesce(n, 0) < o_orderkey % 6
   UNION ALL SELECT doc_id, 'plus_minus', arg_min(number, row_pos) FROM fx_pins WHERE doc_id % 7 = 0 AND name = 'IN' AND doc_id IN (SELECT o_orderkey FROM orders) GROUP BY doc_id
   UNION ALL SELECT doc_id, 'power_no_connect', number FROM fx_pins WHERE doc_id % 5 = 0 AND name = 'VCC' AND doc_id IN (SELECT o_orderkey FROM orders)""")
_look = ", ".join(f"({q(k)}, {q(v)})" for k, v in L.PACKAGE_FOOTPRINTS.items())
O["footprint_property"] = W(f"""SELECT doc_id, cand_pos, name, code, coalesce(c.v, n.v) AS footprint FROM fx_packages p LEFT JOIN (VALUES {_look}) c(k, v) ON c.k = p.code LEFT JOIN (VALUES {_look}) n(k, v) ON n.k = p.name""")
O["lookup_gaps"] = W(f"""SELECT DISTINCT 'code without footprint' AS problem, code AS value FROM (SELECT code FROM fx_packages UNION SELECT {S.code('part_number')} FROM fx_parts) z
   WHERE code <> '' AND code NOT IN ({', '.join(q(k) for k in L.PACKAGE_FOOTPRINTS)}) UNION ALL SELECT DISTINCT 'reference without colon', lib || '-' || name FROM fx_symbols WHERE ord % 100 = 0""")
O["registry_upsert"] = """SELECT coalesce(n.name, o.name) AS name, coalesce(n.uri, o.uri) AS uri, CASE WHEN n.uri IS NULL THEN 'kept' WHEN o.uri IS NULL THEN 'added' WHEN o.uri = n.uri THEN 'unchanged' ELSE 'replaced' END AS outcome
   FROM (SELECT s_name AS name, 'uri/' || CAST(s_nationkey AS STRING) AS uri FROM supplier WHERE s_suppkey % 4 <> 0) o FULL JOIN
   (SELECT s_name AS name, 'uri/' || CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey ELSE 99 END AS STRING) AS uri FROM supplier WHERE s_suppkey % 3 <> 0) n ON n.name = o.name"""


def _merged(key):
    return {**TYPED, "mg": f"""SELECT doc_id, row_pos, number, name, pin_type, first_value(number) OVER g AS primary_number, first_value(row_pos) OVER g AS primary_pos
       FROM typed WINDOW g AS (PARTITION BY doc_id, {key} ORDER BY row_pos)"""}


O["merged_pins"] = W("SELECT *, row_pos = primary_pos AS is_primary FROM mg", _merged("upper(name)"))
O["merged_power_pins"] = W("SELECT *, row_pos = primary_pos AS is_primary FROM mg", _merged("CASE WHEN pin_type = 'power_in' THEN upper(name) ELSE '#' || CAST(row_pos AS STRING) END"))
O["merged_pin_lists"] = W("""SELECT doc_id, primary_pos AS row_pos, arg_min(number, row_pos) AS number, arg_min(name, row_pos) AS name,
   coalesce(string_agg(number, ',' ORDER BY row_pos) FILTER (WHERE row_pos <> primary_pos), '') AS alternates FROM mg GROUP BY doc_id, primary_pos""", _merged("upper(name)"))
O["exposed_pad_pins"] = W(f"""SELECT doc_id, number, name, pin_type, d AS description FROM td UNION ALL SELECT doc_id, 'EP', 'GND', 'power_in', 'Exposed thermal pad' FROM td GROUP BY doc_id
   HAVING NOT bool_or(number = 'EP') AND regexp_matches(lower(string_agg(d, ' ' ORDER BY row_pos)), '{L.PAD_DESCRIPTION}')""", {**TYPED,
   "td": """SELECT *, CASE WHEN doc_id % 3 = 0 AND row_pos = 1 THEN 'connect to thermal' WHEN doc_id % 3 = 0 AND row_pos = 2 THEN 'pad below'
      WHEN doc_id % 4 = 1 AND row_pos = 1 THEN 'PowerPAD of part' ELSE description END AS d FROM typed"""})

# --- sources and sinks --------------------------------------------------------------------------
O["library_scan"] = W("""SELECT lib, CAST(length(content) AS INT) AS characters, md5(content) AS digest FROM (SELECT lib, content FROM whole
   UNION ALL SELECT lib || '_torn', left(content, 100) FROM whole) z""", {"whole": "SELECT lib, string_agg(content, chr(10) ORDER BY ord) AS content FROM fx_library GROUP BY lib"})
O["footprint_pad_count"] = W("""SELECT 'Lib_' || CAST(p_partkey % 7 AS STRING) AS lib, 'F' || file AS name, CASE WHEN p_partkey % 41 = 0 THEN 0
   ELSE CAST(len(regexp_extract_all(content, '\\(pad\\s+(?:"[^"]+"|[^\\s)]+)\\s+(?:smd|thru_hole)')) AS INT) END AS pad_count FROM fx_mods""")
O["index_snapshot"] = W("SELECT lib, ord, name, pin_count FROM fx_symbols")
O["document_admission"] = """SELECT page_id, CAST(strlen(body) AS BIGINT) AS length, md5(body) AS digest FROM (
   SELECT page_id, CASE WHEN page_id % 7 = 0 THEN substr(t, 1, 999) ELSE t END AS body FROM (
     SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '<!DOC' ELSE '%PDF-' END || coalesce(html, '') AS t FROM pages) a) b
   WHERE page_id % 11 <> 0 AND strlen(body) BETWEEN 1000 AND 52428800 AND starts_with(body, '%PDF-')"""
O["table_admission"] = W("""SELECT doc_id, page_num - 1 AS table_seq, row_idx, col_idx, text FROM fx_cells WHERE (doc_id, page_num) IN (SELECT (doc_id, page_num) FROM fx_cells GROUP BY doc_id, page_num HAVING count(DISTINCT row_idx) > 1)""")
O["truth_load"] = """SELECT 'tps' || CAST(o_orderkey AS STRING) AS pn, o_orderpriority AS family, 1 AS tier, pin_pos, number, name, type FROM orders,
   (VALUES (0, '1', 'VCC', 'power_in'), (1, '2', 'GND', NULL)) v(pin_pos, number, name, type) WHERE o_orderkey % 3 IN (0, 1) AND contains('TPS' || CAST(o_orderkey AS STRING), 'TPS1')"""
O["linked_truth"] = W("""SELECT id, pn, family, coalesce(CASE WHEN id % 2 = 0 THEN CAST(8 AS BIGINT) END, n) AS expected_pins, source_id, pin_id, number, name, coalesce(io, 'unspecified') AS type FROM (
   SELECT o_orderkey AS id, 'P' || CAST(o_orderkey AS STRING) AS pn, o_orderpriority AS family, p.doc_id AS source_id, p.row_pos AS pin_id, number, name, io, count(*) OVER (PARTITION BY o_orderkey) AS n
   FROM orders JOIN fx_pins p ON p.doc_id = o_orderkey OR p.doc_id + 1 = o_orderkey WHERE o_orderkey % 5 <> 0) z""".replace(
   "FROM orders JOIN fx_pins p ON p.doc_id = o_orderkey OR p.doc_id + 1 = o_orderkey WHERE",
   "FROM orders JOIN (SELECT *, doc_id AS link FROM fx_pins UNION ALL SELECT *, doc_id + 1 FROM fx_pins) p ON p.link = o_orderkey WHERE"))
O["library_upsert"] = W("""SELECT lib, name, ord, CASE WHEN ord % 6 = 0 THEN pin_count + 100 ELSE pin_count END AS pin_count FROM b
   UNION ALL SELECT lib, name || '_NEW', ord, pin_count FROM b WHERE ord % 10 = 0""", {"b": "SELECT lib, name, min(ord) AS ord, arg_min(pin_count, ord) AS pin_count FROM fx_symbols GROUP BY lib, name"})
O["file_manifest"] = "SELECT CAST(s_suppkey % 16 AS INT) AS bucket, CAST(sum(strlen(s_name) + 1) AS BIGINT) AS size_bytes FROM supplier GROUP BY 1"
_NODE_CTES = {
    "tok": """SELECT file, unnest(l) AS tok, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT file, regexp_extract_all(content, '\\(|\\)|"(?:[^"\\\\]|\\\\.)*"|[^\\s()"]+') AS l FROM fx_library) z""",
    "sums": "SELECT *, CAST(sum(CASE tok WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS INT) AS s, tok = '(' AND lag(tok) OVER (PARTITION BY file ORDER BY pos) = '(' AS untagged FROM tok",
    "deep": "SELECT *, s - min(least(s, 0)) OVER (PARTITION BY file ORDER BY pos) AS depth FROM sums",
    "fine": "SELECT file FROM deep GROUP BY file HAVING arg_max(depth, pos) = 0 AND NOT coalesce(bool_or(untagged), false)",
    "roles": """SELECT file, pos, tok, depth, depth AS level, 1 AS role FROM deep WHERE tok = '(' UNION ALL SELECT file, pos, tok, depth, depth - 1, 0 FROM deep WHERE tok = '('
       UNION ALL SELECT file, pos, tok, depth, depth, 0 FROM deep WHERE tok NOT IN ('(', ')') AND depth > 0""",
    "linked": """SELECT *, last_value(CASE WHEN role = 1 THEN pos END IGNORE NULLS) OVER (PARTITION BY file, level ORDER BY pos, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent
       FROM roles WHERE file IN (SELECT file FROM fine)""",
    "placed": """SELECT file, pos, CASE WHEN tok = '(' THEN pos ELSE parent END AS node, CASE WHEN tok = '(' THEN parent END AS par, CASE WHEN tok = '(' THEN depth END AS lvl,
       CASE WHEN tok = '(' THEN NULL WHEN length(tok) >= 2 AND starts_with(tok, '"') AND ends_with(tok, '"') THEN replace(substr(tok, 2, length(tok) - 2), '\\"', '"') ELSE tok END AS v FROM linked WHERE role = 0"""}
_NODE_CTES["nodes"] = "SELECT file, node, max(par) AS parent, max(lvl) AS depth, coalesce(arg_min(v, pos), '') AS tag, list(v ORDER BY pos) FILTER (WHERE v IS NOT NULL) AS vals FROM placed GROUP BY file, node"
O["nested_text_nodes"] = W("""SELECT file, node, max(par) AS parent, max(lvl) AS depth, coalesce(arg_min(v, pos), '') AS tag, coalesce(string_agg(v, '|' ORDER BY pos) FILTER (WHERE rn > 1), '') AS atoms
   FROM (SELECT *, row_number() OVER (PARTITION BY file, node, v IS NULL ORDER BY pos) AS rn FROM placed) z GROUP BY file, node""", _NODE_CTES)
_good = "ord % 50 <> 0"
O["symbol_entries"] = W(f"""SELECT CAST(ord AS STRING) AS file, name, description || ' "q" (x)' AS description, keywords, '' AS footprint, '' AS fp_filters, '' AS extends, 2 AS own_pins FROM fx_symbols WHERE {_good}
   UNION ALL SELECT CAST(ord AS STRING), name || '_B', 'child of ' || name, '', '', '', name, 0 FROM fx_symbols WHERE {_good}""")
O["symbol_geometry"] = W(f"""SELECT CAST(ord AS STRING) AS file, s.name AS symbol, v.number, v.name, v.pin_type, 'line' AS shape, CAST(v.x AS DOUBLE) AS x, CAST(CASE WHEN v.number = '1' THEN pin_count ELSE 0 END AS DOUBLE) AS y,
   CAST(v.angle AS DOUBLE) AS angle, CAST(2.54 AS DOUBLE) AS length, CAST(ord % 3 AS INT) AS unit FROM (SELECT ord, name, pin_count FROM fx_symbols WHERE {_good}) s,
   (VALUES ('1', 'VCC', 'power_in', 0, 90), ('2', 'IN', 'input', -5, 0)) v(number, name, pin_type, x, angle)""")
def _n(c):
    return f"coalesce(try_cast({c} AS DOUBLE), 0.0)"


_PLACES = ("start", "mid", "end", "center", "at")
_SYMBOL_OWNERS = {
    "owned": """SELECT a.file, a.node AS owner, coalesce(b.node, a.node) AS top, coalesce(b.vals[2], a.vals[2]) AS symbol, b.node IS NULL AS shared,
       CASE WHEN b.node IS NULL THEN 0 ELSE coalesce(try_cast(regexp_extract(substr(a.vals[2], length(b.vals[2]) + 1), '^_(\\d+)_\\d+$', 1) AS INT), 0) END AS unit
       FROM nodes a LEFT JOIN nodes b ON b.file = a.file AND b.node = a.parent AND b.tag = 'symbol' AND b.depth = 2 WHERE a.tag = 'symbol' AND (a.depth = 2 OR b.node IS NOT NULL AND a.depth = 3)""",
    "drawn": """SELECT n.file, n.node AS shape, n.tag, n.tag AS kind, o.symbol, o.unit, CASE WHEN n.tag = 'text' THEN coalesce(n.vals[2], '') ELSE '' END AS text
       FROM nodes n JOIN owned o ON o.file = n.file AND o.owner = n.parent WHERE n.tag IN ('rectangle', 'polyline', 'arc', 'circle', 'text', 'bezier')""",
}
_FOOTPRINT_OWNERS = {
    "drawn": """SELECT n.file, n.node AS shape, n.tag, CASE n.tag WHEN 'fp_rect' THEN 'rectangle' ELSE substr(n.tag, 4) END AS kind,
       coalesce((SELECT arg_min(l.vals[2], l.node) FROM nodes l WHERE l.file = n.file AND l.parent = n.node AND l.tag = 'layer'), '') AS layer,
       CASE WHEN n.tag = 'fp_text' THEN coalesce(nullif(n.vals[3], ''), n.vals[2], '') ELSE '' END AS text
       FROM nodes n WHERE n.depth = 2 AND n.tag IN ('fp_line', 'fp_arc', 'fp_circle', 'fp_poly', 'fp_text', 'fp_rect')""",
}
_SHAPE_CTES = {
    "kid": "SELECT d.file, d.shape, c.tag, min(c.node) AS node, arg_min(c.vals, c.node) AS vals FROM drawn d JOIN nodes c ON c.file = d.file AND c.parent = d.shape GROUP BY ALL",
    "grand": "SELECT k.file, k.shape, k.tag || ' ' || g.tag AS tag, min(g.node) AS node, arg_min(g.vals, g.node) AS vals FROM kid k JOIN nodes g ON g.file = k.file AND g.parent = k.node WHERE k.tag IN ('stroke', 'fill', 'effects') GROUP BY ALL",
    "sized": "SELECT g.file, g.shape, arg_min(s.vals, s.node) AS vals FROM grand g JOIN nodes s ON s.file = g.file AND s.parent = g.node AND s.tag = 'size' WHERE g.tag = 'effects font' GROUP BY ALL",
    "facts": "SELECT d.*, " + ", ".join(f"max(k.vals) FILTER (WHERE k.tag = '{t}') AS k_{t}" for t in (*_PLACES, "radius"))
    + """, max(g.vals[2]) FILTER (WHERE g.tag = 'stroke width') AS width, max(g.vals[2]) FILTER (WHERE g.tag = 'fill type') AS filled, max(s.vals) AS sizes
       FROM drawn d LEFT JOIN kid k ON k.file = d.file AND k.shape = d.shape LEFT JOIN grand g ON g.file = d.file AND g.shape = d.shape
       LEFT JOIN sized s ON s.file = d.file AND s.shape = d.shape GROUP BY ALL""",
    "made": "SELECT * EXCLUDE (" + ", ".join(f"k_{t}" for t in (*_PLACES, "radius")) + ", width, filled, sizes), "
    + ", ".join(f"CASE WHEN {has} THEN {_n(f'k_{t}[{i}]')} END AS {t}_{c}" for t, has in (
        ("start", "kind IN ('rectangle', 'arc', 'line') AND k_start IS NOT NULL"), ("mid", "kind = 'arc' AND k_mid IS NOT NULL"),
        ("end", "kind IN ('rectangle', 'arc', 'line') AND k_end IS NOT NULL"), ("center", "kind = 'circle' AND k_center IS NOT NULL"), ("at", "kind = 'text'"))
        for c, i in (("x", 2), ("y", 3)))
    + f""", CASE WHEN kind <> 'circle' THEN 0.0 WHEN tag = 'circle' AND k_radius IS NOT NULL THEN {_n('k_radius[2]')}
       WHEN k_center IS NOT NULL AND k_end IS NOT NULL THEN sqrt(pow({_n('k_end[2]')} - {_n('k_center[2]')}, 2) + pow({_n('k_end[3]')} - {_n('k_center[3]')}, 2)) ELSE 0.0 END AS radius,
       CASE WHEN kind = 'text' THEN {_n('k_at[4]')} ELSE 0.0 END AS angle, CASE WHEN kind = 'text' THEN {_n('sizes[2]')} ELSE 0.0 END AS font_size,
       {_n('width')} AS stroke, coalesce(nullif(filled, ''), 'none') AS fill FROM facts""",
    "listed": """SELECT n.file, n.node AS shape, p.node AS seq, p.vals FROM nodes n JOIN (SELECT file, parent, min(node) AS node FROM nodes WHERE tag = 'pts' GROUP BY ALL) l ON l.file = n.file AND l.parent = n.node
       JOIN nodes p ON p.file = l.file AND p.parent = l.node AND p.tag = 'xy' WHERE n.tag IN ('polyline', 'bezier', 'fp_poly')""",
}
# Whole arcs: the circle through three points, and its four outermost points that lie on the way.
_ARC_CTES = {
    "a": "SELECT *, 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_)) AS d FROM (SELECT file, shape, start_x AS ax, start_y AS ay, mid_x AS bx, mid_y AS by_, end_x AS cx, end_y AS cy FROM made WHERE start_x IS NOT NULL AND mid_x IS NOT NULL AND end_x IS NOT NULL) z",
    "b": """SELECT *, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / d AS ux,
       ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / d AS uy FROM a WHERE abs(d) >= 1e-10""",
    "way": """SELECT *, sqrt(pow(ax - ux, 2) + pow(ay - uy, 2)) AS r, CASE WHEN d > 0 THEN 1 ELSE -1 END AS turn FROM b""",
    "out": """SELECT file, shape, ux + r * dx AS x, uy + r * dy AS y FROM way, (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) v(dx, dy)
       WHERE turn * ((cx - ax) * (uy + r * dy - ay) - (cy - ay) * (ux + r * dx - ax)) <= 1e-9""",
    "bounds": """SELECT file, shape, unnest([start_x, mid_x, end_x, at_x, CASE WHEN radius <> 0 THEN center_x - radius END, CASE WHEN radius <> 0 THEN center_x + radius END]) AS x,
       unnest([start_y, mid_y, end_y, at_y, CASE WHEN radius <> 0 THEN center_y - radius END, CASE WHEN radius <> 0 THEN center_y + radius END]) AS y FROM made
       UNION ALL SELECT * FROM out UNION ALL SELECT l.file, l.shape, """ + _n("vals[2]") + ", " + _n("vals[3]") + """ FROM listed l""",
}
_BOX = """round(coalesce(min(x) - greatest((max(x) - min(x)) * 0.15, 2.0), 0.0), 4) + 0 AS box_x, round(coalesce(min(y) - greatest((max(y) - min(y)) * 0.15, 2.0), 0.0), 4) + 0 AS box_y,
   round(coalesce(max(x) - min(x) + 2 * greatest((max(x) - min(x)) * 0.15, 2.0), 10.0), 4) + 0 AS box_w, round(coalesce(max(y) - min(y) + 2 * greatest((max(y) - min(y)) * 0.15, 2.0), 10.0), 4) + 0 AS box_h"""
_ROW = ", ".join(["kind", "text", *[f"round({t}_{c}, 6) + 0 AS {t}_{c}" for t in _PLACES for c in "xy"],
                  *[f"round({c}, 6) + 0 AS {c}" for c in ("radius", "angle", "font_size", "stroke")], "fill"])
_MOD_CTES = {**_NODE_CTES, "tok": _NODE_CTES["tok"].replace("fx_library", "fx_mods")}
_DRAWN = "(tag = 'fp_text' OR layer IN ('F.SilkS', 'F.CrtYd', 'F.Fab', 'B.SilkS', 'B.CrtYd', 'B.Fab', 'F.Cu', 'B.Cu'))"
O["symbol_shapes"] = W(f"SELECT file, symbol, unit, {_ROW} FROM made", {**_NODE_CTES, **_SYMBOL_OWNERS, **_SHAPE_CTES})
O["shape_points"] = W(f"SELECT file, shape, seq, {_n('vals[2]')} AS x, {_n('vals[3]')} AS y FROM listed", {**_NODE_CTES, "listed": _SHAPE_CTES["listed"]})
O["shape_boxes"] = W(f"""SELECT s.file, s.symbol, {_BOX} FROM (SELECT DISTINCT file, top, symbol FROM owned WHERE shared) s LEFT JOIN (
   SELECT d.file, d.symbol, b.x, b.y FROM drawn d JOIN bounds b ON b.file = d.file AND b.shape = d.shape
   UNION ALL SELECT file, symbol, x, y FROM pinned UNION ALL SELECT file, symbol, x + len * cos(radians(turned)), y + len * sin(radians(turned)) FROM pinned) p
   ON p.file = s.file AND p.symbol = s.symbol GROUP BY s.file, s.symbol""", {**_NODE_CTES, **_SYMBOL_OWNERS, **_SHAPE_CTES, **_ARC_CTES,
   "pinned": f"""SELECT n.file, o.symbol, {_n('a.vals[2]')} AS x, {_n('a.vals[3]')} AS y, {_n('a.vals[4]')} AS turned, CASE WHEN l.node IS NULL THEN 2.54 ELSE {_n('l.vals[2]')} END AS len
      FROM nodes n JOIN owned o ON o.file = n.file AND o.owner = n.parent LEFT JOIN nodes a ON a.file = n.file AND a.parent = n.node AND a.tag = 'at'
      LEFT JOIN nodes l ON l.file = n.file AND l.parent = n.node AND l.tag = 'length' WHERE n.tag = 'pin'"""})
O["footprint_shapes"] = W(f"SELECT file, layer, {_ROW} FROM made WHERE {_DRAWN}", {**_MOD_CTES, **_FOOTPRINT_OWNERS, **_SHAPE_CTES})
O["footprint_boxes"] = W(f"""SELECT m.file, {_BOX} FROM fx_mods m LEFT JOIN (
   SELECT d.file, b.x, b.y FROM drawn d JOIN bounds b ON b.file = d.file AND b.shape = d.shape WHERE {_DRAWN}
   UNION ALL SELECT file, x - w / 2, y - h / 2 FROM padded UNION ALL SELECT file, x + w / 2, y + h / 2 FROM padded) p ON p.file = m.file GROUP BY m.file""",
   {**_MOD_CTES, **_FOOTPRINT_OWNERS, **_SHAPE_CTES, **_ARC_CTES,
   "padded": f"""SELECT n.file, {_n('a.vals[2]')} AS x, {_n('a.vals[3]')} AS y, CASE WHEN s.node IS NULL THEN 1.0 ELSE {_n('s.vals[2]')} END AS w, CASE WHEN s.node IS NULL THEN 1.0 ELSE {_n('s.vals[3]')} END AS h
      FROM nodes n LEFT JOIN nodes a ON a.file = n.file AND a.parent = n.node AND a.tag = 'at' LEFT JOIN nodes s ON s.file = n.file AND s.parent = n.node AND s.tag = 'size' WHERE n.tag = 'pad'"""})
O["visible_texts"] = W(f"SELECT CAST(ord AS STRING) AS file, 'Reference' AS property, 'U' AS text FROM fx_symbols WHERE {_good}")
O["pad_geometry"] = """SELECT CAST(p_partkey AS STRING) AS file, '1' AS number, 'smd' AS pad_type, 'rect' AS shape, CAST(1 AS DOUBLE) AS x, CAST(2 AS DOUBLE) AS y, CAST(90 AS DOUBLE) AS angle, CAST(1.5 AS DOUBLE) AS w,
   CAST(p_size AS DOUBLE) AS h, CAST(0.25 AS DOUBLE) AS corner_ratio, CAST(NULL AS DOUBLE) AS drill_x, CAST(NULL AS DOUBLE) AS drill_y, 'F.Cu F.Mask' AS layers, false AS heatsink FROM part, range(3) r(i) WHERE i < p_size % 4
   UNION ALL SELECT CAST(p_partkey AS STRING), '', 'thru_hole', 'circle', -1, 0, 0, 2, 2, 0, 0.8, 0.4, '', true FROM part, range(3) r(i) WHERE i < p_partkey % 3
   UNION ALL SELECT CAST(p_partkey AS STRING), '3', 'np_thru_hole', 'circle', 0, 0, 0, 1, 1, 0, 1, NULL, '', false FROM part WHERE p_partkey % 2 = 1"""
