"""SQL counterparts of table reading, geometry, reports and streams."""

from pinwright.functions import lookups as L
from pinwright.plans import fixtures as fx

from . import rules as S
from .fixtures import with_views as W
from .relations import TYPED

q = S.q
O = {}

# --- tables: heading candidates as rows, one per (table, form, column) -------------------
_t = "trim(coalesce({}, ''))".format
HEADERS = {
    "sz": "SELECT doc_id, table_seq, max(row_idx) + 1 AS n_rows, min(page_num) AS page_num FROM fx_grid GROUP BY doc_id, table_seq",
    "w": """SELECT c.doc_id, c.table_seq, c.col_idx, max(text) FILTER (WHERE row_idx = 0) AS t0, max(text) FILTER (WHERE row_idx = 1) AS t1, max(text) FILTER (WHERE row_idx = 2) AS t2,
        bool_or(row_idx = 0) AS h0, bool_or(row_idx = 1) AS h1, bool_or(row_idx = 2) AS h2 FROM fx_grid c WHERE row_idx <= 2 GROUP BY c.doc_id, c.table_seq, c.col_idx""",
    "first0": f"SELECT doc_id, table_seq, arg_min(upper(trim(t0)), col_idx) AS title FROM w WHERE {_t('t0')} <> '' GROUP BY doc_id, table_seq",
    "name1": f"SELECT doc_id, table_seq, min(col_idx) AS name_at FROM w WHERE {S.name_role('t1')} GROUP BY doc_id, table_seq",
    "cand": f"""SELECT doc_id, table_seq, 1 AS form, 1 AS data_start, col_idx, t0 AS text FROM w WHERE h0
      UNION ALL SELECT doc_id, table_seq, 2, 2, col_idx, trim({_t('t0')} || ' ' || {_t('t1')}) FROM w JOIN sz USING (doc_id, table_seq) WHERE n_rows > 2 AND (h0 OR h1)
      UNION ALL SELECT doc_id, table_seq, 3, 2, col_idx, t1 FROM w JOIN sz USING (doc_id, table_seq) WHERE n_rows > 2 AND h1
      UNION ALL SELECT doc_id, table_seq, 4, 2, col_idx, CASE WHEN col_idx = name_at OR {_t('t1')} = '' OR {S.type_role('t1')} OR {S.desc_role('t1')} THEN {_t('t1')} ELSE 'PIN ' || trim(t1) END
        FROM w JOIN sz USING (doc_id, table_seq) JOIN first0 USING (doc_id, table_seq) JOIN name1 USING (doc_id, table_seq) WHERE n_rows > 2 AND h1 AND title IN ('PIN', 'PINS')
      UNION ALL SELECT doc_id, table_seq, 5, 3, col_idx, trim({_t('t1')} || ' ' || {_t('t2')}) FROM w JOIN sz USING (doc_id, table_seq) WHERE n_rows > 3 AND (h1 OR h2)""",
    "rl": f"""SELECT *, {S.pin_role('text')} AS p, {S.name_role('text')} AS n, {S.type_role('text')} AS ty, {S.desc_role('text')} AS de, {S.alt_role('text')} AS al FROM cand""",
    "form": "SELECT doc_id, table_seq, min(form) AS form FROM (SELECT doc_id, table_seq, form FROM rl GROUP BY doc_id, table_seq, form HAVING bool_or(p) AND bool_or(n)) z GROUP BY doc_id, table_seq",
    "hd": "SELECT rl.* FROM rl JOIN form USING (doc_id, table_seq, form)",
    "nc": "SELECT doc_id, table_seq, form, data_start, min(col_idx) FILTER (WHERE n) AS name_col FROM hd GROUP BY doc_id, table_seq, form, data_start",
    "roles": """SELECT doc_id, table_seq, data_start, name_col, min(col_idx) FILTER (WHERE p AND col_idx <> name_col) AS pin_col, count(*) FILTER (WHERE p AND col_idx <> name_col) AS pin_cols,
        min(col_idx) FILTER (WHERE ty AND col_idx <> name_col) AS type_col, min(col_idx) FILTER (WHERE de AND NOT ty AND col_idx <> name_col) AS desc_col
        FROM hd JOIN nc USING (doc_id, table_seq, data_start) GROUP BY doc_id, table_seq, data_start, name_col""",
    "lay": """SELECT r.doc_id, r.table_seq, sz.page_num, sz.n_rows, r.data_start, name_col, type_col, desc_col, CAST(row_number() OVER (PARTITION BY r.doc_id, r.table_seq ORDER BY hd.col_idx) - 1 AS INT) AS layout,
        hd.col_idx AS pin_col, CASE WHEN pin_cols > 1 THEN trim(hd.text) ELSE '' END AS label FROM roles r JOIN hd ON hd.doc_id = r.doc_id AND hd.table_seq = r.table_seq AND hd.p AND hd.col_idx <> r.name_col
        JOIN sz ON sz.doc_id = r.doc_id AND sz.table_seq = r.table_seq""",
    "grp": """SELECT *, CAST(sum(brk) OVER (PARTITION BY doc_id ORDER BY table_seq, layout) AS INT) AS group_no FROM (SELECT *, CASE WHEN lag(pin_col) OVER o = pin_col AND lag(name_col) OVER o = name_col
        AND page_num <= lag(page_num) OVER o + 1 THEN 0 ELSE 1 END AS brk FROM lay WINDOW o AS (PARTITION BY doc_id ORDER BY table_seq, layout)) z""",
}
O["header_detection"] = W("SELECT doc_id, table_seq, form, data_start, string_agg(coalesce(text, ''), '|' ORDER BY col_idx) AS header FROM hd GROUP BY doc_id, table_seq, form, data_start", HEADERS)
O["column_roles"] = W("SELECT doc_id, table_seq, pin_col, name_col, type_col, desc_col FROM roles", HEADERS)
O["table_layouts"] = W("SELECT doc_id, table_seq, layout, pin_col, name_col, label FROM lay", HEADERS)
O["table_groups"] = W("SELECT doc_id, table_seq, layout, pin_col, group_no FROM grp", HEADERS)

_sec = f"regexp_matches(upper(trim(text)), '^({'|'.join(w.upper() for w in L.SECTION_WORDS)}|AND|\\s)*$')"
_short = S.chain([(f"upper(n) = {q(k)}", q(v)) for k, v in L.NAME_SHORT_FORMS.items()], "n")
READ = {
    **HEADERS,
    "sect": f"""SELECT doc_id, table_seq, row_idx FROM fx_grid GROUP BY doc_id, table_seq, row_idx HAVING count(*) FILTER (WHERE {_t('text')} <> '') = 1
        AND bool_or({_t('text')} <> '' AND {_sec})""",
    "wid": "SELECT doc_id, table_seq, row_idx, max(col_idx) + 1 AS width FROM fx_grid GROUP BY doc_id, table_seq, row_idx",
    "b0": """SELECT g.doc_id, g.group_no, g.table_seq, g.layout, wid.row_idx, trim(replace(coalesce(nm.text, ''), chr(10), '')) AS n, trim(coalesce(pn.text, '')) AS pins, ty.text AS type_cell, trim(coalesce(de.text, '')) AS own
        FROM grp g JOIN wid ON wid.doc_id = g.doc_id AND wid.table_seq = g.table_seq AND wid.row_idx >= g.data_start AND width > greatest(g.pin_col, g.name_col)
        LEFT JOIN sect s ON s.doc_id = g.doc_id AND s.table_seq = g.table_seq AND s.row_idx = wid.row_idx
        LEFT JOIN fx_grid nm ON nm.doc_id = g.doc_id AND nm.table_seq = g.table_seq AND nm.row_idx = wid.row_idx AND nm.col_idx = g.name_col
        LEFT JOIN fx_grid pn ON pn.doc_id = g.doc_id AND pn.table_seq = g.table_seq AND pn.row_idx = wid.row_idx AND pn.col_idx = g.pin_col
        LEFT JOIN fx_grid ty ON ty.doc_id = g.doc_id AND ty.table_seq = g.table_seq AND ty.row_idx = wid.row_idx AND ty.col_idx = g.type_col
        LEFT JOIN fx_grid de ON de.doc_id = g.doc_id AND de.table_seq = g.table_seq AND de.row_idx = wid.row_idx AND de.col_idx = g.desc_col WHERE s.doc_id IS NULL""",
    "b1": f"SELECT *, {_short} AS name, {S.io('type_cell')} AS io0 FROM b0 WHERE n <> ''",
    "b2": """SELECT *, last_value(CASE WHEN coalesce(type_cell, '') <> '' AND NOT (io0 IS NULL AND own = '') THEN coalesce(io0, '-') || chr(1) || own END IGNORE NULLS)
        OVER (PARTITION BY doc_id, group_no ORDER BY table_seq, layout, row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM b1""",
    "b3": """SELECT *, CASE WHEN inh THEN split_part(st, chr(1), 1) ELSE io0 END AS io, CASE WHEN inh THEN split_part(st, chr(1), 2) ELSE own END AS description
        FROM (SELECT *, io0 IS NULL AND own = '' AND st IS NOT NULL AND NOT starts_with(st, '-') AS inh FROM b2) z""",
    "nums": f"""SELECT b.*, p.pos, CASE WHEN regexp_matches(trim(split_part(pins, ',', p.pos)), '^[0-9]+$') THEN trim(split_part(pins, ',', p.pos))
        WHEN regexp_matches(trim(split_part(pins, ',', p.pos)), {q(L.PAD_NUMBER_CELL)}) THEN 'EP' END AS number FROM b3 b, (VALUES (1), (2), (3)) p(pos)""",
    "got": f"""SELECT * FROM nums WHERE number IS NOT NULL UNION ALL SELECT b3.*, 1, 'EP' FROM b3 WHERE (regexp_matches(upper(name), {q(L.PAD_NAME)}) OR contains(lower(description), 'thermal pad')
        OR contains(lower(description), 'exposed pad')) AND NOT EXISTS (SELECT 1 FROM nums x WHERE x.doc_id = b3.doc_id AND x.group_no = b3.group_no AND x.table_seq = b3.table_seq AND x.layout = b3.layout
        AND x.row_idx = b3.row_idx AND x.number IS NOT NULL)""",
    "alts": f"""SELECT g.doc_id, g.table_seq, g.row_idx, string_agg({_t('g.text')}, '|' ORDER BY g.col_idx) AS alt_functions FROM fx_grid g JOIN hd USING (doc_id, table_seq, col_idx)
        JOIN roles r USING (doc_id, table_seq) WHERE hd.al AND g.col_idx <> coalesce(r.name_col, -1) AND g.col_idx <> coalesce(r.type_col, -1) AND g.col_idx <> coalesce(r.desc_col, -1)
        AND {_t('g.text')} NOT IN ('', '-') GROUP BY g.doc_id, g.table_seq, g.row_idx""",
    "tp": f"""SELECT doc_id, group_no, table_seq, layout, row_idx, name, description, coalesce(io, {S.infer('name', 'description')}) AS pin_type,
        CAST(row_number() OVER (PARTITION BY doc_id, group_no, table_seq, layout, row_idx ORDER BY pos) - 1 AS INT) AS num_pos, number,
        coalesce(alt_functions, '') AS alt_functions FROM got LEFT JOIN alts USING (doc_id, table_seq, row_idx)""",
}
O["table_pins"] = W("SELECT * FROM tp", READ)
_fam = "regexp_replace({}, '-\\d+$', '')".format
SCORE = {
    **READ,
    "uq": "SELECT doc_id, group_no, count(DISTINCT number) AS unique_pins FROM tp GROUP BY doc_id, group_no",
    "gp": f"""SELECT doc_id, group_no, sum(n_rows - data_start) AS data_rows, bool_or(package <> '' AND label <> '' AND (contains(upper(label), {_fam('upper(package)')})
        OR contains(upper(package), {_fam('upper(label)')}))) AS hit, arg_min(label, table_seq * 100 + layout) AS label, min(expected_count) AS expected_count, min(base) AS base
        FROM grp LEFT JOIN fx_wanted USING (doc_id) GROUP BY doc_id, group_no""",
    "sc": """SELECT doc_id, group_no, unique_pins, CAST(data_rows AS BIGINT) AS data_rows, CAST(unique_pins + CASE WHEN expected_count > 0 AND unique_pins = expected_count THEN 10000 ELSE 0 END + CASE WHEN hit THEN 100000 ELSE 0 END
        + CASE WHEN base <> '' AND label <> '' AND (contains(replace(upper(label), 'PIN ', ''), base) OR contains(base, replace(upper(label), 'PIN ', ''))) THEN 50000 ELSE 0 END AS BIGINT) AS priority,
        least(1.0, CAST(unique_pins AS DOUBLE) / greatest(data_rows, 1)) AS confidence FROM uq JOIN gp USING (doc_id, group_no)""",
    "sr": "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, confidence DESC, group_no) = 1 AS best FROM sc",
}
O["table_scoring"] = W("SELECT * FROM sr", SCORE)
O["datasheet_pins"] = W(f"""SELECT doc_id, number, name, pin_type, description, alt_functions FROM kept UNION ALL SELECT doc_id, 'EP', 'GND', 'power_in', 'Exposed thermal pad', '' FROM kept GROUP BY doc_id
   HAVING NOT bool_or(number = 'EP') AND regexp_matches(lower(string_agg(description, ' ' ORDER BY table_seq, layout, row_idx, num_pos)), '{L.PAD_DESCRIPTION}')""", {**SCORE,
   "bp": """SELECT * FROM (SELECT tp.*, row_number() OVER (PARTITION BY doc_id, number ORDER BY table_seq, layout, row_idx, num_pos) AS rn FROM tp JOIN (SELECT doc_id, group_no FROM sr WHERE best) s USING (doc_id, group_no)) z WHERE rn = 1""",
   "kept": f"SELECT * FROM bp WHERE doc_id IN (SELECT doc_id FROM bp GROUP BY doc_id HAVING avg(length(name)) <= 20 AND NOT (count(*) >= 3 AND count(*) FILTER (WHERE {S.standard('name')}) < count(*) * 0.4))"})
O["continuation_fill"] = W(f"""SELECT doc_id, row_pos, CASE WHEN inh THEN split_part(st, chr(1), 1) ELSE p END AS io, CASE WHEN inh THEN split_part(st, chr(1), 2) ELSE description END AS description FROM (
   SELECT *, p IS NULL AND description = '' AND st IS NOT NULL AND NOT starts_with(st, '-') AS inh FROM (SELECT *, last_value(CASE WHEN coalesce(io, '') <> '' AND NOT (p IS NULL AND description = '')
   THEN coalesce(p, '-') || chr(1) || description END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st
   FROM (SELECT *, {S.io('io')} AS p FROM fx_pins) a) b) c""")
_famc = S.chain([(f"c = {q(k)}", q(n.rsplit('-', 1)[0] if '-' in n else n)) for k, (n, _) in L.CODE_PACKAGES.items()], "f")
O["package_table"] = W(f"""SELECT doc_id, row_idx, name, pin_count, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY row_idx) AS rn FROM (
   SELECT doc_id, row_idx, {_famc} || '-' || CAST(k AS STRING) AS name, k AS pin_count, c AS code FROM hit) z) y WHERE rn = 1""", {
   "pkc": """SELECT doc_id, min(col_idx) AS c FROM fx_package_cells WHERE row_idx = 0 AND contains(upper(text), 'PACKAGE') AND NOT contains(upper(text), 'SIZE')
      AND doc_id IN (SELECT doc_id FROM fx_package_cells WHERE row_idx = 0 AND (contains(upper(text), 'PART') OR contains(upper(text), 'DEVICE'))) GROUP BY doc_id""",
   "rw": """SELECT l.doc_id, l.row_idx, last_value(CASE WHEN trim(l.text) <> '' THEN upper(trim(l.text)) END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.row_idx ROWS UNBOUNDED PRECEDING) AS label, trim(p.text) AS cell
      FROM fx_package_cells l JOIN pkc ON pkc.doc_id = l.doc_id JOIN fx_package_cells p ON p.doc_id = l.doc_id AND p.row_idx = l.row_idx AND p.col_idx = pkc.c WHERE l.col_idx = 0 AND l.row_idx > 0""",
   "hit": f"""SELECT doc_id, row_idx, upper(regexp_extract(cell, {q(L.PACKAGE_CELL)}, 1, 'i')) AS c, upper(regexp_extract(cell, {q(L.PACKAGE_CELL)}, 2, 'i')) AS f, CAST(regexp_extract(cell, {q(L.PACKAGE_CELL)}, 3, 'i') AS INT) AS k
      FROM rw JOIN (SELECT o_orderkey, {fx.PACKAGE_PART} AS pn FROM orders) o ON o_orderkey = doc_id WHERE regexp_matches(cell, {q(L.PACKAGE_CELL)}, 'i')
      AND (starts_with(pn, rtrim(label, 'X')) OR (contains(label, 'X') AND starts_with(pn, replace(label, 'X', ''))))"""})

# --- geometry ---------------------------------------------------------------------------------
O["bounding_box"] = W("""SELECT p_partkey AS footprint_id, round(CASE WHEN x0 IS NULL THEN 0 ELSE x0 - greatest((x1 - x0) * 0.15, 2.0) END, 6) AS box_x, round(CASE WHEN x0 IS NULL THEN 0 ELSE y0 - greatest((y1 - y0) * 0.15, 2.0) END, 6) AS box_y,
   round(CASE WHEN x0 IS NULL THEN 10 ELSE (x1 - x0) + 2 * greatest((x1 - x0) * 0.15, 2.0) END, 6) AS box_w, round(CASE WHEN x0 IS NULL THEN 10 ELSE (y1 - y0) + 2 * greatest((y1 - y0) * 0.15, 2.0) END, 6) AS box_h
   FROM part LEFT JOIN (SELECT footprint_id, min(x - w / 2) AS x0, max(x + w / 2) AS x1, min(y - h / 2) AS y0, max(y + h / 2) AS y1 FROM fx_pads GROUP BY footprint_id) b ON footprint_id = p_partkey""")
_wrap = "CASE WHEN cw THEN CASE WHEN {a} > 0 THEN {a} - 2 * pi() ELSE {a} END ELSE CASE WHEN {a} < 0 THEN {a} + 2 * pi() ELSE {a} END END".format


def _inside(angle):
    at, end = _wrap(a=f"({angle} - fr)"), _wrap(a="(too - fr)")
    return f"(NOT flat AND CASE WHEN cw THEN {at} >= {end} ELSE {at} <= {end} END)"


_ext = [("CAST(0 AS DOUBLE)", "ux + r", "uy"), ("pi() / 2", "ux", "uy + r"), ("pi()", "ux - r", "uy"), ("-pi() / 2", "ux", "uy - r")]
_arms = " UNION ALL ".join(f"SELECT footprint_id, pad_number, {x} AS x, {y} AS y FROM c WHERE {_inside(a)}" for a, x, y in _ext)
O["arc_extent"] = W(f"""SELECT footprint_id, pad_number, round(min(x), 4) + 0 AS x0, round(max(x), 4) + 0 AS x1, round(min(y), 4) + 0 AS y0, round(max(y), 4) + 0 AS y1, count(*) AS points FROM (
   SELECT footprint_id, pad_number, ax AS x, ay AS y FROM c UNION ALL SELECT footprint_id, pad_number, bx, by_ FROM c UNION ALL SELECT footprint_id, pad_number, cx, cy FROM c UNION ALL {_arms}) z GROUP BY footprint_id, pad_number""", {
   "a": "SELECT footprint_id, pad_number, x AS ax, y AS ay, x + w AS bx, y + h AS by_, x + 2 * w + CAST(pad_number % 3 AS DOUBLE) AS cx, y - CAST(pad_number % 4 AS DOUBLE) AS cy FROM fx_pads",
   "b": "SELECT *, 2 * (ax * (by_ - cy) + bx * (cy - ay) + cx * (ay - by_)) AS d FROM a",
   "b1": """SELECT *, abs(d) < 1e-10 AS flat, ((ax * ax + ay * ay) * (by_ - cy) + (bx * bx + by_ * by_) * (cy - ay) + (cx * cx + cy * cy) * (ay - by_)) / CASE WHEN abs(d) < 1e-10 THEN NULL ELSE d END AS ux,
      ((ax * ax + ay * ay) * (cx - bx) + (bx * bx + by_ * by_) * (ax - cx) + (cx * cx + cy * cy) * (bx - ax)) / CASE WHEN abs(d) < 1e-10 THEN NULL ELSE d END AS uy FROM b""",
   "c": """SELECT *, sqrt((ax - ux) * (ax - ux) + (ay - uy) * (ay - uy)) AS r, atan2(ay - uy, ax - ux) AS fr, atan2(cy - uy, cx - ux) AS too, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) < 0 AS cw FROM b1"""})
EXPOSED = {
    "ar": "SELECT footprint_id, pad_number, w * h AS a, row_number() OVER (PARTITION BY footprint_id ORDER BY w * h) AS rn, count(*) OVER (PARTITION BY footprint_id) AS n FROM fx_pads",
    "ep": """SELECT footprint_id, max(n) AS pads, max(a) FILTER (WHERE rn = n // 2 + 1) AS median_area, CASE WHEN max(a) > 3 * CASE WHEN max(a) FILTER (WHERE rn = n // 2 + 1) = 0 THEN 1 ELSE max(a) FILTER (WHERE rn = n // 2 + 1) END
       THEN arg_max(CAST(pad_number AS STRING), a * 1000000 - pad_number) END AS exposed_pad FROM ar GROUP BY footprint_id""",
}
O["exposed_pad"] = W("SELECT footprint_id, pads, round(median_area, 6) AS median_area, exposed_pad FROM ep", EXPOSED)
O["pad_pin_map"] = W("""SELECT doc_id, pad, arg_max(primary_pin, late * 1000000 + row_pos) AS primary_pin FROM (
   SELECT doc_id, 0 AS late, row_pos, number AS pad, primary_pin FROM mp UNION ALL SELECT doc_id, 1, min(row_pos), arg_min(exposed_pad, row_pos), arg_min(primary_pin, row_pos) FROM mp JOIN ep ON footprint_id = doc_id
   WHERE number = 'EP' AND exposed_pad IS NOT NULL GROUP BY doc_id) z GROUP BY doc_id, pad""", {**EXPOSED,
   "mp": "SELECT doc_id, row_pos, number, first_value(number) OVER (PARTITION BY doc_id, upper(name) ORDER BY row_pos) AS primary_pin FROM fx_pins"})
O["stacked_pins"] = W("""SELECT doc_id, pin_pos, number, name, round(CASE WHEN moves THEN fx ELSE x END, 6) AS x, round(CASE WHEN moves THEN fy ELSE y END, 6) AS y, CASE WHEN moves THEN fa ELSE angle END AS angle
   FROM (SELECT *, x IS NOT NULL AND fx IS NOT NULL AS moves FROM (SELECT doc_id, row_pos AS pin_pos, number, name, x, y, pad_number % 4 * 90 AS angle,
     first_value(x) OVER g AS fx, first_value(y) OVER g AS fy, first_value(pad_number % 4 * 90) OVER g AS fa FROM fx_pins LEFT JOIN fx_pads ON footprint_id = doc_id AND pad_number = row_pos
   WINDOW g AS (PARTITION BY doc_id, upper(name) ORDER BY row_pos)) a) b""")
HEADS = {**TYPED, "hp": """SELECT doc_id, row_pos AS pin_pos, number, name, pin_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, upper(name) ORDER BY row_pos) AS rn FROM typed WHERE number <> 'EP') z WHERE rn = 1"""}
_g = "CAST(2.54 AS DOUBLE)"
_grid = (f"""SELECT doc_id, pin_pos, number, name, side, round(CASE side WHEN 'left' THEN -box_w / 2 - {_g} WHEN 'right' THEN box_w / 2 + {_g} ELSE coalesce(-{_g} * (nb - 1) / 2 + (slot - 1) * {_g}, 0) END, 6) + 0 AS x,
   round(CASE WHEN side IN ('left', 'right') THEN box_h / 2 - {_g} - (slot - 1) * {_g} ELSE -box_h / 2 - {_g} END, 6) + 0 AS y, CASE side WHEN 'left' THEN 0 WHEN 'right' THEN 180 ELSE 90 END AS angle, round(box_w, 6) AS box_w, round(box_h, 6) AS box_h FROM (
   SELECT a.*, coalesce(nb, 0) AS nb, greatest(coalesce(lc, 0), coalesce(rc, 0), 1) * {_g} + {_g} + CASE WHEN nb > 0 THEN 5.08 ELSE 0 END AS box_h, greatest(CAST(15.24 AS DOUBLE), CASE WHEN nb > 0 THEN nb * {_g} + 5.08 ELSE 0 END) AS box_w
   FROM everyone a LEFT JOIN cnt2 c ON c.doc_id = a.doc_id) z""", {**HEADS,
   "sd": f"""SELECT *, CASE WHEN pin_type = 'power_in' AND upper(name) IN ({', '.join(q(x) for x in L.GROUND_NAMES)}) THEN 'bottom' WHEN pin_type IN ('power_in', 'input') THEN 'left' ELSE 'right' END AS side FROM hp""",
   "sl": "SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY pin_pos) AS slot FROM sd",
   "cnt": "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE side = 'left') AS l, count(*) FILTER (WHERE side = 'right') AS r, count(*) FILTER (WHERE side = 'bottom') AS nb FROM sd GROUP BY doc_id",
   "cnt2": "SELECT *, CASE WHEN l = 0 AND r = 0 THEN n // 2 ELSE l END AS lc, CASE WHEN l = 0 AND r = 0 THEN n - n // 2 ELSE r END AS rc FROM cnt",
   "everyone": """SELECT doc_id, pin_pos, number, name, side, slot FROM sl UNION ALL SELECT sl.doc_id, pin_pos, number, name, CASE WHEN slot <= n // 2 THEN 'left' ELSE 'right' END, CASE WHEN slot <= n // 2 THEN slot ELSE slot - n // 2 END
       FROM sl JOIN cnt ON cnt.doc_id = sl.doc_id WHERE l = 0 AND r = 0
       UNION ALL SELECT h.doc_id, h.pin_pos, 'EP', 'GND', 'hidden', g.slot FROM (SELECT doc_id, min(row_pos) AS pin_pos FROM fx_pins WHERE number = 'EP' GROUP BY doc_id) h
       LEFT JOIN (SELECT doc_id, min(slot) AS slot FROM sl WHERE side = 'bottom' AND upper(name) = 'GND' GROUP BY doc_id) g ON g.doc_id = h.doc_id"""})
O["grid_layout"] = W("""SELECT * FROM res UNION ALL SELECT r.doc_id, r.pin_pos, f.number, r.name, r.side, r.x, r.y, r.angle, r.box_w, r.box_h FROM res r
   JOIN (SELECT doc_id, number, row_pos, min(row_pos) OVER (PARTITION BY doc_id, upper(name)) AS pin_pos FROM typed WHERE number <> 'EP') f
   ON f.doc_id = r.doc_id AND f.pin_pos = r.pin_pos WHERE f.row_pos <> f.pin_pos AND r.side <> 'hidden'""", {**_grid[1], "res": _grid[0]})
O["preview_layout"] = W(f"""SELECT doc_id, pin_pos, number, name, side, round(CASE side WHEN 'left' THEN -w / 2 WHEN 'right' THEN w / 2 ELSE -w / 2 + (slot - 0.5) * (w / m) END, 6) + 0 AS x,
   round(CASE side WHEN 'top' THEN h / 2 WHEN 'bottom' THEN -h / 2 ELSE h / 2 - (slot - 0.5) * (h / m) END, 6) + 0 AS y, CASE side WHEN 'left' THEN 180 WHEN 'right' THEN 0 WHEN 'top' THEN 90 ELSE 270 END AS angle,
   round(-w / 2 - 7.54, 6) AS box_x, round(-h / 2 - 7.54, 6) AS box_y, round(w + 15.08, 6) AS box_w, round(h + 15.08, 6) AS box_h FROM (
   SELECT f.*, greatest(max(CASE WHEN side IN ('left', 'right') THEN m ELSE 0 END) OVER (PARTITION BY doc_id), 1) * {_g} AS h, greatest(greatest(max(CASE WHEN side IN ('top', 'bottom') THEN m ELSE 0 END) OVER (PARTITION BY doc_id), 1) * {_g}, CAST(10.16 AS DOUBLE)) AS w FROM (
   SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY seq) AS slot, count(*) OVER (PARTITION BY doc_id, side) AS m FROM moved) f) z""", {**HEADS, "hp": HEADS["hp"].replace(" WHERE number <> 'EP'", ""),
   "s0": """SELECT *, CASE WHEN pin_type = 'power_in' THEN 'top' WHEN pin_type IN ('power_out', 'no_connect') THEN 'bottom' WHEN pin_type IN ('output', 'open_collector', 'open_emitter') THEN 'right' ELSE 'left' END AS s FROM hp""",
   "s1": """SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY pin_pos) AS k, count(*) FILTER (WHERE s = 'left') OVER (PARTITION BY doc_id) AS l, count(*) FILTER (WHERE s = 'right') OVER (PARTITION BY doc_id) AS r,
      count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY CASE s WHEN 'top' THEN 0 ELSE 1 END, pin_pos) AS tb FROM s0""",
   "moved": """SELECT doc_id, pin_pos, number, name, CASE WHEN l + r = 0 THEN tb ELSE k END AS seq, CASE WHEN l + r = 0 THEN CASE WHEN tb <= (n + 1) // 2 THEN 'left' ELSE 'right' END
      WHEN r = 0 AND s = 'left' AND k > (l + 1) // 2 THEN 'right' WHEN l = 0 AND s = 'right' AND k > (r + 1) // 2 THEN 'left' ELSE s END AS side FROM s1"""})

# --- reports and streams ------------------------------------------------------------------------
O["accuracy_summary"] = """SELECT user_id % 10 AS batch, round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS avg_seconds, round(min(value) FILTER (WHERE event_type <> 'error'), 6) AS min_seconds,
   round(max(value) FILTER (WHERE event_type <> 'error'), 6) AS max_seconds, count(*) FILTER (WHERE event_type <> 'error') AS fetched,
   round(count(*) FILTER (WHERE event_type IN ('purchase', 'click')) / CAST(count(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) * 100, 6) AS accuracy FROM events GROUP BY 1"""
O["case_report"] = """SELECT 'phase' || CAST(user_id % 11 AS STRING) AS phase, count(*) FILTER (WHERE NOT f) AS passed, count(*) FILTER (WHERE f) AS failed, count(*) FILTER (WHERE f AND event_id % 3 = 0) AS expected_fail,
   count(*) FILTER (WHERE f AND event_id % 3 <> 0) AS regression FROM (SELECT *, event_type IN ('error', 'view') AS f FROM events) z GROUP BY 1"""
O["job_fold_stream"] = W("""SELECT job_id, last_event, outcome, messages, events FROM (SELECT job_id, max(event) FILTER (WHERE d = 1) AS last_event, max(event) FILTER (WHERE e = 1 AND event <> 'status') AS outcome,
   count(*) FILTER (WHERE event = 'status') AS messages, count(*) AS events FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS d,
   row_number() OVER (PARTITION BY job_id, event <> 'status' ORDER BY ts, event_id) AS e FROM fx_job_events) a GROUP BY job_id) b""")
# An event more than 30 days behind the job's last one starts a new job.
O["job_expiry_stream"] = W("""SELECT job_id, c AS created_ms, c + 1800000 AS expired_ms FROM (SELECT job_id, min(ms) AS c FROM runs GROUP BY job_id, run) z WHERE c + 1800000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events)""", {
    "steps": "SELECT job_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY job_id ORDER BY ts) AS gap FROM fx_job_events",
    "runs": "SELECT *, sum(CASE WHEN gap > 2592000000 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ms) AS run FROM steps"})
_claim = """SELECT event_id, {k} AS {n}, CASE WHEN rn = 1 THEN '{a}' WHEN epoch_us(ts) - first <= {s} THEN '{b}' ELSE '{c}' END AS verdict FROM (SELECT *, row_number() OVER w AS rn, first_value(epoch_us(ts)) OVER w AS first
   FROM (SELECT *, {k} AS kk FROM fx_usage WHERE {f}) y WINDOW w AS (PARTITION BY kk ORDER BY ts, event_id)) z"""
# An id has three events at most: each is measured against the last accepted one.
O["token_use_stream"] = W("""SELECT event_id, generation_id, CASE WHEN rn = 1 OR (rn = 2 AND t - t1 > life) OR (rn = 3 AND t - CASE WHEN t2 - t1 > life THEN t2 ELSE t1 END > life)
   THEN 'accepted' ELSE 'already_used' END AS verdict FROM (SELECT *, 300000000 AS life, nth_value(t, 1) OVER g AS t1, nth_value(t, 2) OVER g AS t2, row_number() OVER w AS rn
     FROM (SELECT event_id, generation_id, ts, epoch_us(ts) AS t FROM fx_usage WHERE mode = 'consume') y
     WINDOW w AS (PARTITION BY generation_id ORDER BY ts, event_id), g AS (PARTITION BY generation_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) z""")
O["customer_creation_stream"] = W(_claim.format(k="left(sha256(lower(trim(email))), 32)", n="customer_key", a="created", b="replayed", c="found", s=86400000000, f="true"))
O["customer_keys_stream"] = W("SELECT DISTINCT left(sha256(lower(trim(email))), 32) AS customer_key FROM fx_usage")
O["quota_stream"] = W("""SELECT event_id, lower(trim(email)) AS email, rn <= 3 AS allowed, CAST(least(rn, 3) AS INT) AS generations_used FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY ts, event_id) AS rn FROM fx_usage WHERE mode = 'consume') z""")
O["device_binding_stream"] = W("""SELECT event_id, lower(trim(email)) AS email, epoch, bound AS bound_machine, CASE WHEN machine_id = bound THEN 'ok' ELSE 'device_mismatch' END AS verdict FROM (
   SELECT *, first_value(machine_id) OVER (PARTITION BY email, epoch ORDER BY ts, event_id) AS bound FROM (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY email ORDER BY ts, event_id) AS BIGINT) AS epoch
   FROM fx_usage) a WHERE event_type <> 'signup') b) c""")
O["licensed_customers"] = """SELECT c_custkey AS customer_id, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) z
   WHERE rn <= 5 AND (o_orderstatus = 'P' OR (o_orderstatus = 'F' AND o_orderkey % 3 = 0)))"""
