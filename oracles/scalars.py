"""SQL counterparts of the scalar rules and filters."""

from pinwright.functions import lookups as L
from pinwright.plans import fixtures as fx

from . import rules as S
from .fixtures import with_views as W

q = S.q
O = {}

_bare = S.bare("part_number")
O["suffix_split"] = W(f"SELECT part_id, part_number, {S.base('part_number')} AS base, {S.code('part_number')} AS code FROM fx_parts")
O["manufacturer"] = W("SELECT part_id, " + S.chain(
    [(f"regexp_matches(upper(trim(part_number)), {q(p)}, 'i')", q(m)) for m, p in L.MAKER_PREFIXES], "''") + " AS maker FROM fx_parts")

# Address candidates: every form as a ranked row, kept when it is not a repeat.
_full = "lower(trim(part_number))"
_volt = f"regexp_replace({_full}, '-\\d+\\.?\\d*$', '')"
_maker = S.chain([(f"regexp_matches(upper(trim(part_number)), {q(p)}, 'i')", q(m)) for m, p in L.MAKER_PREFIXES], "''")
O["source_candidates"] = W(f"""
, ranked AS (SELECT part_id, address, min(pos) AS pos FROM forms WHERE address IS NOT NULL GROUP BY part_id, address)
SELECT part_id, CAST(row_number() OVER (PARTITION BY part_id ORDER BY pos) - 1 AS INT) AS rank, address FROM ranked""", {
    "p": f"""SELECT part_id, part_number, upper(trim(part_number)) AS up, {_full} AS f, lower({S.base('part_number')}) AS b, {_volt} AS v,
        lower({S.base(_volt)}) AS vb0, {_maker} AS maker, replace(upper(part_number), '-', '') AS undashed FROM fx_parts""",
    "p2": "SELECT *, CASE WHEN v <> f THEN vb0 ELSE b END AS vb FROM p",
    "ti": """SELECT part_id, pos, c FROM (
        SELECT part_id, 1 AS pos, f AS c, f, b, vb FROM p2 WHERE maker IN ('TI', '')
        UNION ALL SELECT part_id, 2, regexp_replace(f, '-q\\d+$', ''), f, b, vb FROM p2 WHERE maker IN ('TI', '')
        UNION ALL SELECT part_id, 3, b, f, b, vb FROM p2 WHERE maker IN ('TI', '')
        UNION ALL SELECT part_id, 4, v, f, b, vb FROM p2 WHERE maker IN ('TI', '')
        UNION ALL SELECT part_id, 5, CASE WHEN vb <> f AND vb <> b THEN vb END, f, b, vb FROM p2 WHERE maker IN ('TI', '')
        UNION ALL SELECT part_id, 6, CASE WHEN vb <> f AND regexp_replace(vb, '[a-z]{1,2}$', '') <> vb
             AND length(regexp_replace(vb, '[a-z]{1,2}$', '')) >= 5 THEN regexp_replace(vb, '[a-z]{1,2}$', '') END, f, b, vb FROM p2 WHERE maker IN ('TI', '')
        UNION ALL SELECT part_id, 7, CASE WHEN b <> f AND regexp_replace(b, '[a-z]{1,2}$', '') <> b
             AND length(regexp_replace(b, '[a-z]{1,2}$', '')) >= 5 THEN regexp_replace(b, '[a-z]{1,2}$', '') END, f, b, vb FROM p2 WHERE maker IN ('TI', '')) z""",
    "adi": f"""SELECT part_id, 1 AS pos, up AS c FROM p2 WHERE maker = 'Analog Devices'
        UNION ALL SELECT part_id, 2, regexp_extract(up, {q(L.ADI_ORDERING)}, 1) FROM p2 WHERE maker = 'Analog Devices'
           AND length(regexp_extract(up, {q(L.ADI_ORDERING)}, 1)) >= 4
        UNION ALL SELECT part_id, 3, regexp_extract(up, {q(L.VOLTAGE_ORDERING)}, 1) FROM p2 WHERE maker = 'Analog Devices'
           AND regexp_matches(up, {q(L.VOLTAGE_ORDERING)})""",
    "forms": f"""SELECT part_id, pos * 2 AS pos, {q(L.TI_RESOLVER)} || c AS address FROM ti
        UNION ALL SELECT part_id, pos * 2 + 1, {q(L.TI_SYMLINK)} || c || '.pdf' FROM ti
        UNION ALL SELECT part_id, pos * 2, {q(L.ADI_SHEETS)} || lower(c) || '.pdf' FROM adi
        UNION ALL SELECT part_id, pos * 2 + 1, {q(L.ADI_SHEETS)} || upper(c) || '.pdf' FROM adi
        UNION ALL SELECT part_id, 1, {q(L.MICROCHIP_DOCS)} || undashed || '.pdf' FROM p2 WHERE maker = 'Microchip'
        UNION ALL SELECT part_id, 2, {q(L.MICROCHIP_DOCS)} || up || '.pdf' FROM p2 WHERE maker = 'Microchip'
        UNION ALL SELECT part_id, 1, {q(L.ST_SHEETS)} || f || '.pdf' FROM p2 WHERE maker = 'STMicroelectronics'""",
}).replace("\n\n, ranked", ", ranked").replace("\n, ranked", ", ranked")

_pn = """CASE part_id % 4 WHEN 0 THEN 'MAX' WHEN 1 THEN 'ADP' WHEN 2 THEN 'LT' ELSE 'AD' END || CAST(part_id % 4000 + 1000 AS STRING)
    || CASE part_id % 7 WHEN 0 THEN 'G+T' WHEN 1 THEN 'ARMZ' WHEN 2 THEN 'EMSE' WHEN 3 THEN '-3.3' WHEN 4 THEN 'X+T10' WHEN 5 THEN 'ACPZ-1.5' ELSE 'CS8' END"""


def _g(p):
    return f"CASE WHEN regexp_matches(pn, {q(p)}) THEN regexp_extract(pn, {q(p)}, 1) END"


O["ordering_variants"] = W("""SELECT part_id, CAST(row_number() OVER (PARTITION BY part_id ORDER BY pos) - 1 AS INT) AS rank, variant FROM
    (SELECT part_id, variant, min(pos) AS pos FROM v WHERE variant IS NOT NULL GROUP BY part_id, variant) z""", {
    "n": f"SELECT part_id, {_pn} AS pn FROM fx_parts",
    "v": f"""SELECT part_id, 1 AS pos, pn AS variant FROM n UNION ALL SELECT part_id, 2, {_g(L.MAXIM_ORDERING)} FROM n
        UNION ALL SELECT part_id, 3, CASE WHEN length({_g(L.ADI_ORDERING)}) >= 4 THEN {_g(L.ADI_ORDERING)} END FROM n
        UNION ALL SELECT part_id, 4, {_g(L.LINEAR_ORDERING)} FROM n UNION ALL SELECT part_id, 5, {_g(L.VOLTAGE_ORDERING)} FROM n"""})

_u = "lower(replace(replace(url, 'example.com', 'ti.com'), 'example.net', 'NXP.com'))"
O["domain_maker"] = "SELECT page_id, " + S.chain([(f"contains({_u}, {q(d)})", q(m)) for d, m in L.DOMAIN_MAKERS], "''") + " AS maker FROM pages"

_prod = r"^https?://www\.ti\.com/product/([A-Za-z0-9_-]+)"
O["redirect_links"] = f"""WITH h AS (SELECT page_id, {fx.LINK_HTML} AS html FROM pages),
 raw AS (SELECT page_id, generate_subscripts(l, 1) AS pos, unnest(l) AS e FROM (SELECT page_id, regexp_extract_all(html, 'uddg=([^&"]+)', 1) AS l FROM h) z),
 links AS (SELECT page_id, min(pos) AS pos, url_decode(e) AS u FROM raw GROUP BY page_id, url_decode(e)),
 tiers AS (SELECT page_id, 0 AS tier, pos, u AS address FROM links WHERE contains(lower(u), '.pdf')
   UNION ALL SELECT page_id, 1, pos, {q(L.TI_RESOLVER)} || lower(regexp_extract(u, {q(_prod)}, 1)) FROM links WHERE regexp_matches(u, {q(_prod)}))
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY tier, pos) - 1 AS INT) AS rank, address FROM tiers"""

_t = "lower(u)"
O["address_tiers"] = f"""WITH c AS (SELECT page_id, 1 AS pos, url AS u FROM pages UNION ALL SELECT page_id, 2, replace(url, 'example.com', 'ti.com') FROM pages
   UNION ALL SELECT page_id, 3, replace(url, 'example.net', 'github.com') FROM pages UNION ALL SELECT page_id, 4, replace(url, 'example.org', 'lcsc.com') FROM pages),
 t AS (SELECT page_id, u, min(pos) AS pos, CASE WHEN {S.has(_t, L.REJECTED_SITES)} THEN NULL WHEN {S.has(_t, L.MAKER_SITES)} THEN 0
   WHEN {S.has(_t, L.AGGREGATOR_SITES)} THEN 1 ELSE 2 END AS tier FROM c GROUP BY page_id, u)
 SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY tier, pos) - 1 AS INT) AS rank, u AS address FROM t WHERE tier IS NOT NULL"""

O["cache_key"] = """WITH u AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/a.pdf' ELSE '' END AS url FROM pages)
 SELECT page_id, CASE WHEN ends_with(url, '.pdf') THEN left(md5(url), 12) || '_' || split_part(url, '/', -1) ELSE left(md5(url), 12) || '.pdf' END AS cache_key FROM u"""

O["pin_name_cleaning"] = W("""SELECT doc_id, row_pos, trim(replace(replace(replace(' ' || name
  || CASE row_pos % 4 WHEN 0 THEN '±' WHEN 1 THEN '−' WHEN 2 THEN '–' ELSE '' END || ' ', '±', '-'), '−', '-'), '–', '-')) AS clean_name FROM fx_pins""")
O["io_type"] = W(f"SELECT doc_id, row_pos, {S.io('io')} AS pin_type FROM fx_pins")
O["pin_type_inference"] = W(f"""SELECT doc_id, row_pos, {S.infer("CASE WHEN row_pos % 3 = 0 THEN 'X' || name ELSE name END", 'description')} AS pin_type FROM fx_pins""")
O["pin_number_list"] = W("""SELECT doc_id, row_idx, CAST(row_number() OVER (PARTITION BY doc_id, row_idx ORDER BY pos) - 1 AS INT) AS num_pos, number FROM (
  SELECT doc_id, row_idx, pos, CASE WHEN regexp_matches(part, '^[0-9]+$') THEN part WHEN regexp_matches(part, """ + q(L.PAD_NUMBER_CELL) + """) THEN 'EP' END AS number
  FROM (SELECT doc_id, row_idx, p.pos, trim(split_part(text, ',', p.pos)) AS part FROM fx_cells, (VALUES (1), (2), (3)) p(pos)
  WHERE col_idx = 1 AND text IS NOT NULL) a) b WHERE number IS NOT NULL""")
_words = "CASE row_pos % 5 WHEN 0 THEN 'Output' WHEN 1 THEN 'GROUND' WHEN 2 THEN 'Feed' || chr(10) || 'back' WHEN 3 THEN 'V' || chr(10) || 'M' ELSE 'in put' END"
O["pin_name_short_form"] = W(f"""SELECT doc_id, row_pos, {S.chain([(f"upper(n) = {q(k)}", q(v)) for k, v in L.NAME_SHORT_FORMS.items()], 'n')} AS short_name
  FROM (SELECT doc_id, row_pos, replace({_words}, chr(10), '') AS n FROM fx_pins) z""")
O["header_roles"] = W(f"""SELECT doc_id, table_seq, col_idx, text, {S.pin_role('text')} AS pin, {S.name_role('text')} AS name,
  {S.type_role('text')} AS type, {S.desc_role('text')} AS description, {S.alt_role('text')} AS alternate FROM fx_grid WHERE row_idx = 0""")


def _terms(name, count):
    up = f"upper({name})"
    fam = [("HTSSOP", ["TSSOP"]), ("WQFN", ["QFN", "VQFN"]), ("VQFN", ["QFN", "WQFN"]), ("TQFN", ["QFN"])]
    one = S.chain([(f"starts_with({up}, {q(p)})", f"{q(o[0])} || substr({up}, {len(p) + 1})") for p, o in fam], "NULL")
    two = S.chain([(f"starts_with({up}, {q(p)})", f"{q(o[1])} || substr({up}, {len(p) + 1})") for p, o in fam if len(o) > 1], "NULL")
    return [name, f"CASE WHEN {count} <> 0 AND NOT regexp_matches({name}, '\\d+$') THEN {name} || '-' || CAST({count} AS STRING) END",
            f"replace(replace({name}, '-', ''), '_', '')", f"replace({name}, '-', '_')", one, two]


TERMS = " UNION ALL ".join(
    f"SELECT doc_id, cand_pos, code, pin_count, {i} AS pos, {e} AS term FROM fx_packages" for i, e in enumerate(_terms("name", "pin_count")))
O["footprint_terms"] = W("""SELECT doc_id, cand_pos, CAST(row_number() OVER (PARTITION BY doc_id, cand_pos ORDER BY pos) - 1 AS INT) AS term_pos, term
  FROM terms WHERE term IS NOT NULL""", {"terms": TERMS})
WILD = "({n} LIKE '%X' AND rtrim({n}, 'X') <> '' AND starts_with({q}, rtrim({n}, 'X')) AND length({q}) <= length({n}) + 1)"
O["wildcard_match"] = W(f"""SELECT DISTINCT query, name FROM (SELECT DISTINCT upper(part_number) AS query FROM fx_parts) a,
  (SELECT DISTINCT upper(name) AS name FROM fx_symbols) b WHERE {WILD.format(n='name', q='query')}""")
O["pin_name_equivalence"] = W(f"""SELECT a.doc_id, a.number, pin_name, true_name, {S.same_name('pin_name', 'true_name')} AS same FROM
  (SELECT doc_id, number, arg_max(name, row_pos) AS pin_name FROM fx_pins GROUP BY doc_id, number) a
  JOIN (SELECT doc_id, number, name AS true_name FROM fx_truth) b USING (doc_id, number)""")
O["email_key"] = W("""SELECT event_id, lower(trim(email)) AS email, left(sha256(lower(trim(email))), 32) AS customer_key FROM fx_usage""")
O["model_reference"] = W("SELECT ord, lib || '.3dshapes/' || name || '.wrl' AS model FROM fx_footprints")
O["unit_number"] = W("SELECT ord, CASE WHEN ord % 3 = 0 THEN CAST(ord % 4 AS INT) ELSE 0 END AS unit FROM fx_symbols")
O["result_status"] = W("""SELECT o_orderkey AS doc_id, coalesce(n, 0) AS pins, CASE WHEN coalesce(n, 0) = 0 THEN 'ERROR' ELSE 'COMPLETE' END AS status
  FROM orders LEFT JOIN (SELECT doc_id, count(*) AS n FROM fx_pins GROUP BY doc_id) c ON c.doc_id = o_orderkey""")

# --- text
_skip = S.has("lower(line)", L.DESCRIPTION_SKIP)
O["description_line"] = W(f"""SELECT d.doc_id, coalesce(t.line, left(f.line, 200), '') AS description FROM fx_docs d
  LEFT JOIN (SELECT doc_id, arg_min(line, pos) AS line FROM l WHERE contains(upper(line), base) AND length(line) > 20 AND length(line) < 200 AND NOT {_skip} GROUP BY doc_id) t USING (doc_id)
  LEFT JOIN (SELECT doc_id, arg_min(line, pos) AS line FROM l WHERE pos <= 30 AND length(line) > 30 AND NOT starts_with(line, 'www.') AND NOT starts_with(line, 'http') GROUP BY doc_id) f USING (doc_id)""",
  {"l": """SELECT doc_id, base, generate_subscripts(a, 1) AS pos, trim(unnest(a), chr(32) || chr(9) || chr(13) || chr(12) || chr(11)) AS line
     FROM (SELECT doc_id, base, string_split(text, chr(10)) AS a FROM fx_docs) z"""})
O["component_class"] = W("SELECT doc_id, " + S.chain([(S.has("low", w), q(n)) for n, w in L.COMPONENT_KEYWORDS], "'ic'")
                         + " AS component_type FROM (SELECT doc_id, lower(text) AS low FROM fx_docs) z")
O["document_full_text"] = W("SELECT doc_id, string_agg(text, chr(10) ORDER BY page_num) AS full_text FROM fx_conv GROUP BY doc_id")
O["context_packing"] = W("""SELECT doc_id, string_agg('--- Page ' || CAST(page_num AS STRING) || ' ---' || chr(10) || kept, chr(10) || chr(10) ORDER BY tier, page_num) AS context FROM (
   SELECT *, CASE WHEN upto <= 30000 THEN text WHEN upto - len <= 30000 AND over = 1 AND 30000 - (upto - len) > 500 THEN left(text, CAST(30000 - (upto - len) AS INT)) END AS kept FROM (
     SELECT *, sum(CASE WHEN upto > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY tier, page_num) AS over FROM (
       SELECT *, length(text) AS len, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY tier, page_num) AS upto FROM (
         SELECT *, CASE WHEN page_num <= 2 THEN 0 WHEN contains(upper(text), 'PIN') AND (contains(upper(text), 'NAME') OR contains(upper(text), 'FUNCTION')
           OR contains(upper(text), 'DESCRIPTION')) THEN 1 ELSE 2 END AS tier FROM fx_long) a) b) c) d WHERE kept IS NOT NULL GROUP BY doc_id""")
O["answer_packages"] = W("""SELECT doc_id, cand_pos, name, pin_count, code, dimensions FROM (
   SELECT doc_id, 0 AS cand_pos, json_extract_string(answer, '$.packages[0].name') AS name, CAST(json_extract_string(answer, '$.packages[0].pin_count') AS INT) AS pin_count, 'D' AS code, '' AS dimensions FROM fx_answers
   UNION ALL SELECT doc_id, 1, json_extract_string(answer, '$.packages[1].name'), CAST(json_extract_string(answer, '$.packages[1].pin_count') AS INT), '', '' FROM fx_answers) z
   WHERE name <> '' AND pin_count <> 0""")
_pins = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS row_pos, json_extract_string(answer, '$.pins[{i}].number') AS number, json_extract_string(answer, '$.pins[{i}].name') AS n,
    replace(lower(coalesce(json_extract_string(answer, '$.pins[{i}].type'), '')), ' ', '_') AS t, coalesce(json_extract_string(answer, '$.pins[{i}].description'), '') AS description FROM fx_answers"""
    for i in range(4))
O["answer_pins"] = W(f"""SELECT doc_id, row_pos, number, trim(replace(replace(replace(n, '±', '-'), '−', '-'), '–', '-')) AS name,
   CASE WHEN t IN ({', '.join(q(x) for x in L.ANSWER_TYPES)}) THEN t ELSE 'passive' END AS pin_type, description FROM (
   SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY row_pos) AS rn FROM a WHERE number <> '' AND trim(n) <> '') z WHERE rn = 1""", {"a": _pins})
_codes = "|".join(sorted(L.CODE_PACKAGES, key=len, reverse=True))
_fam = S.chain([(f"c = {q(k)}", q(n.rsplit('-', 1)[0] if '-' in n else n)) for k, (n, _) in L.CODE_PACKAGES.items()], "NULL")
ORDERABLE = {
    "m": f"""SELECT doc_id, text, regexp_extract_all(text, '(?i)' || base || '({_codes})R?(?:-Q[0-9]+)?', 1) AS l FROM fx_docs""",
    "a1": "SELECT doc_id, generate_subscripts(l, 1) AS pos, upper(unnest(l)) AS c FROM m",
    "a2": f"SELECT doc_id, generate_subscripts(l2, 1) AS pos, unnest(l2) AS e FROM (SELECT doc_id, regexp_extract_all(text, {q('(?i)' + L.PACKAGE_INLINE)}, 0) AS l2 FROM m WHERE len(l) = 0) z",
    "a3": f"SELECT doc_id, pos, upper(regexp_extract(e, {q('(?i)' + L.PACKAGE_INLINE)}, 1)) AS c, upper(regexp_extract(e, {q('(?i)' + L.PACKAGE_INLINE)}, 2)) AS f, CAST(regexp_extract(e, {q('(?i)' + L.PACKAGE_INLINE)}, 3) AS INT) AS k FROM a2",
    "orderable": f"""SELECT doc_id, pos, {S.chain([(f'c = {q(k)}', q(n)) for k, (n, _) in L.CODE_PACKAGES.items()], 'NULL')} AS name,
        {S.chain([(f'c = {q(k)}', str(n)) for k, (_, n) in L.CODE_PACKAGES.items()], 'NULL')} AS pin_count, c AS code FROM a1
        UNION ALL SELECT doc_id, pos, coalesce({_fam}, f) || '-' || CAST(k AS STRING), k, c FROM a3""",
}
O["orderable_packages"] = W("""SELECT doc_id, name, CAST(pin_count AS INT) AS pin_count, code FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY pos) AS rn
   FROM orderable) z WHERE rn = 1""", ORDERABLE)
_hit = S.chain([(f"ends_with(pn, {q(c)}) OR ends_with(pn, {q(c + 'R')})", q(c)) for c in L.CODE_PACKAGES], "NULL")
O["suffix_package"] = W(f"""SELECT part_id, {S.chain([(f'code = {q(k)}', q(n)) for k, (n, _) in L.CODE_PACKAGES.items()], 'NULL')} AS name,
   CAST({S.chain([(f'code = {q(k)}', str(n)) for k, (_, n) in L.CODE_PACKAGES.items()], 'NULL')} AS INT) AS pin_count, code
   FROM (SELECT part_id, {_hit} AS code FROM (SELECT part_id, upper(trim(part_number)) AS pn FROM fx_parts) z) y WHERE code IS NOT NULL""")

# --- filters
O["entry_lookup"] = W("SELECT lib, name, min(ord) AS ord, arg_min(pin_count, ord) AS pin_count FROM fx_symbols GROUP BY lib, name")
O["unit_filter"] = W("SELECT ord, CAST(ord % 4 AS INT) AS unit FROM fx_symbols WHERE ord % 4 IN (0, 2)")
O["section_rows"] = W("""SELECT doc_id, table_seq, row_idx FROM fx_grid GROUP BY doc_id, table_seq, row_idx
   HAVING NOT (count(*) FILTER (WHERE trim(coalesce(text, '')) <> '') = 1 AND max(CASE WHEN trim(text) <> '' THEN
   CASE WHEN regexp_matches(upper(trim(text)), '^(""" + "|".join(w.upper() for w in L.SECTION_WORDS) + r"""|AND|\s)*$') THEN 1 ELSE 0 END END) = 1)""")
O["quality_gate"] = W(f"""SELECT doc_id, number, row_pos, name FROM f WHERE doc_id IN (SELECT doc_id FROM f GROUP BY doc_id
   HAVING avg(length(name)) <= 20 AND NOT (count(*) >= 3 AND count(*) FILTER (WHERE {S.standard('name')}) < count(*) * 0.4))""",
   {"f": """SELECT doc_id, number, row_pos, name FROM (SELECT doc_id, number, row_pos, CASE WHEN doc_id % 3 = 0 AND row_pos > 1 THEN name || ' maximum value' ELSE name END AS name,
       row_number() OVER (PARTITION BY doc_id, number ORDER BY row_pos) AS rn FROM fx_pins) z WHERE rn = 1"""})
O["layer_filter"] = W(f"""SELECT * FROM (SELECT footprint_id, pad_number, CASE WHEN pad_number % 3 = 0 THEN 'fp_text' ELSE 'fp_line' END AS tag,
   CASE pad_number % 4 WHEN 0 THEN 'F.SilkS' WHEN 1 THEN 'Dwgs.User' WHEN 2 THEN 'B.Cu' ELSE 'F.Mask' END AS layer FROM fx_pads) z
   WHERE tag = 'fp_text' OR layer IN ({', '.join(q(x) for x in L.DRAWN_LAYERS)})""")
