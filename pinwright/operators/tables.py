"""Reading pin tables and package tables from extracted cells.

Cells are rows ``(doc_id, page_num, table_seq, row_idx, col_idx, text)``; a table
is (doc_id, table_seq). Only what is bounded by the width of a table is ever
gathered into an array (its three possible heading rows, or one data row).
Everything that follows the length of a table or document stays in rows and uses
the block-wise helpers of ``ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions import rules as R
from ..sources.shared import staged
from . import ordered

TABLE = ["doc_id", "table_seq"]
OFTEN = 10_000  # rows from which a heading's text is judged beforehand


def admit_tables(cells: DataFrame) -> DataFrame:
    """Cells of tables that have more than one row."""
    sizes = cells.groupBy(*TABLE).agg(F.min("row_idx").alias("_a"), F.max("row_idx").alias("_b"))
    return cells.join(sizes.filter("_a < _b").select(*TABLE), TABLE, "left_semi")


def header_roles(cells: DataFrame) -> DataFrame:
    """Which roles each heading cell could play."""
    c = F.col("text")
    return cells.filter("row_idx = 0").select(
        *TABLE, "col_idx", "text", R.is_pin_header(c).alias("pin"), R.is_name_header(c).alias("name"),
        R.is_type_header(c).alias("type"), R.is_desc_header(c).alias("description"),
        R.is_alt_header(c).alias("alternate"))


def is_section_text(text: Column) -> Column:
    """Nothing but section words in an upper-case text (spaces may be lost)."""
    words = F.filter(F.split(F.regexp_replace(text, r"\bAND\b", ""), r"\s+"), lambda w: w != "")
    known = [w.upper() for w in L.SECTION_WORDS]
    rest = F.replace(text, F.lit("AND"), F.lit(""))
    for w in known:
        rest = F.replace(rest, F.lit(w), F.lit(" "))
    spelled = (F.size(words) > 0) & F.forall(words, lambda w: w.isin(known))
    return spelled | (R.strip(rest) == "")


def is_section_row(row: Column) -> Column:
    """One non-empty cell, and that a section heading."""
    filled = F.filter(F.transform(row, lambda c: R.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.when(F.size(filled) == 1, is_section_text(F.upper(F.try_element_at(filled, F.lit(1))))).otherwise(
        F.lit(False))


def rows_of(cells: DataFrame) -> DataFrame:
    """One row per table row with its cells as an array; widths stay small."""
    grouped = cells.groupBy(*TABLE, "page_num", "row_idx").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", "text"))).alias("_c"), (F.max("col_idx") + 1).alias("_w"))
    dense = F.transform("_c", lambda c: c["text"])
    by_col = F.map_from_entries("_c")
    gaps = F.transform(F.sequence(F.lit(0), F.col("_w") - 1), lambda i: F.try_element_at(by_col, i))
    return grouped.select(
        *TABLE, "page_num", "row_idx", F.when(F.size("_c") == F.col("_w"), dense).otherwise(gaps).alias("row"))


def drop_section_rows(cells: DataFrame) -> DataFrame:
    return rows_of(cells).filter(~is_section_row(F.col("row")))


def detect_headers(cells: DataFrame) -> DataFrame:
    """Heading of every pin table: (doc_id, table_seq, page_num, form, data_start, heads).

    Five forms in order: row 0; rows 0+1 merged; row 1; row 1 under a PIN title;
    rows 1+2 merged. A heading needs a pin and a name column; one column may
    serve as both. ``heads`` lists the heading cells with their possible roles.
    """
    # Only the first three rows can be headings, a filter that reaches the scan; how far
    # a table goes is a plain numeric aggregate over all cells. Heading cells are dealt out by table, once.
    at = [F.col("row_idx") == i for i in range(3)]
    columns = cells.filter("row_idx < 3").repartition(*TABLE).groupBy(*TABLE, "col_idx").agg(
        *[F.max(F.when(at[i], F.col("text"))).alias(f"t{i}") for i in range(3)],
        *[F.max(at[i]).alias(f"h{i}") for i in range(3)])
    reach = cells.groupBy(*TABLE).agg(
        (F.max("row_idx") + 1).alias("n_rows"), F.min("page_num").alias("page_num"))
    # One row per table, with the texts of its heading cells in each form.
    work = columns.join(reach.hint("merge"), TABLE).select(
        *TABLE, "page_num", "n_rows", "col_idx", *[F.col(f"h{i}") for i in range(3)], F.col("t0").alias("raw0"), F.col("t1").alias("raw1"),
        *[R.strip(F.coalesce(f"t{i}", F.lit(""))).alias(f"t{i}") for i in range(3)])
    both = R.strip(F.concat("t0", F.lit(" "), "t1")).alias("t01"), R.strip(F.concat("t1", F.lit(" "), "t2")).alias("t12")
    given = F.struct("col_idx", *[f"h{i}" for i in range(3)], "raw0", "raw1", "t0", "t1", "t01", "t12")
    tables = staged(_with_forms(work.select("*", *both).groupBy(*TABLE, "page_num", "n_rows").agg(
        F.sort_array(F.collect_list(given)).alias("_cols"))), "headings")
    # Headings repeat endlessly: the role patterns run once for each text that is found often, of which
    # there are at most rows / OFTEN, and in place for the others. No text is a key that rows are dealt out by.
    roles_of = {"pin": R.is_pin_header, "name": R.is_name_header, "type": R.is_type_header,
                "desc": R.is_desc_header, "alt": R.is_alt_header}
    cells_of = tables.select(*TABLE, F.explode("_forms").alias("_f")).select(*TABLE, "_f.*", F.coalesce("_f.text", F.lit("")).alias("_key"))
    c = F.col("_key")
    often = F.broadcast(cells_of.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > OFTEN).select("_key", *[f(c).alias(f"_{k}") for k, f in roles_of.items()]))
    judged = {k: F.coalesce(f"_{k}", f(c)) for k, f in roles_of.items()}
    # First the form of each table, from numbers that are put together before they are dealt out; then
    # only that form's cells are gathered, in the task that has the table.
    bits = F.when(judged["pin"], 1).otherwise(0) + F.when(judged["name"], 2).otherwise(0)
    found = cells_of.join(often, "_key", "left").select(*TABLE, "form", bits.alias("_bits")).groupBy(*TABLE).agg(
        *[F.bit_or(F.when(F.col("form") == i, F.col("_bits")).otherwise(0)).alias(f"_f{i}") for i in range(1, 6)])
    form = R.case_chain([(F.col(f"_f{i}") == 3, i) for i in range(1, 6)], F.lit(None).cast("int"))
    best = found.select(*TABLE, form.alias("form")).filter("form is not null").hint("merge")
    return (
        tables.join(best, TABLE)
        .select(*TABLE, "page_num", "n_rows", "form", F.explode(F.filter("_forms", lambda f: f["form"] == F.col("form"))).alias("_f"))
        .withColumn("_key", F.coalesce("_f.text", F.lit(""))).join(often, "_key", "left")
        .select(*TABLE, "page_num", "n_rows", "form", "_f.data_start",
                F.struct("_f.col", "_f.text", *[v.alias(k) for k, v in judged.items()]).alias("_c"))
        .groupBy(*TABLE, "page_num", "n_rows", "form", "data_start")
        .agg(F.sort_array(F.collect_list("_c")).alias("heads"))
    )


def _with_forms(tables: DataFrame) -> DataFrame:
    """``_forms`` lists (form, data_start, col, text) of a table, from its columns ``_cols`` in their order."""
    def raw(c, patterns):
        return c.rlike("(?i)" + "|".join(patterns))

    known = F.filter("_cols", lambda h: h["col_idx"].isNotNull())
    title = F.upper(R.first_of(F.filter(known, lambda h: h["t0"] != ""))["t0"])
    # Only a lone PIN title asks for the name column.
    named = R.first_of(F.filter(known, lambda h: (h["t1"] != "") & raw(h["t1"], L.HEADER_NAME)))["col_idx"]
    n, name_at = F.col("n_rows"), F.col("_name_at")

    def labelled(h):
        # Under a lone PIN title, columns that are neither type nor description count pins.
        c1 = h["t1"]
        plain = (h["col_idx"] == name_at) | (c1 == "") | raw(c1, L.HEADER_TYPE) | raw(c1, L.HEADER_DESC)
        return F.when(plain, c1).otherwise(F.concat(F.lit("PIN "), c1))

    forms = [
        (1, n >= 2, lambda h: h["h0"], lambda h: h["raw0"]),
        (2, n > 2, lambda h: h["h0"] | h["h1"], lambda h: h["t01"]),
        (2, n > 2, lambda h: h["h1"], lambda h: h["raw1"]),
        (2, (n > 2) & name_at.isNotNull(), lambda h: h["h1"], labelled),
        (3, n > 3, lambda h: h["h1"] | h["h2"], lambda h: h["t12"]),
    ]

    def of(i, start, fits, has, text):
        listed = F.transform(F.filter("_cols", has), lambda h: F.struct(
            F.lit(i).alias("form"), F.lit(start).alias("data_start"), h["col_idx"].alias("col"), text(h).alias("text")))
        return F.when(fits, listed).otherwise(F.array().cast("array<struct<form:int,data_start:int,col:int,text:string>>"))

    every = F.concat(*[of(i + 1, *form) for i, form in enumerate(forms)])
    return tables.withColumn("_name_at", F.when(title.isin("PIN", "PINS"), named)).select(
        *TABLE, "page_num", "n_rows", every.alias("_forms"))


def column_roles(headers: DataFrame) -> DataFrame:
    """Column of each role: name before type before description before alternates.

    The pin column is the first pin column that is not the name column.
    """
    def taken(*cols):
        return lambda h: F.array_contains(F.array(*[F.coalesce(F.col(c), F.lit(-1)) for c in cols]), h["col"])

    def columns(role, *before):
        free = (lambda h: h[role] & ~taken(*before)(h)) if before else (lambda h: h[role])
        return F.transform(F.filter("heads", free), lambda h: h["col"])

    work = headers.withColumn("name_col", R.first_of(columns("name")))
    work = work.withColumn("type_col", R.first_of(columns("type", "name_col")))
    work = work.withColumn("desc_col", R.first_of(columns("desc", "name_col", "type_col")))
    return work.withColumn("alt_cols", columns("alt", "name_col", "type_col", "desc_col")).withColumn(
        "pin_cols", columns("pin", "name_col")).withColumn("pin_col", R.first_of(F.col("pin_cols")))


def layouts(headers: DataFrame) -> DataFrame:
    """One layout per pin column; several columns keep their heading as a label."""
    own = R.first_of(F.filter("heads", lambda h: h["col"] == F.col("pin_col")))["text"]
    label = R.strip(F.replace(F.coalesce(own, F.lit("")), F.lit("\n"), F.lit(" ")))
    return (
        column_roles(headers).drop("pin_col")
        .select(*TABLE, "page_num", "n_rows", "data_start", "heads", "name_col", "type_col",
                "desc_col", "alt_cols", F.size("pin_cols").alias("_many"),
                F.posexplode_outer("pin_cols").alias("layout", "pin_col"))
        .filter("pin_col is not null")
        .withColumn("label", F.when(F.col("_many") > 1, label).otherwise(""))
        .drop("heads", "_many")
    )


def table_groups(lay: DataFrame) -> DataFrame:
    """Gaps and islands: tables continued on the next page share a group number.

    A layout joins the group before it when pin and name column agree and its
    page is at most one further. Layouts of a multi-package table alternate and
    therefore start a new group each.
    """
    # One small row per table, read several times below: written once.
    lay = staged(lay, "layouts").hint("merge")
    order = ["table_seq", "layout"]
    block = F.floor(F.col("table_seq") / 4096)
    prev = ordered.last_before(
        lay, ["doc_id"], order, F.struct("pin_col", "name_col", "page_num"), "_p", block)
    joins = (
        (F.col("_p.pin_col") == F.col("pin_col")) & (F.col("_p.name_col") == F.col("name_col"))
        & (F.col("page_num") <= F.col("_p.page_num") + 1)
    )
    starts = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    grouped = ordered.running_sum(prev, ["doc_id"], order, starts, "group_no", block)
    return staged(grouped.drop("_p").withColumn("group_no", F.col("group_no").cast("int")), "groups").hint("merge")


def continuation_fill(rows: DataFrame, keys, order, block: Column) -> DataFrame:
    """Type and description carried down to rows that have neither.

    ``rows`` carries ``type_cell``, ``io`` (parsed type or null) and
    ``description`` ('' when blank). The state is the last row before that has a
    type cell and is not blank in both; it is used when its type is known.
    """
    blank = F.col("io").isNull() & (F.col("description") == "")
    sets = (F.coalesce("type_cell", F.lit("")) != "") & ~blank
    state = F.when(sets, F.struct("io", "description"))
    seen = ordered.last_before(rows, keys, order, state, "_s", block)
    use = blank & F.col("_s.io").isNotNull()
    fill = {c: F.when(use, F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in ("io", "description")}
    return seen.select(*[fill.get(c, F.col(c)) for c in rows.columns])


def read_pins(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Pins of every layout group: (doc_id, group_no, table_seq, layout, row_idx, num_pos, …)."""
    # Only the cells a layout points at are kept, by plain aggregates per row.
    def at(col):
        return F.max(F.when(F.col("col_idx") == F.col(col), F.col("text")))

    filled = R.strip(F.coalesce("text", F.lit("")))
    extra = F.when(F.array_contains("alt_cols", F.col("col_idx")) & ~filled.isin("", "-"),
                   F.struct("col_idx", filled.alias("v")))
    body = (
        cells.drop("page_num").join(groups, TABLE).filter("row_idx >= data_start")
        .groupBy("doc_id", "group_no", "table_seq", "layout", "row_idx")
        .agg(F.max("col_idx").alias("_last"), F.max(F.greatest("pin_col", "name_col")).alias("_need"),
             F.count_if(filled != "").alias("_filled"), F.max(filled).alias("_only"),
             at("name_col").alias("_name"), at("pin_col").alias("_pin"), at("type_col").alias("type_cell"),
             at("desc_col").alias("_desc"), F.collect_list(extra).alias("_alt"))
        .filter("_last >= _need")
        .filter((F.col("_filled") != 1) | ~is_section_text(F.upper("_only")))
        .withColumn("name", R.short_pin_name(F.col("_name")))
        .filter("name <> ''")
        .select("doc_id", "group_no", "table_seq", "layout", "row_idx", "name", "type_cell",
                R.io_type(F.col("type_cell")).alias("io"),
                R.strip(F.coalesce("_desc", F.lit(""))).alias("description"),
                R.pin_numbers(R.strip(F.coalesce("_pin", F.lit("")))).alias("numbers"),
                F.transform(F.sort_array("_alt"), lambda a: a["v"]).alias("alt_functions"))
    )
    # Parsed rows are far smaller than the cells and read twice by the fill.
    body = staged(body, "rows")
    block = F.struct(F.col("table_seq"), F.col("layout"), F.floor(F.col("row_idx") / ordered.BLOCK))
    filled = continuation_fill(body, ["doc_id", "group_no"], ["table_seq", "layout", "row_idx"], block)
    low = F.lower("description")
    pad = F.upper("name").rlike(L.PAD_NAME) | F.contains(low, F.lit("thermal pad")) | F.contains(
        low, F.lit("exposed pad"))
    numbers = F.when(F.size("numbers") > 0, F.col("numbers")).when(pad, F.array(F.lit("EP"))).otherwise(
        F.array().cast("array<string>"))
    keep = ["doc_id", "group_no", "table_seq", "layout", "row_idx", "name", "description", "io", "alt_functions"]
    every = R.numbered(filled, keep, numbers, "num_pos", "number")
    return every.withColumn(
        "pin_type", F.coalesce("io", R.infer_pin_type(F.col("name"), F.col("description")))).drop("io")


def score_groups(pins: DataFrame, groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Score of each layout group of a document; ``best`` marks the winner.

    ``wanted(doc_id, expected_count, package, base)`` holds the pin count, package
    and base number looked for. Unique numbers count one each, an exact count
    adds 10,000, a matching variant label 50,000, a matching package label
    100,000; ties go to the higher confidence, then to the earlier group.
    """
    unique = pins.groupBy("doc_id", "group_no").agg(F.countDistinct("number").alias("unique_pins")).hint("merge")
    target, label = F.upper("package"), F.upper("label")

    def family(c):
        return F.regexp_replace(c, r"-\d+$", "")

    fits = (target != "") & (label != "") & (family(target) != "") & (family(label) != "") & (
        F.contains(label, family(target)) | F.contains(target, family(label)))
    # A document that nothing is known of is scored all the same.
    spans = groups.join(wanted, "doc_id", "left").groupBy("doc_id", "group_no").agg(
        F.sum(F.col("n_rows") - F.col("data_start")).alias("data_rows"),
        F.max(F.coalesce(fits, F.lit(False))).alias("package_hit"),
        F.min_by("label", F.struct("table_seq", "layout")).alias("_label"),
        F.first("expected_count").alias("expected_count"), F.first("base").alias("base"))
    head = F.replace(F.upper("_label"), F.lit("PIN "), F.lit(""))
    base = F.upper("base")
    variant = (base != "") & (F.col("_label") != "") & (
        F.contains(head, base) | F.contains(base, head))
    n = F.col("unique_pins")
    scored = (
        unique.join(spans, ["doc_id", "group_no"])
        .withColumn("confidence", F.least(F.lit(1.0), n / F.greatest("data_rows", F.lit(1))))
        .withColumn("priority", n
                    + F.when((F.col("expected_count") > 0) & (n == F.col("expected_count")), 10000).otherwise(0)
                    + F.when(F.col("package_hit"), 100000).otherwise(0)
                    + F.when(F.coalesce(variant, F.lit(False)), 50000).otherwise(0))
        .select("doc_id", "group_no", "unique_pins", "data_rows", "priority", "confidence")
    )
    scored = staged(scored, "scores").hint("merge")
    winner = scored.groupBy("doc_id").agg(
        F.max_by("group_no", F.struct("priority", "confidence", -F.col("group_no"))).alias("_g"))
    return scored.join(winner, "doc_id").withColumn("best", F.col("group_no") == F.col("_g")).drop("_g")


def best_pins(pins: DataFrame, scores: DataFrame) -> DataFrame:
    """Pins of the winning group, first occurrence per number."""
    chosen = pins.join(scores.filter("best").select("doc_id", "group_no").hint("merge"),
                       ["doc_id", "group_no"], "left_semi")
    return ordered.first_per_key(chosen, ["doc_id", "number"],
                                 ["table_seq", "layout", "row_idx", "num_pos"])


# --- package information tables -----------------------------------------------------

def family_of_code(code: Column) -> Column:
    """Family of a known package code; null for unknown codes."""
    table = {c: (n.rsplit("-", 1)[0] if "-" in n else n) for c, (n, _) in L.CODE_PACKAGES.items()}
    return R.lookup(table, code)


def packages_from_tables(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Packages listed for a part in device-information tables.

    ``parts(doc_id, part_number)``. A table qualifies when its heading speaks of
    packages and of parts or devices; the part label in the first column is
    filled down, a trailing X is a wildcard. The first table with hits counts.
    """
    up = F.upper(F.coalesce("text", F.lit("")))
    heads = cells.filter("row_idx = 0").groupBy(*TABLE).agg(
        F.max(F.contains(up, F.lit("PACKAGE"))).alias("_p"),
        F.max(F.contains(up, F.lit("PART")) | F.contains(up, F.lit("DEVICE"))).alias("_d"),
        F.min(F.when(F.contains(up, F.lit("PACKAGE")) & ~F.contains(up, F.lit("SIZE")),
                     F.col("col_idx"))).alias("pkg_col"),
    ).filter("_p and _d and pkg_col is not null").select(*TABLE, "pkg_col")
    body = cells.filter("row_idx > 0").join(heads, TABLE).groupBy(*TABLE, "row_idx").agg(
        (F.max("col_idx") + 1).alias("_w"), F.first("pkg_col").alias("_c"),
        F.max(F.when(F.col("col_idx") == 0, R.strip(F.col("text")))).alias("_label"),
        F.max(F.when(F.col("col_idx") == F.col("pkg_col"), R.strip(F.col("text")))).alias("cell"),
    ).filter("_w > _c")
    own = F.when(F.coalesce("_label", F.lit("")) != "", F.upper("_label"))
    filled = ordered.last_before(body, TABLE, ["row_idx"], own, "_before",
                                 ordered.block_of("row_idx"))
    rows = filled.withColumn("label", F.coalesce(own, "_before")).filter(
        "label is not null and cell is not null and cell <> ''").join(parts, "doc_id")
    pn = F.upper(R.strip(F.col("part_number")))
    fits = F.startswith(pn, F.regexp_replace("label", "X+$", "")) | (
        F.contains("label", F.lit("X")) & F.startswith(pn, F.replace("label", F.lit("X"), F.lit(""))))
    pattern = "(?i)" + L.PACKAGE_CELL
    code = F.upper(F.regexp_extract("cell", pattern, 1))
    count = F.regexp_extract("cell", pattern, 3).cast("int")
    hits = rows.filter(fits).filter(F.col("cell").rlike(pattern)).select(
        *TABLE, "row_idx", code.alias("code"), count.alias("pin_count"),
        F.concat(F.coalesce(family_of_code(code), F.upper(F.regexp_extract("cell", pattern, 2))),
                 F.lit("-"), count.cast("string")).alias("name"))
    named = ordered.first_per_key(hits, ["doc_id", "table_seq", "name"], ["row_idx"])
    first = hits.groupBy("doc_id").agg(F.min("table_seq").alias("table_seq"))
    return named.join(first, TABLE, "left_semi").select(
        "doc_id", "table_seq", "row_idx", "name", "pin_count", "code")
