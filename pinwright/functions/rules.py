"""Scalar rules of the catalogue as Spark column expressions.

Nothing here touches rows from Python: each function returns a ``Column`` (or a
projected ``DataFrame`` where a rule needs intermediate columns), so the work
stays in the JVM and fuses into whole-stage code generation.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups as L

WHITESPACE = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    """Trim every kind of ASCII whitespace, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def first_of(arr: Column) -> Column:
    """First array element, null when the array is empty."""
    return F.try_element_at(arr, F.lit(1))


def sql_text(value) -> str:
    """A literal as SQL text, so that a whole table costs one call to the JVM."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, list):
        return "array(" + ", ".join(sql_text(v) for v in value) + ")"
    return str(value)


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small literal map, null when absent."""
    entries = ", ".join(sql_text(x) for kv in table.items() for x in kv)
    return F.try_element_at(F.expr(f"map({entries})"), key)


def numbered(df: DataFrame, keep, array: Column, pos: str, out: str) -> DataFrame:
    """One row per array element with its position.

    The outer form is used because the inner one makes the optimizer test the
    array's size first, evaluating the whole expression behind it twice.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, out))
    return rows.filter(F.col(pos).isNotNull())


def case_chain(branches, otherwise) -> Column:
    """``CASE`` from (condition, value) pairs in order: the first match wins."""
    chain = None
    for cond, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return chain.otherwise(other)


def contains_any(text: Column, words) -> Column:
    cond = F.lit(False)
    for word in words:
        cond = cond | F.contains(text, F.lit(word))
    return cond


# --- part numbers -------------------------------------------------------------

def bare_number(pn: Column) -> Column:
    """Upper-case part number without grade (-Q1) and voltage (-3.3) endings."""
    p = F.regexp_replace(F.upper(strip(pn)), r"-Q\d+$", "")
    return F.regexp_replace(p, r"-\d+\.?\d*$", "")


def listed_suffix(bare: Column) -> Column:
    """First suffix in list order that ends the number; null when none does."""
    return first_of(F.filter(F.expr(sql_text(L.SUFFIXES)), lambda s: F.endswith(bare, s)))


def split_suffix(df: DataFrame, pn: str, base: str = "base", code: str = "code") -> DataFrame:
    """Add base number and package code (reel R removed) of a part number."""
    hit = F.col("_suffix")
    return (
        df.withColumn("_bare", bare_number(F.col(pn)))
        .withColumn("_suffix", listed_suffix(F.col("_bare")))
        .withColumn(
            base,
            F.when(hit.isNull(), F.col("_bare")).otherwise(
                F.substring(F.col("_bare"), F.lit(1), F.length("_bare") - F.length(hit))
            ),
        )
        .withColumn(code, F.regexp_replace(hit, "R+$", ""))
        .drop("_bare", "_suffix")
    )


def manufacturer(pn: Column) -> Column:
    p = F.upper(strip(pn))
    return case_chain([(p.rlike("(?i)" + pat), name) for name, pat in L.MAKER_PREFIXES], "")


def _group(text: Column, pattern: str, idx: int = 1) -> Column:
    """A capture group, null instead of the empty string when nothing matched."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, idx))


def ordering_variants(pn: Column) -> Column:
    """Ranked base numbers after removing maker-specific ordering endings."""
    p = F.upper(strip(pn))
    adi = _group(p, L.ADI_ORDERING)
    return F.array_distinct(
        F.array_compact(
            F.array(
                p,
                _group(p, L.MAXIM_ORDERING),
                F.when(F.length(adi) >= 4, adi),
                _group(p, L.LINEAR_ORDERING),
                _group(p, L.VOLTAGE_ORDERING),
            )
        )
    )


def _adi_addresses(variants: Column) -> Column:
    def forms(v: Column) -> Column:
        number = F.lower(F.regexp_extract(v, L.LINEAR_NUMBER, 1))
        revisions = F.array(*[F.lit(r + ".pdf") for r in L.LINEAR_REVISIONS])
        plain = F.array(
            F.concat(F.lit(L.ADI_SHEETS), F.lower(v), F.lit(".pdf")),
            F.concat(F.lit(L.ADI_SHEETS), F.upper(v), F.lit(".pdf")),
        )
        revised = F.transform(revisions, lambda r: F.concat(F.lit(L.ADI_SHEETS), number, r))
        return F.when(v.rlike(L.LINEAR_NUMBER), F.concat(plain, revised)).otherwise(plain)

    return F.array_distinct(F.flatten(F.transform(variants, forms)))


def source_candidates(df: DataFrame, pn: str, out: str = "candidates") -> DataFrame:
    """Add the ranked array of document addresses to try for a part number.

    A known maker gives its own address forms; an unknown one falls back on the
    universal resolver forms.
    """
    full, base = F.col("_full"), F.col("_base")
    volt, volt_base = F.col("_volt"), F.col("_volt_base")
    qual = F.regexp_replace(full, r"-q\d+$", "")
    family = F.when(volt_base != full, F.regexp_replace(volt_base, "[a-z]{1,2}$", ""))
    family2 = F.when(base != full, F.regexp_replace(base, "[a-z]{1,2}$", ""))
    names = F.array_distinct(
        F.array_compact(
            F.array(
                full,
                F.when(qual != full, qual),
                F.when(base != full, base),
                F.when(volt != full, volt),
                F.when((volt_base != full) & (volt_base != base), volt_base),
                F.when((family != volt_base) & (F.length(family) >= 5), family),
                F.when((family2 != base) & (F.length(family2) >= 5), family2),
            )
        )
    )
    resolver = F.flatten(
        F.transform(
            names,
            lambda n: F.array(
                F.concat(F.lit(L.TI_RESOLVER), n),
                F.concat(F.lit(L.TI_SYMLINK), n, F.lit(".pdf")),
            ),
        )
    )
    raw = F.col(pn)
    undashed = F.replace(F.upper(raw), F.lit("-"), F.lit(""))
    maker = F.col("_maker")

    def single(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    forms = case_chain(
        [
            (maker.isin("TI", ""), resolver),
            (maker == "Analog Devices", _adi_addresses(ordering_variants(raw))),
            (maker == "Microchip", F.array_distinct(F.array(
                single(L.MICROCHIP_DOCS, undashed, ".pdf"),
                single(L.MICROCHIP_DOCS, F.upper(strip(raw)), ".pdf")))),
            (maker == "ON Semiconductor", F.array(single(L.ONSEMI_SHEETS, undashed, "-D.PDF"))),
            (maker == "STMicroelectronics",
             F.array(single(L.ST_SHEETS, F.lower(strip(raw)), ".pdf"))),
            (maker == "NXP", F.array_distinct(F.array(
                single(L.NXP_SHEETS, F.upper(raw), ".pdf"),
                single(L.NXP_SHEETS, undashed, ".pdf")))),
        ],
        F.array().cast("array<string>"),
    )
    work = df.withColumn("_full", F.lower(strip(raw))).withColumn("_maker", manufacturer(raw))
    work = work.withColumn("_volt", F.regexp_replace(full, r"-\d+\.?\d*$", ""))
    work = split_suffix(work, pn, "_base0", "_c0")
    work = split_suffix(work, "_volt", "_volt0", "_c1")
    work = work.withColumn("_base", F.lower("_base0")).withColumn(
        "_volt_base", F.when(volt != full, F.lower("_volt0")).otherwise(base)
    )
    return work.withColumn(out, forms).drop(
        "_full", "_maker", "_volt", "_base0", "_c0", "_volt0", "_c1", "_base", "_volt_base"
    )


# --- addresses ----------------------------------------------------------------

def maker_of_address(url: Column) -> Column:
    low = F.lower(url)
    return case_chain([(F.contains(low, F.lit(d)), m) for d, m in L.DOMAIN_MAKERS], "")


def percent_decode(s: Column) -> Column:
    """Percent decoding that keeps '+' and leaves malformed escapes alone."""
    safe = F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B")))


def redirect_links(html: Column, parameter: str = "uddg") -> Column:
    """Ordered array of document links behind redirect parameters in a page.

    Direct ``.pdf`` links come first, then product pages rewritten to the
    document resolver. A page is one row, so no shuffle is needed.
    """
    raw = F.regexp_extract_all(html, F.lit(parameter + '=([^&"]+)'), F.lit(1))
    links = F.array_distinct(F.transform(raw, percent_decode))
    product = r"^https?://www\.ti\.com/product/([A-Za-z0-9_-]+)"
    pdf = F.filter(links, lambda u: F.contains(F.lower(u), F.lit(".pdf")))
    pages = F.transform(
        F.filter(links, lambda u: u.rlike(product)),
        lambda u: F.concat(F.lit(L.TI_RESOLVER), F.lower(F.regexp_extract(u, product, 1))),
    )
    return F.concat(pdf, pages)


def address_tier(url: Column) -> Column:
    """0 maker, 1 aggregator, 2 other, null when the site is rejected."""
    low = F.lower(url)
    return (
        F.when(contains_any(low, L.REJECTED_SITES), F.lit(None).cast("int"))
        .when(contains_any(low, L.MAKER_SITES), 0)
        .when(contains_any(low, L.AGGREGATOR_SITES), 1)
        .otherwise(2)
    )


def rank_addresses(urls: Column) -> Column:
    """Stable tier order of an address array, rejected sites and repeats removed."""
    tagged = F.transform(urls, lambda u: F.struct(address_tier(u).alias("tier"), u.alias("url")))

    def of_tier(t):
        return F.filter(tagged, lambda x: x["tier"] == t)

    tiers = [of_tier(t) for t in (0, 1, 2)]
    return F.array_distinct(F.transform(F.concat(*tiers), lambda x: x["url"]))


def cache_key(url: Column) -> Column:
    digest = F.substring(F.md5(url), 1, 12)
    name = F.element_at(F.split(url, "/"), -1)
    return F.when(F.endswith(name, F.lit(".pdf")), F.concat(digest, F.lit("_"), name)).otherwise(
        F.concat(digest, F.lit(".pdf"))
    )


# --- pins ----------------------------------------------------------------------

def clean_pin_name(name: Column) -> Column:
    """Plus-minus sign, minus sign and en dash become '-'; ends trimmed."""
    return strip(F.translate(name, "±−–", "---"))


def io_type(cell: Column) -> Column:
    return lookup(L.IO_TYPES, F.upper(strip(cell)))


def infer_pin_type(name: Column, description: Column) -> Column:
    """Pin type from the name patterns, then the description phrases.

    Neighbouring patterns of the same type are joined into one alternation, so
    the order of the table is kept with fewer regular expressions per row.
    """
    n = F.upper(strip(name))
    d = F.lower(F.coalesce(description, F.lit("")))
    branches = []
    for pin_type, run in groupby(L.PIN_TYPE_BY_NAME, key=lambda x: x[1]):
        branches.append((n.rlike("|".join(p for p, _ in run)), pin_type))
    for any_of, all_of, none_of, pin_type in L.PIN_TYPE_BY_PHRASE:
        cond = contains_any(d, any_of) if any_of else F.lit(True)
        for w in all_of:
            cond = cond & F.contains(d, F.lit(w))
        for w in none_of:
            cond = cond & ~F.contains(d, F.lit(w))
        branches.append((cond, pin_type))
    return case_chain(branches, "passive")


def pin_numbers(cell: Column) -> Column:
    """Pin-number cell to an ordered array: digits kept, pad words become EP."""
    flat = F.regexp_replace(F.coalesce(cell, F.lit("")), "[\n;]", ",")
    parts = F.transform(F.split(flat, ","), strip)
    coded = F.transform(
        parts,
        lambda p: F.when(p.rlike(r"^[0-9]+$"), p).when(p.rlike(L.PAD_NUMBER_CELL), F.lit("EP")),
    )
    return F.array_compact(coded)


def short_pin_name(name: Column) -> Column:
    """Line breaks removed, full words replaced by their short forms."""
    n = strip(F.replace(strip(F.coalesce(name, F.lit(""))), F.lit("\n"), F.lit("")))
    return F.coalesce(lookup(L.NAME_SHORT_FORMS, F.upper(n)), n)


def _role(cell: Column, patterns) -> Column:
    h = strip(F.replace(cell, F.lit("\n"), F.lit(" ")))
    return F.coalesce(h.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def is_pin_header(cell: Column) -> Column:
    return _role(cell, L.HEADER_PIN)


def is_name_header(cell: Column) -> Column:
    return _role(cell, L.HEADER_NAME)


def is_type_header(cell: Column) -> Column:
    return _role(cell, L.HEADER_TYPE)


def is_desc_header(cell: Column) -> Column:
    return _role(cell, L.HEADER_DESC)


def is_alt_header(cell: Column) -> Column:
    return _role(cell, L.HEADER_ALT)


def is_standard_pin_name(name: Column) -> Column:
    return strip(name).rlike("(?i)" + L.STANDARD_PIN_NAME)


# --- packages and libraries ------------------------------------------------------

def footprint_terms(package: Column, pin_count: Column) -> Column:
    """Ranked search terms for a package name; repeats are kept."""
    up = F.upper(package)
    blank = F.lit(None).cast("string")

    def family(prefix, *others):
        rest = F.substring(up, F.lit(len(prefix) + 1), F.length(up))
        return F.startswith(up, F.lit(prefix)), [F.concat(F.lit(o), rest) for o in others]

    families = [
        family("HTSSOP", "TSSOP"),
        family("WQFN", "QFN", "VQFN"),
        family("VQFN", "QFN", "WQFN"),
        family("TQFN", "QFN"),
    ]
    first = case_chain([(c, forms[0]) for c, forms in families], blank)
    second = case_chain([(c, forms[1]) for c, forms in families if len(forms) > 1], blank)
    counted = (F.coalesce(pin_count, F.lit(0)) != 0) & ~package.rlike(r"\d+$")
    return F.array_compact(
        F.array(
            package,
            F.when(counted, F.concat(package, F.lit("-"), pin_count.cast("string"))),
            F.regexp_replace(package, "[-_]", ""),
            F.replace(package, F.lit("-"), F.lit("_")),
            first,
            second,
        )
    )


def wildcard_stem(name: Column) -> Column:
    """Name without its trailing wildcard letters; null when it has none."""
    stem = F.regexp_replace(name, "X+$", "")
    return F.when((stem != name) & (stem != ""), stem)


def wildcard_match(name: Column, query: Column) -> Column:
    """Does a name ending in X match a query at most one character longer?"""
    stem = wildcard_stem(name)
    return F.coalesce(
        F.startswith(query, stem) & (F.length(query) <= F.length(name) + 1), F.lit(False)
    )


def model_reference(path: Column) -> Column:
    """3D model path without its variable prefix."""
    return F.regexp_replace(path, r"\$\{[^}]+\}/", "")


def unit_number(sub_name: Column, parent: Column) -> Column:
    """Unit of a sub-symbol name such as ``LM358_2_1``; 0 when it has none."""
    rest = F.substring(sub_name, F.length(parent) + 1, F.length(sub_name))
    return F.coalesce(F.when(
        rest.rlike(r"^_\d+_\d+$"), F.regexp_extract(rest, r"^_(\d+)_\d+$", 1).cast("int")
    ), F.lit(0))


# --- customers ----------------------------------------------------------------------

def normal_email(raw: Column) -> Column:
    e = F.lower(strip(raw))
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), e)


def email_key(raw: Column) -> Column:
    return F.substring(F.sha2(normal_email(raw), 256), 1, 32)


def result_status(pin_count: Column) -> Column:
    return F.when(F.coalesce(pin_count, F.lit(0)) == 0, "ERROR").otherwise("COMPLETE")
