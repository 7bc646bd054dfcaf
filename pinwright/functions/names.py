"""When do two pin names mean the same pin?

Each name is brought into a set of canonical forms once; two names are
equivalent when any pair of forms agrees. The forms are plain columns, so the
test is a code-generated predicate evaluated after an equi-join on the pin
number, and each side can compute its forms before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups as L
from .rules import lookup, strip


def bare_polarity(n: Column) -> Column:
    """Name without its active-low mark (``~{X}``, ``~X`` or ``X#``)."""
    braced = F.startswith(n, F.lit("~{")) & F.endswith(n, F.lit("}"))
    return (
        F.when(braced, F.substring(n, F.lit(3), F.length(n) - 3))
        .when(F.startswith(n, F.lit("~")),
              F.btrim(F.substring(n, F.lit(2), F.length(n)), F.lit("{}")))
        .when(F.endswith(n, F.lit("#")), F.substring(n, F.lit(1), F.length(n) - 1))
        .otherwise(n)
    )


def marked_polarity(n: Column) -> Column:
    """Name with any active-low mark written as ``~{X}``."""
    def wrap(inner):
        return F.concat(F.lit("~{"), inner, F.lit("}"))

    braced = F.startswith(n, F.lit("~{")) & F.endswith(n, F.lit("}"))
    return (
        F.when(F.endswith(n, F.lit("#")), wrap(F.substring(n, F.lit(1), F.length(n) - 1)))
        .when(braced, n)
        .when(F.startswith(n, F.lit("/")), wrap(F.substring(n, F.lit(2), F.length(n))))
        .otherwise(n)
    )


def _alias_ids(n: Column) -> Column:
    """Numbers of the alias pairs a name belongs to."""
    table: dict[str, list[int]] = {}
    for i, pair in enumerate(L.NAME_ALIASES):
        for name in pair:
            table.setdefault(name, []).append(i)
    return F.coalesce(lookup(table, n), F.array().cast("array<int>"))


def _amplifier_roles(n: Column) -> Column:
    """Generic amplifier pin names that a concrete name can stand for."""
    c = F.replace(n, F.lit(" "), F.lit(""))
    return F.array_compact(
        F.array(
            F.when(c.rlike(L.OPAMP_OUTPUT), F.lit("~")),
            F.when(c.rlike(L.OPAMP_PLUS), F.lit("+")),
            F.when(c.rlike(L.OPAMP_MINUS), F.lit("-")),
            F.when(c.isin(L.OPAMP_VPLUS), F.lit("V+")),
            F.when(c.isin(L.OPAMP_VMINUS), F.lit("V-")),
        )
    )


def folded_name(name: Column) -> Column:
    """Trimmed, upper case, every dash written as '-'."""
    return F.translate(F.upper(strip(name)), "–—−", "---")


def name_forms(name: Column) -> Column:
    """Struct of canonical forms of a pin name."""
    n = folded_name(name)
    base = bare_polarity(n)
    parts = F.transform(F.split(n, "/", -1), bare_polarity)
    slashed = F.regexp_replace(n, r"\s*\(([^)]+)\)", "/$1")
    unbracketed = strip(F.regexp_replace(n, r"\s*\([^)]*\)", ""))
    return F.struct(
        n.alias("n"),
        marked_polarity(n).alias("marked"),
        base.alias("base"),
        parts.alias("parts"),
        F.element_at(parts, 1).alias("first"),
        F.array_join(parts, "/").alias("joined"),
        slashed.alias("slashed"),
        F.array_join(F.transform(F.split(slashed, "/", -1), bare_polarity), "/").alias("slash_joined"),
        F.replace(F.regexp_replace(n, r"\s*/\s*", "_"), F.lit(" "), F.lit("_")).alias("separated"),
        F.regexp_replace(n, r"_\{([^}]+)\}", "$1").alias("subscript"),
        unbracketed.alias("unbracketed"),
        _amplifier_roles(n).alias("roles"),
        F.concat(
            F.transform(_alias_ids(n), lambda i: i),
            F.transform(_alias_ids(unbracketed), lambda i: i + 1000),
            F.transform(_alias_ids(base), lambda i: i + 2000),
        ).alias("aliases"),
    )


def same_pin_name(a: Column, b: Column) -> Column:
    """Equivalence of two ``name_forms`` structs."""
    return (
        (a["n"] == b["n"])
        | (a["marked"] == b["marked"])
        | (a["base"] == b["base"])
        | ((a["first"] == b["first"]) & (a["first"] != ""))
        | (a["first"] == b["base"])
        | (b["first"] == a["base"])
        | (a["joined"] == b["joined"])
        | F.array_contains(b["parts"], a["base"])
        | F.array_contains(a["parts"], b["base"])
        | (a["slashed"] == b["slashed"])
        | (a["separated"] == b["separated"])
        | (a["slash_joined"] == b["slash_joined"])
        | (a["subscript"] == b["subscript"])
        | ((a["unbracketed"] == b["unbracketed"]) & (a["unbracketed"] != ""))
        | F.array_contains(b["roles"], a["n"])
        | F.array_contains(a["roles"], b["n"])
        | F.arrays_overlap(a["aliases"], b["aliases"])
    )


def match_keys(forms: Column) -> Column:
    """Join keys of a name: two equivalent names share at least one of them."""
    def tag(t, c):
        return F.concat(F.lit(t + ":"), c)

    return F.array_distinct(F.concat(
        F.array(tag("n", forms["n"]), tag("m", forms["marked"]), tag("b", forms["base"]),
                tag("b", forms["first"]), tag("j", forms["joined"]), tag("s", forms["slashed"]),
                tag("k", forms["slash_joined"]), tag("p", forms["separated"]),
                tag("c", forms["subscript"]), tag("u", forms["unbracketed"]), tag("r", forms["n"])),
        F.transform(forms["parts"], lambda p: tag("b", p)),
        F.transform(forms["roles"], lambda r: tag("r", r)),
        F.transform(forms["aliases"], lambda a: tag("a", a.cast("string"))),
    ))


def judged_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) name pairs with ``same``; forms are built once per name."""
    distinct = pairs.select(a, b).distinct()
    names = distinct.select(F.explode(F.array(a, b)).alias("_name")).distinct().select(
        "_name", name_forms(F.col("_name")).alias("_forms"))
    fa = names.select(F.col("_name").alias(a), F.col("_forms").alias("_fa"))
    fb = names.select(F.col("_name").alias(b), F.col("_forms").alias("_fb"))
    return distinct.join(fa, a).join(fb, b).select(
        a, b, same_pin_name(F.col("_fa"), F.col("_fb")).alias("same"))


def equivalent_names(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """All equivalent (a, b) pairs between two sets of names, by shared form keys."""
    def keyed(df, name, out):
        named = df.select(name).distinct().withColumn(out, name_forms(F.col(name)))
        return named.select(name, out, F.explode_outer(match_keys(F.col(out))).alias("_k"))

    return (
        keyed(left, a, "_fa").join(keyed(right, b, "_fb"), "_k")
        .filter(same_pin_name(F.col("_fa"), F.col("_fb"))).select(a, b).distinct()
    )
