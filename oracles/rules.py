"""SQL text builders shared by the oracle queries."""

from itertools import groupby

from pinwright.functions import lookups as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(pairs, other) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


def has(text, words, glue=" OR ") -> str:
    return "(" + glue.join(f"contains({text}, {q(w)})" for w in words) + ")"


def infer(name, desc) -> str:
    n, d = f"upper(trim({name}))", f"lower(coalesce({desc}, ''))"
    rows = [(f"regexp_matches({n}, {q(p)})", q(t)) for p, t in L.PIN_TYPE_BY_NAME]
    for any_of, all_of, none_of, t in L.PIN_TYPE_BY_PHRASE:
        conds = [has(d, any_of)] if any_of else []
        conds += [f"contains({d}, {q(w)})" for w in all_of] + [f"NOT contains({d}, {q(w)})" for w in none_of]
        rows.append((" AND ".join(conds), q(t)))
    return chain(rows, "'passive'")


def io(cell) -> str:
    return chain([(f"upper(trim({cell})) = {q(k)}", q(v)) for k, v in L.IO_TYPES.items()], "NULL")


def bare(pn) -> str:
    return f"regexp_replace(regexp_replace(upper(trim({pn})), '-Q\\d+$', ''), '-\\d+\\.?\\d*$', '')"


def suffix(b) -> str:
    return chain([(f"ends_with({b}, {q(s)})", q(s)) for s in L.SUFFIXES], "NULL")


def base(pn) -> str:
    b = bare(pn)
    return chain([(f"ends_with({b}, {q(s)})", f"left({b}, length({b}) - {len(s)})") for s in L.SUFFIXES], b)


def code(pn) -> str:
    return f"regexp_replace({suffix(bare(pn))}, 'R+$', '')"


def role(cell, patterns) -> str:
    """Heading role; the one pattern with a look-ahead is split in two tests."""
    h = f"trim(replace({cell}, chr(10), ' '))"
    tests = []
    for p in patterns:
        if "(?!" in p:
            tests.append(f"(regexp_matches({h}, {q(r'^pin\s+[\w\-./(),\s' + chr(39) + r']+$')}, 'i') AND NOT "
                         f"regexp_matches({h}, '^pin\\s(name|type|desc)', 'i'))")
        else:
            tests.append(f"regexp_matches({h}, {q(p)}, 'i')")
    return "coalesce(" + " OR ".join(tests) + ", false)"


def pin_role(c):
    return role(c, L.HEADER_PIN)


def name_role(c):
    return role(c, L.HEADER_NAME)


def type_role(c):
    return role(c, L.HEADER_TYPE)


def desc_role(c):
    return role(c, L.HEADER_DESC)


def alt_role(c):
    return role(c, L.HEADER_ALT)


def standard(name) -> str:
    return f"regexp_matches(trim({name}), {q(L.STANDARD_PIN_NAME)}, 'i')"


def same_name(a, b) -> str:
    """Name equivalence of two name columns, written out as SQL."""
    def fold(x):
        return f"replace(replace(replace(upper(trim({x})), '–', '-'), '—', '-'), '−', '-')"

    def base_(n):
        return (f"CASE WHEN {n} LIKE '~{{%' AND {n} LIKE '%}}' THEN substr({n}, 3, length({n}) - 3) "
                f"WHEN {n} LIKE '~%' THEN trim(substr({n}, 2), '{{}}') WHEN {n} LIKE '%#' THEN left({n}, length({n}) - 1) ELSE {n} END")

    def marked(n):
        return (f"CASE WHEN {n} LIKE '%#' THEN '~{{' || left({n}, length({n}) - 1) || '}}' WHEN {n} LIKE '~{{%' AND {n} LIKE '%}}' THEN {n} "
                f"WHEN {n} LIKE '/%' THEN '~{{' || substr({n}, 2) || '}}' ELSE {n} END")

    x, y = fold(a), fold(b)
    pairs = []
    for f in (lambda n: n, lambda n: f"trim(regexp_replace({n}, '\\s*\\([^)]*\\)', '', 'g'))", base_):
        for u, v in L.NAME_ALIASES:
            pairs.append((f, u, v))
    alias = " OR ".join(
        "((" + f(x) + "), (" + f(y) + ")) IN (" + ", ".join(
            f"({q(u)}, {q(v)}), ({q(v)}, {q(u)})" for u, v in L.NAME_ALIASES) + ")"
        for f in (lambda n: n, lambda n: f"trim(regexp_replace({n}, '\\s*\\([^)]*\\)', '', 'g'))", base_))
    sub = lambda n: f"regexp_replace({n}, '_\\{{([^}}]+)\\}}', '\\1', 'g')"
    first = lambda n: base_(f"split_part({n}, '/', 1)")
    return (f"({x} = {y} OR ({marked(x)}) = ({marked(y)}) OR ({base_(x)}) = ({base_(y)}) OR ({first(x)}) = ({first(y)}) "
            f"OR ({first(x)}) = ({base_(y)}) OR ({base_(x)}) = ({first(y)}) OR {sub(x)} = {sub(y)} OR {alias})")


def type_name_runs():
    return groupby(L.PIN_TYPE_BY_NAME, key=lambda r: r[1])
