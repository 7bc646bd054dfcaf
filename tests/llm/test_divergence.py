"""Divergence of sources against a plain count over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pinwright.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string"


def plain(rows, least_docs=3, top=200):
    groups, langs, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOW))
        groups[lang, source].update(terms)
        langs[lang].update(terms)
        held[lang].update(set(terms))
    out = []
    for (lang, source), mine in groups.items():
        kept = [t for t, k in held[lang].items() if k >= least_docs]

        def shares(counts):
            under = sum(counts[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // under for t in kept}

        p, q = shares(mine), shares(langs[lang])
        pairs = [(other, sum((p[t] - r[t]) ** 2 // r[t] for t in kept))
                 for (g, other), counts in groups.items() if g == lang and other != source for r in [shares(counts)]]
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if mine[t] and p[t] > q[t]]
        for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(found[:limit])]
    return sorted(out)


def made(spark, rows, **more):
    docs = spark.createDataFrame([(i, *r, 7, "x") for i, r in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, divergence.source_divergence(docs, **more).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence(spark, seed, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_TERMS", 16)  # several slices and blocks of sources
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    monkeypatch.setattr(divergence, "HELD", 40)
    rng = random.Random(seed)
    pool = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["ÉTÉ", "été", "日本", "Z", "z"]

    def text():
        n = rng.choice([0, 3, 40, 400])
        return rng.choice([" ", "\n", "_1", "\x00", "[]"]).join(pool[min(int(rng.expovariate(0.05)), len(pool) - 1)] for _ in range(n))

    rows = [(text(), rng.choice(["en", "de"]), f"s{rng.randrange(5)}") for _ in range(120)]
    rows += [(None, "en", "s9"), ("", "fr", None), ("only once", "fr", ""), ("a b", None, None), ("a b", None, None),
             ("a b c", None, "s1"), *rows[:10], ("same Word " * 30_000, "en", "s0")]
    want = plain(rows)
    assert made(spark, rows) == want
    assert any(r[2] == "pair" and r[4] == 0 for r in want) and any(r[2] == "term" for r in want)


def test_few_ranks_and_ties(spark):
    rows = [(" ".join(f"t{chr(97 + k)}" for k in range(20)), "en", s) for s in ("a", "a", "b", "b")] + [("ta tb", "en", "a")]
    assert made(spark, rows, top=1, least_docs=2) == plain(rows, 2, 1)


def test_no_documents(spark):
    assert made(spark, []) == []


def test_no_kept_terms(spark):
    got = made(spark, [("one", "en", "a"), ("two", "en", "b"), (None, "en", "c")])
    assert [(r[1], r[3], r[4]) for r in got] == [(x, y, 0) for x in "abc" for y in "abc" if x != y]
