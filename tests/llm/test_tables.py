"""Operators over whole tables against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pinwright.llm import chat, components, decontaminate, lines, passages, simhash, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return text.translate(LOW).translate({ord(c): " " for c in SPACE}).split(" ") if text else []


def words(text):
    return [w for w in split(text) if w]


def prose(rng, n, size=2000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


# -- lines --------------------------------------------------------------------

def plain_lines(rows):
    owner = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = x.strip(SPACE).translate(LOW)
            if i is not None and len(k) >= 10:
                owner[k] = min(i, owner.get(k, i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if i is None or owner.get(x.strip(SPACE).translate(LOW), i) == i]
        out.append((i is None, i or 0, "\n".join(keep), len(all_), len(all_) - len(keep)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines(docs, batches):
    rng = random.Random(batches)
    pool = ["A common line of text", "  a COMMON line of text\t", "short", "ééééééééé", "éééééééééé", "", " ",
            "Ünique Line number", "ünique line number"] + [f"line number {k:04d}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for i in rng.sample(range(-50, 400), 60)]
    rows += [(None, "A common line of text\nline number 0001"), (7000, None), (7001, ""), rows[3], rows[3],
             (rows[4][0], "A common line of text\nline number 0002")]
    got = lines.drop_lines(docs(rows).withColumnRenamed("lang", "n_lines"), batches=batches)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == plain_lines(rows)


def test_no_lines(docs):
    assert lines.drop_lines(docs([])).collect() == []


def test_runs_level_up(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        batch = spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("h1"), F.col("id").alias("h2"))
        assert runs.new(batch).count() == 10
        runs.add(batch)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.new(spark.range(45, 55).select(F.col("id").alias("h1"), F.col("id").alias("h2"))).count() == 5


# -- fingerprints ---------------------------------------------------------------

def plain_print(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(items, near):
    """Smallest member reachable, for each of (id, value)."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for (i, x), (j, y) in itertools.combinations(items, 2):
        if near(x, y):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in items}


def test_fingerprints(odd_texts):
    for text in odd_texts:
        assert simhash.fingerprint(text or "") & (1 << 64) - 1 == plain_print(text or "")


def cloud(rng, n):
    """Fingerprints alone, in chains of 4-bit steps, and in a ball around one."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(12):
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            out.append(x)
    x = rng.getrandbits(64)
    for _ in range(80):
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        out.append(y)
    return out + [0, 0, out[0], (1 << 64) - 1]


@pytest.mark.parametrize("cell_limit", [4096, 6, 1])
def test_components(spark, cell_limit):
    rng = random.Random(11)
    prints = list(enumerate(cloud(rng, 300), 1000))
    rng.shuffle(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(i, signed(x)) for i, x in prints] + [(None, signed(prints[0][1]))], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(table, cell_limit=cell_limit).collect()}
    want = plain_components(prints, lambda x, y: (x ^ y).bit_count() <= 4)
    assert got.pop(None) == want[prints[0][0]]
    assert got == want


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a = rng.integers(-2**63, 2**63 - 1, 2000)
    b = a ^ (np.int64(1) << rng.integers(0, 63, 2000)) ^ (np.int64(1) << rng.integers(0, 63, 2000))
    lower = np.bitwise_count(simhash.np_unary(a) ^ simhash.np_unary(b))
    assert (lower <= np.bitwise_count((a ^ b).view(np.uint64))).all()


def test_component_rows(docs):
    rng = random.Random(3)
    base = prose(rng, 400).split()
    near = base.copy()
    near[200] = "other"
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, None), (8, ""), (10, " \n"), (1, prose(rng, 300)), (1, prose(rng, 300))]
    prints = simhash.fingerprints(docs(rows).withColumnRenamed("lang", "fp"))
    assert prints.columns == ["doc_id", "fp"]
    got = {r.doc_id: r.component_id for r in simhash.near_components(prints).collect()}
    assert (got[9], got[8], got[10], got[1]) == (8, 8, 8, 1)
    want = plain_components([(i, plain_print(t or "")) for i, t in rows[:5]], lambda x, y: (x ^ y).bit_count() <= 4)
    assert {i: got[i] for i in want} == want
    assert simhash.near_components(simhash.fingerprints(docs([]))).collect() == []


def test_long_paths_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


# -- decontamination --------------------------------------------------------------

def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def plain_shingles(text, size=5):
    w = plain_words(text)
    return {" ".join(w[i:i + size]) for i in range(len(w) - size + 1)}


def plain_item(text):
    """The size of an item's runs, and the runs."""
    size = min(5, len(plain_words(text)))
    return size, plain_shingles(text, size) if size else set()


def test_items_in_documents(spark, docs):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(1, 70), 300)) for k in range(40)]
    items += [(90, None), (91, "..."), (92, "one two"), (None, prose(rng, 20)), (93, items[0][1])]
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 200), 300).split()
        for _ in range(rng.randint(0, 2)):
            put = (items[rng.randrange(40)][1] or "").split()
            for _ in range(rng.randint(0, 2)):
                put[rng.randrange(len(put))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = put
        rows.append((i, ", ".join(text[:20]) + " " + " ".join(text[20:]).upper()))
    rows += [(300, None), (301, ""), (302, "One -- TWO"), (None, items[1][1]), (5, items[2][1]), (303, " ".join([items[3][1]] * 40))]
    got = decontaminate.find_items(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    have = {}
    for i, t in rows:
        if i is not None:
            for k in range(1, 6):
                have.setdefault((i, k), set()).update(plain_shingles(t, k))
    want = set()
    for k, t in items:
        size, s = plain_item(t)
        for (i, n), d in have.items():
            if n == size and k is not None and s and len(s & d) >= 0.8 * len(s):
                want.add((i, k, len(s), len(s & d)))
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got.collect()} == want
    short = spark.createDataFrame([(1, "beta gamma delta"), (2, "gamma"), (3, "delta beta")], "item_id long, text string")
    short = decontaminate.find_items(docs([(7, "one alpha Beta, gamma; DELTA two three four"), (8, "gamma")]), short)
    assert {(r.doc_id, r.item_id) for r in short.collect()} == {(7, 1), (7, 2), (8, 2)}
    assert decontaminate.find_items(docs([]), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontaminate.find_items(docs(rows), spark.createDataFrame([], "item_id long, text string")).collect() == []


# -- urls ----------------------------------------------------------------------------

URLS = [("https://A.Example.NET/en/x?q=1", "a.example.net", "/en/x", "example.net/en/"),
        ("http://example.net/en", "example.net", "/en", "net/"), ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/"),
        ("http://net", "net", "", None), ("http://net/", "net", "/", "net/"), ("http://x.example.com/de/#a", "x.example.com", "/de/", "example.com/de/"),
        ("http://b.org/fr/a/b", "b.org", "/fr/a/b", "org/fr/"), ("no scheme.net/", "", "", None), (None, "", "", None), ("", "", "", None),
        ("x://y://z.net/", "y:", "//z.net/", None), ("http://\u00c4B.Example.Org?x", "\u00c4b.example.org", "", None),
        ("a\nb://H.net/p\nq#r", "h.net", "/p\nq", "net/"), ("http://example.netx/en/", "example.netx", "/en/", None)]


def test_urls(spark):
    rows = [(i, u, "x") for i, (u, *_) in enumerate(URLS * 2)] + [(None, "http://a.net/", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    for i, (_, host, path, rule) in enumerate(URLS * 2):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert (r.verdict in ("block", "allow")) and (r.block_score is None) == (rule is not None)
        if rule:
            assert r.verdict == {"net/": "block", "example.com/de/": "block"}.get(rule, "allow")
    none = urls.judge_urls(pages.limit(0))
    assert none.collect() == []
    plain = urls.judge_urls(spark.createDataFrame([(1, "http://q.xyz/")], "page_id long, url string")).collect()
    assert [r.verdict for r in plain] == ["allow"]


def test_trees_hold_out(spark):
    """Trained on half of the labelled URLs, the trees tell the other half apart."""
    rng = random.Random(4)
    made = []
    for i in range(1200):
        bad = rng.random() < 0.5
        tail = "/".join(f"{rng.randrange(10**6):06d}" for _ in range(4)) + "?a=1&b=2&c=3" if bad else "news/article"
        made.append((i, f"http://s{rng.randrange(50)}.{'spam' if i % 2 else 'other'}.{'bad' if bad else 'good'}/{tail}"))
    rules = (urls.Rule("spam.bad/", "block"), urls.Rule("spam.good/", "allow"))
    judged = urls.judge_urls(spark.createDataFrame(made, "page_id long, url string"), rules)
    left = [r for r in judged.collect() if r.rule is None]
    right = sum((r.verdict == "block") == r.host.endswith(".bad") for r in left)
    assert len(left) > 500 and right / len(left) > 0.95


# -- chat -----------------------------------------------------------------------------

def test_reply_trees(spark):
    rows = [  # two trees, one of them with a null name
        ("a", 1, None, "user", "hi <b>", 0.0), ("a", 2, 1, "assistant", "one", 1.0), ("a", 3, 1, "assistant", "two [x]", 2.0),
        ("a", 4, 3, "user", "go\\l on", None), ("a", 5, 4, "assistant", None, 0.5), ("a", 6, 2, "user", "dead end", 1.5),
        (None, 1, 77, None, "lost parent", 0.0), ("c", 1, 2, "user", "circle", 1.0), ("c", 2, 1, "user", "circle", 1.0)]
    table = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): r for r in chat.format_branches(table, branches=2)
           .withColumn("turns", chat.read_turns(F.col("formatted")))
           .withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert set(got) == {("a", 5), ("a", 6), (None, 1)}
    assert [tuple(t) for t in got["a", 5].turns] == [("user", "hi <b>"), ("assistant", "two [x]"), ("user", "go\\l on"), ("assistant", "")]
    assert got["a", 5].loss == "two [x]" and got["a", 6].loss == "one"
    assert [tuple(t) for t in got[None, 1].turns] == [("", "lost parent")]
    best = chat.format_branches(table, branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {("a", 5), (None, 1)}  # 2.5 each: the smaller leaf


def test_long_paths(spark):
    rows = [("t", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}", 1.0) for i in range(300)]
    table = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    (row,) = chat.format_branches(table).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert row.loss == "".join(f"m{i}" for i in range(1, 300, 2))


def test_escapes(spark):
    rng = random.Random(6)
    pool = ["\\", "\\\\", "<", "[", "l", "b", "<|end|>", "<|turn|>", "</s>", "[INST]", "\n", "é", "\\l", ""]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    table = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in table.withColumn("u", chat.unescaped(F.col("e"))).collect():
        assert r.u == r.t and "<" not in r.e and "[" not in r.e


def test_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 5, "assistant", None), (None, 2, "assistant", "x"), (2, None, None, "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r.t for r in chat.format_branches(chat.conversation_tree(turns))
           .withColumn("t", chat.read_turns(F.col("formatted"))).collect()}
    assert {k: [tuple(t) for t in v] for k, v in got.items()} == {
        1: [("user", "a"), ("user", "b"), ("assistant", "")], None: [("assistant", "x")], 2: [("", "y")]}
    assert chat.format_branches(chat.conversation_tree(turns.limit(0))).collect() == []


# -- passages ---------------------------------------------------------------------------

def test_windows_stand_for_all_subsequences():
    rng = np.random.default_rng(9)
    tokens = rng.integers(0, 60, 90).astype(np.uint64)
    tokens[70:] = 5  # repeats must not make a deep tree
    rows = passages.compact_windows(tokens, np.array([0, 40, 90]), 8, 1)
    assert (rows[:, 2] - rows[:, 0] >= 8).all()
    for lo, hi in ((0, 40), (40, 90)):
        for a in range(lo, hi):
            for b in range(a + 8, hi + 1):
                assert sum(l <= a <= m < b <= r for l, m, r in rows) == 1


def test_passages(docs):
    rng = random.Random(12)
    passage, copied = prose(rng, 60).split(), prose(rng, 150)
    edited = passage.copy()
    edited[30] = "edited"
    around = lambda p: " ".join([prose(rng, 80), *p, prose(rng, 90)])
    rows = [(4, around(passage)), (2, around(passage)), (7, around(edited)), (9, copied), (30, copied), (31, copied.upper()),
            (50, prose(rng, 500)), (51, around(passage[:40])), (52, None), (53, ""), (None, copied), (54, "w w " * 3000), (2, prose(rng, 100))]
    got = passages.near_duplicate_passages(docs(rows)).collect()
    pairs = {(r.doc_id, r.match_doc_id) for r in got}
    assert {(4, 2), (7, 2), (30, 9), (31, 9)} <= pairs
    assert not {50, 51, 52, 53, 54, None} & {x for p in pairs for x in p}
    texts = {i: (t or "").encode().lower().split() for i, t in rows[:12]}
    for r in got:
        if 2 not in (r.doc_id, r.match_doc_id):
            x, y = texts[r.doc_id][r.start_word:r.end_word], texts[r.match_doc_id][r.match_start:r.match_end]
            x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (x, y))
            assert abs(len(x & y) / len(x | y) - r.similarity) < 1e-12 and r.similarity >= 0.8
    assert passages.near_duplicate_passages(docs([])).collect() == []


def test_every_exact_repeat_is_found(docs):
    rng = random.Random(13)
    shared = [prose(rng, 55) for _ in range(6)]
    rows = []
    for i in range(60):
        text = [prose(rng, rng.randint(10, 120)) for _ in range(3)]
        text[1:1] = rng.sample(shared, rng.randint(0, 2))
        rows.append((i, " ".join(text)))
    seen, want = {}, set()
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k:k + 50]), i)
            if first != i:
                want.add((i, first))
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_duplicate_passages(docs(rows)).collect()}
    match = {i: {i} | {b for a, b in got if a == i} for i, _ in rows}
    assert want and all(match[a] & match[b] for a, b in want)  # in one place's class




def shingled(w):
    return np.array([hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)])


@pytest.mark.parametrize("inserted", [0, 1])
@pytest.mark.parametrize("n", [50, 52, 55, 60])
def test_one_edit_at_any_place(n, inserted):
    """Around any shared token, a passage with one word replaced or inserted is verified."""
    rng = random.Random(n)
    for at in range(n):
        passage = prose(rng, n).split()
        edited = passage[:at] + ["edited"] + passage[at + 1 - inserted:]
        x, y = (set(shingled(w).tolist()) for w in (passage, edited))
        assert len(x & y) >= 0.8 * len(x | y)
        a, b = (shingled(prose(rng, 60).split() + w + prose(rng, 70).split()) for w in (passage, edited))
        for m in range(60, 60 + n - 4):
            for o_m in np.flatnonzero(b == a[m]):
                (got,) = passages.verified(a, b, [m], int(m - o_m), passages.PassageRule())
                assert got[1] - got[0] >= 46 and got[4] >= 0.8 and got[0] <= m < got[1]


def test_repeats_whose_lines_occur_before(docs):
    """A passage of two long lines that each stand alone in smaller documents, at odd k in the smallest of them all."""
    rng = random.Random(21)
    text = lambda n: prose(rng, n, 10**6)
    rows, want = [], set()
    for k in range(20):
        lines_ = [text(30), text(30)]
        alone = [" ".join([text(60), x, text(60)]) for x in lines_ for _ in range(8)]
        again = [" ".join([text(70), *lines_, text(70)]) for _ in range(2)]
        if k % 2:
            alone = [" ".join([*alone, again.pop()])]
        rows += [(1000 * k + j, t) for j, t in enumerate(alone + again)]
        want.add((1000 * k + len(alone + again) - 1, 1000 * k + len(alone + again) - 2))
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_duplicate_passages(docs(rows)).collect()}
    assert want <= got, len(want - got)


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d", "a b c d e", "  "])
def test_passages_of_a_few_words(docs, text):
    for rows in ([(1, text)], [(1, text), (2, text), (3, None)]):
        assert passages.near_duplicate_passages(docs(rows)).collect() == []


def test_edited_copies_whose_lines_occur_before(docs):
    """Passages of three stock lines with one word replaced anywhere: each line stands alone in many smaller documents."""
    rng = random.Random(22)
    text = lambda n: prose(rng, n, 10**6)
    rows, pairs = [], []
    for k in range(40):
        lines_ = [text(20) for _ in range(3)]
        rows += [(1000 * k + j, " ".join([text(50), lines_[j % 3], text(50)])) for j in range(9)]
        words_ = " ".join(lines_).split()
        edited = words_.copy()
        edited[rng.randrange(60)] = text(1)
        rows += [(1000 * k + 100 + j, " ".join([text(70), *w, text(70)])) for j, w in enumerate((words_, edited))]
        pairs.append((1000 * k + 101, 1000 * k + 100))
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_duplicate_passages(docs(rows)).collect()}
    found = sum(p in got for p in pairs)
    assert found >= 0.9 * len(pairs), found


def test_rules_on_every_page(spark):
    """Host, path and rule of all given pages by plain string work."""
    import pyarrow.dataset as ds

    table = ds.dataset("/root/testdata/sf0.001/pages.parquet").to_table(columns=["page_id", "url"]).to_pylist()
    want = {}
    for row in table:
        _, mark, rest = (row["url"] or "").partition("://")
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = (rest[:end].translate(LOW), rest[end:]) if mark else ("", "")
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        want[row["page_id"]] = host, path, rule and rule.text, rule and rule.verdict
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(
        "page_id", "url", F.lit(1).alias("_features"), F.lit(2).alias("_probability"), F.lit("x").alias("n"))
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(got) == len(want) and any(w[2] for w in want.values())
    for i, (host, path, rule, verdict) in want.items():
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict)


def test_candidates_that_share_too_little_are_not_searched(monkeypatch):
    """A few shared shingles, in step or apart, cannot make a passage of fifty words: no stretch is looked for."""
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 1 << 62, 200), draw.integers(0, 1 << 62, 180)
    b[60:72] = a[70:82]
    b[100:106] = a[150:156]

    def searched(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(passages.Agreement, "around", searched)
    assert passages.verified(a, b, [72, 78], 10, passages.PassageRule()) == []


def test_repeats_of_later_documents_are_found_whatever_smaller_ones_hold(docs):
    """Each token of a passage stands with its context in a smaller document, too; a word is replaced in each copy, so no 50 words are repeated."""
    rng = random.Random(31)
    text = lambda n: prose(rng, n, 10**6)
    rows, want = [], set()
    for k in range(30):
        words_ = text(72).split()
        rows += [(1000 * k + j, " ".join([text(50), *words_[at:at + 40], text(50)])) for j, at in enumerate((0, 16, 32))]
        copies = [words_, *(words_[:at] + [text(1)] + words_[at + 1:] for at in (33, 36, 39))]
        rows += [(1000 * k + 100 + j, " ".join([text(70), *w, text(70)])) for j, w in enumerate(copies)]
        want |= {(1000 * k + 100 + j, 1000 * k + 100) for j in (1, 2, 3)}
    got = {(r.doc_id, r.match_doc_id) for r in passages.near_duplicate_passages(docs(rows)).collect()}
    assert len(want & got) >= 0.95 * len(want), len(want - got)


def test_every_pair_of_a_key_meets(spark, monkeypatch):
    monkeypatch.setattr(passages, "MEET_ROWS", 3)
    rows = [(1, d, 0, m, 0, 50) for d in range(12) for m in (5, 9)] + [(2, 3, 0, 5, 0, 50), (2, 3, 0, 9, 0, 50)]
    met = passages.meetings(spark.createDataFrame(rows, "key long, doc_id long, f int, m int, l int, r int"), "groups").collect()
    assert sorted((r.doc_id, r.m, r.o_id, r.o_m) for r in met) == sorted(
        (a, x, b, y) for a in range(12) for b in range(a) for x in (5, 9) for y in (5, 9))
