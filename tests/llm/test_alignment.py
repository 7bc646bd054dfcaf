"""Alignment of two tokenizers against whole texts encoded by the libraries."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pinwright.llm import alignment
from pinwright.llm.counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a long, block string, pairs string"


def plain(rows):
    ours = Tokenizer.from_file(A)
    ours.encode_special_tokens = True
    theirs = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(byte_letters())}

    def tokens(text):
        a = [(i, bytes(letters[c] for c in ours.id_to_token(i))) for i in ours.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, theirs.id_to_piece(i)) for i in theirs.encode(text)]
        b = [(i, bytes([int(p[3:5], 16)]) if theirs.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
        return [(x, (" " + text).encode() == b"".join(y for _, y in x)) for x in (a, b)]

    found = []
    for doc_id, text in rows:
        (a, fit_a), (b, fit_b) = tokens(text) if text else (([], False), ([], False))
        spans = []
        for some in (a, b) if fit_a and fit_b else ():
            ends = list(itertools.accumulate(len(y) for _, y in some))
            spans.append([(i, end - len(y), end) for (i, y), end in zip(some, ends)])
        a, b = spans or ([], [])
        links, j = [], 0
        for i, low, high in a:
            while j < len(b) and b[j][2] <= low:
                j += 1
            k = j
            while k < len(b) and b[k][1] < high:
                links.append((i, b[k][0]))
                k += 1
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ["|".join(",".join(str(i) for i, _, e in some if low < e <= high) for some in (a, b))
                  for low, high in zip([0, *cuts], cuts)] if len(a) < 5000 else None
        found.append((doc_id, a, b, links, cuts, groups))
    counts = Counter(x for *_, links, _, _ in found for x in links)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(i, len(a), len(b), len(cuts), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             groups and hashlib.sha256(";".join(groups).encode()).hexdigest() if groups is None or groups else "")
            for i, a, b, links, cuts, groups in found]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("width, block", [(1 << 15, 1 << 24), (300, 5_000), (7, 1 << 24)])
def test_documents(spark, odd_texts, width, block):
    some = odd_texts if width > 7 else [t for t in odd_texts if t is None or len(t) < 3000]
    rows = [*enumerate(some), (None, "no id, some text"), (3, "same id"), (0, "a\n\nb \n c"), (5, "\n a"), (6, " lead and trail ")]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = order(map(tuple, alignment.aligned_documents(docs, A, B, range_bytes=width, block_size=block).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in order(plain(rows))]
    for mine, want in zip(got, order([w for w in plain(rows)])):
        assert mine[:7] == want[:7] and want[7] in (None, mine[7])
    assert len(got) == len(rows)


def test_no_documents(spark):
    assert alignment.aligned_documents(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_fragments_compose_in_any_grouping(odd_texts):
    rng, coder = random.Random(3), alignment.aligner(A, B)
    for text in [t for t in odd_texts if t and "▁" not in t and len(t) < 3000][:150]:
        raw = f" {text}".encode()
        parts = [coder.fragment(raw[s:e].decode(), s, low, high) for low, high, s, e in alignment.ranges(raw, rng.choice([3, 5, 11, 64]))]
        whole = coder.fragment(raw.decode(), 0, 0, len(raw))
        for _ in range(3):
            some = list(parts)
            while len(some) > 1:
                k = rng.randrange(len(some) - 1)
                some[k:k + 2] = [alignment.compose(*some[k:k + 2])]
            assert some == [whole]
        assert alignment.compose(alignment.START, whole).tail_a == ""


def test_ranges_cover_the_text_and_are_encoded_twice_at_most():
    raw = (" " + "z" * 5000 + " word" * 200 + "\n" + "é" * 3000 + " end").encode()
    made = list(alignment.ranges(raw, 64))
    assert [x[0] for x in made] == [0, *(x[1] for x in made[:-1])] and made[-1][1] == len(raw)
    assert sum(e - s for _, _, s, e in made) < 3 * len(raw)
    assert list(alignment.ranges(b" ", 64)) == [(0, 1, 0, 1)]
