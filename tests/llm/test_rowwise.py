"""Row-wise operators against the libraries and against plain Python."""

import hashlib
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pinwright.llm import counts, pieces, quality, records

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def piece_model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(BPE)


def test_pieces_equal_the_library(odd_texts, piece_model):
    coder = pieces.codec(PIECES)
    for text in odd_texts:
        ids = piece_model.encode(text or "")
        assert coder.encode(text or "").tolist() == ids
        assert coder.decode(ids) == piece_model.decode(ids)


def test_pieces_uncut_equal_the_library(odd_texts, piece_model):
    coder = pieces.codec(PIECES)
    for text in odd_texts[10:120]:
        whole = "▁" + text.replace(" ", "▁") if text else ""
        assert coder._ids(whole) == piece_model.encode(text)


def test_decode_of_any_ids_equals_the_library(piece_model):
    coder, rng = pieces.codec(PIECES), np.random.default_rng(3)
    for _ in range(1500):
        ids = rng.integers(0, 420, rng.integers(0, 9)).tolist()
        assert coder.decode(ids) == piece_model.decode(ids)


def test_piece_rows(docs, odd_texts, piece_model):
    rows = list(enumerate(odd_texts)) + [(None, "no id"), (1, "twice"), (1, "twice")]
    both = pieces.decode_pieces(pieces.encode_pieces(docs(rows), PIECES), PIECES, carry=("doc_id", "ids"))
    def read(df):
        return sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.decoded_sha256, r.n_tokens)
                      for r in pieces.digests(df).collect())

    got = read(both)
    assert read(pieces.round_trip(docs(rows), PIECES)) == got
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(i, piece_model.encode(t or "")) for i, t in rows]
    want = sorted((i is None, i or 0, sha(",".join(map(str, x))), sha(piece_model.decode(x)), len(x)) for i, x in ids)
    assert got == want


def test_counts_equal_the_library(odd_texts, bpe):
    for text in odd_texts:
        assert counts.counter(BPE).count(text or "") == len(bpe.encode(text or "", add_special_tokens=False).ids)


def test_count_rows(docs, odd_texts, bpe):
    table = docs(enumerate(odd_texts)).withColumnRenamed("lang", "n_tokens")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(table, BPE).collect()}
    for i, text in enumerate(odd_texts):
        n = len(bpe.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 1024)
    assert counts.count_tokens(docs([]), BPE).collect() == []


def plain_quality(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    hit = {i + k for starts in windows.values() if len(starts) > 1 for i in starts for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))


def test_quality_counts(docs, odd_texts):
    more = [*odd_texts, "a b c d e f g h a b c d e f g h x", " # one\n # one\n|two|\n\n|two|", "A b\x0bc\x0cd"]
    got = {r.doc_id: r for r in quality.quality_rules(docs(enumerate(more))).collect()}
    for i, text in enumerate(more):
        row, want = got[i], plain_quality(text or "")
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (row.base_failed and row.kept)


def test_bands_reject_what_repeats_or_is_random(docs):
    rng = np.random.default_rng(1)
    syllables = ["tion", "er", "an", "the", "re", "st", "ou", "in", "ly", "wh", "ea", "ing"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    prose = [" ".join(word() for _ in range(n)) for n in (30, 100, 400, 1500, 6000)]
    noise = " ".join("".join(map(chr, rng.integers(33, 0x3000, 12))) for _ in range(500))
    lines = "\n".join(f"row {i} of the very same table with the very same words in it" for i in range(900))
    half = prose[4] + " " + noise * 9
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs(enumerate([*prose, noise, lines, half]))).collect()}
    assert [got[i] for i in range(8)] == [True] * 5 + [False] * 3


def test_records_round_trip(spark, docs, odd_texts, bpe, tmp_path):
    folder = f"file://{tmp_path}/records"
    rows = [(3 * i, t) for i, t in enumerate(odd_texts)] + [(None, "none"), (9, "again"), (9, "again")]
    manifest = records.write_records(docs(rows), BPE, folder)
    got = sorted(records.read_records(manifest, folder).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    assert got[0].doc_id is None and got[0].start == 0
    start, ids_of = 0, {}
    for i, t in rows:
        ids_of.setdefault(i, []).append(bpe.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids))
        ids_of[r.doc_id].remove(list(r.ids))
        start += r.n_tokens
    assert not any(ids_of.values())
    shuffled = records.read_shuffled(manifest, folder, 7).collect()
    assert sorted(map(repr, shuffled)) == sorted(repr(r) for r in spark.createDataFrame(
        [(r.doc_id, r.ids) for r in got], "doc_id long, ids array<long>").collect())
    assert [r.doc_id for r in shuffled] != [r.doc_id for r in got]


def test_a_damaged_record_is_noticed(tmp_path):
    raw = bytearray(records.frame(b"payload"))
    (tmp_path / "x").write_bytes(raw)
    with open(tmp_path / "x", "rb") as f:
        assert records.unframe(f) == b"payload" and records.unframe(f) is None
    raw[14] ^= 1
    (tmp_path / "x").write_bytes(raw)
    with open(tmp_path / "x", "rb") as f, pytest.raises(records.DamagedRecord):
        records.unframe(f)
    (tmp_path / "x").write_bytes(raw[:9])
    with open(tmp_path / "x", "rb") as f, pytest.raises(records.DamagedRecord):
        records.unframe(f)


def test_no_documents_no_records(docs, tmp_path):
    manifest = records.write_records(docs([]), BPE, f"file://{tmp_path}/none")
    assert records.read_records(manifest, f"file://{tmp_path}/none").collect() == []


def test_many_bytes_without_a_character():
    from pinwright.llm import pieces

    assert pieces.utf8(b"\x80" * 5000) == "\ufffd" * 5000
    assert pieces.utf8(b"a\xc3\xc3\xa9\xf0\x9f\x98") == "a\ufffd\u00e9\ufffd\ufffd\ufffd"
