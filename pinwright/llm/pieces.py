"""Sentence-piece encoding and decoding of merge-type (BPE) models, by backtracking.

A sequence of pieces is the merge encoding of its text exactly if every adjacent
pair is the merge encoding of the two pieces' joined text: were some merge in the
whole text the first to cross a border between two pieces, then it would cross in
their joined text as well, for there the same merges run in the same order. So the
encoder walks through the text with the longest pieces that an Aho-Corasick
automaton found, keeps a piece only if re-merging it with its neighbour gives both
back, falls back to the next shorter one, and remembers in a bit field the
positions from which nothing fitted: the pieces before a position are unique, so
a failed position has failed for good.

Texts are cut at spaces and line breaks first where no piece of the model crosses
one, and what a cut gives is kept in a bounded memo per worker.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pinwright.llm.frames import Memo, annotate, texts

SPACE = "▁"
NEVER = float("-inf")
REPLACED = "�"


class PieceCodec:
    """Encoder and decoder for one model file with identity normalisation."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        probe = "ﬁ Á  b\t　c "
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("only models that leave the text as it is are supported")
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes_at = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes_at) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.shown = [" ⁇ " if sp.is_unknown(i) else "" if sp.is_control(i)
                      else p.replace(SPACE, " ") for i, p in enumerate(pieces)]
        self.silent = {i for i in range(size) if sp.is_control(i)}
        self.spaced = {i for i, p in enumerate(pieces) if p.startswith(SPACE)}
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.cut = all(SPACE not in p.lstrip(SPACE) and ("\n" not in p or p == "\n")
                       for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, (len(p) - 1, 1 << len(p)))
        self.automaton.make_automaton()
        self.fits = Memo(self._fits, limit=200_000, longest=2)
        self.words = Memo(self._word)

    def remerge(self, text: str) -> list[str]:
        """The merge rule itself: best score first, leftmost first among equals."""
        symbols, score = list(text), self.scores.get
        # Score of each symbol joined with the next one; index() finds the leftmost best.
        joined = [score(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while joined:
            best = max(joined)
            if best == NEVER:
                break
            at = joined.index(best)
            symbols[at] += symbols.pop(at + 1)
            del joined[at]
            if at < len(joined):
                joined[at] = score(symbols[at] + symbols[at + 1], NEVER)
            if at:
                joined[at - 1] = score(symbols[at - 1] + symbols[at], NEVER)
        return symbols

    def _fits(self, pair: tuple[str, str]) -> bool:
        return self.remerge(pair[0] + pair[1]) == [p for p in pair if p]

    def split(self, text: str) -> list[str]:
        """The pieces of one stretch of normalised text."""
        size, fits = len(text), self.fits
        # Bit n of a position: a piece of n characters begins there. A single character
        # that is no piece stands for itself.
        found = [2] * size
        for end, (before, bit) in self.automaton.iter(text):
            found[end - before] |= bit
        out: list[str] = []
        untried: list[int] = []
        failed, pos, left, last = 0, 0, found[0] if size else 0, ""
        while pos < size:
            while left:
                length = left.bit_length() - 1
                left ^= 1 << length
                end = pos + length
                if not failed >> end & 1:
                    piece = text[pos:end]
                    if fits[last, piece]:
                        break
            else:
                failed |= 1 << pos
                pos -= len(out.pop())
                left = untried.pop()
                last = out[-1] if out else ""
                continue
            out.append(piece)
            untried.append(left)
            last, pos = piece, end
            left = found[pos] if pos < size else 0
        return out

    def _ids(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.split(text):
            found = self.ids.get(piece)
            if found is not None:
                ids.append(found)
            elif self.byte_of:
                ids += [self.bytes_at[b] for b in piece.encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def _word(self, word: str) -> bytes:
        # A word that begins with a line break had no space before it.
        return array("i", self._ids(word if word[:1] == "\n" else SPACE + word)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text, without begin and end ids."""
        if not text:
            return np.empty(0, np.int32)
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.cut and "  " not in text and text[0] != " " and text[-1] != " ":
            cuts = text.replace("\n", " \n").split(" ")
            if cuts[0] or len(cuts) == 1:
                return np.frombuffer(b"".join(map(self.words.__getitem__, cuts)), np.int32)
        whole = SPACE + text.replace(" ", SPACE)
        cuts = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", whole) if self.cut else [whole]
        return np.array([i for c in cuts for i in self._ids(c)], np.int32)

    def decode(self, ids) -> str:
        """The text of ids; bytes that make no character become U+FFFD each."""
        ids = np.asarray(ids, np.int64)
        parts: list[str] = []
        if not self.is_byte[ids].any():
            parts = list(map(self.shown.__getitem__, ids.tolist()))
        else:
            run = bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(utf8(bytes(run)))
                    run.clear()
                parts.append(self.shown[i])
            parts.append(utf8(bytes(run)))
        whole = "".join(parts)
        first = next((i for i in ids.tolist() if i not in self.silent), -1)
        return whole[1:] if first in self.spaced else whole


def utf8(raw: bytes) -> str:
    """Decode, with one U+FFFD for each byte that belongs to no character."""
    parts, at = [], 0
    while True:
        try:
            return "".join((*parts, raw[at:].decode()))
        except UnicodeDecodeError as fault:
            end = at + fault.start
            parts += (raw[at:end].decode(), REPLACED)
            at = end + 1


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    return PieceCodec(model)


def flat(arrays: list[np.ndarray], kind=np.int32) -> pa.Array:
    """A list array of many small arrays without going through Python numbers."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    values = np.concatenate([*arrays, np.empty(0, kind)]).astype(kind, copy=False)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def encode_pieces(docs: DataFrame, model: str, text: str = "text",
                  carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``ids`` (array of int): the pieces of each whole text.

    One row per input row, repeated rows included; a null or empty text has no ids.
    ``model`` is read by every worker, so it lies on a path that all have.
    """
    return annotate(docs, lambda column: [flat([codec(model).encode(t) for t in texts(column)])],
                    [T.StructField("ids", T.ArrayType(T.IntegerType(), False))], carry, text)


def decode_pieces(encoded: DataFrame, model: str, ids: str = "ids",
                  carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``decoded``: the text of the ids; null or no ids give an empty text.

    The rule is the library's: one space before the first piece is not part of the
    text, and the space mark is a space, so a text holding the mark itself comes
    back with spaces in its place.
    """
    carried = [c for c in carry if c != "decoded"]
    source = encoded.select(*carried, *([] if ids in carried else [ids]))
    at, places = source.columns.index(ids), [source.columns.index(c) for c in carried]
    schema = T.StructType([*(source.schema[c] for c in carried), T.StructField("decoded", T.StringType())])

    arrow = to_arrow_schema(schema)

    def run(batches):
        coder = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                column = part.column(at)
                values = column.values.to_numpy(zero_copy_only=False)
                ends = column.offsets.to_numpy()
                out = [coder.decode(values[a:b]) for a, b in zip(ends, ends[1:])]
                made = [*(part.column(i) for i in places), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``ids`` and ``decoded`` in one pass: encode_pieces, then decode_pieces on what it gave."""
    def both(column: pa.Array) -> list[pa.Array]:
        coder = codec(model)
        ids = [coder.encode(t) for t in texts(column)]
        return [flat(ids), pa.array([coder.decode(i) for i in ids], pa.string())]

    return annotate(docs, both, [T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                                 T.StructField("decoded", T.StringType())], carry, text)


def op1_sentencepiece_round_trip(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")))


def digests(both: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return both.select(
        *keys, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
