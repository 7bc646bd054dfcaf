"""Two tokenizers over the same bytes: aligned groups, and links counted over the whole corpus.

Tokens of A and of B that end at the same byte close a group; two tokens are linked if
their byte ranges overlap. Most texts are cut before single spaces and line breaks, where both
tokenizers begin anew, and what a cut gives is kept in a bounded memo per worker.

A very long text is dealt out over tasks in byte ranges. A range is encoded with the
context that reaches out to the next such cuts, and keeps the tokens that end in it. It becomes a fragment:
an open prefix up to its first common end, closed groups, and an open suffix after its
last one; or a prefix alone where no group ends in the range. Fragments form a monoid: ``compose`` is
associative, so a tree of Spark aggregations puts a text together in any grouping.

Link counts never travel as one table. Texts are held in blocks; a block sends each of
its different links once, with its count, and gets the corpus-wide count back.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pinwright.llm.counts import RUN, WHITE, byte_letters, cut_words
from pinwright.llm.frames import quoted, slices, texts
from pinwright.sources.shared import staged

#: Bytes of a range; longer texts are dealt out. Characters of a block, and fragments composed at a time.
RANGE_BYTES, BLOCK_SIZE, FAN = 1 << 16, 1 << 23, 8
#: Cuts that a worker remembers; as many older ones go when these are full.
KNOWN = 150_000
_SAFE = re.compile(f"(?<=[^{WHITE}])(?=[ \n][^{WHITE}])")
#: The same cuts in bytes, only next to characters that are surely no white space.
_SAFE_BYTES = re.compile(rb"(?:(?<=[\x21-\x7e])|(?<=[\xc3-\xdf][\x80-\xbf]))(?=[ \n][\x21-\x7e\xc3-\xdf\xe4-\xf4])")
_WHITE = re.compile(f"[{WHITE}]")


class Fragment(NamedTuple):
    """Ids as decimal lists: ``head`` is open to the left, ``tail`` to the right; without a common end (``cut``) all is head."""

    ok: bool
    cut: bool
    head_a: str
    head_b: str
    closed: str
    tail_a: str
    tail_b: str


#: The begin of a text, where both tokenizers have a common end.
START = Fragment(True, True, "", "", "", "", "")


def _list(x: str, y: str, mark: str = ",") -> str:
    return f"{x}{mark}{y}" if x and y else x or y


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two that follow each other; associative."""
    ok = x.ok and y.ok
    if not x.cut:
        return Fragment(ok, y.cut, _list(x.head_a, y.head_a), _list(x.head_b, y.head_b), *y[4:])
    seam = _list(x.tail_a, y.head_a), _list(x.tail_b, y.head_b)
    if not y.cut:
        return Fragment(ok, True, x.head_a, x.head_b, x.closed, *seam)
    group = "|".join(seam) if any(seam) else ""
    return Fragment(ok, True, x.head_a, x.head_b, _list(_list(x.closed, group, ";"), y.closed, ";"), y.tail_a, y.tail_b)


class Unit(NamedTuple):
    """Groups of a stretch as text, the tokens and groups in it, and its links as packed pairs of ids."""

    groups: str
    n_a: int
    n_b: int
    n_groups: int
    links: bytes


class Aligner:
    def __init__(self, vocabulary: str, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokens = Tokenizer.from_file(vocabulary)
        self.tokens.encode_special_tokens = True
        self.pieces = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        entries = self.tokens.get_vocab(with_added_tokens=False)
        self.a_bytes = dict.fromkeys(range(self.tokens.get_vocab_size()), b"")
        self.a_bytes.update((i, bytes(map(byte_of.__getitem__, x))) for x, i in entries.items() if all(c in byte_of for c in x))
        shown = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in shown):
            raise ValueError("only models whose pieces end before a space or line break are supported")
        self.b_bytes = {i: bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(shown)}
        self.a_size, self.b_size = (np.array([len(x[i]) for i in range(len(x))], np.int64) for x in (self.a_bytes, self.b_bytes))
        numbers = range(max(len(self.a_size), len(self.b_size)))
        self.shown = np.array([[f"{i}{mark}" for i in numbers] for mark in ",|;"], object)
        self.known: dict[str, Unit | None] = {}
        self.older: dict[str, Unit | None] = {}

    def encode(self, stretches: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B, the ids of all stretches, and where those of each begin (and the end).

        A stretch begins with a space, which for B is the one it puts in front, or with a line break. Where no
        white space meets white space, A begins anew with each stretch, so that it can have many as one text.
        """
        joined = "".join(stretches)
        if RUN.search(joined):
            a = [x.ids for x in self.tokens.encode_batch_fast(stretches, add_special_tokens=False)]
            ours = _flat(a)
        else:
            some = ["".join(stretches[at:at + 1024]) for at in range(0, len(stretches), 1024)]
            ids, _ = _flat([x.ids for x in self.tokens.encode_batch_fast(some, add_special_tokens=False)])
            ends = np.cumsum([0, *(len(s.encode()) for s in stretches)])
            ours = ids, np.searchsorted(np.cumsum(self.a_size[ids]), ends, "right")
        b = self.pieces.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        return [ours, _flat([x if s[0] == " " else x[1:] for s, x in zip(stretches, b)])]

    def same(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == raw == b"".join(map(self.b_bytes.__getitem__, b.tolist()))

    def units(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[Unit]:
        """Units of stretches, all at once; both sides of each have the same bytes.

        The bytes between two neighbouring ends, of either side, belong to one token of each: a link.
        A group ends where an end of both does.
        """
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.union1d(a_end, b_end)
        links = a[np.searchsorted(a_end, ends)] << 32 | b[np.searchsorted(b_end, ends)]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        done = a_end[n_a[1:] - 1]  # of the stretches
        n_links, n_groups = (np.concatenate([[0], np.searchsorted(x, done, "right")]) for x in (ends, both))
        # All tokens in the order of the text form: by group, A before B. A mark follows each.
        group = np.concatenate([np.searchsorted(both, a_end), np.searchsorted(both, b_end)])
        order = np.argsort(group, kind="stable")
        side = order >= len(a)
        last = np.diff(np.append(group[order] * 2 + side, -1)) != 0
        shown = self.shown[np.where(last, np.where(side, 2, 1), 0), np.concatenate([a, b])[order]].tolist()
        at, raw = (n_a + n_b).tolist(), links.tobytes()
        return [Unit("".join(shown[x:y])[:-1], *n, raw[k * 8:m * 8]) for x, y, n, k, m in
                zip(at, at[1:], zip(*(np.diff(x).tolist() for x in (n_a, n_b, n_groups))), n_links.tolist(), n_links[1:].tolist())]

    def made(self, stretches: list[str]) -> list[Unit | None]:
        """Units of stretches; None where the bytes differ."""
        if not stretches:
            return []
        (a, n_a), (b, n_b) = self.encode(stretches)
        if self.same("".join(stretches).encode(), a, b):
            return self.units(a, n_a, b, n_b)
        if len(stretches) == 1:
            return [None]
        half = len(stretches) // 2
        return self.made(stretches[:half]) + self.made(stretches[half:])

    def words(self, keys: list[str]) -> dict[str, Unit | None]:
        """Units of stretches whose leading space, if they have one, is left out; None where the bytes differ."""
        found = {k: self.known[k] if k in self.known else self.older[k] for k in keys if k in self.known or k in self.older}
        lack = [k for k in keys if k not in found]
        found.update(zip(lack, self.made([stretch_of(k) for k in lack])))
        if len(self.known) + len(found) > KNOWN:
            self.known, self.older = {}, self.known
        self.known.update((k, u) for k, u in found.items() if len(k) <= 48)
        return found

    def groups(self, keys: list[str]) -> dict[str, Unit]:
        """Units of single groups."""
        sides = zip(*((list(map(int, x.split(","))) for x in k.split("|")) for k in keys))
        return dict(zip(keys, self.units(*chain.from_iterable(map(_flat, sides))))) if keys else {}

    def fragment(self, stretch: str, base: int, low: int, high: int) -> Fragment:
        """The fragment of the tokens that end in (low, high]; the stretch begins at byte ``base``.

        Cuts well inside the range are whole groups; only those at its borders are looked at by token.
        """
        keys = cut_text(stretch[1:]) if stretch[0] == " " else [stretch]
        whole, at = START._replace(cut=False), base
        units, parts = self.words(list(dict.fromkeys(keys))), []
        for k in keys:
            begin, at = at, at + len(stretch_of(k).encode())
            if units[k] is None:
                return START._replace(ok=False)
            if begin >= low and at <= high and begin > base:
                parts.append(units[k].groups)
            elif at > low and begin < high:
                whole = compose(self._closed(whole, parts), self._at_border(stretch_of(k), begin, low, high))
                parts = []
        return self._closed(whole, parts)

    @staticmethod
    def _closed(before: Fragment, groups: list[str]) -> Fragment:
        """``before`` and whole groups: the first one ends its open suffix, or is its open prefix."""
        if not groups:
            return before
        first, _, rest = ";".join(groups).partition(";")
        return compose(before, Fragment(True, True, *first.split("|"), rest, "", ""))

    def _at_border(self, stretch: str, base: int, low: int, high: int) -> Fragment:
        (a, _), (b, _) = self.encode([stretch])
        a_end, b_end = base + np.cumsum(self.a_size[a]), base + np.cumsum(self.b_size[b])
        inside = (a_end > low) & (a_end <= high), (b_end > low) & (b_end <= high)
        a, a_end, b, b_end = a[inside[0]], a_end[inside[0]], b[inside[1]], b_end[inside[1]]
        ends = np.intersect1d(a_end, b_end)
        parts = [[",".join(map(str, p.tolist())) for p in np.split(x, np.searchsorted(end, ends, "right"))]
                 for x, end in ((a, a_end), (b, b_end))]
        groups, cut = list(map("|".join, zip(*parts))), len(ends) > 0
        return Fragment(True, cut, parts[0][0], parts[1][0], ";".join(groups[1:-1]), *((p[-1] if cut else "") for p in parts))


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of many lists in a row, and where those of each begin (and the end)."""
    lists = list(lists)
    return np.fromiter(chain.from_iterable(lists), np.int64), np.cumsum([0, *map(len, lists)])


@lru_cache(maxsize=2)
def aligner(vocabulary: str, model: str) -> Aligner:
    return Aligner(vocabulary, model)


def stretch_of(key: str) -> str:
    """The stretch of a key: a space stands in front of it, unless it begins with a line break.

    A line break and a space stand for a stretch that has both (the first one of a text that begins with a line break).
    """
    return " " + key[2:] if key[:2] == "\n " else key if key[:1] == "\n" else " " + key


def cut_text(text: str) -> list[str]:
    """The keys of a text's stretches; the first one stands behind the space that the text itself lacks."""
    cuts = None if _WHITE.match(text) or _WHITE.match(text[-1]) else cut_words(text, ())
    if cuts is not None:
        return cuts
    first, *rest = _SAFE.split(text)
    return ["\n " * (first[0] == "\n") + first, *(s[1:] if s[0] == " " else s for s in rest)]


def ranges(raw: bytes, width: int = RANGE_BYTES) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, begin, end): byte ranges and their context out to the next safe cuts.

    Borders are multiples of ``width``, whatever stands there. One that has no safe cut between itself and
    the border before it is left out, so a stretch without cuts is encoded twice at most.
    """
    borders, at = [(0, 0, 0)], width
    while at < len(raw):
        before, _, end = borders[-1]
        reach, last = 256, None
        while last is None:
            begin = max(before, at - reach)
            last = max((m.start() for m in _SAFE_BYTES.finditer(raw, begin, at + 2) if before < m.start() <= at), default=None)
            if begin == before:
                break
            reach *= 2
        if last is None and before:
            at = max(at + 1, end + 1)
            at += -at % width
            continue
        found = _SAFE_BYTES.search(raw, at)
        borders.append((at, last or 0, found.start() if found else len(raw)))
        at += width
    borders.append((len(raw), len(raw), len(raw)))
    for (low, begin, _), (high, _, end) in zip(borders, borders[1:]):
        yield low, high, begin, end


RANGED = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "doc_id", "idx", "base", "low", "high")]
                      + [T.StructField("stretch", T.StringType())])


def range_rows(docs: DataFrame, width: int) -> DataFrame:
    """One row per byte range of each text, with its context."""
    arrow = to_arrow_schema(RANGED)

    def run(batches):
        for batch in batches:
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = f" {text}".encode()
                for idx, (low, high, begin, end) in enumerate(ranges(raw, width)):
                    row = key, doc_id, idx, begin, low, high, raw[begin:end].decode()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, arrow)], schema=arrow)

    return docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "_text").mapInArrow(run, RANGED)


_PLAIN = [T.StructField(c, T.BooleanType()) for c in Fragment._fields[:2]] + [T.StructField(c, T.StringType()) for c in Fragment._fields[2:]]
FRAGMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "doc_id", "idx")] + _PLAIN)


def fragments(rows: DataFrame, vocabulary: str, model: str) -> DataFrame:
    arrow = to_arrow_schema(FRAGMENT)

    def run(batches):
        coder = aligner(vocabulary, model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64).to_pylist()
                made = [(r["key"], r["doc_id"], r["idx"], *coder.fragment(r["stretch"], r["base"], r["low"], r["high"])) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), arrow)], schema=arrow)

    return rows.mapInArrow(run, FRAGMENT)


def composed(rows: DataFrame, deepest: int) -> DataFrame:
    """One fragment per key: FAN neighbours at a time are composed until one is left."""
    arrow = to_arrow_schema(FRAGMENT)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                whole, *rest = (Fragment(*(f[c] for c in Fragment._fields)) for f in row["parts"])
                for f in rest:
                    whole = compose(whole, f)
                made = row["key"], row["doc_id"], row["idx"], *whole
                yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(made, arrow)], schema=arrow)

    while deepest > 0:
        parts = F.sort_array(F.collect_list(F.struct("idx", *Fragment._fields))).alias("parts")
        rows = (rows.groupBy("key", "doc_id", F.expr(f"idx div {FAN}").alias("up")).agg(parts)
                .withColumnRenamed("up", "idx").mapInArrow(run, FRAGMENT))
        deepest //= FAN
    return rows


HELD = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", T.LongType())]
                    + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")] + [T.StructField("groups_sha256", T.StringType())]
                    + [T.StructField("units", T.ArrayType(T.IntegerType())), T.StructField("pairs", T.ArrayType(T.LongType())),
                       T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("starts", T.ArrayType(T.IntegerType())),
                       T.StructField("links", T.ArrayType(T.IntegerType()))])


class Block:
    """Texts held together: their units by number, and at the end the links of all units."""

    def __init__(self, name: int):
        self.name, self.size = name, 0
        self.at: dict[str, int] = {}
        self.shown: list[str] = []
        self.links: list[bytes] = []
        self.stats = np.zeros((0, 4), np.int64)  # tokens of A and B, groups; -1 where the bytes differ
        self.seen = np.zeros(0, np.int64)

    def rows(self, docs: list[tuple], resolve) -> pa.RecordBatch:
        """Rows of (doc_id, keys); keys are None for a text without tokens."""
        lack = list(dict.fromkeys(k for k in chain.from_iterable(keys or () for _, keys in docs) if k not in self.at))
        none = Unit("", 0, 0, 0, b"")
        found = resolve(lack)
        fresh = [found[k] or none for k in lack]
        self.at.update(zip(lack, range(len(self.at), len(self.at) + len(lack))))
        self.shown += [u[0] for u in fresh]
        self.links += [u[4] for u in fresh]
        counted = np.fromiter(chain.from_iterable(map(itemgetter(1, 2, 3), fresh)), np.int64, 3 * len(lack)).reshape(-1, 3)
        self.stats = np.concatenate([self.stats, np.column_stack([counted, np.where(counted[:, 2], 0, -1)])])
        self.seen = np.concatenate([self.seen, np.zeros(len(lack), np.int64)])
        made = []
        for doc_id, keys in docs:
            own = np.fromiter(map(self.at.__getitem__, keys or ()), np.int32, len(keys or ()))
            *sums, bad = self.stats[own].sum(0).tolist()
            if not len(own) or bad:
                made.append((self.name, doc_id, 0, 0, 0, "", own[:0]))
                continue
            np.add.at(self.seen, own, 1)
            text = ";".join(map(self.shown.__getitem__, own.tolist()))
            made.append((self.name, doc_id, *sums, hashlib.sha256(text.encode()).hexdigest(), own))
        return _batch([(*r, None, None, None, None) for r in made])

    def end(self) -> pa.RecordBatch:
        """The row of the block itself: its links, how often each occurs, and the links of each unit."""
        starts = np.cumsum([0, *map(len, self.links)]) // 8
        pairs, links = np.unique(np.frombuffer(b"".join(self.links), np.int64), return_inverse=True)
        times = np.repeat(self.seen, np.diff(starts))
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, links, times)
        return _batch([(self.name, None, None, None, None, None, None, pairs, counts, starts.astype(np.int32), links.astype(np.int32))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrow = to_arrow_schema(HELD)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)


def blocks_of(docs: DataFrame, keys, resolve, mark: int, width: int) -> DataFrame:
    """Rows of (doc_id, value) in blocks of about ``width`` characters of value; ``mark`` keeps two inputs apart."""
    def run(batches):
        block, made = None, 0
        for batch in batches:
            for part in slices(batch, 1):
                if block is None:
                    block, made = Block((TaskContext.get().partitionId() << 32 | made) * 2 + mark), made + 1
                values = texts(part.column(1))
                gc.disable()  # units have no cycles, and looking for them took a fifth of the time
                rows = block.rows([(i, keys(v) if v else None) for i, v in zip(part.column(0).to_pylist(), values)], resolve)
                gc.enable()
                yield rows
                block.size += sum(map(len, values))
                if block.size >= width:
                    yield block.end()
                    block = None
        if block is not None:
            yield block.end()

    return docs.mapInArrow(run, HELD)


ALIGNED = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
                       + [T.StructField("groups_sha256", T.StringType())])


def with_counts(held: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum the corpus-wide counts of each text's links, block by block."""
    arrow = to_arrow_schema(ALIGNED)

    def run(left, right):
        left = left.combine_chunks()
        whole, = np.flatnonzero(left["pairs"].is_valid().to_numpy()).tolist()
        starts, links = (left[c].chunk(0)[whole].values.to_numpy() for c in ("starts", "links"))
        values = np.zeros((3, right.num_rows), np.int64)
        values[:, right["place"].to_numpy()] = np.ones(right.num_rows), right["best"].to_numpy().astype(np.int64), right["count"].to_numpy()
        per_unit = _sums(values[:, links], starts)
        docs = left.filter(left["pairs"].is_null()).combine_chunks()
        own = docs["units"].chunk(0) if docs.num_rows else pa.array([], pa.list_(pa.int32()))
        sums = _sums(per_unit[:, own.flatten().to_numpy()], np.concatenate([[0], np.cumsum(np.diff(own.offsets.to_numpy()))]))
        columns = [docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], *map(pa.array, sums), docs["groups_sha256"]]
        return pa.Table.from_arrays(columns, schema=arrow)

    return held.groupBy("block").cogroup(counts.groupBy("home")).applyInArrow(run, ALIGNED)


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values between each start and the next, row by row."""
    total = np.concatenate([np.zeros((len(values), 1), np.int64), np.cumsum(values, 1)], 1)
    return total[:, starts[1:]] - total[:, starts[:-1]]


def aligned_documents(docs: DataFrame, vocabulary: str, model: str, text: str = "text",
                      range_bytes: int = RANGE_BYTES, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    A is a byte-level vocabulary of the tokenizers library over a space and the text, B a sentencepiece model that puts
    that space in front. A null or empty text, and one that either does not give back byte for byte, has no
    tokens: zeros and an empty digest, and none of its links count. ``n_best`` are the links whose count over all rows is the highest of
    their B id, ties included; repeated rows and rows without an id count like any other. Texts of more than
    ``range_bytes`` are put together from byte ranges. Other columns are not looked at.
    """
    docs = docs.select("doc_id", F.col(quoted(text)).alias("_text"))
    is_long = F.coalesce(F.octet_length("_text") > range_bytes, F.lit(False))

    def words(keys):
        return aligner(vocabulary, model).words(keys)

    def groups(keys):
        return aligner(vocabulary, model).groups(keys)

    ranged = staged(range_rows(docs.where(is_long), range_bytes), "byte-ranges")
    deepest = ranged.agg(F.max("idx")).first()[0] or 0
    made = composed(fragments(ranged.repartition("key", "idx"), vocabulary, model), deepest)
    # START comes before: the open prefix of a whole text is a group, and nothing stays open.
    first = F.when(F.col("head_a") != "", F.concat_ws("|", "head_a", "head_b"))
    joined = staged(made.select("doc_id", F.when(F.col("ok"), F.concat_ws(";", first, F.when(F.col("closed") != "", F.col("closed")))).alias("_text")),
                    "composed")  # written, so that no task has two Python workers
    held = staged(blocks_of(docs.where(~is_long), cut_text, words, 0, block_size)
                  .unionByName(blocks_of(joined, lambda v: v.split(";"), groups, 1, block_size)), "aligned-blocks")

    whole = held.where("pairs IS NOT NULL")
    sent = whole.select(F.col("block").alias("home"), F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("home", "place", "x.pairs", "x.counts")
    every = staged(sent.groupBy("pairs").agg(F.sum("counts").alias("count")).withColumn("b", F.col("pairs").bitwiseAND(F.lit(0xFFFFFFFF))), "links")
    best = every.groupBy("b").agg(F.max("count").alias("most"))
    counted = every.join(best, "b").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    return with_counts(held, sent.drop("counts").join(counted, "pairs").drop("pairs"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model"))
