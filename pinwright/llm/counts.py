"""Token counts by byte-pair merging with a heap and a linked list.

No identifier is emitted: a stretch of text begins as one symbol per byte, each
merge joins two neighbours, and the count is the symbols at first less the merges.
The stretches are the tokenizer's own pre-tokens, so the count is exact.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from pinwright.llm.frames import Memo, annotate, texts

#: Fixed value: the split pattern of byte-level BPE tokenizers.
PRE_TOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed value: the white space of that pattern.
WHITE = "\t-\r \x85\xa0  -     　"
RUN = re.compile(f"[{WHITE}][{WHITE}]")
_WORD = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def cut_words(text: str, special: tuple[str, ...]) -> list[str] | None:
    """Cut where no pre-token crosses; None if the text needs the slow way.

    With single white-space characters only, each white-space character begins a new
    stretch. A stretch that begins with a line break stands for itself, any other
    one had a space before it (the first one is given a line break's form apart).
    """
    if RUN.search(text) or any(s in text for s in special):
        return None
    return text.replace("\n", " \n").split(" ")


def stretches(text: str, special: tuple[str, ...]) -> list[str]:
    """The slow way: stretches of a text whose white space comes in runs."""
    parts = [text]
    for s in special:
        parts = [x for p in parts for x in (split_keeping(p, s) if p not in special else [p])]
    return [w for p in parts for w in ([p] if p in special else _WORD.findall(p))]


def split_keeping(text: str, mark: str) -> list[str]:
    out = []
    for i, part in enumerate(text.split(mark)):
        out += [mark] * bool(i) + [part] * bool(part)
    return out


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        if model["type"] != "BPE" or whole["normalizer"] or whole["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE vocabularies are supported")
        vocab = model["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.first = [vocab[c] for c in byte_letters()]
        self.special = tuple(sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True))
        self.tokens = Memo(self._token)
        self.words = Memo(self._word)

    def _token(self, token: str) -> int:
        """Merge one pre-token: pop the lowest rank, join, look at the new neighbours."""
        symbol = [self.first[b] for b in token.encode()]
        count = size = len(symbol)
        if size == 1:
            return 1
        ranks = self.ranks
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            found = ranks.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if j >= size or symbol[i] < 0 or ranks.get((symbol[i], symbol[j]), (-1,))[0] != rank:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = joined, -1
            count -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = ranks.get((joined, symbol[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = ranks.get((symbol[h], joined))
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return count

    def _stretch(self, stretch: str) -> int:
        if stretch in self.special:
            return 1
        return sum(map(self.tokens.__getitem__, PRE_TOKEN.findall(stretch)))

    def _word(self, word: str) -> int:
        return self._stretch(word if word[:1] == "\n" else " " + word)

    def count(self, text: str) -> int:
        cuts = cut_words(text, self.special)
        if cuts is None:
            return sum(map(self._stretch, stretches(text, self.special)))
        words = self.words
        return self._stretch(cuts[0]) + sum(map(words.__getitem__, cuts[1:]))


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024,
                 carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``).

    One row per input row, repeated rows included; a null or empty text counts zero.
    Special strings inside a text count as one token each, as the library has it.
    """
    def counted(column: pa.Array) -> list:
        whole = texts(column)
        return [pa.array([len(t.encode()) for t in whole], pa.int64()),
                pa.array([counter(vocabulary).count(t) for t in whole], pa.int64())]

    made = annotate(docs, counted, [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())],
                    [c for c in carry if c != "over_limit"], text)
    return made.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        public_tokenizers.path("byte_bpe_50k.json"))
