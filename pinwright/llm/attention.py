"""A quality classifier that learns which passages speak for a document.

Multiple-instance learning: labels are known for documents, not for their passages. Every passage of 64
words is encoded (tanh layer over byte shares and word shapes), a gated attention
network gives each passage a weight, the weights of a document sum to one, and the weighted mean of
its passages is scored. All weights are learned together, from the labels of documents.

A text is read in stretches of about a megabyte, and its softmax is carried on from one to the next (greatest logit,
sum, weighted sum), so a text of any length is scored whole in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pinwright.llm.frames import annotate, quoted, texts

PASSAGE_WORDS = 64
#: Bytes of text that are encoded at once; the longest stretch of one text.
STRETCH = 1 << 20
#: What the classifier is fitted on: so many labelled documents, by the hash of their ids, of at most so many bytes.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 1 << 16

_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128)
_MIX = np.random.default_rng(11).integers(1, 1 << 63, (64, 256), np.uint64)
SHAPES = 9
WIDTH = 256 + SHAPES


def stretches(raw: bytes) -> Iterator[bytes]:
    """The whole text in stretches that end behind white space where there is any in the last half."""
    while len(raw) > STRETCH:
        end = max(raw.rfind(b" ", STRETCH // 2, STRETCH), raw.rfind(b"\n", STRETCH // 2, STRETCH)) + 1 or STRETCH
        yield raw[:end]
        raw = raw[end:]
    yield raw


def _per(group: np.ndarray, values, n: int) -> np.ndarray:
    return np.bincount(group, values, n)


def _new(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands here for the first time."""
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    return first


def passages(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of some stretches, and the number of passages of each; one at least."""
    sizes = np.array([len(p) + 1 for p in parts])
    raw = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    part = np.repeat(np.arange(len(parts)), sizes)
    space = _SPACE[raw]
    begins = ~space & np.append(True, space[:-1])
    at = np.flatnonzero(begins)
    n_words = np.bincount(part[at], minlength=len(parts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.cumsum(n_passages) - n_passages
    word = np.maximum(np.cumsum(begins) - 1 - np.repeat(np.cumsum(n_words) - n_words, sizes), 0)
    word = np.minimum(word, np.maximum(n_words - 1, 0)[part])
    passage = base[part] + word // PASSAGE_WORDS
    n = int(n_passages.sum())

    shares = np.bincount(passage * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float32)
    n_bytes = shares.sum(1)
    features = np.zeros((n, WIDTH), np.float32)
    features[:, :256] = np.sqrt(shares / n_bytes[:, None])
    if len(at):
        of, own = passage[at], part[at]
        lengths = np.add.reduceat(~space, at).astype(np.int64)
        upper, letters = (np.add.reduceat(x[raw], at).astype(np.int64) for x in (_UPPER, _LETTER))
        here = np.arange(len(raw))
        place = np.minimum(here - np.maximum.accumulate(np.where(begins, here, 0)), 63)
        hashed = np.add.reduceat(np.where(space, np.uint64(0), _MIX[place, raw]), at) + own.astype(np.uint64)
        grams = hashed.copy()
        for k in (1, 2, 3):
            grams[:-k] = grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashed[k:]
        words = np.maximum(_per(of, None, n), 1)
        for k, x in enumerate((lengths, lengths**2, lengths <= 3, _UPPER[raw[at]], upper == lengths, letters == 0,
                               letters < lengths, _new(hashed * np.uint64(31) + of.astype(np.uint64)), _new(grams))):
            features[:, 256 + k] = _per(of, x, n) / words
        features[:, 256] = np.log1p(features[:, 256])
        features[:, 257] = np.log1p(features[:, 257])
    return features, n_passages


@dataclass
class AttentionModel:
    """Weights of the encoder (w), the gated attention (v, u, t) and the score (c, d), and the scale of features."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    mean: np.ndarray = None
    spread: np.ndarray = None

    @classmethod
    def blank(cls, prior: float, hidden: int = 24, gate: int = 12, seed: int = 5) -> AttentionModel:
        """A model that gives every text the same score."""
        rng = np.random.default_rng(seed)
        made = {"w": rng.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "wb": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, (hidden, gate)),
                "u": rng.normal(0, hidden**-0.5, (hidden, gate)), "t": np.zeros(gate), "c": np.zeros(hidden), "d": np.array(np.log(prior / (1 - prior)))}
        return cls(made, np.zeros(WIDTH), np.ones(WIDTH))

    def encoded(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Passages, both sides of the gate, and attention logits."""
        p = self.weights
        h = np.tanh(features @ p["w"] + p["wb"])
        a, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        return h, a, g, (a * g) @ p["t"]

    def scaled(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.spread

    def fit(self, features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, epochs: int = 30, rate: float = 0.01,
            decay: float = 1e-4, batch: int = 64) -> AttentionModel:
        """Adam on the log loss of documents; ``sizes`` are their numbers of passages."""
        self.mean, self.spread = features.mean(0), features.std(0) + 1e-3
        x, ends = self.scaled(features), np.cumsum(sizes)
        rng, p = np.random.default_rng(7), self.weights
        first, second, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(sizes))
            for at in range(0, len(order), batch):
                some, step = order[at:at + batch], step + 1
                rows = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in some])
                for k, grad in self._gradient(x[rows], sizes[some], labels[some]).items():
                    grad = grad + decay * p[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad**2
                    p[k] = p[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, of = self.weights, np.repeat(np.arange(len(sizes)), sizes)
        starts = np.cumsum(sizes) - sizes
        h, a, g, logit = self.encoded(x)
        weight = np.exp(logit - np.maximum.reduceat(logit, starts)[of])
        weight /= np.add.reduceat(weight, starts)[of]
        bag = np.add.reduceat(weight[:, None] * h, starts)
        miss = (1 / (1 + np.exp(-(bag @ p["c"] + p["d"]))) - labels) / len(labels)
        d_bag = miss[:, None] * p["c"]
        along = (d_bag[of] * h).sum(1)
        d_logit = weight * (along - np.add.reduceat(weight * along, starts)[of])
        d_a, d_g = d_logit[:, None] * p["t"] * g * (1 - a**2), d_logit[:, None] * p["t"] * a * g * (1 - g)
        d_h = (weight[:, None] * d_bag[of] + d_a @ p["v"].T + d_g @ p["u"].T) * (1 - h**2)
        return {"w": x.T @ d_h, "wb": d_h.sum(0), "v": h.T @ d_a, "u": h.T @ d_g, "t": (a * g).T @ d_logit, "c": bag.T @ miss, "d": miss.sum()}

    def scores(self, whole: list[str]) -> np.ndarray:
        """Scores from 0 to 1, one per text."""
        p, n = self.weights, len(whole)
        top, total, bag = np.full(n, -np.inf), np.zeros(n), np.zeros((n, len(p["c"])))
        for owner, parts in self._together(whole):
            features, sizes = passages(parts)
            h, _, _, logit = self.encoded(self.scaled(features))
            of = np.repeat(owner, sizes)
            now = top.copy()
            np.maximum.at(now, of, logit)
            kept = np.exp(np.where(np.isinf(top), -np.inf, top - np.where(np.isinf(now), 0, now)))
            total, bag, top = total * kept, bag * kept[:, None], now
            weight = np.exp(logit - top[of])
            np.add.at(total, of, weight)
            np.add.at(bag, of, weight[:, None] * h)
        return 1 / (1 + np.exp(-((bag / total[:, None]) @ p["c"] + p["d"])))

    @staticmethod
    def _together(whole: list[str]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """Stretches of several texts, about STRETCH bytes in all, with the number of each one's text."""
        owner, parts, size = [], [], 0
        for i, text in enumerate(whole):
            for part in stretches(text.encode()):
                if size + len(part) > STRETCH and parts:
                    yield np.array(owner), parts
                    owner, parts, size = [], [], 0
                owner.append(i)
                parts.append(part)
                size += len(part)
        if parts:
            yield np.array(owner), parts


def held_out(doc_id: str = "doc_id"):
    """One in five documents, by the checksum of the id as text; rows without an id are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
                sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Fit on labelled documents that are not held out.

    At most ``sample_docs`` labels, in the order of their ids' hashes, and of these the texts of at most ``sample_bytes``:
    what is broadcast and what comes to the driver is bounded whatever the corpus. Without labels the score is a constant;
    of repeated ids all rows count.
    """
    order = F.xxhash64("doc_id")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).alias("_label"))
    chosen = known.orderBy(order, "doc_id", "_label").limit(sample_docs)
    rows = (docs.where(F.coalesce(F.octet_length(quoted(text)), F.lit(0)) <= sample_bytes)
            .select("doc_id", F.col(quoted(text)).alias("_text")).join(F.broadcast(chosen), "doc_id")
            .orderBy(order, "doc_id", "_text", "_label").limit(sample_docs).collect())
    marks = np.array([r["_label"] for r in rows], float)
    model = AttentionModel.blank((marks.sum() + 1) / (len(marks) + 2))
    if not len(rows):
        return model
    made = [passages([(r["_text"] or "").encode()]) for r in rows]
    return model.fit(np.concatenate([f for f, _ in made]), np.concatenate([n for _, n in made]), marks)


def quality_scores(docs: DataFrame, model: AttentionModel, least: float = 0.3, text: str = "text",
                   carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from ``least`` on) from the whole text alone.

    One row per input row, repeated rows included. Null and empty texts have one empty
    passage and are scored as such.
    """
    made = annotate(docs, lambda column: [pa.array(model.scores(texts(column)), pa.float64())],
                    [T.StructField("score", T.DoubleType())], [c for c in carry if c != "predicted"], text)
    return made.withColumn("predicted", (F.col("score") >= least).cast("int"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
