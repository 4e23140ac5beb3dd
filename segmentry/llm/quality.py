"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes, all of them. A passage is described by the shares of classes of
bytes, the shares of pairs of neighbouring classes, and the share of distinct four-byte runs, and encoded by a dense
layer. Gated attention (the product of a tanh and a sigmoid layer) weighs the passages of a text; the weighted sum of
their encodings gives the text's score. All weights are learnt together from labels of texts, in numpy, on at most
``TRAIN_TEXTS`` labelled rows, drawn evenly over the labels by a hash of their ids. Training and scores read whole texts.

Defined results: null and empty texts are one empty passage and are scored like others; if only one label is known every
score is that label, and 0.5 if none is; a document with several labels takes part with each; repeated rows
get equal scores; an empty table gives an empty result; extra columns pass through ``accept`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import draw, held_out, small_side

PASSAGE = 512
HIDDEN = 24
GATE = 12
TRAIN_TEXTS = 2400
EPOCHS = 30
BATCH = 64
ACCEPTED = 0.7

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",", "!", "?", "|", "$%&*#@^~+=", "'\"()[]{}<>", ":;-_/\\`"]
CLASSES = len(_GROUPS) + 2  # and other bytes: control characters, parts of longer characters
_CLASS = np.full(256, CLASSES - 1, dtype=np.int64)
_CLASS[:128] = CLASSES - 2
for _g, _chars in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _chars]] = _g
FEATURES = CLASSES + CLASSES * CLASSES + 2


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages (rows), and the text each belongs to."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        coded = (text or "").encode("utf-8", "replace")
        starts = range(0, max(len(coded), 1), PASSAGE)
        pieces += [coded[s:s + PASSAGE] for s in starts]
        owner += [i] * len(starts)
    x = np.frombuffer(b"".join(p.ljust(PASSAGE, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, PASSAGE)
    length = np.array([len(p) for p in pieces])
    rows, inside = np.arange(len(x))[:, None], np.arange(PASSAGE)[None, :] < length[:, None]
    kinds = _CLASS[x]
    single = np.bincount((rows * CLASSES + kinds)[inside], minlength=len(x) * CLASSES).reshape(len(x), CLASSES)
    double = np.bincount((rows * CLASSES**2 + kinds[:, :-1] * CLASSES + kinds[:, 1:])[inside[:, 1:]], minlength=len(x) * CLASSES**2).reshape(len(x), CLASSES**2)
    wide = x.astype(np.uint32)
    runs = wide[:, :-3] | wide[:, 1:-2] << 8 | wide[:, 2:-1] << 16 | wide[:, 3:] << 24
    runs[~inside[:, 3:]] = 0  # one value for all that lies past the end
    runs.sort(axis=1)
    distinct = (np.diff(runs, axis=1) != 0).sum(axis=1) + 1 - (length < PASSAGE)
    n = np.maximum(length, 1)[:, None]
    share = np.where(length >= 4, distinct / np.maximum(length - 3, 1), 1.0)
    features = np.concatenate([single / n, double / n, share[:, None], np.log1p(length)[:, None] / np.log(PASSAGE)], axis=1)
    return features.astype(np.float32), np.array(owner, dtype=np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class GatedBags:
    """Centring of the features, encoder, the two attention layers, attention and output weights."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]

    @classmethod
    def untrained(cls, features: np.ndarray, seed: int = 5) -> GatedBags:
        rng = np.random.default_rng(seed)
        shapes = [(FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]
        weights = [(rng.standard_normal(s) / np.sqrt(s[0]) * (len(s) > 1 or s[0] > 1)).astype(np.float32) for s in shapes]
        weights[1][:] = 0
        return cls(features.mean(axis=0), features.std(axis=0) + 0.01, weights)

    def _forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        enc, enc_bias, tanh_w, gate_w, att, out, bias = self.weights
        n = (x - self.mean) / self.spread
        h = np.tanh(n @ enc + enc_bias)
        t, g = np.tanh(h @ tanh_w), _sigmoid(h @ gate_w)
        e = np.exp(np.clip((t * g) @ att, -30, 30))
        sizes = np.diff(starts, append=len(x))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts)
        return n, h, t, g, a, sizes, z, _sigmoid(z @ out + bias)

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self._forward(x, starts)[-1]

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, decay: float = 1e-4, seed: int = 5) -> None:
        """Adam on the cross-entropy of bags, whose passages follow each other from ``starts`` on."""
        rng = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0
        ends = np.append(starts[1:], len(x))
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // BATCH)):
                step += 1
                rows = np.concatenate([np.arange(starts[i], ends[i]) for i in part])
                at = np.cumsum(np.r_[0, (ends - starts)[part][:-1]])
                enc, _, tanh_w, gate_w, att, out, _ = self.weights
                n, h, t, g, a, sizes, z, p = self._forward(x[rows], at)
                dp = (p - y[part]) / len(part)
                dz = np.repeat(dp[:, None] * out[None, :], sizes, axis=0)
                da = (dz * h).sum(axis=1)
                ds = a * (da - np.repeat(np.add.reduceat(a * da, at), sizes))
                dt, dg = ds[:, None] * att * g * (1 - t * t), ds[:, None] * att * t * g * (1 - g)
                dh = (dz * a[:, None] + dt @ tanh_w.T + dg @ gate_w.T) * (1 - h * h)
                grads = [n.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ ds, z.T @ dp, dp.sum(keepdims=True)]
                for w, d, m, v in zip(self.weights, grads, first, second):
                    d = d + decay * w
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def training_texts(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_TEXTS) -> list:
    """At most ``limit`` rows (label, text) outside the held-out part, half of each label where there are enough."""
    known = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return [(y, []) for y in counts]
    order = draw(55, "doc_id")
    rate = F.when(F.col("label") == 1, F.lit(limit / 2 / counts[1])).otherwise(F.lit(limit / 2 / counts[0]))
    chosen = known.distinct().withColumn("order", order).filter(F.col("order") < rate).orderBy("order", "doc_id", "label").limit(limit)
    return docs.select("doc_id", "text").filter("text is not null").join(small_side(chosen), "doc_id").select("label", "text", "order", "doc_id").orderBy("order", "doc_id").limit(limit).collect()


def train(docs: DataFrame, labels: DataFrame) -> GatedBags | float:
    """The fitted model, or a constant score if the labels don't allow a fit."""
    rows = training_texts(docs, labels)
    kinds = {r[0] for r in rows}
    if len(kinds) < 2:
        return float(kinds.pop()) if kinds else 0.5
    bags = [passages([r["text"]])[0] for r in rows]
    x = np.concatenate(bags)
    starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
    model = GatedBags.untrained(x)
    model.fit(x, starts, np.array([r["label"] for r in rows], dtype=np.float32))
    return model


def _scored(rows: DataFrame, model: GatedBags | float, text: str, columns: list[str], name: str) -> DataFrame:
    """``columns`` of ``rows`` and the score of ``text``."""
    if isinstance(model, float):
        return rows.select(*columns, F.lit(model).alias(name))
    schema = rows.select(*columns).schema.add(name, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts, begin = batch.column(batch.schema.get_field_index(text)).to_pylist(), [], 0
            while begin < len(texts):
                # About a megabyte of text at a time, whole texts only.
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end] or "") <= 1 << 20):
                    size += len(texts[end] or "")
                    end += 1
                x, owner = passages(texts[begin:end])
                parts.append(model.scores(x, np.searchsorted(owner, np.arange(end - begin))))
                begin = end
            scores = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(scores, pa.float64())], names=[*columns, name])

    return rows.mapInArrow(score, schema)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = train(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = _scored(rows, model, "text", ["doc_id", "held_out"], "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= ACCEPTED).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns. Without any label to learn from nothing is rejected."""
    model = train(docs, labels)
    if model == 0.5:
        return docs
    name = next(n for n in (f"__score{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    return _scored(docs, model, "text", docs.columns, name).filter(F.col(name) >= ACCEPTED).drop(name)
