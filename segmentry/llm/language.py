"""Language identification by a byte convolutional network over fixed-length windows.

A text in lower case is cut into windows of ``WINDOW`` bytes, all of them. Filters of several widths slide over a
window (a filter over one-hot bytes is a table of weights per offset and byte), each keeps its largest response, and a
softmax over these gives the languages. A text's prediction is the mean of its windows' probabilities, weighted by
their bytes. The network is trained in numpy on at most ``TRAIN_TEXTS`` labelled texts, drawn evenly over the languages
by a hash of their ids; training and predictions read whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; if nothing is labelled every text is
``und``; repeated rows get equal predictions; ties between languages go to the first by name; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmentry.llm.common import draw, held_out

WINDOW = 256
# The prediction reads offsets in pairs, so the first width is 2 and the last 4.
WIDTHS = (2, 3, 4)
REACH = WIDTHS[-1]
FILTERS = 16
TRAIN_TEXTS = 1000
EPOCHS = 5
BATCH = 32
NONE = "und"


@dataclass
class ByteNetwork:
    """Filter tables (offset x 256 x all filters; 0 beyond a filter's width), and the dense layer over the pooled responses."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    @classmethod
    def untrained(cls, languages: list[str], seed: int = 2) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        pooled = FILTERS * len(WIDTHS)
        table = (rng.standard_normal((REACH, 256, pooled)) * 0.3).astype(np.float32) * _within()
        return cls(languages, table, np.zeros(pooled, np.float32), (rng.standard_normal((pooled, len(languages))) * 0.1).astype(np.float32), np.zeros(len(languages), np.float32))

    def _dense(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(best + self.bias, 0)
        return h, _softmax(h @ self.dense + self.shift)

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to two neighbouring bytes at once: at offsets 0 and 1 for all filters, at 2 and 3 for those wider than 2."""
        first = (self.table[0][:, None] + self.table[1][None]).reshape(1 << 16, -1)
        return first, np.ascontiguousarray((self.table[2][:, None, FILTERS:] + self.table[3][None, :, FILTERS:]).reshape(1 << 16, -1))

    def probabilities(self, x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], chunk: int = 64) -> np.ndarray:
        """Probabilities of the languages for each window. A chunk's responses stay in the processor's cache."""
        out = []
        places = WINDOW - REACH + 1
        for a in range(0, len(x), chunk):
            part = x[a:a + chunk].astype(np.uint16)
            two = part[:, :-1] << 8 | part[:, 1:]
            z = np.take(pairs[0], two[:, :places], axis=0, mode="clip")
            z[:, :, FILTERS:] += np.take(pairs[1], two[:, 2:places + 2], axis=0, mode="clip")
            out.append(self._dense(z.max(axis=1))[1])
        return np.concatenate(out)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on the cross-entropy. A filter learns from the place of its largest response only."""
        rng = np.random.default_rng(seed)
        weights = [self.table, self.bias, self.dense, self.shift]
        first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        places = WINDOW - REACH + 1
        filters = np.arange(self.table.shape[2])[None, :]
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
                step += 1
                xb = x[part]
                z = sum(self.table[j][xb[:, j:places + j]] for j in range(REACH))
                at = z.argmax(axis=1)
                h, error = self._dense(z.max(axis=1))
                error[np.arange(len(part)), y[part]] -= 1
                error /= len(part)
                back = (error @ self.dense.T) * (h > 0)
                g = np.zeros_like(self.table)
                for j in range(REACH):
                    np.add.at(g[j], (xb[np.arange(len(part))[:, None], at + j], filters), back)
                grads = [g * _within(), back.sum(0), h.T @ error, error.sum(0)]
                for w, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * 0.6**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def _within() -> np.ndarray:
    """1 for the offsets inside each filter's width."""
    return (np.arange(REACH)[:, None] < np.repeat(WIDTHS, FILTERS)[None, :]).astype(np.float32)[:, None, :]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def byte_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts as rows of bytes (0 fills the last), the text of each window and its bytes."""
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    counts = np.array([max(1, -(-len(b) // WINDOW)) for b in coded])
    padded = b"".join(b.ljust(n * WINDOW, b"\0") for b, n in zip(coded, counts))
    owner = np.repeat(np.arange(len(coded)), counts)
    last = np.cumsum(counts) - 1
    used = np.full(len(owner), WINDOW)
    used[last] = [len(b) - (n - 1) * WINDOW for b, n in zip(coded, counts)]
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, WINDOW), owner, used


def training_texts(docs: DataFrame, label: str = "lang", limit: int = TRAIN_TEXTS) -> list:
    """At most ``limit`` rows (label, text) of labelled texts outside the held-out part, drawn evenly over the labels."""
    from pyspark.sql.window import Window

    labelled = docs.select("doc_id", "text", label).filter(F.col(label).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(limit) / F.count(F.lit(1)).over(Window.partitionBy()) / F.col("n")
    rates = {r[0]: r[1] for r in counts.select(F.col(label), share.alias("rate")).collect()}
    if not rates:
        return []
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col(label))
    order = draw(22, "doc_id", "text")
    chosen = labelled.withColumn("order", order).filter(F.col("order") < rate).select(F.col(label).alias("label"), "text", "order")
    return chosen.orderBy("order", "label").limit(limit).collect()


def train(docs: DataFrame) -> ByteNetwork | None:
    rows = training_texts(docs)
    languages = sorted({r["label"] for r in rows})
    if not languages:
        return None
    pairs = [(r["text"], languages.index(r["label"])) for r in rows if r["text"]]
    network = ByteNetwork.untrained(languages)
    if pairs:
        x, owner, _ = byte_windows([t for t, _ in pairs])
        network.fit(x, np.array([y for _, y in pairs])[owner])
    return network


def predict(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    if network is None:
        return rows.select("doc_id", "held_out", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))

    shared = docs.sparkSession.sparkContext.broadcast(network)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        pairs = network.pair_tables()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            named, scores = [NONE] * len(texts), [0.0] * len(texts)
            has = [i for i, t in enumerate(texts) if t is not None]
            if has:
                x, owner, used = byte_windows([texts[i] for i in has])
                p = network.probabilities(x, pairs)
                total = np.zeros((len(has), p.shape[1]))
                np.add.at(total, owner, p * used[:, None])
                mean = total / np.bincount(owner, weights=used)[:, None]
                for i, row in zip(has, mean):
                    best = int(row.argmax())
                    named[i], scores[i] = network.languages[best], min(1.0, max(0.0, float(row[best])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(classify, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
