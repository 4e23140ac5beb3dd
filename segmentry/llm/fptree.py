"""Ranked lexical search by branch and bound over trees of shared document prefixes.

Terms are runs of ASCII letters and digits and of characters outside ASCII, with A-Z in lower case. Documents are scored
for an item by saturating term weights in whole numbers (``gain`` below); the statistics (documents, all terms, documents
of each term) cover all documents.

One pass over the texts leaves a restricted vector for each document: the terms that any item has, with their counts. A
block of documents becomes a tree: terms in falling order of document frequency, the vectors sorted as sequences, and nodes where
sequences share a prefix (chains without a branch are one node; siblings of a few documents share a leaf). A node knows the
largest count of every term and the smallest length figure ``m`` among its documents, so the gain from both is a bound for
all of them. Each item searches the tree depth first, the child with the best bound before the others, and leaves every node whose bound is below
the item's k-th best score so far. What remains is scored exactly. Scores so far are carried from block to block of a task.

The items are taken in chunks of bounded vocabulary, whose weights are all that is broadcast; the best of all tasks meet in
two steps, so that no item's candidates are gathered in one task.

Defined results: null, empty and termless texts are in no statistic and score nothing; a null ``doc_id`` counts in the
statistics but is not ranked; a repeated row is ranked as often as it stands there; items are named by id, the distinct texts of an id
are one item (joined in order), null ids and termless items have no rows; ties go to the smaller id;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import written

BEST = 20
BLOCK = 2048
LEAF = 16
# Distinct terms of a chunk of items (its matrices have one column for each), and of all items together.
CHUNK_TERMS = 1 << 13
MOST_TERMS = 1 << 21
SALTS = 64

# Bytes between terms become spaces, A-Z lower case; bytes of characters outside ASCII are kept.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


@dataclass
class Item:
    """An item's id, its distinct terms as columns of its chunk, and weight times repeats of each."""

    item_id: int
    columns: np.ndarray
    weights: np.ndarray


def gain(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over terms (columns) of weight times saturated count; grows with ``tf`` and falls with ``m``."""
    tf = tf.astype(np.int64)
    return (weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None]))).sum(axis=1)


class PrefixTree:
    """Nodes over a block's documents in the order of their term sequences.

    ``tf`` is documents x terms (columns in falling document frequency) and ``m`` the length figures; both are kept in
    the order of the sequences. Nodes are numbers with a range of documents each; leaves have no children.
    """

    def __init__(self, tf: np.ndarray, m: np.ndarray):
        rows, columns = np.nonzero(tf)
        cuts = np.searchsorted(rows, np.arange(1, len(tf)))
        sequences = [c.tobytes() for c in np.split(columns.astype(">u4"), cuts)]
        self.order = np.array(sorted(range(len(tf)), key=lambda i: sequences[i]))
        self.tf, self.m = tf[self.order], m[self.order]
        self.shared = self._shared_lengths()
        self.leaves: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.ranges: list[tuple[int, int]] = []
        self._split(0, len(tf))
        starts = np.array([a for a, _ in self.leaves])
        most, least = np.maximum.reduceat(self.tf, starts, axis=0), np.minimum.reduceat(self.m, starts)
        # Leaves are numbered in document order, so a node's figures come from a run of leaves.
        first = np.searchsorted(starts, [a for a, _ in self.ranges])
        last = np.searchsorted(starts, [b for _, b in self.ranges])
        self.most = np.stack([most[a:b].max(axis=0) for a, b in zip(first, last)])
        self.least = np.array([least[a:b].min() for a, b in zip(first, last)])
        # A tree of one leaf has it as its own child, so that a search always looks below a node.
        self.below = [np.array(c or [n]) for n, c in enumerate(self.children)]
        self.leaf = np.array([not c for c in self.children])

    def _shared_lengths(self) -> np.ndarray:
        """Terms that each document's sequence has in common with the one before it, from the front."""
        has = self.tf > 0
        differs = has[1:] != has[:-1]
        at = np.where(differs.any(axis=1), differs.argmax(axis=1), has.shape[1])
        before = np.cumsum(has[1:], axis=1, dtype=np.int32)
        return np.concatenate([[0], np.where(at > 0, before[np.arange(len(at)), np.maximum(at - 1, 0)], 0)])

    def _split(self, begin: int, end: int) -> None:
        """Nodes below the range: it is cut where neighbours share least, and small neighbours are put together."""
        todo = [(begin, end, -1)]
        while todo:
            a, b, parent = todo.pop()
            number = len(self.ranges)
            self.ranges.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(number)
            if b - a > LEAF:
                inner = self.shared[a + 1:b]
                cuts = [a, *(np.flatnonzero(inner == inner.min()) + a + 1), b]
                parts = [a]
                for left, right in zip(cuts, cuts[1:]):
                    if right - parts[-1] > LEAF and left > parts[-1]:
                        parts.append(left)
                parts.append(b)
                if len(parts) > 2:
                    todo += [(x, y, number) for x, y in zip(parts, parts[1:])]
                    continue
            self.leaves.append((a, b))
        self.leaves.sort()

    def search(self, item: Item, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of ``best`` and the tree's documents; ``ids`` in the order of the sequences."""
        scores, found = best
        floor = scores[-1] if len(scores) == k else 1
        stack = [(gain(self.most[:1, item.columns], self.least[:1], item.weights)[0], 0)]
        while stack:
            bound, node = stack.pop()
            if bound < floor:
                continue
            below = self.below[node]
            bounds = gain(self.most[np.ix_(below, item.columns)], self.least[below], item.weights)
            below, bounds = below[bounds >= floor], bounds[bounds >= floor]
            leaf = self.leaf[below]
            if leaf.any():
                rows = np.concatenate([np.arange(*self.ranges[n]) for n in below[leaf]])
                exact = gain(self.tf[np.ix_(rows, item.columns)], self.m[rows], item.weights)
                stays = exact >= floor
                if stays.any():
                    scores, found = np.concatenate([scores, exact[stays]]), np.concatenate([found, ids[rows[stays]]])
                    order = np.lexsort((found, -scores))[:k]
                    scores, found = scores[order], found[order]
                    floor = scores[-1] if len(scores) == k else 1
            order = np.argsort(bounds[~leaf], kind="stable")  # the best one is on top of the stack
            stack += zip(bounds[~leaf][order], below[~leaf][order])
        return scores, found


def item_terms(items: DataFrame) -> dict[int, Counter]:
    """The terms of each item with their repeats. The items are a stated query set; their vocabulary is checked."""
    texts = items.filter("item_id is not null and text is not null").groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("text")), " ").alias("text"))
    found, words = {}, set()
    for row in texts.toLocalIterator():
        counted = Counter(terms(row["text"].encode()))
        if counted:
            found[row["item_id"]] = counted
            words.update(counted)
            if len(words) > MOST_TERMS:
                raise ValueError(f"items of more than {MOST_TERMS} distinct terms: search them in parts")
    return found


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, terms, tfs``: each document's number of terms, and the terms of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, numbers, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = terms(text.as_py())
                sizes.append(len(words))
                for word, n in Counter(words).items():
                    at = known.get(word)
                    if at is not None:
                        numbers.append(at)
                        counts.append(n)
                ends.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (numbers, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(read, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _chunks(items: dict[int, Counter]) -> Iterator[list[int]]:
    """Items in runs of at most CHUNK_TERMS distinct terms (or one item)."""
    run, seen = [], set()
    for item_id in sorted(items):
        if run and len(seen | items[item_id].keys()) > CHUNK_TERMS:
            yield run
            run, seen = [], set()
        run.append(item_id)
        seen |= items[item_id].keys()
    if run:
        yield run


def _block_best(vectors: DataFrame, chunk: list[Item], width: int, column_of: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """``item_id, doc_id, score``: the k best of each task."""
    shared = vectors.sparkSession.sparkContext.broadcast((chunk, column_of))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, column_of = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in chunk]
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                ids, lengths = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
                numbers, counts = part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy()
                owner = np.repeat(np.arange(len(ids)), np.diff(part.column("terms").offsets.to_numpy()))
                columns = column_of[numbers]
                here = columns >= 0
                tf = np.zeros((len(ids), width), dtype=np.int32)
                tf[owner[here], columns[here]] = counts[here]
                # Whole numbers of any size: 25 * length * documents may pass 64 bits.
                m = np.array([75 + 25 * int(n) * n_docs // all_terms for n in lengths], dtype=np.int64)
                tree = PrefixTree(tf, m)
                ordered = ids[tree.order]
                best = [tree.search(item, ordered, b, k) for item, b in zip(chunk, best)]
        rows = [(item.item_id, int(d), int(s)) for item, (scores, found) in zip(chunk, best) for s, d in zip(scores, found)]
        yield pa.RecordBatch.from_pylist([{"item_id": i, "doc_id": d, "score": s} for i, d, s in rows], pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return vectors.filter("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item_id bigint, doc_id bigint, score bigint")


def top_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of every item."""
    spark = docs.sparkSession
    wanted = item_terms(items)
    vocabulary = sorted(set().union(*wanted.values())) if wanted else []
    vectors = written(restricted_vectors(docs, vocabulary))
    totals = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not wanted or not totals["docs"]:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    # One row per term of the items, a bounded number.
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(totals["docs"])) + 2) / (2 * F.col("df") + 1))).alias("w")
    weights = {vocabulary[r["term"]]: (r["df"], r["w"]) for r in held.select("term", "df", weight).collect()}
    number = {t: i for i, t in enumerate(vocabulary)}
    found = None
    for run in _chunks(wanted):
        # Columns in falling document frequency; terms that no document has can add nothing.
        columns = sorted({t for i in run for t in wanted[i]} & weights.keys(), key=lambda t: (-weights[t][0], t))
        place = {t: c for c, t in enumerate(columns)}
        column_of = np.full(len(vocabulary), -1, dtype=np.int64)
        column_of[[number[t] for t in columns]] = np.arange(len(columns))
        chunk = []
        for i in run:
            own = sorted((place[t], weights[t][1] * n) for t, n in wanted[i].items() if t in place)
            if own:
                chunk.append(Item(i, np.array([c for c, _ in own]), np.array([w for _, w in own], dtype=np.int64)))
        if chunk:
            best = written(_block_best(vectors, chunk, len(columns), column_of, totals["docs"], totals["terms"], k))
            found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = [F.desc("score"), F.col("doc_id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).filter(F.col("r") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
