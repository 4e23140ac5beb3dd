"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components.

A document is the set of its distinct shingles. 32 bands of 4 MinHash samples bring a pair of similarity 0.8 together
with a chance of all but 5e-8. The 128 samples are also folded
into a 512-bit parity bitmap (odd sketch); the count of ones in the XOR of two bitmaps estimates the similarity of
high-similarity pairs, and pairs estimated below 0.6 (nearly five standard deviations under 0.8) are left. A second
parity bitmap of the set itself bounds the symmetric difference from below, which rules out pairs for certain and is
sharp for short texts. What remains is confirmed on the full sets.

Groups of copies are never expanded into pairs. Documents with equal sets are one class. In a band's bucket every
class is compared with a few hubs; confirmed links give components, and classes of a component need no comparison
with each other. What can still matter are pairs of different components in a bucket: the buckets with more than one
component compare the classes outside their largest component with the others, which completes the result.

Defined results: null, empty and wordless texts are linked with nothing; a null ``doc_id`` has a null component and
is kept; rows that repeat a ``doc_id`` count as one document with the links of all of them; ties go to the
smallest id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from segmentry.llm.common import ascii_spaced, letter_spaced, shingle_hashes, small_side, split_words, text_key, written
from segmentry.operators.graph import connected_components

BANDS = 32
ROWS = 4
SKETCH_BITS = 512
LEAST_ESTIMATE = 0.6
PERCENT = 80
SAMPLES = BANDS * ROWS
# Values and sets that the signature kernel takes at once: they stay in the processor's cache.
_CHUNK = 1 << 17
_CHUNK_SETS = 1 << 12
SIGNATURE = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>, parity array<bigint>"


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``doc_id, shingles``: the distinct shingle hashes of each spaced text."""
    return texts.select("doc_id", split_words(F.col("text")).alias("words")).select("doc_id", F.array_distinct(shingle_hashes(F.col("words"), size)).alias("shingles"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _signatures(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """For sets that begin at ``starts`` in ``values``: two digests, band keys and the parity bitmaps of samples and set."""
    n = len(starts)
    rng = np.random.default_rng(10)
    offsets = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
    factors = rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    d1 = np.add.reduceat(_mixed(values), starts)
    d2 = np.add.reduceat(_mixed(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
    bands = np.zeros((n, BANDS), dtype=np.uint64)
    sketch = np.zeros((n, SKETCH_BITS), dtype=np.uint8)
    rows = np.arange(n)
    for s in range(SAMPLES):
        low = np.minimum.reduceat((values ^ offsets[s]) * factors[s], starts)
        mixed = _mixed(low + np.uint64(s))
        bands[:, s // ROWS] = _mixed(bands[:, s // ROWS] * np.uint64(31) + mixed + np.uint64(s))
        sketch[rows, (mixed & np.uint64(SKETCH_BITS - 1)).astype(np.int64)] ^= 1
    own = np.repeat(rows, np.diff(starts, append=len(values))) * SKETCH_BITS + (_mixed(values) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    parity = (np.bincount(own, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return d1, d2, bands, np.packbits(sketch, axis=1).view(np.uint64), np.packbits(parity, axis=1).view(np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("shingles")), 0))
        ids, lists = batch.column("doc_id"), batch.column("shingles")
        sizes = pc.list_value_length(lists).to_numpy()
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        # Sets are cut into chunks of about _CHUNK values; every set left here has at least one value.
        ends = np.cumsum(sizes)
        part = np.stack([(ends - sizes) // _CHUNK, np.arange(len(sizes)) // _CHUNK_SETS])
        cuts = np.flatnonzero(np.diff(part, axis=1, prepend=-1).any(axis=0))
        for a, b in zip(cuts, [*cuts[1:], len(sizes)]):
            begin = ends[a] - sizes[a]
            d1, d2, *wide = _signatures(values[begin:ends[b - 1]], ends[a:b] - sizes[a:b] - begin)
            lists_of = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel().view(np.int64))) for m in wide]
            columns = [ids.slice(a, b - a), pa.array(sizes[a:b].astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *lists_of]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch", "parity"])


def most_differing_bits() -> int:
    """Ones in the XOR of two bitmaps at the least accepted estimate."""
    return math.floor(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - LEAST_ESTIMATE) / SKETCH_BITS)))


def _differing(a: str, b: str) -> Column:
    bits = [F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(SKETCH_BITS // 64)]
    return sum(bits[1:], bits[0])


def _sketched(reps: DataFrame, side: str) -> DataFrame:
    return reps.select(F.col("doc_id").alias(f"{side}_id"), F.col("n_shingles").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_s"), F.col("parity").alias(f"{side}_p"))


def _allowed() -> Column:
    """Whether the sizes and sketches of sides a and b allow a link. The first and last test never fail a linked pair."""
    sized = 100 * F.least("a_n", "b_n") >= PERCENT * F.greatest("a_n", "b_n")
    # A linked pair's symmetric difference is at most this share of the sum of both sizes, and the parity bits differ in no more places.
    bounded = (100 + PERCENT) * _differing("a_p", "b_p") <= (100 - PERCENT) * (F.col("a_n") + F.col("b_n"))
    return sized & (_differing("a_s", "b_s") <= most_differing_bits()) & bounded


def _may_link(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs ``a_id, b_id`` whose sizes and sketches allow a link."""
    for side in ("a", "b"):
        pairs = pairs.join(_sketched(reps, side), f"{side}_id")
    return pairs.filter(_allowed()).select("a_id", "b_id")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs that are linked, by their full sets; texts travel, as they are smaller than sets of hashes."""
    wanted = written(pairs.select(F.explode(F.array("a_id", "b_id")).alias("doc_id")).distinct())
    held = written(texts.join(small_side(wanted), "doc_id", "left_semi"))
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("doc_id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text")), f"{side}_id")

    def shingles(text: str) -> set:
        words = text.split(" ")
        return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)}

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set] = (None, set())  # rows of one hub follow each other
        for batch in batches:
            linked = []
            for a_text, b_text in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                if last[0] != b_text:
                    last = (b_text, shingles(b_text))
                a, b = shingles(a_text), last[1]
                both = len(a & b)
                linked.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield batch.select(["a_id", "b_id"]).filter(pa.array(linked, pa.bool_()))

    return pairs.select("a_id", "b_id", "a_text", "b_text").mapInArrow(confirm, "a_id bigint, b_id bigint")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a_id"), F.greatest(a, b).alias("b_id")]


def near_groups(docs: DataFrame, spaced=ascii_spaced, size: int = 4, text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    texts = docs.select("doc_id", spaced(F.col(text)).alias("text"))
    signed = written(shingle_sets(texts.filter("doc_id is not null"), size).mapInArrow(_sign, SIGNATURE))

    # Equal sets are one class, named by its smallest id. Several rows may carry one id, so an id can be in more classes than one.
    classes = written(signed.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    member = signed.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["n_shingles", "d1", "d2"]).select("doc_id", "rep")
    same = written(member.filter("doc_id <> rep").select(F.col("doc_id").alias("a_id"), F.col("rep").alias("b_id")).distinct())
    reps = signed.join(classes.select(F.col("rep").alias("doc_id"), "n_shingles", "d1", "d2"), ["doc_id", "n_shingles", "d1", "d2"], "left_semi")
    banded = reps.select("doc_id", F.explode("bands").alias("key"))

    hubs = banded.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi")
    hubs = written(hubs)
    seen = written(banded.join(hubs, "key").select("doc_id", F.explode(F.array("lo", "hi")).alias("hub")).filter("doc_id <> hub").select(*_ordered("doc_id", "hub")).distinct())
    links = written(_confirmed(written(_may_link(seen, reps)), texts, size))
    if not links.isEmpty():
        label = written(connected_components(links).withColumnRenamed("row_id", "doc_id"))
    else:
        label = links.select(F.col("a_id").alias("doc_id"), F.col("b_id").alias("component"))
    crossing = _crossing_pairs(banded.join(hubs.select("key"), "key", "left_semi"), label, reps).join(seen, ["a_id", "b_id"], "left_anti")
    more = written(_confirmed(written(crossing), texts, size))
    links = links.unionByName(more).unionByName(same)
    label = written(connected_components(links).withColumnRenamed("row_id", "doc_id")) if not links.isEmpty() else label

    count = signed.select("doc_id", "n_shingles")
    per_id = F.max("n_shingles").alias("n_shingles")
    out = texts.select("doc_id").join(count.groupBy("doc_id").agg(per_id), "doc_id", "left").join(label, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("bigint")).alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _crossing_pairs(banded: DataFrame, label: DataFrame, reps: DataFrame) -> DataFrame:
    """Distinct pairs of classes of different components that share a bucket and that the sketches allow.

    In each bucket the classes outside its largest component meet the others; the sketches are compared in the join,
    so that a large group of similar but unlinked texts does not come out as pairs.
    """
    placed = written(banded.join(label, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    share = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = share.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    rows = written(placed.join(written(mixed.select("key", "largest")), "key"))
    few = rows.filter("component <> largest").select(F.col("key").alias("a_key"), F.col("doc_id").alias("a_id"), F.col("component").alias("a_component")).join(_sketched(reps, "a"), "a_id")
    rest = rows.select(F.col("key").alias("b_key"), F.col("doc_id").alias("b_id"), F.col("component").alias("b_component")).join(_sketched(reps, "b"), "b_id")
    pairs = few.join(rest, (F.col("a_key") == F.col("b_key")) & (F.col("a_component") != F.col("b_component")) & _allowed())
    return pairs.select(*_ordered("a_id", "b_id")).distinct()


def keep_one(docs: DataFrame, spaced=letter_spaced, size: int = 5, text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id.

    A document is an id and its text. Rows that repeat both are one document, of which the row with the smallest other
    columns stays; different texts under one id are documents of their own, the one of the smallest digest under the id itself, the
    others after all ids. Rows without an id stay.
    """
    columns = docs.columns
    keyed = docs.withColumn("__key", text_key(F.col(text)))
    ids = keyed.filter("doc_id is not null").groupBy("doc_id").agg(F.min("__key").alias("__low"), F.max("__key").alias("__high"), F.count(F.lit(1)).alias("__rows"))
    repeated = written(ids.filter("__rows > 1"))
    if repeated.isEmpty():
        return _without_dropped(docs, spaced, size, text, "doc_id")
    top = docs.agg(F.max("doc_id")).first()[0]
    several = small_side(repeated.filter("__low <> __high").select("doc_id", "__low"))
    others = keyed.join(several, "doc_id").filter(F.col("__key") != F.col("__low")).select("doc_id", "__key").distinct()
    numbered = written(others.withColumn("__unit", F.lit(top + 1) + F.monotonically_increasing_id()))
    units = written(keyed.join(small_side(numbered), ["doc_id", "__key"], "left").withColumn("__unit", F.coalesce("__unit", "doc_id")))
    kept = _without_dropped(units, spaced, size, text, "__unit")
    marked = kept.join(small_side(repeated.select("doc_id", "__rows")), "doc_id", "left")
    first = F.row_number().over(Window.partitionBy("__unit").orderBy(*[F.col(c) for c in columns if c not in ("doc_id", text)]))
    one = marked.filter("__rows > 1").withColumn("__place", first).filter("__place = 1")
    return marked.filter("__rows is null").select(*columns).unionByName(one.select(*columns))


def _without_dropped(docs: DataFrame, spaced, size: int, text: str, unit: str) -> DataFrame:
    """``docs`` without the units that are not the smallest of their component. They are fewer than those that stay, so the texts need no shuffle as long as they can be broadcast."""
    groups = near_groups(docs.select(F.col(unit).alias("doc_id"), F.col(text).alias("text")), spaced, size)
    dropped = written(groups.filter("doc_id is not null and not kept").select(F.col("doc_id").alias(unit)).distinct())
    return docs.join(small_side(dropped), unit, "left_anti")
