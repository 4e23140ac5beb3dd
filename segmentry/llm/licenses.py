"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment confirms them.

Texts and templates are words (lower-case runs of letters and digits) and their shingles of five. For each length of
template there are windows of that many words, a stride of an eighth apart, so that a template in a text is shifted
against some window by at most a sixteenth. A window that holds at least 0.8 of a template so shifted has a similarity of at least
0.55 to it; ``BANDS`` bands of ``ROWS`` samples then agree in one with a chance of all but 1e-5. Windows that, with their
margin, hold too few shingles of the templates of their length to be confirmed are not signed. What the bands find is confirmed in
Spark by the share of the template's shingles in the window and the stride's margin around it.

Licenses share passages (BSD-2-Clause and BSD-3-Clause, the GPL family, versions). Where half or more of a template stands
in one of another license, both are compared by the shingles that only one of them has: a window has to hold a larger
share of the template's than of the other's.

``shipped_templates`` are the short notices below and the notices and full texts of the folder ``license_texts``. The text of
AGPL-3.0 in it is its terms without preamble.

Defined results: null and empty texts hold nothing; repeated rows of an id count once; the first of equal windows is
reported; a null id is reported as null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import letter_spaced

SHINGLE = 5
PERCENT = 80
BANDS = 32
ROWS = 2

# Notices as they are published, by the name of the license.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
     " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
     ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software"
     " without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit"
     " persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies"
     " or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,"
     " either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    # BSD-2-Clause and BSD-3-Clause share this sentence.
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


TEXTS = Path(__file__).with_name("license_texts")
# Share of a template in one of another license from which the two are told apart by what only one of them has.
SHARED = 0.5


def shipped_templates() -> list[tuple[str, str]]:
    """Name and text of all templates that come with this package."""
    notices = [tuple(line.split("\t", 1)) for line in (TEXTS / "notices.tsv").read_text(encoding="utf-8").splitlines()]
    return [*TEMPLATES, *notices, *((file.stem, file.read_text(encoding="utf-8")) for file in sorted(TEXTS.glob("*.txt")))]


def _rivals(spaced: list[tuple[int, str, list[str]]]) -> dict[int, list[tuple[list[int], list[int]]]]:
    """Per template, for each template of another license that holds much of it: shingles of this one only, of the other only."""
    held = [(i, name, frozenset(_shingles(words))) for i, name, words in spaced]
    return {i: [(sorted(t - u), sorted(u - t)) for _, other, u in held if other != name and t != u and len(t & u) >= SHARED * len(t)] for i, name, t in held}


def _shingles(words: list[str]) -> list[int]:
    """64-bit hashes (signed) of all runs of five words; fewer words are one run."""
    runs = zip(*(words[k:] for k in range(SHINGLE))) if len(words) >= SHINGLE else [words] if words else []
    return [xxhash.xxh64_intdigest(" ".join(r)) - (1 << 63) for r in runs]


def band_keys(shingles: list[int]) -> list[int]:
    """One key for each band of MinHash samples; the band's number is part of it."""
    rng = np.random.default_rng(9)
    mask, factor = rng.integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
    x = np.array(shingles, dtype=np.int64).view(np.uint64)
    low = ((x[:, None] ^ mask) * (factor * np.uint64(2) + np.uint64(1))).min(axis=0).reshape(BANDS, ROWS)
    key = low[:, 0] * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)
    for r in range(1, ROWS):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + low[:, r]
    return key.view(np.int64).tolist()


def _stride(length: int) -> int:
    return max(1, length // 8)


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, license, template, containment, start_word, n_words``: the best window of each template in each document."""
    templates = TEMPLATES if templates is None else templates
    spark: SparkSession = docs.sparkSession
    notices = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    spaced = [(r["template"], r["license"], r["t"].split(" ")) for r in notices.select("template", "license", letter_spaced(F.col("text")).alias("t")).collect() if r["t"]]
    known: dict[tuple, set[int]] = {}  # lengths of the templates that hold a shingle
    least: dict[int, float] = {}  # fewest shingles that confirm a template of a length
    for _, _, words in spaced:
        runs = set(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)}
        least[len(words)] = min(least.get(len(words), np.inf), (PERCENT / 100 - 1e-6) * len(runs))
        for run in runs:
            known.setdefault(run, set()).add(len(words))
    rivals = _rivals(spaced)
    table = spark.createDataFrame([(i, name, len(words), sorted(set(_shingles(words))), band_keys(_shingles(words)), rivals[i]) for i, name, words in spaced],
                                  "template int, license string, size int, wanted array<bigint>, keys array<bigint>, rivals array<struct<mine: array<bigint>, theirs: array<bigint>>>")

    def windows(words: list[str]) -> Iterator[tuple[int, int]]:
        """Start and length of the windows that hold shingles enough of the templates of their length."""
        runs = zip(words, words[1:], words[2:], words[3:], words[4:]) if len(words) >= SHINGLE else [tuple(words)]
        places: dict[int, list[int]] = {}
        for i, run in enumerate(runs):
            for length in known.get(run, ()):
                places.setdefault(length, []).append(i)
        for length, at in sorted(places.items()):
            stride, done = _stride(length), -1
            margin = stride // 2 + 1
            for p in at:
                first = max(0, -(-(p + SHINGLE - length) // stride))
                for k in range(max(first, done + 1), p // stride + 1):
                    done = k
                    if bisect_left(at, k * stride + length + margin) - bisect_left(at, k * stride - margin) >= least[length]:
                        yield k * stride, length

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, sizes, wide, keys = [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = text.split(" ") if text else []
                for start, length in windows(words):
                    margin = _stride(length) // 2 + 1
                    ids.append(doc)
                    starts.append(start)
                    sizes.append(length)
                    keys.append(band_keys(_shingles(words[start:start + length])))
                    wide.append(_shingles(words[max(0, start - margin):start + length + margin]))
            wide_type = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(wide, wide_type), pa.array(keys, wide_type)], names=["doc_id", "start", "size", "held", "window_keys"])

    signed = docs.select("doc_id", letter_spaced(F.col("text")).alias("text")).mapInArrow(sign, "doc_id bigint, start int, size int, held array<bigint>, window_keys array<bigint>")
    # The templates are a parameter of a few rows, and their keys a short table.
    bands = F.broadcast(table.select("template", "size", F.posexplode("keys").alias("band", "key")))
    asked = signed.select("doc_id", "start", "size", "held", F.posexplode("window_keys").alias("band", "key"))
    met = asked.join(bands, ["size", "band", "key"]).join(F.broadcast(table.select("template", "license", "wanted", "rivals")), "template")
    share = F.size(F.array_intersect("wanted", "held")) / F.size("wanted")

    def part(shingles: Column) -> Column:
        """Share of some shingles that the window holds; all of none."""
        return F.when(F.size(shingles) == 0, 1.0).otherwise(F.size(F.array_intersect(shingles, F.col("held"))) / F.size(shingles))

    own = F.forall("rivals", lambda r: part(r["mine"]) > part(r["theirs"]))
    confirmed = met.select("doc_id", "license", "template", "start", "size", F.round(share, 6).alias("containment"), own.alias("own")).filter((100 * F.col("containment") >= PERCENT) & F.col("own"))
    best = confirmed.groupBy("doc_id", "license", "template").agg(F.max(F.struct("containment", (-F.col("start")).alias("back"), "size")).alias("w"))
    return best.select("doc_id", "license", "template", "w.containment", (-F.col("w.back")).alias("start_word"), F.col("w.size").alias("n_words"))
