"""License scans by diagonal voting.

Every rolling word k-gram of a text is hashed and joined to the positions where license templates hold the same k-gram.
A match at word i of the text and j of the template lies on diagonal i - j: hits are counted by diagonal, neighbouring
diagonals (insertions and deletions shift a copy by a few words) are merged into spans, and each span is verified by the
longest common subsequence of its words with the template's. Templates shorter than k words vote with one gram of their
whole length, so a phrase is found exactly where its words stand consecutively.

The template table is bounded (it is part of the code or a parameter; its grams are counted before they are broadcast).
A semi-join on the gram hashes runs where the grams are made, so only grams that have a template position leave the scan.

Defined results: null and empty texts have no words and no labels; repeated rows are scanned each; a null doc_id is
carried along; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WordHashes, folded_words, gram_hashes, pick, written

# Phrases and labels of the base rule, then well-known license notices (public texts) by label.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]

MAX_GRAMS = 100_000
_GRAMS = "row long, doc_id long, n_words long, pos array<int>, gram array<long>, words array<long>"


def default_templates() -> list[tuple[str, str, bool]]:
    """(label, text, whether it is a base phrase)."""
    return [(label, phrase, True) for phrase, label in BASE] + [(label, text, False) for label, text in NOTICES]


def template_grams(templates: list[tuple[str, str, bool]], k: int) -> tuple[list[list[bytes]], list[tuple[int, int, int, int]]]:
    """The templates' words, and (gram, template, position, k) of all their grams."""
    words = [folded_words(text) for _, text, _ in templates]
    grams, hashes = [], WordHashes()
    for t, w in enumerate(words):
        size = min(k, len(w))
        if size:
            found = gram_hashes(hashes.of(w), size).view(np.int64)
            grams += [(int(h), t, j, size) for j, h in enumerate(found.tolist())]
    if len(grams) > MAX_GRAMS:
        raise ValueError(f"{len(grams)} template grams; scan in runs of at most {MAX_GRAMS}")
    return words, grams


def _scanner(sizes: list[int], wanted: np.ndarray):
    def run(batches):
        known = WordHashes()
        for batch in batches:
            rows, docs, texts = (c.to_pylist() for c in batch.columns)
            n_words, pos, gram, kept = [], [], [], []
            for text in texts:
                words = folded_words(text)
                ids = known.of(words)
                at, found = [], []
                for k in sizes:
                    h = gram_hashes(ids, k).view(np.int64)
                    i = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    hit = np.flatnonzero(wanted[i] == h)
                    at.append(hit)
                    found.append(h[hit])
                at, found = np.concatenate(at).astype(np.int32), np.concatenate(found)
                n_words.append(len(words))
                pos.append(at)
                gram.append(found)
                kept.append(ids.view(np.int64) if len(at) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(n_words, pa.int64()), pa.array(pos, pa.list_(pa.int32())), pa.array(gram, pa.list_(pa.int64())), pa.array(kept, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_words", "pos", "gram", "words"],
            )

    return run


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a row of the table at a time."""
    best = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        step = np.maximum(best[1:], best[:-1] + (b == x))
        best[1:] = np.maximum.accumulate(step)
    return int(best[-1])


def _verifier(words: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            row, text, spans = (c.to_pylist() for c in batch.columns)
            out = []
            for r, w, found in zip(row, text, spans, strict=True):
                w = np.array(w, dtype=np.int64).view(np.uint64)
                for s in found:
                    t = words[s["template"]]
                    start, end = max(0, s["start"]), min(len(w), s["end"])
                    out.append((r, s["template"], start, end, common_words(t, w[start:end]) / len(t)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["row", "template", "start", "end", "similarity"])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str, bool]] | None = None, k: int = 5, drift: int = 4, min_similarity: float = 0.8) -> DataFrame:
    """row, doc_id, n_words, spans (array of label, base, start, end, similarity: those verified), a row for each row of docs."""
    spark, templates = docs.sparkSession, default_templates() if templates is None else templates
    words, grams = template_grams(templates, k)
    plain = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = np.unique(np.array([g[0] for g in grams] or [0], dtype=np.int64))
    scanned = written(plain.mapInArrow(_scanner(sorted({g[3] for g in grams}) or [k], wanted), _GRAMS), "license-grams")
    table = spark.createDataFrame(grams, "gram long, template int, tpos int, size int")
    names = spark.createDataFrame([(t, label, base, len(w)) for t, ((label, _, base), w) in enumerate(zip(templates, words, strict=True))], "template int, label string, base boolean, length int")
    hits = scanned.select("row", F.explode(F.arrays_zip("pos", "gram")).alias("x")).select("row", "x.pos", "x.gram").join(F.broadcast(table), "gram")  # at most MAX_GRAMS rows
    votes = hits.groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("size")).alias("last"))
    votes = votes.join(F.broadcast(names), "template")
    order = W.partitionBy("row", "template").orderBy("diagonal")
    # a base phrase is one place for each diagonal; of notices, diagonals within the drift are one span
    opens = F.col("base") | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > drift)
    spans = votes.withColumn("span", F.sum(opens.cast("int")).over(order)).groupBy("row", "template", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.first("length").alias("length"), F.first("base").alias("base"))
    # a span reaches from where the template would begin to where it would end; a copy of a short part of a notice stays below the similarity
    start, end = F.least("low", "first"), F.greatest(F.col("high") + F.col("length"), F.col("last"))
    spans = spans.select("row", F.struct("template", F.when(F.col("base"), F.col("first")).otherwise(start).alias("start"), F.when(F.col("base"), F.col("last")).otherwise(end).alias("end")).alias("s"))
    candidates = spans.groupBy("row").agg(F.collect_list("s").alias("spans"))  # bounded by the document's length
    checked = scanned.where("words is not null").select("row", "words").join(candidates, "row").select("row", "words", "spans")
    hashes = WordHashes()
    arrays = [hashes.of(w) for w in words]
    verified = checked.mapInArrow(_verifier(arrays), "row long, template int, start long, end long, similarity double").where(F.col("similarity") >= min_similarity)
    verified = verified.join(F.broadcast(names), "template").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "base", "start", "end", "similarity"))).alias("spans"))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:bigint,end:bigint,similarity:double>>")
    return scanned.select("row", "doc_id", "n_words").join(verified, "row", "left").withColumn("spans", F.coalesce("spans", empty))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["start"])).alias("first_word"), F.array_max(F.transform(base, lambda s: s["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0)).alias("score"),
    )
