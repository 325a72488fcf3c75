"""Benchmark decontamination by word n-grams.

The windows of the benchmark (n consecutive words of an item; an item with fewer words, but not none, is one window)
form a hash set that is broadcast; every document is scanned once, in Arrow batches, and each hash hit is verified
word by word. The benchmark's size is checked first: beyond ``max_windows`` (500,000: about 100 MB in the driver and in each worker) it is
dealt into blocks of at most about that many windows, each broadcast on its own; each block scans the documents again, and the blocks' hits
are merged per document.

Defined results: null and empty texts have no words, no hits and are clean; items with null id or no words never match;
repeated item rows count once; an item longer than a block is a block of its own; repeated document rows are each judged; a null doc_id is carried along; further columns
are kept by :func:`decontaminate` and ignored by :func:`find_leaks`; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, pick

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SCAN = "row long, doc_id long, text_key long, n_words long, starts array<int>, ends array<int>, items array<string>"
_BITS = 20


class WindowSet:
    """Windows of some items by length: exact word ids behind 64-bit rolling hashes, in arrays of about 70 bytes a window of ten words."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        self.vocab: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (_, text) in enumerate(items):
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in folded_words(text)], dtype=np.int32)
            if len(ids):
                size = min(n, len(ids))
                by_size.setdefault(size, []).append((i, np.lib.stride_tricks.sliding_window_view(ids, size)))
        self.sizes = {}
        for size, found in by_size.items():
            rows, owner = np.concatenate([w for _, w in found]), np.repeat(np.array([i for i, _ in found], dtype=np.int32), [len(w) for _, w in found])
            factor = np.uint64(0x9E3779B97F4A7C15)
            while True:
                powers = np.array([pow(int(factor), j + 1, 1 << 64) for j in range(size)], dtype=np.uint64)
                hashes = np.zeros(len(rows), dtype=np.uint64)
                for j in range(size):
                    hashes += rows[:, j].astype(np.uint64) * powers[j]
                order = np.argsort(hashes, kind="stable")
                hashes, sorted_rows = hashes[order], rows[order]
                new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
                first = np.flatnonzero(new)
                if (sorted_rows == sorted_rows[first[np.cumsum(new) - 1]]).all():  # equal hashes are equal windows
                    break
                factor += np.uint64(2)
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[hashes[first] >> np.uint64(64 - _BITS)] = True
            self.sizes[size] = (powers, hashes[first], sorted_rows[first], np.append(first, len(rows)), owner[order], seen)

    def scan(self, ids: np.ndarray):
        """(size, position, index of window) of verified hits; ids: words of many documents, 0 for others and between documents."""
        for size, (powers, hashes, rows, _, _, seen) in self.sizes.items():
            if len(ids) < size:
                continue
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            h = np.zeros(len(at), dtype=np.uint64)
            for j in range(size):
                h += ids[at + j].astype(np.uint64) * powers[j]
            maybe = seen[h >> np.uint64(64 - _BITS)]
            at, h = at[maybe], h[maybe]
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, k = at[same], k[same]
            if len(at):
                same = (ids[at[:, None] + np.arange(size)] == rows[k]).all(axis=1)
                yield size, at[same], k[same]

    def names(self, size: int, window: int) -> list[str]:
        """The items that have a window."""
        bounds, owner = self.sizes[size][3:5]
        return [self.items[i] for i in owner[bounds[window] : bounds[window + 1]].tolist()]


def _scanner(shared):
    def run(batches):
        found: WindowSet = shared.value
        get = found.vocab.get
        for batch in batches:
            rows, doc, keys, texts = (batch.column(i).to_pylist() for i in range(4))
            ids, n_words, offset = [], [], [0]
            for text in texts:
                words = folded_words(text)
                n_words.append(len(words))
                ids.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int64, count=len(words)))
                ids.append(np.zeros(1, dtype=np.int64))
                offset.append(offset[-1] + len(words) + 1)
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int64)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for size, at, k in found.scan(flat):
                which = np.searchsorted(offset, at, side="right") - 1
                for d, p in zip(which.tolist(), at.tolist(), strict=True):
                    spans.setdefault(d, []).append((p - offset[d], p - offset[d] + size))
                for d, w in set(zip(which.tolist(), k.tolist(), strict=True)):
                    items.setdefault(d, set()).update(found.names(size, w))
            merged = [_merge(spans.get(d, ())) for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()), pa.array(doc, pa.int64()), pa.array(keys, pa.int64()), pa.array(n_words, pa.int64()),
                    pa.array([[a for a, _ in x] for x in merged], pa.list_(pa.int32())), pa.array([[b for _, b in x] for x in merged], pa.list_(pa.int32())),
                    pa.array([sorted(items.get(d, ())) for d in range(len(texts))], pa.list_(pa.string())),
                ],
                names=["row", "doc_id", "text_key", "n_words", "starts", "ends", "items"],
            )

    return run


def _merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def window_blocks(benchmark: DataFrame, n: int, max_windows: int) -> list[DataFrame]:
    """The benchmark's items in blocks of about max_windows words at most; a word starts one window at most."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2 + 1
    blocks = -(-words // max_windows)
    return [items] if blocks == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) for b in range(blocks)]


def _scan(docs: DataFrame, benchmark: DataFrame, n: int, max_windows: int) -> DataFrame:
    """docs: row, doc_id, text_key, text. One row for each: the merged word spans that are hit, and the items."""
    spark, out = docs.sparkSession, None
    blocks = window_blocks(benchmark, n, max_windows)
    for block in blocks:
        # one block is bounded by max_windows, whatever the benchmark's size
        shared = spark.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"]) for r in block.toLocalIterator()], n))
        hits = docs.mapInArrow(_scanner(shared), _SCAN)
        out = hits if out is None else out.unionByName(hits)
    if len(blocks) > 1:
        out = out.groupBy("row", "doc_id", "text_key", "n_words").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = out.withColumn("spans", F.array_sort(F.arrays_zip("starts", "ends"))).select("row", "doc_id", "text_key", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items")
    return out


def _hit_words(starts, ends):
    """Words in the union of sorted spans; spans of several blocks may overlap."""
    spans = F.arrays_zip(starts.alias("starts"), ends.alias("ends"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(spans, none, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["ends"].cast("long") - F.greatest(acc["to"], s["starts"].cast("long")))).alias("n"), F.greatest(acc["to"], s["ends"].cast("long")).alias("to")), lambda acc: acc["n"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_windows: int = 500_000) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_words, n_hit, n_items, items, starts, ends (word spans) and contaminated, a row for each row of docs."""
    plain = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    hits = _scan(plain, pick(benchmark, "item_id", "text"), n, max_windows)
    hits = hits.withColumn("n_hit", _hit_words(F.col("starts"), F.col("ends")))
    return hits.select("doc_id", "text_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "starts", "ends", (F.col("n_hit") > 0).alias("contaminated"))


def _without(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the spans; one space stands for what lay between a span's words."""
    words = list(_WORD.finditer(text or ""))
    out, at = [], 0
    for a, b in _merge(zip(starts or (), ends or (), strict=True)):  # texts without spans come here too
        out.append(text[at : words[a].start()])
        at = words[b - 1].end()
    return "".join([*out, (text or "")[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "documents", max_windows: int = 500_000) -> DataFrame:
    """docs without leaked documents, or (action="spans") with the leaked words cut out of their texts; columns as in docs."""
    if action not in ("documents", "spans"):
        raise ValueError("action is documents or spans")
    leaks = find_leaks(docs, benchmark, n, max_windows).where("contaminated")
    spans = leaks.groupBy(F.col("doc_id").alias("_leaked"), F.col("text_key").alias("_key")).agg(F.first(F.struct("starts", "ends")).alias("_spans"))
    same = docs["doc_id"].cast("long").eqNullSafe(spans["_leaked"]) & (F.xxhash64(docs["text"]) == spans["_key"])
    if action == "documents":
        return docs.join(spans, same, "left_anti")
    cut = F.udf(_without, "string", useArrow=True)
    text = F.when(spans["_spans"].isNull(), docs["text"]).otherwise(cut(docs["text"], spans["_spans.starts"], spans["_spans.ends"])).alias("text")
    return docs.join(spans, same, "left").select(*[text if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_leaks(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM bw),
di AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
hits AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS l FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
