"""Alignment of two tokenizers' tokens, corpus-wide, each distinct text once.

Texts are shuffled whole, so that copies become one row with a count. A distinct text is encoded by both tokenizers in the
task that holds it; its tokens' byte ranges give the groups (cut where tokens of both end) and the links (pairs of
overlapping tokens). Texts of a batch lie one after another on one byte axis, so that this is a few numpy operations for all
of them. A text is written once, with its measures and its distinct linked pairs as packed numbers.

A pair's count, the documents that hold it linked, is the sum of the counts of texts: tasks add up their texts' pairs, the
sums are shuffled by pair. Counts come back to the texts by broadcast up to a checked number of pairs; beyond it pairs are
dealt into buckets, and each text sends its pairs of a bucket as one row to where the bucket's counts are. Measures are then
joined to the documents by two hashes of the text, copies of one text dealt over several tasks.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and
an empty string; special tokens' strings are plain text; null and repeated doc_ids are carried along; every text is aligned
whole; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .common import partitions, pick, spread_join, written

#: The pattern by which byte_bpe_50k.json's vocabulary was made to split texts before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Linked pairs whose counts are broadcast at most (17 bytes each); bytes of text aligned together.
MAX_PAIRS, TOGETHER = 2_000_000, 2 << 20
_LONG_RUN = 5000
_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = "k1 long, k2 long, n long, " + ", ".join(f"{m} long" for m in _MEASURES) + ", groups_sha256 string, pairs binary, links binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in the fewest of 1, 2 or 4 bytes each, behind a byte that says how many."""
    size = next(s for s in (1, 2, 4) if not len(numbers) or int(numbers.max()) < 1 << (8 * s))
    return bytes([size]) + numbers.astype(f"<u{size}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def ascending(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return packed(np.diff(numbers, prepend=0))


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokens:
    """byte-level BPE of a tokenizers file. A vocabulary in the order of its merges is encoded by rank, which gives the same ids sooner."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _bytes_of_letters()
        self.bytes = [b""] * (max(model["vocab"].values()) + 1)
        for entry, i in model["vocab"].items():
            self.bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)):
            ranks = {b: i for i, b in enumerate(self.bytes) if i < 256 + len(merges)}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        else:
            self.by_rank = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        # the rank encoder's pattern recurses over a run of white space
        by_rank = lambda t: self.by_rank and not (len(t) > _LONG_RUN and re.search(r"\s{%d}" % _LONG_RUN, t))
        return [self.by_rank.encode_ordinary(t) if by_rank(t) else self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokens:
    """A sentencepiece model."""

    def __init__(self, path: str) -> None:
        model = SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]
        self.encode = lambda texts: model.encode(texts, num_threads=1)


class Digits:
    """Ids as decimal digits with what follows them: one row for each id, one more for where it ends its group."""

    def __init__(self, size: int, inner: str, last: str) -> None:
        rows = [f"{i}{end}".encode() for i in range(size) for end in (inner, last)]
        self.sizes = np.array([len(r) for r in rows])
        self.rows = np.array(rows, dtype="S8").view(np.uint8).reshape(len(rows), 8)


@functools.lru_cache(1)
def _tools(path_a: str, path_b: str):
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    digits = [Digits(len(a.bytes), ",", "|"), Digits(len(b.bytes), ",", ";")]
    rows, sizes = np.concatenate([d.rows for d in digits]), np.concatenate([d.sizes for d in digits])
    lengths = [np.array([len(x) for x in t.bytes]) for t in (a, b)]
    return a, b, lengths, rows, sizes, len(b.bytes).bit_length()


def _texts_of(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive places."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])


def align(texts: list[str], path_a: str, path_b: str) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, packed pairs (a * 2^bits + b) and their links, for each text."""
    a, b, (length_a, length_b), rows, row_sizes, shift = _tools(path_a, path_b)
    out: list[tuple] = [(0, 0, 0, 0, "", packed(np.zeros(0)), packed(np.zeros(0)))] * len(texts)
    spaced = [" " + t for t in texts]
    lists_a, lists_b, raw = a.encode(spaced), b.encode(texts), [t.encode() for t in spaced]
    same = lambda ids, t, r: b"".join(map(t.bytes.__getitem__, ids)) == r
    kept = [i for i in range(len(texts)) if texts[i] and same(lists_a[i], a, raw[i]) and same(lists_b[i], b, raw[i])]
    if not kept:
        return out
    ids_a, ids_b = (np.concatenate([np.array(lists[i], dtype=np.int64) for i in kept]) for lists in (lists_a, lists_b))
    ends_a, ends_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    of_a, of_b = np.zeros(int(ends_a[-1]) + 1, dtype=bool), np.zeros(int(ends_a[-1]) + 1, dtype=bool)
    of_a[ends_a] = True
    of_b[ends_b] = True
    ends = np.flatnonzero(of_a | of_b)
    in_a, in_b = of_a[ends], of_b[ends]
    # each stretch between two ends belongs to one token of each tokenizer: one link
    pairs = ids_a[np.cumsum(in_a) - in_a] << shift | ids_b[np.cumsum(in_b) - in_b]
    to = np.searchsorted(ends, np.cumsum([0, *(len(raw[i]) for i in kept)]), side="right")
    text = np.repeat(np.arange(len(kept)), np.diff(to))
    keys, links = np.unique(text << 40 | pairs, return_counts=True)
    cut = np.searchsorted(keys, np.arange(len(kept) + 1) << 40)
    keys &= (1 << 40) - 1
    # groups in order: the A ids of a group, then its B ids
    last_a, last_b = of_b[ends_a], of_a[ends_b]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    before_b = np.cumsum(np.bincount(group_b, minlength=n))
    before_a = np.cumsum(np.bincount(group_a, minlength=n))
    code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    code[np.arange(len(ids_a)) + np.concatenate([[0], before_b])[group_a]] = 2 * ids_a + last_a
    code[np.arange(len(ids_b)) + before_a[group_b]] = 2 * (ids_b + len(length_a)) + last_b
    sizes = row_sizes[code]
    said = rows[code][np.arange(rows.shape[1]) < sizes[:, None]].tobytes()
    of = [np.array([len(lists[i]) for i in kept]) for lists in (lists_a, lists_b)]
    spans = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(of[0] + of[1])])].tolist()
    groups = _texts_of(to, in_a & in_b)
    for j, i in enumerate(kept):
        x, y = cut[j], cut[j + 1]
        out[i] = (int(of[0][j]), int(of[1][j]), int(groups[j]), int(to[j + 1] - to[j]), hashlib.sha256(said[spans[j] : spans[j + 1] - 1]).hexdigest(), ascending(keys[x:y]), packed(links[x:y]))
    return out


def _aligned(path_a: str, path_b: str):
    def run(batches):
        for batch in batches:
            k1, k2, n, texts = (c.to_pylist() for c in batch.columns)
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= TOGETHER):
                    size += len(texts[end])
                    end += 1
                rows = align(texts[begin:end], path_a, path_b)
                yield _batch([(*key, *row) for key, row in zip(zip(k1[begin:end], k2[begin:end], n[begin:end], strict=True), rows, strict=True)], _ALIGNED)
                begin = end

    return run


def _pairs_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw))


def _added(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate(pairs), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def _count(batches):
    """A task's texts added up; what is held is given out once it has grown past a million pairs."""
    pairs, counts, held = [], [], 0
    for batch in batches:
        for n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs.append(_pairs_of(raw))
            counts.append(np.full(len(pairs[-1]), n))
            held += len(pairs[-1])
            if held > 2_000_000:
                pair, count = _added(pairs, counts)
                pairs, counts, held = [pair], [count], len(pair)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "n"])
                    pairs, counts, held = [], [], 0
    if pairs:
        pair, count = _added(pairs, counts)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], names=["pair", "n"])


def pair_counts(aligned: DataFrame, shift: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its A id has more); written."""
    counts = written(aligned.select("n", "pairs").mapInArrow(_count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    of_a = F.shiftright("pair", shift).alias("a")
    best = counts.groupBy(of_a).agg(F.max("n").alias("most"))  # at most one row an id of the vocabulary
    return written(counts.withColumn("a", of_a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "pair-best")


_SCORES = "k1 long, k2 long, n_best long, count_sum long"


def _sums(raw_pairs: bytes, raw_links: bytes, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[int, int]:
    at, links = np.searchsorted(table[0], _pairs_of(raw_pairs)), unpacked(raw_links)
    return int((links * table[2][at]).sum()), int((links * table[1][at]).sum())


def _scored(table):
    def run(batches):
        for batch in batches:
            yield _batch([(k1, k2, *_sums(p, x, table.value)) for k1, k2, p, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _SCORES)

    return run


_DEALT = "bucket int, k1 long, k2 long, pairs binary, links binary, counts binary"


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def _deal_texts(buckets: int):
    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, raw, raw_links in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, links = _pairs_of(raw), unpacked(raw_links)
                bucket = _bucket(pairs, buckets)
                order = np.argsort(bucket, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    if len(part):
                        out.append((int(bucket[part[0]]), k1, k2, ascending(pairs[part]), packed(links[part]), None))
            yield _batch(out, _DEALT)

    return run


def _deal_counts(buckets: int):
    def run(batches):
        for batch in batches:
            pairs, counts, best = (c.to_numpy() for c in batch.columns)
            bucket, out = _bucket(pairs, buckets), []
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == b)
                at = at[np.argsort(pairs[at])]
                out.append((b, None, None, ascending(pairs[at]), packed(best[at]), counts[at].astype("<i8").tobytes()))
            yield _batch(out, _DEALT)

    return run


def _meet(batches):
    """Rows of buckets, a bucket's counts before its texts' pairs."""
    now, parts, table = None, [], None
    for batch in batches:
        out = []
        for bucket, k1, k2, pairs, links, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                now, parts, table = bucket, [], None
            if counts is not None:
                parts.append((_pairs_of(pairs), np.frombuffer(counts, dtype="<i8"), unpacked(links)))
                continue
            if table is None:
                table = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(table[0])
                table = tuple(x[order] for x in table)
            out.append((k1, k2, *_sums(pairs, links, table)))
        yield _batch(out, _SCORES)


def scores(aligned: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """k1, k2, n_best, count_sum of every text."""
    n = counts.count()
    texts = aligned.select("k1", "k2", "pairs", "links")
    if n <= max_pairs:
        table = counts.toPandas().sort_values("pair")
        shared = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy(dtype=np.int64) for c in ("pair", "n", "best")))
        return texts.mapInArrow(_scored(shared), _SCORES)
    buckets = 4 * -(-n // max_pairs)
    both = texts.mapInArrow(_deal_texts(buckets), _DEALT).unionByName(counts.mapInArrow(_deal_counts(buckets), _DEALT))
    both = both.repartition(max(partitions(aligned), buckets), "bucket").sortWithinPartitions("bucket", F.col("counts").isNull())
    return both.mapInArrow(_meet, _SCORES).groupBy("k1", "k2").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, max_pairs: int = MAX_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a row for each document; a row for each distinct text, with packed pairs; a row for each linked pair: a, b, n, best)."""
    import public_tokenizers

    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    shift = len(PieceTokens(path_b).bytes).bit_length()
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", F.col("text")).alias("text"))
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2")]
    texts = plain.where(F.col("text").isNotNull()).groupBy("text").agg(F.count("*").alias("n")).select(*keys, "n", "text")
    aligned = written(texts.mapInArrow(_aligned(path_a, path_b), _ALIGNED), "aligned")
    counts = pair_counts(aligned, shift)
    measures = aligned.select("k1", "k2", *_MEASURES, "groups_sha256").join(scores(aligned, counts, max_pairs), ["k1", "k2"])
    named = plain.select("doc_id", F.when(F.col("text").isNotNull(), keys[0]).alias("k1"), F.when(F.col("text").isNotNull(), keys[1]).alias("k2"))
    out = spread_join(named, measures, ["k1", "k2"], "doc_id", aligned.select("k1", "k2", "n"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*_MEASURES, "n_best", "count_sum")]
    table = counts.select(F.shiftright("pair", shift).alias("a"), (F.col("pair") % (1 << shift)).alias("b"), "n", (F.col("best") == 1).alias("best"))
    return out.select("doc_id", *numbers, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), aligned, table


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
