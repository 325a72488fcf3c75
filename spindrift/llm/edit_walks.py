"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its first character on. At each step it writes down the current character and goes on to the next
one, or stays, as a shared random bit for (step, character) says. Two texts that differ by few edits are written down almost
alike: after an edit the walks drift until they meet again. So edit distance becomes Hamming distance, never less than half
the edit distance. Steps up to the next set bit are tabled, so a walk costs one look-up a character.

Of the steps below a power of two, at most ``SAMPLES`` random ones are sampled, half of them below the power before and then
among its own, and each sampled step keeps one random bit of its character. A text takes the smallest power not below its walk's end, so texts of any length are read whole,
and those of different lengths still share the sampled steps that both have. A fingerprint is, for each of the ``WALKS``
walks, its end and these bits in hexadecimal. :func:`likeness` estimates the share of equal steps from the bits, steps of the
longer walk alone counting as different, and takes the walk that shows most.

:func:`edited_neighbours` deals the texts by range of descending doc_id, and compares each with the next in a sorted
stream, so texts move once; where two ranges meet, the outermost texts of each range (two a partition) are compared by a join.
:func:`near_classes` bands sampled bits, compares the texts of a bucket with one of them by fingerprint, and verifies by edit
distance.

Defined results: null texts are empty, and empty texts have ends of 0 and are alike (1.0); null doc_ids come after all
others; rows of one doc_id are taken by hash of text; repeated rows follow one another; a single row is its own next one;
further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, pick, spread_join, text_keys, text_or_empty, written

WALKS, SAMPLES = 2, 512
#: Random bits repeat after so many steps; the least power of two of a walk; characters walked before samples are looked up.
PERIOD, LEAST, CHUNK = 1 << 14, 6, 1 << 20
#: Characters that are walked side by side; fewer lanes than _FEW are walked one by one.
GROUP, _FEW, _DEEPEST = 1 << 22, 40, 44


def classes_of(text: str) -> bytes:
    """A byte for each character; all of Latin-1 stays apart."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return ((points ^ (points >> 8)) & 0xFF).astype(np.uint8).tobytes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _stays(walk: int) -> list[bytes]:
    """For each class and step (modulo the period): the steps until the walk has left the character."""
    bits = np.random.default_rng(1000 + walk).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    at = np.arange(2 * PERIOD)
    following = np.minimum.accumulate(np.where(np.tile(bits, 2) == 1, at, 4 * PERIOD)[:, ::-1], axis=1)[:, ::-1]
    return [row.tobytes() for row in (following - at + 1)[:, :PERIOD].astype(np.uint8)]


@functools.cache
def _samples(walk: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(all steps that are sampled for some power of two, ascending; for each power the places of its own among them)."""
    rng = np.random.default_rng(2000 + walk)
    kept = np.arange(1 << LEAST)
    own = [kept] * (LEAST + 1)
    for power in range(LEAST + 1, _DEEPEST):
        low = 1 << (power - 1)
        more = np.arange(low, 2 * low) if 2 * low <= SAMPLES else low + np.unique(rng.integers(0, low, SAMPLES // 2))
        # of the steps below, a random half stays: what a text's sample lacks no longer text has below its end
        kept = rng.permutation(np.concatenate([kept[: SAMPLES - len(more)], more]))
        own.append(kept)
    steps = np.unique(np.concatenate(own))
    return steps, [np.searchsorted(steps, np.sort(x)) for x in own]


@functools.cache
def _bits(walk: int) -> np.ndarray:
    """The random bit of each sampled step and class."""
    steps = _samples(walk)[0].astype(np.uint64)
    return (_mix(steps[:, None] * np.uint64(512) + np.arange(256, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def _printed(walk: int, end: int, seen: np.ndarray) -> str:
    """End and bits, from the classes that the walk saw at the own steps of its power (in ascending order)."""
    own = _samples(walk)[1][_power(end)]
    bits = _bits(walk)[own, seen]
    bits[_samples(walk)[0][own] >= end] = 0
    return f"{end:x}-{np.packbits(bits).tobytes().hex()}"


class Walk:
    """One walk over one text of any length, which may go on from any point."""

    def __init__(self, walk: int, end: int = 0, seen: np.ndarray | None = None) -> None:
        self.walk, self.end = walk, end
        self.seen = np.zeros(len(_samples(walk)[0]), dtype=np.uint8) if seen is None else seen

    def copy(self) -> Walk:
        return Walk(self.walk, self.end, self.seen.copy())

    def go(self, classes: bytes) -> Walk:
        stays, steps, mask = _stays(self.walk), _samples(self.walk)[0], PERIOD - 1
        for i in range(0, len(classes), CHUNK):
            part, t = classes[i : i + CHUNK], self.end
            left = np.array([t := t + stays[c][t & mask] for c in part])
            a, b = np.searchsorted(steps, (self.end, t))
            self.seen[a:b] = np.frombuffer(part, dtype=np.uint8)[np.searchsorted(left, steps[a:b], side="right")]
            self.end = t
        return self

    def fingerprint(self) -> str:
        return _printed(self.walk, self.end, self.seen[_samples(self.walk)[1][_power(self.end)]])


def _power(end: int) -> int:
    return max(LEAST, (end - 1).bit_length())


def fingerprint(text: str | None) -> str:
    classes = classes_of(text or "")
    return ".".join(Walk(w).go(classes).fingerprint() for w in range(WALKS))


@functools.lru_cache(4096)
def _common(walk: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The steps sampled for the higher power, and where those below the lower one stand in both samples."""
    steps, own = _samples(walk)
    both, at_low, at_high = np.intersect1d(own[low], own[high], assume_unique=True, return_indices=True)
    return steps[own[high]], at_low, at_high


def _parsed(print_: str) -> list[tuple[int, np.ndarray]]:
    return [(int(end, 16), np.unpackbits(np.frombuffer(bytes.fromhex(bits), dtype=np.uint8))) for end, bits in (x.split("-") for x in print_.split("."))]


def likeness(a: str, b: str) -> float:
    """0 to 1: the estimated share of equal steps, of the walk that shows most."""
    if a == b:
        return 1.0
    best = 0.0
    for walk, ((end_a, bits_a), (end_b, bits_b)) in enumerate(zip(_parsed(a), _parsed(b), strict=True)):
        if end_a > end_b:
            end_a, bits_a, end_b, bits_b = end_b, bits_b, end_a, bits_a
        steps, at_a, at_b = _common(walk, _power(end_a), _power(end_b))
        inside = steps[at_b] < end_a
        equal = (bits_a[at_a] == bits_b[at_b]) & inside
        best = max(best, (2 * int(equal.sum()) - int(inside.sum())) / max(1, int((steps < end_b).sum())))
    return best


_ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OPEN = f"part int, first boolean, last boolean, {_ROWS}, text string"
_KINDS = {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[x.split() for x in schema.split(", ")], strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _advance(codes: np.ndarray, start: np.ndarray, size: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Many walks side by side: lane i walks on from step t[i] over size[i] codes (walk, class and a place for the step).

    (the step at which each character is left, where each lane's begin, the last step of each lane). Lanes are sorted by
    size; the last few long ones go on one by one.
    """
    order = np.argsort(-size, kind="stable")
    at = np.zeros(len(size), dtype=np.int64)
    at[order] = np.cumsum(size[order]) - size[order]
    left, end = np.zeros(int(size.sum()), dtype=np.int64), t.astype(np.int64)
    table = _steps_table()
    place, out, now, sizes, mask = start[order].astype(np.int64), at[order].copy(), end[order], size[order], PERIOD - 1
    i, k = 0, int((sizes > 0).sum())
    while k >= _FEW:
        p, o, n = place[:k], out[:k], now[:k]
        for _ in range(int(sizes[k - 1]) - i):
            key = codes[p]
            key += n & mask
            n += table[key]
            left[o] = n
            p += 1
            o += 1
        i = int(sizes[k - 1])
        k = int(np.searchsorted(-sizes, -i, side="left"))
    flat = table.tobytes() if k else b""
    for j in range(k):
        a, step = int(place[j]), int(now[j])
        rest = codes[a : a + int(sizes[j]) - i].tolist()
        left[int(out[j]) : int(out[j]) + len(rest)] = [step := step + flat[c + (step & mask)] for c in rest]
        now[j] = step
    end[order] = now
    return left, at, end


@functools.cache
def _steps_table() -> np.ndarray:
    return np.frombuffer(b"".join(row for w in range(WALKS) for row in _stays(w)), dtype=np.uint8)


def _head(text: str) -> int:
    """Where the last third begins."""
    return len(text) - len(text) // 3


def _side_by_side(texts: list[str]) -> tuple[list[str], list[str]]:
    """(fingerprints of the texts; of each but the last, with its last third taken from the next one)."""
    classes = [np.frombuffer(classes_of(t), dtype=np.uint8) for t in texts]
    begin = np.cumsum([0, *map(len, classes)])
    flat = np.concatenate([*classes, np.zeros(0, dtype=np.uint8)])
    # classes of all texts once for each walk, so that a code is its row of the table of steps
    codes = np.concatenate([(flat.astype(np.int32) + 256 * w) * PERIOD for w in range(WALKS)])
    heads, n = np.array([_head(t) for t in texts]), len(texts)
    sizes = np.array([len(c) for c in classes])
    thirds = sizes - heads
    lanes = lambda x, shift=True: np.concatenate([x + (w * len(flat) if shift else 0) for w in range(WALKS)])
    left, at, end = _advance(codes, lanes(begin[:-1]), lanes(heads, False), np.zeros(n * WALKS, dtype=np.int64))
    # own last thirds, then the next texts' beginnings
    follow = np.minimum(thirds[:-1], sizes[1:])
    head_ends = end.reshape(WALKS, n)
    tails = np.concatenate([lanes(begin[:-1] + heads), lanes(begin[1:-1])])
    starts = np.concatenate([end, head_ends[:, :-1].ravel()])
    left2, at2, end2 = _advance(codes, tails, np.concatenate([lanes(thirds, False), lanes(follow, False)]), starts)

    def printed(i: int, w: int, lane: int, first: int, size: int) -> str:
        last, middle = int(end2[lane]), int(head_ends[w, i])
        steps = _samples(w)[0][_samples(w)[1][_power(last)]]
        seen, cut, used = np.zeros(len(steps), dtype=np.uint8), *np.searchsorted(steps, (middle, last))
        a = int(at[w * n + i])
        seen[:cut] = flat[begin[i] + np.searchsorted(left[a : a + heads[i]], steps[:cut], side="right")]
        a = int(at2[lane])
        seen[cut:used] = flat[first + np.searchsorted(left2[a : a + size], steps[cut:used], side="right")]
        return _printed(w, last, seen)

    own = [".".join(printed(i, w, w * n + i, begin[i] + heads[i], thirds[i]) for w in range(WALKS)) for i in range(n)]
    edited = [".".join(printed(i, w, WALKS * n + w * (n - 1) + i, begin[i + 1], follow[i]) for w in range(WALKS)) for i in range(n - 1)]
    return own, edited


def _one_by_one(text: str, following: str) -> tuple[str, str]:
    """The same for one text of any length, in chunks."""
    head, classes = _head(text), classes_of(text)
    walks = [Walk(w).go(classes[:head]) for w in range(WALKS)]
    own = ".".join(w.copy().go(classes[head:]).fingerprint() for w in walks)
    return own, ".".join(w.go(classes_of(following[: len(text) - head])).fingerprint() for w in walks)


def compared(texts: list[str]) -> tuple[list[tuple], str]:
    """(of each text but the last: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; the last one's fingerprint)."""
    if max(map(len, texts)) <= GROUP:
        own, edited = _side_by_side(texts)
    else:
        both = [_one_by_one(a, b) for a, b in zip(texts, [*texts[1:], ""], strict=True)]
        own, edited = [x for x, _ in both], [x for _, x in both[:-1]]
    out = []
    for i, (text, following) in enumerate(zip(texts, texts[1:], strict=False)):
        head = _head(text)
        sha = hashlib.sha256((text[:head] + following[: len(text) - head]).encode("utf-8", "replace")).hexdigest()
        out.append((len(text), sha, own[i], edited[i], likeness(own[i], edited[i]), likeness(own[i], own[i + 1])))
    return out, own[-1]


def _neighbours(batches):
    """Rows of one range in order; of the last row, which needs the next range, and of the first one the texts are kept."""
    part, ids, texts, size, first = TaskContext.get().partitionId(), [], [], 0, True

    def done():
        nonlocal ids, texts, size, first
        rows = [(part, first and i == 0, False, ids[i], *row, texts[i] if first and i == 0 else None) for i, row in enumerate(compared(texts)[0])]
        first, ids, texts, size = first and not rows, ids[-1:], texts[-1:], len(texts[-1])
        return _batch(rows, _OPEN)

    for batch in batches:
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size > GROUP and len(texts) > 1:
                yield done()
    if texts:
        yield done()
        yield _batch([(part, first, True, ids[0], *[None] * 6, texts[0])], _OPEN)


def _meet(batches):
    for batch in batches:
        yield _batch([(doc_id, *compared([text, following])[0][0]) for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _ROWS)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """For each row: its fingerprint, that of its text with the last third taken from the next row's, and both likenesses."""
    spark: SparkSession = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    found = written(rows.mapInArrow(_neighbours, _OPEN), "neighbours")
    # one number a partition
    parts = sorted(r["part"] for r in found.where("last").select("part").collect())
    following = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    ends = found.where("last").select("part", "doc_id", "text").join(F.broadcast(following), "part")
    starts = found.where("first").select(F.col("part").alias("next"), F.col("text").alias("following"))
    met = ends.join(starts, "next").select("doc_id", "text", "following").mapInArrow(_meet, _ROWS)
    return found.where("not last").select(*met.columns).unionByName(met)


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Edits from a to b, bit-parallel over whole columns; stops once more than ``most`` are sure."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = sorted((a[start : len(a) - end], b[start : len(b) - end]), key=len)
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for i, c in enumerate(b):
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | (full & ~(across | up)), up & across
        score += bool(rises & high) - bool(falls & high)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | (full & ~(vertical | rises)), rises & vertical
        if most is not None and score - (len(b) - 1 - i) > most:
            return most + 1
    return score


def _band_keys(bands: int, bits: int):
    def run(batches):
        for batch in batches:
            out = []
            for node, print_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for walk, (end, found) in enumerate(_parsed(print_)):
                    steps, own = _samples(walk)
                    power = _power(end)
                    # a text meets those of its own power and of the next one by the steps that all of these have
                    for label in (power, power - 1):
                        inside = np.flatnonzero((steps[own[power]] < 1 << (label - 1)) & np.isin(own[power], own[max(label, LEAST)]))
                        rng = np.random.default_rng(label * 131 + walk)
                        if len(inside) == 0:
                            out.append((node, f"{walk}:{label}:{print_}"))
                            continue
                        for band in range(bands):
                            chosen = inside[rng.integers(0, len(inside), bits)]
                            out.append((node, f"{walk}:{label}:{band}:" + np.packbits(found[chosen]).tobytes().hex()))
            yield _batch(out, "node long, bucket string")

    return run


def _alike(least: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            yield _batch([(p, q) for p, q, s, t in zip(a, b, x, y, strict=True) if likeness(s, t) >= least], "a long, b long")

    return run


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            out = []
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                longest = max(len(s), len(t), 1)
                most = int((1 - threshold) * longest + 1e-9)
                distance = edit_distance(s, t, most)
                if distance <= most:
                    out.append((a, b, 1 - distance / longest))
            yield _batch(out, "a long, b long, similarity double")

    return run


def _prints(batches):
    for batch in batches:
        yield _batch([(*row, fingerprint(text)) for *row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)], "id long, k1 long, k2 long, fingerprint string")


def near_classes(docs: DataFrame, threshold: float = 0.9, bands: int = 32, bits: int = 24, least: float = 0.4) -> DataFrame:
    """doc_id and class_id (the smallest doc_id) of each row: texts linked by an edit similarity of at least the threshold.

    In each bucket of ``bits`` equal sampled bits every text is compared with one of them, chosen by hash and so another one
    in every bucket: by fingerprint first, which must show ``least``, then by edit distance. Texts with few edits a hundred
    characters meet in most buckets; the tests measure the recall.
    """
    null = 2**63 - 1
    keyed = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null)).alias("id"), text_or_empty().alias("text")).select("id", *text_keys(), "text")
    prints = written(keyed.mapInArrow(_prints, "id long, k1 long, k2 long, fingerprint string"), "prints")
    nodes = prints.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("fingerprint").alias("fingerprint"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "print-nodes")
    in_bucket = nodes.select("node", "fingerprint").mapInArrow(_band_keys(bands, bits), "node long, bucket string").select("node", F.xxhash64("bucket").alias("bucket"))
    shared = written(in_bucket.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node", "bucket")).alias("pivot")).where("n > 1"), "print-buckets")
    pairs = spread_join(in_bucket, shared.select("bucket", "pivot"), ["bucket"], "node", shared.select("bucket", "n")).where("node <> pivot")
    pairs = written(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "print-pairs")
    side = lambda df, key, name, column: df.select(F.col("node").alias(key), F.col(column).alias(name))
    counts = lambda df: df.groupBy("a").agg(F.count("*").alias("n"))
    both = spread_join(pairs.join(side(nodes, "b", "y", "fingerprint"), "b"), side(nodes, "a", "x", "fingerprint"), ["a"], "b", written(counts(pairs), "print-counts"))
    alike = written(both.select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long"), "print-alike")
    wanted = nodes.join(alike.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "id", "k1", "k2")
    texts = written(keyed.join(wanted, ["id", "k1", "k2"]).dropDuplicates(["node"]).select("node", "text"), "print-texts")
    both = spread_join(alike.join(side(texts, "b", "t", "text"), "b"), side(texts, "a", "s", "text"), ["a"], "b", written(counts(alike), "print-counts"))
    links = written(both.select("a", "b", "s", "t").mapInArrow(_verified(threshold), "a long, b long, similarity double"), "print-links")
    whole = nodes.join(components(links.select("a", "b")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = whole.select("k1", "k2", "component").join(whole.groupBy("component").agg(F.min("id").alias("class_id")), "component")
    real = lambda c: F.when(F.col(c) != null, F.col(c))
    return prints.select("id", "k1", "k2").join(whole, ["k1", "k2"]).select(real("id").alias("doc_id"), real("class_id").alias("class_id"))


def op12_edit_walks(spark, sf_dir: str) -> DataFrame:
    return edited_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
