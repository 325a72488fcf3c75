"""Substring dedup: fuzzy passages that repeat across documents, by collinear chaining of shared k-mer seeds.

Equal texts are one node from the start; their copies are reported as whole. Seeds are the k-word grams with the smallest
hash in each window of w grams (every exact run of w + k - 1 words that two texts share gives both the same seed). A seed's
occurrences are joined to one anchor text, the first that holds it, so a passage that a third of all documents share costs
a row per occurrence and no pair of them is enumerated. A text's matches are chained per anchor text: a Fenwick tree over
the anchor's positions finds the best predecessor, gaps cost in proportion to their words, and predecessors that overlap
are compared as well. Chains are aligned: gaps between matches by longest common subsequence, ends by extension while words
go on agreeing. A chain may run over words that differ: it is cut at its gaps into the passages of at least ``min_words``
words and ``min_identity`` that hold most of its equal words, each verified alone. Alignment reads ``margin`` words beyond
a chain; where an end grows up to that edge, the chain is aligned again with sixteen times as many.

Anchors alone would lose a passage whose seeds have different first holders, each of which holds less than a passage. So
every run of ``min_words`` words that the passages found so far do not cover, and whose seeds all occur in earlier texts, is
hashed whole and joined to the first text that holds the same run; as few of these as cover the same words are reported.
Thus, of every exact repeat of ``min_words`` words or more between two texts, all words lie in reported passages. Edited passages are found where two seeds of one anchor
remain: a chain's ends grow by alignment past words that one side has more; the README states the recall.

Repeats inside one document are not reported. Defined results: null and empty texts and texts shorter than k words have no
passages; a copy's passage is its whole text, if that has ``min_words`` words; repeated rows are copies of each other; very
long texts are taken whole; of ties the first in input order is the anchor; a null doc_id is carried along; further columns
are ignored or, in :func:`cut_passages`, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, WordHashes, few, folded_words, gram_hashes, pick, spread_join, text_keys, written

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ALIGNED = "row long, source long, start long, end long, source_start long, source_end long, matched long, identity double"


#: A seed's place is its position times this, plus the words from the seed before it, which are at most a window's.
STEP = 64


def seed_positions(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window of grams, the first of equal ones; of all grams where there are fewer."""
    n = len(grams) - window + 1
    if n < 2:
        return np.array([int(grams.argmin())]) if len(grams) else np.zeros(0, dtype=np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = grams[j : n + j] < best
        at[less] = np.flatnonzero(less) + j
        np.minimum(best, grams[j : n + j], out=best)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def places(pos: np.ndarray) -> np.ndarray:
    """Positions with the distance to the one before, 0 for the first."""
    return pos * STEP + np.diff(pos, prepend=pos[:1])


def _seeder(k: int, window: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            grams, at, sizes = [], [], []
            for text in batch.column(4).to_pylist():
                words = hashes.of(folded_words(text))
                g = gram_hashes(words, k)
                pos = seed_positions(g, window)
                g, place = g[pos], places(pos)
                if len(pos) > 1:
                    order = np.argsort(g, kind="stable")
                    again = order[1:][g[order[1:]] == g[order[:-1]]]
                    place[again] = ~place[again]  # a seed's later places in a text are negative
                grams.append(g.view(np.int64))
                at.append(place)
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(grams, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64()))], names=["row", "doc_id", "k1", "k2", "n_words", "grams", "at"])

    return run


class Fenwick:
    """Prefix maxima of (score, item) over positions."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def before(self, i: int) -> tuple[float, int]:
        """The largest at positions below i."""
        out = (float("-inf"), -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def runs(pos: np.ndarray, other: np.ndarray, k: int, gap: int) -> list[tuple[int, int, int]]:
    """Matches on one diagonal at most ``gap`` words apart as (start, other start, words)."""
    order = np.lexsort((pos, pos - other))
    p, o = pos[order], other[order]
    new = np.flatnonzero(np.concatenate([[True], (p - o)[1:] != (p - o)[:-1]]) | np.concatenate([[True], p[1:] - p[:-1] > gap]))
    last = np.concatenate([new[1:], [len(p)]]) - 1
    return list(zip(p[new].tolist(), o[new].tolist(), (p[last] - p[new] + k).tolist(), strict=True))


def one_run(pos: list[int], other: list[int], k: int, gap: int) -> list[int] | None:
    """The piece, if all matches make one."""
    shift, last = pos[0] - other[0], None
    for p, o in sorted(zip(pos, other, strict=True)):
        if p - o != shift or last is not None and p - last > gap:
            return None
        last = p
    low = min(pos)
    return [low, low - shift, last - low + k]


def chain(pieces: list[tuple[int, int, int]], cost: float) -> list[list[tuple[int, int, int]]]:
    """Chains of pieces that ascend in both texts, the best first.

    A chain's score is its words less ``cost`` for each word of its gaps; words that two neighbours overlap by count once.
    A piece's best predecessor among those that end before it is found by the Fenwick tree, over ends in the other text in
    the order of ends in this one; those that overlap it stand next to it in order of starts.
    """
    pieces = sorted(pieces)
    n = len(pieces)
    p, o, size = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
    longest = int(size.max())
    ends = sorted(range(n), key=lambda i: pieces[i][0] + pieces[i][2])
    spots = np.unique(o + size)
    rank = np.searchsorted(spots, o + size).tolist()  # a piece's place among the ends
    upto = np.searchsorted(spots, o, side="right").tolist()
    by_other = np.argsort(o, kind="stable")
    sorted_o = o[by_other]
    near = np.searchsorted(p, p - longest, side="right").tolist()
    low, high = np.searchsorted(sorted_o, o - longest, side="right").tolist(), np.searchsorted(sorted_o, o).tolist()
    tree, score, back, e = Fenwick(len(spots)), np.zeros(n), [-1] * n, 0
    for i, (a, b, m) in enumerate(pieces):
        while e < n and pieces[ends[e]][0] + pieces[ends[e]][2] <= a:
            j = ends[e]
            tree.put(rank[j], (score[j] + cost * (pieces[j][0] + pieces[j][1] + 2 * pieces[j][2]), j))
            e += 1
        value, best = tree.before(upto[i])
        value -= cost * (a + b)
        if i - near[i] > 0 or high[i] > low[i]:
            js = np.concatenate([np.arange(near[i], i), by_other[low[i] : high[i]]])
            js = js[(js < i) & (o[js] < b) & ((p[js] + size[js] > a) | (o[js] + size[js] > b))]
            if len(js):
                left, right = a - p[js] - size[js], b - o[js] - size[js]  # gaps; negative where they overlap
                values = score[js] - cost * (left + right) - np.maximum(0, -np.minimum(left, right))
                x = int(values.argmax())
                if values[x] > value:
                    value, best = float(values[x]), int(js[x])
        if value > 0:
            back[i] = best
        score[i] = max(value, 0.0) + m
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        found = []
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(pieces[i])
            i = back[i]
        if found:
            out.append(found[::-1])
    return out


def _chainer(k: int, gap: int, cost: float, least: int):
    """Chains of at least ``least`` words by row and source."""

    def run(batches):
        for batch in batches:
            rows = {n: [] for n in ("row", "source", "pieces")}
            for row, source, pos, other in _matches(batch):
                cuts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])).tolist() + [len(source)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b - a == 1 and k < least:
                        continue
                    if (simple := one_run(pos[a:b].tolist(), other[a:b].tolist(), k, gap)) is not None:
                        if simple[2] >= least:
                            rows["row"].append(row)
                            rows["source"].append(int(source[a]))
                            rows["pieces"].append(simple)
                        continue
                    for found in chain(runs(pos[a:b], other[a:b], k, gap), cost):
                        if found[-1][0] + found[-1][2] - found[0][0] >= least:
                            rows["row"].append(row)
                            rows["source"].append(int(source[a]))
                            rows["pieces"].append([x for piece in found for x in piece])
            yield _chains(rows)

    return run


def _coverer(size: int):
    """Of matching runs of ``size`` words, as few pieces as cover the words of all."""

    def run(batches):
        for batch in batches:
            rows = {n: [] for n in ("row", "source", "pieces")}
            for row, source, pos, other in _matches(batch):
                cuts = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])).tolist() + [len(source)]
                pieces = sorted((*x, int(source[a])) for a, b in zip(cuts, cuts[1:], strict=False) for x in runs(pos[a:b], other[a:b], size, 1))
                for p, o, n, src in covering(pieces):
                    rows["row"].append(row)
                    rows["source"].append(src)
                    rows["pieces"].append([p, o, n])
            yield _chains(rows)

    return run


def covering(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The fewest of the sorted pieces (start, other start, words, source) whose words are those of all."""
    out, end, i = [], -1, 0
    while i < len(pieces):
        if pieces[i][0] > end:
            end = pieces[i][0]
        best = None
        while i < len(pieces) and pieces[i][0] <= end:
            if best is None or pieces[i][0] + pieces[i][2] > best[0] + best[2]:
                best = pieces[i]
            i += 1
        if best[0] + best[2] > end:
            out.append(best)
            end = best[0] + best[2]
    return out


def _matches(batch):
    """row, source, pos and other, by source, of each row's matches to earlier texts."""
    for row, matches in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        m = matches.values
        source, pos, other = (m.field(n).to_numpy(zero_copy_only=False) for n in ("source", "at", "other"))
        later = source != row
        source, pos, other = source[later], pos[later] // STEP, other[later] // STEP
        if len(source):
            order = np.argsort(source, kind="stable")
            yield row, source[order], pos[order], other[order]


def _chains(rows: dict[str, list]):
    return pa.RecordBatch.from_arrays([pa.array(rows["row"], pa.int64()), pa.array(rows["source"], pa.int64()), pa.array(rows["pieces"], pa.list_(pa.int64()))], names=["row", "source", "pieces"])


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel: a step for each word of the longer side, over bits of the shorter one."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for w in b.tolist():
        if at := places.get(w):
            met = rows & at
            rows = ((rows + met) | (rows - met)) & full
    return len(a) - rows.bit_count()


def extension(a: np.ndarray, b: np.ndarray, drop: int = 4) -> tuple[int, int, bool]:
    """How many words from the beginning of both on agree (a mismatch costs one; it ends ``drop`` below the best), how many of them are equal, and whether it came to the end of the shorter one."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0, True
    for most in (64, n):  # most extensions are short
        same = a[: min(most, n)] == b[: min(most, n)]
        score = np.cumsum(np.where(same, 1, -1))
        low = np.flatnonzero(score <= np.maximum(np.maximum.accumulate(score), 0) - drop)
        if len(low):
            same, score = same[: low[0]], score[: low[0]]
            break
        if most >= n:
            break
    best = int(score.argmax()) if len(score) else 0
    if not len(score) or score[best] <= 0:
        return 0, 0, not len(low)
    return best + 1, int(same[: best + 1].sum()), not len(low)


def end_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Words of a and of b, and how many are equal, in the best alignment from the beginnings of both (equal 1, each edit -1; of ties, with most equal words)."""
    # a score and the equal words behind it in one number
    slope = 1000 * np.arange(len(b) + 1, dtype=np.int64)
    row, top = -slope, (0, 0, 0)
    for i, w in enumerate(a.tolist()):
        start = row - 1000
        start[1:] = np.maximum(start[1:], row[:-1] + np.where(b == w, 1001, -1000))
        row = np.maximum.accumulate(start + slope) - slope
        j = int(row.argmax())
        if row[j] > top[0]:
            top = (int(row[j]), i + 1, j)
    return top[1], top[2], top[0] % 1000


def end_growth(a: np.ndarray, b: np.ndarray, edited: bool, window: int = 64) -> tuple[int, int, int, bool]:
    """How far an end grows into a and into b, how many of these words are equal, and whether it came to the end of one.

    The ends of an edited passage grow past words that one side has more: by alignment, a window at a time.
    """
    i, same, edge = extension(a, b)
    j = i
    while edited and not edge:
        x, y, more = end_alignment(a[i : i + window], b[j : j + window])
        i, j, same = i + x, j + y, same + more
        edge = min(len(a) - i, len(b) - j) < window  # what follows may matter
        if 2 * max(x, y) < window:
            break
    return i, j, same, edge


def blocks(a: np.ndarray, b: np.ndarray, pieces: list[tuple[int, int, int]], most: int = 8, least: int = 4) -> list[tuple[int, int, int, int]]:
    """A chain's pieces without overlaps, cut where ``most`` words in a row differ, as (start, other start, words, equal words). Grams are hashed, so words are compared."""
    out, i, j = [], 0, 0
    for s, t, n in pieces:
        cut = max(i - s, j - t, 0)  # overlaps the piece before
        s, t, n = s + cut, t + cut, n - cut
        if n <= 0:
            continue
        i, j = s + n, t + n
        same = np.flatnonzero(a[s:i] == b[t:j]).tolist()
        if len(same) == n:
            out.append((s, t, n, n))
            continue
        first = 0
        for x in range(1, len(same) + 1):
            if x == len(same) or same[x] - same[x - 1] > most:
                if x - first >= least:
                    out.append((s + same[first], t + same[first], same[x - 1] + 1 - same[first], x - first))
                first = x
    return out


def align(a: np.ndarray, b: np.ndarray, pieces: list[tuple[int, int, int]], min_words: int, min_identity: float, joint: int = 8) -> tuple[list[tuple[int, int, int, int, int]], bool, bool]:
    """The passages in a chain, as (start, end, source start, source end, equal words), and whether extension came to the beginning and to the end of a or b.

    Of all ways to cut the chain at gaps into passages of ``min_words`` and ``min_identity``, the one whose blocks hold most
    equal words; among those, a gap stays inside a passage if its different words outnumber its equal ones by at most ``joint``.
    """
    parts = [[s, t, s + n, t + n, e] for s, t, n, e in blocks(a, b, pieces)]
    m = len(parts)
    if not m:
        return [], False, False
    inside, worth, edges = [0] * m, [0] * m, [False, False]
    edited = m > 1 or parts[0][4] < parts[0][2] - parts[0][0] or parts[0][4] < min_words
    n, n2, same, edges[0] = end_growth(a[: parts[0][0]][::-1], b[: parts[0][1]][::-1], edited)
    parts[0] = [parts[0][0] - n, parts[0][1] - n2, *parts[0][2:4], parts[0][4] + same]
    n, n2, same, edges[1] = end_growth(a[parts[-1][2] :], b[parts[-1][3] :], edited)
    parts[-1] = [*parts[-1][:2], parts[-1][2] + n, parts[-1][3] + n2, parts[-1][4] + same]
    for x in range(1, m):  # ends grow into the gap before part x, then its other words are aligned
        (_, _, i, j, _), (s, t, _, _, _) = parts[x - 1], parts[x]
        n, same, _ = extension(a[i:s], b[j:t])
        parts[x - 1][2:] = [i + n, j + n, parts[x - 1][4] + same]
        i, j = i + n, j + n
        n, same, _ = extension(a[i:s][::-1], b[j:t][::-1])
        parts[x][:2], parts[x][4] = [s - n, t - n], parts[x][4] + same
        s, t = s - n, t - n
        inside[x] = common_words(a[i:s], b[j:t]) if s > i and t > j else 0
        worth[x] = 2 * inside[x] - max(s - i, t - j)
    low, low2, high, high2, e = (np.array(c, dtype=np.int64) for c in zip(*parts, strict=True))
    equal, gaps, gains = (np.concatenate([[0], np.cumsum(c)]) for c in (e, inside, worth))

    def matched(x, y):
        return equal[y + 1] - equal[x] + gaps[y + 1] - gaps[x + 1]

    best, start = np.zeros(m + 1, np.int64), [-1] * m
    for y in range(m):
        x = np.arange(y + 1)
        size = high[y] - low[x]
        fit = (size >= min_words) & (matched(x, y) >= min_identity * np.maximum(size, high2[y] - low2[x]))
        value = np.where(fit, best[x] + (equal[y + 1] - equal[x]) * 1_000_000 + gains[y + 1] - gains[x + 1] - joint, -1)
        best[y + 1] = best[y]
        if value.max() > best[y]:
            start[y] = int(value.argmax())
            best[y + 1] = value[start[y]]
    out, y = [], m - 1
    while y >= 0:
        x = start[y]
        if x >= 0:
            out.append((int(low[x]), int(high[y]), int(low2[x]), int(high2[y]), int(matched(x, y))))
            y = x
        y -= 1
    return out[::-1], edges[0], edges[1]


def _hasher(batches):
    """Texts as binary strings of 64-bit word hashes."""
    hashes = WordHashes()
    for batch in batches:
        words = [hashes.of(folded_words(t)).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.binary())], names=["k1", "k2", "words"])


def _aligner(min_words: int, min_identity: float):
    """Aligns the words around both sides of a chain: row, source, pieces, where the words begin in both, whether they are all there, words of both."""

    def run(batches):
        for batch in batches:
            out = []
            for row, source, pieces, low, low2, first, last, raw, raw2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(raw, dtype=np.uint64), np.frombuffer(raw2, dtype=np.uint64)
                shifted = [(pieces[i] - low, pieces[i + 1] - low2, pieces[i + 2]) for i in range(0, len(pieces), 3)]
                found, left, right = align(a, b, shifted, min_words, min_identity)
                if (left and not first) or (right and not last):
                    out.append((row, source, None, None, None, None, None, None, pieces))
                    continue
                for start, end, s0, s1, matched in found:
                    out.append((row, source, start + low, end + low, s0 + low2, s1 + low2, matched, matched / max(end - start, s1 - s0), None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[*(x.split()[0] for x in _ALIGNED.split(", ")), "again"])

    return run


def _verified(plain: DataFrame, keys: DataFrame, matches: DataFrame, chainer, min_words: int, min_identity: float, margin: int) -> DataFrame:
    """Passages (row, source, start, end, source_start, source_end, matched, identity) in the chains of matches (row, list of source, at, other)."""
    chains = written(matches.mapInArrow(chainer, "row long, source long, pieces array<long>"), "chains")
    nodes = chains.select("row").unionByName(chains.select(F.col("source").alias("row"))).distinct()
    named = written(keys.join(few(nodes), "row").select("row", "k1", "k2"), "chain-nodes")
    texts = plain.select("k1", "k2", "text").join(few(named.select("k1", "k2")), ["k1", "k2"]).select("k1", "k2", "text").mapInArrow(_hasher, "k1 long, k2 long, words binary").dropDuplicates(["k1", "k2"])
    words = written(named.join(texts, ["k1", "k2"]).select("row", "words", (F.octet_length("words") / 8).cast("long").alias("size")), "chain-words")
    x = lambda i: F.element_at("pieces", i)
    out = None
    while True:
        # many chains may have one source: its words are cut to the chain in the JVM before they move on
        cut = lambda low, high: F.substring("words", (8 * low + 1).cast("int"), (8 * (high - low)).cast("int"))
        spans = chains.withColumn("low", F.greatest(x(1) - margin, F.lit(0))).withColumn("low2", F.greatest(x(2) - margin, F.lit(0)))
        for side, base, at, of in (("row", "low", -3, "a"), ("source", "low2", -2, "b")):
            counts = written(spans.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("n")), "chain-counts")
            high = F.least(x(at) + x(-1) + margin, F.col("size"))
            mine = words.withColumnRenamed("row", "node").join(few(counts.select("node")), "node", "left_semi")  # words of this side's texts alone move
            spans = spread_join(spans.withColumn("node", F.col(side)).withColumn("by", F.xxhash64("row", "source", "pieces")), mine, ["node"], "by", counts)
            spans = spans.withColumn(of, cut(F.col(base), high)).withColumn(f"last_{of}", high == F.col("size")).drop("words", "size", "node", "by")
        both = spans.select("row", "source", "pieces", "low", "low2", ((F.col("low") == 0) | (F.col("low2") == 0)).alias("first"), (F.col("last_a") | F.col("last_b")).alias("last"), "a", "b")
        aligned = written(both.mapInArrow(_aligner(min_words, min_identity), f"{_ALIGNED}, again array<long>"), "aligned")
        done = aligned.where("again is null").drop("again")
        out = done if out is None else out.unionByName(done)
        chains = aligned.where("again is not null").select("row", "source", F.col("again").alias("pieces"))
        if not chains.limit(1).count():
            return out
        margin *= 16


def _open_runs(k: int, window: int, size: int, later: bool):
    """Ranges of starts of runs of ``size`` words that have none but the given seeds, less those inside spans; and the seeds of those ranges, named by their anchors.

    later: only runs that may have an earlier holder; a text that is itself the anchor of one of a run's seeds is the first to hold the run.
    """

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("row", "low", "high", "source", "other")}
            for row, seeds, n_words, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m = seeds.values
                source, at, other = (m.field(n).to_numpy(zero_copy_only=False) for n in ("source", "at", "other"))
                if later:
                    keep = source != row
                    source, at, other = source[keep], at[keep], other[keep]
                order = np.argsort(at)
                source, at, other = source[order], at[order], other[order]
                pos = at // STEP
                ranges = [(a, min(b, n_words - size + 1)) for a, b in shared_runs(at, k, window, size)]
                for low, high in without(ranges, [(a, b - size + 1) for a, b in union((s["start"], s["end"]) for s in spans or ())]):
                    inside = slice(*np.searchsorted(pos, [low, high + size]))
                    for n, v in zip(out, (row, low, high, source[inside] if later else (), other[inside] if later else ()), strict=True):
                        out[n].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def shared_runs(at: np.ndarray, k: int, window: int, size: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of starts of runs of ``size`` words that may have nothing but shared seeds. at: sorted places of the text's shared seeds.

    Seeds from ``window`` - 1 words behind a run's start to ``window`` + k - 2 words before its end are decided by the run alone, so two texts that
    share the run share them; neighbouring ones are at most ``window`` words apart.
    """
    if not len(at):
        return []
    pos, step = at // STEP, at % STEP
    new = np.flatnonzero(np.concatenate([[True], (pos - step)[1:] != pos[:-1]]))
    last = np.concatenate([new[1:], [len(pos)]]) - 1
    low = np.maximum(pos[new] - 2 * window + 2, 0)
    high = pos[last] - (size - k - 2 * window + 1)
    return union((a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b)


def union(ranges) -> list[tuple[int, int]]:
    """Disjoint ranges [low, high) that hold what these hold."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(ranges: list[tuple[int, int]], gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges [low, high) less other ranges."""
    out = []
    for low, high in ranges:
        for a, b in sorted(gone):
            if b <= a or b <= low or a >= high:
                continue
            if a > low:
                out.append((low, a))
            low = max(low, b)
        if low < high:
            out.append((low, high))
    return out


def _run_hashes(size: int):
    """The hash of every run of ``size`` words that starts in the given ranges of a text, and whether it lies in an open one."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for row, text, ranges, open_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = gram_hashes(hashes.of(folded_words(text)), size)
                wanted, first = np.zeros(len(grams) + 1, dtype=np.int8), np.zeros(len(grams) + 1, dtype=np.int8)
                for flags, parts in ((wanted, ranges), (wanted, open_), (first, open_)):
                    for r in parts or ():
                        flags[r["low"] : r["high"]] = 1
                at = np.flatnonzero(wanted[: len(grams)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row, dtype=np.int64)), pa.array(grams[at].view(np.int64)), pa.array(at), pa.array(first[at].astype(bool))], names=["row", "gram", "pos", "open"])

    return run


def _exact(plain: DataFrame, keys: DataFrame, shared: DataFrame, found: DataFrame, k: int, window: int, size: int) -> DataFrame | None:
    """Matches (row, list of source, at, other) of the runs of ``size`` words that no passage in found covers, to the first text that holds the same run."""
    spans = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    open_ = written(shared.join(spans, "row", "left").select("row", "seeds", "n_words", "spans").mapInArrow(_open_runs(k, window, size, True), "row long, low long, high long, source array<long>, other array<long>"), "open")
    if not open_.limit(1).count():
        return None
    wanted = written(open_.select(F.explode(F.arrays_zip("source", "other")).alias("x")).select("x.source", "x.other").distinct(), "open-seeds")
    # only runs of these seeds can be the same
    held = shared.select("row", "n_words", F.explode("seeds").alias("x")).select("row", "n_words", "x.source", "x.at", "x.other").join(few(wanted), ["source", "other"], "left_semi")
    held = held.groupBy("row").agg(F.collect_list(F.struct("source", "at", "other")).alias("seeds"), F.max("n_words").alias("n_words"))  # bounded by the text's seeds
    none = F.lit(None).cast("array<struct<start:long,end:long>>").alias("spans")
    all_runs = held.select("row", "seeds", "n_words", none).mapInArrow(_open_runs(k, window, size, False), "row long, low long, high long, source array<long>, other array<long>")
    listed = lambda df, name: df.groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias(name))  # noqa: E731  bounded by the text's words
    ranges = listed(all_runs, "ranges").join(listed(open_, "open"), "row", "left")
    ranges = written(ranges.join(keys.select("row", "k1", "k2"), "row"), "ranges")
    texts = plain.select("k1", "k2", "text").join(few(ranges.select("k1", "k2")), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    grams = written(texts.join(ranges, ["k1", "k2"]).select("row", "text", "ranges", "open").mapInArrow(_run_hashes(size), "row long, gram long, pos long, open boolean"), "run-hashes")
    first = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("row").alias("source"), F.max("row").alias("last"), F.min_by("pos", F.struct("row", "pos")).alias("other"), F.max("open").alias("any"))
    first = written(first.where("any and source <> last").select("gram", "n", "source", "other"), "first-runs")
    both = spread_join(grams.where("open").select("row", "gram", "pos"), first.drop("n"), ["gram"], "row", first.select("gram", "n")).where("row <> source")
    return both.groupBy("row").agg(F.collect_list(F.struct("source", (F.col("pos") * STEP).alias("at"), (F.col("other") * STEP).alias("other"))).alias("seeds"))  # bounded by the text's words


def _hot_grams(seeds: DataFrame, of: int = 64, least: int = 1000) -> DataFrame:
    """The grams that more than about ``least`` texts share, or more of a larger table, so that they are :data:`HOT_KEYS` or so at most. Counted in every
    ``of``-th text: this only decides which of two ways a gram takes to the same result."""
    some = written(seeds.where(F.pmod(F.xxhash64("row"), F.lit(of)) == 0).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    most = max(least, (some.agg(F.sum("n")).first()[0] or 0) * of // HOT_KEYS)
    return written(some.where(F.col("n") * of > most).select("gram"), "hot-grams")


def _anchored(seeds: DataFrame) -> DataFrame:
    """row, at, source, other of the seeds (row, gram, at) that several texts hold: their first text and the place there.

    Seeds move once, by gram; hot grams do not move at all, their anchors come from partial minima and are broadcast.
    """
    hot = _hot_grams(seeds)
    # a text has one place that is not negative for each seed
    key = F.col("row") * 2 + (F.col("at") < 0).cast("long")
    anchor = [F.count_if(F.col("at") >= 0).alias("n"), F.min(key).alias("first"), F.min_by("at", key).alias("other")]
    anchors = lambda df: df.groupBy("gram").agg(*anchor).where("n > 1").select("gram", F.shiftright("first", 1).alias("source"), "other")
    cold = seeds.join(F.broadcast(hot), "gram", "left_anti").repartition("gram")
    out = cold.join(anchors(cold).hint("merge"), "gram")
    if hot.limit(1).count():
        warm = seeds.join(F.broadcast(hot), "gram")  # HOT_KEYS or so
        out = out.unionByName(warm.join(F.broadcast(written(anchors(warm), "hot-anchors")), "gram"))
    return out.select("row", F.greatest("at", F.bitwise_not("at")).alias("at"), "source", "other")


def repeated_passages(docs: DataFrame, k: int = 5, window: int = 6, min_words: int = 50, min_identity: float = 0.8, gap: int = 40, cost: float = 0.1, margin: int = 128) -> DataFrame:
    """A row for each passage of a document that an earlier document (by input order) holds too: word spans in both, equal words, identity, and the text keys of the document."""
    if min_words < k + 3 * window or window >= STEP:
        raise ValueError(f"min_words must be at least k + 3 * window, and window less than {STEP}")
    plain = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), F.coalesce("text", F.lit("")).alias("text"))
    seeded = written(plain.mapInArrow(_seeder(k, window), "row long, doc_id long, k1 long, k2 long, n_words long, grams array<long>, at array<long>"), "seeds")
    keys = seeded.select("row", "doc_id", "k1", "k2", "n_words")
    repeated = written(keys.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count("*").alias("n")).where("n > 1"), "repeated")
    copies = written(spread_join(keys, repeated.drop("n"), ["k1", "k2"], "row", repeated.drop("node")).where("row <> node").select("row", "node", "n_words"), "copies")
    texts = seeded.join(few(copies.select("row")), "row", "left_anti")
    seeds = texts.select("row", F.explode(F.arrays_zip(F.col("grams").alias("gram"), "at")).alias("x")).select("row", "x.gram", "x.at")
    shared = _anchored(seeds)
    shared = shared.select("row", F.struct("source", "at", "other").alias("x"), F.lit(None).cast("long").alias("n_words"))
    sized = shared.unionByName(texts.where(F.col("n_words") >= min_words).select("row", "n_words"), allowMissingColumns=True)
    shared = sized.groupBy("row").agg(F.collect_list("x").alias("seeds"), F.max("n_words").alias("n_words")).where("n_words is not null and size(seeds) > 0")
    shared = written(shared, "shared-seeds")  # bounded by the text's seeds
    found = _verified(plain, keys, shared, _chainer(k, gap, cost, 2 * k), min_words, min_identity, margin)
    exact = _exact(plain, keys, shared, found, k, window, min_words)
    if exact is not None:
        found = found.unionByName(_verified(plain, keys, exact, _coverer(min_words), min_words, min_identity, margin))
    whole = copies.where(F.col("n_words") >= min_words).select("row", F.col("node").alias("source"), F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.lit(0).cast("long").alias("source_start"), F.col("n_words").alias("source_end"), F.col("n_words").alias("matched"), F.lit(1.0).alias("identity"))
    # chains of one document and source that grew into the same passage
    found = found.groupBy("row", "source", "start", "end").agg(F.max(F.struct("identity", "matched", "source_start", "source_end")).alias("x"))
    found = written(found.select("row", "source", "start", "end", "x.source_start", "x.source_end", "x.matched", "x.identity").unionByName(whole), "passages")
    counts = written(found.groupBy("source").agg(F.count("*").alias("n")), "source-counts")
    ids = keys.select(F.col("row").alias("source"), F.col("doc_id").alias("source_id"))
    out = spread_join(found.join(keys.drop("n_words"), "row"), ids.join(few(counts.select("source")), "source", "left_semi"), ["source"], "row", counts)
    return out.select("doc_id", "start", "end", "source_id", "source_start", "source_end", "matched", F.round("identity", 6).alias("identity"), "k1", "k2")


def _cutter(batches):
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([_without(text, spans) for text, spans in rows], pa.string())], names=[*batch.schema.names[:-2], "cut"])


def _without(text: str, spans: list[dict]) -> str:
    words, out, at, done = list(_WORD.finditer(text)), [], 0, 0
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if b > done:
            a = max(a, done)
            out.append(text[at : words[a].start()])
            at, done = words[b - 1].end(), b
    return "".join([*out, text[at:]])


def cut_passages(docs: DataFrame, **settings) -> DataFrame:
    """docs with every passage cut that an earlier document holds; columns as in docs. A whole copy keeps what stands around its words.

    Rows of one text and doc_id are cut alike.
    """
    none = F.lit(-(2**63))
    spans = repeated_passages(docs, **settings).groupBy(F.coalesce("doc_id", none).alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    spans = written(spans, "spans")
    texts = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), none).alias("_id"), F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(7), F.col("text")).alias("_k2"), "text")
    cut = texts.join(spans, ["_id", "_k1", "_k2"]).dropDuplicates(["_id", "_k1", "_k2"]).mapInArrow(_cutter, "_id long, _k1 long, _k2 long, cut string")
    cut = cut.withColumnRenamed("cut", "_cut")
    same = (F.coalesce(docs["doc_id"].cast("long"), none) == cut["_id"]) & (F.xxhash64(docs["text"]) == cut["_k1"]) & (F.xxhash64(F.lit(7), docs["text"]) == cut["_k2"])
    text = F.coalesce(cut["_cut"], docs["text"]).alias("text")
    return docs.join(cut, same, "left").select(*[text if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op9_collinear(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("k1", "k2")
