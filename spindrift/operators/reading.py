"""Reading aids: local alignment of reads to texts beside decoys, and gaps in texts filled by a letter model."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ngrams
from .graph import written
from .resampling import draw, resample_weights

#: Runs of words that a read shares with more texts than this are dealt over several tasks.
HOT = 1000
#: Words of a block of a text.
BLOCK = 32
#: Cells of the rows of tables that are made together.
CELLS = 100_000
#: So many reads are broadcast.
MOST_READS = 100_000
#: So many runs of reads are broadcast.
MOST_RUNS = 200_000
#: Tables of so many grams are broadcast.
MOST_GRAMS = 100_000


def decoys(reads: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """reads with draw 0 (as they are) and 1 to n: each read's words in an order drawn by hash of key, place and draw. w: an array of words."""
    numbered = reads.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n))))
    place = lambda i: draw(F.pmod(F.col(key).cast("long"), F.lit(1_000_003)) * 4096 + i.cast("long"), F.col("draw").cast("long"), seed)
    mixed = F.transform(F.array_sort(F.transform("w", lambda w, i: F.struct(place(i).alias("p"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    return numbered.withColumn("w", F.when(F.col("draw") == 0, F.col("w")).otherwise(mixed))


def align(a: list[str], b: list[str], match: int, mismatch: int, gap: int) -> tuple[int, int, int, int, int]:
    """(score, places of the first and after the last word in a and in b) of the best local alignment; the first end in b, then in a, of those that tie."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x, y = (np.array([codes.get(w, -3) for w in t], dtype=np.int64) for t in (a, b))
    return tuple(align_many([x], [y], match, mismatch, gap)[0].tolist())


def align_many(a: list[np.ndarray], b: list[np.ndarray], match: int, mismatch: int, gap: int) -> np.ndarray:
    """:func:`align` of each a with its b, arrays of word numbers; those of like sizes are aligned together, one row of all tables at a time."""
    size_a, size_b = (np.array([len(t) for t in side], dtype=np.int64) for side in (a, b))
    out, order = np.zeros((len(a), 5), dtype=np.int64), np.lexsort((size_b, size_a // 8))
    start = 0
    while start < len(order):
        # as many as fill the cells at the width of the last of them
        width = np.maximum.accumulate(size_b[order[start : start + CELLS]]) + 1
        stop = start + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), CELLS, "right")))
        some = order[start:stop]
        out[some] = _align_block([a[i] for i in some], [b[i] for i in some], match, mismatch, gap)
        start = stop
    return out


def _padded(arrays: list[np.ndarray], filler: int) -> np.ndarray:
    """One column for each array; fillers equal no word."""
    out = np.full((max(map(len, arrays)), len(arrays)), filler, dtype=np.int32)
    for i, x in enumerate(arrays):
        out[: len(x), i] = x
    return out


def _align_block(a: list[np.ndarray], b: list[np.ndarray], match: int, mismatch: int, gap: int) -> np.ndarray:
    out = np.zeros((len(a), 5), dtype=np.int64)
    y, x = _padded(b, -2), _padded(a, -1)
    small = np.int16 if (match + mismatch + gap) * (len(x) + len(y) + 2) < 2**15 else np.int32
    slope = (gap * np.arange(len(y) + 1, dtype=small))[:, None]
    row, start = (np.zeros((len(y) + 1, len(a)), dtype=small) for _ in range(2))
    score, end_a, end_b = (np.zeros(len(a), dtype=np.int64) for _ in range(3))
    for i, code in enumerate(x):
        start[0] = 0
        np.multiply(y == code, small(match + mismatch), out=start[1:])
        start[1:] += row[:-1] - small(mismatch)
        np.maximum(start[1:], row[1:] - small(gap), out=start[1:])
        np.maximum(start, small(0), out=start)
        start += slope
        np.subtract(np.maximum.accumulate(start, axis=0), slope, out=row)  # gaps along b
        high = row.max(axis=0)
        at = np.flatnonzero((high >= score) & (high > 0))
        place = row[:, at].argmax(axis=0)
        better = (high[at] > score[at]) | (place < end_b[at])
        at = at[better]
        score[at], end_a[at], end_b[at] = high[at], i + 1, place[better]
    found = np.flatnonzero(score)
    if len(found):
        # the same alignments read backwards from their ends begin where they ended; of b they take no more than a can pay for
        most = end_b - end_a - end_a * match // gap if gap else 0 * end_b
        back_a = [a[i][: end_a[i]][::-1] for i in found]
        back_b = [b[i][max(0, most[i]) : end_b[i]][::-1] for i in found]
        used_a, used_b = best_anchored(back_a, back_b, match, mismatch, gap, score[found])
        out[found] = np.stack([score[found], end_a[found] - used_a, end_a[found], end_b[found] - used_b, end_b[found]], axis=1)
    return out


def best_anchored(a: list[np.ndarray], b: list[np.ndarray], match: int, mismatch: int, gap: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each a and b in the shortest alignment from the beginnings of both that reaches the score."""
    y = _padded(b, -2)
    slope = (gap * np.arange(len(y) + 1, dtype=np.int32))[:, None]
    row = np.repeat(-slope, len(a), axis=1)
    used_a, used_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(a), dtype=np.int64)
    for i, code in enumerate(_padded(a, -1)):
        start = np.empty_like(row)
        start[0] = -gap * (i + 1)
        np.maximum(row[:-1] + np.where(y == code, np.int32(match), np.int32(-mismatch)), row[1:] - gap, out=start[1:])
        row = np.maximum.accumulate(start + slope, axis=0) - slope
        at = np.flatnonzero((used_a == 0) & (row.max(axis=0) >= score))
        used_a[at], used_b[at] = i + 1, (row[:, at] >= score[at]).argmax(axis=0)
        if used_a.all():
            return used_a, used_b
    raise AssertionError("a local alignment has no beginning")


def _aligned(match: int, mismatch: int, gap: int):
    """Rows of Arrow batches aligned: read, draw, key, blocks (numbers), pieces (their words), _a. Blocks that follow each other are one text."""

    def run(batches):
        for batch in batches:
            blocks, pieces, reads = (batch.column(batch.schema.get_field_index(c)) for c in ("blocks", "pieces", "_a"))
            inner = pieces.values
            words = pa.concat_arrays([reads.values, inner.values]).dictionary_encode()
            codes = words.indices.fill_null(len(words.dictionary)).to_numpy()
            of_read, of_word = codes[: len(reads.values)], codes[len(reads.values) :]
            number, first, at, ends = blocks.values.to_numpy(), blocks.offsets.to_numpy(), pieces.offsets.to_numpy(), inner.offsets.to_numpy()
            read_at = reads.offsets.to_numpy()
            a, b, rows, shift = [], [], [], []
            for r in range(batch.num_rows):
                own = number[first[r] : first[r + 1]]
                cuts = [0, *(np.flatnonzero(np.diff(own) != 1) + 1).tolist(), len(own)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    a.append(of_read[read_at[r] : read_at[r + 1]])
                    b.append(of_word[ends[at[r] + i] : ends[at[r] + j]])
                    rows.append(r)
                    shift.append(int(own[i]) * BLOCK)
            found = align_many(a, b, match, mismatch, gap)
            found[:, 3:] += np.array(shift, dtype=np.int64)[:, None]
            rows = np.array(rows, dtype=np.int64)
            order = np.lexsort((found[:, 2], found[:, 4], -found[:, 0], rows))
            best = order[np.unique(rows[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(found[best, c], pa.int32()) for c in range(5)]], names=[*batch.schema.names[:3], "score", "first_a", "after_a", "first_b", "after_b"])

    return run


def _runs(k: int, wanted: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """Rows of Arrow batches (keys and, last, words) with size, the places and hashes of their runs of k words, and the blocks near these with their words.

    wanted: sorted hashes, and how many words before and behind the run are near; None for all runs and blocks. Rows without a run are left out.
    """

    def run(batches):
        for batch in batches:
            words = batch.columns[-1]
            begin = words.offsets.to_numpy().astype(np.int64)
            values = words.values.slice(begin[0], begin[-1] - begin[0])
            begin, n = begin - begin[0], len(values)
            coded = values.dictionary_encode()
            each = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()]
            numbers = np.array([*each, 0], dtype=np.uint64)[coded.indices.fill_null(len(each)).to_numpy()]
            own, size = np.repeat(np.arange(len(begin) - 1), np.diff(begin)), np.diff(begin)
            hashed = np.zeros(max(0, n - k + 1), dtype=np.uint64)
            for i in range(k):
                hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + numbers[i : i + len(hashed)]
            hashed = hashed.view(np.int64)
            at = np.flatnonzero(own[: len(hashed)] == own[k - 1 :][: len(hashed)])
            blocks = -(-size // BLOCK)
            base = np.concatenate([[0], np.cumsum(blocks)])
            if wanted is None:
                near = np.ones(base[-1], dtype=bool)
            else:
                place = np.minimum(np.searchsorted(wanted[0], hashed[at]), len(wanted[0]) - 1)
                hit = wanted[0][place] == hashed[at]
                at, place = at[hit], place[hit]
                first = np.maximum(at - begin[own[at]] - wanted[1][place], 0) // BLOCK
                last = (np.minimum(at - begin[own[at]] + k + wanted[2][place], size[own[at]]) - 1) // BLOCK
                marks = np.zeros(base[-1] + 1, dtype=np.int64)
                np.add.at(marks, base[own[at]] + first, 1)
                np.add.at(marks, base[own[at]] + last + 1, -1)
                near = np.cumsum(marks)[:-1] > 0
            keep = np.unique(own[at])
            near &= np.repeat(np.isin(np.arange(len(size)), keep), blocks)
            chosen = np.flatnonzero(near)
            of = np.searchsorted(base, chosen, "right") - 1
            start = begin[of] + (chosen - base[of]) * BLOCK
            length = np.minimum(start + BLOCK, begin[of + 1]) - start
            taken = np.arange(length.sum()) + np.repeat(start - np.cumsum(length) + length, length)
            ends = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            runs, held = ends(np.bincount(own[at], minlength=len(size))[keep]), ends(np.bincount(of, minlength=len(size))[keep])
            lists = [(runs, pa.array(at - begin[own[at]], pa.int32())), (runs, pa.array(hashed[at])), (held, pa.array(chosen - base[of], pa.int32())), (held, pa.ListArray.from_arrays(ends(length), values.take(pa.array(taken))))]
            columns = [*[c.take(pa.array(keep)) for c in batch.columns[:-1]], pa.array(size[keep], pa.int32()), *[pa.ListArray.from_arrays(*x) for x in lists]]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "size", "at", "run", "blocks", "pieces"])

    return run


def local_alignments(reads: DataFrame, texts: DataFrame, read: str, key: str, match: int = 1, mismatch: int = 2, gap: int = 2) -> DataFrame:
    """read, draw, key, score, first_a, after_a, first_b, after_b: the best local alignment of each read with each text that it shares a seed with.

    reads: read, draw (see :func:`decoys`) and w; texts: key and w; w are arrays of words. A seed is a run of k words, k so
    that fewer equal words than k earn no more than one error costs: so every alignment that scores k * match or more has
    one, and pairs without a seed are left out. On either side of its seed a best alignment earns what its gaps cost, so its
    words of the text are no more than those of the read and the gaps that they pay for: only blocks of the text that are as
    near to a seed are kept, in the row of the text, and aligned, in Arrow batches. Runs of the reads are broadcast up to a
    bound; beyond it all runs and blocks of the texts are kept, and meet them by a join.
    """
    k = int(min(mismatch, gap) // match) + 1
    types = {**dict(reads.dtypes), **dict(texts.dtypes)}

    def seeds(df: DataFrame, keys: list[str], wanted: tuple | None) -> DataFrame:
        out = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "size int, at array<int>, run array<bigint>, blocks array<int>, pieces array<array<string>>"])
        return df.select(*keys, F.col("w").alias("_w")).mapInArrow(_runs(k, wanted), out)

    def each(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.select(*keys, "size", F.explode(F.arrays_zip("at", "run")).alias("s")).select(*keys, "size", "s.at", "s.run")

    paid = lambda n: n + F.floor(n * match / gap).cast("int") if gap else F.lit(2**30)
    reads = written(reads.select(read, "draw", "w"), "reads")
    few = reads.count() <= MOST_READS
    asked = each(seeds(reads, [read, "draw"], None), [read, "draw"]).groupBy(read, "draw", "run")
    asked = written(asked.agg(paid(F.max("at")).alias("left"), paid(F.max("size") - k - F.min("at")).alias("right")), "seeds")
    wanted = asked.groupBy("run").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    some = wanted.limit(MOST_RUNS + 1).collect() if few else []  # of no more runs than that
    chosen = tuple(np.array([r[i] for r in sorted(some)], dtype=np.int64) for i in range(3)) if 0 < len(some) <= MOST_RUNS else None
    near = written(seeds(texts, [key], chosen), "near")
    # a run that many texts hold is joined in parts: its reads are repeated for each part
    held = written(each(near, [key]).join(wanted.select("run"), "run"), "seeds")
    counts = held.groupBy("run").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
    asked = asked.join(counts, "run").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = held.join(counts, "run").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")).cast("int")).drop("parts")
    block = lambda c: F.floor(c / BLOCK).cast("int")
    reached = F.sequence(block(F.greatest(F.col("at") - F.col("left"), F.lit(0))), block(F.least(F.col("at") + k + F.col("right"), F.col("size")) - 1))
    met = asked.join(held, ["run", "part"]).select(read, "draw", key, F.explode(reached).alias("block"))
    pairs = written(met.groupBy(read, "draw", key).agg(F.array_sort(F.collect_set("block")).alias("blocks")), "seeded")
    own = near.select(key, F.map_from_arrays("blocks", F.transform(F.sequence(F.lit(0), F.size("blocks") - 1), lambda i: i)).alias("_i"), F.col("pieces").alias("_p"))
    cut = pairs.hint("merge").join(own, key).select(read, "draw", key, "blocks", F.transform("blocks", lambda b: F.get("_p", F.element_at("_i", b))).alias("pieces"))
    a = reads.select(read, "draw", F.col("w").alias("_a"))
    both = cut.join(F.broadcast(a) if few else a, [read, "draw"]).select(read, "draw", key, "blocks", "pieces", "_a")
    out = ", ".join(f"`{c}` {types[c]}" for c in (read, "draw", key)) + ", score int, first_a int, after_a int, first_b int, after_b int"
    return both.mapInArrow(_aligned(match, mismatch, gap), out).where(F.col("score") >= k * match)


def decoy_scores(found: DataFrame, reads: DataFrame, read: str, key: str, n: int) -> DataFrame:
    """read, score, key (the smallest of the best), only (no other text scores so), decoy_mean, decoy_max, excess, p.

    A draw without an alignment scores 0. p is the share of the draws, the read itself among them, that score as much as the read.
    """
    best = found.groupBy(read, "draw").agg(F.max(F.struct("score", (-F.col(key)).alias("k"))).alias("b"), F.max("score").alias("top"))
    ties = found.join(best.select(read, "draw", "top"), [read, "draw"]).where("draw = 0 and score = top").groupBy(read).agg(F.count("*").alias("ties"))
    real = reads.select(read).distinct().join(best.where("draw = 0").select(read, "top", (-F.col("b.k")).alias(key)), read, "left").join(ties, read, "left")
    real = real.select(read, F.coalesce("top", F.lit(0)).alias("score"), key, (F.coalesce("ties", F.lit(0)) == 1).alias("only"))
    decoy = best.where("draw > 0").join(real.select(read, "score"), read).groupBy(read).agg(F.sum("top").alias("total"), F.max("top").alias("most"), F.count_if(F.col("top") >= F.col("score")).alias("over"))
    out = real.join(decoy, read, "left")
    over = F.when(F.col("score") == 0, n).otherwise(F.coalesce("over", F.lit(0)))
    mean = F.coalesce("total", F.lit(0)) / n
    return out.select(read, "score", key, "only", mean.alias("decoy_mean"), F.coalesce("most", F.lit(0)).alias("decoy_max"), (F.col("score") - mean).alias("excess"), ((over + 1) / (n + 1)).alias("p"))


def make_gaps(docs: DataFrame, key: str, text: str, lengths: list[int], left: int, right: int, seed: int = 0) -> DataFrame:
    """key, length, left, right, truth: one gap in each text of enough letters, its length and place drawn by hash of the key.

    The gap has ``length`` letters (spaces included); left and right are what stands beside it, ``left`` and ``right`` letters.
    """
    n = F.length(text)
    length = F.element_at(F.array(*map(F.lit, lengths)), (draw(F.pmod(F.col(key).cast("long"), F.lit(1_000_003)), F.lit(0).cast("long"), seed) % len(lengths) + 1).cast("int"))
    room = n - left - right - length
    items = docs.withColumn("length", length).where(room >= 0)
    place = (left + draw(F.pmod(F.col(key).cast("long"), F.lit(1_000_003)), F.lit(1).cast("long"), seed) % (n - left - right - F.col("length") + 1)).cast("int")
    part = lambda start, size: F.substring(F.col(text), start, size)
    return items.withColumn("_at", place).select(key, "length", part(F.col("_at") - left + 1, F.lit(left)).alias("left"), part(F.col("_at") + F.col("length") + 1, F.lit(right)).alias("right"), part(F.col("_at") + 1, F.col("length")).alias("truth"))


def _log_probs(rows: DataFrame, model: list[DataFrame], letters: int) -> DataFrame:
    """rows with logp, the log2 probability of the last letter of column gram behind the others.

    The grams are broadcast where the alphabet and the order bound them; rows never are, whose number the planner cannot see.
    """
    known = written(ngrams.gram_probs(rows.select("gram").distinct(), model, letters).select("gram", F.log2("prob").alias("logp")), "known")
    few = (letters + 1) ** len(model) <= MOST_GRAMS
    return rows.join(F.broadcast(known) if few else known.hint("merge"), "gram")


def fill_gaps(items: DataFrame, key: str, model: list[DataFrame], alphabet: str, beam: int, places: int = 9) -> DataFrame:
    """key, fill, score: the best filling of each gap by a beam over its letters, chosen with what follows.

    Each step asks the model's tables for every letter behind the kept beginnings, and the ``beam`` best of an item are kept
    (log2 probabilities rounded to ``places``; ties in order of letters). The last ones are scored again with the text on the
    right, of which only letters within the model's order depend on the filling.
    """
    order = len(model)
    each = F.explode(F.array(*map(F.lit, alphabet)))
    state = written(items.select(key, "length", F.concat(F.lit("^" * (order - 1)), F.col("left")).alias("before"), "right", F.lit("").alias("fill"), F.lit(0.0).alias("score")), "beam")
    longest = state.agg(F.max("length")).first()[0] or 0
    done = state.where("length = 0")
    for step in range(1, longest + 1):
        grown = state.where(F.col("length") >= step).withColumn("letter", each)
        context = F.right(F.concat("before", "fill"), F.lit(order - 1)) if order > 1 else F.lit("")
        scored = _log_probs(grown.withColumn("gram", F.concat(context, F.col("letter"))), model, len(alphabet))
        scored = scored.select(key, "length", "before", "right", F.concat("fill", "letter").alias("fill"), F.round(F.col("score") + F.col("logp"), places).alias("score"))
        rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "fill"))  # beam * alphabet rows of one item
        state = written(scored.withColumn("_k", rank).where(F.col("_k") <= beam).drop("_k"), "beam")
        done = done.unionByName(state.where(F.col("length") == step))
    done = written(done, "beam")
    tail = done.where(F.length("right") > 0).withColumn("i", F.explode(F.sequence(F.lit(1), F.least(F.length("right"), F.lit(max(1, order - 1))))))
    whole = F.concat(F.right(F.concat("before", "fill"), F.lit(order - 1)) if order > 1 else F.lit(""), F.substring("right", F.lit(1), F.col("i")))
    after = _log_probs(tail.select(key, "fill", F.right(whole, F.lit(order)).alias("gram")), model, len(alphabet)).groupBy(key, "fill").agg(F.sum("logp").alias("after"))
    total = done.join(after, [key, "fill"], "left").withColumn("score", F.round(F.col("score") + F.coalesce("after", F.lit(0.0)), places))
    best = F.min(F.struct((-F.col("score")).alias("s"), "fill")).alias("b")
    return total.groupBy(key).agg(best).select(key, "b.fill", (-F.col("b.s")).alias("score"))


def letter_hits(a: Column, b: Column) -> Column:
    """Places at which both have the same letter."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))).otherwise(0)


def score_fills(items: DataFrame, fills: DataFrame, others: DataFrame, key: str, draws: int = 200, units: int = 64, seed: int = 0) -> DataFrame:
    """By length (and 0 for all): items, letters, accuracy and exact share of the fills, accuracy of the others, their difference and its interval.

    The interval is a paired bootstrap: both fills of an item stay together, items are drawn in ``units`` groups by key. An
    item without a filling has no hits.
    """
    one = items.select(key, "length", "truth").join(fills.select(key, "fill"), key, "left").join(others.select(key, F.col("fill").alias("other")), key, "left")
    hits = one.select("length", F.pmod(F.col(key), F.lit(units)).cast("long").alias("unit"), letter_hits(F.col("truth"), F.coalesce("fill", F.lit(""))).alias("a"), letter_hits(F.col("truth"), F.coalesce("other", F.lit(""))).alias("b"), F.coalesce(F.col("truth") == F.col("fill"), F.lit(False)).cast("int").alias("exact"))
    hits = hits.withColumn("length", F.explode(F.array("length", F.lit(0)))).withColumn("size", F.lit(1))
    letters = F.col("letters")
    truth = items.select(key, F.explode(F.array("length", F.lit(0))).alias("length"), F.pmod(F.col(key), F.lit(units)).cast("long").alias("unit"), F.length("truth").alias("letters")).groupBy("length", "unit").agg(F.sum("letters").alias("letters"))
    sums = written(hits.groupBy("length", "unit").agg(*[F.sum(c).alias(c) for c in ("a", "b", "exact", "size")]).join(truth, ["length", "unit"]), "hits")
    number = sums.sparkSession.range(units).select(F.col("id").alias("unit"))
    drawn = sums.join(F.broadcast(resample_weights(number, units, draws, seed)), "unit").groupBy("length", "draw").agg((F.sum((F.col("a") - F.col("b")) * F.col("weight")) / F.sum(letters * F.col("weight"))).alias("diff"))  # at most units * draws weights
    low = drawn.where("diff is not null").groupBy("length").agg(F.percentile("diff", F.lit(0.025)).alias("low"), F.percentile("diff", F.lit(0.975)).alias("high"))
    total = sums.groupBy("length").agg(F.sum("size").alias("items"), F.sum("letters").alias("letters"), *[F.sum(c).alias(c) for c in ("a", "b", "exact")])
    return total.join(low, "length", "left").select("length", "items", "letters", (F.col("a") / letters).alias("accuracy"), (F.col("exact") / F.col("items")).alias("exact"), (F.col("b") / letters).alias("other_accuracy"), ((F.col("a") - F.col("b")) / letters).alias("diff"), "low", "high")
