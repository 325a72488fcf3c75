"""Character n-gram tables with Kneser-Ney smoothing: all counts are grouped tables, and scoring joins them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import written


#: Letters that are counted together.
LETTERS = 1_000_000
#: Tables of so many grams are broadcast.
MOST_GRAMS = 100_000


def _counts(texts: list[str], k: int, pad: str, apart: bool) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Number of the text (0 for all unless apart), gram and times."""
    points = np.frombuffer("".join(pad * (k - 1) + t for t in texts).encode("utf-32-le"), dtype="<u4")
    size = np.array([len(t) for t in texts])
    whole = size + k - 1
    place = np.arange(size.sum()) + np.repeat(np.cumsum(whole) - whole - np.cumsum(size) + size, size)
    own = np.repeat(np.arange(len(texts)), size) if apart else np.zeros(len(place), dtype=np.int64)
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    span = len(letters) ** k
    if span * len(texts) < 2**62:
        number = np.zeros(0x110000, dtype=np.int64)
        number[letters] = np.arange(len(letters))
        number, code = number[points], own
        for i in range(k):
            code = code * len(letters) + number[place + i]
        code, times = np.unique(code, return_counts=True)
        own, code = np.divmod(code, span)
        code, at = np.unique(code, return_inverse=True)
        rows = letters[np.stack([code // len(letters) ** (k - 1 - i) % len(letters) for i in range(k)], axis=1)]
    else:
        rows, times = np.unique(np.column_stack([own, *[points[place + i] for i in range(k)]]), axis=0, return_counts=True)
        own, rows, at = rows[:, 0], rows[:, 1:], np.arange(len(rows))
    text = rows.astype("<u4").tobytes().decode("utf-32-le")
    return own, pa.array([text[i : i + k] for i in range(0, len(text), k)], pa.string()).take(pa.array(at)), times


def gram_counts(docs: DataFrame, text: str, k: int, key: str | None = None, pad: str = "^") -> DataFrame:
    """(key,) gram, times: all k-letter grams of each text behind k - 1 pads; without a key, of many texts together, so a gram has many rows."""

    def run(batches):
        for batch in batches:
            texts = batch.columns[-1].to_pylist()
            full = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
            cuts = np.cumsum([len(texts[i]) for i in full]) // LETTERS
            for some in np.split(full, np.flatnonzero(np.diff(cuts)) + 1) if len(full) else []:
                own, gram, times = _counts([texts[i] for i in some], k, pad, key is not None)
                keys = [] if key is None else [batch.column(0).take(pa.array(some[own]))]
                yield pa.RecordBatch.from_arrays([*keys, gram, pa.array(times, pa.int64())], names=[*([key] if key else []), "gram", "times"])

    named = f"`{key}` {dict(docs.dtypes)[key]}, " if key else ""
    return docs.select(*([key] if key else []), text).mapInArrow(run, f"{named}gram string, times bigint")


def ngram_counts(docs: DataFrame, text: str, k: int, min_count: int = 1) -> DataFrame:
    """gram, n over all documents."""
    return gram_counts(docs, text, k).groupBy("gram").agg(F.sum("times").alias("n")).where(F.col("n") >= min_count)


def continuations(counts: DataFrame) -> DataFrame:
    """Grams one letter shorter, with how many letters stand before them."""
    return counts.groupBy(F.substr("gram", F.lit(2)).alias("gram")).agg(F.count("*").alias("n"))


def discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 from the counts of counts; one row."""
    c = counts.agg(*[F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))
    d = lambda i: F.greatest(F.lit(0.0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.greatest(F.lit(1.0), F.col(f"n{i}")))
    return c.select(*[d(i).alias(f"d{i}") for i in (1, 2, 3)])


def kn_table(counts: DataFrame) -> DataFrame:
    """gram, context, discounted count, context total and the mass left for shorter contexts."""
    d = discounts(counts)
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    g = counts.join(F.broadcast(d)).select("gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), "n", cut.alias("cut"))  # one row of discounts
    ctx = g.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    return g.join(ctx, "context").select("gram", "context", ((F.col("n") - F.col("cut")) / F.col("total")).alias("p"), (F.col("left") / F.col("total")).alias("back"))


def kn_model(docs: DataFrame, text: str, order: int) -> list[DataFrame]:
    """Tables for orders 1..order: raw counts at the top, continuation counts below. Each is written once."""
    counts = written(ngram_counts(docs, text, order), "grams")
    tables = [written(kn_table(counts), "kn")]
    for _ in range(order - 1):
        counts = written(continuations(counts), "grams")
        tables.append(written(kn_table(counts), "kn"))
    return tables[::-1]


def gram_probs(seen: DataFrame, model: list[DataFrame], letters: int) -> DataFrame:
    """gram, prob: the interpolated probability of the last letter behind the others; seen: distinct grams of the model's order."""
    order = len(model)
    seen = seen.select("gram", F.lit(1.0 / letters).alias("prob"))
    for k, table in enumerate(model, 1):
        tail = F.expr(f"substring(gram, {order - k + 1}, {k})")
        t = table.select(F.col("gram").alias("_g"), F.col("p").alias("_p"))
        c = table.select("context", "back").distinct()
        s = seen.withColumn("_t", tail).withColumn("_c", F.expr(f"substring(_t, 1, {k - 1})"))
        s = s.join(t, F.col("_t") == F.col("_g"), "left").join(c, F.col("_c") == F.col("context"), "left")
        seen = s.select("gram", (F.coalesce("_p", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("prob")).alias("prob"))
    return seen


def kn_score(docs: DataFrame, key: str, text: str, model: list[DataFrame], letters: int, seen: DataFrame | None = None) -> DataFrame:
    """key, letters, bits: minus log2 of the interpolated probability, summed over the text; unseen letters fall to uniform.

    Grams are counted inside the row of their document, and each distinct gram of a document is looked up once.
    seen: a table with every distinct gram of the documents once, such as the model's last where it was made from them.
    """
    seen = ngram_counts(docs, text, len(model)) if seen is None else seen
    known = written(gram_probs(seen.select("gram"), model, letters).select("gram", (-F.log2("prob")).alias("bits")), "known")
    few = known.count() <= MOST_GRAMS
    pos = gram_counts(docs, text, len(model), key).join(F.broadcast(known) if few else known.hint("merge"), "gram")
    return pos.groupBy(key).agg(F.sum("times").alias("letters"), F.sum(F.col("bits") * F.col("times")).alias("bits"))


def em_weights(probs: DataFrame, names: list[str], rounds: int = 20) -> dict[str, float]:
    """Mixture weights of models by expectation maximisation; the driver holds one number per model."""
    w = {n: 1.0 / len(names) for n in names}
    for _ in range(rounds):
        total = sum((F.lit(w[n]) * F.col(n) for n in names), F.lit(0.0))
        row = probs.agg(*[F.avg(F.lit(w[n]) * F.col(n) / total).alias(n) for n in names]).first()
        w = {n: float(row[n]) for n in names}
    return w
