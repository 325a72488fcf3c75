"""Quality classifier: a sparse rule ensemble over statistics of the text.

Shallow trees are grown on labelled documents; each path from a root to a node is a conjunctive rule over the
statistics; a logistic regression with an L1 penalty weighs the rules, and those that keep a weight are compiled into one
Spark column expression, so scoring is a projection over the statistics.

The fit reads at most about ``max_labelled`` labelled documents (a documented bound, taken by hash of the id); statistics and
scores cover every document. Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have all statistics 0 and get a score; null ids are scored, never learned from;
documents with several label rows count once for each; without labels of both kinds every score is the share of label 1
(0.5 without any); repeated rows are scored each; further columns are ignored or, in :func:`keep_good`, kept.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, utf8, written

STATISTICS = [
    "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "non_ascii_share", "space_share",
    "stop_share", "distinct_share", "top_word_share", "repeat_next_share", "words_per_line", "dup_line_share", "end_mark_share", "comma_share", "shout_word_share", "symbol_end_share",
]
_SYMBOLS = b"#*$%&<>{}[]=_~^\\@+/"
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_HIGH = bytes(range(128, 256))
_ENDS = (b".", b"!", b"?", b":", b";", b'"')


def text_statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, each a share of bytes, words or lines, or a mean."""
    raw = utf8(text)
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = counts.most_common(1)[0][1]
    spaces = size - len(raw.translate(None, b" \t\n\r"))
    return [
        len(b"%d" % n) + n / 10 ** len(b"%d" % n), (size - spaces) / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(b"!"), share(b"|"), share(_HIGH), spaces / size,
        sum(c for w, c in counts.items() if len(w) <= 3) / n, len(counts) / n, most / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip().endswith(_ENDS) for x in lines) / len(lines), share(b",") * size / n,
        sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n, sum(c for w, c in counts.items() if not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in (b".", b",", b"!", b"?"))) / n,
    ]


def _measure(batches):
    for batch in batches:
        key, doc = batch.column(0), batch.column(1)
        rows = [text_statistics(x) for x in batch.column(2).to_pylist()]
        cols = [pa.array(list(c), pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * len(STATISTICS)
        yield pa.RecordBatch.from_arrays([key.cast(pa.int64()), doc.cast(pa.int64()), *cols], names=["text_key", "doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    """text_key (xxhash64 of the text), doc_id and the statistics, written once: a row for each row of docs."""
    plain = pick(docs, "doc_id", "text").select(F.xxhash64("text").alias("text_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(plain.mapInArrow(_measure, "text_key long, doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)), "text-statistics")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(model) -> list[Rule]:
    """The paths of a forest's trees as conjunctions of (statistic, "<=" or ">", threshold), each once, bounds on one statistic merged."""
    rules: dict[Rule, None] = {}

    def walk(node, path: dict) -> None:
        if path:
            rules.setdefault(tuple(sorted((k, op, t) for (k, op), t in path.items())))
        if node.subtreeDepth() == 0:
            return
        k, t = node.split().featureIndex(), float(node.split().threshold())
        walk(node.leftChild(), path | {(k, "<="): min(t, path.get((k, "<="), t))})
        walk(node.rightChild(), path | {(k, ">"): max(t, path.get((k, ">"), t))})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(rules)


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(STATISTICS[k]) <= t if op == "<=" else F.col(STATISTICS[k]) > t for k, op, t in rule])


def fit_rules(labelled: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 5) -> tuple[list[tuple[Rule, float]], float]:
    """Rules with their weights, and the intercept. labelled: the statistics and label (0 or 1)."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    total = sum(counts.values())
    if len(counts) < 2:
        share = min(max(counts.get(1.0, 0) / total if total else 0.5, 1e-6), 1 - 1e-6)
        return [], -_logit(1 - share)
    vector = labelled.select(array_to_vector(F.array(*STATISTICS)).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird", maxBins=64, minInstancesPerNode=5).fit(vector)
    rules = tree_rules(forest)
    if not rules:
        return [], _logit(counts[1.0] / total)
    fired = labelled.select(array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features"), "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(fired)
    return [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if w], float(lasso.intercept)


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def score_column(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    z = F.lit(intercept)
    for rule, weight in rules:
        z = z + F.when(rule_column(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 50_000) -> DataFrame:
    """text_key, doc_id, held_out and score of every row of docs; learned from labels of documents that are not held out."""
    stats = statistics(docs)
    marks = pick(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("_id"), F.col(f"`{label}`").cast("double").alias("label")).where("_id is not null and label in (0, 1)")
    marks = marks.where(~held_out(F.col("_id")))
    n = marks.count()
    if n > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    labelled = written(stats.join(marks, stats["doc_id"] == marks["_id"]).select(*STATISTICS, "label"), "labelled-statistics")
    rules, intercept = fit_rules(labelled)
    return stats.select("text_key", "doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(rules, intercept).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores below the threshold; columns as in docs."""
    bad = score_quality(docs, labels).where(F.col("score") < threshold).select(F.col("text_key").alias("_key")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["_key"], "left_anti")


def op5_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
