"""Near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A document is a bag of five-word shingles with their counts as weights. For every shingle a Poisson process of marked
points runs over the weight axis, discretised to whole numbers and cut into (0, 1], (1, 2], (2, 4], (4, 8] ...; each
interval is a binary tree of processes down to width 1. A point's time is exponential in the width of its interval; the
interval then splits, the point goes to one half by a coin, and both halves go on from that time. All draws are hashes of
shingle and interval, so documents agree wherever their weights do. A document keeps, for each of m registers, the
earliest time of a point below its weights: two documents share a register's point with the probability of their
weighted Jaccard similarity. A process stops once its time is later than all of the document's registers, so large bags
cost little more than one point per shingle.

Bands of registers make buckets. In a bucket every document is verified against the bucket's pivot (linear in the
bucket) and the links make components. Only pairs of a bucket in different components could still change the classes; of
these, the overlaps with the pivot exclude all but pairs that share shingles the pivot lacks or whose sizes leave room
(see :func:`_apart`), and those are verified too. So no link of two documents in a bucket is lost for the classes, and a
group of thousands of near copies costs thousands of comparisons, not their square. Exact copies are one node from the start.

With 25 bands of 5 registers a pair of similarity 0.8 shares no bucket with probability 5e-5.

Defined results: texts of one to four words have one shingle of all their words; null texts and texts without a word
have none and are classes of their own text (all null and empty texts with the same content form one class only if their
text is equal); a null doc_id counts as smaller than any other and its class id is null; repeated rows are copies;
further columns are ignored or, in :func:`keep_one`, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WordHashes, components, few, folded_words, gram_hashes, pick, spread_join, text_keys, written

#: Rows of one pivot from which a join by pivot is dealt over several tasks; each row has a whole bag or is compared with many.
SPREAD = 300
_NULL = -(2**63)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seed(element: np.ndarray, low: np.ndarray, width: np.ndarray, salt: int) -> np.ndarray:
    return _mix(element ^ _mix(low.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + width.astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(salt)))


def _exponential(x: np.ndarray) -> np.ndarray:
    return -np.log(((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """n_docs x m earliest point times; rows of doc, element, weight are the documents' distinct shingles and counts."""
    times = np.full(n_docs * m, np.inf)
    latest = np.full(n_docs, np.inf)
    start = [(doc, element, np.zeros(len(doc), dtype=np.int64), np.ones(len(doc), dtype=np.int64), weight)]
    low = 1
    while True:
        more = weight > low
        if not more.any():
            break
        n = int(more.sum())
        start.append((doc[more], element[more], np.full(n, low, dtype=np.int64), np.full(n, low, dtype=np.int64), weight[more]))
        low *= 2
    doc, element, low, width, weight = (np.concatenate(x) for x in zip(*start, strict=True))
    time, step = np.zeros(len(doc)), np.zeros(len(doc), dtype=np.uint64)
    state = _seed(element, low, width, 1)
    while len(doc):
        state = _mix(state + _U(0x9E3779B97F4A7C15))
        time = time + _exponential(state) / width
        live = time < latest[doc]
        doc, element, low, width, weight, time, step, state = (x[live] for x in (doc, element, low, width, weight, time, step, state))
        spawned = []
        while (wide := np.flatnonzero(width > 1)).size:  # the point goes down to a leaf; the other halves go on from here
            half = width[wide] // 2
            coin = (_seed(element[wide], low[wide], width[wide], 2) & _U(1)).astype(bool)
            right = np.where(coin, low[wide], low[wide] + half)
            spawned.append((doc[wide], element[wide], right, half, weight[wide], time[wide]))
            low[wide] = np.where(coin, low[wide] + half, low[wide])
            width[wide] = half
            step[wide] = 1
        fresh = step == 1
        state[fresh] = _seed(element[fresh], low[fresh], width[fresh], 1)
        step[fresh] = 0
        inside = low < weight
        doc, element, low, width, weight, time, step, state = (x[inside] for x in (doc, element, low, width, weight, time, step, state))
        at = doc * m + (_mix(state ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64)
        np.minimum.at(times, at, time)
        if spawned:
            d, e, lo, w, wt, t = (np.concatenate(x) for x in zip(*spawned, strict=True))
            inside = lo < wt
            d, e, lo, w, wt, t = (x[inside] for x in (d, e, lo, w, wt, t))
            doc, element, low, width, weight, time = (np.concatenate(x) for x in zip((doc, element, low, width, weight, time), (d, e, lo, w, wt, t), strict=True))
            step, state = np.concatenate([step, np.zeros(len(d), dtype=np.uint64)]), np.concatenate([state, _seed(e, lo, w, 1)])
        if len(doc):
            some = np.unique(doc)
            latest[some] = times.reshape(n_docs, m)[some].max(axis=1)
    return times.reshape(n_docs, m)


def shingle_bag(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted hashes of the shingles, each as often as it occurs."""
    return np.sort(gram_hashes(words, min(size, len(words)))) if len(words) else np.zeros(0, dtype=np.uint64)


def _band_keys(times: np.ndarray, bands: int) -> np.ndarray:
    bits = times.view(np.uint64).reshape(len(times), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(times), 1))
    for j in range(bits.shape[2]):
        key = _mix(key * _U(0x9E3779B97F4A7C15) ^ bits[:, :, j])
    return key.view(np.int64)


def _signer(size: int, bands: int, rows: int, most: int = 250_000):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.columns[:-1], batch.columns[-1].to_pylist()
            at = 0
            while at < len(texts):
                end, total, bags = at, 0, []
                while end < len(texts) and total < most:
                    bags.append(np.unique(shingle_bag(hashes.of(folded_words(texts[end])), size), return_counts=True))
                    total += len(bags[-1][0])
                    end += 1
                doc = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
                times = signatures(doc, np.concatenate([b for b, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64), len(bags), bands * rows)
                keys = _band_keys(times, bands)
                lists = pa.array([k if len(b) else k[:0] for k, (b, _) in zip(keys, bags, strict=True)], pa.list_(pa.int64()))
                sizes = pa.array([int(c.sum()) for _, c in bags], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.slice(at, end - at) for c in ids], sizes, lists], names=["row", "doc_id", "k1", "k2", "n_shingles", "bands"])
                at = end

    return run


def _bags(size: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            bags = [shingle_bag(hashes.of(folded_words(t)), size).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["node", "bag"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted bags."""
    x, n = np.unique(a, return_counts=True)
    y, k = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], k[j]).sum())


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags; of two empty ones 0."""
    both = common(a, b)
    return both / (len(a) + len(b) - both) if both else 0.0


def _arrays(column):
    return (np.frombuffer(x.as_py(), dtype=np.uint64) for x in column)


def _compare(batches):
    for batch in batches:
        out = [(common(x, y), len(x), len(y)) for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), pa.int64()) for c in cols]], names=["a", "b", "both", "size_a", "size_b"])


def _novel(batches):
    """The shingles that b has and a has not, or not as often, and how often more."""
    for batch in batches:
        out, more = [], []
        for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True):
            (x, n), (y, k) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
            if len(x):
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                k = k - np.where(x[at] == y, n[at], 0)
            out.append(y[k > 0].view(np.int64))
            more.append(k[k > 0])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))], names=["a", "b", "novel", "more"])


def _bag_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, name: str) -> DataFrame:
    """a, b and both bags of written pairs of nodes. Texts of these nodes alone are read again, as bags, and moved."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(wanted.join(nodes.select("node", "id", "k1", "k2"), "node"), f"{name}-nodes")
    texts = docs.join(few(wanted), ["id", "k1", "k2"]).select("node", "text")
    bags = written(texts.mapInArrow(_bags(size), "node long, bag binary").dropDuplicates(["node"]), f"{name}-bags")
    counts = written(pairs.groupBy("a").agg(F.count("*").alias("n")), f"{name}-counts")  # a pivot may have many pairs
    both = pairs.select("a", "b").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    return spread_join(both, bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), ["a"], "b", counts, least=SPREAD).select("a", "b", "bag_a", "bag_b")


def _similarities(both: DataFrame, name: str) -> DataFrame:
    """a, b, both (common shingles), size_a, size_b, similarity."""
    compared = both.mapInArrow(_compare, "a long, b long, both long, size_a long, size_b long")
    return written(compared.withColumn("similarity", F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))), f"{name}-similar")


def _apart(known: DataFrame, parts: DataFrame, both: DataFrame, threshold: float) -> DataFrame:
    """Pairs of documents compared with the same pivot, in different components, that may still reach the threshold.

    With m the smaller of two documents' overlaps with their pivot, their own overlap is at most m plus the shingles that
    both have and the pivot lacks. So a pair reaches the threshold only if m alone would allow it, or if it shares shingles
    that the pivot lacks. The second kind is found by prefix filtering: a document x must share at least
    threshold * |x| - m of these shingles, hence one of those that remain when its most frequent ones, fewer than that, are
    set aside; and m plus the smaller number of such shingles must allow the threshold. These conditions are joined on,
    instead of all pairs of the pivot's documents.
    """
    named = known.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.col("both").alias("m"), F.col("size_b").alias("size"))
    place = lambda df, node, name: df.join(parts.select(F.col("node").alias(node), F.col("component").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))
    named = place(place(named, "node", "component"), "pivot", "main")
    open_ = named.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("main")).alias("off")).where("n > 1 and off > 0").select("pivot")
    named = written(named.join(open_, "pivot"), "open")
    other = lambda df, *keys: df.where("component <> main").select(*keys, *[F.col(c).alias(f"x_{c}") for c in ("node", "component", "m", "size")])
    counts = written(named.groupBy("pivot").agg(F.count("*").alias("n")), "open-counts")
    m = F.least("x_m", "m")
    differ = (F.col("x_component") != F.col("component")) & ((F.col("component") == F.col("main")) | (F.col("x_node") < F.col("node")))
    fits = m >= threshold * (F.col("x_size") + F.col("size") - m) - 1e-9
    pair = [F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")]
    near = spread_join(named, other(named, "pivot"), ["pivot"], "node", counts, least=SPREAD).where(differ & fits).select(*pair)
    novel = both.join(named.select(F.col("pivot").alias("a"), F.col("node").alias("b")), ["a", "b"]).select("a", "b", "bag_a", "bag_b").mapInArrow(_novel, "a long, b long, novel array<long>, more array<long>")
    novel = written(novel.select(F.col("a").alias("pivot"), F.col("b").alias("node"), F.explode(F.arrays_zip("novel", "more")).alias("s")).select("pivot", "node", F.col("s.novel").alias("shingle"), F.col("s.more").alias("weight")), "novel")
    common_ = written(novel.groupBy("pivot", "shingle").agg(F.count("*").alias("n")).where("n > 1"), "novel-common")
    rest = W.partitionBy("pivot", "node").orderBy(F.desc("n"), F.desc("shingle"))  # one document's shingles
    ranked = spread_join(novel, common_, ["pivot", "shingle"], "node", common_, "left", least=SPREAD).withColumn("n", F.coalesce("n", F.lit(1))).withColumn("suffix", F.sum("weight").over(rest))
    ranked = ranked.join(named, ["pivot", "node"]).where((F.col("n") > 1) & (F.col("suffix") >= F.greatest(F.lit(1.0), F.ceil(threshold * F.col("size") - F.col("m") - 1e-9))))
    # by shingle: its most frequent component is compared with the others, whatever shares it within one component is not
    ranked = written(ranked.select("pivot", "shingle", "node", "component", "m", "size"), "ranked")
    sizes = ranked.groupBy("pivot", "shingle", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("pivot", "shingle").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("pivot", "shingle", "main")
    mixed = written(spread_join(ranked, most, ["pivot", "shingle"], "node", common_, least=SPREAD), "mixed")
    most_common = m + F.least(F.col("x_size") - F.col("x_m"), F.col("size") - F.col("m"))
    allowed = most_common >= threshold * (F.col("x_size") + F.col("size") - most_common) - 1e-9
    shared = spread_join(mixed, other(mixed, "pivot", "shingle"), ["pivot", "shingle"], "node", common_, least=SPREAD).where(differ & allowed).select(*pair)
    pairs = near.unionByName(shared).distinct()
    return written(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti"), "cross")


def _with_keys(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).select("id", *text_keys(), "text")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, bands: int = 25, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(members, links): a row id, k1, k2, class_id for each row of docs; and a, b, similarity of the verified links of nodes."""
    keyed = _with_keys(docs)
    plain = keyed.select(F.monotonically_increasing_id().alias("row"), "id", "k1", "k2", "text")
    signed = written(plain.mapInArrow(_signer(size, bands, rows), "row long, doc_id long, k1 long, k2 long, n_shingles long, bands array<long>"), "signatures")
    nodes = written(signed.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "nodes")
    in_bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = written(in_bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = written(spread_join(in_bucket, shared, ["bucket"], "node", shared), "buckets")
    # the pivot of a bucket is its document with most company over all buckets: of edited copies, most likely their original
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = written(members.join(company, "node").select("bucket", "node", "company"), "members")
    pivots = members.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("k")))["k"].alias("k")).select("bucket", (-F.col("k")).alias("pivot"))
    pairs = spread_join(members, pivots, ["bucket"], "node", shared).where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    both = _bag_pairs(pairs, nodes, keyed, size, "star")
    known = _similarities(both, "star")
    links = known.where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    parts = written(components(links), "components")
    cross = _apart(known, parts, both, threshold)
    if cross.limit(1).count():
        more = _similarities(_bag_pairs(cross, nodes, keyed, size, "cross"), "cross").where(F.col("similarity") >= threshold)
        links = links.unionByName(more.select("a", "b", "similarity"))
        parts = written(components(links), "components")
    whole = nodes.select("node", "id", "k1", "k2").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = whole.groupBy("component").agg(F.min("id").alias("class_id"))
    whole = whole.join(classes, "component").select("k1", "k2", "class_id")
    return signed.select(F.col("doc_id").alias("id"), "k1", "k2", "n_shingles").join(whole, ["k1", "k2"]), links


def classes_of(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and first (whether it is that one), a row for each row of docs."""
    members, _ = near_duplicates(docs, **settings)
    real = lambda c: F.when(F.col(c) != _NULL, F.col(c))
    return members.select(real("id").alias("doc_id"), real("class_id").alias("class_id"), (F.col("id") == F.col("class_id")).alias("first"), "n_shingles")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id; columns as in docs."""
    members, _ = near_duplicates(docs, **settings)
    members = written(members, "classes")
    gone = members.where("id <> class_id").select("id", "k1", "k2").distinct()
    names = [F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL)).alias("_id"), *[c.alias(f"_{k}") for c, k in zip([F.xxhash64(F.coalesce(docs["text"], F.lit(""))), F.xxhash64(F.lit(7), F.coalesce(docs["text"], F.lit("")))], ("k1", "k2"), strict=True)]]
    kept = docs.select("*", *names).join(few(gone.toDF("_id", "_k1", "_k2")), ["_id", "_k1", "_k2"], "left_anti")
    # rows that repeat an id and a text, or texts of one class under one id, are rare: only then are rows compared again
    if members.where("id = class_id").groupBy("class_id").count().where("count > 1").limit(1).count():
        first = members.where("id = class_id").groupBy("id").agg(F.min(F.struct("k1", "k2")).alias("k")).select(F.col("id").alias("_id"), F.col("k.k1").alias("_k1"), F.col("k.k2").alias("_k2"))
        kept = kept.join(first, ["_id", "_k1", "_k2"], "left_semi").dropDuplicates(["_id", "_k1", "_k2"])
    return kept.select(*[kept[f"`{c}`"] for c in docs.columns])


def op7_bagminhash(spark, sf_dir: str) -> DataFrame:
    return classes_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
