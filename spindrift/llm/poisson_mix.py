"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's repetition rate is its target share of the output divided by its share of the input (in characters). Each
document draws a count by inverting the Poisson distribution of that mean at a uniform number that is hashed from its id
and the seed, is exploded by the count, and lands at a hashed position of the output: the partition comes from the hash
itself, so the global shuffle needs no sampling pass and its partitions are even whatever the sources' sizes.

Distributions are tables of the probabilities of at most k: from 0 on for rates up to ``SMALL``, and for larger ones within 12 standard
deviations of the rate, from the terms' logarithms (by Stirling's series) and a running sum, so a table is as long as 24 times the root
of its rate. Counts beyond ``CHUNK`` are dealt in chunks to all tasks before they are exploded.

Defined results: null sources form one source (``None`` in ``weights``); null and empty texts count no characters, and a
source without any gets rate 0; a null doc_id draws as one id; repeated rows draw the same count each; further columns are
kept, but ``copy`` and ``mix_key`` are replaced; an empty table gives an empty result. Sources that ``weights`` does not
name get weight 0. A rate of r makes about r copies of each of the source's documents, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import partitions, spread_join, text_or_empty, written

#: Entries of the sources' tables that are broadcast at most; beyond it they are joined by shuffle, hot sources spread.
MAX_BROADCAST = 1_000_000
SMALL = 1000
CHUNK = 4096


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 hash, the same in every engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """The array of P(X <= k) for k = 0, 1, ... up to where the rest is below double precision."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, k):
        lp = acc["lp"] + F.log(rate / k)
        total = acc["sum"] + F.exp(lp)
        return F.struct(lp.alias("lp"), total.alias("sum"), F.concat(acc["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])).otherwise(F.array(F.lit(1.0)))


def large_cdf(rates: DataFrame) -> DataFrame:
    """source, first, cdf: P(X <= k) for k = first, first + 1, ... within 12 standard deviations of each rate."""
    rate, k = F.col("rate"), F.col("k")
    reach = 12 * F.sqrt(rate) + 30
    terms = rates.select("source", "rate", F.explode(F.sequence(F.greatest(F.floor(rate - reach), F.lit(1)), F.ceil(rate + reach))).alias("k"))
    stirling = F.log(2 * F.pi() * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k.cast("double"))
    terms = terms.withColumn("p", F.exp(k * F.log(rate / k) + (k - rate) - stirling))
    running = terms.withColumn("cdf", F.sum("p").over(W.partitionBy("source").orderBy("k")))  # 24 roots of the rate a source
    return running.groupBy("source").agg(F.min("k").alias("first"), F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("x")).select("source", "first", F.col("x.cdf").alias("cdf"))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5) -> DataFrame:
    """source, documents, size, rate. Without weights the targets are in proportion to size ** power (below 1: small sources gain)."""
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length(text_or_empty()).cast("double")).alias("size"))
    if weights is None:
        weight = F.pow("size", F.lit(float(power)))
    else:
        pairs = [x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(float(v)))]
        named = F.element_at(F.create_map(*pairs), F.col("source")) if pairs else F.lit(None).cast("double")
        weight = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(F.coalesce(named, F.lit(0.0)))
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    totals = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.col("weight") / F.col("all_weight") * F.col("all_size") / F.col("size")
    return sizes.join(F.broadcast(totals)).select("source", "n", "size", F.when((F.col("size") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0).alias("rate"))  # totals is one row


def _drawn(docs: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """docs with _count, the copies of each. rates is a written table."""
    key = lambda name: F.coalesce(F.concat(F.lit("s"), name), F.lit("null")).alias("_source")
    tables = rates.where(f"rate <= {SMALL}").select(key("source"), F.lit(0).cast("long").alias("_first"), poisson_cdf(F.col("rate")).alias("_cdf"))
    large = rates.where(f"rate > {SMALL}")
    if large.limit(1).count():
        tables = tables.unionByName(large_cdf(large.withColumn("source", key("source"))).toDF("_source", "_first", "_cdf"))
    entries = rates.agg(F.sum(F.when(F.col("rate") <= SMALL, F.col("rate")).otherwise(0) + 24 * F.sqrt("rate") + 60).alias("n")).first()["n"] or 0
    docs = docs.withColumn("_source", key("source")).withColumn("_u", uniform(seed, F.col("doc_id")))
    if entries <= MAX_BROADCAST:
        drawn = docs.join(F.broadcast(tables), "_source")
    else:
        drawn = spread_join(docs, tables, ["_source"], "doc_id", rates.select(key("source"), "n"))
    return drawn.withColumn("_count", (F.col("_first") + F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).cast("int")).where("_count > 0").drop("_source", "_first", "_cdf", "_u")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, seed: int = 17) -> DataFrame:
    """docs' columns, then copy (from 1) and mix_key: the place in the global order, by which partitions and rows are sorted."""
    rates = written(source_rates(docs, weights, power), "rates")
    drawn = _drawn(docs, rates, seed)
    names = [c for c in docs.columns if c not in ("copy", "mix_key")]
    n = partitions(docs)
    one = F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy")
    if rates.where(f"rate > {CHUNK} / 2").limit(1).count():  # a count beyond a chunk is out of reach of smaller rates
        many = drawn.where(f"_count > {CHUNK}").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_count") - 1) / CHUNK).cast("int"))))
        many = many.repartition(n, F.col("doc_id"), F.col("_chunk"))
        first = F.col("_chunk") * CHUNK
        many = many.select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(first + 1, F.least(first + CHUNK, F.col("_count")))).alias("copy"))
        out = drawn.where(f"_count <= {CHUNK}").select(*[F.col(f"`{c}`") for c in names], one).unionByName(many)
    else:
        out = drawn.select(*[F.col(f"`{c}`") for c in names], one)
    out = out.withColumn("mix_key", uniform(seed + 1, F.col("doc_id"), F.col("copy")))
    return out.repartitionById(n, F.floor(F.col("mix_key") * n).cast("int")).sortWithinPartitions("mix_key")


def op6_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE s AS (SELECT source, sum(CAST(length(coalesce(text, '')) AS DOUBLE)) AS size FROM documents GROUP BY 1),
w AS (SELECT source, size, CASE WHEN size > 0 THEN sqrt(size) ELSE 0 END AS weight FROM s),
r AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT sum(weight) FROM w) * (SELECT sum(size) FROM w) / size ELSE 0 END AS rate FROM w),
c(source, rate, k, lp, cdf) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM r WHERE rate > 0
  UNION ALL SELECT source, rate, k + 1, lp + ln(rate / (k + 1)), cdf + exp(lp + ln(rate / (k + 1))) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|17'), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY ALL),
e AS (SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n)
SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || copy || '|18'), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS mix_key FROM e
"""
