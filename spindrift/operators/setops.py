"""Snapshots, catalogs and ledgers: diffs, reconciliation, dedup, merges, splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fingerprint(cols: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(cols)]), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, change: new, changed or gone."""
    a, b = old.select(F.col(key).alias("k_old"), fingerprint(cols).alias("f_old")), new.select(F.col(key).alias("k_new"), fingerprint(cols).alias("f_new"))
    change = F.when(F.col("k_old").isNull(), "new").when(F.col("k_new").isNull(), "gone").when(F.col("f_old") != F.col("f_new"), "changed")
    return a.join(b, F.col("k_old") == F.col("k_new"), "full_outer").select(F.coalesce("k_new", "k_old").alias(key), change.alias("change")).where("change is not null")


def incremental(current: DataFrame, previous: DataFrame, key: str, cols: list[str], carry: list[str]) -> DataFrame:
    """current with action keep (unchanged: carry columns come from previous) or measure."""
    p = previous.select(F.col(key).alias("_k"), fingerprint(cols).alias("_f"), *[F.col(c).alias(f"_{c}") for c in carry])
    joined = current.withColumn("_now", fingerprint(cols)).join(p, F.col(key) == F.col("_k"), "left")
    keep = F.col("_f").eqNullSafe(F.col("_now"))
    return joined.select(*current.columns, F.when(keep, "keep").otherwise("measure").alias("action"), *[F.when(keep, F.col(f"_{c}")).alias(f"carried_{c}") for c in carry])


def first_per(df: DataFrame, by: list, order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_rn = 1").drop("_rn")


def dedup_by_hash(df: DataFrame, content: str, key: str) -> DataFrame:
    """keep (the first copy's key), copies (how many), size per distinct content; rows without content are their own group."""
    group = F.coalesce(F.sha2(content, 256), F.concat(F.lit("key:"), F.col(key).cast("string")))
    return df.groupBy(group.alias("hash")).agg(F.min(key).alias("keep"), F.count("*").alias("copies"), F.max(F.coalesce(F.length(content), F.lit(0))).alias("size"))


def merge_secondary(primary: DataFrame, secondary: DataFrame, on: str, cols: list[str]) -> DataFrame:
    """primary with its missing fields filled from secondary rows, then the secondary rows without a primary."""
    s = secondary.select(F.col(on).alias("_on"), *[F.col(c).alias(f"_{c}") for c in cols])
    filled = primary.join(s, F.col(on) == F.col("_on"), "left").select(on, *[F.coalesce(c, f"_{c}").alias(c) for c in cols], F.col("_on").isNotNull().alias("folded"))
    rest = secondary.join(primary.select(on), on, "left_anti").select(on, *cols, F.lit(False).alias("folded"))
    return filled.unionByName(rest)


def merge_registry(base: DataFrame, extension: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row per key: a later non-null field wins."""
    both = base.select(key, *cols).withColumn("_p", F.lit(0)).unionByName(extension.select(key, *cols).withColumn("_p", F.lit(1)))
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_p"))).alias(c) for c in cols], F.count("*").alias("sources"))


def reconcile(meta: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """key, era: current (in both), superseded (only described), listing-only."""
    a, b = meta.select(F.col(key).alias("a")).distinct(), listing.select(F.col(key).alias("b")).distinct()
    era = F.when(F.col("b").isNull(), "superseded").when(F.col("a").isNull(), "listing-only").otherwise("current")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), era.alias("era"))


def exposure(df: DataFrame, records: DataFrame) -> DataFrame:
    """df (scroll, segment) with the level of the record for its segment, else of its scroll, else none."""
    exact = records.where("segment is not null").groupBy("scroll", "segment").agg(F.max("level").alias("exact"))
    wide = records.where("segment is null").groupBy("scroll").agg(F.max("level").alias("wide"))
    return df.join(exact, ["scroll", "segment"], "left").join(wide, "scroll", "left").withColumn("level", F.coalesce("exact", "wide", F.lit(0))).drop("exact", "wide")


def plan_rows(bill: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """For each asked id, once: done, running or missing."""
    state = F.when(F.col("state").isNull(), "missing").when(F.col("state") == "finished", "done").otherwise("running")
    return ids.select(key).distinct().join(bill.select(key, "state"), key, "left").select(key, state.alias("plan"))


def exclude_globs(df: DataFrame, col: str, patterns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that match no glob; and of the dropped ones only how many ids there were, and an order-free digest of them."""
    regex = "|".join("^" + "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() else ch for ch in p) + "$" for p in patterns)
    dropped = df.where(F.col(col).rlike(regex)).select(col).distinct()
    digest = dropped.agg(F.count("*").alias("ids"), F.coalesce(F.sum(F.conv(F.substring(F.sha2(col, 256), 1, 12), 16, 10).cast("decimal(30,0)")), F.lit(0)).cast("string").alias("digest"))
    return df.where(~F.col(col).rlike(regex)), digest


def public_gate(df: DataFrame, col: str, blocked: list[str]) -> DataFrame:
    """df with reason: the blocked words in a text, or null where the row may be published."""
    found = F.filter(F.array(*map(F.lit, sorted(blocked))), lambda w: F.contains(F.lower(F.col(col)), w))
    return df.withColumn("reason", F.when(F.size(found) > 0, F.array_join(found, ",")))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with errors: the names of broken rules, comma-joined and in order; empty where all hold."""
    return df.withColumn("errors", F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])), ","))


def hash_split(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    """df with held_out for about that share of keys, by hash."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256), 1, 8), 16, 10).cast("long")
    return df.withColumn("held_out", h % 100 < percent)


def chunk_holdout(df: DataFrame, key: str, text: str, size: int, every: int) -> DataFrame:
    """key, chunk, n_chars, held_out for chunks of a text; every n-th is held out."""
    n = F.ceil(F.length(text) / size).cast("int")
    out = df.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return out.select(key, "chunk", F.length(F.substring(F.col(text), F.col("chunk") * size + 1, F.lit(size))).alias("n_chars"), (F.col("chunk") % every == every - 1).alias("held_out"))


def pick_current(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest entry of each key, by a partial aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def ledger_append(ledger: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The rows of batch whose key is not in the ledger yet, each key once."""
    if unknown := set(batch.columns) - set(ledger.columns):
        raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
    return pick_current(batch, key, [c for c in batch.columns if c != key]).join(ledger.select(key), key, "left_anti")


def lookup(value: str, tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Everything about one key: kind and detail from each table's key and detail columns."""
    parts = [df.where(F.col(k).cast("string") == value).select(F.lit(kind).alias("kind"), F.col(detail).cast("string").alias("detail")) for kind, (df, k, detail) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
