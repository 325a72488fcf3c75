"""What the training-data operators share: words, work folders and written intermediate tables."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of words after lower-casing A-Z: digits, a-z and all of UTF-8 beyond ASCII; the rest separates.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def folded_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8. Null has none."""
    return utf8(text).translate(_FOLD).split()


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, in this order; further columns of any name stay out of an operator's way."""
    return df.select(*[df[f"`{n}`"] for n in names])


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing and the master is local (tests on one machine) it is a new local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: lineage ends there and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast at most, behind a count of them; beyond it the join is by shuffle.
MAX_BROADCAST = 100_000
#: Keys at most that :func:`spread_join` treats as hot.
HOT_KEYS = 20_000


def few(df: DataFrame) -> DataFrame:
    """The rows, to be broadcast where their checked count allows it."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: str, counts: DataFrame, how: str = "inner", least: int = 1000) -> DataFrame:
    """left joined to right on keys of which some may be hot: right has a row for each key, counts (a written table) has column n, the rows of left of each key.

    The rows of a key of more than ``least`` rows are dealt by column ``by`` over several parts of at most about so many, and
    the key's row in right is repeated for each part. The bound rises with the rows, so there are never more than
    :data:`HOT_KEYS` such keys, which are broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(least, -(-total // HOT_KEYS))
    hot = counts.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    if not hot.limit(1).count():
        return left.join(right, on, how)
    left = left.join(F.broadcast(hot), on, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    right = right.join(F.broadcast(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def few_or_spread(left: DataFrame, right: DataFrame, on: list[str], by: str, counts: DataFrame) -> DataFrame:
    """left joined to right by broadcast where the checked count of right allows it, and by :func:`spread_join` elsewhere."""
    if right.count() <= MAX_BROADCAST:
        return left.join(F.broadcast(right), on)
    return spread_join(left, right, on, by, counts)


def filesystem(url: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and the path in it; plain paths and file: URLs are local."""
    parts = urlparse(url)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), parts.path
    return pafs.FileSystem.from_uri(url)


def write_file(url: str, data: bytes) -> None:
    """Write the whole file under another name, then move it: a retried task replaces it, a lost one leaves nothing half done."""
    fs, path = filesystem(url)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


class WordHashes(dict):
    """64-bit hashes of words, remembered; at most ``most`` of them when a text begins."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all rolling k-grams of word hashes; k is mixed in, so sizes never meet."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def text_keys() -> list:
    """Two 64-bit hashes of column text: rows with both equal have the same text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")]


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node in links (a, b: long), by alternating large and small stars.

    Each round is written to the shared folder; nothing but two sums per round reaches the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == seen:
            break
        seen = (now["n"], now["s"])
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
