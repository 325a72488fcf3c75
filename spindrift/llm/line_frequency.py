"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits as 0, white space collapsed) and hashed. Per host, the distinct documents
(by text: exact copies are one document) that hold a line are counted; a line in more than ``max_documents`` of them is
boilerplate and is removed from every document of the host but the one with the smallest id. A document is depleted, and
rejected, when the removed lines held more than ``max_removed`` of its words. :func:`line_rules` gives the verdicts and
:func:`clean_texts` the kept documents without their removed lines, both from the same flags.

Only hashes and counts are shuffled, never texts: distinct (host, line, text) triples are counted after a partial
aggregation. Lines meet their common ones by broadcast up to a checked count; beyond it lines of many rows are dealt over
several tasks.

Defined results: null and empty texts have no words and fail the base rules; null hosts form one host; a null doc_id is
carried along and counts as larger than any other; repeated rows are one document for the counts and each get a verdict;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_or_spread, pick, utf8, written

_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_STATS = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, line_words array<int>"


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(words)
    if n <= size:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    if len(seen) ** size < 2**63:
        keys = np.zeros(n - size + 1, dtype=np.int64)
        for j in range(size):
            keys = keys * len(seen) + ids[j : n - size + 1 + j]
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
    else:
        windows = [tuple(ids[i : i + size]) for i in range(n - size + 1)]
        counts = Counter(windows)
        again = np.array([counts[w] > 1 for w in windows])
    covered = np.zeros(n, dtype=bool)
    for j in range(size):
        covered[j : n - size + 1 + j] |= again
    return int(covered.sum())


def _line_stats(raw: bytes) -> tuple[int, list[int], list[int]]:
    """Lines with a word that equal an earlier one; the distinct normalised lines' hashes, and the words that each covers."""
    again, seen, found = 0, set(), Counter()
    for line in raw.split(b"\n"):
        words = line.translate(_NORMAL).split()
        if words:
            again += line in seen
            seen.add(line)
            found[b" ".join(words)] += len(words)
    return again, [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in found], list(found.values())


def _stats(batches):
    for batch in batches:
        rows, docs, hosts, texts = (c.to_pylist() for c in batch.columns)
        out = []
        for text in texts:
            raw = utf8(text)
            words = raw.split()
            again, lines, sizes = _line_stats(raw)
            spaces = len(raw) - len(raw.translate(None, _SPACE))
            out.append((len(words), len(text or "") - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), again, repeat_words(words), xxhash.xxh3_64_intdigest(raw) - (1 << 63), lines, sizes))
        cols = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int64()] * 6 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(hosts, pa.string()), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names=[x.split()[0] for x in _STATS.split(", ")])


def _flagged(docs: DataFrame, host: str, max_documents: int) -> tuple[DataFrame, DataFrame]:
    """(the base counts of each row of docs, row id included; row, line and words of each line to remove)."""
    plain = pick(docs, "doc_id", host, "text").toDF("doc_id", "host", "text")
    plain = plain.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("host").cast("string").alias("host"), "text")
    stats = written(plain.mapInArrow(_stats, _STATS), "line-stats")
    h = F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("h")
    lines = stats.select("row", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), h, "text_hash", F.explode(F.arrays_zip(F.col("lines").alias("line"), F.col("line_words").alias("words"))).alias("x")).select("row", "id", "h", "text_hash", "x.line", "x.words")
    texts = lines.groupBy("h", "line", "text_hash").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    common = texts.groupBy("h", "line").agg(F.count("*").alias("texts"), F.min("id").alias("first_id"), F.sum("rows").alias("n")).where(F.col("texts") > max_documents)
    common = written(common.select("h", "line", "first_id", "n"), "common-lines")
    # a line may stand in a third of all documents
    removed = few_or_spread(lines, common.drop("n"), ["h", "line"], "row", common.select("h", "line", "n")).where("id <> first_id")
    return stats.drop("lines", "line_words"), removed.select("row", "line", "words")


def _verdicts(stats: DataFrame, removed: DataFrame, max_removed: float) -> DataFrame:
    """The base counts with base_failed, n_removed and kept, and the hashes of the lines to remove."""
    removed = removed.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("n_removed"), F.collect_list("line").alias("cut"))  # bounded by the document's lines
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    n_removed = F.coalesce("n_removed", F.lit(0)).cast("long")
    out = stats.join(removed, F.col("row") == F.col("r"), "left").withColumn("n_removed", n_removed).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed") <= max_removed * F.col("n_words")))


def line_rules(docs: DataFrame, host: str = "source", max_documents: int = 50, max_removed: float = 0.7) -> DataFrame:
    """A row for each row of docs: the base counts, n_removed (words in removed lines) and kept."""
    out = _verdicts(*_flagged(docs, host, max_documents), max_removed)
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept")


def without_lines(text: str | None, cut: list[int] | None) -> str | None:
    """The text without the lines whose normalised form has one of these hashes; the other lines stay as they are, in order."""
    if not cut or text is None:
        return text
    gone, out = set(cut), []
    for line in text.split("\n"):
        words = utf8(line).translate(_NORMAL).split()
        if not words or xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) not in gone:
            out.append(line)
    return "\n".join(out)


def clean_texts(docs: DataFrame, host: str = "source", max_documents: int = 50, max_removed: float = 0.7) -> DataFrame:
    """The rows of docs that :func:`line_rules` keeps, without the lines that it removes; columns as in docs."""
    out = _verdicts(*_flagged(docs, host, max_documents), max_removed).where("kept")
    # rows of one id, host and text have the same lines to remove
    rules = out.select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash"), F.coalesce("cut", F.array()).alias("_cut")).dropDuplicates(["_id", "_host", "_hash"])
    digest = F.udf(lambda t: xxhash.xxh3_64_intdigest(utf8(t)) - (1 << 63), "long", useArrow=True)
    same = docs["doc_id"].cast("long").eqNullSafe(rules["_id"]) & docs[f"`{host}`"].cast("string").eqNullSafe(rules["_host"]) & (digest(docs["text"]) == rules["_hash"])
    cut = F.udf(without_lines, "string", useArrow=True)
    text = F.when(F.size(rules["_cut"]) == 0, docs["text"]).otherwise(cut(docs["text"], rules["_cut"])).alias("text")
    return docs.join(rules, same).select(*[text if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op2_line_frequency(spark, sf_dir: str) -> DataFrame:
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
li AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
ln AS (SELECT doc_id, source, text, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY 1),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rg AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM rg) GROUP BY 1),
common AS (SELECT source, norm, min(doc_id) AS first_id FROM ln GROUP BY 1, 2 HAVING count(DISTINCT text) > 50),
rem AS (SELECT doc_id, sum(nw) AS n FROM ln JOIN common USING (source, norm) WHERE doc_id <> first_id GROUP BY 1),
x AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed
   FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
   NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed <= CAST(0.7 AS DOUBLE) * n_words AS kept FROM x
"""
