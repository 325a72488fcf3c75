"""Text, URL, name and time functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The five predefined character references and the no-break space.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# Accented Latin letters and the base letters they fold to.
ACCENTED = "ßàáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BASE = "saaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
# Time formats, tried in this order.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd MMM yyyy HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd"]


def clean_text(c: Column) -> Column:
    """Without tags, references decoded, white space collapsed."""
    plain = F.regexp_replace(c, "<[^>]*>", " ")
    return F.trim(F.regexp_replace(reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, plain), r"\s+", " "))


def letters_only(c: Column) -> Column:
    """Upper-case ASCII letters of the text, each run of anything else as one space."""
    return F.trim(F.regexp_replace(F.upper(F.translate(c, ACCENTED, BASE)), "[^A-Z]+", " "))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[a-z]+://([^/?#:]*)", 1))


def links(c: Column) -> Column:
    """Distinct http links of a text in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(https?://[^\s\"'<>]+)"), F.lit(1)))


def code_links(c: Column, hosts: list[str], most: int = 4) -> Column:
    """The first few links to known hosts with a path of at least two parts."""
    known = lambda x: url_host(x).isin(hosts) & (F.size(F.split(x, "/")) > 4)
    return F.slice(F.filter(links(c), known), 1, most)


def safe_url(c: Column) -> Column:
    return F.when(c.rlike("^https?://[^/]+"), c)


def unwrap_url(c: Column, parameter: str = "url") -> Column:
    """The target of a click wrapper's parameter, else the link itself."""
    inner = F.regexp_extract(c, rf"[?&]{parameter}=([^&#]+)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(c)


def parse_time(c: Column) -> Column:
    """A timestamp by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS])


def norm_name(c: Column) -> Column:
    """Letters in upper case and the number in at least four digits: ``Name. 139`` becomes ``NAME0139``."""
    flat = F.upper(F.regexp_replace(c, r"[^A-Za-z0-9]+", ""))
    head, digits = F.regexp_extract(flat, r"^([A-Z]+)", 1), F.regexp_extract(flat, r"([0-9]+)$", 1)
    return F.concat(head, F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def safe_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; numbers stay as they are."""
    risky = c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def numbers(c: Column) -> Column:
    """Numbers in prose: array of (token, value, decimals, percent)."""
    tokens = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?%?)"), F.lit(1))
    bare = lambda x: F.replace(x, F.lit("%"), F.lit(""))
    return F.transform(tokens, lambda x: F.struct(x.alias("token"), bare(x).cast("double").alias("value"), F.length(F.regexp_extract(bare(x), r"\.([0-9]+)$", 1)).alias("decimals"), x.endswith("%").alias("percent")))


def said(c: Column, most: int) -> Column:
    """An activity's own words: without comments, code fences and quoted lines, cut to a length."""
    text = reduce(lambda x, p: F.regexp_replace(x, p, " "), ["(?s)<!--.*?-->", "(?s)```.*?```", r"(?m)^>.*$"], c)
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def letter_hits(a: Column, b: Column) -> Column:
    """Positions at which two texts have the same letter."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))))


def term_hits(c: Column, terms: list[str]) -> Column:
    """Distinct terms of a list that stand in the text as whole words of letters, digits and _ of any script, lower-cased and sorted."""
    pattern = r"(?<![\p{L}\p{N}_])(" + "|".join(sorted(map(str.lower, terms), key=lambda x: (-len(x), x))) + r")(?![\p{L}\p{N}_])"
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1))))


def keyword_score(c: Column, groups: dict[str, tuple[list[str], int, int]], negative: list[str], penalty: int) -> tuple[Column, Column]:
    """(score 0..100, parts): each group gives points per matched term up to a limit; negative terms cost."""
    points = {name: F.least(F.size(term_hits(c, terms)) * each, F.lit(most)) for name, (terms, each, most) in groups.items()}
    total = reduce(lambda a, b: a + b, points.values()) - F.size(term_hits(c, negative)) * penalty
    parts = F.array(*[F.struct(F.lit(n).alias("label"), p.alias("points")) for n, p in points.items()])
    return F.greatest(F.lit(0), F.least(F.lit(100), total)), parts


def has_word(c: Column, terms: list[str]) -> Column:
    """Whether one of the terms stands in the text as a whole word."""
    return F.lower(c).rlike(r"(^|[^\p{L}\p{N}_])(" + "|".join(terms) + r")([^\p{L}\p{N}_]|$)")


def words(c: Column) -> Column:
    return F.split(c, " ")


def locate(queries: DataFrame, texts: DataFrame, query: str, key: str, gram: int, broadcast_rows: int = 100_000) -> DataFrame:
    """query, candidates, distance, key, start: where each query reads best in the texts, by edit distance. queries and texts: an id and w, an array of words.

    Every run of ``gram`` words that both share proposes the window that lines it up; windows are as long as the query. The queries' runs are
    broadcast up to a checked count.
    """
    runs = lambda df, at: df.where(F.size("w") >= gram).select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - gram + 1), lambda i: F.array_join(F.slice("w", i, F.lit(gram)), " "))).alias(at, "g"))
    wanted = runs(queries, "i").select(query, F.size("w").alias("n"), "i", "g")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    spots = runs(texts, "j").drop("w").join(wanted, "g").select(query, key, F.greatest(F.lit(0), F.col("j") - F.col("i")).alias("start"), "n").distinct()
    read = spots.join(queries.select(query, F.array_join("w", " ").alias("q")), query).join(texts, key)
    window = F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ")
    found = read.select(query, key, "start", F.levenshtein("q", window).alias("distance"))
    best = F.min(F.struct("distance", key, "start")).alias("b")
    return found.groupBy(query).agg(F.count("*").alias("candidates"), best).select(query, "candidates", "b.distance", f"b.{key}", "b.start")
