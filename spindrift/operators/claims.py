"""Documents as blocks (items, paragraphs, table rows), the numbers that blocks state, and findings about their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import written

#: A line that separates blocks; the beginning of an item; a table row; a row of dashes below a table's head; a number.
BREAK, ITEM, ROW, RULE, NUMBER = r"^\s*($|#|>|<!--)", r"^([-*+]|\d+[.)])\s+", r"^\s*\|.*\|\s*$", r"^[\s|:-]*$", r"(?<![\w.,])-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?%?(?!\w)"


def _bound(value: Column, then) -> Column:
    """then(value), with the value computed once a row however often it is used."""
    return F.transform(F.array(value), then)[0]


def _blocks_of(lines: Column) -> Column:
    """block, kind, text, base and n (which of its base's in the document) of each block of one document's lines, in order of base.

    The lines stay in their row: nothing is sorted or grouped over rows. A line behind a separator or a table row begins a
    block, so a block is the lines from its first one to the next block or separator.
    """
    row, item = (lambda x: x.rlike(ROW)), (lambda x: x.rlike(ITEM))
    gap = lambda x: x.rlike(BREAK) | (row(x) & x.rlike(RULE))
    flags = F.transform(lines, lambda x: F.when(gap(x), 0).when(row(x), 3).when(item(x), 2).otherwise(1))  # 0: separator, 1: other

    def from_flags(flag: Column) -> Column:
        begins = lambda f, i: (f >= 2) | ((f == 1) & ((i == 0) | F.get(flag, i - 1).isin(0, 3)))
        first = F.filter(F.transform(flag, lambda f, i: F.when(begins(f, i), i)), lambda i: i.isNotNull())
        return _bound(first, lambda at: F.transform(at, lambda i, k: block(flag, i, F.coalesce(F.get(at, k + 1), F.size(lines)) - i)))

    def block(flag: Column, i: Column, n: Column) -> Column:
        kind = F.get(flag, i)
        said = F.transform(F.slice(lines, i + 1, n), lambda x: F.when(gap(x), F.lit(None)).when(item(x), F.regexp_replace(x, ITEM, "")).otherwise(F.trim(x)))
        text = F.array_join(said, " ")  # without nulls
        return F.struct((i + 1).alias("block"), F.when(kind == 3, "row").when(kind == 2, "item").otherwise("paragraph").alias("kind"), text.alias("text"))

    def named(b: Column) -> Column:
        lead = F.regexp_extract(b["text"], r"^\s*\*\*(.+?)\*\*", 1)
        words = F.slice(F.regexp_extract_all(F.lower(F.when(lead != "", lead).otherwise(b["text"])), F.lit("[a-z0-9]+"), F.lit(0)), 1, 8)
        base = F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("block")
        return F.struct(base.alias("base"), b["block"].alias("block"), b["kind"].alias("kind"), b["text"].alias("text"))

    def numbered(b: Column) -> Column:
        heads = F.filter(F.transform(b, lambda x, i: F.when((i == 0) | (x["base"] != F.get(b, i - 1)["base"]), i)), lambda i: i.isNotNull())
        return _bound(heads, lambda at: F.flatten(F.transform(at, lambda i, k: F.transform(F.slice(b, i + 1, F.coalesce(F.get(at, k + 1), F.size(b)) - i), lambda x, j: x.withField("n", j + 1)))))

    return _bound(F.array_sort(F.transform(_bound(flags, from_flags), named)), numbered)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block (its first line, from 1), name, kind, text and cells of each block of each document.

    A block is an unindented list item with the lines that follow it, a paragraph (lines in a row) or a table row, whose cells
    are trimmed (null for others); blank lines, headings, quotes and comments separate blocks and belong to none. Lines are
    joined by a space. A name is the first eight words of a-z and 0-9 (of the bold lead, if there is one), lower-cased and
    joined by -, with -2, -3 on repeats in a document. Null texts have no blocks; rows that repeat a key are taken once.
    """
    once = docs.where(F.col(text).isNotNull()).dropDuplicates([key])
    found = once.select(key, F.explode(_bound(F.split(text, "\n"), _blocks_of)).alias("b")).select(key, "b.*")
    name = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    cells = F.when(F.col("kind") == "row", F.transform(F.split(F.regexp_replace("text", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return found.select(key, "block", name.alias("name"), "kind", "text", cells.alias("cells"))


def stated_numbers(df: DataFrame, text: str) -> DataFrame:
    """df with token, value, decimals and percent of each number that the text states; rows without one are left out."""
    out = df.withColumn("token", F.explode(F.regexp_extract_all(F.col(text), F.lit(NUMBER), F.lit(0))))
    plain = F.regexp_replace("token", "[,%]", "")
    return out.withColumns({"value": plain.cast("double"), "decimals": F.length(F.regexp_extract(plain, r"\.(\d+)$", 1)), "percent": F.col("token").endswith("%")})


def supports(value: Column, decimals: Column, percent: Column, source: Column) -> Column:
    """Whether a source value, its size, or these times 100 for a percentage, rounds to the stated value or its size; whole numbers must be equal."""
    def close(c: Column, t: Column) -> Column:
        scale = F.pow(F.lit(10.0), decimals)
        return F.when(decimals == 0, c == t).otherwise(F.abs(F.round(c * scale) / scale - t) < F.pow(F.lit(10.0), -decimals - 3))

    direct = close(source, value) | close(F.abs(source), F.abs(value)) | close(source, F.abs(value)) | close(F.abs(source), value)
    return direct | (percent & (close(source * 100, value) | close(F.abs(source * 100), F.abs(value))))


def findings(numbers: DataFrame, ledger: DataFrame, sources: DataFrame, checked: DataFrame) -> DataFrame:
    """code, doc, name, detail: what is wrong with the claims.

    numbers: doc, name, token, value, decimals, percent (a block's name is its key in the ledger); ledger: name, source, pin;
    sources: source, digest, values; checked: doc, the documents that are checked themselves. Codes: unsourced (a block that
    states numbers without a ledger entry; detail: how many), self (a checked document as source), missing (a source that is not there), changed
    (its digest is not the pinned one) and unmatched (a number that no source of its block supports; detail: the number).
    Ledger entries of blocks that state no number are not looked at.
    """
    numbers = written(numbers, "numbers")  # read five times below
    stated = numbers.select("doc", "name").distinct()
    entries = ledger.select("name", "source", "pin").distinct()
    lone = numbers.groupBy("doc", "name").agg(F.count("*").alias("n")).join(entries.select("name").distinct(), "name", "left_anti")
    out = lone.select(F.lit("unsourced").alias("code"), "doc", "name", F.col("n").cast("string").alias("detail"))
    used = stated.join(entries, "name").join(checked.select(F.col("doc").cast("string").alias("source"), F.lit(True).alias("own")).distinct(), "source", "left")
    own = used.where("own")
    out = out.unionByName(own.select(F.lit("self").alias("code"), "doc", "name", F.col("source").alias("detail")))
    used = used.where("own is null").join(sources.select("source", "digest", "values", F.lit(True).alias("there")), "source", "left")
    state = F.when(F.col("there").isNull(), "missing").when(~F.col("digest").eqNullSafe(F.col("pin")), "changed")
    out = out.unionByName(used.withColumn("code", state).where("code is not null").select("code", "doc", "name", F.col("source").alias("detail")))
    values = used.where("there").select("doc", "name", F.explode("values").alias("v")).distinct()
    hit = numbers.join(values, ["doc", "name"]).where(supports(F.col("value"), F.col("decimals"), F.col("percent"), F.col("v"))).select("doc", "name", "token").distinct()
    claimed = numbers.join(entries.select("name").distinct(), "name", "left_semi").select("doc", "name", "token").distinct()
    bad = claimed.join(hit, ["doc", "name", "token"], "left_anti")
    return out.unionByName(bad.select(F.lit("unmatched").alias("code"), "doc", "name", F.col("token").alias("detail")))
