"""File sources and sinks beyond plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_text, letters_only, safe_cell


def joined_lists(df: DataFrame, list_cols: list[str], sep: str) -> DataFrame:
    return df.withColumns({c: F.array_join(c, sep) for c in list_cols})


def write_table(df: DataFrame, path: str, list_cols: list[str] = ()) -> None:
    """JSON lines with lists as they are, CSV with lists joined by semicolons."""
    df.write.json(f"{path}/json")
    joined_lists(df, list(list_cols), ";").write.option("header", True).csv(f"{path}/csv")


def export_csv(df: DataFrame, path: str, list_cols: list[str] = (), safe: list[str] = ()) -> None:
    """CSV for spreadsheets: lists joined, text cells that look like formulas made plain."""
    joined_lists(df, list(list_cols), "; ").withColumns({c: safe_cell(F.col(c)) for c in safe}).write.option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A CSV ledger; columns by its header, cells as text unless a schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def collect_records(spark: SparkSession, path: str, schema: StructType, pattern: str = "provenance*.json", required: str | None = None, one_each: bool = True) -> DataFrame:
    """JSON records of a name below a folder, one in each file or one in each line; unreadable or shapeless ones are skipped."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", one_each).option("mode", "PERMISSIVE").json(path)
    return df.where(F.col(required or schema.fieldNames()[0]).isNotNull())


def build_corpus(pages: DataFrame, key: str, markup: str, drop: tuple[str, ...] = ("script", "style", "nav", "footer", "title")) -> DataFrame:
    """key, line: one normalised line of letters per document with a body; listed elements are dropped, hyphen breaks joined."""
    text = F.regexp_replace(markup, "(?s)<!--.*?-->", " ")
    for tag in drop:
        text = F.regexp_replace(text, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    line = letters_only(clean_text(F.regexp_replace(text, r"-\s*\n\s*", "")))
    return pages.select(key, line.alias("line")).where(F.length("line") > 0)
