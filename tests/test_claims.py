"""Blocks, stated numbers and findings about claims on small documents."""

from pyspark.sql import functions as F

from spindrift.operators import claims

TEXT = "# Head\nFirst line\nsecond  line.\n\n> quote\n- item one\n  more of it\n- **Bold lead** and rest\n  - nested stays\n1. numbered\nafter it\n\n<!-- note -->\n| a | b |\n|---|:--|\n| 1 | 2.5% |\nparagraph\n## Sub\n***\nFirst line second line."


def test_blocks_names_and_cells(spark):
    df = spark.createDataFrame([(1, TEXT, 5), (1, TEXT, 5), (2, None, 5), (3, "", 5), (4, " \n\n", 5), (None, "no key", 5), (5, "…\n\n…", 5)], "doc long, text string, block int")
    got = sorted((str(r["doc"]), r["block"], r["kind"], r["name"], r["text"], r["cells"]) for r in claims.blocks(df, "doc", "text").collect())
    want = [
        ("1", 2, "paragraph", "first-line-second-line", "First line second  line.", None), ("1", 6, "item", "item-one-more-of-it", "item one more of it", None), ("1", 8, "item", "bold-lead", "**Bold lead** and rest - nested stays", None),
        ("1", 10, "item", "numbered-after-it", "numbered after it", None), ("1", 14, "row", "a-b", "| a | b |", ["a", "b"]), ("1", 16, "row", "1-2-5", "| 1 | 2.5% |", ["1", "2.5%"]), ("1", 17, "paragraph", "paragraph", "paragraph", None),
        ("1", 19, "paragraph", "first-line-second-line-2", "*** First line second line.", None), ("5", 1, "paragraph", "block", "…", None), ("5", 3, "paragraph", "block-2", "…", None), ("None", 1, "paragraph", "no-key", "no key", None),
    ]
    assert got == sorted(want)
    assert claims.blocks(df.limit(0), "doc", "text").count() == 0


def test_numbers_and_what_supports_them(spark):
    df = spark.createDataFrame([("12 of 1,234,567, or 3.50% (-7.25); v2 and 1.2.3 x",), (None,), ("none",)], "text string")
    got = [(r["token"], r["value"], r["decimals"], r["percent"]) for r in claims.stated_numbers(df, "text").collect()]
    assert got[:4] == [("12", 12.0, 0, False), ("1,234,567", 1234567.0, 0, False), ("3.50%", 3.5, 2, True), ("-7.25", -7.25, 2, False)]

    def plain(v, d, pct, s):
        close = lambda c, t: c == t if d == 0 else abs(round(c, d) - t) < 10 ** (-d - 3)
        return any(close(c, t) for c in [s, abs(s)] + ([s * 100, abs(s) * 100] if pct else []) for t in (v, abs(v)))

    cases = [(v, d, p, s) for v, d in ((3.0, 0), (3.5, 1), (-3.25, 2), (0.0, 0)) for p in (False, True) for s in (3.0, 3.04, -3.5, 3.2496, 0.035, 0.03, -3.25, 0.0, 3.46)]
    rows = spark.createDataFrame(cases, "v double, d int, p boolean, s double")
    got = {tuple(r)[:4]: r["ok"] for r in rows.withColumn("ok", claims.supports(F.col("v"), F.col("d"), F.col("p"), F.col("s"))).collect()}
    assert got == {c: plain(*c) for c in cases}


def test_findings(spark):
    numbers = [("a", "x", "5"), ("a", "x", "6"), ("a", "y", "7"), ("b", "z", "8"), ("b", "w", "9")]
    n = spark.createDataFrame([(d, k, t, float(t), 0, False) for d, k, t in numbers], "doc string, name string, token string, value double, decimals int, percent boolean")
    ledger = spark.createDataFrame([("x", "s1", "p1"), ("x", "s1", "p1"), ("y", "s2", "old"), ("y", "gone", "p"), ("z", "a", None), ("unused", "gone", "p")], "name string, source string, pin string")
    sources = spark.createDataFrame([("s1", "p1", [5.0, 1.0]), ("s2", "new", [7.0]), ("a", "q", [8.0])], "source string, digest string, values array<double>")
    checked = spark.createDataFrame([("a",), ("b",)], "doc string")
    got = {tuple(r) for r in claims.findings(n, ledger, sources, checked).collect()}
    assert got == {("unmatched", "a", "x", "6"), ("changed", "a", "y", "s2"), ("missing", "a", "y", "gone"), ("self", "b", "z", "a"), ("unmatched", "b", "z", "8"), ("unsourced", "b", "w", "1")}
    assert claims.findings(n.limit(0), ledger, sources, checked).count() == 0
    assert {r["code"] for r in claims.findings(n, ledger.limit(0), sources, checked).collect()} == {"unsourced"}

