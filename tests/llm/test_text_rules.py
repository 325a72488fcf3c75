"""Decontamination, line frequency, licenses, mixing."""

import random

from pyspark.sql import functions as F

from spindrift.llm import decontaminate as dc
from spindrift.llm import licenses as lc
from spindrift.llm import line_frequency as lf
from spindrift.llm import poisson_mix as pm
from spindrift.llm.common import folded_words

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_leaks_words_spans_and_items(spark):
    docs = spark.createDataFrame([(1, f"before {ITEM.upper()}, after"), (2, "short item here"), (3, "clean text of words")], "doc_id long, text string")
    bench = items(spark, (10, ITEM), (9, "Short ITEM"), (9, "Short ITEM"), (8, None), (None, "clean text"), (7, "..."))
    got = {r["doc_id"]: r for r in dc.find_leaks(docs, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"]) == (13, 11, ["10"])
    assert (got[2]["n_hit"], got[2]["items"]) == (2, ["9"]) and not got[3]["contaminated"]
    cut = {r["doc_id"]: r["text"] for r in dc.decontaminate(docs, bench, action="spans").collect()}
    assert cut == {1: "before , after", 2: " here", 3: "clean text of words"}
    assert [r["doc_id"] for r in dc.decontaminate(docs, bench).collect()] == [3]


def test_blocks_of_a_large_benchmark_give_the_same(spark):
    rng = random.Random(4)
    words = [f"v{i}" for i in range(12)]
    bench = items(spark, *[(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for i in range(40)])
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)], "doc_id long, text string")
    one = sorted(map(str, dc.find_leaks(docs, bench, n=3).select("doc_id", "n_words", "n_hit", "items").collect()))
    assert len(dc.window_blocks(bench, 3, 50)) > 1
    assert sorted(map(str, dc.find_leaks(docs, bench, n=3, max_windows=50).select("doc_id", "n_words", "n_hit", "items").collect())) == one


def test_leaks_of_odd_rows(odd, none, spark):
    bench = items(spark, (1, "one two"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["contaminated"]) for r in dc.find_leaks(odd, bench).collect())
    assert len(got) == odd.count() and sum(c for *_, c in got) == 2
    assert dc.decontaminate(odd, bench).columns == odd.columns and dc.decontaminate(odd, bench).count() == odd.count() - 2
    assert dc.find_leaks(none, bench).count() == 0 and dc.find_leaks(odd, items(spark)).where("contaminated").count() == 0


def test_repeat_words_like_a_count_of_windows():
    rng = random.Random(1)
    for n in (0, 2, 3, 50, 400):
        words = [rng.choice([b"a", b"b", b"c", b"d"]) + (b"" if rng.random() < 0.5 else b"%d" % rng.randrange(9)) for _ in range(n)]
        w = [tuple(words[i : i + 3]) for i in range(n - 2)]
        want = {j for i in range(len(w)) if w.count(w[i]) > 1 for j in range(i, i + 3)}
        assert lf.repeat_words(words) == len(want)


def test_common_lines_are_removed_but_once(spark):
    body = lambda i: " ".join(f"{chr(97 + i)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(70))
    rows = [(i, "Menu 1 Home\n" + (" ".join(["same"] + [f"{chr(97 + j % 26)}{chr(97 + j // 26)}c" for j in range(80)]) if i >= 10 else body(i)) + (f"\nt{chr(97 + i)}" if i >= 10 else ""), "h") for i in range(20)]
    got = {r["doc_id"]: r for r in lf.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=5).collect()}
    assert all(got[i]["kept"] for i in range(11)) and not any(got[i]["kept"] for i in range(11, 20))
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 3 and got[15]["n_removed"] == 84


def test_copies_are_one_document_for_line_counts(spark):
    text = " ".join(f"w{j}" for j in range(60))
    rows = [(i, text, "h") for i in range(30)]
    assert lf.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_documents=5).where("kept").count() == 30


def test_texts_lose_their_common_lines_and_no_others(spark, odd, none):
    body = lambda i, n: "\n".join(" ".join(chr(97 + i) + chr(97 + j) + chr(97 + k) for k in range(10)) for j in range(n))
    menu, note = "Home | About | Contact 12", "All  rights reserved by the owner of this page and its parts"
    rows = [(i, f"{menu}\n\n{body(i, 6)}\n{note.upper() if i % 2 else note}\nlast line {'z' * (i + 1)}", "h") for i in range(20)]
    rows += [(20, "\n".join([note] * 20) + "\n" + body(20, 3), "h"), (21, rows[3][1], "other"), (5, rows[5][1], "h"), (None, rows[0][1] + "\nno id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r["doc_id"]), r["source"], r["text"]) for r in lf.clean_texts(df, max_documents=5).collect())
    bare = lambda i: f"\n{body(i, 6)}\nlast line {'z' * (i + 1)}"
    want = [("0", "h", rows[0][1]), ("21", "other", rows[3][1]), ("None", None, rows[-1][1]), ("5", "h", bare(5))] + [(str(i), "h", bare(i)) for i in range(1, 20)]
    assert got == sorted(want)
    kept = lf.clean_texts(odd)
    assert kept.columns == odd.columns and kept.count() == lf.line_rules(odd).where("kept").count() and lf.clean_texts(none).count() == 0


def test_line_rules_of_odd_rows(odd, none):
    got = lf.line_rules(odd).collect()
    assert len(got) == odd.count() and {r["n_words"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {0}
    assert lf.line_rules(none).count() == 0


def test_license_phrases_stand_where_their_words_do(spark):
    rng = random.Random(2)
    words = ["mit", "license", "apache", "general", "public", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)).title()) for i in range(25)]
    got = {r["doc_id"]: r["spans"] for r in lc.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = [x.decode() for x in folded_words(text)]
        want = sorted((label, j) for phrase, label in lc.BASE for j in range(len(w)) if w[j : j + len(phrase.split())] == phrase.split())
        assert sorted((s["label"], s["start"]) for s in got[i] if s["base"]) == want


def test_edited_notice_is_found_and_part_of_it_is_not(spark):
    isc = next(t for label, t in lc.NOTICES if label == "isc").split()
    edited = isc[:9] + ["really"] + isc[9:20] + isc[21:]
    rows = [(1, "intro words " + " ".join(edited) + " the end"), (2, "intro " + " ".join(isc[:12])), (3, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: {s["label"] for s in r["spans"]} for r in lc.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: {"isc"}, 2: set(), 3: {"cc-by-nc"}}


def test_licenses_of_odd_rows(odd, none):
    assert lc.scan_licenses(odd).count() == odd.count() and lc.scan_licenses(none).count() == 0


def test_common_words_like_the_textbook():
    import numpy as np

    rng = random.Random(3)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lc.common_words(np.array(a), np.array(b)) == t[-1][-1]


def test_mix_reaches_target_shares(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"))
    got = {r["source"]: r["count"] for r in pm.mix(docs, {"small": 1.0, "large": 1.0}).groupBy("source").count().collect()}
    assert abs(got["small"] - 3000) < 200 and abs(got["large"] - 3000) < 200
    assert pm.mix(docs, {"small": 1.0}).where("source = 'large'").count() == 0
    keys = [r["mix_key"] for r in pm.mix(docs, {"small": 1.0}).select("mix_key").collect()]
    assert keys == sorted(keys)


def test_poisson_cdf_is_the_distribution(spark):
    import math

    for rate in (0.3, 4.0, 60.0):
        cdf = spark.range(1).select(pm.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        for k in (0, 3, 10):
            assert abs(cdf[k] - sum(math.exp(-rate) * rate**i / math.factorial(i) for i in range(k + 1))) < 1e-9
        assert cdf[-1] > 1 - 1e-9


def test_large_rates_are_inverted_alike(spark):
    rates = [1001.5, 5000.0, 250_000.0]
    got = {r["source"]: r for r in pm.large_cdf(spark.createDataFrame([(str(x), x) for x in rates], "source string, rate double")).collect()}
    small = spark.range(1).select(pm.poisson_cdf(F.lit(rates[0])).alias("c")).first()["c"]
    first, cdf = got[str(rates[0])]["first"], got[str(rates[0])]["cdf"]
    assert max(abs(a - b) for a, b in zip(small[first:], cdf, strict=False)) < 1e-9
    for x in rates:
        row = got[str(x)]
        mean = row["first"] + sum(1 - c for c in row["cdf"])  # of the counts drawn
        assert abs(mean - x) < 1e-3 and row["cdf"][0] < 1e-12 and abs(row["cdf"][-1] - 1) < 1e-6 and len(row["cdf"]) < 30 * x**0.5 + 100


def test_a_rate_of_a_million(spark):
    docs = spark.createDataFrame([(1, "x", "small"), (2, "y" * 2_000_000, "large"), (3, "", "small"), (4, None, "none")], "doc_id long, text string, source string")
    out = pm.mix(docs, {"small": 1.0, "large": 1.0}).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.count_distinct("mix_key").alias("keys")).collect()
    got = {r["doc_id"]: r["n"] for r in out}
    assert abs(got[1] - 1_000_000) < 6000 and abs(got[3] - 1_000_000) < 6000 and got.get(2, 0) <= 8 and 4 not in got
    assert all(r["n"] == r["last"] for r in out)


def test_mix_of_odd_rows(spark, odd, none):
    out = pm.mix(odd)
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy", "mix_key"]
    rates = {r["source"]: r["rate"] for r in pm.source_rates(odd).collect()}
    rows = [r.asDict() for r in odd.collect()]
    u = {r["doc_id"]: r["u"] for r in odd.select("doc_id", pm.uniform(17, F.col("doc_id")).alias("u")).collect()}

    def count(rate, x):  # by the distribution itself
        import math

        term = total = math.exp(-rate)
        k = 0
        while total <= x and rate > 0 and k < 1000:
            k += 1
            term *= rate / k
            total += term
        return k

    want = sorted((str(r["doc_id"]), r["text"]) for r in rows for _ in range(count(rates[r["source"]], u[r["doc_id"]])))
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == want and set(rates) == {"a", "b", None}
    assert pm.mix(none).count() == 0 and pm.mix(odd, {}).count() == 0
    only = pm.mix(odd, {None: 1.0})
    assert {r["source"] for r in only.select("source").collect()} <= {None}
