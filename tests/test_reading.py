"""Local alignment, decoys and gap filling against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import ngrams as ng
from spindrift.operators import reading


def table(a, b, match, mismatch, gap):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if x == y else -mismatch), h[i - 1][j] - gap, h[i][j - 1] - gap)
    return h


def test_alignments_like_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        match, mismatch, gap = rng.choice([(1, 1, 1), (1, 2, 2), (2, 1, 3), (3, 2, 1)])
        h = table(a, b, match, mismatch, gap)
        top = max(map(max, h))
        score, a0, a1, b0, b1 = reading.align(a, b, match, mismatch, gap)
        assert score == top
        if top:
            assert (b1, a1) == min((j, i) for i, row in enumerate(h) for j, x in enumerate(row) if x == top)
            assert table(a[a0:a1], b[b0:b1], match, mismatch, gap)[-1][-1] == top and a[a0] == b[b0] and a[a1 - 1] == b[b1 - 1]


def test_every_alignment_above_a_seed_is_found(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    reads = [(i, [rng.choice(words) for _ in range(rng.randrange(12))]) for i in range(25)] + [(99, None), (98, [])]
    texts = [(i, [rng.choice(words) for _ in range(rng.randrange(40))]) for i in range(40)] + [(90, None), (91, [])]
    a = reading.decoys(spark.createDataFrame(reads, "item long, w array<string>"), "item", 3, 7)
    b = spark.createDataFrame(texts, "doc long, w array<string>")
    drawn = {(r["item"], r["draw"]): r["w"] for r in a.collect()}
    assert all(drawn[i, 0] == w and all(sorted(drawn[i, d] or []) == sorted(w or []) for d in (1, 2, 3)) for i, w in reads) and any(drawn[i, 1] != w for i, w in reads if w)
    for match, mismatch, gap in ((1, 2, 2), (1, 1, 1)):
        k = mismatch // match + 1
        want = {}
        for (i, d), w in drawn.items():
            for j, t in texts:
                score = max(map(max, table(w or [], t or [], match, mismatch, gap)))
                if score >= k * match:
                    want[i, d, j] = score
        found = reading.local_alignments(a, b, "item", "doc", match, mismatch, gap).cache()
        assert {(r["item"], r["draw"], r["doc"]): r["score"] for r in found.collect()} == want
    got = {r["item"]: r for r in reading.decoy_scores(found, a, "item", "doc", 3).collect()}
    assert got.keys() == {i for i, _ in reads}
    best = {(i, d): max((s for (p, q, _), s in want.items() if (p, q) == (i, d)), default=0) for i, d in drawn}
    for i, r in got.items():
        at = sorted(j for (p, q, j), s in want.items() if (p, q) == (i, 0) and s == best[i, 0])
        assert (r["score"], r["doc"], r["only"]) == (best[i, 0], at[0] if at else None, len(at) == 1)
        assert r["p"] == pytest.approx((1 + sum(best[i, d] >= best[i, 0] for d in (1, 2, 3))) / 4) and r["decoy_max"] == max(best[i, d] for d in (1, 2, 3))


def test_hot_runs_are_dealt_and_nothing_is_lost(spark, monkeypatch):
    reads = spark.createDataFrame([(i, ["a", "b", "c", str(i)]) for i in range(6)], "item long, w array<string>").withColumn("draw", F.lit(0))
    texts = spark.createDataFrame([(i, ["x", "a", "b", "c"]) for i in range(50)], "doc long, w array<string>")
    monkeypatch.setattr(reading, "HOT", 4)
    assert sorted((r["item"], r["doc"], r["score"]) for r in reading.local_alignments(reads, texts, "item", "doc").collect()) == [(i, j, 3) for i in range(6) for j in range(50)]
    assert reading.local_alignments(reads.limit(0), texts, "item", "doc").count() == 0 and reading.local_alignments(reads, texts.limit(0), "item", "doc").count() == 0


LETTERS = " ABC"


def prob(model, gram):
    """The interpolated probability by the tables' rows."""
    p = 1 / len(LETTERS)
    for k, (grams, back) in enumerate(model, 1):
        tail = gram[len(gram) - k :]
        p = grams.get(tail, 0.0) + back.get(tail[:-1], 1.0) * p
    return p


def test_fills_like_every_filling(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choice("AAB C") for _ in range(rng.randrange(80)))) for i in range(60)] + [(77, None), (78, "")], "doc long, t string")
    model = ng.kn_model(docs, "t", 3)
    tables = [({r["gram"]: r["p"] for r in m.collect()}, {r["context"]: r["back"] for r in m.collect()}) for m in model]
    items = reading.make_gaps(docs, "doc", "t", [1, 2, 3], 5, 4, 1).cache()
    texts = {r["doc"]: r["t"] for r in docs.collect()}
    rows = items.collect()
    assert {r["doc"] for r in rows} >= {i for i, t in texts.items() if t and len(t) >= 12} and {r["length"] for r in rows} == {1, 2, 3}
    assert all(r["left"] + r["truth"] + r["right"] in texts[r["doc"]] and (len(r["left"]), len(r["truth"]), len(r["right"])) == (5, r["length"], 4) for r in rows)
    got = {r["doc"]: r for r in reading.fill_gaps(items, "doc", model, LETTERS, 64).collect()}
    assert got.keys() == {r["doc"] for r in rows}
    for r in rows:
        whole = lambda s: "^^" + r["left"] + s + r["right"][:2]  # noqa: B023, E731
        score = lambda s: sum(math.log2(prob(tables, whole(s)[i - 2 : i + 1])) for i in range(7, len(whole(s))))  # noqa: B023, E731
        best = max(score("".join(s)) for s in itertools.product(LETTERS, repeat=r["length"]))
        assert got[r["doc"]]["score"] == pytest.approx(best, abs=1e-6) and score(got[r["doc"]]["fill"]) == pytest.approx(best, abs=1e-6)
    none = items.limit(0)
    assert reading.fill_gaps(none, "doc", model, LETTERS, 4).count() == 0


def test_report_of_fills(spark):
    items = spark.createDataFrame([(1, 2, "AB"), (2, 2, "CD"), (3, 1, "E"), (4, 1, "F")], "doc long, length int, truth string")
    a = spark.createDataFrame([(1, "AB"), (2, "XD"), (3, None)], "doc long, fill string")
    b = spark.createDataFrame([(1, "A"), (4, "F")], "doc long, fill string")
    got = {r["length"]: r for r in reading.score_fills(items, a, b, "doc", 50, 8).collect()}
    assert (got[2]["items"], got[2]["letters"], got[2]["accuracy"], got[2]["exact"], got[2]["other_accuracy"]) == (2, 4, 0.75, 0.5, 0.25)
    assert (got[1]["accuracy"], got[1]["other_accuracy"], got[0]["items"], got[0]["diff"]) == (0.0, 0.5, 4, pytest.approx(1 / 6)) and got[0]["low"] <= 1 / 6 <= got[0]["high"]
    assert reading.score_fills(items.limit(0), a, b, "doc").count() == 0
