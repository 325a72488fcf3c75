"""Rule ensemble, near-duplicates, passages, main text and the pipeline."""

import itertools
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spindrift.llm import bagminhash as bm
from spindrift.llm import collinear as cl
from spindrift.llm import consensus_html as ch
from spindrift.llm import rule_ensemble as re_
from spindrift.llm.common import folded_words

SF = "/root/testdata/sf0.001"


def edited(rng, words, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def bag(text):
    w = folded_words(text)
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_classes(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = sum((bags[a] & bags[b]).values())
        if (both and both / sum((bags[a] | bags[b]).values()) >= 0.8) or (rows[a][1] or "") == (rows[b][1] or ""):
            root[find(b)] = find(a)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: low[find(i)] for i, (d, _) in enumerate(rows)}


def test_rules_separate_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = re_.score_quality(docs, labels).join(labels, "doc_id").select("held_out", "score", "quality").toPandas()
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.9


def test_scores_without_labels_of_both_kinds(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in re_.score_quality(odd, empty).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1), (4, 1), (6, None), (None, 0)], "doc_id long, quality int")
    assert all(r["score"] > 0.9 for r in re_.score_quality(odd, one).collect())
    assert re_.score_quality(none, one).count() == 0 and re_.keep_good(odd, one).columns == odd.columns


def test_statistics_are_finite():
    for text in (None, "", " ", "a", "\U0001f600" * 5, "A!! " * 100, "x" * 100_000):
        s = re_.text_statistics(text)
        assert len(s) == len(re_.STATISTICS) and np.isfinite(s).all()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(7)
    for low, high in ((1, 2), (1, 12)):
        elements = rng.integers(0, 2**63, 60).astype(np.uint64)
        a, b = rng.integers(low, high, 60), rng.integers(low, high, 60)
        a[:15], b[20:35] = 0, 0
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        m, hits = 256, []
        for _ in range(12):
            e = elements ^ np.uint64(rng.integers(0, 2**62))
            doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
            s = bm.signatures(doc, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, m)
            hits.append((s[0] == s[1]).mean())
        assert np.isfinite(s).all() and abs(np.mean(hits) - want) < 4 * (want * (1 - want) / (m * 12)) ** 0.5 + 0.002


def test_classes_equal_all_pairs(spark):
    rng = random.Random(11)
    rows, n = [], itertools.count()
    for _ in range(6):
        base = [f"b{rng.randrange(5000)}" for _ in range(rng.randrange(20, 160))]
        rows += [(next(n), " ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.04, 0.08])))) for _ in range(25)]
        rows += [(next(n), " ".join(base[: rng.randrange(10, len(base))])) for _ in range(8)]
    rows += [(next(n), t) for t in ("", "one two", "one two", "a a a a a a a a a a a a", "a " * 13, "x", "x y z")]
    got = {r["doc_id"]: r["class_id"] for r in bm.classes_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_classes(rows)
    assert sum(got[d] != want[d] for d in want) == 0


def test_near_duplicates_of_odd_rows(odd, none):
    got = bm.classes_of(odd).collect()
    assert len(got) == odd.count()
    assert {r["class_id"] for r in got if r["doc_id"] in (4, 5)} == {4} and {r["class_id"] for r in got if r["doc_id"] in (1, 2, 8)} == {1}
    kept = bm.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "7", "None"]
    assert bm.classes_of(none).count() == 0 and bm.keep_one(none).count() == 0


def test_chains_score_like_all_predecessors():
    rng = random.Random(13)
    for case in range(400):
        top = rng.choice([15, 60, 300])
        pieces = sorted({(rng.randrange(top), rng.randrange(top), rng.randrange(2, 12)) for _ in range(rng.randrange(1, 30))})
        cost, best = rng.choice([0.1, 0.5]), []
        value = lambda j, i: -cost * ((pieces[i][0] - pieces[j][0] - pieces[j][2]) + (pieces[i][1] - pieces[j][1] - pieces[j][2])) - max(0, pieces[j][0] + pieces[j][2] - pieces[i][0], pieces[j][1] + pieces[j][2] - pieces[i][1])  # noqa: B023, E731
        for i, (p, o, n) in enumerate(pieces):
            # neighbours that overlap must ascend; those that do not are in order by themselves
            options = [best[j] + value(j, i) for j, (q, r, m) in enumerate(pieces[:i]) if r < o or (q + m <= p and r + m <= o)]
            best.append(max([0.0, *options]) + n)
        found = cl.chain(pieces, cost)
        assert sorted(x for c in found for x in c) == sorted(pieces)
        index = {x: i for i, x in enumerate(pieces)}
        score = sum(x[2] for x in found[0]) + sum(value(index[a], index[b]) for a, b in zip(found[0], found[0][1:], strict=False))
        assert abs(score - max(best)) < 1e-9, case
    assert cl.chain([(0, 0, 8), (10, 10, 8), (20, 200, 8)], 0.1)[0] == [(0, 0, 8), (10, 10, 8)]


def exact_repeats(rows, size=50):
    """(doc, start) of every run of size words that another text holds too."""
    held = {}
    for d, text in rows:
        w = folded_words(text)
        for i in range(len(w) - size + 1):
            held.setdefault(tuple(w[i : i + size]), []).append((d, i))
    texts = dict(rows)
    return [x for x in held.values() if len({texts[d] for d, _ in x}) > 1]


def test_every_exact_repeat_is_covered(spark):
    rng = random.Random(41)
    words = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    rows, shared = [], [words(rng.randrange(50, 160)) for _ in range(8)]
    for passage in shared:
        # earlier documents hold slices, later ones the whole, some with edits
        rows += [words(9) + passage[a : a + 37] + words(9) for a in range(0, len(passage) - 36, 23)]
        rows += [words(30) + edited(rng, passage, rng.choice([0, 0, 0.1])) + words(30) for _ in range(4)]
    rows += [sum((rng.choice([words(12), p[(a := rng.randrange(20)) : a + rng.randrange(20, 90)]]) for p in rng.choices(shared, k=6)), []) for _ in range(40)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = cl.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    repeats = exact_repeats(rows)
    assert len(repeats) > 400
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        a, b = (folded_words(rows[d][1])[s:e] for d, s, e in ((r["doc_id"], r["start"], r["end"]), (r["source_id"], r["source_start"], r["source_end"])))
        assert r["end"] - r["start"] >= 50 and r["identity"] >= 0.8 and r["matched"] <= cl.common_words(np.array(a), np.array(b))
    # the first document that holds a run need not have it as a passage; all others do
    missed = [(d, i) for x in repeats for d, i in x if d != min(d for d, _ in x) and not any(a <= i and i + 50 <= b for a, b in cl.union(spans.get(d, ())))]
    assert not missed


def test_few_pieces_cover_all_words():
    rng = random.Random(59)
    for _ in range(200):
        pieces = sorted((rng.randrange(60), rng.randrange(60), rng.randrange(3, 15), 0) for _ in range(rng.randrange(1, 25)))
        words = lambda some: {i for p, _, n, _ in some for i in range(p, p + n)}
        got = cl.covering(pieces)
        assert words(got) == words(pieces)
        assert all(words(got) != words([x for x in got if x is not y]) for y in got)


def test_one_passage_over_slices_of_earlier_documents(spark):
    rng = random.Random(43)
    words = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    passage = words(120)
    rows = [words(20) + passage[a : a + 37] + words(20) for a in (0, 28, 56, 83)] + [words(30) + passage + words(30) for _ in range(2)]
    got = cl.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["start"], r["end"], r["source_id"], r["identity"]) for r in got] == [(5, 30, 150, 4, 1.0)]


def test_a_long_passage_of_one_chain_grows_over_the_margin(spark):
    rng = random.Random(47)
    words = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    passage = words(3000)
    # every fifth word differs but in one place: seeds are found there only
    other = [w if i % 5 or 1500 <= i < 1560 else words(1)[0] for i, w in enumerate(passage)]
    rows = [words(50) + passage + words(50), words(70) + other + words(50)]
    got = cl.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(1), margin=20).collect()
    assert len(got) == 1 and got[0]["end"] - got[0]["start"] > 2900


def test_planted_passages_are_found(spark):
    rng = random.Random(17)
    word = lambda: f"r{rng.randrange(10**7)}"
    passage = [word() for _ in range(80)]
    rows = [(i, " ".join([word() for _ in range(40)] + (edited(rng, passage, 0.04 if i % 2 else 0) if i < 12 else []) + [word() for _ in range(30)])) for i in range(20)]
    got = cl.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r["doc_id"] for r in got} | {r["source_id"] for r in got}
    assert ids == set(range(12))
    assert all(r["start"] >= 30 and r["end"] <= 130 and r["identity"] >= 0.8 for r in got)
    cut = {r["doc_id"]: r["text"] for r in cl.cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(cut[i].split()) < 90 for i in range(12)) == 11 and all(cut[i] == rows[i][1] for i in range(12, 20))


def test_chains_are_cut_at_gaps():
    rng = random.Random(23)
    word = lambda: rng.randrange(10**7)
    align = lambda a, b, *rest: cl.align(np.array(a), np.array(b), *rest)[0]
    for size, gap, other in [(60, 40, 40), (60, 100, 100), (60, 250, 250), (50, 33, 33), (200, 100, 90), (200, 1000, 900), (60, 40, 0)]:
        first, second = ([word() for _ in range(size)] for _ in range(2))
        a, b = ([word() for _ in range(9)] + first + [word() for _ in range(g)] + second + [word() for _ in range(9)] for g in (gap, other))
        at, to = 9 + size + gap, 9 + size + other
        want = [(9, 9 + size, 9, 9 + size, size), (at, at + size, to, to + size, size)]
        assert align(a, b, [(12, 12, 30), (at + 5, to + 5, 30)], 50, 0.8) == want
        if gap == other:
            assert align(a, b, [(12, 12, gap + size + 30)], 50, 0.8) == want
    # pieces too short alone stay together, and a small gap is no cut
    a = [word() for _ in range(130)]
    b = a[:30] + [word() for _ in range(6)] + a[33:]
    assert align(a[:60], b[:63], [(0, 0, 30), (33, 36, 27)], 50, 0.8) == [(0, 60, 0, 63, 57)]
    assert align(a, b, [(0, 0, 30), (33, 36, 97)], 20, 0.8) == [(0, 130, 0, 133, 127)]


def test_pages_share_head_and_foot_around_their_bodies(spark):
    rng = random.Random(29)
    words = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    head, foot = words(60), words(60)
    sizes = [40, 60, 100, 250, 400, 1000]
    rows = [(i, " ".join(head + words(n) + foot)) for i, n in enumerate(sizes)]
    got = cl.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(i, s, s + 60) for i, n in enumerate(sizes) for s in (0, 60 + n)}
    last = {r["source_id"] for r in got}
    assert len(last) == 1 and {(r["doc_id"], r["start"], r["end"]) for r in got} == {w for w in want if w[0] not in last}


def test_passages_whose_parts_have_earlier_holders(spark):
    rng = random.Random(31)
    words = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    whole, quoted = words(60), [words(20) for _ in range(4)]
    rows = [words(20) + part + words(20) for part in (whole[:30], whole[30:], *quoted)]
    rows += [words(20) + body + words(20) for body in (whole, sum(quoted, [])) for _ in range(2)]
    got = cl.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(1)).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["source_id"]) for r in got} == {(7, 20, 80, 6), (9, 20, 100, 8)}


def test_edited_passages_are_found(spark):
    rng = random.Random(37)
    words = lambda n: [f"r{rng.randrange(10**7)}" for _ in range(n)]
    rows = []
    for _ in range(60):
        passage = words(60)
        rows += [words(30) + passage + words(30), words(30) + [w if i % 10 else words(1)[0] for i, w in enumerate(passage, 5)] + words(30)]
    got = cl.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string").coalesce(1)).collect()
    assert len({(r["doc_id"], r["source_id"]) for r in got} & {(2 * i + 1, 2 * i) for i in range(60)}) >= 57


def test_passages_of_odd_rows(odd, none):
    got = cl.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} in ({(5, 4)}, {(4, 5)})
    assert len({i for r in got for i in range(r["start"], r["end"])}) == 30_000
    assert cl.repeated_passages(none).count() == 0 and cl.cut_passages(odd).columns == odd.columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="x1">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main"><article class="post-77"><h1>Title &amp; more</h1><p>First  <b>bo</b>ld<br>line &eacute;&#233;.<p>Second<!-- c --> one<div class="ad banner">Buy</div>
<ul><li>item one<li>item two</ul><form><input value="x">Form text</form><section class="comments"><p>Reader says hi</p></section></article></div>
<aside>Side</aside><footer>&copy; F</footer></body></html>"""


def test_main_text():
    page = ch.Page(PAGE)
    scores = page.by_path()
    assert max(scores, key=scores.get) == "/body.x0/div/article.post-0"
    assert ch.main_text(PAGE, None) == "Title & more\n\nFirst bold line éé.\n\nSecond one\n\nitem one\n\nitem two"
    for broken in (None, "", "<", "<p", "</p></p>", "<!-- open", "<script>x", "text only", "<p class='a>x", "<div" * 500, "</>", "<!", "a < b > c", "<p title=don't>y</p>"):
        assert isinstance(ch.main_text(broken, None), str)
    assert ch.main_text("text only", None) == "text only" and ch.main_text("a < b &lt; c", None) == "a < b < c" and ch.main_text("<p title=don't>y</p>", None) == "y"


P = lambda t, n=1: "".join(f"<p>{t} {i} with a number of words in it.</p>" for i in range(n))


def lines(html, winners=None):
    return [x.split(" with ")[0] for x in ch.main_text(html, winners).split("\n\n")]


def test_what_belongs_to_the_article_stays():
    nested = f"<body><nav>Menu</nav><article><h1>Title</h1>{P('Lead')}<div class='body'>{P('Text', 9)}</div><p>Closing</p></article><div class='ad'>Buy</div></body>"
    assert lines(nested) == ["Title", "Lead 0", *[f"Text {i}" for i in range(9)], "Closing"]
    sections = "<article><h1>A</h1>" + "".join(f"<div>{P(f'Part {i}')}</div>" for i in range(3)) + "<p>Closing</p></article>"
    assert lines(sections) == ["A", "Part 0 0", "Part 1 0", "Part 2 0", "Closing"]
    intro = f"<article><section>{P('Intro', 6)}</section>{P('Rest', 3)}</article>"
    assert len(lines(intro)) == 9
    assert lines(f"<main><h1>T</h1><section>{P('a', 3)}</section><section>{P('b', 2)}</section></main>") == ["T", "a 0", "a 1", "a 2", "b 0", "b 1"]
    assert lines(f"<body><h1>T</h1><div class='left'><a href='/'>x</a></div><div class='text'>{P('a', 3)}</div></body>") == ["T", "a 0", "a 1", "a 2"]
    assert lines(f"<article><header><nav><h2>Menu</h2></nav><h1>T</h1><p>By me</p></header>{P('a')}</article>") == ["T", "a 0"]


def test_names_are_taken_as_wholes():
    for name in ("content no-sidebar", "has-sidebar", "entry-header", "with-comments", "post-title", "headers"):
        assert lines(f"<body><div class='{name}'>{P('a', 3)}</div><div class='copyright'><p>small print</p></div></body>")[:1] == ["a 0"], name
    for name in ("sidebar", "cookie-notice", "site-header", "post-comments", "adBanner", "share_buttons", "widget2", "main-menu", "page-header", "article-footer"):
        assert lines(f"<body><article>{P('a')}<div class='{name}'>{P('b', 5)}</div></article></body>") == ["a 0"], name
    assert lines(f"<body><article><h2 id='related-work'>Related</h2>{P('a')}<section id='notification'>{P('b')}</section></article>") == ["Related", "a 0", "b 0"]
    assert lines(f"<body><form class='widget'>{P('a', 2)}</form></body>") == ["a 0", "a 1"]  # nothing else is there


def test_time_and_memory_are_linear():
    import time
    import tracemalloc

    pages = [
        "<p>x <a " + "y" * 10_000 + "<p>", "<p>x <a " + "y " * 200_000, "<a <" * 200_000, "<a x=\"" * 100_000 + ">", "<a x=\">" * 100_001, "<p>" + "<b>" * 50_000 + "</i>" * 50_000, "<div>" * 50_000 + "x" + "</p>" * 50_000, "<div>x" * 50_000,
        "<div class='c9'><p>x</p>" * 20_000, "<li>x" * 50_000, "<table><tr><td>x" * 20_000, "<!--" * 100_000, "<script>" * 50_000, "<i><div>" * 30_000 + "</i>" * 30_000, "<a class " + "class " * 50_000 + ">", "& " * 500_000, "<div>" * 9_000 + "<div>x</div>" * 9_000,
    ]
    tracemalloc.start()
    for page in pages:
        began = time.process_time()
        ch.main_text(page, ["/div"])
        assert time.process_time() - began < 15, page[:40]
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_two_layouts_of_a_host():
    page = f"<body><div class='a'>{P('short')}</div><div class='b'>{P('real', 60)}</div></body>"
    assert lines(page, ["/body/div.a", "/body/div.b"]) == [f"real {i}" for i in range(60)]
    assert lines(page, ["/body/div.x", "/body/div.b"])[0] == "real 0"
    assert lines(f"<body><div class='a'>{P('voted', 4)}</div><div class='b'>{P('longer', 9)}</div></body>", ["/body/div.a"]) == [f"voted {i}" for i in range(4)]


def test_host_paths_outvote_a_page(spark):
    body = lambda i: "".join(f"<p>Paragraph {i} {j} with a number of words in it.</p>" for j in range(4))
    pages = [(i, f"http://h.example/{i}", f"<body><div class='text{i}'>{body(i)}</div><div class='other'>{'<p>More text that is not the article.</p>' * (9 if i == 0 else 0)}</div></body>", "p") for i in range(6)]
    pages += [(7, None, None, "p"), (8, "not a url", "<p>alone</p>", "p"), (None, "http://h.example/x", "", "p")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r["text"] for r in ch.extract_text(df).collect()}
    assert "More text" not in got[0] and got[0].startswith("Paragraph 0 0") and got[7] == "" and got[8] == "alone" and got[None] == ""
    assert "More text" in ch.main_text(pages[0][2], None)  # without the vote
    assert ch.extract_text(df.limit(0)).count() == 0


def article_text(html):
    """The article of the given pages, by cutting strings."""
    import html as h
    import re

    inner = re.sub(r"(?s)<!--.*?-->|<(div|form|section)\b[^>]*(?:class=\"(?:ad|comments?)\")[^>]*>.*?</\1>", "", html.split("<article>")[1].split("</article>")[0])
    parts = re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote)\b[^>]*>", inner)
    texts = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_given_pages_against_cut_strings(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in ch.extract_text(pages).collect()}
    assert len(got) == len(html) == 250
    assert all(got[i][0] == article_text(x) and got[i][1] == len(got[i][0]) for i, x in html.items())


def test_varied_pages_where_the_vote_decides(spark):
    rng = random.Random(53)
    rows, want = [], {}
    for i in range(60):
        paragraphs = [f"Article {i} {j} " + "word " * rng.randrange(5, 30) + "end." for j in range(rng.randrange(2, 7))]
        talk = [f"Reader {i} {j} " + "says " * rng.randrange(20, 60) + "so." for j in range(rng.randrange(0, 9) if i % 4 == 0 else 0)]  # not marked as comments
        lead, rest = paragraphs[:1], paragraphs[1:]
        rows.append((i, f"http://host{i % 3}/p{i}", f"<html><body><div class='nav'>Menu</div><div class='wrap'><div class='post-{i}'><h1>Title {i}</h1>{''.join(f'<p>{x}</p>' for x in lead)}<div class='inner'>{''.join(f'<p>{x}</p>' for x in rest)}</div></div><div class='talk'>{''.join(f'<p>{x}</p>' for x in talk)}</div></div></body></html>"))
        want[i] = "\n\n".join([f"Title {i}", *paragraphs])
    got = {r["page_id"]: r["text"] for r in ch.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
    assert any(ch.main_text(html, None) != want[i] for i, _, html in rows)  # the vote changes these


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = cp.quality(spark, docs, SF)
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == cp.COLUMNS and sum((d in ids) == (q == 1) for d, q in labels.items()) > 0.9 * len(labels)
    rows = [(r["doc_id"], r["text"]) for r in good.orderBy("doc_id").collect()]
    one = cp.near_duplicates(spark, good, SF)
    assert {r["doc_id"] for r in one.collect()} == set(brute_classes(rows).values())
    items = [folded_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + min(10, len(w))]) for w in items for i in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(g) for g in grams}
    leaked = {d for d, t in rows for w in [folded_words(t)] for n in sizes if any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))}
    clean = cp.decontamination(spark, one, SF)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - leaked
    mixed = cp.mixing(spark, clean, SF)
    assert mixed.columns == cp.COLUMNS and 0.5 < mixed.count() / clean.count() < 1.6
    files = cp.token_files(spark, mixed, SF)
    assert files.count() == mixed.count() and files.select(F.sum("n_tokens")).first()[0] == files.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]


def test_pipeline_of_odd_and_empty_tables(spark, odd, none, tmp_path):
    import zlib

    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    given = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}

    def folder(name, docs):
        for t, df in {**given, "documents": docs}.items():
            df.write.parquet(f"file://{tmp_path}/{name}/{t}.parquet")
        return f"file://{tmp_path}/{name}"

    more = odd.withColumn("doc_id", F.col("doc_id") + 1_000_000)  # null ids stay null
    both = folder("both", given["documents"].unionByName(more, allowMissingColumns=True))
    docs = spark.read.parquet(f"{both}/documents.parquet")
    stages = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, both)
        assert docs.columns == cp.COLUMNS
        docs.write.parquet(f"file://{tmp_path}/{name}")
        stages[name] = docs = spark.read.parquet(f"file://{tmp_path}/{name}")
    mixed = docs.collect()
    got = sorted(cp.token_files(spark, docs, both).collect(), key=lambda r: r["start"])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in mixed]
    # the files keep the mixed rows in the order they are read, and copies of a document apart
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(r["doc_id"], len(x), zlib.crc32(x.tobytes())) for r, x in zip(mixed, ids, strict=True)]
    assert [r["start"] for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    counts = Counter(r["doc_id"] for r in got)
    assert max(counts.values()) > 1 and sum(a["doc_id"] == b["doc_id"] for a, b in zip(got, got[1:], strict=False)) < 0.1 * sum(n for n in counts.values() if n > 1)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in stages["decontamination"].collect()}
    empty = cp.run(spark, folder("empty", none))
    assert empty.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and empty.count() == 0
    rejected = cp.run(spark, folder("rejected", odd.where("text is null")))
    assert rejected.count() == 0


def test_readers_comments_go_and_look_alike_names_stay():
    body = "<h1>Title</h1><p>The article has a long first paragraph, with commas, and more of it.</p><p>And a second paragraph that goes on for a while.</p>"
    plain = "Title\n\nThe article has a long first paragraph, with commas, and more of it.\n\nAnd a second paragraph that goes on for a while."
    page = lambda inner: f"<html><body><nav><a href=/x>Home</a></nav><article>{body}{inner}</article><footer>foot</footer></body></html>"
    gone = [
        '<section id="comments"><p>First! I like this text a lot.</p></section>', '<section class="responses"><p>A reply of a reader.</p></section>', '<article class="comment-body"><p>Nested comment.</p></article>', '<div id="disqus_thread"><p>Loading</p></div>',
        '<div class="comment-list"><p>one</p></div>', '<div class="share-buttons"><p>Share</p></div>', '<div class="related-posts"><p>More</p></div>', '<div class="site-header"><p>Site</p></div>', '<ol class="commentlist"><li>c</li></ol>', '<div class="cookie-banner"><p>We use cookies</p></div>',
    ]
    for inner in gone:
        assert ch.main_text(page(inner), None) == plain, inner
    kept = [
        '<p title="see class=ad here">Kept text.</p>', '<p data-x="a id=comments b">Kept text.</p>', "<p data-y='role=navigation'>Kept text.</p>", '<div class="share-price"><p>Kept text.</p></div>', '<div class="related-work"><p>Kept text.</p></div>', '<div class="comment-on-method"><p>Kept text.</p></div>',
        '<div class="informed-consent"><p>Kept text.</p></div>', '<div id="navigation-theory"><p>Kept text.</p></div>', '<section id="related"><p>Kept text.</p></section>', '<div class="no-sidebar"><p>Kept text.</p></div>', '<p data-class="ad">Kept text.</p>', '<p CLASS=lead id=x>Kept text.</p>',
    ]
    for inner in kept:
        assert ch.main_text(page(inner), None) == plain + "\n\nKept text.", inner
    standfirst = page("").replace(body, "<header><h1>Title</h1><p class='lead'>A standfirst.</p><nav><a href=/>up</a></nav><p class='share'>Share</p></header>" + body[14:])
    assert ch.main_text(standfirst, None) == plain.replace("Title", "Title\n\nA standfirst.")
    assert ch.main_text(page("").replace("<article>", "<header><h2>Site</h2><p>Slogan</p></header><article>"), None) == plain


def edited_passage(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < rate / 3 else [f"r{rng.randrange(10**9)}"] if x < 2 * rate / 3 else [w, f"n{rng.randrange(10**9)}"] if x < rate else [w]
    return out


def test_recall_of_edited_passages(spark):
    """Passages of 60 words of which 15 in 100 are deleted, replaced or followed by a new one: nine in ten of those of identity 0.8 are found."""
    rng = random.Random(21)
    fresh = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    rows, wanted = [], []
    for i in range(100):
        passage = fresh(60)
        copy = edited_passage(rng, passage, 0.15)
        code = {w: j for j, w in enumerate(dict.fromkeys(passage + copy))}
        same = cl.common_words(*(np.array([code[w] for w in x], dtype=np.uint64) for x in (passage, copy)))
        rows += [(2 * i, " ".join(fresh(150) + passage + fresh(150))), (2 * i + 1, " ".join(fresh(90) + copy + fresh(200)))]
        if len(copy) >= 50 and same >= 0.8 * max(60, len(copy)):
            wanted.append(2 * i + 1)
    got = {r["doc_id"] for r in cl.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect() if r["source_id"] == r["doc_id"] - 1 and r["identity"] >= 0.8}
    assert len(wanted) > 90 and sum(d in got for d in wanted) >= 0.9 * len(wanted)


def test_longest_common_subsequences_of_large_gaps():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        best = np.zeros(len(b) + 1, int)
        for w in a:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (b == w)))
        assert cl.common_words(a, b) == best[-1]
        x, y, same = cl.end_alignment(a, b)
        assert same <= cl.common_words(a[:x], b[:y]) and 2 * same >= max(x, y)
    same = rng.integers(0, 2**60, 5000)
    a, b = (np.insert(same, rng.integers(0, 5000, 40_000), rng.integers(0, 2**60, 40_000)).astype(np.uint64) for _ in range(2))
    assert cl.common_words(a, b) == 5000
