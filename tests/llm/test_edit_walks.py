"""Edit fingerprints against walks taken step by step, neighbours by brute force, near classes of planted edits."""

import hashlib
import random

import numpy as np

from spindrift.llm import edit_walks as ew

ALPHABET = "abcdefghijklmnopqrstuvwxyz      .,\nÀé中\U0001f600"


def written_down(text, walk):
    """Every character that the walk writes down, by the random bits themselves."""
    bits = np.random.default_rng(1000 + walk).integers(0, 2, (256, ew.PERIOD), dtype=np.uint8)
    out, i, classes = [], 0, ew.classes_of(text)
    while i < len(classes):
        out.append(classes[i])
        i += int(bits[classes[i], (len(out) - 1) % ew.PERIOD])
    return out


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def edits(rng, text, rate):
    return "".join(c if rng.random() > rate else rng.choice(["", c + rng.choice(ALPHABET), rng.choice(ALPHABET)]) for c in text)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_fingerprints_are_samples_of_the_walk():
    rng = random.Random(1)
    for n in (0, 1, 2, 40, 300, 5000, 30_000):
        text = random_text(rng, n)
        for walk, (end, bits) in enumerate(ew._parsed(ew.fingerprint(text))):
            steps, own = ew._samples(walk)
            seen = written_down(text, walk)
            assert end == len(seen)
            own = steps[own[ew._power(end)]]
            assert [int(b) for b in bits[: len(own)]] == [int(ew._bits(walk)[np.searchsorted(steps, s), seen[s]]) if s < end else 0 for s in own]


def test_samples_of_longer_texts_lie_within_those_of_shorter_ones():
    for walk in range(ew.WALKS):
        steps, own = ew._samples(walk)
        for power in range(ew.LEAST + 1, 30):
            longer, shorter = steps[own[power]], steps[own[power - 1]]
            assert set(longer[longer < 1 << (power - 1)]) <= set(shorter) and ew.SAMPLES * 3 // 5 < len(longer) + (power < 10) * ew.SAMPLES and longer.max() < 1 << power


def test_likeness_estimates_the_share_of_equal_steps():
    rng = random.Random(2)
    for rate in (0.0, 0.002, 0.01, 0.05):
        for n in (2000, 9000):
            a = random_text(rng, n)
            b = edits(rng, a, rate) + random_text(rng, rng.choice([0, 500]))
            shares = []
            for walk in range(ew.WALKS):
                x, y = written_down(a, walk), written_down(b, walk)
                shares.append(sum(p == q for p, q in zip(x, y, strict=False)) / max(len(x), len(y)))
            assert abs(ew.likeness(ew.fingerprint(a), ew.fingerprint(b)) - max(shares)) < 0.17
    assert ew.likeness(ew.fingerprint(""), ew.fingerprint(None)) == 1.0 and ew.likeness(ew.fingerprint(""), ew.fingerprint("a")) == 0.0
    same = ew.fingerprint("one text")
    assert ew.likeness(same, same) == 1.0


def test_side_by_side_like_one_by_one(monkeypatch):
    rng = random.Random(3)
    texts = [random_text(rng, rng.choice([0, 1, 2, 3, 10, 100, 700])) for _ in range(150)] + [random_text(rng, 20_000), random_text(rng, 3)]
    own, edited = ew._side_by_side(texts)
    assert own == [ew.fingerprint(t) for t in texts]
    for i, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
        cut = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        assert edited[i] == ew.fingerprint(cut) and ew._one_by_one(a, b) == (own[i], edited[i])
    monkeypatch.setattr(ew, "CHUNK", 13)
    assert [ew.fingerprint(t) for t in texts] == own


def brute(rows):
    """Of each row, in order, the columns of edited_neighbours but the likenesses."""
    out = []
    for (doc_id, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, following = text or "", following or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), ew.fingerprint(text), ew.fingerprint(edited), ew.likeness(ew.fingerprint(text), ew.fingerprint(edited)), ew.likeness(ew.fingerprint(text), ew.fingerprint(following))))
    return out


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=str)


def test_neighbours_over_many_ranges(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i * 7 - 300, None if i % 31 == 0 else random_text(rng, rng.randrange(400)), "x", 1) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, first int").repartition(7)
    assert as_rows(ew.edited_neighbours(df)) == sorted(brute([r[:2] for r in sorted(rows, reverse=True, key=lambda r: r[0])]), key=str)
    for n in (1, 2):  # fewer rows than partitions: the first row is also the last of its range
        few = spark.createDataFrame(rows[1 : n + 1], "doc_id long, text string, part string, first int")
        assert as_rows(ew.edited_neighbours(few)) == sorted(brute([r[:2] for r in sorted(rows[1 : n + 1], reverse=True, key=lambda r: r[0])]), key=str)


def test_small_groups_and_long_texts(monkeypatch):
    rng = random.Random(9)
    texts = [random_text(rng, n) for n in (5, 900, 30, 0, 2500, 40, 7)]
    whole = ew.compared(texts)
    monkeypatch.setattr(ew, "GROUP", 1000)
    assert ew.compared(texts) == whole


def test_neighbours_of_odd_rows(spark, odd, none):
    got = as_rows(ew.edited_neighbours(odd))
    assert len(got) == odd.count() and {r[1] for r in got if r[0] in (4, 5)} == {max(len(r["text"] or "") for r in odd.collect())}
    prints = {}
    for r in odd.collect():
        prints.setdefault(ew.fingerprint(r["text"]), set()).add(r["text"] or "")
    assert all(len(x) == 1 for x in prints.values()) and {r[3] for r in got} == set(prints)
    assert next(r[5] for r in got if r[0] == 2) == 1.0  # an empty text and its edited text
    assert ew.edited_neighbours(none).count() == 0 and ew.near_classes(none).count() == 0
    classes = {(r["doc_id"], r["class_id"]) for r in ew.near_classes(odd).collect()}
    assert {(1, 1), (2, 1), (4, 4), (5, 4), (6, 6), (None, None)} <= classes


def test_edit_distance_like_the_table():
    rng = random.Random(6)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        b = edits(rng, a, 0.3) if rng.random() < 0.7 else "".join(rng.choice("abc") for _ in range(rng.randrange(90)))
        want = plain_distance(a, b)
        assert ew.edit_distance(a, b) == want and min(want, 6) == min(ew.edit_distance(a, b, 5), 6)


def test_recall_of_near_classes(spark):
    """Of texts with one edit in 200 characters at most a twentieth is lost; unlike texts stay apart."""
    rng = random.Random(7)
    rows, first = [], {}
    for i in range(120):
        text = random_text(rng, rng.randrange(300, 3000))
        rows.append((2 * i, text))
        rows.append((2 * i + 1, edits(rng, text, 0.005) if i % 3 else random_text(rng, 800)))
        first[2 * i], first[2 * i + 1] = 2 * i, 2 * i if i % 3 else 2 * i + 1
    got = {r["doc_id"]: r["class_id"] for r in ew.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == first.keys() and all(got[d] == first[d] for d in got if first[d] == d)
    near = [d for d in got if first[d] != d]
    assert sum(got[d] == first[d] for d in near) >= 0.95 * len(near)
