"""Token alignment against loops over tokens of the tokenizers libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from spindrift.llm import token_alignment as ta

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(PATH_A), SentencePieceProcessor(model_file=PATH_B)
A.encode_special_tokens = True
LETTERS = {i: chr(i) for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LETTERS |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in LETTERS)}
BYTES = {c: b for b, c in LETTERS.items()}
TEXTS = ["Hello, world! don't  stop\n\n now", "été naïve 中文 \U0001f600 ok", "<|endoftext|> and <s> </s> <unk> <0x41>", "  leading", "trailing  ", "\t\tx\r\ny", "a", " ", "▁ lower block", "12345 678", "É", "ﬁ ½ ①", "x" * 3000, " " * 7000 + "z"]


def tokens(text):
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    in_a = [bytes(BYTES[c] for c in A.id_to_token(i)) for i in a]
    in_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    return ([], []) if b"".join(in_a) != raw or b"".join(in_b) != raw else (list(zip(a, in_a, strict=True)), list(zip(b, in_b, strict=True)))


def ranges(items):
    at, out = 0, []
    for i, raw in items:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def aligned(text):
    """(n_a, n_b, groups as text, links)."""
    a, b = map(ranges, tokens(text) if text else ([], []))
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] if len(a) * len(b) < 1e6 else None
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, low = [], 0
    for cut in cuts:
        groups.append(",".join(str(i) for i, s, e in a if low < e <= cut) + "|" + ",".join(str(i) for i, s, e in b if low < e <= cut))
        low = cut
    return len(a), len(b), ";".join(groups), links


def random_texts(n):
    rng = random.Random(2)
    parts = ["the ", "ing", "é", " ", "\n", "中", "Th", "qu", "1", "23", ".", ", ", "'s", "<|endoftext|>", "\U0001f600", "́", "-", "▁", "\x00", "zz"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def brute(rows):
    one = {t: aligned(t) for _, t in rows}
    counts = Counter(p for _, t in rows for p in set(one[t][3]))
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for doc_id, text in rows:
        n_a, n_b, groups, links = one[text]
        out.append((doc_id, n_a, n_b, groups.count("|") if n_a else 0, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else ""))
    return sorted(map(str, out)), counts


def test_measures_of_single_texts():
    for text, row in zip(TEXTS, ta.align(TEXTS, PATH_A, PATH_B), strict=True):
        n_a, n_b, groups, links = aligned(text)
        assert row[:2] == (n_a, n_b), text
        if n_a:
            assert row[4] == hashlib.sha256(groups.encode()).hexdigest() and row[3] == n_a + n_b - row[2]
        if links is not None:
            shift, found = 15, Counter(links)
            pairs = [(p >> shift, p & ((1 << shift) - 1)) for p in ta._pairs_of(row[5]).tolist()]
            assert dict(zip(pairs, ta.unpacked(row[6]).tolist(), strict=True)) == dict(found)
    assert [r[0] for r, t in zip(ta.align(TEXTS, PATH_A, PATH_B), TEXTS, strict=True) if "▁" in t] == [0]


def test_ranks_give_the_library_s_ids():
    texts = TEXTS + random_texts(1500)
    assert ta.ByteTokens(PATH_A).encode(texts) == [A.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("max_pairs", [ta.MAX_PAIRS, 40])
def test_documents_by_broadcast_and_by_buckets(spark, max_pairs):
    texts = random_texts(60)
    rng = random.Random(3)
    rows = [(i, rng.choice(texts) if i % 3 else texts[0]) for i in range(150)] + [(500, None), (501, ""), (None, texts[1]), (7, texts[2])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, k1 string")
    found, _, pairs = ta.alignments(df, max_pairs=max_pairs)
    want, counts = brute(rows)
    assert sorted(str(tuple(r)) for r in found.collect()) == want
    got = {(r["a"], r["b"]): r["n"] for r in pairs.collect()}
    assert got == dict(counts)
    assert all(r["best"] == (r["n"] == max(n for (a, _), n in counts.items() if a == r["a"])) for r in pairs.collect())


def test_alignment_of_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = ta.alignments(odd)[0].collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[4]["groups_sha256"] == by_id[5]["groups_sha256"] != "" and by_id[4]["n_links"] == by_id[4]["n_a"] + by_id[4]["n_b"] - by_id[4]["n_groups"]
    assert [tuple(by_id[i])[1:] for i in (1, 2)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert ta.alignments(none)[0].count() == 0
    assert ta.alignments(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))[0].count() == 2
