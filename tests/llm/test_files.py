"""Token files and packaged archives: exact round trips."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spindrift.llm import huffman_ids as hf
from spindrift.llm import packaged_warc as pw
from spindrift.llm.common import work_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def huffman_cost(counts):
    import heapq

    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 1000, 300)
    lengths = hf.code_lengths(counts, 30).astype(int)
    assert int((counts * lengths).sum()) == huffman_cost(counts.tolist())
    steep = np.array([2**i for i in range(20)])
    assert hf.code_lengths(steep, 30).max() > 8
    short = hf.code_lengths(steep, 6).astype(int)
    assert short.max() <= 6 and sum(2.0**-n for n in short) <= 1
    assert hf.code_lengths(np.array([0, 5, 0]), 16).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        hf.code_lengths(np.ones(5), 2)


@pytest.mark.parametrize("n", [0, 1, 5, 512, 513, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 700).astype(np.int64)
    lengths = hf.code_lengths(np.bincount(ids, minlength=700), 16)
    bits, offsets = hf.pack_bits(ids, lengths, hf.canonical_codes(lengths), 64)
    back = hf.unpack_bits(bits, offsets.astype(np.int64), 64, hf.decode_table(lengths, 16), 16)[:n] if n else ids
    assert (back == ids).all()


def test_any_range_of_a_file(tmp_path):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 900, 3000)
    lengths = hf.code_lengths(np.bincount(ids, minlength=900), 16)
    (tmp_path / "x.ids").write_bytes(hf.shard_bytes([5, None], np.array([1000, 2000]), ids, 77, lengths, hf.canonical_codes(lengths), 128, 16))
    s = hf.Shard(f"file://{tmp_path}/x.ids")
    assert s.doc_ids == [5, None] and s.head["start"] == 77
    for a, b in ((0, 3000), (127, 129), (500, 500), (2990, 3000), (1000, 1001)):
        assert (s.ids(a, b) == ids[a:b]).all()


def test_pieces_give_the_library_s_ids():
    rng = random.Random(5)
    alphabet = list("abzÀéß019.,!?'-*# \n\t\x1c ́İΣ中") + ["'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", ". ", ", ", "!.", ".\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    encoder = hf.WordEncoder(PATH, 1)
    want = [np.array([*e.ids, 1], dtype="<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want and encoder.encode(texts[::-1]) == want[::-1]


def test_words_with_marks_give_the_library_s_ids_text_by_text():
    rng = random.Random(6)
    alphabet = list("abEÉßøıɏɐ×÷ª\xa0٣¼'\"#$%&()*+,-./:;<=>?@[]^_`{|}~\\ \ń̈Σςﬁ")
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", "", "ab", " "]) for _ in range(rng.randrange(25))) for _ in range(4000)]
    encoder, tokenizer = hf.WordEncoder(PATH, 1, most=2000), Tokenizer.from_file(PATH)
    for t in texts:
        assert encoder.encode([t]) == [np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()], t


def test_token_files_of_odd_rows(odd, none):
    rows = sorted(odd.collect(), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    t = Tokenizer.from_file(PATH)
    want = [np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4") for r in rows]
    got = sorted(hf.token_files(odd).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(w.tobytes()) for w in want]
    assert [r["start"] for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]
    assert hf.token_files(none).count() == 0


def test_ranges_ascend_and_split_hot_orders():
    rng = random.Random(7)
    bounds = np.array([5, 5, 5, 9, 2**62, 2**62])
    rows = sorted(((rng.choice([None, 1, 4, 5, 5, 5, 6, 9, 10, 2**62 - 1, 2**62, 2**62 + 1]), rng.randrange(2**32)) for _ in range(600)), key=lambda r: (-1 if r[0] is None else r[0], r[1]))
    parts = [hf.part_of(o, c, bounds, 2) for o, c in rows]
    assert parts == sorted(parts) and set(parts) == set(range(9))


def test_files_in_another_order(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}", (i * 37) % 100) for i in range(100)], "doc_id long, text string, place int")
    t = Tokenizer.from_file(PATH)
    got = sorted(hf.token_files(docs, order=docs["place"]).collect(), key=lambda r: r["start"])
    rows = sorted(docs.collect(), key=lambda r: r["place"])
    want = [zlib.crc32(np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4").tobytes()) for r in rows]
    assert [r["ids_crc32"] for r in got] == want and [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]


class Bytes:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, at, n):
        return self.data[at : at + n]


def test_directory_like_zipfile():
    for zip64 in (False, True):
        data = pw.package([(1, "http://a/", b"x" * 1000, None), (2, "http://b/", b"", 1)], zip64)
        z = zipfile.ZipFile(io.BytesIO(data))
        members = pw.zip_members(Bytes(data))
        assert list(members) == z.namelist()
        for name, m in members.items():
            at, n = pw.stored_range(Bytes(data), m)
            assert data[at : at + n] == z.read(name)


def test_zip64_directory():
    name, body = b"archive/data.warc.gz", b"stored bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHI", 9, 4, 0) + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(central), 1)
    comment = b"with PK\5\6 in it"
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment
    data = local + central + end64 + locator + end
    members = pw.zip_members(Bytes(data))
    at, n = pw.stored_range(Bytes(data), members[name.decode()])
    assert data[at : at + n] == body
    for broken in (data[: len(local)], b"PK\5\6", b""):
        with pytest.raises(ValueError):
            pw.zip_members(Bytes(broken))


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "a" * 100)
    with pytest.raises(ValueError):
        pw.stored_range(Bytes(out.getvalue()), pw.zip_members(Bytes(out.getvalue()))["a"])


def test_archives_round_trip(spark):
    rows = [(1, "http://a/", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (3, "http://c/", "Été \U0001f600\r\n\r\nWARC/1.1"), (4, None, None), (9, "http://d/", ""), (None, "http://e/", "<p>same</p>"), (5, "http://b/", "<p>same</p>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    got = pw.read_packages(pw.write_packages(pages, work_dir(spark, "warc"), package_bytes=20), payloads=True).collect()
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        payload = (html or "").encode()
        r = next(r for r in got if r["page_id"] == page_id and r["url"] == url)
        assert r["payload_digest"] == pw.payload_digest(payload) and r["payload_bytes"] == len(payload)
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == payload
    kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got)
    assert kinds == [("1", "revisit", "5"), ("3", "response", "None"), ("4", "revisit", "9"), ("5", "response", "None"), ("5", "response", "None"), ("9", "response", "None"), ("None", "revisit", "5")]
    small = pw.read_packages(pw.write_packages(pages, work_dir(spark, "warc"), min_bytes=5)).where("record_type = 'revisit'").count()
    assert small == 2
    assert pw.read_packages(pw.write_packages(pages.limit(0), work_dir(spark, "warc"))).count() == 0
