"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Documents are tokenised once, dealt into ranges of ascending doc_id and written as an intermediate table; the counts of
all ids (at most one row per id of the vocabulary) give the code lengths, and each run of about ``shard_ids`` ids becomes
one file in the shared folder. A file holds everything needed to read it:

    8 bytes magic, 4 bytes little-endian header size, JSON header (section sizes, counts, block size, length limit),
    zlib-packed code length of every id, doc ids (int64), null flags, ids per document (int64),
    start of the first document among all ids (in the header), bit offset of every block (uint64), code bits.

A block is ``block`` ids; its bit offset is a checkpoint, so any range of ids is read by decoding its blocks alone, and
all blocks of a range decode side by side: one table look-up gives the next id and length of each.

Documents come in ascending doc_id, or in that of another whole number, as the place in a mixed order. Ranges are cut at
quantiles of that number; a number that many rows share is cut further by their content.

Defined results: null and empty texts are the end id alone; null ids sort first; repeated rows and equal ids keep all their
rows, ordered by content; very long texts are encoded whole, one at a time; further columns are ignored; an empty table
writes no file and gives an empty result.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, partitions, work_dir, write_file, written

MAGIC = b"HUFFIDS1"
#: Characters of texts that are encoded together; a longer text is alone.
TOGETHER = 4_000_000
_LATIN = "0-9A-Za-zÀ-ÖØ-öø-įı-ɏ"
_OTHER = re.compile(f"[^\x00-\x7f{_LATIN}]")
_PIECE = re.compile(f"[^ \t\n\r\x0b\x0c{_LATIN}]*[{_LATIN}]+|[^ \t\n\r\x0b\x0c{_LATIN}]+")
#: Punctuation that may follow a word in its piece.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of UTF-8 that lead no character outside plain Latin text but those of _OTHERS; what each byte is for finding stops.
_PLAIN = bytes([*range(0xC2), *range(0xC3, 0xCA)])
_OTHERS = ("×".encode(), "÷".encode(), "İ".encode())
_KIND = bytes(0x20 if b in b" \t\n\r\x0b\x0c" else 0x2E if b in b".," else 0x61 if b > 0x7F or chr(b).isalnum() else 0x23 for b in range(256))


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level models use for each byte: itself where it prints, else the next one from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_LETTERS = _byte_letters()


def _foreign(raw: bytes) -> bool:
    """Whether a text (in UTF-8) has letters beyond plain Latin ones."""
    return bool(raw.translate(None, _PLAIN)) or any(x in raw for x in _OTHERS) or (b"\xc9" in raw and bool(_OTHER.search(raw.decode())))


def _spaced(raw: bytes) -> bytes:
    """The text with white space between pieces that are encoded one by one: in plain Latin text also where punctuation follows a letter or digit. raw: its UTF-8 with A-Z lower-cased."""
    if not raw.isascii() and _foreign(raw):
        return raw
    kinds = raw.translate(_KIND)
    if b"#." in kinds or b".." in kinds:  # stops after other punctuation belong to it
        return " ".join(_PIECE.findall(raw.decode())).encode()
    for a, b in ((b". ", b" . "), (b", ", b" , "), (b".\n", b" . "), (b",\n", b" , ")):
        raw = raw.replace(a, b)
    return raw


class WordEncoder:
    """The ids of whole texts, by encoding each distinct piece once.

    For tokenizers that drop white space and split letters, digits and punctuation (``by_words``), a text's ids are those
    of its pieces one after another: pieces end at white space and, in plain Latin text, also where punctuation follows a
    letter or digit. Texts that hold an added token's string are encoded whole. Words of plain Latin letters go straight to
    the tokenizer's model: its normalizer only lower-cases them and its pre-tokenizer keeps them whole.
    """

    def __init__(self, path: str, end_id: int, by_words: bool = True, most: int = 1_200_000) -> None:
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {"": b""}  # a piece's ids as little-endian unsigned 32-bit numbers
        self.tokenizer, self.end, self.by_words, self.most = Tokenizer.from_file(path), struct.pack("<I", end_id), by_words, most
        config = json.loads(self.tokenizer.to_str())
        self.added = [x["content"].encode().lower() for x in config["added_tokens"]]
        kinds = lambda part, many: [x["type"] for x in (config[part] or {}).get(many, [])]
        self.plain = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        self.model = self.tokenizer.model

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [self._packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes | None:
        """The ids of a word of plain Latin letters."""
        if not self.plain or not word.isalpha() or not (word.isascii() or not _OTHER.search(word)):
            return None
        letters = word if word.isascii() else word.lower().encode().decode("latin-1").translate(_BYTE_LETTERS)
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _learn(self, pieces: list[str]) -> None:
        rest = []
        for piece in pieces:
            word = piece.rstrip(_MARKS)  # letters and punctuation are never in one token
            ids, marks = self.known.get(word) or self._word(word), self.known.get(piece[len(word) :])
            if not self.plain or ids is None or marks is None or not word.isalpha():
                rest.append(piece)
            else:
                self.known[piece] = ids + marks
        self.known.update(zip(rest, self._batch(rest), strict=True))

    def _by_pieces(self, texts: list[bytes]) -> list[bytes]:
        """The ids of texts cut at white space: distinct pieces are looked up, all others are gathered by number."""
        if not texts:
            return []
        pieces = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        distinct = pieces.values.dictionary_encode()
        words, of = distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices.to_numpy()
        if len(self.known) > self.most:
            self.known = {"": b""}
        ids = list(map(self.known.get, words))
        if None in ids:
            self._learn([w for w, x in zip(words, ids, strict=True) if x is None])
            ids = list(map(self.known.__getitem__, words))
        flat, sizes = np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        n = sizes[of]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[of] - (ends - n), n)
        at += np.arange(len(at))
        out = flat[at]
        cuts = np.concatenate([[0], ends])[pieces.offsets.to_numpy()].tolist()
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last."""
        cut: list[bytes | None] = []
        for t in texts:
            low = t.encode("utf-8", "replace").lower()
            cut.append(None if not self.by_words or any(x in low for x in self.added) else _spaced(low))
        whole = iter(self._batch([t for t, c in zip(texts, cut, strict=True) if c is None]))
        parts = iter(self._by_pieces([c for c in cut if c is not None]))
        return [next(whole if c is None else parts) + self.end for c in cut]


_ENCODERS: dict[tuple, WordEncoder] = {}


def part_of(order: int | None, crc: int, bounds: np.ndarray, nulls: int) -> int:
    """The range of a row: null orders in the first ``nulls`` ranges, others by sorted bounds; rows that equal several bounds are dealt over their ranges by crc."""
    if order is None:
        return crc * nulls >> 32
    low, high = np.searchsorted(bounds, order, side="left"), np.searchsorted(bounds, order, side="right")
    return nulls + int(low) + (crc * int(high - low + 1) >> 32)


def _tokenise(path: str, end_id: int, by_words: bool, bounds: list[int], nulls: int):
    def run(batches):
        key = (path, end_id, by_words)
        if key not in _ENCODERS:  # a worker's tasks share it
            _ENCODERS[key] = WordEncoder(*key)
        encoder, edges = _ENCODERS[key], np.array(bounds, dtype=np.int64)
        for batch in batches:
            orders, docs, texts = batch.column(0).to_pylist(), batch.column(1), [t or "" for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) < TOGETHER):
                    size += len(texts[end])
                    end += 1
                ids = encoder.encode(texts[at:end])
                crc = [zlib.crc32(x) for x in ids]
                part = [part_of(o, c, edges, nulls) for o, c in zip(orders[at:end], crc, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(orders[at:end], pa.int64()), docs.slice(at, end - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array([_packed(x) for x in ids], pa.binary())],
                    names=["part", "place", "doc_id", "n_tokens", "crc", "ids"],
                )
                at = end

    return run


def _packed(ids: bytes) -> bytes:
    """Ids below 65,536 as 16 bits behind a 0 byte, others as 32 bits behind a 1 byte."""
    x = np.frombuffer(ids, dtype="<u4")
    return b"\0" + x.astype("<u2").tobytes() if x.max() < 1 << 16 else b"\1" + ids


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if raw[0] else "<u2", offset=1).astype(np.int64)


def _starts(batches):
    """Adds, to sorted rows of one range, the ids of the rows before."""
    before = 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        start = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(start, pa.int64()), batch.column(4)], names=["part", "doc_id", "n_tokens", "start", "ids"])


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 1, by_words: bool = True, order: Column | None = None) -> DataFrame:
    """part, doc_id, n_tokens, start (within the part), ids; written once, each part in ascending order (doc_id where none is given)."""
    doc_id = docs["doc_id"].cast("long")
    plain = docs.select((doc_id if order is None else order.cast("long")).alias("place"), doc_id.alias("doc_id"), docs["text"])
    n = partitions(docs)
    # as many numbers as there are partitions; they only balance the ranges
    seen = plain.agg(F.count("*").alias("rows"), F.count_if(F.col("place").isNull()).alias("nulls"), F.percentile_approx("place", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("bounds")).first()
    bounds = seen["bounds"] if n > 1 and seen["bounds"] else []
    nulls = -(-n * seen["nulls"] // seen["rows"]) if seen["nulls"] else 0
    rows = plain.mapInArrow(_tokenise(tokenizer, end_id, by_words, sorted(bounds), nulls), "part int, place long, doc_id long, n_tokens long, crc long, ids binary")
    rows = rows.repartitionById(n + nulls, F.col("part")).sortWithinPartitions("part", "place", "crc", "n_tokens").select("part", "doc_id", "n_tokens", "crc", "ids")
    return written(rows.mapInArrow(_starts, "part int, doc_id long, n_tokens long, start long, ids binary"), "token-ids")


def _count(batches):
    total = np.zeros(0, dtype=np.int64)
    for batch in batches:
        rows = [_unpacked(raw) for raw in batch.column(0).to_pylist()]
        if rows:
            n = np.bincount(np.concatenate(rows), minlength=len(total))
            n[: len(total)] += total
            total = n
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    items, levels = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        items = both[order]
        levels.append(order < len(leaves))
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    code, size = 0, 0
    for i, n in zip(used.tolist(), lengths[used].tolist(), strict=True):
        code <<= n - size
        codes[i], size = code, n
        code += 1
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[bytes, np.ndarray]:
    """The codes one after another, most significant bit first, and the bit offset of each block."""
    sizes = lengths[ids].astype(np.int64)
    offset = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    word, shift = offset >> 5, (64 - (offset & 31) - sizes).astype(np.uint64)
    bits = codes[ids] << shift
    out = np.zeros((total + 31) // 32 + 2, dtype=np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        at = word[first]  # no two codes share a bit, so sums are unions
        out[at] += np.add.reduceat(bits >> np.uint64(32), first)
        out[at + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], offset[::block].astype("<u8")


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next ``limit`` bits: the id and its length."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    spans = 1 << (limit - lengths[used].astype(np.int64))
    symbol, size = np.zeros(1 << limit, dtype=np.int64), np.ones(1 << limit, dtype=np.int64)
    n = int(spans.sum())
    symbol[:n], size[:n] = np.repeat(used, spans), np.repeat(lengths[used].astype(np.int64), spans)
    return symbol, size


def unpack_bits(data: bytes, offsets: np.ndarray, block: int, table: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """The ids of the blocks that begin at these bits of data; the last may run over its end."""
    symbol, size = table
    raw = np.frombuffer(data + bytes(block * limit // 8 + 8), dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, out = offsets.astype(np.int64), np.empty((block, len(offsets)), dtype=np.int64)
    for step in range(block):
        code = (words[at >> 3] >> (32 - limit - (at & 7)).astype(np.uint32)) & np.uint32((1 << limit) - 1)
        out[step] = symbol[code]
        at += size[code]
    return out.T.reshape(-1)


def shard_bytes(doc_ids: list, n_tokens: np.ndarray, ids: np.ndarray, start: int, lengths: np.ndarray, codes: np.ndarray, block: int, limit: int) -> bytes:
    bits, offsets = pack_bits(ids, lengths, codes, block)
    sections = [zlib.compress(lengths.tobytes()), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), bytes(d is None for d in doc_ids), n_tokens.astype("<i8").tobytes(), offsets.tobytes(), bits]
    head = json.dumps({"sections": [len(s) for s in sections], "docs": len(doc_ids), "ids": len(ids), "start": start, "block": block, "limit": limit}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *sections])


class Shard:
    """An open file: its documents, and any range of its ids by reading only the blocks that hold them."""

    def __init__(self, url: str) -> None:
        fs, path = filesystem(url)
        self.file = fs.open_input_file(path)
        magic, n = struct.unpack("<8sI", self._read(0, 12))
        if magic != MAGIC:
            raise ValueError(f"{url} is not a file of token ids")
        self.head = json.loads(self._read(12, n))
        ends = (12 + n + np.cumsum([0, *self.head["sections"]])).tolist()
        part = lambda i: self._read(ends[i], ends[i + 1] - ends[i])
        self.limit, self.block, self.bits_at, self.end = self.head["limit"], self.head["block"], ends[5], ends[6]
        self.table = decode_table(np.frombuffer(zlib.decompress(part(0)), dtype=np.uint8), self.limit)
        self.doc_ids = [None if null else int(d) for d, null in zip(np.frombuffer(part(1), dtype="<i8"), part(2), strict=True)]
        self.n_tokens, self.offsets = np.frombuffer(part(3), dtype="<i8").astype(np.int64), np.frombuffer(part(4), dtype="<u8").astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (exclusive) of the file."""
        if b <= a:
            return np.zeros(0, dtype=np.int64)
        first, last = a // self.block, (b - 1) // self.block
        low = int(self.offsets[first]) >> 3
        high = (int(self.offsets[last + 1]) + 7) >> 3 if last + 1 < len(self.offsets) else self.end - self.bits_at
        data = self._read(self.bits_at + low, high - low)
        return unpack_bits(data, self.offsets[first : last + 1] - 8 * low, self.block, self.table, self.limit)[a - first * self.block : b - first * self.block]


def _writer(folder: str, bases: dict[int, int], lengths: np.ndarray, block: int, limit: int, shard_ids: int):
    codes = canonical_codes(lengths)

    def run(batches):
        attempt, made, rows = TaskContext.get().taskAttemptId(), [], []
        size, following = 0, None

        def flush():
            nonlocal rows, size
            if rows:
                part, start = rows[0][0], bases[rows[0][0]] + rows[0][3]
                ids = np.concatenate([_unpacked(r[4]) for r in rows])
                # an attempt has files of its own; the returned rows name those of the attempt that counts
                name = f"{folder}/{start:015d}-{part:06d}-{attempt}.ids"
                write_file(name, shard_bytes([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), ids, start, lengths, codes, block, limit))
                made.append((name, start, len(rows), len(ids)))
            rows, size = [], 0

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_ids or following != (row[0], row[3]):
                    flush()
                rows.append(row)
                size += row[2]
                following = (row[0], row[3] + row[2])
        flush()
        cols = list(zip(*made, strict=True)) if made else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["file", "start", "n_docs", "n_ids"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, by_words: bool = True, block: int = 512, limit: int = 16, shard_ids: int = 1 << 20, order: Column | None = None) -> DataFrame:
    """file, start, n_docs, n_ids of each file written; file names ascend with the order, which is doc_id where none is given."""
    rows = tokenised(docs, tokenizer, end_id, by_words, order)
    counts = rows.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # at most one row per id of the vocabulary
    totals = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    totals[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    bases, at = {}, 0
    for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row per partition
        bases[r["part"]], at = at, at + r["n"]
    return written(rows.mapInArrow(_writer(folder, bases, code_lengths(totals, limit), block, limit, shard_ids), "file string, start long, n_docs long, n_ids long"), "token-files")


def _read_documents(batches):
    for batch in batches:
        for name in batch.column(0).to_pylist():
            shard = Shard(name)
            ends = np.cumsum(shard.n_tokens)
            ids = shard.ids(0, shard.head["ids"]).astype("<u4")
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - shard.n_tokens).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.head["start"] + ends - shard.n_tokens, pa.int64()), pa.array(shard.n_tokens, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    n = max(1, min(files.count(), 8 * partitions(files)))
    return files.select("file").repartition(n).mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, order: Column | None = None) -> DataFrame:
    """Documents written to token files, in the order given or by doc_id, and read back."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_token_files(write_token_files(docs, work_dir(docs.sparkSession, "ids"), tokenizer, end_id, order=order))


def op3_huffman_ids(spark, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
