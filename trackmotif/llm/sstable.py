"""Token ids in sorted-string-table shards.

A shard holds documents by ascending identifier in compressed blocks whose keys drop the prefix shared with the key
before (each 16th is whole), then a sparse index with the first key of each block, a Bloom filter of all keys and a
footer. A lookup asks the filter, bisects the index, reads one block and scans it from the last whole key that is not
above the one sought.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmotif.llm import storage
from trackmotif.llm.bpe_lexicon import Vocabulary
from trackmotif.llm.memory import release, roomy
from trackmotif.llm.pieces import Coder, Pieces, chunks
from trackmotif.session import materialise, scratch_dir, ship_package

BLOCK_BYTES, WHOLE_EVERY, BLOOM_BITS, BLOOM_HASHES = 1 << 17, 16, 10, 7
MAGIC = b"TMSSTAB1"
_FOOTER = struct.Struct("<QQQQQQI8s")  # index at, size; filter at, size; entries; ids; bytes an id; magic


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifiers do; null is first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _bloom_bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [(a + i * b) % size for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must not descend, equal keys stay in the order given."""

    def __init__(self, out: BinaryIO, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.ids = self.entries = 0
        self.first = self.last = None
        self._new_block()

    def _new_block(self) -> None:
        self.body, self.size, self.whole, self.block_first, self.in_block, self.before = [], 0, [], None, 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must not descend")
        shared = 0
        if self.in_block % WHOLE_EVERY == 0:
            self.whole.append(self.size)
        else:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.body += [head, value]
        self.size += len(head) + len(value)
        self.block_first = key if self.block_first is None else self.block_first
        self.first = key if self.first is None else self.first
        self.in_block, self.before = self.in_block + 1, key
        if key != self.last:
            self.hashes.append(key)
        self.last = key
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        at, packed = self.at, zstandard.ZstdCompressor(level=1).compress(data)
        self.out.write(packed)
        self.at += len(packed)
        return at, len(packed)

    def _end_block(self) -> None:
        if self.in_block:
            tail = struct.pack(f"<{len(self.whole)}II", *self.whole, len(self.whole))
            at, size = self._put(b"".join([*self.body, tail]))
            self.index.append((self.block_first, at, size))
        self._new_block()

    def finish(self) -> None:
        self._end_block()
        index_at, index_size = self._put(b"".join(_varint(len(k)) + k + _varint(a) + _varint(n) for k, a, n in self.index))
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.hashes:
            for b in _bloom_bits(key, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom_at, bloom_size = self._put(struct.pack("<Q", bits) + bloom.tobytes())
        self.out.write(_FOOTER.pack(index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, self.id_bytes, MAGIC))


class Reader:
    """Reads one shard from a file that can seek."""

    def __init__(self, f: BinaryIO):
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - _FOOTER.size)
        ia, isz, ba, bsz, self.entries, self.ids, self.id_bytes, magic = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        data, at, self.index = self._get(ia, isz), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            self.index.append((key, offset, size))
        self.firsts = [k for k, _, _ in self.index]
        bloom = self._get(ba, bsz)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _get(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.f.read(size))

    def _entries(self, block: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(block, at)
            own, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + own]
            at += own
            yield key, block[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        """All entries in order, a block at a time."""
        for _, at, size in self.index:
            block = self._get(at, size)
            (n,) = struct.unpack_from("<I", block, len(block) - 4)
            yield from self._entries(block, 0, len(block) - 4 - 4 * n)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of that identifier."""
        key = key_of(doc_id)
        if any(not self.bloom[b >> 3] >> (b & 7) & 1 for b in _bloom_bits(key, self.bits)):
            return []
        out = []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.index)):
            first, at, size = self.index[k]
            if first > key:
                break
            block = self._get(at, size)
            (n,) = struct.unpack_from("<I", block, len(block) - 4)
            end = len(block) - 4 - 4 * n
            whole = struct.unpack_from(f"<{n}I", block, end)
            start = bisect.bisect_left([next(self._entries(block, w, end))[0] for w in whole], key) - 1
            for found, value in self._entries(block, whole[max(0, start)], end):
                if found == key:
                    out.append(np.frombuffer(value, f"<u{self.id_bytes}"))
                elif found > key:
                    break
        return out


#: Pieces whose ids a worker keeps, about 36 bytes each.
MEMO_PIECES = 2_000_000
_coders: dict[str, tuple] = {}


def coders_of(path: str) -> tuple[Coder | None, object, int]:
    """``library_coder`` of the last file, which a worker keeps between tasks: reading the file and the library's work on
    pieces met before cost more than all else. Its size is bounded by the file and ``MEMO_PIECES``."""
    if path not in _coders:
        _coders.clear()
        _coders[path] = library_coder(path)
    return _coders[path]


def library_coder(path: str) -> tuple[Coder | None, object, int]:
    """The tokenizers library's ids, by distinct pieces where the file's word pattern allows that (see pieces); the
    library's tokenizer; and how many bytes an id takes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    size = 1 + max([tokenizer.get_vocab_size() - 1, *special.values()])
    width = 2 if size <= 1 << 16 else 4
    state = json.loads(tokenizer.to_str())
    words = state["pre_tokenizer"] or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space") and not state["normalizer"]
    if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in state["added_tokens"]):
        return None, tokenizer, width
    vocab = Vocabulary.parse(path)

    def resolve(p: Pieces, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast([p.piece(k).decode() for k in at.tolist()], add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.array([i for ids in found for i in ids], f"<u{width}")

    return Coder(resolve, special, vocab.bytes_of, np.uint16 if width == 2 else np.int32, MEMO_PIECES), tokenizer, width


def encode(texts: Iterable[str], coders: tuple, end_id: int | None = 0) -> Iterator[bytes]:
    """Little-endian ids of each text as the tokenizers library gives them, with the end id."""
    coder, tokenizer, width = coders
    end = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()
    for part in chunks(t.encode() for t in texts):
        if coder is None:
            yield from (np.array(e.ids, f"<u{width}").tobytes() + end for e in tokenizer.encode_batch_fast([t.decode() for t in part], add_special_tokens=False))
        else:
            yield from (ids.astype(f"<u{width}").tobytes() + end for ids, _ in coder.encode(part))


MANIFEST = "shard int, path string, first_key binary, last_key binary, n_docs long, n_ids long"


def write_shards(df: DataFrame, tokenizer: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text", end_id: int | None = 0) -> DataFrame:
    """Write all documents to shards of ascending identifiers below ``folder`` (shared by all nodes); gives the manifest.

    Each attempt writes a file of its own, and the manifest names those of the attempts that succeeded: a lost executor
    leaves at most files that nothing names. Null text counts as empty; null identifiers come first; equal identifiers
    are ordered by text.
    """
    spark = df.sparkSession
    ship_package(spark)
    folder = folder or scratch_dir(spark, "sstable")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.sst"
        roomy()
        coders = coders_of(tokenizer)
        with storage.create(path) as out:
            for batch in batches:
                values = encode((t.as_py() or "" for t in batch.column(1)), coders, end_id)
                writer = writer or Writer(out, coders[2])
                for doc, value in zip(batch.column(0), values, strict=True):
                    writer.add(key_of(doc.as_py()), value)
            writer = writer or Writer(out, 4)
            writer.finish()
        release()
        if writer.entries:
            row = {"shard": [part], "path": [path], "first_key": [writer.first], "last_key": [writer.last], "n_docs": [writer.entries], "n_ids": [writer.ids]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, MANIFEST), "sstable-manifest")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_digests(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in all shards), n_tokens and crc32 of its ids.

    Only the manifest, a row for each shard, comes to the driver, to sum up where each shard starts.
    """
    spark = manifest.sparkSession
    ship_package(spark)
    shards, start, last = [], 0, b""
    for row in sorted(manifest.collect(), key=lambda r: (bytes(r.first_key), r.shard)):
        if bytes(row.first_key) < last:
            raise ValueError("shards overlap")
        shards.append((row.path, start))
        start, last = start + row.n_ids, bytes(row.last_key)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                with storage.open_file(path) as f:
                    reader = Reader(f)
                    for key, value in reader.scan():
                        n = len(value) // reader.id_bytes
                        wide = value if reader.id_bytes == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                        rows.append((id_of(key), at, n, zlib.crc32(wide)))
                        at += n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    files = spark.createDataFrame(shards, "path string, start long")
    return files.repartition(max(1, len(shards))).mapInArrow(read, DIGEST)
