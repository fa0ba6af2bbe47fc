"""Token-id shards as sorted string tables: documents keyed by id, in files that allow binary search.

A file holds one contiguous range of keys:

    block*  index  bloom  footer

and every section ends in the byte 0x0A, so that Spark's own text writer, with
its commit protocol and on any file system, writes the files: a table is one row,
and every row gets a file of its own, of ``SHARD_BYTES`` whatever the size of the
corpus and the number of tasks.  All numbers are little-endian.

  block   entries in key order: varint shared, varint rest, rest of the key,
          varint number of ids, ids of 2 or 4 bytes; `shared` counts the bytes
          that the key has in common with the one before it in the block
  index   per block: u64 offset, u64 length, u64 ids before it in the file, u32 entries, u16 key length, first key
  bloom   u8 hashes per key, then the bits
  footer  FOOTER: magic, version, id width, counts, places of index and bloom

A key is the id as 8 big-endian bytes with the sign bit flipped, so that byte
order is number order; a null id is the empty key and comes first.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.common import materialize, slices


MAGIC, VERSION = b"LSSTABLE", 1
FOOTER = struct.Struct("<8sHHQQQQQQ")  # magic, version, width, documents, ids, index offset and length, bloom offset and length
ENTRY = struct.Struct("<QQQIH")
BLOCK_BYTES = 64 * 1024
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Bytes of a file, and of input (as stored) for each task up to MOST_TASKS of them; beyond it tasks write more files.
SHARD_BYTES, MOST_TASKS = 8 * 2**20, 100_000
#: Files up to which their first numbers (some 24 bytes each) are broadcast; beyond it they are joined.
BROADCAST_ROWS = 1_000_000
#: Words whose ids a worker remembers; a full cache is emptied.
CACHE = 1_000_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - 2**63


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


class WordEncoder:
    """Whole texts by the tokenizers library, which sees each distinct word once.

    The pattern that splits texts drops white space and joins nothing across it,
    so words that ASCII white space parts are encoded apart with the same ids.
    It lowers letters and parts them from marks: texts are lowered in ASCII (unless
    they may hold special tokens, which know case) and a run of ``MARKS`` between
    such a letter and white space is a word of its own.  New words of letters alone
    go to the library as one text: each is one part there, whose last piece has the
    word-end suffix.
    """

    MARKS = re.compile(rb"[.,;:!?|*$%&#](?<=[a-z].)[.,;:!?|*$%&#]*(?=[ \t\n\v\f\r]|\Z)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.wide = max(vocabulary.values()) >= 2**16
        self.dtype = "<u4" if self.wide else "<u2"
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for piece, i in vocabulary.items():
            self.last[i] = piece.endswith("</w>")
        self.words: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False), strict=True):
            self.words[w] = np.array(e.ids, self.dtype).tobytes()

    def _together(self, words: list[bytes]) -> None:
        ids = np.array(self.tokenizer.encode_batch([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.dtype)
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(words):  # a letter that lower-cases to several characters, say
            return self._one_by_one(words)
        data, width = ids.tobytes(), ids.itemsize
        self.words.update(zip(words, [data[a * width : b * width] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _learn(self, fresh: list[bytes]) -> None:
        letters, others = [], []
        for w in fresh:
            (letters if w.decode().isalpha() else others).append(w)
        for i in range(0, len(letters), 2000):
            self._together(letters[i : i + 2000])
        if others:
            self._one_by_one(others)

    def _split(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode()
        return (raw if b"<|" in raw else self.MARKS.sub(rb" \g<0>", raw.lower())).split()

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end = np.array([end_id], self.dtype).tobytes()
        if len(self.words) > CACHE:
            self.words.clear()
        split = [self._split(t) for t in texts]
        known = [list(map(self.words.get, words)) for words in split]
        missing = [None in ids for ids in known]
        if any(missing):
            self._learn(list({w for words, ids, m in zip(split, known, missing, strict=True) if m for w, i in zip(words, ids, strict=True) if i is None}))
            look = self.words.__getitem__
            known = [map(look, words) if m else ids for words, ids, m in zip(split, known, missing, strict=True)]
        return [b"".join(ids) + end for ids in known]


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class TableWriter:
    """Turns entries in key order into the sections of one file; only the open block, keys' hashes and the index are kept."""

    def __init__(self, width: int):
        self.width = width
        self.block, self.last, self.entries, self.first = bytearray(), b"", 0, b""
        self.offset = self.docs = self.ids = self.ids_before = 0
        self.index, self.hashes = bytearray(), []

    def add(self, key: bytes, value: bytes) -> bytes | None:
        """Add an entry; a full block comes back."""
        n = len(value) // self.width
        if not self.entries:
            self.first, self.last, self.ids_before = key, b"", self.ids
        shared = 0
        for a, b in zip(key, self.last):
            if a != b:
                break
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + key[shared:] + varint(n) + value
        self.last = key
        self.entries += 1
        self.docs += 1
        self.ids += n
        self.hashes.append(xxhash.xxh64_intdigest(key))
        return self.flush() if len(self.block) >= BLOCK_BYTES else None

    def flush(self) -> bytes:
        section = bytes(self.block) + b"\n"
        self.index += ENTRY.pack(self.offset, len(self.block), self.ids_before, self.entries, len(self.first)) + self.first
        self.offset += len(section)
        self.block, self.entries = bytearray(), 0
        return section

    def finish(self) -> Iterator[bytes]:
        if self.entries:
            yield self.flush()
        index_at, index = self.offset, bytes(self.index)
        yield index + b"\n"
        n_bits = max(64, BLOOM_BITS_PER_KEY * self.docs)
        bits = np.zeros(-(-n_bits // 8) * 8, "u1")
        h = np.array(self.hashes, "u8")
        for i in range(BLOOM_HASHES):
            bits[((h & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (h >> np.uint64(32))) % np.uint64(bits.size)] = 1
        bloom_at, bloom = index_at + len(index) + 1, bytes([BLOOM_HASHES]) + np.packbits(bits).tobytes()
        yield bloom + b"\n"
        yield FOOTER.pack(MAGIC, VERSION, self.width, self.docs, self.ids, index_at, len(index), bloom_at, len(bloom)) + b"\n"


class TableReader:
    """Reads one file: by key through Bloom filter and binary search, or all entries in order."""

    def __init__(self, data: bytes):
        self.data = memoryview(data).cast("B")  # Arrow buffers count as signed bytes
        magic, version, self.width, self.docs, self.ids, index_at, index_size, bloom_at, bloom_size = FOOTER.unpack(self.data[-FOOTER.size - 1 : -1])
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token table")
        self.blocks, self.firsts, at = [], [], index_at
        while at < index_at + index_size:
            *block, size = ENTRY.unpack(self.data[at : at + ENTRY.size])
            at += ENTRY.size
            self.blocks.append(block)
            self.firsts.append(bytes(self.data[at : at + size]))
            at += size
        self.bloom = self.data[bloom_at : bloom_at + bloom_size]

    def may_hold(self, key: bytes) -> bool:
        h, size = xxhash.xxh64_intdigest(key), (len(self.bloom) - 1) * 8
        places = (((h & 0xFFFFFFFF) + i * (h >> 32)) % size for i in range(self.bloom[0]))
        return all(self.bloom[1 + p // 8] >> (7 - p % 8) & 1 for p in places)

    def entries(self, block: int) -> Iterator[tuple[bytes, int, memoryview]]:
        """Key, ids before the entry in the file, and its ids as bytes."""
        at, size, before, count = self.blocks[block]
        key, kind = b"", self.width
        for _ in range(count):
            shared, at = read_varint(self.data, at)
            rest, at = read_varint(self.data, at)
            key = key[:shared] + bytes(self.data[at : at + rest])
            n, at = read_varint(self.data, at + rest)
            yield key, before, self.data[at : at + n * kind]
            at += n * kind
            before += n

    def __iter__(self) -> Iterator[tuple[bytes, int, memoryview]]:
        for block in range(len(self.blocks)):
            yield from self.entries(block)

    def get(self, doc_id: int | None) -> list[list[int]]:
        """The id lists kept under a document id: none, one, or several where ids repeat."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        block = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while block < len(self.blocks) and self.firsts[block] <= key:
            found += [np.frombuffer(v, f"<u{self.width}").tolist() for k, _, v in self.entries(block) if k == key]
            block += 1
        return found


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the files to ``path``, which any Spark file system may hold.

    Null texts are empty and have the end id alone.  Rows go by id, then by a
    hash of the text; repeated ids keep all their entries, and a run of one id is
    dealt over as many files as it fills.  An empty table writes no documents.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    files = max(1, -(-int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SHARD_BYTES))
    order = ["id", "h", "row"]
    keyed = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(min(files, MOST_TASKS), *order).sortWithinPartitions(*order).select("id", "text")

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        width = 4 if enc.wide else 2

        def table_of(out: TableWriter, sections: list[bytes]) -> pa.RecordBatch:
            whole = b"".join([*sections, *out.finish()])
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1]], pa.binary())], names=["table"])

        out, sections, made = TableWriter(width), [], 0
        for part in parts:
            for some in slices(part, 2 * 2**20):
                for i, v in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist(), end_id), strict=True):
                    section = out.add(key_of(i), v)
                    if section is not None:
                        sections.append(section)
                    if out.offset >= SHARD_BYTES:
                        yield table_of(out, sections)
                        out, sections, made = TableWriter(width), [], made + 1
        if out.docs or not made:
            yield table_of(out, sections)

    ranged.mapInArrow(build, "table binary").select(F.col("table").cast("string").alias("value")).write.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """task, number, content of the files: which task wrote it, and its place among that task's."""
    name = F.element_at(F.split("path", "/"), -1)
    place = [F.regexp_extract(name, pattern, 1).cast("int").alias(n) for n, pattern in (("task", r"^part-(\d+)-"), ("number", r"-c(\d+)\."))]
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(*place, "content")


def read(spark: SparkSession, path: str, make: Callable[[np.ndarray], object], kind: str, name: str) -> DataFrame:
    """doc_id, start, n_tokens and ``name``, which ``make`` computes from each document's ids as 32-bit numbers.

    ``start`` counts the ids of all documents before it, over all files: each
    file is read once, and the numbers of ids in the files before, of the same
    task and of the tasks before (MOST_TASKS rows), give its first number.
    """

    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for task, number, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                data = data.as_buffer()
                if not data.size:
                    continue
                table = TableReader(data)
                for block in range(len(table.blocks)):
                    found = [(id_of(k), before, np.frombuffer(v, f"<u{table.width}").astype("<u4")) for k, before, v in table.entries(block)]
                    ids, before, values = zip(*found, strict=True)
                    columns = [pa.array([task] * len(ids), pa.int32()), pa.array([number] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(before, pa.int64()), pa.array([len(v) for v in values], pa.int64()), pa.array([make(v) for v in values])]
                    yield pa.RecordBatch.from_arrays(columns, names=["task", "number", "doc_id", "at", "n_tokens", name])

    rows = _files(spark, path).mapInArrow(entries, f"task int, number int, doc_id long, at long, n_tokens long, {name} {kind}")
    rows = materialize(rows, "token-rows")
    counts = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("ids"))
    tasks = counts.groupBy("task").agg(F.sum("ids").alias("ids"))
    of_task = tasks.select("task", (F.sum("ids").over(Window.orderBy("task")) - F.col("ids")).alias("of_task"))
    in_task = F.sum("ids").over(Window.partitionBy("task").orderBy("number")) - F.col("ids")
    bases = materialize(counts.withColumn("in_task", in_task).join(F.broadcast(of_task), "task").select("task", "number", (F.col("in_task") + F.col("of_task")).alias("base")), "token-bases")
    held = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    return rows.join(held, ["task", "number"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", name)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())
