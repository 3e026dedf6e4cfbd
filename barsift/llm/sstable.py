"""Token-id output as sorted-string-table shards.

Texts are encoded with a public byte-level tokenizer and an end id. Documents
are dealt to shards by ranges of their id and written in ascending order, one
file a shard:

    blocks   entries (shared key bytes, other key bytes, value bytes as varints,
             key rest, value), keys prefix-compressed against the previous entry
             of the block, closed by the block's CRC32
    index    for each block: first key, offset, length
    bloom    bits of the shard's keys, HASHES probes each
    footer   offsets of index and bloom, counts, id width, magic

Keys are ids as 8 big-endian bytes with the sign bit flipped, so byte order is
number order. Values are token ids, little-endian, 2 bytes where the vocabulary
allows and 4 otherwise. ``Reader`` looks keys up by Bloom filter, binary search
of the sparse index, and a scan of one block; repeated keys are adjacent.

The ranges come from Spark's range partitioning; the number of shards follows
from the bytes and rows of the table, without a cap, and a shard's sparse index,
Bloom filter and keys are what its writer holds in memory. Each attempt of a task
writes a file of its own name; the manifest names those of the attempts that
counted, and other files are deleted. All files go to the shared folder, and
each shard is read back by a task of its own.

Defined cases: null texts are empty and yield the end id alone; rows without an
id are left out; repeated ids keep all their rows, in order of their token
bytes; an empty table makes no files; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, kept, shared_path, tokenizer_path

MAGIC = b"BSSSTBL1"
FOOTER = struct.Struct("<QQQQQQB7x8s")
BLOCK_BYTES = 64 * 1024
BITS_A_KEY, HASHES = 10, 7
CACHE_UNITS = 700_000
# white space of the tokenizer's pattern; a word never starts inside a run of it
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
ODD_BLANKS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] | [\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|^ | $"
# a letter or digit and what is neither, nor white space, always part there
TAIL = re.compile(f"([^.,;:!?]*[^\\W_])([.,;:!?]+)")


class Encoder:
    """Ids of whole texts. The tokenizer splits a text wherever white space follows something else, so the stretches between such places are encoded once each; the first CACHE_UNITS of them are remembered.

    Where blanks stand alone between words, Arrow does the rest: it splits the
    texts, numbers the distinct words, and strings their ids together. Other
    texts are cut by pattern.
    """

    def __init__(self, path: str, width: int):
        # one thread: the executor's cores are already taken by its tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if width == 2 else "I"
        # by what stands before the unit: nothing, or the blank that parts it from the word before
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        odd = pc.match_substring_regex(texts, ODD_BLANKS)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out: list = [b""] * len(texts)
        for i, x in zip(np.flatnonzero(~odd), self.encode_plain(texts.filter(pa.array(~odd))), strict=True):
            out[i] = x
        for i in np.flatnonzero(odd):
            out[i] = self.encode_odd(texts[i].as_py())
        return out

    def encode_odd(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(self.look_up(UNIT.findall(text), ""))

    def encode_plain(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        split = pc.split_pattern(texts, " ")
        begin = split.offsets.to_numpy().astype(np.int64)
        begin, words = begin - begin[0], split.flatten()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        kinds = coded.dictionary.to_pylist()
        # a text's first word has no blank before it
        first = words.take(pa.array(begin[:-1])).to_pylist()
        codes[begin[:-1]] = len(kinds) + np.arange(len(first))
        ids = pa.array(self.look_up(kinds, " ") + self.look_up(first, ""), pa.large_binary()).take(pa.array(codes))
        at = np.frombuffer(ids.buffers()[1], np.int64, len(codes) + 1, ids.offset * 8)[begin].tolist()
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def look_up(self, units: list[str], lead: str) -> list[bytes]:
        known = self.known[lead]
        got = list(map(known.get, units))
        fresh = [u for u, v in zip(units, got, strict=True) if v is None]
        if fresh:
            new = self.encode_units(set(fresh), lead)
            if len(known) < CACHE_UNITS:
                known.update(new)
            got = [new[u] if v is None else v for u, v in zip(units, got, strict=True)]
        return got

    def encode_units(self, units: set[str], lead: str) -> dict[str, bytes]:
        """Units not met before; a word and the punctuation after it apart, as other units share either."""
        ended = {u: m.groups() for u in units if (m := TAIL.fullmatch(u))}
        known, marks = self.known[lead], self.known[""]
        stems = {stem for stem, _ in ended.values() if stem not in units and stem not in known}
        tails = {tail for _, tail in ended.values() if tail not in marks}
        out: dict[str, bytes] = {}
        self.encode_whole([u for u in units if u not in ended] + list(stems), lead, out)
        self.encode_whole(list(tails), "", marks)
        for u, (stem, tail) in ended.items():
            out[u] = (out.get(stem) or known[stem]) + marks[tail]
        return out

    def encode_whole(self, units: list[str], lead: str, into: dict[str, bytes]) -> None:
        for lo in range(0, len(units), 20_000):
            part = units[lo : lo + 20_000]
            for u, e in zip(part, self.tokenizer.encode_batch_fast([lead + u for u in part], add_special_tokens=False), strict=True):
                into[u] = self.packed(e.ids)

    def packed(self, ids: list[int]) -> bytes:
        a = array(self.kind, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()


def encoder_for(path: str, width: int) -> Encoder:
    """The worker's encoder: what it remembers serves all its tasks."""
    return kept(("encoder", path, width), lambda: Encoder(path, width))


def key_bytes(i: int) -> bytes:
    return struct.pack(">Q", i + 2**63)


def key_of(b: bytes) -> int:
    return struct.unpack(">Q", b)[0] - 2**63


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys must come in ascending order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.count = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.open()

    def open(self):
        self.block, self.size, self.first, self.last = [], 0, None, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first = key
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.last = key
        self.keys.append(key)
        self.count += 1
        self.tokens += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self):
        if self.first is not None:
            data = b"".join(self.block)
            data += struct.pack("<I", zlib.crc32(data))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
        self.open()

    def close(self) -> None:
        self.flush()
        index = b"".join(varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, BITS_A_KEY * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[probes(k, bits)] = 1
        packed = np.packbits(bloom).tobytes()
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.count, self.tokens, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary stream."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell()
        at, size, bloom_at, self.bits, self.count, self.tokens, self.width, magic = FOOTER.unpack(self.piece(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw = self.piece(at, size)
        self.bloom = np.unpackbits(np.frombuffer(self.piece(bloom_at, (self.bits + 7) // 8), np.uint8))
        self.index, i = [], 0
        while i < size:
            n, i = read_varint(raw, i)
            self.index.append((raw[i : i + n], *struct.unpack_from("<QQ", raw, i + n)))
            i += n + 16

    def piece(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def block(self, i: int):
        """Entries of block i, as (key, value)."""
        _, at, size = self.index[i]
        data = self.piece(at, size)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {i} is damaged")
        key, p = b"", 0
        while p < size - 4:
            shared, p = read_varint(data, p)
            rest, p = read_varint(data, p)
            n, p = read_varint(data, p)
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, data[p : p + n]
            p += n

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def get(self, i: int) -> np.ndarray | None:
        """Token ids of document ``i`` (the first, if the id repeats), or None."""
        key = key_bytes(i)
        if not self.bloom[probes(key, self.bits)].all():
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:  # first block whose first key is >= key
            mid = (lo + hi) // 2
            if self.index[mid][0] < key:
                lo = mid + 1
            else:
                hi = mid
        for b in range(max(0, lo - 1), len(self.index)):
            if self.index[b][0] > key:
                return None
            for k, v in self.block(b):
                if k == key:
                    return self.ids(v)
                if k > key:
                    return None
        return None

    def __iter__(self):
        for b in range(len(self.index)):
            for k, v in self.block(b):
                yield key_of(k), self.ids(v)


def open_store(uri: str):
    """(file system, path) of a folder in any store that pyarrow knows; plain paths and file: are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(f"file://{uri}")


def _drop_strays(spark: SparkSession, manifest: DataFrame, folder: str) -> None:
    """Delete files of attempts that did not finish: those that the manifest does not name."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(top):
        there = [s.getPath().getName() for s in store.listStatus(top) if s.getPath().getName().endswith(".sst")]
        # from Arrow: a list would start Python workers of another kind, and their daemon stays
        listed = spark.createDataFrame(pa.table({"name": pa.array(there, pa.string())}))
        named = manifest.select(F.substring_index("path", "/", -1).alias("name"))
        for r in listed.join(named, "name", "left_anti").toLocalIterator():
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}"), False)


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end_id: int = 2, shard_bytes: int = 32_000_000, shard_rows: int = 200_000, slice_rows: int = 1_000) -> DataFrame:
    """Write the shards; returns one row a shard: shard, path, rows, tokens, first_key, last_key, start (ids in all shards before)."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    top = max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"]), end_id])
    width = 2 if top < 65_536 else 4
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    shards = max(1, -(-total // shard_rows), -(-size // shard_bytes))
    # ranges of ids from Spark's own sampling: equal ids are always in one
    dealt = rows.repartitionByRange(shards, "k").sortWithinPartitions("k")
    end = np.array([end_id], "<u2" if width == 2 else "<u4").tobytes()

    def run(batches):
        store, top = open_store(folder)
        store.create_dir(top, recursive=True)
        writer = out = None
        encoder = encoder_for(path, width)
        held: list[tuple[int, bytes]] = []
        ends = [None, None]

        def put(last: bool):
            """Entries of a repeated key wait for each other, to go out in order of their bytes."""
            nonlocal held
            n = len(held)
            if not last and n:
                while n and held[n - 1][0] == held[-1][0]:
                    n -= 1
            for k, v in sorted(held[:n]):
                writer.add(key_bytes(k), v)
            held = held[n:]

        number = TaskContext.get().partitionId()
        name = f"{number:07d}-{uuid.uuid4().hex}.sst"
        try:
            for b in batches:
                for lo in range(0, b.num_rows, slice_rows):
                    part = b.slice(lo, slice_rows)
                    keys = part.column(0).to_pylist()
                    if not keys:
                        continue
                    if writer is None:
                        out = store.open_output_stream(f"{top}/{name}")
                        writer = Writer(out, width)
                        ends[0] = keys[0]
                    ends[1] = keys[-1]
                    held += [(k, v + end) for k, v in zip(keys, encoder.encode(part.column(1)), strict=True)]
                    put(False)
                    give_back()
            if writer is not None:
                put(True)
                writer.close()
                out.close()
        except BaseException:
            if writer is not None:
                out.close()
                store.delete_file(f"{top}/{name}")
            raise
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"shard": number, "path": f"{folder}/{name}", "rows": writer.count, "tokens": writer.tokens, "first_key": ends[0], "last_key": ends[1]}])

    manifest = cut(spark, dealt.mapInArrow(run, "shard long, path string, rows long, tokens long, first_key long, last_key long"), "manifest")
    _drop_strays(spark, manifest, folder)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document in the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = open_store(path)
                with store.open_input_file(at) as f:
                    keys, starts, sizes, crcs = [], [], [], []
                    for k, ids in Reader(f):
                        keys.append(k)
                        starts.append(start)
                        sizes.append(len(ids))
                        crcs.append(zlib.crc32(ids.tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, starts, sizes, crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a window over the shards leaves them in one partition: one task each, by number, which the engine does not coalesce
    at = manifest.agg(F.max("shard")).first()[0]
    shards = manifest.repartitionById(1 + (at or 0), F.col("shard").cast("int")).select("path", "start")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as shards (to ``folder``, or a new one in the shared folder) and return what the files hold."""
    return read_shards(write_shards(spark, docs, folder or shared_path(spark, "sst"), **options))
