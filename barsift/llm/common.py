"""Shared plumbing: tables in the shared folder, word hashing, tokenizer files."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Spark deletes an execution's shuffle files when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barsift-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and the shuffles of the write are deleted with it."""
    path = shared_path(spark, stem)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._barsift_path = path
    return out


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables written by ``cut`` that nothing reads any more."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for df in frames:
        path = getattr(df, "_barsift_path", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: What this Python worker keeps from task to task; workers serve all operators of an application, so it is one thing at a time.
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]):
    """What ``make`` returns, kept by the worker until something else is asked for. (A function of the module, as the dictionary itself would travel as a copy.)"""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what an operator before has kept."""
    _kept.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library hold on to it, in every worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def crc_mod(col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``; null ids count as remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


class WordHash(dict):
    """64-bit hashes of byte words, kept up to ``most`` words and then forgotten."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain), on arrays of uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space bytes; bytes.lower and bytes.split do exactly that."""
    return text.lower().split() if text else []


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
