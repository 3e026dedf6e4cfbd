"""Token counts kept as delta-maintained rollups.

A ledger lives in a folder. Every batch brings signed changes: inserts (+1
document, +n tokens), deletes (-1, -n) and revised counts (0, new - old). The
batch is summed by source, language and tokenizer version into a folder of its
own name. The commit is a small marker file under the batch's id, made to appear
whole by one step that fails if it is there already; so of writers that bring
the same batch at the same time one commits and the others are told that they
did not, and a repeated delivery or a retried job changes nothing. Totals are
the sum over committed batches, and additive: any order of batches gives the
same. ``compact`` folds batches into a snapshot that names them.

Versions are names of tokenizers; ``token_counts`` counts with a public one.

Defined cases: null source, language or version are groups of their own; null
counts are 0; an empty batch commits and changes nothing; groups whose
documents and tokens come to 0 leave the totals; a repeated row counts each
time; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tokenizer_path
from .sstable import encoder_for

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def inserts(rows: DataFrame) -> DataFrame:
    """(source, lang, version, n) -> changes."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("n", F.lit(0)).cast("long").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return inserts(rows).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """(source, lang, version, old, n) -> changes."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("docs"), (F.coalesce("n", F.lit(0)) - F.coalesce("old", F.lit(0))).cast("long").alias("tokens"))


class Ledger:
    """Folders ``data`` (summed batches), ``batches`` (a marker for each committed batch, holding its data folder's name) and ``snapshots`` (markers of folded batches)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _markers(self, kind: str) -> dict[str, str]:
        """Marker names of a kind and what they hold."""
        top = self._path(kind)
        if not self._fs.exists(top):
            return {}
        if not any(not s.getPath().getName().startswith("pending-") for s in self._fs.listStatus(top)):
            return {}
        held = self.spark.read.format("binaryFile").option("pathGlobFilter", "[!p.]*").load(f"{self.folder}/{kind}")
        return {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]).decode() for r in held.select("path", "content").collect()}

    def _publish(self, kind: str, name: str, content: str) -> bool:
        """Make a marker appear with its content, by one step that fails if it is there: a link where files are local (or mounted), else a rename, which never replaces a file on a distributed file system."""
        self._fs.mkdirs(self._path(kind))
        temp, final = self._path(f"{kind}/pending-{uuid.uuid4().hex}"), self._path(f"{kind}/{name}")
        out = self._fs.create(temp, False)
        out.write(bytearray(content.encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, temp)]
                jvm.java.nio.file.Files.createLink(*local)
                return True
            return bool(self._fs.rename(temp, final))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self._fs.delete(temp, False)

    def _snapshot(self) -> tuple[int, str | None]:
        done = self._markers("snapshots")
        last = max(done, default=None)
        return (int(last[1:]), done[last]) if last else (0, None)

    def _folded(self, snap: str | None) -> set[str]:
        return {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/data/{snap}/members").collect()} if snap else set()

    def batches(self) -> list[str]:
        """Ids of committed batches."""
        return sorted(n[1:] for n in self._markers("batches"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes under the id; False if it was committed before, by whomever."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id must be letters, digits, '_', '.' or '-', got {batch!r}")
        if batch in self.batches():
            return False
        name = f"batch-{uuid.uuid4().hex}"
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.parquet(f"{self.folder}/data/{name}")
        if self._publish("batches", f"b{batch}", name):
            return True
        self._fs.delete(self._path(f"data/{name}"), True)
        return False

    def _sum(self, snap: str | None, folders: list[str]) -> DataFrame:
        parts = [f"{self.folder}/data/{snap}/totals"] * bool(snap) + [f"{self.folder}/data/{f}" for f in folders]
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of all committed batches."""
        _, snap = self._snapshot()
        folded = self._folded(snap)
        return self._sum(snap, [f for n, f in sorted(self._markers("batches").items()) if n[1:] not in folded])

    def compact(self) -> bool:
        """Fold all committed batches into a new snapshot, then drop the data folded by the snapshot before; False if another writer was first. Markers stay, so that a folded batch is known for ever."""
        number, snap = self._snapshot()
        folded, committed = self._folded(snap), self._markers("batches")
        fresh = {n[1:]: f for n, f in committed.items() if n[1:] not in folded}
        name = f"snapshot-{uuid.uuid4().hex}"
        self._sum(snap, sorted(fresh.values())).write.parquet(f"{self.folder}/data/{name}/totals")
        members = sorted(folded | set(fresh))
        self.spark.createDataFrame([(m,) for m in members], "batch string").coalesce(1).write.parquet(f"{self.folder}/data/{name}/members")
        if not self._publish("snapshots", f"s{number + 1:08d}", name):
            self._fs.delete(self._path(f"data/{name}"), True)
            return False
        # what this snapshot replaces stays until the next one, for readers that still look at it
        older = [f for n, f in self._markers("snapshots").items() if int(n[1:]) < number]
        for f in [*(f for n, f in committed.items() if n[1:] in folded), *older]:
            self._fs.delete(self._path(f"data/{f}"), True)
        return True


def token_counts(rows: DataFrame, *, text: str = "text", tokenizer: str | None = None, slice_rows: int = 1_000) -> DataFrame:
    """``rows`` with a column ``n``: token ids of each whole text under a public tokenizer; 0 for null and empty texts."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    at = rows.columns.index(text)
    schema = T.StructType([f for f in rows.schema.fields if f.name != text] + [T.StructField("n", T.LongType())])

    def run(batches):
        encoder = encoder_for(path, 4)
        for b in batches:
            for lo in range(0, b.num_rows, slice_rows):
                part = b.slice(lo, slice_rows)
                n = [len(x) // 4 for x in encoder.encode(part.column(at))]
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(part.columns) if i != at] + [pa.array(n, pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
