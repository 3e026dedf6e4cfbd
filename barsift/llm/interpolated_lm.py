"""Language-model scores by deleted interpolation of n-gram estimates.

    P(w | u v) = l3 c(u v w) / c(u v) + l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1)

The weights l depend on the frequency bucket of the context: powers of two of
c(u v), or of c(v) where u v was never met. They are learnt by
expectation-maximisation on deleted counts: every training token is held out in
turn, so it is predicted from counts less one, (c(u v w) - 1) / (c(u v) - 1) and
so on, and its bucket is that of the counts less one. Each round passes over all
held-out tokens on the executors and brings home one row of sums a bucket. The
rounds begin at the weights that a bounded sample of tokens (``START_TOKENS``)
settles on, and end when one raises the likelihood by less than ``GAIN`` nats a token.

Counts never leave the executors and nothing that grows is broadcast.
Documents are dealt to parts by a hash of their id (texts compressed), of about
``PART_BYTES`` of text. Each part asks for the counts of its distinct words, pairs
and triples: 64-bit hashes, sorted, cut into ranges, one packed block for each range.
The tasks that own a range add up the parts' training counts and send each part its
totals in the order asked. A part then writes its documents' counts, token by token
(packed, a slice of documents a row); learning and scoring read those alone. What is
exchanged is one entry for each distinct n-gram of a part, so it grows with the
input, and a frequent word costs no more than a rare one.

Defined cases: null and empty texts have the end token alone; with no training
documents N = V = 0, nothing is known, and both scores take every token at
1 / (V + 1); rows without an id are left out; repeated rows count each time;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHash, cut, discard, mix64, words_of

END, START = U64(0x5EED0001), U64(0x5EED0002)
SIZES = 24  # buckets of a context's frequency
BUCKETS = 2 * SIZES  # of the last word alone, then of the last two
PART_BYTES = 16_000_000
LOW = 5  # bytes of a difference of hashes that stand as they are
START_TOKENS, GAIN, ROUNDS = 200_000, 1e-5, 30


#: For planes of small numbers, whose bytes are seldom equally frequent.
SQUEEZE = zstandard.ZstdCompressor(level=1)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences of 6 bytes (8 if one is wider) and counts of one byte, larger ones listed after.

    The lower 5 bytes of a hash's difference are as good as random and stand as they are. The upper ones are mostly
    small, as are the counts: these go by planes and compressed."""
    step = np.diff(keys, prepend=U64(0))
    first, step = step[:1], step[1:]
    width = 6 if not len(step) or int(step.max()) < 2**48 else 8
    raw = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    small = np.minimum(counts, 255).astype(np.uint8)
    large = counts[counts >= 255].astype("<u4")
    planes = SQUEEZE.compress(np.ascontiguousarray(raw[:, LOW:width].T).tobytes() + small.tobytes())
    head = np.array([len(keys), width, len(planes)], "<u4").tobytes() + first.astype("<u8").tobytes()
    return head + np.ascontiguousarray(raw[:, :LOW]).tobytes() + planes + large.tobytes()


def unpack_counts(raw: bytes, n: int, at: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u4", -1, at + n)
    return counts


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, size = np.frombuffer(raw, "<u4", 3).tolist()
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    step = np.zeros((n, 8), np.uint8)
    step[0] = np.frombuffer(raw, np.uint8, 8, 12)
    step[1:, :LOW] = np.frombuffer(raw, np.uint8, (n - 1) * LOW, 20).reshape(-1, LOW)
    at = 20 + (n - 1) * LOW
    planes = zstandard.ZstdDecompressor().decompress(raw[at : at + size])
    upper = (n - 1) * (width - LOW)
    step[1:, LOW:width] = np.frombuffer(planes, np.uint8, upper).reshape(width - LOW, -1).T
    return np.cumsum(step.view("<u8").ravel(), dtype=U64), unpack_counts(planes[upper:] + raw[at + size :], n, 0)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and each value's number among them in 32 bits."""
    keys, at = np.unique(x, return_inverse=True)
    return keys, at.astype(np.int32)


def ranges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the hash space begins among sorted keys; parts + 1 places."""
    edges = np.array([(i << 64) // parts for i in range(parts)], U64)
    return np.append(np.searchsorted(keys, edges), len(keys))


class Part:
    """The documents of a part as hashes of words, pairs and triples, and their distinct ones."""

    def __init__(self, docs: list[tuple[int, bool, bytes]], hashes: WordHash):
        inflate = zstandard.ZstdDecompressor()
        self.ids = np.array([d[0] for d in docs], np.int64)
        self.train = np.array([d[1] for d in docs], bool)
        tokens = []
        for d in docs:
            tokens.append(hashes.of(words_of(inflate.decompress(d[2]) if d[2] else b"")))
            tokens.append(np.array([END], U64))
        self.size = np.array([len(tokens[2 * i]) + 1 for i in range(len(docs))], np.int64)
        w = mix64(np.concatenate(tokens)) if tokens else np.zeros(0, U64)
        tokens.clear()
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.learnt = np.repeat(self.train, self.size)
        self.keys, self.at = [], []
        before = np.empty_like(w)
        for salt in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0):
            keys, at = numbered(w if not self.keys else gram)
            self.keys.append(keys)
            self.at.append(at)
            if salt:
                # what came before, hashed with the word: pairs, then triples
                last = w if len(self.keys) == 1 else gram
                before[1:] = last[:-1]
                before[self.begin] = mix64(np.array([START + U64(len(self.keys))], U64))[0]
                gram = mix64(before * U64(0x9E3779B97F4A7C15) + (w ^ U64(salt)))

    def requests(self, parts: int):
        """(range, a packed block of each order)."""
        out = []
        for keys, of in zip(self.keys, self.at, strict=True):
            counts = np.bincount(of[self.learnt], minlength=len(keys))
            cuts = ranges(keys, parts)
            out.append([pack(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        yield from enumerate(zip(*out, strict=True))

    def take(self, replies: list[tuple], parts: int) -> np.ndarray:
        """Counts of every token: (order, token) of the word, the pair and the triple that end there."""
        out = np.empty((len(self.keys), len(self.learnt)), np.int32)
        for order, (keys, at) in enumerate(zip(self.keys, self.at, strict=True)):
            cuts, counts = ranges(keys, parts), np.zeros(len(keys), np.int64)
            for r in replies:
                a, b = cuts[r[0]], cuts[r[0] + 1]
                counts[a:b] = unpack_counts(r[1 + order], b - a, 0)
            out[order] = np.minimum(counts, 2**31 - 1)[at]
        return out


def size_class(c: np.ndarray) -> np.ndarray:
    """0 for contexts never met, then by powers of two."""
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, SIZES - 1), 0)


def estimates(counts: np.ndarray, begin: np.ndarray, documents: int, total: int, vocabulary: int, held_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, token x 4 estimates: triple, pair, word, uniform) from counts by order; less one where the token itself is held out."""
    less = 1 if held_out else 0
    word, pair, triple = (c.astype(np.int64) for c in counts)
    one, two = np.empty_like(word), np.empty_like(pair)
    one[1:], two[1:] = word[:-1], pair[:-1]
    # a text's first contexts were met once for each training document
    one[begin] = two[begin] = documents
    word, pair, triple, one, two = word - less, pair - less, triple - less, one - less, two - less
    p = np.empty((len(word), 4))
    p[:, 0] = np.where(two > 0, triple / np.maximum(two, 1), 0.0)
    p[:, 1] = np.where(one > 0, pair / np.maximum(one, 1), 0.0)
    p[:, 2] = word / max(1, total - less)
    p[:, 3] = 1 / (vocabulary + 1)
    return np.where(two > 0, SIZES + size_class(two), size_class(one)), p


def expectation(bucket: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """BUCKETS x 6: how much of the tokens each estimate accounts for, their number, and their log-likelihood."""
    share = weights[bucket] * p
    all_p = share.sum(1)
    share /= all_p[:, None]
    columns = [*share.T, np.ones(len(p)), np.log(all_p)]
    return np.stack([np.bincount(bucket, c, BUCKETS) for c in columns], 1)


def maximised(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """New weights; buckets without tokens keep theirs. None falls to 0, so that an unmet word keeps some probability."""
    n = sums[:, 4:5]
    new = np.where(n > 0, sums[:, :4] / np.maximum(n, 1), weights)
    new = np.maximum(new, 1e-9)
    return new / new.sum(1, keepdims=True)


def first_weights() -> np.ndarray:
    out = np.full((BUCKETS, 4), 0.25)
    out[0] = [0, 0, 0.5, 0.5]
    out[1:SIZES] = [0, 1 / 3, 1 / 3, 1 / 3]
    out = np.maximum(out, 1e-9)
    return out / out.sum(1, keepdims=True)


def slices(part: Part, tokens: int = 200_000):
    """Documents of about so many tokens at a time: (first document, last, first token, last)."""
    lo, ends = 0, part.begin + part.size
    while lo < len(part.ids):
        hi = max(lo + 1, int(np.searchsorted(ends, part.begin[lo] + tokens, "right")))
        yield lo, hi, int(part.begin[lo]), int(ends[hi - 1])
        lo = hi


class Slice:
    """Documents and their tokens' counts, as read back."""

    SCHEMA = "ids binary, sizes binary, train binary, counts binary"

    def __init__(self, ids: bytes, sizes: bytes, train: bytes, counts: bytes):
        self.ids, self.size = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64)
        self.train = np.frombuffer(train, bool)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint8).reshape(3, 4, -1)
        self.counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i4")[:, :, 0]

    @staticmethod
    def packed(part: Part, counts: np.ndarray, first: int, last: int, a: int, b: int) -> list[bytes]:
        # bytes of equal weight side by side, as most of the upper ones are 0
        planes = np.ascontiguousarray(counts[:, a:b].astype("<i4")).view(np.uint8).reshape(3, b - a, 4).transpose(0, 2, 1)
        z = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())
        return [part.ids[first:last].tobytes(), part.size[first:last].tobytes(), part.train[first:last].tobytes(), z]

    def learnt(self, documents: int, total: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
        on = np.repeat(self.train, self.size)
        bucket, p = estimates(self.counts, self.begin, documents, total, vocabulary, True)
        return bucket[on], p[on]


def _held(docs: DataFrame, text: str, key: str, train: Column, parts: int) -> DataFrame:
    """(part, id, train, z): documents dealt by id, texts compressed."""

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [z.compress(t) if t else b"" for t in (x.as_py() for x in b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], ["part", "id", "train", "z"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("binary").alias("t")).where("id IS NOT NULL")
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "train", "t")
    return rows.mapInArrow(squeeze, "part int, id long, train boolean, z binary")


def score(spark: SparkSession, docs: DataFrame, train: Column, *, text: str = "text", key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """One row a document: key, n_tokens, n_known, train_tokens, base_score, score (log10). ``train`` marks the rows to learn from."""
    rows = docs.select(key, text)
    size = rows.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    held = _held(docs, text, key, train, parts)
    blocks = "w binary, p binary, t binary"

    def ask(batches):
        rows = [(i, t, z) for b in batches for i, t, z in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        if not rows:
            return
        me = TaskContext.get().partitionId()
        out = list(Part(rows, WordHash()).requests(parts))
        for lo in range(0, len(out), 8):
            some = out[lo : lo + 8]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int32()), pa.array([me] * len(some), pa.int32()), *[pa.array(x, pa.binary()) for x in zip(*(k for _, k in some), strict=True)]], ["range", "part", "w", "p", "t"])

    def count(batches):
        asked: list[list] = [[], [], [], []]
        for b in batches:
            for x, c in zip(asked, b.columns[1:], strict=True):
                x += c.to_pylist()
        if not asked[0]:
            return
        mine, replies, sums = TaskContext.get().partitionId(), [], []
        ends = mix64(np.array([END], U64))[0]
        for order, blocks in enumerate(asked[1:]):
            got = [unpack(x) for x in blocks]
            blocks.clear()
            keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            total = np.bincount(at, np.concatenate([g[1] for g in got]), len(keys)).astype(np.int64)
            cuts = np.cumsum([0] + [len(g[0]) for g in got])
            replies.append([pack_counts(total[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            if order == 0:
                # tokens, distinct tokens, and documents: as many as ends
                sums = [int(total.sum()), int((total > 0).sum()), int(total[keys == ends].sum())]
            del got, at
        for i, part in enumerate(asked[0]):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mine], pa.int32()), *[pa.array([r[i]], pa.binary()) for r in replies], *[pa.array([x if i == 0 else 0], pa.int64()) for x in sums]], ["part", "range", "w", "p", "t", "n", "v", "d"])

    asked = held.repartitionById(parts, F.col("part")).mapInArrow(ask, f"range int, part int, {blocks}")
    answered = asked.repartitionById(parts, F.col("range")).mapInArrow(count, f"part int, range int, {blocks}, n long, v long, d long")
    replies = cut(spark, answered, "counts")
    total, vocabulary, documents = (x or 0 for x in replies.agg(F.sum("n"), F.sum("v"), F.sum("d")).first())

    none = F.lit(None).cast("binary")
    both = held.select("part", F.lit(-1).alias("range"), "id", "train", F.col("z").alias("w"), none.alias("p"), none.alias("t"))
    both = both.unionByName(replies.select("part", "range", F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("train"), "w", "p", "t"))

    def met(batches):
        rows, got = [], []
        for b in batches:
            for _, r, i, t, w, p, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows.append((i, t, w)) if r < 0 else got.append((r, w, p, x))
        if rows:
            part = Part(rows, WordHash())
            counts = part.take(got, parts)
            for at in slices(part):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Slice.packed(part, counts, *at)], ["ids", "sizes", "train", "counts"])

    counted = cut(spark, both.repartitionById(parts, F.col("part")).mapInArrow(met, Slice.SCHEMA), "counted")
    discard(spark, replies)

    def each(batches):
        for b in batches:
            yield from (Slice(*row) for row in zip(*[c.to_pylist() for c in b.columns], strict=True))

    def sums_of(weights: np.ndarray) -> np.ndarray:
        """One round's sums over all held-out tokens."""

        def run(batches):
            sums = np.zeros((BUCKETS, 6))
            for s in each(batches):
                if s.train.any():
                    sums += expectation(*s.learnt(documents, total, vocabulary), weights)
            yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), *[pa.array(c) for c in sums.T]], ["bucket", *"abcdnl"])

        rows = counted.mapInArrow(run, "bucket int, a double, b double, c double, d double, n double, l double").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in "abcdnl"]).collect()
        out = np.zeros((BUCKETS, 6))
        for r in rows:
            out[r["bucket"]] = [r[c] for c in "abcdnl"]
        return out

    def sampled(batches):
        """Held-out tokens picked evenly, about START_TOKENS of them all."""
        for s in each(batches):
            if s.train.any():
                bucket, p = s.learnt(documents, total, vocabulary)
                pick = np.random.default_rng(int(s.ids[0]) & 0xFFFF_FFFF).random(len(bucket)) < START_TOKENS / max(1, total)
                if pick.any():
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[pick].astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in p[pick].T]], ["bucket", *"abcd"])

    weights = first_weights()
    if total:
        sample = counted.mapInArrow(sampled, "bucket int, a double, b double, c double, d double").toArrow().sort_by([(c, "ascending") for c in ("bucket", *"abcd")])
        if sample.num_rows:
            bucket, p = sample.column(0).to_numpy().astype(np.int64), np.stack([sample.column(i).to_numpy() for i in range(1, 5)], 1)
            for _ in range(100):
                weights = maximised(expectation(bucket, p, weights), weights)
        best = -np.inf
        for _ in range(ROUNDS):
            sums = sums_of(weights)
            weights = maximised(sums, weights)
            now = sums[:, 5].sum() / max(1, sums[:, 4].sum())
            if now - best < GAIN:
                break
            best = now

    def evaluate(batches):
        for s in each(batches):
            bucket, p = estimates(s.counts, s.begin, documents, total, vocabulary, False)
            chance = (weights[bucket] * p).sum(1) if total else np.ones(len(p)) / (vocabulary + 1)
            word = s.counts[0].astype(np.int64)
            sums = [np.add.reduceat(x, s.begin) for x in ((word > 0).astype(np.int64), np.log10((word + 1) / (total + vocabulary + 1)), np.log10(chance))]
            yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(s.size), pa.array(sums[0]), pa.array(np.full(len(s.ids), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.mapInArrow(evaluate, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", key)
