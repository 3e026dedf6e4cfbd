"""Language identification by segmentation-marginalised unigrams.

A fixed public byte-level vocabulary supplies the pieces, of any length. For each
language a unigram distribution over pieces is learnt by expectation-maximisation
(forward-backward over all segmentations of the training words), and a text is
scored by the forward algorithm: the probability of a word is the sum over all
its segmentations, the probability of a text the product over its words.

Words are lower-cased, split at ASCII white space, and carry a leading space. They
are of any length. Up to ``SHORT`` bytes, words of equal length go side by side,
every piece probability multiplied by 2^(``GAIN`` a byte), so that sums stay far
from the ends of the doubles' range (a byte's worst probability of 1e-8 makes
1e-282 of the longest such word); longer words go one by one in logarithms, over
the pieces that do occur in them. Within a task each distinct word is scored once.

Training reads a bounded sample of labelled rows (``sample_docs`` a language,
by a hash of the id); prediction covers every row and sees the text alone.

Defined cases: null text, or text without a letter -> ``und``, score 0.
No labelled rows -> every row is ``und``. Ties go to the alphabetically first
language. Extra columns are ignored, repeated rows give repeated results, null
ids are ids like others.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, give_back, kept, mix64, tokenizer_path

SHORT = 64
GAIN = 10
HEADSTART = 12
CACHE_WORDS = 150_000
BASE = U64(0x9E3779B97F4A7C15)
UNDETERMINED = "und"


def byte_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as raw bytes; all 256 single bytes are among them."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = {bytes([b]) for b in range(256)}
    for piece in vocab:
        if all(c in back for c in piece):
            out.add(bytes(back[c] for c in piece).lower())
    return sorted(out)


class Lattice:
    """All pieces at all places of a batch of words, found by hashing substrings against the piece table."""

    def __init__(self, pieces: list[bytes]):
        keys = np.zeros(len(pieces), U64)
        for i, p in enumerate(pieces):
            h = U64(0)
            with np.errstate(over="ignore"):
                for b in p:
                    h = h * BASE + U64(b + 1)
            keys[i] = h
        self.lengths = sorted({len(p) for p in pieces})
        self.bytes = np.array([len(p) for p in pieces] + [0])
        keys = mix64(keys)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        top = 18
        self.shift = U64(64 - top)
        self.start = np.searchsorted(self.keys, np.arange(2**top, dtype=U64) << self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1: a bucket by leading bits, then up to a few steps."""
        h = mix64(h)
        at = self.start[h >> self.shift]
        out = np.full(h.shape, -1, np.int64)
        last = len(self.keys) - 1
        todo = np.arange(h.size)
        while todo.size:
            k = self.keys[np.minimum(at[todo], last)]
            hit = (k == h[todo]) & (at[todo] <= last)
            out[todo[hit]] = self.order[at[todo[hit]]]
            todo = todo[(k < h[todo]) & (at[todo] < last)]
            at[todo] += 1
        return out

    def chars(self, words: list[bytes], n: int) -> np.ndarray:
        return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).astype(U64) + U64(1)

    def found(self, chars: np.ndarray):
        """(length, piece numbers at each start) of every length that pieces have."""
        h = np.zeros(chars.shape, U64)
        for k in range(1, min(self.lengths[-1], chars.shape[1]) + 1):
            # h[:, i] becomes the hash of the k bytes from i on
            h = h[:, : chars.shape[1] - k + 1] * BASE + chars[:, k - 1 :]
            if k in self.lengths:
                yield k, self.find(h.ravel()).reshape(h.shape)

    def spans(self, words: list[bytes]) -> list[tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]]:
        """Of words up to SHORT bytes, by length: which words, and for (start, length) their piece numbers where there are any."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = []
        for n in np.unique(lengths):
            if 0 < n <= SHORT:
                who = np.flatnonzero(lengths == n)
                spans = {}
                for k, ids in self.found(self.chars([words[i] for i in who], n)):
                    some = (ids >= 0).any(0)
                    spans |= {(i, k): ids[:, i] for i in np.flatnonzero(some).tolist()}
                out.append((who, spans))
        return out

    def edges(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in one word, by end."""
        parts = []
        for k, ids in self.found(self.chars([word], len(word))):
            at = np.flatnonzero(ids[0] >= 0)
            parts.append((at, at + k, ids[0, at]))
        start, end, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]


def gained(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Piece probabilities times 2^(GAIN x bytes); of pieces longer than SHORT, that no short word holds, 0."""
    return np.where((lengths <= SHORT)[:, None], np.ldexp(p, GAIN * np.minimum(lengths, SHORT)[:, None]), 0.0)


def forward(spans: dict, n: int, p: np.ndarray, backward: bool = False) -> np.ndarray:
    """alpha[i]: summed weight of all segmentations of the first i bytes (of the last n-i, if backward). p: weights, pieces x languages, its last row 0."""
    size = next(iter(spans.values())).shape[0]
    a = np.zeros((n + 1, size, p.shape[1]))
    a[n if backward else 0] = 1
    # every start before what follows it; backwards every end before what precedes it
    for i, k in sorted(spans, key=(lambda x: -x[0]) if backward else sum):
        if backward:
            a[i] += p[spans[i, k]] * a[i + k]
        else:
            a[i + k] += a[i] * p[spans[i, k]]
    return a


def forward_log(edges: tuple, n: int, logp: np.ndarray, backward: bool = False) -> np.ndarray:
    """The same for one word of any length, in logarithms: n + 1 x languages."""
    start, end, piece = edges
    here, there = (start, end) if backward else (end, start)
    if backward:
        order = np.argsort(start, kind="stable")
        here, there, piece = here[order], there[order], piece[order]
    cuts = np.searchsorted(here, np.arange(n + 2))
    a = np.full((n + 1, logp.shape[1]), -np.inf)
    a[n if backward else 0] = 0
    for i in range(n - 1, -1, -1) if backward else range(1, n + 1):
        x = a[there[cuts[i] : cuts[i + 1]]] + logp[piece[cuts[i] : cuts[i + 1]]]
        top = x.max(0)
        a[i] = top + np.log(np.exp(x - top).sum(0))
    return a


def split_words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def fit_pieces(counts: list[dict[bytes, int]], pieces: list[bytes], rounds: int = 3, smooth: float = 0.1) -> np.ndarray:
    """EM: piece probabilities by language (pieces + 1 rows, the last 0) from word counts by language."""
    words = sorted(set().union(*counts)) if counts else []
    langs = len(counts)
    c = np.array([[d.get(w, 0) for d in counts] for w in words], float).reshape(len(words), langs)
    size = len(pieces)
    # EM begins with a liking for long pieces, level from HEADSTART bytes on
    start = np.array([np.exp(1.5 * (min(len(p), HEADSTART) - 1)) for p in pieces])
    p = np.repeat((start / start.sum())[:, None], langs, 1)
    lattice = Lattice(pieces)
    for _ in range(rounds):
        expected = np.full((size + 1, langs), smooth)
        full = np.vstack([p, np.zeros(langs)])
        short, logp = gained(full, lattice.bytes), np.log(np.maximum(full, 1e-300))
        for lo in range(0, len(words), 4000):
            part = words[lo : lo + 4000]
            for who, spans in lattice.spans(part):
                n = len(part[who[0]])
                a, b = forward(spans, n, short), forward(spans, n, short, backward=True)
                weight = c[lo + who] / a[n]
                for (i, k), ids in spans.items():
                    ok = ids >= 0
                    add = (a[i] * short[ids] * b[i + k] * weight)[ok]
                    for lang in range(langs):
                        expected[:, lang] += np.bincount(ids[ok], add[:, lang], size + 1)
            for j, w in enumerate(part):
                if len(w) > SHORT:
                    edges = start_, end, piece = lattice.edges(w)
                    a, b = forward_log(edges, len(w), logp), forward_log(edges, len(w), logp, backward=True)
                    np.add.at(expected, piece, np.exp(a[start_] + logp[piece] + b[end] - a[-1]) * c[lo + j])
        expected = expected[:size]
        p = expected / expected.sum(0)
    return np.vstack([p, np.zeros(langs)])


class Scorer:
    """Log-probabilities of texts; words already met keep theirs, up to CACHE_WORDS."""

    def __init__(self, langs: list[str], prior: np.ndarray, p: np.ndarray, pieces: list[bytes]):
        self.langs, self.prior, self.p = langs, prior, p
        self.lattice = Lattice(pieces)
        self.short, self.logp = gained(p, self.lattice.bytes), np.log(np.maximum(p, 1e-300))
        self.reset()

    def reset(self) -> None:
        self.row: dict[bytes, int] = {}
        self.logs = np.zeros((CACHE_WORDS * 2, len(self.langs)))

    def learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 8192):
            part = words[lo : lo + 8192]
            spaced = [b" " + w for w in part]
            logs = np.zeros((len(part), len(self.langs)))
            for who, spans in self.lattice.spans(spaced):
                n = len(spaced[who[0]])
                logs[who] = np.log(forward(spans, n, self.short)[-1]) - n * GAIN * np.log(2)
            for i, w in enumerate(spaced):
                if len(w) > SHORT:
                    logs[i] = forward_log(self.lattice.edges(w), len(w), self.logp)[-1]
            at = len(self.row)
            if at + len(part) > len(self.logs):
                self.logs = np.vstack([self.logs, np.zeros((len(part) + CACHE_WORDS, len(self.langs)))])
            self.logs[at : at + len(part)] = logs
            self.row.update(zip(part, range(at, at + len(part)), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.row) > CACHE_WORDS:
            self.reset()
        if not self.langs:
            return [(UNDETERMINED, 0.0)] * len(texts)
        split = [split_words(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(self.row) if split else set()
        self.learn(list(fresh))
        out = []
        for text, words in zip(texts, split, strict=True):
            if not words or not any(map(str.isalpha, text)):
                out.append((UNDETERMINED, 0.0))
                continue
            ids = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
            total = self.logs[ids].sum(0) + self.prior
            e = np.exp(total - total.max())
            out.append((self.langs[best := int(total.argmax())], float(e[best] / e.sum())))
        return out


def scorer_for(model: dict) -> Scorer:
    """The worker's scorer of this model, with the words it has met; models are told apart by a name drawn when they were fitted."""
    return kept(("scorer", model["name"]), lambda: Scorer(model["langs"], model["prior"], model["p"], model["pieces"]))


def fit(spark: SparkSession, labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", vocab: str | None = None, sample_docs: int = 150) -> dict:
    """Learn from (text, lang) rows. The word statistics come from about ``sample_docs`` rows a language, picked by a hash of the key; the label frequencies from all."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    total = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(total)
    if not langs:
        return {"name": uuid.uuid4().hex, "langs": [], "prior": np.zeros(0), "p": np.zeros((2, 0)), "pieces": [b" "]}
    share = F.create_map(*[F.lit(x) for lg in langs for x in (lg, int(min(1.0, sample_docs / total[lg]) * 2**30))])
    picked = rows.where(F.pmod(F.xxhash64("k"), F.lit(2**30)) < share[F.col("l")])
    counts = [{} for _ in langs]
    at = {lg: i for i, lg in enumerate(langs)}
    spread = picked.select("l", F.explode(F.split(F.lower("t"), r"\s+")).alias("w")).where("w <> ''").groupBy("l", "w").agg(F.count("*").alias("n"))
    for r in spread.toLocalIterator():
        d = counts[at[r["l"]]]
        word = b" " + r["w"].encode("utf-8", "replace")
        d[word] = d.get(word, 0) + r["n"]
    pieces = byte_pieces(vocab or tokenizer_path("byte_bpe_50k.json"))
    prior = np.log(np.array([total[lg] for lg in langs], float) / sum(total.values()))
    return {"name": uuid.uuid4().hex, "langs": langs, "prior": prior, "p": fit_pieces(counts, pieces), "pieces": pieces}


def predict(spark: SparkSession, docs: DataFrame, model: dict, *, text: str = "text", key: str = "doc_id", slice_rows: int = 256) -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the vocabulary's size times the languages

    def run(batches):
        scorer = scorer_for(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, slice_rows):
                part = batch.slice(lo, slice_rows)
                got = scorer.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["k", "lang_pred", "score"])
        give_back()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, lang_pred string, score double").withColumnRenamed("k", key)


def keep_identified(spark: SparkSession, docs: DataFrame, model: dict, *, text: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is undetermined or less sure than ``min_score``; rows pass whole, so nothing is shuffled."""
    shared = spark.sparkContext.broadcast(model)
    column = docs.columns.index(text)

    def run(batches):
        scorer = scorer_for(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                good = [lang != UNDETERMINED and score >= min_score for lang, score in scorer.score(part.column(column).to_pylist())]
                yield part.filter(pa.array(good, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
