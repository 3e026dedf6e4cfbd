"""Benchmark decontamination: CGK walks, bit-sampling LSH, exact edit verification.

Texts and benchmark items become sequences of symbols: words lower-cased (A-Z),
with ASCII punctuation stripped from both ends. A word of no item is the blank
symbol. An item is found in a document if some stretch of it is at an edit
distance, in words, of at most ``floor(edits * words)`` of the item.

Embedding. Items fall into size classes whose lengths differ by at most a
tenth. A window of a class's least length is embedded by a CGK walk (Chakraborty,
Goldenberg, Koucky): step by step the walk shows the symbol it stands on, and a
random bit of step and symbol says whether it moves on. Two windows at a small
edit distance fall into step again after each edit, so their walks differ in few
places: edit distance becomes Hamming distance. Windows of every start are
walked, over twice their length in steps, which is what a walk needs to pass
through.

Search. A repetition has a walk of its own and samples ``BITS`` of its steps
from the whole walk; a window and an item that agree there are a candidate. The
number of repetitions follows from ``target_recall``: on a bounded sample of the
class's own items (``TRIALS``), edited as much as allowed at the head, in the
middle, at the tail or all over, by replacements, insertions or deletions, the
chance of a hit a repetition is measured, and repetitions are added until the
worst of these twelve cases is expected to reach the target. Items without an
allowance are met in every repetition, so one is enough.

Lossless filters spare windows that no item can match: at most k of the words
surely in the stretch are no item's words; and as an edit spoils at most two pairs and
three triples of neighbouring words, at most 2k pairs and 3k triples are of no item. Candidates are verified by
bit-parallel edit distance (Myers) from the item's end backwards, which gives
the least distance from every start around in one pass.

Items are handled in groups of at most ``group_items`` items and ``GROUP_BYTES``
of text (or one item); one group's tables are broadcast for each pass over the
documents, so what is broadcast is bounded whatever the benchmark's size. Equal
texts are in the same group. Items of fewer than ``min_words`` words (by default
none) are matched exactly only.

Defined cases: null and empty texts are clean; null or empty items match
nothing; repeated items count once (smallest id); extra columns are ignored;
ties in distance go to the smaller item id; every row is judged by itself, so
null and repeated ids are results like others; long texts are searched whole.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, forget, give_back, mix64

STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BITS = 3
TRIALS, TRIAL_REPEATS, MOST_REPEATS = 24, 48, 160
WALKERS = 200_000
GROUP_BYTES = 32_000_000
PRIME = 1_000_003
NEAR = (2, 3)
PLACEMENTS = ("head", "middle", "tail", "spread")
KINDS = ("replace", "insert", "delete")


def symbols(text: bytes | None) -> list[bytes]:
    out = []
    for w in (text or b"").lower().split():
        w = w.strip(STRIP)
        if w:
            out.append(w)
    return out


def edit_distance(a: list, b: list, most: int) -> int:
    """Least edits turning ``a`` into some prefix of ``b``, or most + 1. Banded."""
    big = most + 1
    prev = [j if j <= most else big for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        lo, hi = max(0, i - most), min(len(b), i + most)
        if lo > len(b):
            return big
        row = [big] * (len(b) + 1)
        if lo == 0:
            row[0] = i if i <= most else big
        for j in range(max(1, lo), hi + 1):
            row[j] = min(prev[j - 1] + (a[i - 1] != b[j - 1]), prev[j] + 1, row[j - 1] + 1, big)
        if min(row[lo : hi + 1]) > most:
            return big
        prev = row
    return min(min(prev), big)


def codes_of(syms: np.ndarray) -> np.ndarray:
    """A random 32-bit code of each symbol."""
    return (mix64(syms.astype(np.int64).view(U64) + U64(0x5DEECE66D)) >> U64(32)).astype(np.uint32)


def grams(syms: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` neighbouring symbols."""
    out = np.zeros(len(syms) - size + 1, np.int64)
    for j in range(size):
        out = (out ^ out >> 15) * PRIME + syms[j : len(syms) - size + 1 + j]
    return out


class Item:
    """One item and its allowance."""

    def __init__(self, item: int, syms: np.ndarray, most: int):
        self.item, self.syms, self.most = item, syms, most

    def bits(self) -> dict[int, int]:
        """The places of each of its words, from its end, as bits."""
        out: dict[int, int] = {}
        for j, s in enumerate(self.syms[::-1].tolist()):
            out[s] = out.get(s, 0) | 1 << j
        return out

    def distances(self, bits: dict[int, int], words: list[int]) -> list[int]:
        """From each word, the least edits turning the item into what follows, of any length."""
        m, out = len(self.syms), []
        full, top = (1 << m) - 1, 1 << m - 1
        up, down, d = full, 0, m
        for w in reversed(words):
            eq = bits.get(w, 0)
            x = eq | down
            flat = (((eq & up) + up) ^ up) | eq
            more, less = down | ~(flat | up) & full, up & flat
            d += (more & top > 0) - (less & top > 0)
            more, less = more << 1 & full, less << 1 & full
            up, down = less | ~(x | more) & full, more & x
            out.append(d)
        return out[::-1]


def edited(item: np.ndarray, most: int, kind: str, placement: str, rng) -> np.ndarray:
    """``item`` after ``most`` edits of a kind at a placement; new words are blanks (0)."""
    n = len(item)
    if placement == "spread":
        places = rng.choice(n, most, replace=False)
    else:
        places = np.arange(most) + {"head": 0, "middle": (n - most) // 2, "tail": n - most}[placement]
    out = item.tolist()
    for at in sorted(places.tolist(), reverse=True):
        out[at : at + 1] = {"replace": [0], "insert": [0, out[at]], "delete": []}[kind]
    return np.array(out, np.int64)


class Walks:
    """The index of one size class: repetitions of walk and sampled steps, and the items' hashes in each."""

    def __init__(self, items: list[tuple[int, Item]], target_recall: float, seed: int):
        self.size = min(len(x.syms) for _, x in items)
        self.most = max(x.most for _, x in items)
        self.steps = max(1, 2 * self.size)
        bits = min(BITS, self.steps)
        while True:
            self.draw(1 if not self.most else TRIAL_REPEATS, bits, seed)
            repeats = self.repeats_for(items, bits, target_recall, seed) if self.most else 1
            if repeats:
                break
            bits -= 1  # fewer samples agree more often
        self.draw(repeats, bits, seed)
        heads = np.concatenate([x.syms[: self.size] for _, x in items])
        got = self.walk(codes_of(heads), np.arange(len(items)) * self.size)
        who = np.tile(np.array([k for k, _ in items], np.int64), len(self.odd))
        order = np.argsort(got.ravel(), kind="stable")
        self.keys, self.item = got.ravel()[order], who[order]

    def draw(self, repeats: int, bits: int, seed: int) -> None:
        rng = np.random.default_rng([seed, self.size])
        self.odd = rng.integers(0, 2**31, (repeats, self.steps), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.sampled = np.zeros((repeats, self.steps), bool)
        for r in self.sampled:
            r[rng.choice(self.steps, bits, replace=False)] = True
        self.last = int(np.flatnonzero(self.sampled.any(0))[-1])

    def walk(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(repetitions x starts) hashes of what the walks over codes[start : start + size] show at the sampled steps; past the end they show a pad."""
        wide = self.size + 1
        padded = np.append(codes, np.zeros(self.size, np.uint32))
        cells = np.ones((len(starts), wide), np.uint32)
        cells[:, :-1] = padded[starts[:, None] + np.arange(self.size)]
        cells, last = cells.ravel(), np.arange(1, len(starts) + 1, dtype=np.int32) * wide - 1
        at = np.repeat((last - self.size)[None], len(self.odd), 0)
        out = np.repeat(mix64(np.arange(1, len(self.odd) + 1, dtype=U64))[:, None], len(starts), 1)
        for j in range(self.last + 1):
            seen = cells.take(at)
            rows = np.flatnonzero(self.sampled[:, j])
            if len(rows):
                out[rows] = mix64(out[rows] * U64(31) + seen[rows])
            seen *= self.odd[:, j : j + 1]
            seen >>= np.uint32(31)
            at += seen.view(np.int32)
            np.minimum(at, last, out=at)
        return out

    def repeats_for(self, items: list[tuple[int, Item]], bits: int, target_recall: float, seed: int) -> int:
        """Repetitions that the worst kind and placement of edits needs, from the share of trial repetitions that hit (half a hit added, so that none is not taken for never); 0 if too many, so that fewer samples are better."""
        rng = np.random.default_rng([seed, self.size, 1])
        able = [x for _, x in items if x.most]
        chosen = [able[i] for i in rng.choice(len(able), TRIALS, replace=len(able) < TRIALS)]
        blank = np.zeros(self.size, np.int64)
        lines, starts, owner, at = [], [], [], 0
        trials = [(kind, placement, x) for kind in KINDS for placement in PLACEMENTS for x in chosen]
        for i, (kind, placement, x) in enumerate(trials):
            line = np.concatenate([blank, edited(x.syms, x.most, kind, placement, rng), blank])
            near = np.arange(max(0, self.size - x.most), self.size + x.most + 1)
            lines.append(line)
            starts.append(near + at)
            owner.append(np.full(len(near), i))
            at += len(line)
        own = self.walk(codes_of(np.concatenate([x.syms[: self.size] for x in chosen])), np.arange(len(chosen)) * self.size)
        owner = np.concatenate(owner)
        met = self.walk(codes_of(np.concatenate(lines)), np.concatenate(starts)) == own[:, owner % len(chosen)]
        hit = np.logical_or.reduceat(met, np.searchsorted(owner, np.arange(len(trials))), axis=1).mean(0)
        hit = (hit * len(self.odd) + 0.5) / (len(self.odd) + 1)
        lost = 1 - hit.reshape(-1, len(chosen))  # by kind and placement
        repeats = 1
        while (1 - (lost**repeats).mean(1)).min() < target_recall:
            repeats += 1 + repeats // 8
            if repeats > MOST_REPEATS and bits > 1:
                return 0
            if repeats > 16 * TRIAL_REPEATS:
                break
        return repeats

    def places(self, syms: np.ndarray, codes: np.ndarray, blanks: np.ndarray, misses: list[np.ndarray]):
        """(item, start) candidates, some at a time."""
        # of what is surely in the stretch, few words and pairs are of no item; a window may begin before the text, as an item whose head was cut off there does
        sure = max(1, self.size - self.most)
        ends = len(syms) - sure + 1
        if ends < 1:
            return
        ok = blanks[sure:] - blanks[:ends] <= self.most
        for g, missed in zip(NEAR, misses, strict=True):
            if sure >= g:
                within = sure - g + 1
                ok &= missed[within : within + ends] - missed[:ends] <= g * self.most
        starts = np.flatnonzero(ok)
        wide = max(1, WALKERS // len(self.odd))
        for lo in range(0, len(starts), wide):
            part = starts[lo : lo + wide]
            got = self.walk(codes, part).ravel()
            first, last = np.searchsorted(self.keys, got, "left"), np.searchsorted(self.keys, got, "right")
            met = np.flatnonzero(last > first)
            n = last[met] - first[met]
            at = np.repeat(first[met] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())
            yield self.item[at], np.repeat(part[met % len(part)], n)


class Group:
    """Items of one group and their walks; small and broadcast."""

    def __init__(self, items: list[tuple[int, list[bytes]]], edits: float, min_words: int, target_recall: float = 0.99, seed: int = 7):
        seen: dict[tuple, int] = {}
        for i, w in sorted(items, key=lambda x: x[0]):
            if w:
                seen.setdefault(tuple(w), i)
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({x for ws in seen for x in ws}))}
        self.items = [Item(i, np.array([self.vocab[x] for x in ws], np.int64), min(len(ws) - 1, int(edits * len(ws))) if len(ws) >= min_words else 0) for ws, i in seen.items()]
        self.sizes = np.array([len(x.syms) for x in self.items], np.int64)
        self.most = np.array([x.most for x in self.items], np.int64)
        self.walks: list[Walks] = []
        order = sorted(range(len(self.items)), key=lambda k: (self.sizes[k], k))
        while order:
            # lengths within a tenth, and either all with an allowance or none
            least, free = self.sizes[order[0]], self.most[order[0]] > 0
            mine = [k for k in order if self.sizes[k] * 10 <= least * 11 and (self.most[k] > 0) == free]
            self.walks.append(Walks([(k, self.items[k]) for k in mine], target_recall, seed))
            taken = set(mine)
            order = [k for k in order if k not in taken]
        self.memo: dict[bytes, int] = {}
        seqs = [x.syms for x in self.items]
        # sets of neighbouring symbols, two and three, as bit tables; a false member only costs a look-up
        size = 1 << max(16, int(np.ceil(np.log2(1 + 16 * sum(map(len, seqs))))))
        self.near = [np.zeros(size, bool) for _ in NEAR]
        for x in seqs:
            for table, g in zip(self.near, NEAR, strict=True):
                if len(x) >= g:
                    table[grams(x, g) & (size - 1)] = True

    def encode(self, text: bytes | None) -> np.ndarray:
        """Symbols of a text: 0 for words of no item; what is only punctuation goes."""
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        words = text.lower().split() if text else []
        for w in set(words).difference(memo):
            x = w.strip(STRIP)
            memo[w] = self.vocab.get(x, 0) if x else -1
        syms = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        return syms[syms >= 0]

    @staticmethod
    def stretches(places: list[int], syms: np.ndarray, n: int, most: int, bits: dict) -> list[list[int]]:
        """[first, last) starts around the candidates of one item, joined where they overlap; without candidates of whose surely matched words more than ``most`` are not the item's."""
        out: list[list[int]] = []
        for place in places:
            sure = syms[max(0, place + most) : place + n - most].tolist()
            if len(sure) - sum(map(bits.__contains__, sure)) <= most:
                if out and place - most <= out[-1][1]:
                    out[-1][1] = place + most + 1
                else:
                    out.append([max(0, place - most), place + most + 1])
        return out

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int]]:
        """(number of the text, item id, least distance, word at which it starts) of every item found. The texts are searched as one sequence, kept apart by more separators than any allowance."""
        if not self.items:
            return []
        widest = int(self.most.max())
        gap = np.full(widest + 1, -1, np.int64)
        parts = [self.encode(t) for t in texts]
        begin = np.cumsum([len(gap)] + [len(p) + len(gap) for p in parts])
        syms = np.concatenate([gap, *(x for p in parts for x in (p, gap))])
        codes = codes_of(syms)
        blanks = np.concatenate([[0], np.cumsum(syms <= 0)])
        misses = [np.concatenate([[0], np.cumsum(~t[grams(syms, g) & (len(t) - 1)])]) if len(syms) >= g else np.zeros(1, np.int64) for t, g in zip(self.near, NEAR, strict=True)]
        places = set()
        for walks in self.walks:
            for item, at in walks.places(syms, codes, blanks, misses):
                places.update(zip(item.tolist(), at.tolist(), strict=True))
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for k, places_of in groupby(sorted(places), key=itemgetter(0)):
            item = self.items[k]
            n, most, bits = len(item.syms), item.most, item.bits()
            for first, last in self.stretches([p for _, p in places_of], syms, n, most, bits):
                # one pass for candidates that stand together
                for at, d in enumerate(item.distances(bits, syms[first : last + n + most].tolist())[: last - first], first):
                    if d <= most and syms[at] > 0:
                        doc = int(np.searchsorted(begin, at, "right")) - 1
                        if (d, at - begin[doc]) < found.get((doc, item.item), (10**9, 0)):
                            found[doc, item.item] = (d, int(at - begin[doc]))
        return [(doc, item, d, at) for (doc, item), (d, at) in sorted(found.items())]


def _groups(spark: SparkSession, benchmark: DataFrame, item_text: str, item_key: str, group_items: int, edits: float, min_words: int, target_recall: float):
    """Broadcast tables of the items, group by group."""
    items = benchmark.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t IS NOT NULL AND i IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    count = max(1, -(-n // group_items), -(-size // GROUP_BYTES))
    for g in range(count):
        part = items.where(F.pmod(F.xxhash64("t"), F.lit(count)) == g)
        yield spark.sparkContext.broadcast(Group([(r["i"], symbols(bytes(r["t"]))) for r in part.toLocalIterator()], edits, min_words, target_recall))


def _sliced(batches, slice_rows: int):
    for b in batches:
        for lo in range(0, b.num_rows, slice_rows):
            yield b.slice(lo, slice_rows)


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", edits: float = 0.15, min_words: int = 0, target_recall: float = 0.99, group_items: int = 20_000, slice_rows: int = 512) -> DataFrame:
    """One row for each document and item found in it: key, item_id, distance, at_word."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"))
    out = None
    for shared in _groups(spark, benchmark, item_text, item_key, group_items, edits, min_words, target_recall):

        def run(batches, shared=shared):
            forget()
            group = shared.value
            for part in _sliced(batches, slice_rows):
                got = group.hits(part.column(1).to_pylist())
                doc, *rest = zip(*got, strict=True) if got else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], ["k", "item_id", "distance", "at_word"])
            give_back()

        part = rows.mapInArrow(run, f"k {kind}, item_id long, distance long, at_word long")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("k", key)


def flag(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", edits: float = 0.15, min_words: int = 0, target_recall: float = 0.99, group_items: int = 20_000, slice_rows: int = 512) -> DataFrame:
    """One row a row of ``docs``: key, contaminated, n_items, item_id and distance of the closest item. Rows are judged where they stand, nothing is shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, t binary, n long, item long, far long"
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("far"))
    for shared in _groups(spark, benchmark, item_text, item_key, group_items, edits, min_words, target_recall):

        def run(batches, shared=shared):
            forget()
            group = shared.value
            for part in _sliced(batches, slice_rows):
                n, item, far = (part.column(c).to_pylist() for c in (2, 3, 4))
                for doc, i, d, _ in group.hits(part.column(1).to_pylist()):
                    n[doc] += 1
                    if far[doc] is None or (d, i) < (far[doc], item[doc]):
                        far[doc], item[doc] = d, i
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.int64()) for x in (n, item, far)]], ["k", "t", "n", "item", "far"])
            give_back()

        rows = rows.mapInArrow(run, schema)
    return rows.select(F.col("k").alias(key), (F.col("n") > 0).alias("contaminated"), F.col("n").alias("n_items"), F.col("item").alias("item_id"), F.col("far").alias("distance"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_text: str = "text", item_key: str = "item_id", edits: float = 0.15, min_words: int = 0, target_recall: float = 0.99, group_items: int = 20_000, slice_rows: int = 512) -> DataFrame:
    """``docs`` without the rows in which an item is found; rows pass whole, so nothing is shuffled."""
    at = docs.columns.index(text)
    for shared in _groups(spark, benchmark, item_text, item_key, group_items, edits, min_words, target_recall):

        def run(batches, shared=shared):
            forget()
            group = shared.value
            for part in _sliced(batches, slice_rows):
                good = np.ones(part.num_rows, bool)
                good[[h[0] for h in group.hits([None if t is None else t.encode() for t in part.column(at).to_pylist()])]] = False
                yield part.filter(pa.array(good))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
