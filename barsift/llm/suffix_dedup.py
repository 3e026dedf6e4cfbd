"""Exact substring dedup: suffix arrays over what can recur, merged across shards.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller id, or same document and earlier start) is removed, judged on the
input. A window is a string of that length at one place.

Finding what can recur. In each window the minwise ``K``-mer is its anchor; the
windows of a document that follow each other and share an anchor are a run. As
the anchor depends on the window's bytes alone, equal windows have equal
anchors at equal offsets, so only runs of equal anchors need comparing. Parts
of the corpus (ranges of ids, so the order of parts is the order of documents)
ask two questions about their distinct runs and anchors, packed as sorted hash
blocks: is this run's content first met in me, and does this anchor come with
several contents. A run met before is wholly repeated; contents are told apart
by two hashes of 64 bits, one over bytes and one over K-mers: among 10^12 runs
the chance of any false match is some 10^-13. What is left open are
first runs of anchors with several contents, mostly the edges of repeats.

Suffix arrays. Those runs go to shards by anchor. A shard sorts its suffixes by
Larsson-Sadakane refinement (8 bytes first, then doubling inside groups that
are still equal, up to the window's length), takes common prefixes by Kasai's
method (in lanes, eight bytes a step), and finds for each group of equal
windows the earliest. An anchor with very many contents is dealt to several
shards; each sends the windows it met first as a sorted run of fingerprints,
and a later shard looks each of its own up among the earlier ones by binary
search.

Defined cases: null texts are empty; texts shorter than a window lose nothing;
rows without an id are left out; repeated ids are ordered by their text; extra
columns are ignored. Text is handled as UTF-8 bytes; matches never cross
documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, cut, discard, mix64
from .interpolated_lm import pack, ranges, unpack

K = 50
SEGMENT = 1 << 19
POSITION = U64((1 << 20) - 1)
SEPARATOR = 0xFF

_rng = np.random.default_rng(9)
BYTE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 1024)
        for name, base in (("up", _B), ("down", pow(_B, -1, 2**64))):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U64)
    return _powers["up"], _powers["down"]


def alike(key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order: the first place of each, and each place's number among them."""
    order = np.argsort(key, kind="stable")
    k, t = key[order], tag[order]
    if ((k[1:] == k[:-1]) & (t[1:] != t[:-1])).any():
        order = np.lexsort((tag, key))
        k, t = key[order], tag[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class Runs:
    """Runs of one text: first and last window, anchor hash, and two content hashes, one over bytes, one over K-mers."""

    def __init__(self, text: bytes, length: int):
        parts = [self._segment(text[lo : lo + SEGMENT + length - 1], lo, length) for lo in range(0, len(text) - length + 1, SEGMENT)]
        parts = [p for p in parts if p is not None]
        self.lo, self.hi, self.anchor, self.content, self.tag = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64 if i > 1 else np.int64) for i in range(5))

    @staticmethod
    def _segment(text: bytes, base: int, length: int):
        n = len(text)
        windows = n - length + 1
        if windows < 1:
            return None
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(BYTE[np.frombuffer(text, np.uint8)] * up[:n], out=sums[1:])
        mers = mix64((sums[K:] - sums[:-K]) * down[: n - K + 1])
        # the least of each window's k-mers, the leftmost of equals: place in the low bits
        least = (mers & ~POSITION) | np.arange(len(mers), dtype=U64)
        span, have, best = length - K + 1, 1, least
        while have * 2 <= span:
            best = np.minimum(best[: len(best) - have], best[have:])
            have *= 2
        if have < span:
            best = np.minimum(best[: len(best) - (span - have)], best[span - have :])
        at = (best[:windows] & POSITION).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        ends = np.append(starts[1:], windows) - 1
        whole = (sums[ends + length] - sums[starts]) * down[starts]
        place = at[starts]
        content = mix64(whole ^ mix64((ends - starts).astype(U64) * U64(4096) + (place - starts).astype(U64)))
        # the mixed K-mers are no polynomial of the bytes, so texts that agree in one hash by chance differ in the other
        np.cumsum(mers * up[: len(mers)], out=sums[1 : len(mers) + 1])
        tag = mix64((sums[ends + length - K + 1] - sums[starts]) * down[starts])
        # minima crowd at the low end; mixed again they spread over all ranges
        return starts + base, ends + base, mix64(mers[place] ^ BYTE[0]), content, tag


class Part:
    """The documents of a part in order, their runs, and the questions about them."""

    def __init__(self, docs: list[tuple[int, bytes]], length: int):
        inflate = zstandard.ZstdDecompressor()
        self.docs = sorted((i, inflate.decompress(z) if z else b"") for i, z in docs)
        runs = [Runs(t, length) for _, t in self.docs]
        self.doc = np.repeat(np.arange(len(runs)), [len(r.lo) for r in runs])
        self.lo, self.hi, anchor, content, tag = (np.concatenate([getattr(r, k) for r in runs]) if runs else np.zeros(0, np.int64) for k in ("lo", "hi", "anchor", "content", "tag"))
        anchor, content, tag = anchor.astype(U64), content.astype(U64), tag.astype(U64)
        self.anchor = anchor
        keys = mix64(anchor * U64(_B) + content)
        self.first, self.key = alike(keys, tag)
        self.keys, self.tags = keys[self.first], tag[self.first]
        self.anchors, self.a = np.unique(anchor, return_inverse=True)
        # contents of each anchor: how many, and one that stands for them
        owner = self.a[self.first]
        self.kinds = np.bincount(owner, minlength=len(self.anchors))
        self.one = np.zeros(len(self.anchors), U64)
        self.one[owner] = content[self.first]

    def questions(self, parts: int):
        none = np.zeros(len(self.keys), np.int64)
        ck, ca = ranges(self.keys, parts), ranges(self.anchors, parts)
        for r in range(parts):
            a, b = ca[r], ca[r + 1]
            x = slice(ck[r], ck[r + 1])
            yield r, pack(self.keys[x], none[x]), self.tags[x].astype("<u8").tobytes(), pack(self.anchors[a:b], self.kinds[a:b]), self.one[a:b].astype("<u8").tobytes()

    def answers(self, replies: list[tuple[int, bytes, bytes]], parts: int) -> None:
        """``repeated``: runs whose content was met before. ``open``: 1 for first runs of anchors with several contents, 2 if very many."""
        met, several = np.zeros(len(self.keys), bool), np.zeros(len(self.anchors), np.int8)
        ck, ca = ranges(self.keys, parts), ranges(self.anchors, parts)
        for r, x, y in replies:
            met[ck[r] : ck[r + 1]] = np.frombuffer(x, np.uint8)
            several[ca[r] : ca[r + 1]] = np.frombuffer(y, np.int8)
        here_first = np.zeros(len(self.lo), bool)
        here_first[self.first] = True
        self.repeated = met[self.key] | ~here_first
        self.open = np.where(self.repeated, 0, several[self.a])


def join_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ranges [lo, hi] joined where they touch or overlap."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1] + 1])
    at = np.flatnonzero(new)
    return lo[at], np.append(hi[at[1:] - 1], hi[-1])


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes or more, by Larsson-Sadakane refinement; and the 8 bytes at each place."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n, U64)
    for k in range(8):
        words = (words << U64(8)) | padded[k : n + k].astype(U64)
    sa = np.argsort(words, kind="stable").astype(np.int32)  # a shard is far below 2^31 bytes
    sorted_words = words[sa]
    new = np.concatenate([[True], sorted_words[1:] != sorted_words[:-1]]) if n else np.zeros(0, bool)
    del sorted_words
    # a group's number is its first place; places past the end come before all
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    h = 8
    while h < depth:
        alone = new & np.append(new[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        who = sa[todo]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)], -1)
        group = rank[who]
        order = np.lexsort((after, group))
        sa[todo] = who[order]
        after, group = after[order], group[order]
        split = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        new[todo] = split
        # numbers change only after all comparisons of this round
        rank[sa[todo]] = np.maximum.accumulate(np.where(split, todo, 0))
        h *= 2
    return sa, words


def common_prefixes(sa: np.ndarray, words: np.ndarray, most: int, lanes: int = 2048) -> np.ndarray:
    """Kasai: common prefix of each suffix with the one before it in order, up to ``most``. Lanes walk the text side by side; the prefix at one place less one is where the next place begins."""
    n = len(sa)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    step = -(-n // lanes)
    start = np.arange(0, n, step)
    h = np.zeros(len(start), np.int64)
    for i in range(step):
        at = start + i
        lane = np.flatnonzero(at < n)
        x = at[lane]
        y = before[x]
        got = np.where(y < 0, 0, h[lane])
        run = np.flatnonzero(y >= 0)
        while len(run):
            p, q = x[run] + got[run], y[run] + got[run]
            ok = (p < n) & (q < n)
            diff = np.where(ok, words[np.minimum(p, n - 1)] ^ words[np.minimum(q, n - 1)], U64(2**63))
            # equal leading bytes of eight
            same = (diff == 0).astype(np.int64)
            for bits in range(8, 64, 8):
                same += diff < U64(1 << bits)
            got[run] += same
            run = run[(same == 8) & (got[run] < most)]
        got = np.minimum(got, most)
        out[place[x]] = got
        # suffixes equal to the sorted depth stand in any order, so nothing carries over from them
        h[lane] = np.where(got >= most, 0, np.maximum(got - 1, 0))
    return out


def earlier_windows(snippets: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each snippet, the windows (starts) that equal an earlier one of any snippet, and those that equal none earlier. Snippets come in order."""
    sizes = np.array([len(s) + 1 for s in snippets])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text = np.frombuffer(bytes([SEPARATOR]).join(snippets) + bytes([SEPARATOR]), np.uint8)
    window = np.ones(len(text), bool)
    for b, n in zip(begin, sizes, strict=True):
        window[b + max(0, n - length) : b + n] = False
    sa, words = suffix_array(text, length)
    lcp = common_prefixes(sa, words, length)
    group = np.flatnonzero(np.concatenate([[True], lcp[1:] < length]))
    first = np.minimum.reduceat(sa, group)
    earliest = np.repeat(first, np.diff(np.append(group, len(sa))))
    again = np.zeros(len(text), bool)
    again[sa] = sa != earliest
    again &= window
    where = [np.flatnonzero(again[b : b + n]) for b, n in zip(begin, sizes, strict=True)]
    fresh = [np.flatnonzero(window[b : b + n] & ~again[b : b + n]) for b, n in zip(begin, sizes, strict=True)]
    return where, fresh


def fingerprints(snippet: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """Two hashes of each window."""
    up, down = powers(len(snippet) + 1)
    raw = np.frombuffer(snippet, np.uint8)
    out = []
    for table in (BYTE, mix64(BYTE)):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(table[raw] * up[: len(raw)], dtype=U64)])
        out.append(mix64((sums[starts + length] - sums[starts]) * down[starts]))
    return np.stack(out, 1)


def _rows(batches, columns):
    for b in batches:
        yield from zip(*[b.column(c).to_pylist() for c in columns], strict=True)


def _range_rows(part: list, doc: list, lo: list, hi: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["part", "doc", "lo", "hi"])


def dedup(spark: SparkSession, docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: int = 100, parts: int | None = None, shards: int | None = None, hot_kinds: int = 4_000) -> DataFrame:
    """One row a document: key, n_bytes, n_removed, n_spans, kept (remaining bytes)."""
    if length <= K:
        raise ValueError(f"length must be over {K}")
    want = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).where("id IS NOT NULL")
    bounds = sorted(set(rows.agg(F.percentile_approx("id", [i / want for i in range(1, want)], 10_000)).first()[0] or []))
    parts = len(bounds) + 1
    part_of = F.size(F.filter(F.lit(bounds), lambda b: b < F.col("id"))) if bounds else F.lit(0)

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            packed = [z.compress(t) if t else b"" for t in (x.as_py() for x in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["part", "id", "z"])

    held = rows.select(part_of.cast("int").alias("part"), "id", "t").mapInArrow(squeeze, "part int, id long, z binary")

    def ask(batches):
        docs = list(_rows(batches, (1, 2)))
        if docs:
            me = TaskContext.get().partitionId()
            part = Part(docs, length)
            for r, *blocks in part.questions(parts):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([me], pa.int32()), *[pa.array([v], pa.binary()) for v in blocks]], ["range", "part", "x", "tag", "y", "one"])

    def answer(batches):
        asked = sorted(_rows(batches, (1, 2, 3, 4, 5)))
        if not asked:
            return
        mine = TaskContext.get().partitionId()
        runs = [unpack(x)[0] for _, x, *_ in asked]
        cuts = np.cumsum([0] + [len(r) for r in runs])
        # blocks stand in order of parts, so the first of equal keys is the earliest part's
        first, at = alike(np.concatenate(runs), np.concatenate([np.frombuffer(t, "<u8") for _, _, t, *_ in asked]))
        met = (first[at] != np.arange(cuts[-1])).astype(np.uint8)
        got = [(*unpack(y), np.frombuffer(one, "<u8")) for *_, y, one in asked]
        cut_a = np.cumsum([0] + [len(g[0]) for g in got])
        keys, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        one = np.concatenate([g[2] for g in got])
        kinds = np.bincount(at, np.concatenate([g[1] for g in got]), len(keys))
        sample = np.zeros(len(keys), U64)
        sample[at] = one
        varied = np.bincount(at, (one != sample[at]).astype(float), len(keys)) + np.bincount(at, (np.concatenate([g[1] for g in got]) > 1).astype(float), len(keys))
        several = np.where(varied > 0, np.where(kinds > hot_kinds, 2, 1), 0).astype(np.int8)[at]
        for i, (part, *_) in enumerate(asked):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([mine], pa.int32()), pa.array([met[cuts[i] : cuts[i + 1]].tobytes()], pa.binary()), pa.array([several[cut_a[i] : cut_a[i + 1]].tobytes()], pa.binary())], ["part", "range", "x", "y"])

    asked = held.repartitionById(parts, F.col("part")).mapInArrow(ask, "range int, part int, x binary, tag binary, y binary, one binary")
    replies = cut(spark, asked.repartitionById(parts, F.col("range")).mapInArrow(answer, "part int, range int, x binary, y binary"), "replies")

    many = shards or parts

    def sift(batches):
        docs, got = [], []
        for r, i, x, y in _rows(batches, (1, 2, 3, 4)):
            docs.append((i, x)) if r < 0 else got.append((r, x, y))
        if not docs:
            return
        me = TaskContext.get().partitionId()
        part = Part(docs, length)
        part.answers(got, parts)
        out = {k: [] for k in ("shard", "hot", "doc", "lo", "hi", "snippet")}

        def batch():
            n = len(out["doc"])
            b = pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array([me] * n, pa.int32()), pa.array(out["doc"], pa.int32()), pa.array(out["lo"], pa.int64()), pa.array(out["hi"], pa.int64()), pa.array(out["snippet"], pa.binary())], ["shard", "hot", "part", "doc", "lo", "hi", "snippet"])
            for v in out.values():
                v.clear()
            return b

        again = np.flatnonzero(part.repeated)
        owner = part.doc[again]
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for first, end in zip(edges[:-1], edges[1:], strict=True):
            d, rows = owner[first], again[first:end]
            lo, hi = join_ranges(part.lo[rows], part.hi[rows])
            out["shard"] += [-1] * len(lo)
            out["hot"] += [False] * len(lo)
            out["doc"] += [int(d)] * len(lo)
            out["lo"] += lo.tolist()
            out["hi"] += hi.tolist()
            out["snippet"] += [None] * len(lo)
            if len(out["doc"]) > 50_000:
                yield batch()
        opened = np.flatnonzero(part.open)
        hot_runs = part.open[opened] == 2
        # a very common anchor's runs are dealt over shards by blocks of parts
        target = part.anchor[opened]
        target[hot_runs] = mix64(target[hot_runs] ^ U64(me // 2 + 1))
        for r, hot, shard in zip(opened.tolist(), hot_runs.tolist(), (target % U64(many)).tolist(), strict=True):
            out["shard"].append(shard)
            out["hot"].append(hot)
            out["doc"].append(int(part.doc[r]))
            out["lo"].append(int(part.lo[r]))
            out["hi"].append(int(part.hi[r]))
            out["snippet"].append(part.docs[part.doc[r]][1][part.lo[r] : part.hi[r] + length])
            if len(out["doc"]) > 20_000:
                yield batch()
        yield batch()

    none = F.lit(None).cast("binary")
    both = held.select("part", F.lit(-1).alias("range"), "id", F.col("z").alias("x"), none.alias("y")).unionByName(replies.select("part", "range", F.lit(None).cast("long").alias("id"), "x", "y"))
    sifted = cut(spark, both.repartitionById(parts, F.col("part")).mapInArrow(sift, "shard long, hot boolean, part int, doc int, lo long, hi long, snippet binary"), "sifted")

    def shard_runs(batches):
        rows = sorted((p, d, lo, hot, s) for p, d, lo, hot, s in _rows(batches, (2, 3, 4, 1, 5)))
        part, doc, first, last, a, b = [], [], [], [], [], []
        if rows:
            again, fresh = earlier_windows([r[4] for r in rows], length)
            for (p, d, at, hot, s), x, y in zip(rows, again, fresh, strict=True):
                lo, hi = join_ranges(x, x)
                part += [p] * len(lo)
                doc += [d] * len(lo)
                first += (lo + at).tolist()
                last += (hi + at).tolist()
                a += [None] * len(lo)
                b += [None] * len(lo)
                if hot and len(y):
                    prints = fingerprints(s, y, length).view(np.int64)
                    part += [p] * len(y)
                    doc += [d] * len(y)
                    first += (y + at).tolist()
                    last += (y + at).tolist()
                    a += prints[:, 0].tolist()
                    b += prints[:, 1].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(doc, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["part", "doc", "lo", "hi", "a", "b"])

    open_runs = sifted.where("shard >= 0").select("shard", "hot", "part", "doc", "lo", "snippet")
    sorted_shards = cut(spark, open_runs.repartitionById(many, F.col("shard").cast("int")).mapInArrow(shard_runs, "part int, doc int, lo long, hi long, a long, b long"), "shards")

    def merge(batches):
        """Windows first in their shard: each block of parts, in order, is looked up among those before it."""
        rows = sorted(_rows(batches, (0, 1, 2, 3, 4)))
        seen = np.zeros(0, [("a", np.int64), ("b", np.int64)])
        part, doc, at = [], [], []
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            mine = np.array([(r[3], r[4]) for r in rows[i:j]], seen.dtype)
            spot = np.searchsorted(seen, mine)
            known = (spot < len(seen)) & (seen[np.minimum(spot, max(0, len(seen) - 1))] == mine) if len(seen) else np.zeros(len(mine), bool)
            _, lead = np.unique(mine, return_index=True)
            known |= ~np.isin(np.arange(len(mine)), lead)
            for k in np.flatnonzero(known):
                part.append(rows[i + k][0])
                doc.append(rows[i + k][1])
                at.append(rows[i + k][2])
            seen = np.sort(np.concatenate([seen, mine[~known]]))
            i = j
        yield _range_rows(part, doc, at, at)

    fresh = sorted_shards.where("a IS NOT NULL").select("part", "doc", "lo", "a", "b").repartition(many, "a", "b")
    merged = fresh.mapInArrow(merge, "part int, doc int, lo long, hi long")
    found = sifted.where("shard < 0").select("part", "doc", "lo", "hi").union(sorted_shards.where("a IS NULL").select("part", "doc", "lo", "hi")).union(merged)

    last = held.select("part", F.lit(-1).alias("doc"), "id", F.lit(None).cast("long").alias("hi"), F.col("z")).unionByName(found.select("part", "doc", F.col("lo").alias("id"), "hi", none.alias("z")))

    def remove(batches):
        docs, cover = [], []
        for doc, i, hi, z in _rows(batches, (1, 2, 3, 4)):
            docs.append((i, z)) if doc < 0 else cover.append((doc, i, hi))
        if not docs:
            return
        inflate = zstandard.ZstdDecompressor()
        docs = sorted((i, inflate.decompress(z) if z else b"") for i, z in docs)
        spans = np.array(sorted(cover), np.int64).reshape(-1, 3)
        cuts = np.searchsorted(spans[:, 0], np.arange(len(docs) + 1))
        out = [[], [], [], [], []]
        for k, (i, t) in enumerate(docs):
            mine = spans[cuts[k] : cuts[k + 1]]
            lo, hi = join_ranges(mine[:, 1], mine[:, 2] + length - 1)
            kept, at = [], 0
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                kept.append(t[at:a])
                at = b + 1
            kept.append(t[at:])
            for o, v in zip(out, (i, len(t), int((hi - lo + 1).sum()), len(lo), b"".join(kept)), strict=True):
                o.append(v)
            if k % 500 == 499:
                yield kept_rows(out)
                out = [[], [], [], [], []]
        yield kept_rows(out)

    def kept_rows(out):
        return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    result = last.repartitionById(parts, F.col("part")).mapInArrow(remove, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    discard(spark, replies)
    return result.withColumnRenamed("id", key)
