"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first.

Vectors are brought to unit length, where nearness by cosine is nearness by
distance. The top of the tree is fitted on a bounded sample (``sample_rows``) by
recursive k-means of ``branch`` centres, down to leaves of the wished size. Every
row is indexed: it descends to the leaf of the nearest centre at each level. The
tree grows with the table: leaves of more than ``grow_rows`` rows are fitted again,
each on a bounded sample of its own rows and on executors, and their rows descend
further, until no leaf is larger (or its vectors are all equal). Grown parts stay
in tables; only the top is broadcast.

A query visits leaves best bin first: branches are opened by the distance between
the query and their centres, and the nearest child of a branch with the branch.
So a leaf's turn is that of the farthest branch on its way, which is worked out
for many queries at once. Where leaves were grown, a query keeps its best
``visits`` bins of all it has met at each level.

How many leaves a query visits is calibrated: a bounded set of calibration
queries is answered by brute force over all rows, and the number of leaves is
widened until their recall reaches ``recall``. Vectors without near neighbours
(independent directions, say) need a good part of all leaves, so what a query costs
is bounded: neighbouring leaves are dealt to groups of about ``group_rows`` rows (by
default ``GROUP_BYTES`` of vectors), a larger leaf to several, and a query is sent once to each group that holds
leaves of its, with their list. A group's task holds the group's rows and takes queries by blocks:
cosines in single precision by matrix products, leaf by leaf; those within their
error of a query's ``k`` best are computed exactly. A second step keeps the best
of the groups' ``k`` best, ties to smaller ids. Queries are answered in as many
rounds as keep what is sent at once near the index's own size.

Of equal vectors only the k + 1 smallest different ids can be among anyone's k nearest
(ties go to smaller ids, and one may be the query's), so a batch of the
index keeps no more of them: copies of one vector do not pile up in a leaf.

Scores are cosines of the original vectors in double precision, computed in
the same way for every pair.

Defined cases: vectors that are null, empty, of another length than most, zero,
or hold null or non-finite components take no part as query or candidate; no
rows give no rows; a query with fewer candidates than ``k`` gets them all (it
visits every leaf when the table has at most ``k`` times the leaves' number of
rows); rows that share an id are one candidate and one query, at the best score
that any of their vectors gives; rows without an id take no part; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, mix64

BROADCAST_LEAVES = 100_000
#: Of a group's vectors; pairs of a query and a bin, and bytes of queries sent, held or written at once.
GROUP_BYTES, BLOCK_BINS, LEAST_SENT = 32_000_000, 1_000_000, 500_000_000
#: Queries, and rows of a leaf, of one matrix product.
BLOCK, TILE = 512, 4096


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from k-means++ seeds; at most k, all different."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = [x[rng.integers(len(x))]]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and far.sum() > 1e-12:
        centres.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


class Tree:
    """Nodes as (centres, children); a child that is a number is a leaf."""

    def __init__(self, sample: np.ndarray, branch: int, leaf_rows: int, seed: int = 5):
        self.leaves = 0
        rng = np.random.default_rng(seed)
        self.root = self.grow(sample, branch, max(2, leaf_rows), rng, 0)

    def grow(self, x, branch, leaf_rows, rng, depth):
        if len(x) > leaf_rows and depth < 12:
            c = kmeans(x, branch, rng)
            if len(c) > 1:
                near = self.nearest(x, c)
                return (c, [self.grow(x[near == j], branch, leaf_rows, rng, depth + 1) for j in range(len(c))])
        self.leaves += 1
        return self.leaves - 1

    @staticmethod
    def nearest(x, c):
        return (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                near = self.nearest(x[rows], node[0])
                todo += [(child, rows[near == j]) for j, child in enumerate(node[1])]
        return out

    def bins(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) each query's ``most`` leaves of the earliest turns, in no order, and the turns: the farthest centre opened on the way."""
        turn = np.empty((self.leaves, len(q)))
        side, todo = np.ascontiguousarray(q.T), [(self.root, np.zeros(len(q)))]
        while todo:
            node, key = todo.pop()
            if isinstance(node, int):
                turn[node] = key
                continue
            c = node[0]
            far = np.maximum((c**2).sum(1)[:, None] + 1 - 2 * (c @ side), 0)
            # the nearest child is opened with its parent; of equal turns the nearer is first
            below = np.where(far > far.min(0), np.maximum(key, far), key) + 1e-9 * far
            ends = [j for j, child in enumerate(node[1]) if isinstance(child, int)]
            turn[[node[1][j] for j in ends]] = below[ends]
            todo += [(child, below[j]) for j, child in enumerate(node[1]) if not isinstance(child, int)]
        turn = np.ascontiguousarray(turn.T)
        if most >= self.leaves:
            return np.broadcast_to(np.arange(self.leaves), turn.shape), turn
        got = np.argpartition(turn, most - 1, 1)[:, :most]
        return got, np.take_along_axis(turn, got, 1)

    def visit(self, q: np.ndarray, most: int) -> tuple[list[int], list[float]]:
        """One query's leaves best bin first, and their turns."""
        leaf, turn = (x[0] for x in self.bins(q[None], most))
        order = np.argsort(turn, kind="stable")
        return leaf[order].tolist(), turn[order].tolist()


def _clean(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v): rows with usable vectors, as doubles, or as floats where they are floats."""
    kind = "array<float>" if vectors.select(column).dtypes[0][1] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast(kind).alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(F.filter("v", lambda x: x.isNotNull()), lambda x: x != 0)
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(broken, F.lit(True)) & F.coalesce(nonzero, F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def telling(ids: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Rows that can be an answer: of each distinct vector the ``most`` smallest different ids, once each."""
    kinds = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, kind = np.unique(kinds, return_inverse=True)
    order = np.lexsort((ids, kind))
    k, i = kind[order], ids[order]
    order = order[np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])])]
    k = kind[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    place = np.arange(len(k)) - np.repeat(begin, np.diff(np.append(begin, len(k))))
    return np.sort(order[place < most])


class Cell:
    """Index rows of a group, leaf by leaf, and queries' best among them."""

    def __init__(self, leaf: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        rows = telling(ids, x, k + 1)
        rows = rows[np.argsort(leaf[rows], kind="stable")]
        self.k, self.ids, self.x = k, ids[rows], x[rows]
        self.names, begin = np.unique(leaf[rows], return_index=True)
        self.begin = np.append(begin, len(rows))
        self.unit, self.norm = np.empty(self.x.shape, np.float32), np.empty(len(rows))
        for lo in range(0, len(rows), TILE):
            part = self.x[lo : lo + TILE].astype(np.float64)
            self.unit[lo : lo + TILE] = unit(part)
            self.norm[lo : lo + TILE] = np.sqrt(np.einsum("ij,ij->i", part, part))
        # so many rows hold k ids besides the query's own
        self.most = (k + 1) * int(np.unique(self.ids, return_counts=True)[1].max(initial=1))
        # twice what single precision may be wrong by
        self.slack = np.float32(4 * (x.shape[1] + 8) * 2.0**-24)

    def best(self, qid: np.ndarray, q: np.ndarray, size: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, cosine) of each query's k best ids in its ``size`` leaves, its own id left out. An exact score is one dot product a pair by einsum, so it does not depend on the block."""
        q = q.astype(np.float64)
        u = unit(q).astype(np.float32)
        top = np.full((len(q), self.most), -np.inf, np.float32)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        at, who = np.searchsorted(self.names, leaves), np.repeat(np.arange(len(q)), size)
        here = np.flatnonzero(self.names[np.minimum(at, len(self.names) - 1)] == leaves)
        here = here[np.argsort(at[here], kind="stable")]
        at, who = at[here], who[here]
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                break
            first, last = self.begin[at[i]], self.begin[at[i] + 1]
            for lo in range(first, last, TILE):
                asks, width = who[i:j], min(last - lo, TILE)
                s = u[asks] @ self.unit[lo : lo + width].T
                hit = s.max(1) >= top[asks].min(1) - self.slack
                if not hit.all():
                    s, asks = s[hit], asks[hit]
                if len(asks):
                    n = min(self.most, width)
                    both = np.concatenate([top[asks], np.partition(s, width - n, 1)[:, width - n :]], 1)
                    top[asks] = np.partition(both, n, 1)[:, n:] if n < both.shape[1] else both
                    r, c = np.nonzero(s >= (top[asks].min(1) - self.slack)[:, None])
                    found.append((asks[r], lo + c, s[r, c]))
        a, row, near = (np.concatenate(x) for x in zip(*found, strict=True))
        on = (near >= top[a].min(1) - self.slack) & (self.ids[row] != qid[a])
        a, row = a[on], row[on]
        score, norm = np.empty(len(a)), np.sqrt(np.einsum("ij,ij->i", q, q))
        for lo in range(0, len(a), 50_000):
            i, j = a[lo : lo + 50_000], row[lo : lo + 50_000]
            score[lo : lo + 50_000] = np.einsum("ij,ij->i", self.x[j].astype(np.float64), q[i]) / (self.norm[j] * norm[i])
        ids = self.ids[row]
        if self.most > self.k + 1:  # of an id's rows the best
            order = np.lexsort((-score, ids, a))
            order = order[np.concatenate([[True], (np.diff(a[order]) != 0) | (np.diff(ids[order]) != 0)])[: len(order)]]
            a, ids, score = a[order], ids[order], score[order]
        order = np.lexsort((ids, -score, a))
        a, ids, score = a[order], ids[order], score[order]
        begin = np.searchsorted(a, np.arange(len(q)))
        on = np.arange(len(a)) - begin[a] < self.k
        return qid[a[on]], ids[on], score[on]


def _brute(rows: DataFrame, qid: np.ndarray, q: np.ndarray, k: int, size: int) -> dict[int, set[int]]:
    """Exact answers of a bounded number of queries over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((qid, q))

    def run(batches):
        ids, qs = shared.value
        for b in batches:
            if b.num_rows:
                cell = Cell(np.zeros(b.num_rows, np.int64), b.column(0).to_numpy(), matrix(b.column(1), size), k)
                got = cell.best(ids, qs, np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    out: dict[int, set[int]] = {}
    for r in _top(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k).toLocalIterator():
        out.setdefault(r["query_id"], set()).add(r["vec_id"])
    return out


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of the chunks' bests. A query has k rows a group it visited, so its list is bounded by the visits."""
    ids = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best_first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    lists = ids.groupBy("query_id").agg(best_first.alias("b"))
    return lists.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def _mixed(leaf: np.ndarray | int, below: np.ndarray) -> np.ndarray:
    """The number of a leaf below a leaf that was grown."""
    above = np.asarray(leaf, np.int64).view(np.uint64)
    return mix64(np.atleast_1d(mix64(np.atleast_1d(above)) ^ (np.asarray(below).astype(np.uint64) + np.uint64(1)))).view(np.int64)


def _runs(batches, keys: int):
    """Runs of equal leading columns out of sorted batches, batch by batch: (key, batch slice)."""
    for b in batches:
        if b.num_rows:
            cols = [b.column(i).to_numpy() for i in range(keys)]
            change = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in cols])) + 1
            for lo, hi in zip([0, *change], [*change, b.num_rows], strict=True):
                yield tuple(c[lo] for c in cols), b.slice(lo, hi - lo)


def _blocks(b: pa.RecordBatch, most: int):
    """A batch in slices whose queries have about BLOCK_BINS bins of ``most`` each."""
    step = max(1, min(BLOCK, BLOCK_BINS // max(1, most)))
    for lo in range(0, b.num_rows, step):
        yield b.slice(lo, step)


def _asked(leaf: np.ndarray, far: np.ndarray, ids: pa.Array, v: pa.Array):
    """Batches of (leaf, far, id, v) from (query, place) leaves and turns. Each row holds its query's vector, so a batch is bounded in bytes."""
    row = np.repeat(np.arange(len(leaf)), leaf.shape[1])
    step = max(1, GROUP_BYTES // 8 // max(1, v.nbytes // max(1, len(v))))
    for lo in range(0, len(row), step):
        take = pa.array(row[lo : lo + step])
        yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()[lo : lo + step].astype(np.int64)), pa.array(far.ravel()[lo : lo + step]), ids.take(take), v.take(take)], ["leaf", "far", "id", "v"])


class Grown:
    """One level of grown leaves: a table (leaf, tree), and how rows and queries descend through it."""

    def __init__(self, spark: SparkSession, rows: DataFrame, large: DataFrame, *, size: int, sample_rows: int, branch: int, leaf_rows: int, chunk_rows: int):
        self.spark, self.size, self.chunk_rows = spark, size, chunk_rows
        self.parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        share = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n"))
        drawn = rows.join(large, "leaf").where(F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(2**30)) < share * F.lit(2**30))

        def fit(table: pa.Table) -> pa.Table:
            x = unit(matrix(table.column("v").combine_chunks(), size))
            n = table.column("n")[0].as_py()
            tree = Tree(x[np.lexsort(x.T[::-1])], branch, int(leaf_rows * len(x) / n), seed=table.column("leaf")[0].as_py() % 2**32)
            return pa.table({"leaf": table.column("leaf")[:1], "n": pa.array([n], pa.int64()), "tree": pa.array([pickle.dumps(tree) if tree.leaves > 1 else None], pa.binary())})

        fitted = drawn.groupBy("leaf").applyInArrow(fit, "leaf long, n long, tree binary")
        self.trees = cut(spark, fitted.where("tree IS NOT NULL"), "trees")

    def _met(self, rows: DataFrame) -> DataFrame:
        """(leaf, chunk, kind, id, v, tree, far): each tree before its rows, chunk by chunk."""
        kind = dict(rows.dtypes)["v"]
        far = F.col("far") if "far" in rows.columns else F.lit(0.0)
        chunks = self.trees.select("leaf", F.ceil(F.col("n") / self.chunk_rows).cast("int").alias("chunks"), "tree")
        held = rows.join(chunks.select("leaf", "chunks"), "leaf").select("leaf", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("tree"), far.alias("far"))
        copies = chunks.select("leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(None).cast(kind).alias("v"), "tree", F.lit(0.0).alias("far"))
        both = copies.select(copies.leaf, F.col("chunk").cast("long").alias("chunk"), "kind", "id", "v", "tree", "far").unionByName(held.select("leaf", F.col("chunk").cast("long").alias("chunk"), "kind", "id", "v", "tree", "far"))
        return both.repartition(self.parts, "leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind")

    def descend(self, rows: DataFrame) -> DataFrame:
        """(leaf, id, v) with the leaves of this level in place of those grown."""
        size = self.size

        def run(batches):
            tree = None
            for (leaf, _, kind), b in _runs(batches, 3):
                if kind == 0:
                    tree = pickle.loads(b.column(5)[0].as_py())
                else:
                    below = tree.assign(unit(matrix(b.column(4), size)))
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(leaf, below)), b.column(3), b.column(4)], ["leaf", "id", "v"])

        stay = rows.join(self.trees.select("leaf"), "leaf", "left_anti")
        return stay.unionByName(self._met(rows).mapInArrow(run, f"leaf long, id long, v {dict(rows.dtypes)['v']}"))

    def visit(self, asked: DataFrame, most: int) -> DataFrame:
        """(leaf, far, id, v) with each query's bins of this level; of all a query has, the ``most`` best stay."""
        size = self.size

        def run(batches):
            tree = None
            for (leaf, _, kind), b in _runs(batches, 3):
                if kind == 0:
                    tree = pickle.loads(b.column(5)[0].as_py())
                    continue
                for part in _blocks(b, tree.leaves):
                    below, far = tree.bins(unit(matrix(part.column(4), size)), most)
                    far = np.maximum(far, part.column(6).to_numpy()[:, None])
                    yield from _asked(_mixed(leaf, below.ravel()).reshape(below.shape), far, part.column(3), part.column(4))

        stay = asked.join(self.trees.select("leaf"), "leaf", "left_anti").select("leaf", "far", "id", "v")
        return best_bins(stay.unionByName(self._met(asked).mapInArrow(run, f"leaf long, far double, id long, v {dict(asked.dtypes)['v']}")), most)


def _dealt(sizes: list, leaves: int, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each leaf's first group, and its number of groups: more than one for a leaf of over ``group_rows`` rows, which are its own."""
    n = np.zeros(leaves, np.int64)
    for r in sizes:
        n[r["leaf"]] = r["n"]
    first, chunks, at, filled = np.zeros(leaves, np.int64), np.maximum(1, -(-n // group_rows)), 0, 0
    for i, c in enumerate(n.tolist()):
        if filled and filled + c > group_rows:
            at, filled = at + 1, 0
        first[i] = at
        if chunks[i] > 1:
            at, c = at + int(chunks[i]), 0
        filled += c
    return first, chunks


def best_bins(asked: DataFrame, most: int) -> DataFrame:
    """Of each query row's bins the nearest ``most``."""
    w = Window.partitionBy("id", "v").orderBy("far", "leaf")
    return asked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("place")


def search(spark: SparkSession, vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", every: int = 50, k: int = 5, recall: float = 0.98, sample_rows: int = 20_000, branch: int = 16, leaf_rows: int = 400, grow_rows: int = 20_000, chunk_rows: int = 4_000, calibrate: int = 100, group_rows: int | None = None) -> DataFrame:
    """Neighbours of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""
    schema = "query_id long, rank int, vec_id long, score double"
    rows = _clean(vectors, key, column)
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    size, total = sizes[0]["n"], sizes[0]["c"]
    rows = rows.where(F.size("v") == size)
    kind = dict(rows.dtypes)["v"]
    width = size * (4 if kind == "array<float>" else 8)

    def picked(n: int, of: int, salt: int, df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """About n rows by a hash of id and vector: a bounded sample for the driver, never more than 2n rows."""
        share = min(1.0, n / max(1, of))
        got = df.where(F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.lit(2**30)) < int(share * 2**30)).limit(2 * n).toArrow()
        if not got.num_rows:
            got = df.limit(n).toArrow()
        x = matrix(got.column(1).combine_chunks(), size) if got.num_rows else np.zeros((0, size))
        x = x.astype(np.float64)
        order = np.lexsort((*x.T[::-1], got.column(0).to_numpy()))
        return got.column(0).to_numpy()[order], x[order]

    _, sample = picked(sample_rows, total, 1, rows)
    share = max(1.0, total / max(1, len(sample)))
    tree = Tree(unit(sample), branch, int(leaf_rows / share))
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    asking = queries.count()
    qid, q = picked(calibrate, asking, 2, queries)
    exact = _brute(rows, qid, q, k, size) if len(qid) else {}

    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def index(batches):
        for b in batches:
            if b.num_rows:
                b = b.take(pa.array(telling(b.column(0).to_numpy(), matrix(b.column(1), size), k + 1)))
                x = matrix(b.column(1), size)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(unit(x))), b.column(0), b.column(1)], ["leaf", "id", "v"])

    indexed = cut(spark, rows.mapInArrow(index, f"leaf long, id long, v {kind}"), "index")
    levels: list[Grown] = []
    final = spark.createDataFrame([], "leaf long")  # leaves that cannot be parted
    while True:
        sizes = indexed.groupBy("leaf").agg(F.count("*").alias("n"))
        large = cut(spark, sizes.where(F.col("n") > grow_rows).join(final, "leaf", "left_anti"), "large")
        if large.isEmpty():
            break
        level = Grown(spark, indexed, large, size=size, sample_rows=sample_rows, branch=branch, leaf_rows=leaf_rows, chunk_rows=chunk_rows)
        final = cut(spark, final.union(large.select("leaf").join(level.trees.select("leaf"), "leaf", "left_anti")), "whole")
        if not level.trees.isEmpty():
            levels.append(level)
            below = cut(spark, level.descend(indexed), "index")
            discard(spark, indexed)
            indexed = below
    sizes = cut(spark, indexed.groupBy("leaf").agg(F.count("*").alias("n")), "leaves")
    leaves = sizes.count()

    def bins(asked: DataFrame, most: int) -> DataFrame:
        """(leaf, far, id, v): the leaves that each query visits."""

        def run(batches):
            for b in batches:
                for part in _blocks(b, shared.value.leaves):
                    yield from _asked(*shared.value.bins(unit(matrix(part.column(1), size)), most), part.column(0), part.column(1))

        out = asked.mapInArrow(run, f"leaf long, far double, id long, v {kind}")
        for level in levels:
            out = level.visit(out, most)
        return out

    # widen until the calibration queries' true neighbours lie in the leaves visited
    wanted = sorted(set().union(*exact.values())) if exact else []
    place: dict[int, set[int]] = {}
    for r in indexed.where(F.col("id").isin(wanted)).select("id", "leaf").distinct().collect() if wanted else []:
        place.setdefault(r["id"], set()).add(r["leaf"])
    trial = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(qid, q, strict=True)], f"id long, v {kind}")
    visits = min(2, leaves)
    while visits < leaves:
        met: dict[int, set[int]] = {}
        if levels:
            for r in bins(trial, visits).select("id", "leaf").toLocalIterator():
                met.setdefault(r["id"], set()).add(r["leaf"])
        else:
            for i, got in zip(qid.tolist(), tree.bins(unit(q), visits)[0].tolist() if len(q) else [], strict=True):
                met.setdefault(i, set()).update(got)
        hit = sum(bool(place.get(n, set()) & met.get(i, set())) for i, found in exact.items() for n in found)
        if hit >= recall * max(1, sum(map(len, exact.values()))) and total > k * leaves:
            break
        visits = min(leaves, visits + max(1, visits // 2))

    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group_rows = group_rows or max(leaf_rows, min(GROUP_BYTES // width, -(-total // 32)))
    if levels:
        groups = -(-total // group_rows)
        dealt = sizes.select("leaf", F.pmod(F.xxhash64("leaf"), F.lit(groups)).alias("first"), F.ceil(F.col("n") / group_rows).cast("long").alias("chunks"))
        dealt = F.broadcast(dealt) if leaves <= BROADCAST_LEAVES else dealt
        met_groups = float(visits)
    else:
        # as many leaves as the sample gave; those near in the tree have near numbers
        first, chunks = _dealt(sizes.collect(), tree.leaves, group_rows)
        groups = int((first + chunks).max())
        dealt = F.broadcast(spark.createDataFrame(pa.table({"leaf": np.arange(tree.leaves), "first": first, "chunks": chunks})))
        met_groups = float(np.mean([chunks[x].sum() if (chunks[x] > 1).any() else len(set(first[x].tolist())) for x in tree.bins(unit(q), visits)[0]])) if len(q) else 1.0

    def sent(batches):
        """Queries once for each group that they visit, with their leaves there."""
        for b in batches:
            for part in _blocks(b, tree.leaves):
                leaf = np.sort(shared.value.bins(unit(matrix(part.column(1), size)), visits)[0], 1)
                row, leaf = np.repeat(np.arange(len(leaf)), leaf.shape[1]), leaf.ravel()
                times = chunks[leaf]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                group = first[leaf] + nth
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group) != 0)]))
                step = max(1, GROUP_BYTES // 4 // (width + 8 * visits))
                for lo in range(0, len(begin), step):
                    some = begin[lo : lo + step]
                    end = int(begin[lo + step]) if lo + step < len(begin) else len(row)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(some, end) - some[0], pa.int32()), pa.array(leaf[some[0] : end].astype(np.int64)))
                    take = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays([pa.array(group[some]), part.column(0).take(take), part.column(1).take(take), lists], ["group", "id", "v", "leaves"])

    def answer(batches):
        place, held, cell = None, [], None
        for (at, q), b in _runs(batches, 2):
            if at != place:
                place, held, cell = at, [], None
            if q == 0:
                held.append((b.column(2).to_numpy(), b.column(3).to_numpy(), matrix(b.column(4), size)))
                continue
            if cell is None:
                if not held:
                    continue
                cell, held = Cell(*(np.concatenate(x) for x in zip(*held, strict=True)), k), []
            for lo in range(0, b.num_rows, BLOCK):
                part = b.slice(lo, BLOCK)
                lists = part.column(5)
                got = cell.best(part.column(3).to_numpy(), matrix(part.column(4), size), lists.value_lengths().to_numpy(), lists.flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["query_id", "vec_id", "score"])

    def answered(queries: DataFrame) -> DataFrame:
        if levels:
            asked = bins(queries, visits).join(dealt, "leaf").select("leaf", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "v")
            asked = asked.select(((F.col("first") + F.col("chunk")) % groups).alias("group"), "id", "v", F.array("leaf").alias("leaves"))
        else:
            asked = queries.mapInArrow(sent, f"group long, id long, v {kind}, leaves array<long>")
        asked = asked.select("group", F.lit(1).alias("q"), F.lit(0).cast("long").alias("leaf"), "id", "v", "leaves")
        chunk = F.pmod(F.xxhash64("id", "v"), F.col("chunks"))
        held = indexed.join(dealt, "leaf").select(((F.col("first") + chunk) % groups).alias("group"), F.lit(0).alias("q"), "leaf", "id", "v", F.lit(None).cast("array<long>").alias("leaves"))
        met = held.unionByName(asked).repartitionById(parts, (F.col("group") % parts).cast("int")).sortWithinPartitions("group", "q", "leaf")
        return _top(met.mapInArrow(answer, "query_id long, vec_id long, score double"), k)

    volume = asking * (met_groups * (width + 40) + 2 * visits)
    rounds = int(-(-volume // max(LEAST_SENT, total * (width + 30))))
    if rounds < 2:
        return answered(queries)
    out = [cut(spark, answered(queries.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(rounds)) == r)), "answers") for r in range(rounds)]
    discard(spark, indexed)
    return functools.reduce(DataFrame.unionByName, out)
