"""Near-duplicate documents: chosen-path set similarity join over word shingles.

Documents become sets of hashed word shingles. Equal sets form one class, whose
smallest id stands for it. Representatives are branched recursively: a node of
a tree picks one or two of ``COORDS`` minwise coordinates (1/similarity on
average, chosen by a hash of the node), and a document goes to the child named
by its minwise token there. Two sets of Jaccard similarity s share a child with
probability s per coordinate, so similar pairs survive and others part. Nodes
of at most ``node_limit`` documents are compared exhaustively; larger ones
branch again. Independent trees are repeated until the recall of a pair at the
threshold reaches ``recall``.

A node still too large at ``max_depth`` (a dense group) is compared block by
block: its documents are dealt to blocks of half the limit and each pair of
blocks is a node of its own, so no task holds more than the limit and no pair
is lost.

Comparison has two steps. Minwise signatures drop documents that are far from
all others of their node (estimated similarity five standard errors below the
threshold); what is left is compared on full shingle sets, whole texts shipped
once for each distinct list of candidates. Each list yields a spanning star of
every group it holds rather than all its pairs; connected components join them.

Defined cases: null or word-less texts have an empty set and link with nothing;
with fewer words than a shingle, the whole sequence is the one shingle; rows
without an id are left out; repeated rows are in one class; extra columns are
ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHash, cut, discard, forget, give_back, mix64, words_of
from .graph import components

COORDS = 128
_rng = np.random.default_rng(20)
MULT = _rng.integers(1, 2**63, COORDS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
WEIGHTS = _rng.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def shingle_set(text: bytes | None, hashes: WordHash, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    h = hashes.of(words_of(text))
    n = len(h)
    if n == 0:
        return h
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b"short" + h.tobytes())], U64)
    s = np.zeros(n - size + 1, U64)
    for k in range(size):
        s += mix64(h[k : n - size + 1 + k] + WEIGHTS[k % 64]) * WEIGHTS[(k + 1) % 64]
    return np.unique(mix64(s))


def minwise(s: np.ndarray) -> np.ndarray:
    """The COORDS minwise tokens of a set, 32 bits each; zeros for the empty set."""
    out = np.full(COORDS, 2**32 - 1, U64)
    if not len(s):
        return np.zeros(COORDS, np.uint32)
    for lo in range(0, len(s), 8192):
        np.minimum(out, ((s[None, lo : lo + 8192] * MULT[:, None]) >> U64(32)).min(1), out=out)
    return out.astype(np.uint32)


def children(nodes: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of each (node, minwise row): index of the row and child id. One coordinate always, a second with probability 1/similarity - 1."""
    h = mix64(nodes)
    first = (h % U64(COORDS)).astype(np.int64)
    step = 1 + ((h >> U64(16)) % U64(COORDS - 1)).astype(np.int64)
    two = (h >> U64(40)).astype(float) / 2**24 < 1 / similarity - 1
    rows = np.arange(len(nodes))
    who = np.concatenate([rows, rows[two]])
    at = np.concatenate([first, (first + step)[two] % COORDS])
    child = mix64(nodes[who] ^ mix64(tokens[who, at].astype(U64) + (at.astype(U64) << U64(32)) + U64(1)))
    return who, child


def trees_for(similarity: float, recall: float, depth: int = 2) -> int:
    """Trees needed so that a pair at the threshold meets in some node at ``depth``: independent trees, survival of a branching process in each."""
    b = 1 / similarity
    meet = 0.0
    for _ in range(depth):
        # one child for sure, a second with probability b - 1; each is shared with probability `similarity`
        below = 1 - similarity * (1 - meet) if _ else 1 - similarity
        meet = (2 - b) * below + (b - 1) * below**2
    return max(1, math.ceil(math.log(1 - recall) / math.log(meet)))


def _sketches(docs: DataFrame, text: str, key: str, size: int, trees: int, similarity: float) -> DataFrame:
    roots = mix64(np.arange(1, trees + 1, dtype=U64))

    def run(batches):
        forget()
        hashes = WordHash(200_000)
        for batch in (b.slice(lo, 1_000) for b in batches for lo in range(0, b.num_rows, 1_000)):
            ids, out = batch.column(0), {"n": [], "fp": [], "mh": [], "nodes": []}
            for t in batch.column(1):
                s = shingle_set(t.as_py(), hashes, size)
                mh = minwise(s)
                out["n"].append(len(s))
                out["fp"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["mh"].append(mh.tobytes())
                out["nodes"].append(children(roots, np.repeat(mh[None], trees, 0), similarity)[1].view(np.int64).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n"], pa.int64()), pa.array(out["fp"], pa.binary()), pa.array(out["mh"], pa.binary()), pa.array(out["nodes"], pa.list_(pa.int64()))], ["id", "n", "fp", "mh", "nodes"])
        del hashes
        give_back()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).where("id IS NOT NULL")
    return rows.mapInArrow(run, "id long, n long, fp binary, mh binary, nodes array<long>")


def _branch(rows: DataFrame, similarity: float) -> DataFrame:
    """(node, id, mh) -> (node, id) of the children."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                mh = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, COORDS)
                who, child = children(b.column(0).to_numpy().view(U64), mh, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column(1).take(pa.array(who))], ["node", "id"])

    return rows.select("node", "id", "mh").mapInArrow(run, "node long, id long")


def runs(batches, columns: int):
    """Whole runs of equal first column out of batches sorted by it: (key, list of columns)."""
    key, held = None, [[] for _ in range(columns)]
    for part in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
        for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if row[0] != key:
                if held[0]:
                    yield key, held
                key, held = row[0], [[] for _ in range(columns)]
            for h, v in zip(held, row[1:], strict=True):
                h.append(v)
    if held[0]:
        yield key, held


def _likely(near: float):
    """Split each node into lists of documents whose signatures are connected; documents alone go."""

    def run(batches):
        ids_out, list_out = [], []
        for _, (ids, mhs) in runs(batches, 2):
            m = np.frombuffer(b"".join(mhs), np.uint32).reshape(-1, COORDS)
            ids = np.array(ids)
            left = np.ones(len(ids), bool)
            for i in range(len(ids)):
                if not left[i]:
                    continue
                left[i] = False
                group, queue = [i], [i]
                while queue and left.any():
                    rest = np.flatnonzero(left)
                    hit = rest[(m[rest] == m[queue.pop()]).sum(1) >= near * COORDS]
                    left[hit] = False
                    group += hit.tolist()
                    queue += hit.tolist()
                if len(group) > 1:
                    found = np.sort(ids[group])
                    ids_out += found.tolist()
                    list_out += [xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63] * len(found)
            if len(ids_out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list_out, pa.int64()), pa.array(ids_out, pa.int64())], ["list", "id"])
                ids_out, list_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(list_out, pa.int64()), pa.array(ids_out, pa.int64())], ["list", "id"])

    return run


def stars(sets: list[np.ndarray], need: int, of: int) -> list[tuple[int, int]]:
    """Exact groups of sets linked where of * intersection >= need * union, as (first member, other member)."""
    m = len(sets)
    if m == 2:
        a, b = sets
        both = len(a) + len(b) - len(np.union1d(a, b))
        return [(0, 1)] if both and of * both >= need * (len(a) + len(b) - both) else []
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(m), size)
    _, tok = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(tok, kind="stable")
    left, built, out = np.ones(m, bool), -1, []

    def build():
        live = order[left[doc[order]]]
        return doc[live], np.concatenate([[0], np.cumsum(np.bincount(tok[live], minlength=tok.max() + 1 if len(tok) else 1))])

    for root in range(m):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            alive = int(left.sum())
            if not alive:
                return out
            if built < 0 or alive * 2 < built:
                (post, ptr), built = build(), alive
            x = queue.pop()
            t = tok[begin[x] : begin[x + 1]]
            n = ptr[t + 1] - ptr[t]
            if not n.sum():
                continue
            at = np.repeat(ptr[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(post[at], minlength=m)
            hit = np.flatnonzero(left & (both > 0) & (of * both >= need * (size[x] + size - both)))
            left[hit] = False
            out += [(root, int(y)) for y in hit]
            queue += hit.tolist()
    return out


def _confirm(size: int, need: int, of: int):
    def run(batches):
        forget()
        hashes = WordHash(200_000)
        u, v = [], []
        for _, (ids, texts) in runs(batches, 2):
            for a, b in stars([shingle_set(t, hashes, size) for t in texts], need, of):
                u.append(ids[a])
                v.append(ids[b])
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        del hashes
        give_back()

    return run


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    shingle: int = 5,
    percent: int = 80,
    recall: float = 0.9999,
    node_limit: int = 1000,
    max_depth: int = 3,
) -> DataFrame:
    """One row a document: key, n_shingles, component_id (smallest id reachable over links of ``percent`` Jaccard similarity), kept."""
    similarity = percent / 100
    near = similarity - 5 * math.sqrt(similarity * (1 - similarity) / COORDS)
    sketch = cut(spark, _sketches(docs, text, key, shingle, trees_for(similarity, recall, max_depth), similarity), "sketch")
    classes = cut(spark, sketch.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "classes")
    alone = sketch.where("n > 0").join(classes.select("id"), "id", "left_semi")

    frontier = alone.select(F.explode("nodes").alias("node"), "id")
    leaves, levels = [], []
    for depth in range(1, max_depth + 1):
        # counts are written before they are joined back, so that the join can split a hot node
        sized = cut(spark, frontier.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "sized")
        level = cut(spark, frontier.join(sized, "node"), "level")
        levels += [level, sized]
        leaves.append(level.where(F.col("c") <= node_limit).select("node", "id"))
        large = level.where(F.col("c") > node_limit)
        if large.isEmpty():
            break
        if depth == max_depth:
            blocks = F.ceil(F.col("c") / (node_limit // 2)).cast("int")
            dealt = large.withColumn("b", F.pmod(F.xxhash64("id"), blocks)).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
            leaves.append(dealt.select(F.xxhash64("node", F.least("b", "o"), F.greatest("b", "o")).alias("node"), "id"))
            break
        frontier = _branch(large.join(sketch.select("id", "mh"), "id"), similarity)
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.union(more)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    gathered = nodes.join(alone.select("id", "mh"), "id").select("node", "id", "mh").repartition(parts, "node").sortWithinPartitions("node")
    lists = cut(spark, gathered.mapInArrow(_likely(near), "list long, id long").distinct(), "lists")
    discard(spark, *levels)

    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).join(lists.select("id").distinct().hint("merge"), "id", "left_semi")
    shipped = lists.hint("merge").join(body, "id").select("list", "id", "t").repartition(parts, "list").sortWithinPartitions("list")
    edges = shipped.mapInArrow(_confirm(shingle, percent, 100), "u long, v long")
    found = components(spark, edges)
    discard(spark, lists)

    rep = classes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    out = sketch.select("id", "n", "fp").join(rep, "fp", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one whose id is the group's smallest. Of rows that share that id, the one of the smallest hash stays. Rows without an id stay."""
    own = f"id_{uuid.uuid4().hex}"  # a name that no column of theirs has
    found = cut(spark, near_duplicates(spark, docs, key=key, **options).select(F.col(key).alias(own), "kept"), "found")
    gone = found.where("NOT kept").select(own).distinct()
    left = docs.join(gone.hint("merge"), F.col(key).cast("long") == F.col(own), "left_anti")
    twice = cut(spark, found.groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own), "twice")
    if twice.isEmpty():
        return left
    # rows of ids that occur once pass by; of the others one is picked after a pre-aggregation
    same = F.col(key).cast("long") == F.col(own)
    whole = left.join(twice, same, "left_semi").select(F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("h"), F.struct("*").alias("row"), F.col(key).cast("long").alias(own))
    one = whole.groupBy(own).agg(F.min_by("row", "h").alias("row")).select("row.*")
    return left.join(twice, same, "left_anti").union(one)
