"""Nearest neighbours, mixing, token shards, substring dedup, token counts, the pipeline."""

import gc
import hashlib
import io
import math
import random
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barsift.cluster import ship
from barsift.llm import kmeans_tree, language_id, mixing, sstable, suffix_dedup, token_counts
from barsift.llm.common import shared_path, tokenizer_path
from tests.llm import corpus


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return corpus.documents(spark).cache()


# -- nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, leaf int, id string")


def brute_neighbours(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    n = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, v) for i, v in good if len(v) == n]
    out = {}
    for i, v in good:
        if i % every == 0:
            s = sorted((-round(float(v @ w / math.sqrt(v @ v) / math.sqrt(w @ w)), 12), j) for j, w in good if j != i)
            out[i] = s[:k]
    return out


def test_neighbours(spark, docs):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(400)]  # one very common vector
    rows += [(3000, None), (3050, []), (3100, [0.0] * 8), (3150, [float("nan")] * 8), (3200, [None] * 8), (3250, [1.0] * 3), (None, [1.0] * 8), (3300, [float("inf")] * 8)]
    want = brute_neighbours(rows, 50, 5)
    got = defaultdict(list)
    for r in kmeans_tree.search(spark, vectors(spark, rows), leaf_rows=40, chunk_rows=100, sample_rows=800).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert [(-round(s, 9), v) for _, v, s in found] == sorted((-round(s, 9), v) for _, v, s in found)
        edge = -want[q][-1][0]
        hit += sum(s >= edge - 1e-9 for _, _, s in found)
    assert hit >= 0.9 * 5 * len(want)


def brute_by_id(rows, every, k):
    """Ids by the best score of any of their vectors."""
    best = defaultdict(lambda: -2.0)
    for i, v in rows:
        for j, w in rows:
            if i % every == 0 and i != j:
                a, b = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                best[i, j] = max(best[i, j], round(float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)), 9))
    out = defaultdict(list)
    for (i, j), s in sorted(best.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if len(out[i]) < k:
            out[i].append((len(out[i]) + 1, j, s))
    return dict(out)


def test_neighbours_of_repeated_ids(spark, docs):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 200)]
    same, other = [1.0, 2.0, 0.0, 0.0, 1.0, 0.5], rng.normal(size=6).tolist()
    rows += [(50, same)] * 8 + [(60, same), (61, same)]  # copies of a query
    rows += [(100, other), (100, same), (7, [x + 0.1 for x in other]), (7, other[::-1]), (7, other[::-1])]  # several vectors under one id
    rows = [r for r in rows if r[0] not in (50, 100) or r[1] in (same, other)]
    got = defaultdict(list)
    for r in kmeans_tree.search(spark, vectors(spark, rows), recall=1.0, leaf_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    assert dict(got) == brute_by_id(rows, 50, 5)
    assert [v for _, v, _ in got[50]][:3] == [60, 61, 100]


def test_leaves_grow_with_the_table(spark, docs):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=8)).tolist()) for i in range(4000)]
    rows += [(5000 + i, rows[3][1]) for i in range(600)]
    want = brute_neighbours(rows, 100, 5)
    seen = []
    grown = kmeans_tree.Grown.__init__

    def watch(self, *args, **options):
        grown(self, *args, **options)
        seen.append(self.trees.count())

    kmeans_tree.Grown.__init__ = watch
    try:
        out = kmeans_tree.search(spark, vectors(spark, rows), every=100, sample_rows=12, branch=3, leaf_rows=60, grow_rows=150, chunk_rows=100).collect()
    finally:
        kmeans_tree.Grown.__init__ = grown
    assert len(seen) >= 2 and seen[0] > 1  # several levels, fitted apart
    got = defaultdict(set)
    for r in out:
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len(got[q] & {j for _, j in found}) for q, found in want.items())
    assert hit >= 0.9 * 5 * len(want)


def test_few_vectors(spark, docs):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [1.0, 0.1])]
    got = [(r.query_id, r["rank"], r.vec_id) for r in kmeans_tree.search(spark, vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert kmeans_tree.search(spark, vectors(spark, rows).limit(0)).count() == 0
    assert kmeans_tree.search(spark, vectors(spark, [(3, [1.0]), (4, [2.0])])).count() == 0
    same = [(i, [1.0, 2.0]) for i in range(60)]
    got = kmeans_tree.search(spark, vectors(spark, same), leaf_rows=5).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]


def test_batches_stay_bounded_where_queries_visit_most_leaves(spark, docs, monkeypatch, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 32)))]  # no near neighbours
    frame = vectors(spark, rows)
    plain = type(frame).mapInArrow

    def watched(self, run, schema, *args, **options):
        def watch(batches):
            for b in run(batches):
                (tmp_path / f"{b.nbytes}").touch()
                yield b

        return plain(self, watch, schema, *args, **options)

    monkeypatch.setattr(type(frame), "mapInArrow", watched)
    got = defaultdict(set)
    for r in kmeans_tree.search(spark, frame, every=1, leaf_rows=10).collect():
        got[r.query_id].add(r.vec_id)
    x = kmeans_tree.unit(np.array([v for _, v in rows], np.float32))
    near = x @ x.T - 9 * np.eye(len(x))
    want = np.argsort(-near, 1)[:, :5]
    assert sum(len(got[i] & set(w.tolist())) for i, w in enumerate(want)) >= 0.9 * want.size
    assert max(int(p.name) for p in tmp_path.iterdir()) < 16e6


@pytest.mark.parametrize("grow_rows", [20_000, 60])
def test_neighbours_by_groups_and_rounds(spark, docs, monkeypatch, grow_rows):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(400 + i, rows[9][1]) for i in range(60)]  # a leaf of several groups
    rows += [(i, rng.normal(size=6).tolist()) for i in (7, 7, 8, 8, 50, 100)]  # several vectors under one id
    monkeypatch.setattr(kmeans_tree, "LEAST_SENT", 1)
    got = defaultdict(list)
    options = {"every": 10, "recall": 1.0, "sample_rows": 40, "branch": 3, "leaf_rows": 20, "grow_rows": grow_rows, "group_rows": 25}
    for r in kmeans_tree.search(spark, vectors(spark, rows), **options).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    want = brute_by_id(rows, 10, 5)
    assert set(got) == set(want)
    same = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert same >= 0.97 * 5 * len(want) and all([x[0] for x in got[i]] == [1, 2, 3, 4, 5] for i in got)


def test_cell_equals_brute_force(monkeypatch):
    monkeypatch.setattr(kmeans_tree, "TILE", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 5)) * 10.0 ** rng.integers(-6, 6, size=(200, 1))
    x[150:] = x[:50] * 3  # equal cosines, all but rounding
    ids, leaf = rng.integers(0, 150, 200), rng.integers(0, 4, 200)
    qid, lists = np.arange(40), [np.flatnonzero(rng.random(4) < 0.6) for _ in range(40)]
    q = rng.normal(size=(40, 5))
    cell = kmeans_tree.Cell(leaf, ids, x, 5)
    got = defaultdict(list)
    for a, i, s in zip(*cell.best(qid, q, np.array([len(z) for z in lists]), np.concatenate(lists)), strict=True):
        got[int(a)].append((int(i), round(float(s), 9)))
    for i in range(40):
        best = {}
        for j in np.flatnonzero(np.isin(leaf, lists[i])):
            if ids[j] != i:
                best[ids[j]] = max(best.get(ids[j], -2), round(float(x[j] @ q[i] / math.sqrt(x[j] @ x[j]) / math.sqrt(q[i] @ q[i])), 9))
        assert [s for _, s in got[i]] == sorted(best.values(), reverse=True)[:5]
        assert all(best[j] == s for j, s in got[i])


def test_visits_are_best_first():
    rng = np.random.default_rng(3)
    x = kmeans_tree.unit(rng.normal(size=(600, 6)))
    tree = kmeans_tree.Tree(x, 4, 30)
    assert sorted(tree.visit(x[0], tree.leaves)[0]) == list(range(tree.leaves))
    assert all(tree.visit(v, 1)[0][0] == a for v, a in zip(x[:50], tree.assign(x[:50]), strict=True))


# -- mixing


def test_mixing_budgets(spark, docs):
    got = [r.asDict() for r in mixing.mix(spark, docs, max_repeat=1.25).select("row.doc_id", "source", "n_tokens", "weight", "pass", "position").collect()]
    have = Counter()
    sizes = defaultdict(int)
    for i, t, _, s in corpus.rows():
        n = len((t or "").encode().split())
        have[s or ""] += n
        sizes[s or "", n] += 1
        del i
    total = sum(have.values())
    weight = {r["source"]: r["weight"] for r in got}
    used = Counter()
    for r in got:
        used[r["source"]] += r["n_tokens"]
    assert sum(weight.values()) == pytest.approx(1)
    for s, w in weight.items():
        budget = round(w * total)
        assert used[s] <= budget and budget / have[s] <= 1.25 + 1e-6
        assert budget - used[s] <= max(n for x, n in sizes if x == s)
    times = Counter((r["doc_id"], r["pass"]) for r in got)
    assert max(times.values()) == 1 and all(0 <= r["position"] <= 1 for r in got)


def test_mixing_targets(spark, docs):
    totals = spark.createDataFrame([("a", 700.0, 1000.0), ("b", 200.0, 1000.0), ("c", 100.0, 1000.0)], "source string, tokens double, all_tokens double")

    def shares(a):
        x = np.array([0.7, 0.2, 0.1]) ** a
        return x / x.sum()

    for goal in (0.4, 0.9, 1.05):
        w = shares(mixing.exponent(totals, target_entropy=goal))
        assert -(w * np.log(w)).sum() == pytest.approx(goal, abs=1e-6)
    a = mixing.exponent(totals, max_repeat=2.0)
    assert (shares(a) / [0.7, 0.2, 0.1]).max() == pytest.approx(2.0, abs=1e-6)
    assert mixing.exponent(totals, max_repeat=10.0) == 0.0


def test_mixing_keeps_columns_and_survives_nothing(spark, docs):
    out = mixing.mix(spark, docs).select("row.*")
    assert out.schema == docs.schema
    assert mixing.mix(spark, corpus.empty(spark)).count() == 0
    assert mixing.mix(spark, docs.where("doc_id IN (120, 121)")).count() == 0
    plan = mixing.mix(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- token shards


def test_shards_round_trip(spark, docs):
    extra = [(140, "a <|endoftext|> b", "en", "s"), (141, "same id", "en", "s"), (141, "same id twice", "en", "s")]
    df = corpus.documents(spark, extra=extra)
    folder = shared_path(spark, "test-sst")
    manifest = sstable.write_shards(spark, df, folder, shard_rows=10)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sstable.read_shards(manifest).collect())
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, ids in sorted((i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in [*corpus.rows(), *extra]):
        ids = np.array([*ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want and manifest.count() > 3
    for r in manifest.collect():
        with open(r["path"].removeprefix("file://"), "rb") as f:
            reader = sstable.Reader(f)
            keys = [k for k, _ in reader]
            assert keys == sorted(keys) and (keys[0], keys[-1]) == (r["first_key"], r["last_key"])
            assert all(reader.get(k) is not None for k in keys) and reader.get(keys[-1] + 1) is None
    assert sstable.token_output(spark, corpus.empty(spark)).count() == 0


def test_shard_format():
    out = io.BytesIO()
    w = sstable.Writer(out, 2)
    keys = [-(2**63), -7, 0, *range(100, 5000, 3), 2**63 - 1]
    for k in keys:
        w.add(sstable.key_bytes(k), np.arange(abs(k) % 50, dtype="<u2").tobytes())
    w.close()
    r = sstable.Reader(out)
    assert len(r.index) > 1 and r.count == len(keys)
    assert all((r.get(k) == np.arange(abs(k) % 50)).all() for k in keys)
    assert not [k for k in range(101, 5000, 3) if r.get(k) is not None]
    damaged = bytearray(out.getvalue())
    damaged[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        list(sstable.Reader(io.BytesIO(bytes(damaged))))
    with pytest.raises(ValueError, match="format"):
        sstable.Reader(io.BytesIO(bytes(100)))


def test_workers_keep_one_operators_tables():
    pieces = [bytes([b]) for b in range(256)]
    model = {"name": "one", "langs": ["x"], "prior": np.zeros(1), "p": np.append(np.full(256, 1 / 256), 0)[:, None], "pieces": pieces}
    scorer = weakref.ref(language_id.scorer_for(model))
    encoder = sstable.encoder_for(tokenizer_path("byte_bpe_50k.json"), 2)
    gc.collect()
    assert scorer() is None and sstable.encoder_for(tokenizer_path("byte_bpe_50k.json"), 2) is encoder


def test_shards_start_no_other_python_workers(spark, docs, monkeypatch):
    def no_rows_from_python(*a, **b):
        raise AssertionError("rows of the driver's Python go through Python workers of their own")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", no_rows_from_python)
    assert sstable.token_output(spark, docs.limit(50), shard_rows=20).count() == 50


def test_encoder_equals_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    library, ours = Tokenizer.from_file(path), sstable.Encoder(path, 4)
    rng = random.Random(3)
    alphabet = [*"ab1 \n\t\r.,!_'s", "\x0b", "\x1c", "\x85", "　", " ", "​", "é", "½", "²", "  ", "<|endoftext|>", "'ll", "the", " of"]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert np.frombuffer(ours.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# -- substring dedup


def brute_windows(texts, length):
    """The definition: a byte goes if some window over it was seen before."""
    seen, out = set(), []
    for i, t in sorted(texts):
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"hot_kinds": 0, "shards": 3}])
def test_substrings(spark, docs, options):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abc ") for _ in range(rng.randrange(99, 400))) for _ in range(4)]
    extra = []
    for j in range(40):
        body = "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(0, 300)))
        p = rng.choice(passages)
        cut = rng.randrange(0, 40)
        extra.append((400 + j, body + p[cut:] + body[: rng.randrange(50)] + (p if j % 3 else p[:150]), "en", "s"))
    extra += [(500, "ab" * 400, "en", "s"), (501, "x" + "ab" * 300, "en", "s"), (502, "z" * 99, "en", "s"), (503, "z" * 99, "en", "s"), (504, "z" * 250, "en", "s"), (505, extra[3][1], "en", "s"), (505, extra[3][1], "en", "s")]
    df = corpus.documents(spark, extra=extra)
    got = suffix_dedup.dedup(spark, df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    assert sorted(map(tuple, got.collect())) == brute_windows([(i, (t or "").encode()) for i, t, *_ in [*corpus.rows(), *extra]], 100)


def test_substrings_of_nothing(spark, docs):
    assert suffix_dedup.dedup(spark, corpus.empty(spark)).count() == 0
    with pytest.raises(ValueError, match="over"):
        suffix_dedup.dedup(spark, docs, length=50)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(8)
    for text in (rng.integers(97, 99, 700), np.full(300, 97), np.tile([97, 98, 99], 120), rng.integers(0, 255, 500), np.array([5])):
        t = text.astype(np.uint8)
        sa, words = suffix_dedup.suffix_array(t, 1000)
        raw = t.tobytes()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
        lcp = suffix_dedup.common_prefixes(sa, words, 64, lanes=7)
        for k in range(1, len(sa)):
            a, b = raw[sa[k] :], raw[sa[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(n, 64)


def test_runs_cover_all_windows():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 105) for _ in range(2000))
    whole = suffix_dedup.Runs(text, 100)
    assert whole.lo[0] == 0 and whole.hi[-1] == 1900 and (whole.lo[1:] == whole.hi[:-1] + 1).all()


def test_alike_tells_pairs_apart():
    rng = np.random.default_rng(3)
    for n, high in ((0, 1), (1, 1), (400, 6), (400, 1000)):
        key, tag = (rng.integers(0, high, n).astype(np.uint64) for _ in range(2))
        pairs = list(zip(key.tolist(), tag.tolist(), strict=True))
        first, number = suffix_dedup.alike(key, tag)
        assert [pairs[i] for i in first] == sorted(set(pairs)) and [pairs.index(p) for p in sorted(set(pairs))] == first.tolist()
        assert [sorted(set(pairs))[i] for i in number] == pairs


def test_tags_follow_contents():
    """Runs of equal bytes have equal tags wherever they stand, others differ; so a chance match of the first hash alone removes nothing."""
    rng = random.Random(2)
    shared = bytes(rng.randrange(97, 123) for _ in range(900))
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) + shared + bytes(rng.randrange(97, 123) for _ in range(50)) for n in (0, 7, 333)]
    tags = {}
    for t in texts:
        r = suffix_dedup.Runs(t, 100)
        for lo, hi, tag in zip(r.lo.tolist(), r.hi.tolist(), r.tag.tolist(), strict=True):
            assert tags.setdefault(t[lo : hi + 100], tag) == tag
    assert len(set(tags.values())) == len(tags) and len(tags) < sum(len(suffix_dedup.Runs(t, 100).lo) for t in texts)
    z = zstandard.ZstdCompressor()
    part = suffix_dedup.Part([(i, z.compress(t)) for i, t in enumerate(texts)], 100)
    assert len(part.keys) == len(tags) == len(part.tags)


# -- token counts


def test_ledger(spark, docs):
    ledger = token_counts.Ledger(spark, shared_path(spark, "ledger"))
    schema = "source string, lang string, version string, old long, n long, extra string"
    rows = [("a", "en", "v1", 1, 10, "x"), ("a", "en", "v1", 2, None, "x"), ("b", None, "v1", 3, 7, "x"), (None, "fr", "v2", 4, 5, "x")]
    df = spark.createDataFrame(rows, schema)

    def totals():
        return {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in ledger.totals().collect()}

    assert totals() == {}
    assert ledger.apply("b1", token_counts.inserts(df)) and not ledger.apply("b1", token_counts.inserts(df))
    first = {("a", "en", "v1"): (2, 10), ("b", None, "v1"): (1, 7), (None, "fr", "v2"): (1, 5)}
    assert totals() == first
    assert ledger.apply("b2", token_counts.revisions(df))
    assert totals() == {("a", "en", "v1"): (2, 17), ("b", None, "v1"): (1, 11), (None, "fr", "v2"): (1, 6)}
    assert ledger.apply("empty", token_counts.inserts(df.limit(0)))
    ledger.compact()
    before = totals()
    assert ledger.batches() == ["b1", "b2", "empty"] and not ledger.apply("b2", token_counts.inserts(df))
    assert ledger.apply("b3", token_counts.deletes(df.where("source = 'b'")))
    assert totals() == {k: (v if k[0] != "b" else (0, 4)) for k, v in before.items()}
    ledger.compact()
    assert totals()[("a", "en", "v1")] == before[("a", "en", "v1")] and ledger.batches() == ["b1", "b2", "b3", "empty"]
    with pytest.raises(ValueError, match="batch id"):
        ledger.apply("../x", token_counts.inserts(df))


def test_ledger_of_two_writers(spark):
    folder = shared_path(spark, "ledger")
    df = spark.createDataFrame([("a", "en", "v1", 10)], "source string, lang string, version string, n long")
    one, two = token_counts.Ledger(spark, folder), token_counts.Ledger(spark, folder)
    two.batches = list  # has looked before the other committed
    assert one.apply("b1", token_counts.inserts(df)) and not two.apply("b1", token_counts.inserts(df))
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v1", 1, 10)]
    two._snapshot = lambda: (0, None)
    assert one.compact() and not two.compact()
    assert not two.apply("b1", token_counts.inserts(df))
    assert [tuple(r) for r in one.totals().collect()] == [("a", "en", "v1", 1, 10)]


def test_token_counts_query_equals_brute_force(spark, docs, tmp_path):
    from barsift.llm import queries

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {0, 5, 100, 120, 130}
    spark.createDataFrame([*[(i, 1) for i in toxic], (0, 1), (None, 1), (7, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want: dict = {}
    for r in docs.collect():
        if r.doc_id in toxic:
            continue
        for version, n in (("byte_bpe_50k", len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)), ("bytes", len((r.text or "").encode()))):
            d, t = want.get((r.source, r.lang, version), (0, 0))
            want[r.source, r.lang, version] = (d + 1, t + n)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in queries.op10_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


# -- the pipeline


def test_pipeline_on_small_tables(spark, docs, tmp_path):
    import corpus_pipeline

    extra = [(700 + i, "unseen words " * 20 + " ".join(f"item{j}" for j in range(30)) + " and after", "en", "s1") for i in range(2)]
    df = corpus.documents(spark, extra=extra).select("doc_id", "text", "lang", "source", "n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{j}" for j in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    rows = {r.doc_id for r in df.select("doc_id").collect()}
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, got, str(tmp_path))
        assert k == 4 or got.columns == df.columns
        got.write.parquet(f"{tmp_path}/{k}")
        got = spark.read.parquet(f"{tmp_path}/{k}")
        left.append({r.doc_id for r in got.select("doc_id").collect()})
    assert rows - left[0] >= {120, 121, 122, 123} and set(range(60)) <= left[0]
    assert len(left[1] & {100, 101, 102, 103, 104, 105, 110, 111, 112}) == 1 and 701 not in left[1]
    assert left[1] - left[2] == {700}
    assert left[4] == left[3] <= left[2]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, got.select(*whole.columns).collect()))
