"""Near duplicates and components against comparing all pairs."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import embedding_dedup as ed
from emberline.llm import simhash as sh
from emberline.llm.common import Workspace, components, table


def joined(n, pairs):
    """Smallest member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("shape", ["path", "random", "star", "loops", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 60
    pairs = {
        "path": [(k, k + 1) for k in range(n - 1)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(40)],
        "star": [(0, k) for k in range(1, n)],
        "loops": [(k, k) for k in range(5)],
        "none": [],
    }[shape]
    edges = spark.createDataFrame([(b, a) for a, b in pairs], "a long, b long")
    got = {r.id: r.component for r in components(edges, Workspace(spark, "t")).collect()}
    want = joined(n, pairs)
    assert got == {k: want[k] for k in {x for p in pairs for x in p}}


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=6))
def test_covering_masks_miss_no_pair(x, flips):
    for radius in (2, 6):
        if len(set(flips)) <= radius:
            y = x
            for k in set(flips):
                y ^= 1 << k
            masks = [m & (2**64 - 1) for m in sh.covering_masks(radius)]
            assert len(masks) == 2 ** (radius + 1) - 1
            assert any(x & m == y & m for m in masks)


def test_bucket_links_join_all_pairs():
    rng = np.random.default_rng(2)
    for size in (2, 5, 16, 17, 80):
        base = rng.integers(0, 2**63, 3, dtype=np.uint64)
        fps = np.array([base[k % 3] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for k in range(size)])
        fps = np.unique(fps)
        size = len(fps)
        keys = np.zeros(size, np.int64)
        a, b = sh.bucket_links(keys, fps, 2)
        at = {int(f): k for k, f in enumerate(fps)}
        a, b = (np.array([at[int(x)] for x in c], int) for c in (a, b))
        near = [(i, j) for i in range(size) for j in range(i + 1, size) if bin(int(fps[i] ^ fps[j])).count("1") <= 2]
        assert joined(size, zip(a.tolist(), b.tolist(), strict=True)) == joined(size, near)
        assert len(a) <= max(size, sh.SMALL * sh.SMALL)


def test_fingerprint_of_the_contract():
    import xxhash

    def slow(text):
        words = [w for w in text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").split(" ") if w]
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))

    for text in ("", " \n", "One", "one Two", "ÀÉ x y z\n a b\tc a b c", "w " * 50):
        assert sh.fingerprint(text) == slow(text)


def test_simhash_query_against_all_pairs(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    fps = [sh.fingerprint(t) for _, t in docs]
    near = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, joined(len(fps), near), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op6_simhash(spark, sf_dir).collect()}
    assert got == want


def test_simhash_of_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 1), (None, "only here", 1), (7, "a b c d", 1), (7, "a b c d", 1), (9, "long " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int")
    got = sorted((r.id is None, r.id, r.component) for r in sh.simhash_components(df).collect())
    assert got == [(False, 1, 1), (False, 3, 1), (False, 7, 7), (False, 7, 7), (False, 9, 9), (True, None, None)]
    assert sh.simhash_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 3, 20, 100_000])
def test_hot_keys_join_what_all_pairs_join(spark, most):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63, 3)
    fps = []
    for k in range(400):
        fp = int(base[k % 3]) & (2**64 - 1)
        for _ in range(int(rng.integers(0, 5))):
            fp ^= 1 << int(rng.integers(64))
        fps.append(fp)
    fps = sorted(set(fps))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    points = spark.createDataFrame([(f,) for f in signed], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edges = sh.covering_links(points, 2, Workspace(spark, "t"), most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = {f: k for k, f in enumerate(signed)}
    assert joined(len(fps), [(at[r.a], at[r.b]) for r in edges]) == joined(len(fps), near)


def test_representatives(spark):
    rows = [(5, "a b c d e", "k5"), (3, "a b c d e", "k3"), (3, "a b c d e", "k2"), (None, "a b c d e", "k0"), (None, "alone", "k9"), (None, "alone", "k8"), (8, None, "k7"), (9, "", "k6"), (9, "", "k6")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, name string, fp int")
    assert sorted(r.name for r in sh.representatives(docs, "name").collect()) == ["k2", "k7", "k8"]
    assert sh.representatives(docs.limit(0), "name").count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id int")


def brute(rows, threshold=0.95):
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = joined(len(rows), list(zip(*map(list, np.nonzero(np.triu(near))), strict=True)))
    return {r[0]: (int(n), rows[c][0]) for r, n, c in zip(rows, near.sum(1), root, strict=True)}


def planted(n=300, d=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for k in range(n // 2, n):
        x[k] = x[k % 7] / np.linalg.norm(x[k % 7]) + rng.normal(size=d) * rng.choice([0.01, 0.04, 0.06, 0.075])
        x[k] *= rng.uniform(0.1, 10)
    return [(k, x[k].astype(np.float32).tolist(), 0) for k in range(n)]


@pytest.mark.parametrize("tile", [32, 100, 8192])
def test_embedding_links_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(ed, "SIDE", 24)
    rows = planted()
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_vectors(vectors(spark, rows), tile=tile).collect()}
    assert got == brute(rows)


def test_int8_bounds_hold():
    rng = np.random.default_rng(0)
    for scale in (1.0, 30.0):
        x = rng.normal(size=(200, 48)) ** (3 if scale > 1 else 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        codes, s, e, m = ed.quantise(x)
        coded = codes * s[:, None]
        assert codes.dtype == np.int8
        assert (np.abs(x @ x.T - coded @ coded.T) <= e[:, None] + m[:, None] * e[None, :] + 1e-12).all()


def test_only_doubtful_pairs_are_computed_again():
    rows = planted(400)
    tile = ed.Tile(ed.pack_tile(np.arange(400), np.ones(400), np.array([r[1] for r in rows], np.float32)))
    _, _, doubt = ed.linked(tile, tile, slice(0, 400), slice(0, 400), 0.95)
    assert 0 < doubt < 400 * 400 / 20


def test_forest_joins_what_the_pairs_join():
    rng = np.random.default_rng(3)
    for p in (0.01, 0.2, 0.9):
        net = rng.random((40, 30)) < p
        i, j = np.nonzero(net)
        a, b = ed.forest(i, j, 40, 30)
        assert joined(70, zip(a, b + 40, strict=True)) == joined(70, zip(i, j + 40, strict=True))
        assert len(a) <= 2 * 70


def test_embeddings_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0),
        (7, [None, 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0], 0), (10, [-1.0, 0.0], 0),
    ]
    got = sorted((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_vectors(vectors(spark, rows)).collect())
    alone = [(False, k, 0, k, True) for k in range(3, 11)]
    assert got == [(False, 1, 2, 1, True), (False, 2, 2, 1, False), (False, 2, 2, 1, False), *alone, (True, None, 0, None, False)]
    assert ed.near_vectors(vectors(spark, rows).limit(0)).count() == 0
