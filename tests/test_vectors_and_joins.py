"""Texts as vectors, pruned joins, strongest partners, factor scores and placed views, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from dense import calinski, cells, matrix, planted, silhouette
from pyspark.sql import functions as F

from facetgraph.operators import blocks, fusion, matching, scores, text_vectors, threshold_join, views


def test_text_vectors_by_hand(spark):
    texts = {1: "a a b", 2: "b c", 3: "", 4: None, 5: "a"}
    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {(r.i, r.f): r.v for r in text_vectors.text_vectors(df, "id", F.split("t", " "), buckets=1 << 20).collect()}
    docs = {i: Counter(t.split()) for i, t in texts.items() if t}
    df_of = Counter(t for d in docs.values() for t in d)

    def place(term):
        h = xxhash.xxh64_intdigest(term.encode(), 42)
        return h % (1 << 20) if h < 1 << 63 else (h - (1 << 64)) % (1 << 20), -1 if (h >> 59) & 1 else 1

    want = {(i, place(t)[0]): place(t)[1] * n * (math.log((1 + 3) / (1 + df_of[t])) + 1) for i, d in docs.items() for t, n in d.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # documents with one key are one document; a feature both of whose terms cancel is zero and left out
    twice = spark.createDataFrame([(1, ["x"]), (1, ["y"]), (None, ["z"])], "id int, t array<string>")
    opposite = lambda t: F.when(t == "x", F.lit(1 << 59)).otherwise(F.lit(0)).cast("bigint")
    counts = text_vectors.term_counts(twice, "id", F.col("t"), 8, opposite)
    assert counts.collect() == [(1, 0, 0)] and text_vectors.weighted(counts, 8).collect() == []


def sparse_world(seed, n=60, features=40):
    """Rows with a few frequent features in nearly all and copies in a third of all rows."""
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, features)) < 0.15, rng.random((n, features)), 0)
    m[:, :3] = rng.random((n, 3)) * (rng.random((n, 3)) < 0.9)
    m[10:30] = m[9]
    m[n - 1] = 0
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


@pytest.mark.parametrize("threshold", [0.2, 0.6, 0.95])
def test_similar_rows_lose_and_add_nothing(spark, threshold):
    m = sparse_world(1)
    rows = [(f"e{a:02d}", f"f{b:02d}", float(m[a, b])) for a in range(60) for b in range(40) if m[a, b]]
    df = spark.createDataFrame(rows, "i string, f string, v double").repartition(3)
    got = {(r.i, r.j): r.w for r in threshold_join.similar_rows(df, threshold).collect()}
    s = m @ m.T
    want = {(f"e{a:02d}", f"e{b:02d}"): s[a, b] for a in range(60) for b in range(a + 1, 60) if s[a, b] >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_few_candidates_are_compared(spark):
    """Rows that share only frequent features are ruled out unseen."""
    rng = np.random.default_rng(2)
    rows = []
    for a in range(400):
        own = [f"g{a // 4}_{x}" for x in range(6)] + [f"common{x}" for x in range(3)]
        v = np.append(rng.random(6) + 1, rng.random(3) * 0.7)
        v /= np.linalg.norm(v)
        rows += [(a, f, float(x)) for f, x in zip(own, v)]
    df = spark.createDataFrame(rows, "i bigint, f string, v double")
    assert threshold_join.candidates(df, 0.8).count() <= 400 * 3 // 2 < 400 * 399 // 100


def cloud(seed, n=300, size=12, groups=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, size))
    x = middle[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, size))
    x[n // 3 : n // 2] = x[n // 3]
    x[0] = 0
    return x.astype(np.float32)


@pytest.mark.parametrize("threshold", [0.3, 0.9, 1.0 - 1e-7])
def test_similar_vectors_lose_and_add_nothing(spark, threshold):
    x = cloud(3)
    df = spark.createDataFrame([(n, [float(c) for c in row]) for n, row in enumerate(x)] + [(900, None)], "i bigint, v array<float>").repartition(3)
    u = x.astype(float)
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=np.zeros_like(u), where=np.abs(u).sum(axis=1, keepdims=True) > 0)
    s = u @ u.T
    got = {(r.i, r.j): r.w for r in threshold_join.similar_vectors(df, threshold).collect()}
    sure = {(a, b) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= threshold + 1e-12}
    maybe = {(a, b) for a in range(300) for b in range(a + 1, 300) if s[a, b] >= threshold - 1e-12}
    assert sure <= got.keys() <= maybe and all(got[k] == pytest.approx(s[k]) for k in got)
    both = threshold_join.similar_between(df.filter("i < 100"), df.filter("i >= 100"), threshold)
    pairs = {(r.i, r.j) for r in both.collect()}
    assert {p for p in sure if p[0] < 100 <= p[1]} <= pairs <= {p for p in maybe if p[0] < 100 <= p[1]}


def test_vectors_visit_few_tiles(spark, monkeypatch):
    """Over a high threshold a row goes to the tiles around it, not to all others."""
    monkeypatch.setattr(threshold_join, "TILE", 16)
    x = cloud(4, n=600, groups=24)
    df = spark.createDataFrame([(n, [float(c) for c in row]) for n, row in enumerate(x)], "i bigint, v array<float>")
    sent = threshold_join.visits(df, 0.95)
    tiles = sent.filter("side = 0").select("tile").distinct().count()
    assert sent.filter("side = 0").count() == 599 and tiles > 30
    assert sent.filter("side = 1").count() < 599 * tiles / 8
    with pytest.raises(ValueError):
        threshold_join.similar_vectors(df, 0.0)
    nothing = df.filter("i = 0")  # a zero vector alone
    assert threshold_join.similar_vectors(nothing, 0.5).collect() == [] and threshold_join.similar_vectors(df.limit(0), 0.5).collect() == []


@pytest.mark.parametrize("queue", [1, 3])
def test_matching_refills_its_queues(spark, queue):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(14, 3)), rng.normal(size=(11, 3))
    u, w = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    s = u @ w.T
    want, free = set(), {(x, y) for x in range(14) for y in range(11)}
    while free:
        x, y = max(free, key=lambda p: s[p])
        want.add((x, y))
        free = {p for p in free if p[0] != x and p[1] != y}

    def frame(v):
        return spark.createDataFrame([(n, [float(c) for c in row]) for n, row in enumerate(v)], "i bigint, v array<double>")

    assert {(r.i, r.j) for r in matching.mutual_best(frame(a), frame(b), queue=queue).collect()} == want


def test_strongest_partners(spark):
    m = np.array([[9, 3, 3, 1], [3, 9, 2, 0], [3, 2, 9, 0.5], [1, 0, 0.5, 9]], float)
    view = cells(spark, m, list("abcd"))
    union = {(r.i, r.j): r.w for r in views.strongest(view, 1).collect()}
    assert union == {("a", "b"): 3, ("b", "a"): 3, ("c", "a"): 3, ("a", "c"): 3, ("d", "a"): 1, ("a", "d"): 1}
    assert {(r.i, r.j) for r in views.strongest(view, 1, "mutual").collect()} == {("a", "b"), ("b", "a")}
    assert "WindowGroupLimit" in views.strongest(view, 1)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        views.strongest(view, 1, "other")


def test_factor_scores_equal_dense_ones(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 6)) * (rng.random((20, 6)) < 0.7)
    x[:, 0] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"n{a:02d}", f"f{b}", float(x[a, b])) for a in range(20) for b in range(6) if x[a, b]]
    factors = spark.createDataFrame(rows, "i string, f string, v double")
    labels = {3: [int(c) for c in rng.integers(0, 3, 20)], 5: [int(c) for c in rng.integers(0, 5, 20)]}
    labels[5][0] = 9  # a cluster of one
    given = spark.createDataFrame([(k, f"n{a:02d}", c) for k, ls in labels.items() for a, c in enumerate(ls)], "k int, entity string, cluster int")
    got = {r.k: r for r in scores.sweep_scores_factors(factors, given).collect()}
    for k, ls in labels.items():
        assert got[k].silhouette_score == pytest.approx(silhouette(x @ x.T, ls, clip=False))
        assert got[k].calinski_harabasz_score == pytest.approx(calinski(x @ x.T, ls))
    one = given.filter("k = 3").drop("k")
    assert scores.silhouette_factors(factors, one).first()[0] == pytest.approx(got[3].silhouette_score)
    single = scores.calinski_harabasz_factors(factors, one.withColumn("cluster", F.lit(0))).first()[0]
    assert single == 0.0


def test_placed_view_without_its_grid(spark):
    rng = np.random.default_rng(9)
    m, _ = planted(rng, [4, 3])
    names = [f"n{x}" for x in range(7)]
    view = cells(spark, m, names)
    mapping = spark.createDataFrame([(n, x + 2) for x, n in enumerate(names)], "i string, position bigint")
    placed = fusion.place(view, mapping, size=12, known=7, original=7)
    grid = np.zeros((12, 12))
    for r in fusion.expand(view, mapping, 12, 7, 7).collect():
        grid[r.r, r.c] = r.w
    assert {r.r: pytest.approx(r.degree) for r in placed.degrees().collect()} == dict(enumerate(grid.sum(axis=1)))
    norms = placed.norms().first()
    assert norms.l1 == pytest.approx(np.abs(grid).sum(axis=0).max())
    assert norms.frobenius == pytest.approx(np.linalg.norm(grid)) and norms["mean"] == pytest.approx(grid.mean())
    x = rng.normal(size=12)
    y = {r.r: r.y for r in placed.times(spark.createDataFrame([(n, float(v)) for n, v in enumerate(x)], "r bigint, x double")).collect()}
    assert np.allclose([y[n] for n in range(12)], grid @ x)


def test_l1_fusion_until_it_stands_still(spark):
    rng = np.random.default_rng(10)
    a, b = planted(rng, [5, 4])[0], planted(rng, [5, 4], 0.7, 0.2)[0]
    names = [f"n{x}" for x in range(9)]
    fused, weights, history = fusion.l1_fusion({"a": cells(spark, a, names), "b": cells(spark, b, names)}, spark.createDataFrame([(n,) for n in names], "i string"))

    def unit(m):
        m = np.clip((m + m.T) / 2, 0, 1)
        np.fill_diagonal(m, 1)
        return m

    both = [unit(a.copy()), unit(b.copy())]
    u = sum(both) / 2
    for it in range(100):
        gaps = [np.abs(u - v).sum(axis=0).max() for v in both]
        p = np.array([1 / (2 * np.sqrt(g)) if g > 1e-10 else 1.0 for g in gaps])
        p /= p.sum()
        new = 0.7 * sum(q * (v + 0.1 * np.tanh(10 * (u - v))) for q, v in zip(p, both)) + 0.3 * u
        np.fill_diagonal(new, 1)
        change, u = np.linalg.norm(new - u), new
        if change < 1e-6 and it > 10:
            break
    assert len(history) == it + 1 and history[-1][1] == pytest.approx(change, abs=1e-9)
    assert [weights["a"], weights["b"]] == pytest.approx(p.tolist())
    assert np.allclose(matrix(fused.collect(), names), u, atol=1e-9)


def test_blocks_of_vectors_grow_with_the_set():
    assert [blocks.vector_blocks(n) for n in (1, 1024, 20_000, 120_000, 720_000)] == [1, 1, 20, 24, 24]
    assert blocks.vector_blocks(10_000_000) * blocks.MOST_ROWS >= 10_000_000


def test_best_partners_and_silhouette_over_many_strips(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_BLOCK", 300)
    rng = np.random.default_rng(8)
    v = rng.integers(-1, 2, size=(900, 4)).astype(float)
    frame = spark.createDataFrame([(n, [float(x) for x in row]) for n, row in enumerate(v)], "i bigint, v array<float>")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    got = views.cosine_rectangle(frame.filter("i < 400"), frame.filter("i >= 400"), best=5).collect()
    sims = np.round(u[:400] @ u[400:].T, 9)
    assert len(got) == 2000
    for i in range(0, 400, 37):
        best = np.sort(sims[i])[::-1][:5]
        assert np.allclose(sorted((r.w for r in got if r.i == i), reverse=True), best)
    given = spark.createDataFrame([(n, n % 3) for n in range(900)], "entity bigint, cluster int")
    d = 1 - np.clip(u @ u.T, 0, 1)
    np.fill_diagonal(d, 0)
    label = np.arange(900) % 3
    value = []
    for i in range(900):
        means = [d[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        value.append((b - a) / max(a, b) if max(a, b) else 0.0)
    assert abs(scores.silhouette_vectors(frame, given).first()[0] - np.mean(value)) < 1e-9
