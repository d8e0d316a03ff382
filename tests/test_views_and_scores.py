import numpy as np
import pyarrow as pa
import pytest
from dense import calinski, cells, laplacian, matrix, planted, silhouette
from pyspark.sql import functions as F

from facetgraph.operators import fusion, laplacian as lap, matching, quality, scores, views
from facetgraph.sources import sinks, tables


def test_scaling_order_matters_for_a_dominant_self_loop(spark):
    rel = spark.createDataFrame([("a", "a", 10), ("a", "b", 5)], "src string, dst string, score bigint")
    assert views.structural_view(rel).filter("i = 'a'").first()["w"] == pytest.approx(0.25)
    assert views.structural_view(rel, "zero_before").filter("i = 'a'").first()["w"] == pytest.approx(1.0)
    zero = spark.createDataFrame([("a", "b", 0.0)], "i string, j string, w double")
    assert views.scale_by_max(zero).first()["w"] == 0.0


def brute_counts(groups):
    out = {}
    for members in groups.values():
        s = sorted(set(members))
        for x in range(len(s)):
            for y in range(x + 1, len(s)):
                out[(s[x], s[y])] = out.get((s[x], s[y]), 0) + 1
    return out


@pytest.mark.parametrize("large", [64, 3])
def test_cooccurrence_with_and_without_blocks(spark, large):
    rng = np.random.default_rng(1)
    # one group holds a third of all rows
    groups = {g: [f"e{x:02d}" for x in rng.integers(0, 30, 6)] for g in range(20)} | {99: [f"e{x:02d}" for x in range(30)] * 2}
    df = spark.createDataFrame([(g, m) for g, ms in groups.items() for m in ms], "grp int, member string")
    got = {(r.a, r.b): r.n for r in views.cooccurrence_counts(df, large=large).collect()}
    assert got == brute_counts(groups)


def test_gram_cells_over_many_blocks_and_chunks(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(23, 11)) * (rng.random((23, 11)) < 0.4)
    rows = [(f"e{a:02d}", f"f{b}", float(m[a, b])) for a in range(23) for b in range(11) if m[a, b]]
    got = {(r.i, r.j): r.w for r in views.gram_cells(spark.createDataFrame(rows, "i string, f string, v double"), 5, 4).collect()}
    want = m @ m.T
    for a in range(23):
        for b in range(a + 1, 23):
            assert got.get((f"e{a:02d}", f"e{b:02d}"), 0.0) == pytest.approx(want[a, b], abs=1e-12)


def vector_frame(spark, v):
    return spark.createDataFrame([(n, [float(x) for x in row]) for n, row in enumerate(v)], "i bigint, v array<float>")


def unit(v):
    v = v.astype(np.float32).astype(float)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def test_cosine_forms_agree(spark, monkeypatch):
    monkeypatch.setattr("facetgraph.operators.blocks.ROWS_PER_BLOCK", 7)
    monkeypatch.setattr("facetgraph.operators.blocks.block_count", lambda rows, per_block=7: max(1, -(-rows // 7)))
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 5))
    v[4] = 0
    s = unit(v) @ unit(v).T
    df = vector_frame(spark, v)
    got = {(r.i, r.j): r.w for r in views.cosine_pairs(df, mirror=True, diagonal=True).collect()}
    assert len(got) == 400
    assert all(got[(a, b)] == pytest.approx(1.0 if a == b else s[a, b], abs=1e-9) for a, b in got)
    kept = {(r.i, r.j) for r in views.cosine_pairs(df, threshold=0.3).collect()}
    assert kept == {(a, b) for a in range(20) for b in range(a + 1, 20) if s[a, b] >= 0.3}
    sums = {r.i: r.degree for r in views.cosine_row_sums(views.unit_factors(views.vector_features(df))).collect()}
    assert all(sums[a] == pytest.approx(s[a].sum() - 1, abs=1e-6) for a in sums)
    labels = [int(x) for x in rng.integers(0, 3, 20)]
    asg = spark.createDataFrame(list(enumerate(labels)), "entity bigint, cluster int")
    for clip in (True, False):
        score = scores.silhouette_vectors(df, asg, clip=clip).first()[0]
        assert score == pytest.approx(silhouette(s.copy(), labels, clip), abs=1e-6)


def test_mutual_best_is_greedy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(8, 4)), rng.normal(size=(6, 4))
    s = unit(a) @ unit(b).T
    want, free = set(), [(x, y) for x in range(8) for y in range(6)]
    while free:
        x, y = max(free, key=lambda p: s[p])
        want.add((x, y))
        free = [p for p in free if p[0] != x and p[1] != y]
    got = {(r.i, r.j) for r in matching.mutual_best(vector_frame(spark, a), vector_frame(spark, b)).collect()}
    assert got == want


def test_mean_pool_with_mask(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [5.0, 5.0], 0)], "k string, v array<double>, m int")
    got = {r.k: r.v for r in views.mean_pool(df, "k", "v", "m").collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


def test_scores_against_dense(spark):
    rng = np.random.default_rng(5)
    m, _ = planted(rng, [5, 6, 4])
    names = [f"n{x:02d}" for x in range(15)]
    labels = [int(x) for x in rng.integers(0, 4, 15)]
    labels[0] = 9  # a singleton
    view = cells(spark, m, names)
    asg = spark.createDataFrame(list(zip(names, labels)), "entity string, cluster int")
    assert scores.silhouette(view, asg).first()[0] == pytest.approx(silhouette(m.copy(), labels))
    assert scores.calinski_harabasz(view, asg).first()[0] == pytest.approx(calinski(m, labels))
    swept = asg.selectExpr("3 as k", "entity", "cluster").union(asg.selectExpr("1 as k", "entity", "0 as cluster"))
    rows = {r.k: r for r in scores.sweep_scores(view, swept).collect()}
    assert rows[3].silhouette_score == pytest.approx(silhouette(m.copy(), labels))
    assert (rows[1].silhouette_score, rows[1].calinski_harabasz_score) == (-1.0, 0.0)
    assert scores.best_k(scores.sweep_scores(view, swept)).first()["best_k"] == 3


def test_laplacian_rules(spark):
    names = ["a", "b", "c"]
    m = np.array([[1.0, 0.5, 0], [0.5, 0, 0], [0, 0, 0]])
    everyone = spark.createDataFrame([(n,) for n in names], "i string")
    got = matrix(lap.normalized_laplacian(cells(spark, m, names), everyone).collect(), names)
    assert np.allclose(got, laplacian(m.copy()))
    kept = matrix(lap.normalized_laplacian(cells(spark, m, names), everyone, keep_diagonal=True).collect(), names)
    assert kept[0, 0] == pytest.approx(1 - 1 / 1.5) and kept[2, 2] == pytest.approx(1.0)


def test_alignment(spark):
    one = spark.createDataFrame([("a",), ("b",)], "i string")
    two = spark.createDataFrame([("b",), ("c",)], "i string")
    assert [r.i for r in views.common_entities(one, two).collect()] == ["b"]
    assert {tuple(r) for r in views.misaligned({"x": one, "y": two}).collect()} == {("a", "x"), ("c", "y")}
    with pytest.raises(ValueError):
        views.require_aligned({"x": one, "y": two})


# The one complete published partition.
GOLD = {
    "Account": ["Account", "AccountDao", "SqlMapAccountDao"],
    "Catalog": ["Category", "CategoryDao", "SqlMapCategoryDao", "Item", "ItemDao", "SqlMapItemDao", "Product", "ProductDao", "SqlMapProductDao"],
    "Order": ["Order", "OrderDao", "SqlMapOrderDao", "OrderService", "LineItem"],
    "Cart": ["Cart", "CartItem"],
    "Sequence": ["Sequence", "SqlMapSequenceDao"],
    "Gateway": ["PetStoreFacade", "PetStoreImpl"],
}


def test_quality_by_hand(spark):
    clusters = GOLD | {"Empty": []}
    of = {e: c for c, es in clusters.items() for e in es}
    edges = [
        ("Cart", "CartItem", 13), ("CartItem", "Item", 5), ("Order", "LineItem", 8), ("LineItem", "Item", 8), ("Order", "Account", 3),
        ("SqlMapOrderDao", "OrderDao", 15), ("PetStoreImpl", "PetStoreFacade", 15), ("Cart", "Cart", 15), ("Unknown", "Cart", 50),
    ]
    rel = spark.createDataFrame(edges, "src string, dst string, score bigint")
    asg = spark.createDataFrame(list(of.items()), "entity string, cluster string")
    dim = spark.createDataFrame([(c,) for c in clusters], "cluster string")
    inner = [(s, t, w) for s, t, w in edges if s in of]
    size = {c: len(es) for c, es in clusters.items()}
    k = len(clusters)
    for variant, weigh in (("counts", lambda w: 1), ("weights", lambda w: w)):
        cohesion = sum(weigh(w) / size[of[s]] ** 2 for s, t, w in inner if of[s] == of[t]) / k
        coupling = sum(weigh(w) / (2 * size[of[s]] * size[of[t]]) for s, t, w in inner if of[s] != of[t]) / (k * (k - 1) / 2)
        got = {r.metric: r.value for r in quality.quality(rel, asg, dim, variant).collect()}
        assert got["SM"] == pytest.approx(cohesion - coupling)
    assert got["ICP"] == pytest.approx((5 + 8 + 3) / sum(w for _, _, w in inner))
    assert got["IFN"] == pytest.approx(len({t for s, t, _ in inner if of[s] != of[t]}) / k)
    assert got["NED"] == pytest.approx(1 - 2 / k)
    lone = asg.selectExpr("entity", "'x' as cluster")
    assert quality.structural_modularity(rel, lone).first()[0] == 0.0
    none = rel.filter("score < 0")
    assert quality.inter_call_share(none, asg).first()[0] == 0.0


def test_l1_fusion_against_dense(spark):
    rng = np.random.default_rng(6)
    names = [f"n{x}" for x in range(6)]
    raw = [planted(rng, [3, 3])[0], planted(rng, [2, 4])[0]]
    everyone = spark.createDataFrame([(n,) for n in names], "i string")
    fused, weights, history = fusion.l1_fusion({n: cells(spark, m, names) for n, m in zip("ab", raw)}, everyone, max_iter=4, cut_every=2)
    vs = []
    for m in raw:
        m = np.clip((m + m.T) / 2, 0, 1)
        np.fill_diagonal(m, 1)
        vs.append(m)
    u = sum(vs) / 2
    for _ in range(4):
        p = np.array([1 / (2 * np.sqrt(np.linalg.norm(u - v, 1))) for v in vs])
        p /= p.sum()
        u = 0.7 * sum(q * (v + 0.1 * np.tanh(10 * (u - v))) for q, v in zip(p, vs)) + 0.3 * u
        np.fill_diagonal(u, 1)
    assert np.allclose(matrix(fused.collect(), names), u)
    assert [weights["a"], weights["b"]] == pytest.approx(list(p)) and len(history) == 4


def test_interchange_forms(spark, tmp_path):
    rel = spark.createDataFrame([("a", "b", 15), ("a", "c", 3)], "src string, dst string, score bigint")
    everyone = spark.createDataFrame([("a",), ("b",)], "class string")
    maps = sinks.relation_maps(everyone, rel)
    assert {tuple(r) for r in maps.collect()} == {("a", "{'b': 15, 'c': 3}"), ("b", "{}")}
    sinks.write_csv(maps, str(tmp_path / "maps"), ["class"])
    back = tables.csv_table(spark, str(tmp_path / "maps"))
    assert {tuple(r) for r in tables.relation_rows(back).collect()} == {("a", "b", 15), ("a", "c", 3)}
    bad = spark.createDataFrame([("a", "{oops")], "class string, relations string")
    assert tables.relation_rows(bad).count() == 0
    view = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "i string, j string, w double")
    sinks.write_csv(sinks.pivot_matrix(view, ["a", "b"]), str(tmp_path / "wide"))
    cells_back = {(r.i, r.j): r.w for r in tables.read_wide_matrix(spark, str(tmp_path / "wide")).collect()}
    assert cells_back == {("a", "a"): 0.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 0.0}
    asg = spark.createDataFrame([(2, "x", "cluster_0"), (2, "y", "cluster_0")], "k int, entity string, cluster string")
    dim = spark.createDataFrame([(2, "cluster_0"), (2, "cluster_1")], "k int, cluster string")
    docs = sinks.partition_documents(asg, dim, ["k"])
    assert docs.first()["document"] == '{"cluster_0":["x","y"],"cluster_1":[]}'
    sinks.write_partitions(docs, str(tmp_path / "k"))
    got, dims = tables.read_partition(spark, str(tmp_path / "k"))
    assert got.count() == 2 and dims.count() == 2


def test_expand(spark):
    view = spark.createDataFrame([("a", "b", 0.4), ("b", "a", 0.4)], "i string, j string, w double")
    mapping = spark.createDataFrame([("a", 0), ("b", 2)], "i string, position bigint")
    got = {(r.r, r.c): r.w for r in fusion.expand(view, mapping, size=4, known=3, original=2).collect()}
    assert len(got) == 16 and got[(0, 2)] == 0.4 and got[(1, 1)] == 1.0
    assert got[(0, 1)] == pytest.approx(0.2 * 0.7) and got[(0, 3)] == pytest.approx(0.2 * 0.5)


def test_cells_of_pairs_are_made_whole_and_never_shuffled(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{a:02d}", f"f{b}", float(rng.integers(1, 4))) for a in range(40) for b in range(15)]
    made = views.gram_cells(spark.createDataFrame(rows, "i string, f string, v double"), 8, 4)
    assert made.count() == 40 * 39 / 2
    plan = made._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert "HashAggregate" not in plan[: plan.index("MapInArrow")] and "Exchange" not in plan[: plan.index("MapInArrow")]


def test_largest_cells_leave_each_task_with_ties_by_partner(spark):
    rng = np.random.default_rng(5)
    profiles = rng.integers(1, 3, size=(6, 3))
    rows = [(f"e{a:02d}", f"f{b}", float(profiles[a % 6, b])) for a in range(48) for b in range(3)]
    features = spark.createDataFrame(rows, "i string, f string, v double")
    whole = views.cosine_cells(features).withColumn("w", F.round("w", 6))
    few = views.cosine_cells(features, best=3, digits=6).withColumn("w", F.round("w", 6))
    assert few.count() < whole.count() / 2
    for rule in ("union", "mutual"):
        want, got = ({tuple(r) for r in views.strongest(x, 3, rule).collect()} for x in (whole, few))
        assert got == want and want
    factors = views.unit_factors(features)
    split = views.gram_cells(factors, 8, 2, best=3, digits=6).unionByName(features.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))
    assert {tuple(r) for r in views.strongest(split, 3).collect()} == {tuple(r) for r in views.strongest(whole, 3).collect()}


def test_rounding_of_cells_is_that_of_spark(spark):
    x = np.concatenate([np.arange(-2000, 2000) / 2000 + 0.0005, np.random.default_rng(6).random(500), [0.1234565, 0.9999995, 1.0, 0.0000005]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 3)).collect()]
    assert views._half_up(x, 3).tolist() == want


def test_counts_of_large_groups_alone_are_not_summed_again(spark):
    rows = [(g, f"m{m:02d}") for g in range(3) for m in range(70) if (m + g) % 9]
    members = spark.createDataFrame(rows, "grp int, member string")
    counts = views.cooccurrence_counts(members, large=20)
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "HashAggregate" not in plan[: plan.index("MapInArrow")]
    assert {(r.a, r.b): r.n for r in counts.collect()} == brute_counts({k: [m for g, m in rows if g == k] for k in range(3)})


def test_cells_leave_a_task_as_numbers_beside_one_list_of_names():
    pair, n = views._Pair(), 100
    names = pa.array([f"e{k:03d}" for k in range(n)])
    none = pa.array([[]] * n, pa.list_(pa.int64()))
    pair.take(-1, np.full(n, 2), names, none, none.cast(pa.list_(pa.float64())))
    pair.take(0, np.full(n, 2), names, pa.array([[7]] * n, pa.list_(pa.int64())), pa.array([[float(k + 1)] for k in range(n)]))
    sent = list(pair.rows(True, 0, None))
    assert sum(len(b) for b in sent) <= n // views.SENT + 1
    got = {}
    for r in (r for b in sent for r in b.to_pylist()):
        assert len(r["names"]) <= n + views.SENT
        got.update({(r["names"][a], r["names"][b]): w for a, b, w in zip(r["one"], r["two"], r["w"], strict=True)})
    assert got == {(f"e{a:03d}", f"e{b:03d}"): (a + 1.0) * (b + 1) for a in range(n) for b in range(a + 1, n)}
