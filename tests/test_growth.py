"""What tasks hold and send as the data grow."""

import itertools
from collections import Counter

import numpy as np
import pytest

from facetgraph import session
from facetgraph.operators import scores, spectral, threshold_join, views
from facetgraph.plans import workload


def test_tasks_stay_small_while_the_cells_grow(spark, monkeypatch):
    """Pairs and cells are dealt to as many tasks as there are, not to a fixed number; the results stay."""
    rng = np.random.default_rng(5)
    groups = [sorted({f"e{x:02d}" for x in rng.integers(0, 30, 5)}) for _ in range(80)]
    members = spark.createDataFrame([(g, m) for g, own in enumerate(groups) for m in own], "grp int, member string")
    want = Counter(p for own in groups for p in itertools.combinations(own, 2))
    view = views.cooccurrence_view(members)
    given = spark.createDataFrame([(f"e{x:02d}", x % 3) for x in range(30)], "entity string, cluster int")
    plain = [f(view, given).collect() for f in (scores.silhouette, scores.calinski_harabasz)]
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    counts = views.cooccurrence_counts(members)
    assert {(r.a, r.b): r.n for r in counts.collect()} == dict(want)
    assert counts.rdd.getNumPartitions() >= sum(want.values()) // 20 > 8
    for f, old in zip((scores.silhouette, scores.calinski_harabasz), plain):
        assert f(views.cooccurrence_view(members), given).collect()[0][0] == pytest.approx(old[0][0], abs=1e-12)


def test_symmetric_scores_of_loops_and_nulls(spark):
    rows = [("a", "b", 1), ("b", "a", 2), ("a", "a", 3), (None, "a", 4), ("a", None, 5), (None, None, 6), ("b", "c", None)]
    got = views.symmetric_scores(spark.createDataFrame(rows, "src string, dst string, score bigint")).collect()
    want = {("a", "b"): 3.0, ("b", "a"): 3.0, ("a", "a"): 6.0, (None, "a"): 9.0, ("a", None): 9.0, (None, None): 12.0, ("b", "c"): None, ("c", "b"): None}
    assert len(got) == len(want) and {(r.i, r.j): r.w for r in got} == want


def test_suppliers_of_the_next_line(spark, tmp_path):
    """Repeated lines count each time, lines without a key or a line after them not at all; lines are sent once."""
    lines = [(1, 1, 7, "R"), (1, 1, 7, "A"), (1, 2, 8, "N"), (1, 2, 8, "N"), (1, 2, 9, "N"), (1, 4, 7, "R"), (2, 3, 9, "N"), (None, 1, 7, "R"), (None, 2, 8, "R"), (3, None, 7, "R"), (3, 1, None, "R"), (3, 2, 8, "N")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"s{k}") for k in (7, 8, 9)], "s_suppkey bigint, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    relation = workload.supplier_relation(spark, str(tmp_path))
    assert {(r.src, r.dst): r.score for r in relation.collect()} == {("s7", "s8"): 46, ("s7", "s9"): 23}
    plan = relation._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_returnflag") and len([x for x in plan.splitlines() if "Relation" in x and "l_linenumber" in x]) == 1


def test_common_features_are_never_sent_pair_by_pair(spark, monkeypatch):
    """Rows that all share their features meet in blocks; none is lost, and a row without a key has no pair."""
    rng = np.random.default_rng(3)
    m = np.where(rng.random((90, 12)) < 0.7, rng.normal(size=(90, 12)), 0) + 0.5
    m[40:50] += 4 * np.eye(12)[3]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    monkeypatch.setattr(threshold_join, "LEAST_ROWS", 8)
    df = spark.createDataFrame([(a, f"f{b}", float(m[a, b])) for a in range(90) for b in range(12)], "i bigint, f string, v double")
    found = threshold_join.similar_rows(df.unionByName(df.limit(12).selectExpr("null AS i", "f", "v")), 0.8)
    s = m @ m.T
    want = {(a, b): s[a, b] for a in range(90) for b in range(a + 1, 90) if s[a, b] >= 0.8}
    got = {(r.i, r.j): r.w for r in found.collect()}
    assert len(want) > 20 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_frequent_features_are_added_as_a_matrix(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = (np.where(rng.random((n, 300)) < 0.4, rng.normal(size=(n, 300)), 0) for n in (20, 30))

    def lists(m):
        f, at = np.nonzero(m.T)
        features, begin = np.unique(f, return_index=True)
        return features, np.append(begin, len(f)), at, m[at, f]

    for share in (0.0, 0.16, 1.0):
        monkeypatch.setattr(threshold_join, "DENSE", share)
        assert np.allclose(threshold_join._shared(lists(a), lists(b), (20, 30)), a @ b.T)


def test_few_matrix_rows_make_few_buckets(spark):
    """Each bucket sends a sum for every entity it reaches: there are as many as the rows need, not as the session has partitions."""
    ring = spark.createDataFrame([(f"n{x:02d}", f"n{(x + s) % 30:02d}", 1.0) for x in range(30) for s in (-1, 1)], "i string, j string, w double")
    stack = spectral.stack_views({"ring": ring}, ring.select("i").distinct())
    assert stack.cells.rows.rdd.getNumPartitions() == 1
    summed = stack.cells.times({"y": spectral.F.col("a0")}, stack.nodes.selectExpr("concat('-1|', i) AS key", "cast(substr(i, 2) AS double) AS y0"), ["y0"])
    assert {r.to: r.y0 for r in summed.collect()} == {f"n{x:02d}": float((x - 1) % 30 + (x + 1) % 30) for x in range(30)}
    spectral.unstack(stack)


def test_steps_of_the_solver_move_arrays(spark):
    """Matrix rows are packed once per weights and a basis moves in blocks: steps read a few rows, whatever the cells and vectors."""
    rng = np.random.default_rng(7)
    w = np.triu(rng.random((60, 60)), 1)
    cells = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(w[a, b])) for a, b in zip(*np.nonzero(w), strict=True)], "i string, j string, w double")
    everyone = spark.createDataFrame([(f"n{a:02d}",) for a in range(60)], "i string")
    stack = spectral.stack_views({"dense": cells}, everyone)
    d = (w + w.T).sum(axis=1)
    n = (w + w.T) / np.sqrt(np.outer(d, d))
    affinity = spectral.Affinity.build(stack, [1.0])
    assert stack.cells.rows.count() == 60 * 60 and affinity.cells.count() == 1
    y = rng.random((60, 3))
    basis = spark.createDataFrame([(f"n{a:02d}", *map(float, y[a])) for a in range(60)], "i string, y0 double, y1 double, y2 double")
    stepped = spectral._merged(affinity.step(affinity.blocks(basis, ["y0", "y1", "y2"]), 2, alpha=2.0, beta=-3.0))
    assert stepped.columns == ["t", "copy", "ids", "m"] and stepped.count() == 1
    got = spectral._plain(stepped, 5).orderBy("i").toPandas()
    assert np.allclose(got.drop(columns="i").to_numpy(), np.hstack([2 * y[:, :2] - 3 * n @ y[:, :2], y]))
    affinity.release()
    spectral.unstack(stack)
