import numpy as np
import pytest
from dense import cells, laplacian, matrix, planted

from facetgraph.operators import cluster, fusion, spectral, views
from facetgraph.plans import pipeline
from facetgraph.sources.files import source_files


@pytest.fixture(scope="module")
def world(spark):
    """Three groups of entities, two sparse views and one factor view."""
    rng = np.random.default_rng(7)
    a, labels = planted(rng, [14, 13, 13])
    b, _ = planted(rng, [14, 13, 13], 0.6, 0.1)
    e = np.abs(rng.normal(size=(40, 6))) + 3 * np.eye(3)[labels].repeat(2, axis=1)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    names = [f"n{x:02d}" for x in range(40)]
    factors = spark.createDataFrame([(names[x], f"f{y}", float(e[x, y])) for x in range(40) for y in range(6)], "i string, f string, v double")
    parts = {"str": cells(spark, a, names), "sem": factors, "fun": cells(spark, b, names)}
    everyone = spark.createDataFrame([(n,) for n in names], "i string")
    return names, labels, [a, e @ e.T, b], parts, everyone


def exact(mats, weights, k):
    values, vectors = np.linalg.eigh(laplacian(sum(w * m for w, m in zip(weights, mats))))
    return values, vectors[:, :k]


@pytest.mark.parametrize("slices", [10**6, 15])
def test_eigenvalues_and_losses(spark, world, slices):
    """With whole sources, and with hot ones cut into slices."""
    names, _, mats, parts, everyone = world
    stack = spectral.stack_views(parts, everyone, slice_rows=slices)
    assert (stack.cells.hot is not None) == (slices == 15)
    weights = [0.5, 0.3, 0.2]
    basis = spectral.smallest_eigenvectors(stack, weights, 3)
    values, vectors = exact(mats, weights, 3)
    assert np.allclose(basis.values[:3], values[:3], atol=1e-8)
    assert basis.gap() == pytest.approx(values[3] - values[2], abs=1e-3)
    losses = spectral.trace_losses(stack, basis)
    want = [np.trace(vectors.T @ laplacian(m.copy()) @ vectors) for m in mats]
    assert np.allclose(losses, want, atol=1e-5)
    again = spectral.smallest_eigenvectors(stack, weights, 3, start=basis)
    assert again.rounds == 1 and np.allclose(again.values[:3], values[:3], atol=1e-8)
    spectral.unstack(stack)


CHORDS = (1, 7, 31, 142, 389)


@pytest.mark.parametrize("n", [25, 300])
def test_ring_has_its_known_eigenvalues(spark, n):
    """One solver at every size: 1 - cos(2 pi m / n), each but the first twice, on rings of chords."""
    rows = [(f"n{x:04d}", f"n{(x + s) % n:04d}", 1.0) for x in range(n) for step in CHORDS for s in (step, -step)]
    view = spark.createDataFrame(rows, "i string, j string, w double")
    stack = spectral.stack_views({"ring": view}, view.select("i").distinct())
    basis = spectral.smallest_eigenvectors(stack, [1.0], 5)
    turns = 2 * np.pi * np.arange(n) / n
    want = np.sort(1 - np.mean([np.cos(step * turns) for step in CHORDS], axis=0))
    assert np.allclose(basis.values[:5], want[:5], atol=1e-7)
    ys = basis.rows.select(*[f"y{c}" for c in range(5)]).toPandas().to_numpy()
    assert np.allclose(ys.T @ ys, np.eye(5), atol=1e-5)
    spectral.unstack(stack)


def test_an_unfinished_basis_is_an_error(spark, world):
    _, _, _, parts, everyone = world
    stack = spectral.stack_views(parts, everyone)
    with pytest.raises(RuntimeError, match="not converged"):
        spectral.smallest_eigenvectors(stack, [0.5, 0.3, 0.2], 3, max_rounds=1)
    with pytest.raises(ValueError, match="41 eigenvectors"):
        spectral.smallest_eigenvectors(stack, [1, 1, 1], 41)
    spectral.unstack(stack)


def test_learned_weights_and_partition(spark, world):
    names, labels, mats, parts, everyone = world
    fused = fusion.self_weighted(parts, everyone, 3)
    w = np.full(3, 1 / 3)
    for _ in range(20):
        _, h = exact(mats, w, 3)
        losses = np.array([np.trace(h.T @ laplacian(m.copy()) @ h) for m in mats])
        new = np.exp(-0.5 * (losses - losses.min()))
        new /= new.sum()
        done = np.linalg.norm(new - w) < 1e-4
        w = new
        if done:
            break
    assert np.allclose([fused.weights[n] for n in ("str", "sem", "fun")], w, atol=1e-3)
    assert sum(fused.weights.values()) == pytest.approx(1.0)
    assignment = cluster.spectral_sweep(fused.stack, w, [2, 3], n_init=5)
    three = {r.entity: r.cluster for r in assignment.filter("k = 3").collect()}
    assert len(three) == 40
    assert len({(three[n], int(c)) for n, c in zip(names, labels)}) == 3
    assert three[names[0]] == 0  # numbered by the smallest member


@pytest.mark.parametrize("slices", [15])
def test_kmeans_on_rows(spark, world, slices):
    names, labels, mats, _, everyone = world
    view = cells(spark, mats[0] + np.eye(40), names)
    got = {r.entity: r.cluster for r in cluster.kmeans_rows(view, everyone, 3, n_init=3, slice_rows=slices).collect()}
    assert len({(got[n], int(c)) for n, c in zip(names, labels)}) == 3


def test_kmeans_reaches_a_fixed_point(spark):
    """No row is nearer to another mean, although most rows skip most rounds; rows without cells take part."""
    rng = np.random.default_rng(11)
    m = np.where(rng.random((60, 12)) < 0.3, rng.random((60, 12)), 0) + 2 * np.eye(4)[rng.integers(0, 4, 60)].repeat(3, axis=1) * (rng.random((60, 1)) < 0.6)
    m[59] = 0
    rows = [(f"r{a:02d}", f"c{b}", float(m[a, b])) for a in range(60) for b in range(12) if m[a, b]]
    view = spark.createDataFrame(rows, "i string, j string, w double")
    everyone = spark.createDataFrame([(f"r{a:02d}",) for a in range(60)], "i string")
    got = {r.entity: r.cluster for r in cluster.kmeans_rows(view, everyone, 4, n_init=2).collect()}
    label = np.array([got[f"r{a:02d}"] for a in range(60)])
    assert set(label) == {0, 1, 2, 3}
    means = np.array([m[label == c].mean(axis=0) for c in range(4)])
    far = ((m[:, None] - means[None]) ** 2).sum(axis=2)
    assert np.allclose(far[np.arange(60), label], far.min(axis=1))


SHOP = {
    "Cart": ["Cart", "CartItem", "CartLine"],
    "Order": ["Order", "OrderItem", "OrderLine"],
}


def write_shop(root):
    """Two groups of classes that know, resemble and accompany only each other."""
    for group, members in SHOP.items():
        for name in members:
            fields = "".join(f"  {other} x{n};\n" for n, other in enumerate(members) if other != name)
            (root / f"{name}.java").write_text(f"package shop.{group.lower()};\nclass {name} {{\n{fields}  void {group.lower()}Price({name} p);\n}}\n")
        calls = " ".join(members)
        (root / f"{group}Action.java").write_text(f"class {group}Action {{ /* uses */ {calls} }}\n")


def test_source_tree_to_partition_by_all_views(spark, tmp_path):
    write_shop(tmp_path)
    parts, entities, _ = pipeline.source_views(source_files(spark, str(tmp_path)))
    assert {r.i for r in entities.collect()} == set(SHOP["Cart"] + SHOP["Order"])
    mentioned = {(r.i, r.j) for r in parts["fun"].collect()}
    assert mentioned == {(a, b) for names in SHOP.values() for a in names for b in names if a != b}
    out = pipeline.source_run(spark, str(tmp_path), k=2, n_init=3)
    got = {r.entity: r.cluster for r in out.assignment.collect()}
    assert sorted(got) == sorted(SHOP["Cart"] + SHOP["Order"])
    assert {c: {got[n] for n in names} for c, names in SHOP.items()} in ({"Cart": {0}, "Order": {1}}, {"Cart": {1}, "Order": {0}})
    values = {r.metric: r.value for r in out.quality.collect()}
    assert values["ICP"] == 0.0 and values["IFN"] == 0.0


def test_views_over_different_entities(spark, world):
    """The current rules refuse views that are not aligned; the older ones go on with the shared entities, isolated ones too."""
    names, _, _, parts, everyone = world
    members = {v: everyone for v in parts} | {"str": everyone.filter("i <> 'n39'")}
    relation = spark.createDataFrame([("n00", "n01", 1)], "src string, dst string, score bigint")
    with pytest.raises(ValueError, match="same entities"):
        pipeline.run(parts, everyone, relation, k=3, members=members)
    lonely = spark.createDataFrame([("z",)], "i string").unionByName(everyone)
    shared = views.common_entities(lonely, lonely, lonely.filter("i <> 'n39'"))
    assert {r.i for r in shared.collect()} == set(names) - {"n39"} | {"z"}


def test_structural_pipeline(spark, tmp_path):
    for group in ("Cart", "Order"):
        for part in ("", "Item", "Line"):
            body = "".join(f"  private {group}{other} x{n};\n" for n, other in enumerate(("", "Item", "Line")) if other != part)
            (tmp_path / f"{group}{part}.java").write_text(f"public class {group}{part} {{\n{body}}}\n")
    out = pipeline.structural_run(spark, str(tmp_path), k=2, n_init=3)
    got = {r.entity: r.cluster for r in out.assignment.collect()}
    assert len(got) == 6 and len({(e[:4], c) for e, c in got.items()}) == 2
    values = {r.metric: r.value for r in out.quality.collect()}
    assert values["ICP"] == 0.0 and values["IFN"] == 0.0 and values["NED"] == 1.0
