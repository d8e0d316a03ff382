"""What the solver and the views leave on disk and send, and that results need none of what was removed."""

import os

import numpy as np
import pytest

from facetgraph import session
from facetgraph.operators import spectral, views


def held(spark) -> int:
    top = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names if not x.startswith("."))


@pytest.fixture(scope="module")
def ring(spark):
    rows = [(f"n{x:03d}", f"n{(x + s) % 200:03d}", 1.0) for x in range(200) for step in (1, 7, 31) for s in (step, -step)]
    return spark.createDataFrame(rows, "i string, j string, w double")


def test_rounds_leave_the_basis_only(spark, ring):
    """Every round is removed by the one after it; before, each of them stayed on disk."""
    stack = spectral.stack_views({"ring": ring}, ring.select("i").distinct())
    before = held(spark)
    basis = spectral.smallest_eigenvectors(stack, [1.0], 5, width=8)
    assert basis.rounds > 2
    one = 200 * 8 * 8  # bytes of a basis
    assert held(spark) - before < 8 * one
    rows = basis.rows.orderBy("i").select(*[f"y{c}" for c in range(5)]).toPandas().to_numpy()
    assert np.allclose(rows.T @ rows, np.eye(5), atol=1e-5)
    session.release(basis.rows)
    spectral.unstack(stack)


def test_a_basis_block_goes_to_its_line_of_the_grid(spark, ring, monkeypatch):
    """Sums come from as many tasks as the grid is wide, not from all of them; a pair is held once."""
    monkeypatch.setattr(spectral, "SLICE_ROWS", 60)
    stack = spectral.stack_views({"ring": ring}, ring.select("i").distinct())
    n, tasks = stack.cells.blocks[0], len(stack.cells.tasks)
    assert n > 3 and tasks == n * (n + 1) // 2
    assert sum(r.n for r in stack.cells.packs.select("n").collect()) == 200 * 6 // 2 + 200
    affinity = spectral.Affinity.build(stack, [1.0])
    basis = stack.nodes.selectExpr("i", "cast(substr(i, 2) AS double) AS y0")
    parts = affinity.step(affinity.blocks(basis, ["y0"]), 1, alpha=0.0, beta=1.0)
    sent = parts.filter("copy").selectExpr("sum(size(ids)) AS n").first().n
    assert sent <= 200 * (n + 1) < 200 * tasks
    got = {r.i: r.y0 for r in spectral._plain(spectral._merged(parts), 1).collect()}
    want = {x: sum((x + s) % 200 for step in (1, 7, 31) for s in (step, -step)) / 6 for x in range(200)}
    assert all(got[f"n{x:03d}"] == pytest.approx(want[x]) for x in want)
    spectral.unstack(stack)


def test_directed_repeated_and_missing_cells(spark):
    """Halves of both orders are added, a loop counts with its diagonal only; what names no entity, and a missing weight, adds nothing."""
    cells = [("a", "b", 2.0), ("b", "a", 1.0), ("a", "b", 2.0), ("a", "a", 3.0), ("a", "x", 5.0), (None, "b", 1.0), ("b", "c", None), ("c", "b", 4.0)]
    view = spark.createDataFrame(cells, "i string, j string, w double")
    everyone = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "i string")
    for diagonal, want in ((False, {"a": 2.5, "b": 4.5, "c": 2.0}), (True, {"a": 5.5, "b": 4.5, "c": 2.0})):
        stack = spectral.stack_views({"v": view}, everyone, keep_diagonal=diagonal)
        assert {r.i: r.d0 for r in stack.nodes.collect()} == pytest.approx(want) and stack.n == 3
        spectral.unstack(stack)


def test_large_tables_are_kept_in_compressed_columns(spark):
    rows = spark.range(200_000).selectExpr("concat('Supplier#', lpad(cast(id % 1000 AS string), 9, '0')) AS a", "concat('Supplier#', lpad(cast(id % 997 AS string), 9, '0')) AS b", "cast(id % 5 AS double) AS w")
    before = held(spark)
    view = views.scale_by_max(rows)
    assert held(spark) - before < 200_000 * 8
    assert view.agg({"w": "max"}).first()[0] == 1.0 and view.count() == 200_000
