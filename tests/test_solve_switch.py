"""The automatic solver gives the same supply below and above its switch of size."""

import pytest

from ecolattice.operators import solve

CELLS = "row_id long, col_id long, amount double"
SYSTEMS = {
    "by-product": [(1, 11, 1.0), (2, 11, 0.2), (2, 12, 1.0)],
    "negative maker": [(1, 11, 1.0), (2, 11, -2.0), (2, 12, -1.0)],
    "cycle": [(1, 11, 1.0), (2, 11, -0.5), (2, 12, 1.0), (1, 12, -0.5)],
    "chain": [(1, 11, 2.0), (2, 11, -0.5), (2, 12, 1.0), (3, 12, -3.0), (3, 13, 1.0)],
}


@pytest.mark.parametrize("name", SYSTEMS)
def test_same_supply_on_both_sides(spark, monkeypatch, name):
    a = spark.createDataFrame(SYSTEMS[name], CELLS)
    f = spark.createDataFrame([("x", 1, 1.0)], "fu string, product_id long, amount double")
    answer = lambda: {r["activity_id"]: pytest.approx(r["amount"], abs=1e-9) for r in solve.supply(a, f).collect()}
    want = answer()
    monkeypatch.setattr(solve, "TASK_CELLS", 0)
    assert answer() == want and want


def test_cycles_are_found(spark):
    assert not solve.cyclic(spark.createDataFrame(SYSTEMS["chain"], CELLS))
    assert solve.cyclic(spark.createDataFrame(SYSTEMS["cycle"], CELLS))


@pytest.mark.parametrize("name", ["by-product", "negative maker"])
def test_join_solver_refuses_what_it_cannot_solve(spark, name):
    f = spark.createDataFrame([("x", 1, 1.0)], "fu string, product_id long, amount double")
    with pytest.raises(ValueError, match="numeric solver"):
        solve.solve_acyclic(spark.createDataFrame(SYSTEMS[name], CELLS), f)
