"""The inverse leaves its tasks row by row, and no level of it is a table."""

import numpy as np
import pytest

from ecolattice.operators import numeric, solve

CELLS = "row_id long, col_id long, amount double"


def acyclic(at, n, rnd):
    rows = [(at + p, 100_000 + at + p, float(rnd.uniform(0.5, 2))) for p in range(n)]
    return rows + [(at + int(q), 100_000 + at + p, -0.3) for p in range(1, n) for q in set(rnd.integers(0, p, 3).tolist())]


def brute(rows):
    s = numeric.System(*(np.array(c) for c in zip(*rows)))
    x = np.linalg.inv(s.dense())
    return {(int(s.rows[r]), int(s.cols[c])): x[c, r] for c, r in zip(*np.nonzero(np.abs(x) > 1e-12))}


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_inverse_by_parts_of_systems(spark, monkeypatch, block):
    rnd = np.random.default_rng(4)
    # One system that several tasks share, one that has its own, and small ones that go together.
    rows = acyclic(0, 200, rnd) + acyclic(1000, 30, rnd) + [r for k in range(40) for r in acyclic(2000 + 10 * k, 3, rnd)]
    monkeypatch.setattr(solve, "solve_acyclic", lambda *a, **o: pytest.fail("the levels become tables"))
    monkeypatch.setattr(solve, "unit_supplies", lambda *a: numeric.unit_supplies(*a, block=block))
    a = spark.createDataFrame(rows, CELLS)
    found = solve.inverse(a, "acyclic").collect()
    want = brute(rows)
    assert len(found) == len(want)
    assert {(r["product_id"], r["activity_id"]): r["amount"] for r in found} == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
    twice = spark.createDataFrame([(i, r, c, v * (i + 1)) for i in (0, 1) for r, c, v in rows], "iteration long, " + CELLS)
    again = solve.inverse(twice, "acyclic").where("iteration = 1").collect()
    assert {(r["product_id"], r["activity_id"]): r["amount"] for r in again} == {k: pytest.approx(v / 2, rel=1e-9) for k, v in want.items()}


def test_a_cyclic_system_is_refused(spark):
    a = spark.createDataFrame([(1, 11, 1.0), (2, 12, 1.0), (1, 12, -0.5), (2, 11, -0.5)], CELLS)
    with pytest.raises(Exception, match="cyclic"):
        solve.inverse(a, "acyclic").collect()
