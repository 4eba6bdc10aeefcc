"""Large systems: only what the demands reach goes to a task, and blocks are solved densely one by one."""

import numpy as np
import pytest

from ecolattice.operators import numeric, solve

CELLS = "row_id long, col_id long, amount double"


def system(n=400, seed=3, cycles=True):
    """Products 0..n-1 in rings of three that need earlier rings, and as many that the demand doesn't reach."""
    rnd, rows = np.random.default_rng(seed), []
    for at in (0, 10_000):
        for p in range(n):
            rows.append((at + p, 100_000 + at + p, float(rnd.uniform(0.5, 2))))
            if cycles:
                rows.append((at + 3 * (p // 3) + (p + 1) % 3, 100_000 + at + p, -0.3)) if 3 * (p // 3) + 2 < n else None
            for q in {int(x) for x in rnd.integers(0, max(1, 3 * (p // 3)), 2)} if p >= 3 else ():
                rows.append((at + q, 100_000 + at + p, -0.2))
        rows.append((at + 7, 100_000 + at + n - 1, -0.1))
    return rows


def dense(rows, demand):
    s = numeric.System(*(np.array(c) for c in zip(*rows)))
    f = np.zeros(s.shape[0])
    f[np.searchsorted(s.rows, list(demand))] = list(demand.values())
    return {int(c): v for c, v in zip(s.cols, np.linalg.solve(s.dense(), f))}


@pytest.mark.parametrize("solver", ["dense", "gmres", "cgs", "least_squares"])
def test_only_the_reach_is_solved(spark, monkeypatch, solver):
    rows = system(30)
    a = spark.createDataFrame(rows, CELLS)
    f = spark.createDataFrame([("x", 29, 2.0)], "fu string, product_id long, amount double")
    want = {k: v for k, v in dense(rows, {29: 2.0}).items() if abs(v) > 1e-9}
    monkeypatch.setattr(solve, "TASK_CELLS", 10)
    kept = solve.reached(a, f)
    assert kept.count() < len(rows) / 2 + 2 and kept.where("col_id >= 110000").isEmpty()
    found = {r["activity_id"]: r["amount"] for r in solve.supply(a, f, solver).collect() if abs(r["amount"]) > 1e-9}
    assert found == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}


def test_unpaired_systems_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(solve, "TASK_CELLS", 0)
    a = spark.createDataFrame([(1, 11, 1.0), (2, 11, 0.2), (1, 12, 1.0), (2, 12, -1.0)], CELLS)
    f = spark.createDataFrame([("x", 1, 1.0)], "fu string, product_id long, amount double")
    assert solve.reached(a, f).count() == 4
    assert {r["activity_id"]: pytest.approx(r["amount"]) for r in solve.supply(a, f, "dense").collect()} == {11: 1 / 1.2, 12: 0.2 / 1.2}


def test_dense_needs_the_largest_block_only(monkeypatch):
    rows = system(n=3000, cycles=True)
    s = numeric.System(*(np.array(c) for c in zip(*rows)))
    f = np.zeros((s.shape[0], 1))
    f[np.searchsorted(s.rows, 2999), 0] = 1.0
    monkeypatch.setattr(numeric.System, "dense", lambda self: pytest.fail("6,000 x 6,000 at once"))
    x = numeric.solve(s, f, "dense")
    assert np.abs(s.times(x[:, 0]) - f[:, 0]).max() < 1e-9 and np.count_nonzero(x)


def test_cgs_reaches_a_narrow_goal():
    rows = system(n=900, cycles=False)
    s = numeric.System(*(np.array(c) for c in zip(*rows)))
    f = np.zeros(s.shape[0])
    f[np.searchsorted(s.rows, 899)] = 1e6
    x, good = numeric.cgs(s.times, f, rtol=1e-12)
    assert good and np.linalg.norm(s.times(x) - f) <= 1e-10 * 1e6


def test_draws_of_the_reach_only(spark, monkeypatch):
    from fixtures import U

    from ecolattice.plans.lca import LCA
    from ecolattice.schema import BIOSPHERE, CHARACTERIZATION, TECHNOSPHERE
    from ecolattice.sources.packages import PackageBuilder

    b = PackageBuilder(spark, "two chains", seed=5)
    b.vector(TECHNOSPHERE, [(1, 101), (2, 102), (2, 101), (3, 103), (4, 104), (4, 103)], [1, 1, 0.5, 1, 1, 0.5], [False, False, True] * 2, [None, None, U(0.2, 0.8)] * 2)
    b.vector(BIOSPHERE, [(7, 101), (7, 102), (7, 103), (8, 104)], [1, 2, 3, 4], distributions=[U(0.5, 1.5)] * 4)
    b.vector(CHARACTERIZATION, [(7, 0), (8, 0)], [1, 10], global_index=0)
    lca = LCA({1: 2}, [b.build()], solver="acyclic", use_distributions=True)
    for m in lca._lci_matrices(range(4)):
        assert {(r["iteration"], r["col_id"]) for r in m.collect()} == {(i, c) for i in range(4) for c in (101, 102)}
    scores = lambda: {r["iteration"]: r["score"] for r in lca.run(4).collect()}
    found = scores()
    monkeypatch.setattr(LCA, "_reached", lambda self: self.packages)
    assert found == pytest.approx(scores()) and len(set(found.values())) == 4


def test_uncertain_makers_keep_the_whole_system(spark):
    from fixtures import U

    from ecolattice.operators.matrix import exchanges
    from ecolattice.schema import TECHNOSPHERE
    from ecolattice.sources.packages import PackageBuilder

    def makers(low):
        b = PackageBuilder(spark, "signs")
        b.vector(TECHNOSPHERE, [(1, 11), (2, 12), (2, 11)], [1, 1, 0.5], [False, False, True], [None, None, U(low, 0.8)])
        return solve.sure_makers(exchanges([b.build()], TECHNOSPHERE), True)

    assert sorted(map(tuple, makers(0.2).collect())) == [(1, 11), (2, 12)]
    assert makers(-0.2) is None
