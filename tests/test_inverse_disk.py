"""The inverse sends the cells once, and keeps a row for each activity."""

import pytest

from ecolattice.operators import matrix, solve
from ecolattice.schema import TECHNOSPHERE
from ecolattice.sources.packages import PackageBuilder


def test_cells_travel_once_and_are_kept_by_activity(spark, monkeypatch):
    b = PackageBuilder(spark, "chain")
    b.vector(TECHNOSPHERE, [(k, 100 + k) for k in range(6)], [2.0] * 6)
    pairs = [(q, 100 + p) for p in range(6) for q in range(p)]
    b.vector(TECHNOSPHERE, pairs, [0.5 if q else 0.0 for q, _ in pairs], [True] * len(pairs))
    kept, filed = [], solve.filed
    monkeypatch.setattr(solve, "filed", lambda df: kept.append(df) or filed(df))
    rows = solve.inverse_rows(matrix.build_matrix([b.build()], TECHNOSPHERE, by_column=True)).collect()
    assert [df.count() for df in kept] == [6]
    assert kept[0]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {(r["product_id"], a): v for r in rows for a, v in zip(r["activity_ids"], r["amounts"])}
    # Product 0 is an input of zero, so nothing needs it; the others need a quarter of each before them.
    want = {(p, 100 + q): 0.5 * (1 if p == q else 0.25 * 1.25 ** (p - q - 1)) for p in range(6) for q in range(p + 1) if q or not p}
    assert found == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("rows, why", [([(1, 11, 1.0), (2, 11, 1.0), (2, 12, 1.0)], "several products"), ([(1, 11, 1.0), (1, 12, 1.0)], "several makers"), ([(1, 11, 1.0), (2, 11, -0.5)], "several makers")])
def test_unpaired_systems_are_refused(spark, rows, why):
    with pytest.raises(ValueError, match=why):
        solve.inverse_rows(spark.createDataFrame(rows, "row_id long, col_id long, amount double"))
