"""Golden answers for several demands, draws, and partitioned Monte Carlo."""

import numpy as np
import pytest
from fixtures import CONFIG, DEMANDS, multi, partitioned

from ecolattice.errors import CyclicDependencyGraph, InconsistentLCIA, MissingDatabaseDependencies
from ecolattice.operators.partitioned import PartitionedMonteCarloLCA, check_for_cycles
from ecolattice.plans.lca import FastScoresOnlyMultiLCA, MultiLCA
from ecolattice.plans.method_config import MethodConfig
from ecolattice.schema import TECHNOSPHERE
from ecolattice.sources.packages import PackageBuilder, get_package, read_package

FIRST, SECOND = ("first", "category"), ("second", "category")


def test_scores(spark):
    m = MultiLCA(DEMANDS, CONFIG, multi(spark))
    m.lci()
    with pytest.raises(ValueError):
        m.scores
    m.lcia()
    # The published answers of this system.
    assert m.scores == {k: pytest.approx(v) for k, v in {(FIRST, "γ"): 11, (SECOND, "γ"): 30, (FIRST, "ε"): 8.19, (SECOND, "ε"): 6.7, (FIRST, "ζ"): 28.2, (SECOND, "ζ"): 120}.items()}
    m.normalize()
    m.weight()
    s = m.scores
    assert s[(("w", "2"), ("n", "2"), SECOND, "ζ")] == pytest.approx(10080)
    assert s[(("w", "1"), ("n", "1"), FIRST, "γ")] == pytest.approx(126)
    assert len(s) == 6


def test_fast_scores(spark):
    m = FastScoresOnlyMultiLCA(DEMANDS, CONFIG, multi(spark), chunk=2)
    with pytest.raises(NotImplementedError):
        m.lci()
    with pytest.raises(ValueError):
        m.set_chunk_size(0)
    got = {r["fu"]: r["score"] for r in m.calculate().where("weighting like '%2%'").collect()}
    assert got == pytest.approx({"γ": 2520, "ε": 562.8, "ζ": 10080})


def test_draws(spark):
    m = MultiLCA(DEMANDS, {"impact_categories": [FIRST]}, multi(spark), use_distributions=True)
    one, two = m.run(4).collect(), m.run(4).collect()
    assert {(r["iteration"], r["fu"]): r["score"] for r in one} == pytest.approx({(r["iteration"], r["fu"]): r["score"] for r in two})
    assert len({round(r["score"], 9) for r in one if r["fu"] == "γ"}) == 4
    still = MultiLCA(DEMANDS, {"impact_categories": [FIRST]}, multi(spark))
    assert "iteration" not in still.run(4).columns


def test_demands_checked(spark):
    with pytest.raises(ValueError):
        MultiLCA({"a": {"x": 1}}, CONFIG, multi(spark))


@pytest.mark.parametrize("bad,error", [
    ({"impact_categories": ["a"], "normalizations": {"n": ["b"]}}, ValueError),
    ({"impact_categories": ["a"], "normalizations": {"a": ["a"]}}, ValueError),
    ({"impact_categories": ["a", "b"], "normalizations": {"n": ["a"]}}, InconsistentLCIA),
    ({"impact_categories": ["a"], "weightings": {"w": ["x"]}}, ValueError),
    ({"impact_categories": ["a"], "weightings": {"a": ["a"]}}, ValueError),
    ({"impact_categories": ["a"], "normalizations": {"n": ["a"]}, "weightings": {"n": ["a"]}}, ValueError),
    ({"impact_categories": ["a"], "normalizations": {"n": ["a"]}, "weightings": {"w": ["a", "n"]}}, InconsistentLCIA),
    ({"impact_categories": ["a", "b"], "weightings": {"w": ["a"]}}, InconsistentLCIA),
])
def test_method_config(bad, error):
    with pytest.raises(error):
        MethodConfig(**bad)


def test_partitioned(spark):
    packages = partitioned(spark)
    p = PartitionedMonteCarloLCA({30: 1}, ["grid"], packages)
    p.use_distributions = False
    p.lci()
    p.lcia()
    # The same system solved whole: supply of 330, 220, 110, then flows and factors.
    x = np.linalg.solve([[1, -0.25, 0], [0, 1, -2], [0, 0, 1]], [0, 0, 1])
    assert p.score == pytest.approx(np.array([3, 1]) @ np.array([[4, 0, 0.5], [0, 3, 0]]) @ x)
    drawn = [r["score"] for r in PartitionedMonteCarloLCA({30: 1}, ["grid"], packages).run(5).collect()]
    assert len({round(x, 9) for x in drawn}) == 5
    with pytest.raises(TypeError):
        PartitionedMonteCarloLCA({"x": 1}, ["grid"], packages)
    lost = PackageBuilder(spark, "x").vector(TECHNOSPHERE, [(3, 300)], [1]).build()
    with pytest.raises(MissingDatabaseDependencies):
        PartitionedMonteCarloLCA({3: 1}, [], [lost])
    with pytest.raises(CyclicDependencyGraph):
        check_for_cycles({"a": ["b"], "b": ["c"], "c": ["a"]})
    check_for_cycles({"a": ["b", "c"], "b": ["c"], "c": []})


def test_packages_round_trip(spark, tmp_path):
    p = multi(spark)[0]
    p.write(str(tmp_path / "p"))
    q = get_package(spark, str(tmp_path / "p"))
    assert q.resources == p.resources and q.seed == 1
    assert sorted(map(str, q.frame.collect())) == sorted(map(str, p.frame.select(*q.frame.columns).collect()))
    assert read_package(spark, str(tmp_path / "p")).name == "one"
    with pytest.raises(TypeError):
        get_package(spark, 1)
    with pytest.raises(TypeError):
        get_package(spark, "nowhere")
