"""NN-descent goes on until little changes, the search until nothing is left to expand; recall above one block."""

import numpy as np
from pyspark.sql import functions as F

from ecolattice.llm import nn_descent
from ecolattice.llm.common import Rounds


def test_search_walks_to_the_end_of_a_chain(spark):
    # Every node knows only the next one, and each is a better answer than the one before.
    n = 12
    nodes = spark.createDataFrame([(i, np.array([1.0 + i, 1.0]).tobytes()) for i in range(n)], "node long, x binary")
    near = [(i, nn_descent.pack(np.array([i + 1]), np.array([1.0], np.float32))) for i in range(n - 1)]
    found = nn_descent.search(nodes, spark.createDataFrame(near, "node long, near binary"), spark.createDataFrame([(0, 0)], "query_id long, node long"), 3).collect()
    assert n - 1 in {r["node"] for r in found}


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    kept, sizes = Rounds(spark, "test"), []
    state = kept(spark.range(20).selectExpr("id % 4 as part", "id"))
    for _ in range(4):
        state = kept(nn_descent._together(state, state, lambda a, b: a, "part long, id long"))
        sizes.append(int(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert state.count() == 20
    assert max(sizes) < 1_000_000


def test_rounds_go_on_while_neighbours_change(spark, monkeypatch):
    rounds = []

    def descend(graph, codes, k, reverse, introduced):
        rounds.append(1)
        return graph.withColumn("changed", F.lit(k if len(rounds) < 6 else 0))

    monkeypatch.setattr(nn_descent, "descend", descend)
    x = np.random.default_rng(0).normal(size=(50, 4))
    nn_descent.build_graph(spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "node long, x binary"))
    assert len(rounds) == 6


def test_recall_above_a_block_with_a_hot_cluster(spark):
    # 5,000 vectors of one tight cluster, more than a block holds, and 4,000 others.
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=16) * 3 + 0.3 * rng.normal(size=(5000, 16)), rng.normal(size=(4000, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nn_descent.neighbours(vectors, every=40).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = {"hot": [], "other": []}
    for q in range(0, len(x), 40):
        s = x @ x[q]
        s[q] = -np.inf
        recall["hot" if q < 5000 else "other"].append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    print({k: round(float(np.mean(v)), 4) for k, v in recall.items()})
    assert all(np.mean(v) > 0.95 for v in recall.values())
