"""Partitioned Monte Carlo: static databases are solved once, and only the foreground is drawn again and again."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import CyclicDependencyGraph, DemandInStaticDatabase, MissingDatabaseDependencies, OutsideTechnosphere, StaticDependsOnStochastic
from ..operators.inventory import inventory
from ..operators.lineage import cut
from ..operators.matrix import build_matrix
from ..operators.solve import production_exchanges, supply
from ..plans.lca import LCA
from ..schema import BIOSPHERE, CHARACTERIZATION, TECHNOSPHERE
from ..sources.packages import Package, Resource, package_from_frame


def clean_name(name: str) -> str:
    """A database name as it stands in package and group names."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in name)


#: Endings that a database's groups may have after its name.
SUFFIXES = tuple(f"_{m}_matrix" for m in ("technosphere", "biosphere", "characterization", "normalization", "weighting"))


def is_static(resource: Resource, package: Package, names: Iterable[str]) -> bool:
    """Whether a group belongs to a static database, by its own name or its package's."""
    clean = [clean_name(n) for n in names]
    own = any(resource.group == n or any(resource.group.startswith(n + s) for s in SUFFIXES) for n in clean)
    return own or package.name in {*names, *clean}


def classify(packages: Sequence[Package], static: Iterable[str]) -> dict[str, list[Package]]:
    """Packages split by group into method (characterization), static and stochastic; other matrices are dropped."""
    out: dict[str, list[Package]] = {"method": [], "static": [], "stochastic": []}
    for p in packages:
        for bucket in out:
            def belongs(r, p=p, bucket=bucket):
                if r.matrix == CHARACTERIZATION:
                    return bucket == "method"
                return r.matrix in (TECHNOSPHERE, BIOSPHERE) and bucket == ("static" if is_static(r, p, static) else "stochastic")

            groups = [r.group for r in p.resources if belongs(r)]
            if groups:
                out[bucket].append(p.only(belongs, F.col("group").isin(groups)))
    return out


def check_for_cycles(graph: Mapping[str, Iterable[str]]) -> None:
    """Raises if the databases depend on each other in a circle."""
    state: dict[str, int] = {}
    for root in graph:
        stack = [(root, iter(graph.get(root, ())))]
        if state.get(root) == 2:
            continue
        state[root] = 1
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if state.get(n) == 1:
                    raise CyclicDependencyGraph(f"{n} depends on itself")
                if n not in state:
                    state[n] = 1
                    stack.append((n, iter(graph.get(n, ()))))
                    break
            else:
                state[node] = 2
                stack.pop()


def validate(packages: Sequence[Package], static: Iterable[str]) -> None:
    """Dependencies must be stated, acyclic, and never lead from a static to a stochastic database."""
    static = set(static)
    graph = {}
    for p in packages:
        if any(r.matrix in (TECHNOSPHERE, BIOSPHERE) for r in p.resources):
            if p.database_dependencies is None:
                raise MissingDatabaseDependencies(p.name)
            graph[p.name] = [d for d in p.database_dependencies if d != p.name]
    names = static | {clean_name(s) for s in static}
    for name, deps in graph.items():
        if name in names and any(d in graph and d not in names for d in deps):
            raise StaticDependsOnStochastic(name)
    check_for_cycles(graph)


def interface_products(technosphere):
    """(product_id): products that the foreground uses and doesn't make."""
    made = production_exchanges(technosphere).select("product_id")
    return technosphere.select(F.col("row_id").alias("product_id")).distinct().join(made, "product_id", "left_anti")


def static_background(static: Sequence[Package], products, solver="auto"):
    """(product_id, row_id, amount): flows of one unit of each interface product, from the static databases."""
    a, b = build_matrix(static, TECHNOSPHERE), build_matrix(static, BIOSPHERE)
    known = a.select(F.col("row_id").alias("product_id")).distinct()
    missing = products.join(known, "product_id", "left_anti").limit(5).collect()
    if missing:
        raise OutsideTechnosphere(f"no database makes {[r[0] for r in missing]}")
    demands = products.select(F.col("product_id").cast("string").alias("fu"), "product_id", F.lit(1.0).alias("amount"))
    cells = inventory(b, supply(cut(a), demands, solver))
    return cells.groupBy(F.col("fu").cast("long").alias("product_id"), "row_id").agg(F.sum("amount").alias("amount"))


class PartitionedMonteCarloLCA(LCA):
    """An LCA with distributions whose static databases are replaced by their solved flows."""

    def __init__(self, demand: Mapping[int, float], static_databases: Iterable[str], packages: Sequence[Package], seed_override: int | None = None, solver=None):
        if not all(isinstance(k, int) for k in demand):
            raise TypeError("demand keys must be integers")
        self.static_databases = list(static_databases)
        validate(packages, self.static_databases)
        parts = classify(packages, self.static_databases)
        dynamic = self._dynamic(parts, demand)
        super().__init__(demand, [*parts["stochastic"], *dynamic, *parts["method"]], use_distributions=True, seed_override=seed_override, solver=solver)

    @staticmethod
    def _dynamic(parts: dict[str, list[Package]], demand: Mapping[int, float]) -> list[Package]:
        """A package with a stand-in activity for each interface product: one unit of production, and aggregated flows."""
        if not parts["stochastic"]:
            raise ValueError("no stochastic database")
        foreground = cut(build_matrix(parts["stochastic"], TECHNOSPHERE))
        made = {r[0] for r in production_exchanges(foreground).where(F.col("product_id").isin([int(k) for k in demand])).select("product_id").collect()}
        lost = set(demand) - made
        if lost and parts["static"]:
            static_rows = build_matrix(parts["static"], TECHNOSPHERE)
            if not static_rows.where(F.col("row_id").isin([int(k) for k in lost])).isEmpty():
                raise DemandInStaticDatabase(f"{sorted(lost)}")
        if not parts["static"]:
            return []
        products = interface_products(foreground)
        products = cut(products)
        flows = cut(static_background(parts["static"], products))
        # Stand-ins are numbered below zero, so they can't meet an activity's id.
        stand_in = (-F.col("product_id") - 1).alias("col_id")
        rows = products.select(F.lit(TECHNOSPHERE).alias("matrix"), F.col("product_id").alias("row_id"), stand_in, F.lit(1.0).alias("amount"))
        rows = rows.unionByName(flows.select(F.lit(BIOSPHERE).alias("matrix"), "row_id", stand_in, "amount"))
        return [replace(package_from_frame("background", rows, [Resource("background_t", TECHNOSPHERE), Resource("background_b", BIOSPHERE)]))]
