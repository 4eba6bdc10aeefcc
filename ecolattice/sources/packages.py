"""Packages: named bundles of exchange groups with metadata, as one DataFrame each.

Sources are in-memory arrays, Parquet folders, DataFrames, and folders or zip
files of `.npy` resources with a `datapackage.json`.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EXCHANGES, label


@dataclass(frozen=True)
class Resource:
    """One group: what it is about, even if it has no rows."""

    group: str
    matrix: str
    category: str = "vector"
    identifier: str | None = None
    global_index: int | None = None
    uncertain: bool = False


@dataclass(frozen=True)
class Package:
    """Exchanges in the schema of `EXCHANGES`, the groups they belong to, and how groups combine."""

    name: str
    frame: DataFrame
    resources: tuple[Resource, ...]
    seed: int | None = None
    sequential: bool = False
    sum_intra_duplicates: bool = True
    sum_inter_duplicates: bool = False
    database_dependencies: tuple[str, ...] | None = None

    def only(self, keep, condition) -> Package:
        """The package without the resources that `keep` refuses; `condition` is the same as a column."""
        return replace(self, resources=tuple(r for r in self.resources if keep(r)), frame=self.frame.where(condition))

    def of_matrix(self, matrix: str) -> Package:
        return self.only(lambda r: r.matrix == matrix, F.col("matrix") == matrix)

    def without_matrix(self, matrix: str) -> Package:
        return self.only(lambda r: r.matrix != matrix, F.col("matrix") != matrix)

    def write(self, path: str) -> None:
        """Exchanges as Parquet, partitioned by matrix, and the metadata as JSON lines beside it; any Hadoop path."""
        self.frame.write.mode("overwrite").partitionBy("matrix").parquet(f"{path}/exchanges")
        meta = {k: getattr(self, k) for k in ("name", "seed", "sequential", "sum_intra_duplicates", "sum_inter_duplicates", "database_dependencies")}
        meta["resources"] = [r.__dict__ for r in self.resources]
        self.frame.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_package(spark: SparkSession, path: str) -> Package:
    """A package that `Package.write` wrote."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
    resources = tuple(Resource(**r) for r in meta.pop("resources"))
    deps = meta.pop("database_dependencies")
    frame = spark.read.parquet(f"{path}/exchanges").select(*[F.col(f.name).cast(f.dataType) for f in EXCHANGES])
    return Package(frame=frame, resources=resources, database_dependencies=None if deps is None else tuple(deps), **meta)


def has_matrix(packages: Iterable[Package], name: str) -> bool:
    """Whether any package has a group for the matrix `{name}_matrix`, be it empty."""
    return any(r.matrix == f"{name}_matrix" for p in packages for r in p.resources)


def filter_by_identifier(packages: Sequence[Package], identifier) -> list[Package]:
    """Each package with only the resources of that identifier; packages may end up empty."""
    wanted = label(identifier)
    return [p.only(lambda r: r.identifier == wanted, F.col("identifier") == wanted) for p in packages]


@dataclass
class PackageBuilder:
    """Collects groups of exchanges given as plain sequences."""

    spark: SparkSession
    name: str = "package"
    seed: int | None = None
    sequential: bool = False
    sum_intra_duplicates: bool = True
    sum_inter_duplicates: bool = False
    database_dependencies: Sequence[str] | None = None
    _rows: list = field(default_factory=list)
    _resources: list = field(default_factory=list)

    def _add(self, matrix, indices, category, values, flip, dists, identifier, global_index, group) -> PackageBuilder:
        order = len(self._resources)
        group = group or f"{self.name}_{matrix}_{order}"
        self._resources.append(Resource(group, matrix, category, label(identifier), global_index, dists is not None))
        for k, (r, c) in enumerate(indices):
            amount, samples = (None, [float(v) for v in values[k]]) if category == "array" else (float(values[k]), None)
            dist = None if dists is None or dists[k] is None else _distribution(dists[k])
            self._rows.append((order, group, matrix, category, label(identifier), global_index, int(r), int(c), amount, samples, bool(flip[k]) if flip is not None else False, dist))
        return self

    def vector(self, matrix: str, indices, data, flip=None, distributions=None, identifier=None, global_index=None, group=None) -> PackageBuilder:
        """One amount for each (row, col); distributions: (type, loc, scale, shape, minimum, maximum[, negative]) or None each."""
        return self._add(matrix, indices, "vector", data, flip, distributions, identifier, global_index, group)

    def array(self, matrix: str, indices, samples, flip=None, identifier=None, global_index=None, group=None) -> PackageBuilder:
        """A row of scenario values for each (row, col)."""
        return self._add(matrix, indices, "array", samples, flip, None, identifier, global_index, group)

    def build(self) -> Package:
        deps = None if self.database_dependencies is None else tuple(self.database_dependencies)
        return Package(self.name, self.spark.createDataFrame(self._rows, EXCHANGES), tuple(self._resources), self.seed, self.sequential, self.sum_intra_duplicates, self.sum_inter_duplicates, deps)


def _distribution(d) -> tuple:
    numbers = [None if v is None or np.isnan(v) else float(v) for v in d[1:6]]
    return (int(d[0]), *numbers, bool(d[6]) if len(d) > 6 else False)


def package_from_frame(name: str, frame: DataFrame, resources: Sequence[Resource], **meta) -> Package:
    """A package over any DataFrame that has some of the schema's columns; the others are null."""
    columns = [(F.col(f.name) if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EXCHANGES]
    out = frame.select(*columns).withColumns({"flip": F.coalesce("flip", F.lit(False)), "category": F.coalesce("category", F.lit("vector")), "group_ord": F.coalesce("group_ord", F.lit(0))})
    return Package(name, out, tuple(resources), **meta)


def get_package(spark: SparkSession, source) -> Package:
    """A package from a Package, a Parquet folder written by this engine, or a folder or zip of `.npy` resources."""
    if isinstance(source, Package):
        return source
    if isinstance(source, (str, os.PathLike)):
        path = os.fspath(source)
        if path.endswith(".zip"):
            return read_npy(spark, path)
        if os.path.isdir(path) and os.path.exists(os.path.join(path, "datapackage.json")):
            return read_npy(spark, path)
        if "://" in path or os.path.isdir(path):
            return read_package(spark, path)
    raise TypeError(f"Can't make a package of {type(source).__name__}: {source!r}")


def read_npy(spark: SparkSession, path: str) -> Package:
    """A package from `datapackage.json` and `.npy` resources, in a folder or a zip file on the driver.

    Resources of a group are of kind indices, data, distributions or flip;
    `allow_pickle` is off.
    """
    if path.endswith(".zip"):
        with zipfile.ZipFile(path) as z:
            files = {n: z.read(n) for n in z.namelist()}
    else:
        files = {n: open(os.path.join(path, n), "rb").read() for n in os.listdir(path)}
    meta = json.loads(files["datapackage.json"])
    load = lambda r: np.load(io.BytesIO(files[r["path"]]), allow_pickle=False)
    groups: dict[str, dict] = {}
    for r in meta["resources"]:
        groups.setdefault(r["group"], {})[r["kind"]] = r
    build = PackageBuilder(spark, meta.get("name", "package"), meta.get("seed"), bool(meta.get("sequential")), meta.get("sum_intra_duplicates", True), meta.get("sum_inter_duplicates", False), meta.get("database_dependencies"))
    for name, kinds in groups.items():
        head = kinds["indices"]
        indices = [(int(x["row"]), int(x["col"])) for x in load(head)]
        flip = load(kinds["flip"]).astype(bool) if "flip" in kinds else None
        dists = [tuple(d.item()) for d in load(kinds["distributions"])] if "distributions" in kinds else None
        data = load(kinds["data"]) if "data" in kinds else np.array([d[1] for d in dists or []], float)
        common = {"flip": flip, "identifier": head.get("identifier"), "global_index": head.get("global_index"), "group": name}
        if head.get("category") == "array":
            build.array(head["matrix"], indices, data, **common)
        else:
            build.vector(head["matrix"], indices, data, distributions=dists, **common)
    return build.build()
