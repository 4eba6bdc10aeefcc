"""Matrices from exchanges: sign, duplicates, overrides, restriction to known rows and columns."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InconsistentGlobalIndex, MultipleValues, NonsquareTechnosphere, UnsupportedDistribution
from ..functions.sampling import KNOWN, column_choice, draw, uniform
from ..schema import CHARACTERIZATION
from ..sources.packages import Package


def exchanges(packages: Sequence[Package], matrix: str) -> DataFrame | None:
    """All exchanges of a matrix in package order; None if no package has a group for it."""
    out = None
    for k, p in enumerate(packages):
        if any(r.matrix == matrix for r in p.resources):
            part = p.frame.where(F.col("matrix") == matrix).withColumns({"pkg_ord": F.lit(k), "sum_intra": F.lit(p.sum_intra_duplicates), "sum_inter": F.lit(p.sum_inter_duplicates)})
            out = part if out is None else out.unionByName(part)
    return out


def varies(packages: Sequence[Package], matrix: str, use_arrays: bool, use_distributions: bool) -> bool:
    """Whether the matrix has groups whose values depend on the iteration."""
    return any(r.matrix == matrix and ((use_arrays and r.category == "array") or (use_distributions and r.uncertain)) for p in packages for r in p.resources)


def iterations_frame(spark: SparkSession, iterations: Iterable[int]) -> DataFrame:
    """One row for each iteration number."""
    its = iterations if isinstance(iterations, range) else list(iterations)
    if isinstance(its, range):
        return spark.range(its.start, its.stop, its.step).withColumnRenamed("id", "iteration")
    return spark.createDataFrame([(int(i),) for i in its], "iteration long")


def build_matrix(
    packages: Sequence[Package], matrix: str, *, use_arrays: bool = False, use_distributions: bool = False, iterations: Iterable[int] | None = None, seed_override: int | None = None, by_identifier: bool = False, by_column: bool = False
) -> DataFrame | None:
    """([iteration,] row_id, col_id, amount) of a matrix; None if no package has a group for it.

    Flipped amounts are negated. Duplicates in a group are added up; of several
    groups with the same cell the last one counts, unless its package adds
    them up. Array groups are used only with use_arrays, distributions only
    with use_distributions. There is an iteration column only if values vary,
    and an identifier column with by_identifier: then groups of different
    identifiers are matrices of their own, built in one plan. With by_column
    exchanges travel once, by their column, and the cells stay so partitioned;
    a column must fit a task then.
    """
    rows = exchanges(packages, matrix)
    if rows is None:
        return None
    spark = rows.sparkSession
    if not use_arrays:
        rows = rows.where(F.col("category") != "array")
    keys = [*(["identifier"] if by_identifier else []), "row_id", "col_id"]
    value = F.col("amount")
    if varies(packages, matrix, use_arrays, use_distributions):
        # A handful of iteration numbers against the exchanges: the product is the result's own size.
        rows = rows.crossJoin(F.broadcast(iterations_frame(spark, [0] if iterations is None else iterations)))
        keys = ["iteration", *keys]
        it = F.col("iteration")
        if use_distributions:
            unknown = {r["t"] for r in rows.select(F.col("dist.uncertainty_type").alias("t")).where(F.col("t").isNotNull() & ~F.col("t").isin(*KNOWN)).distinct().limit(5).collect()}
            if unknown:
                raise UnsupportedDistribution(f"uncertainty types {sorted(unknown)}")
        value = None
        for k, p in enumerate(packages):
            seed = seed_override if seed_override is not None else p.seed if p.seed is not None else 0
            key = (F.lit(seed), it, F.lit(matrix), F.col("row_id"), F.col("col_id"))
            drawn = draw(F.col("dist"), F.col("amount"), uniform(*key), uniform(*key, F.lit("v"))) if use_distributions else F.col("amount")
            chosen = F.element_at("samples", column_choice(F.size("samples"), it, p.sequential, seed, p.name)) if use_arrays else F.lit(None)
            own = F.when(F.col("category") == "array", chosen).otherwise(drawn)
            value = F.when(F.col("pkg_ord") == k, own) if value is None else value.when(F.col("pkg_ord") == k, own)
    signed = rows.select(*keys, "pkg_ord", "group_ord", "sum_intra", "sum_inter", F.when(F.col("flip"), -value).otherwise(value).alias("amount"))
    if by_column:
        signed = signed.repartition("col_id")
    by = [*keys, "pkg_ord", "group_ord"]
    if all(p.sum_intra_duplicates for p in packages):
        groups = signed.groupBy(*by).agg(F.sum("amount").alias("amount"), F.first("sum_inter").alias("sum_inter"))
    else:
        # Of duplicates that are not added up the last row counts, in the order of the frame.
        placed = signed.withColumn("place", F.monotonically_increasing_id())
        groups = placed.groupBy(*by).agg(F.when(F.first("sum_intra"), F.sum("amount")).otherwise(F.max_by("amount", "place")).alias("amount"), F.first("sum_inter").alias("sum_inter"))
    order = F.struct("pkg_ord", "group_ord")
    if any(p.sum_inter_duplicates for p in packages):
        merged = groups.groupBy(*keys).agg(F.max_by("sum_inter", order).alias("add"), F.sum("amount").alias("total"), F.max_by("amount", order).alias("last"))
        return merged.select(*keys, F.when(F.col("add"), F.col("total")).otherwise(F.col("last")).alias("amount"))
    return groups.groupBy(*keys).agg(F.max_by("amount", order).alias("amount"))


def dimension(matrix: DataFrame, column: str) -> DataFrame:
    """(id): the distinct ids of a matrix's rows or columns."""
    return matrix.select(F.col(column).alias("id")).distinct()


def numbered(ids: DataFrame) -> DataFrame:
    """(id, idx): ids with consecutive numbers from 0 in ascending order, without gathering them in one task."""
    spread = ids.sort("id").rdd.map(lambda r: r[0]).zipWithIndex()
    return spread.toDF("id long, idx long")


def check_square(technosphere: DataFrame) -> None:
    """Raises unless there are as many products as activities."""
    found = technosphere.agg(F.countDistinct("row_id").alias("rows"), F.countDistinct("col_id").alias("cols")).first()
    if found["rows"] != found["cols"]:
        raise NonsquareTechnosphere(f"{found['cols']} activities (columns) and {found['rows']} products (rows); use least squares or fix the data")


def restrict(matrix: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is known elsewhere."""
    return matrix.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_semi")


def global_index(packages: Sequence[Package], matrix: str = CHARACTERIZATION) -> int | None:
    """The one global location that all resources of the matrix name (None counts as a value)."""
    found = {r.global_index for p in packages for r in p.resources if r.matrix == matrix}
    if len(found) > 1:
        raise InconsistentGlobalIndex(f"several global locations: {sorted(found, key=str)}")
    return found.pop() if found else None


def diagonal(packages: Sequence[Package], matrix: str, flows: DataFrame, *, region: int | None = None, **options) -> DataFrame:
    """([iteration,] [identifier,] row_id, amount): a diagonal matrix over known flows, only of one region if given.

    No group for the matrix is an error; groups without any rows are a warning.
    """
    rows = [p.only(lambda r: True, (F.col("matrix") != matrix) | (F.col("col_id") == region)) for p in packages] if region is not None else packages
    built = build_matrix(rows, matrix, **options)
    if built is None:
        raise ValueError(f"No data for {matrix}")
    keys = [c for c in built.columns if c not in ("col_id", "amount")]
    out = restrict(built, "row_id", flows).groupBy(*keys).agg(F.sum("amount").alias("amount"))
    if exchanges(packages, matrix).isEmpty():
        warnings.warn(f"All values for {matrix} are empty")
    return out


def single_value(packages: Sequence[Package], matrix: str, custom_filter=None, **options) -> DataFrame:
    """([iteration,] amount): the one value of a single-value diagonal matrix; custom_filter is a column over exchanges."""
    rows = packages if custom_filter is None else [p.only(lambda r: True, (F.col("matrix") != matrix) | custom_filter) for p in packages]
    built = build_matrix(rows, matrix, **options)
    if built is None:
        raise ValueError(f"No data for {matrix}")
    cells = built.select("row_id", "col_id").distinct().limit(2).count()
    if cells != 1:
        raise MultipleValues(f"{matrix} must have exactly one value")
    return built.drop("row_id", "col_id")
