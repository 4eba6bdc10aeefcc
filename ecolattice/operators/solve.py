"""A x = f for many demands and iterations."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OutsideTechnosphere, SingularTechnosphere
from .lineage import cut, filed, release
from .numeric import System, solve, unit_supplies

#: Levels of an acyclic system, at most; deeper ones are taken for cyclic.
MAX_LEVELS = 200
#: Cells up to which a system goes to a task as it is.
TASK_CELLS = 5_000_000


def _cells(technosphere: DataFrame) -> int:
    """Cells of one iteration, at most."""
    per = technosphere.groupBy("iteration").count().agg(F.max("count")) if "iteration" in technosphere.columns else technosphere.agg(F.count("*"))
    return per.first()[0] or 0


def check_products(demands: DataFrame, technosphere: DataFrame) -> None:
    """Raises if a demanded id is no product: a ValueError for activities, else OutsideTechnosphere."""
    wanted = demands.select(F.col("product_id").alias("id")).distinct()
    unknown = wanted.join(technosphere.select(F.col("row_id").alias("id")).distinct(), "id", "left_anti")
    found = unknown.join(technosphere.select(F.col("col_id").alias("id"), F.lit(True).alias("activity")).distinct(), "id", "left").limit(20).collect()
    if any(r["activity"] for r in found):
        raise ValueError(f"activities, not products, are demanded: {sorted(r['id'] for r in found if r['activity'])}")
    if found:
        raise OutsideTechnosphere(f"not in the technosphere: {sorted(r['id'] for r in found)}")


def production_exchanges(technosphere: DataFrame) -> DataFrame:
    """([iteration,] product_id, activity_id, amount): the one positive cell of each column that has just one.

    A column with several positive cells has no unambiguous production and is left out.
    """
    keys = [c for c in technosphere.columns if c == "iteration"] + ["col_id"]
    found = technosphere.where("amount > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.min("row_id").alias("product_id"), F.min("amount").alias("amount")).where("n = 1")
    if technosphere.where("amount > 0").isEmpty():
        raise ValueError("no production exchanges")
    return found.select(*keys[:-1], "product_id", F.col("col_id").alias("activity_id"), "amount")


def unfit_for_joins(technosphere: DataFrame) -> str | None:
    """Why production by joins would not solve the same system: None if each activity makes one product, and each product has one maker."""
    by = [c for c in technosphere.columns if c == "iteration"]
    positive = F.col("amount") > 0
    if not technosphere.groupBy(*by, "col_id").agg(F.count_if(positive).alias("n")).where("n <> 1").isEmpty():
        return "an activity has several products or none"
    if not technosphere.groupBy(*by, "row_id").agg(F.count_if(positive).alias("n")).where("n <> 1").isEmpty():
        return "a product has several makers or none"
    return None


def cyclic(technosphere: DataFrame) -> bool:
    """Whether a product needs itself, in a system that fits joins: inputs that need nothing go, until none is left or none goes."""
    by = [c for c in technosphere.columns if c == "iteration"]
    made = production_exchanges(technosphere).select(*by, F.col("product_id").alias("consumer"), F.col("activity_id").alias("col_id"))
    left = cut(technosphere.where("amount < 0").join(made, [*by, "col_id"]).select(*by, "consumer", F.col("row_id").alias("input")))
    before, n = None, left.count()
    while n and n != before:
        left = cut(left.join(left.select(*by, F.col("consumer").alias("input")).distinct(), [*by, "input"], "left_semi"))
        before, n = n, left.count()
    return n > 0


def solve_acyclic(technosphere: DataFrame, demands: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """([iteration,] fu, activity_id, amount) by following inputs level by level with joins.

    Exact for systems whose products don't depend on themselves; raises
    SingularTechnosphere if they still do after max_levels, and ValueError
    unless each activity makes one product that nothing else makes. Every
    level is a join on the product and a pre-aggregated sum, so only what the
    demands reach is read on.
    """
    reason = unfit_for_joins(technosphere)
    if reason:
        raise ValueError(f"{reason}; use a numeric solver")
    by = ["iteration"] if "iteration" in technosphere.columns else []
    make = cut(production_exchanges(technosphere).withColumnRenamed("amount", "per_unit"))
    inputs = technosphere.where("amount < 0").withColumnRenamed("col_id", "activity_id").join(make, [*by, "activity_id"])
    inputs = cut(inputs.select(*by, F.col("product_id").alias("consumer"), F.col("row_id").alias("input"), (-F.col("amount") / F.col("per_unit")).alias("share")))
    level = demands.select("fu", "product_id", "amount")
    if by:
        level = make.select("iteration").distinct().crossJoin(F.broadcast(level))
    level = level.groupBy(*by, "fu", "product_id").agg(F.sum("amount").alias("amount")).where("amount <> 0")
    needed, k = level, 0
    while True:
        nxt = level.join(inputs.withColumnRenamed("consumer", "product_id"), [*by, "product_id"]).groupBy(*by, "fu", "input").agg(F.sum(F.col("amount") * F.col("share")).alias("amount")).where("amount <> 0")
        nxt = cut(nxt.withColumnRenamed("input", "product_id").select(*by, "fu", "product_id", "amount"))
        if nxt.isEmpty():
            break
        k += 1
        if k > max_levels:
            raise SingularTechnosphere("the technosphere is cyclic; use a numeric solver")
        needed, level = needed.unionByName(nxt), nxt
    total = needed.groupBy(*by, "fu", "product_id").agg(F.sum("amount").alias("amount"))
    return total.join(make, [*by, "product_id"]).select(*by, "fu", "activity_id", (F.col("amount") / F.col("per_unit")).alias("amount"))


def reached(technosphere: DataFrame, demands: DataFrame) -> DataFrame:
    """The cells of the activities that the demands reach, by joins; all cells if products and activities can't be paired.

    Each activity is paired with the product of its largest positive cell. If
    those are all products, once each, the activities of the demanded products,
    of the products these touch, and so on are a square system of their own:
    none of its columns has a cell in another row. Its solution, and zero
    elsewhere, solves the whole system. Nothing outside is looked at.
    """
    by = [c for c in technosphere.columns if c == "iteration"]
    keys = [*by, "col_id"]
    pairs = cut(technosphere.where("amount > 0").groupBy(*keys).agg(F.max_by("row_id", F.struct("amount", "row_id")).alias("product_id")))
    n = pairs.count()
    if n != pairs.select(*by, "product_id").distinct().count() or any(n != technosphere.select(*by, c).distinct().count() for c in ("row_id", "col_id")):
        return technosphere
    columns = reached_columns(technosphere, pairs, demands)
    return technosphere.join(broadcast_ids(columns), keys, "left_semi")


def broadcast_ids(ids: DataFrame) -> DataFrame:
    """Ids marked for a broadcast up to a million (eight bytes each), so that a large other side stays where it is."""
    return F.broadcast(ids) if ids.count() <= 1_000_000 else ids


def reached_columns(cells: DataFrame, pairs: DataFrame, demands: DataFrame) -> DataFrame:
    """([iteration,] col_id) of the activities that the demands reach: from product to paired activity to the products of its cells, and so on."""
    by = [c for c in pairs.columns if c == "iteration"]
    keys = [*by, "col_id"]
    new = demands.select("product_id").distinct()
    if by:
        new = pairs.select(*by).distinct().crossJoin(F.broadcast(new))
    seen = pairs.select(*keys).limit(0)
    while True:
        columns = cut(pairs.join(new, [*by, "product_id"], "left_semi").select(*keys))
        if columns.isEmpty():
            return cut(seen)
        seen = seen.unionByName(columns)
        known = pairs.join(broadcast_ids(seen), keys, "left_semi").select(*by, "product_id")
        met = cells.join(broadcast_ids(columns), keys, "left_semi").select(*by, F.col("row_id").alias("product_id")).distinct()
        new = cut(met.join(known, [*by, "product_id"], "left_anti"))


def sure_makers(rows: DataFrame, drawn: bool) -> DataFrame | None:
    """(product_id, col_id) if, whatever is drawn, one cell of each activity can be positive, and those are all products, once each; else None.

    rows: exchanges; drawn: whether their distributions count.
    """
    d, flip = F.col("dist"), F.coalesce("flip", F.lit(False))
    ends = F.when(flip, -F.least(d["minimum"], d["maximum"])).otherwise(F.greatest(d["minimum"], d["maximum"]))
    fixed = F.when(flip, -F.col("amount")).otherwise(F.col("amount")) > 0
    kind = d["uncertainty_type"]
    may = F.when(F.col("category") == "array", F.lit(True))
    if drawn:
        may = may.when(d.isNotNull() & kind.isin(4, 5), ends > 0).when(d.isNotNull() & (kind != 0), F.lit(True))
    makers = cut(rows.where(F.coalesce(may.otherwise(fixed), F.lit(True))).select(F.col("row_id").alias("product_id"), "col_id").distinct())
    n = makers.count()
    whole = n and all(n == ids.distinct().count() for ids in (makers.select("product_id"), makers.select("col_id"), rows.select("row_id"), rows.select("col_id")))
    return makers if whole else None


def solve_numeric(technosphere: DataFrame, demands: DataFrame, solver="auto", chunk: int = 50, **options) -> DataFrame:
    """([iteration,] fu, activity_id, amount) by a numpy solver, one task per iteration and chunk of demands.

    Of systems over TASK_CELLS cells only what the demands reach is taken
    along, if `reached` can tell. That system of one iteration must fit a task
    (16 bytes a cell and a few vectors); demands are solved `chunk` at a time
    as columns of one system.
    """
    if _cells(technosphere) > TASK_CELLS:
        check_products(demands, technosphere)
        technosphere = reached(technosphere, demands)
    by = ["iteration"] if "iteration" in technosphere.columns else []
    fus = [r["fu"] for r in demands.select("fu").distinct().sort("fu").collect()]
    spark = technosphere.sparkSession
    chunks = spark.createDataFrame([(fu, k // chunk) for k, fu in enumerate(fus)], "fu string, chunk int")
    left = technosphere if by else technosphere.withColumn("iteration", F.lit(0).cast("long"))
    left = left.crossJoin(F.broadcast(spark.range(max(1, -(-len(fus) // chunk))).select(F.col("id").cast("int").alias("chunk"))))
    # Fresh column identities: both sides come from the same matrix.
    its = [r[0] for r in left.select("iteration").distinct().collect()] if by else [0]
    numbers = spark.createDataFrame([(i,) for i in its], "iteration long")
    right = demands.join(F.broadcast(chunks), "fu").crossJoin(F.broadcast(numbers))

    def group(key, a: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        s = System(a["row_id"].to_numpy(), a["col_id"].to_numpy(), a["amount"].to_numpy())
        names = sorted(d["fu"].unique())
        f = np.zeros((s.shape[0], len(names)))
        at = np.searchsorted(s.rows, d["product_id"].to_numpy())
        if len(d) and ((at >= s.shape[0]) | (s.rows[np.minimum(at, s.shape[0] - 1)] != d["product_id"].to_numpy())).any():
            raise OutsideTechnosphere("a demanded product is not in the technosphere")
        np.add.at(f, (at, np.searchsorted(names, d["fu"])), d["amount"].to_numpy())
        x = solve(s, f, solver, **options)
        c, k = np.nonzero(x)
        return pd.DataFrame({"iteration": int(key[0]), "fu": np.array(names, object)[k] if len(names) else [], "activity_id": s.cols[c], "amount": x[c, k]})

    found = left.groupBy("iteration", "chunk").cogroup(right.groupBy("iteration", "chunk")).applyInPandas(group, "iteration long, fu string, activity_id long, amount double")
    return found if by else found.drop("iteration")




def supply(technosphere: DataFrame, demands: DataFrame, solver="auto", chunk: int = 50, **options) -> DataFrame:
    """([iteration,] fu, activity_id, amount): what each activity supplies to meet each demand.

    solver: auto, acyclic (joins), dense, gmres, cgs, least_squares, or a
    callable (System, right-hand side) -> solution. auto counts the cells:
    systems that fit a task are solved there, larger ones by joins if those
    give the same answer (one product an activity, one maker a product, no
    cycle), otherwise still in a task.
    """
    if solver == "acyclic":
        return solve_acyclic(technosphere, demands, **options)
    if solver == "auto":
        if _cells(technosphere) > TASK_CELLS and not unfit_for_joins(technosphere) and not cyclic(technosphere):
            return solve_acyclic(technosphere, demands, **{"max_levels": sys.maxsize, **options})
    return solve_numeric(technosphere, demands, solver, chunk, **options)


def _classes(edges: DataFrame, now: DataFrame) -> DataFrame:
    """(product_id, class): the least class of `now` that edges lead to, in whatever direction; only tables of products travel."""
    ids = lambda df, name, value: (F.broadcast(df) if small else df).select(F.col("product_id").alias(name), F.col("class").alias(value))
    small = now.count() <= 2_000_000
    while True:
        met = edges.join(ids(now, "consumer", "a"), "consumer").join(ids(now, "input", "b"), "input").where("a <> b")
        # Each class goes to the least one that it meets.
        least = cut(met.groupBy(F.greatest("a", "b").alias("from")).agg(F.min(F.least("a", "b")).alias("to")))
        if least.isEmpty():
            return now
        moved = now.join(F.broadcast(least) if small else least, now["class"] == least["from"], "left")
        now = cut(moved.select("product_id", F.coalesce("to", "class").alias("class")))


def _columns(technosphere: DataFrame) -> DataFrame:
    """([iteration,] activity_id, product_id, per_unit, inputs, amounts): a row for each activity, as a table; raises as `unfit_for_joins` would.

    The cells travel once, or not at all if they come partitioned by column.
    """
    by = [c for c in technosphere.columns if c == "iteration"]
    made = F.coalesce(F.col("amount") > 0, F.lit(False))
    cells = F.collect_list(F.when(~made, F.struct("row_id", F.coalesce("amount", F.lit(0.0)).alias("amount"))))
    one = technosphere.groupBy(*by, F.col("col_id").alias("activity_id")).agg(F.count_if(made).alias("n"), F.min(F.when(made, F.col("row_id"))).alias("product_id"), F.min(F.when(made, F.col("amount"))).alias("per_unit"), cells.alias("cells"))
    columns = filed(one.select(*by, "activity_id", "n", "product_id", "per_unit", F.col("cells.row_id").alias("inputs"), F.col("cells.amount").alias("amounts")))
    release(columns)
    if columns.isEmpty():
        raise ValueError("no production exchanges")
    if not columns.where("n <> 1").isEmpty():
        raise ValueError("an activity has several products or none; use a numeric solver")
    made = columns.select(*by, "product_id")
    alone = made.groupBy(*by, "product_id").count().where("count > 1").isEmpty()
    products = broadcast_ids(made)
    if not alone or not columns.select(*by, F.explode("inputs").alias("product_id")).join(products, [*by, "product_id"], "left_anti").isEmpty():
        raise ValueError("a product has several makers or none; use a numeric solver")
    return columns.drop("n")


def inverse_rows(technosphere: DataFrame) -> DataFrame:
    """([iteration,] product_id, activity_ids, amounts) of an acyclic system: the inverse, a row for each product.

    Products that lead to each other, in whatever direction, are a system of
    their own. Each goes to a task, or, with its cells repeated, to several if
    it has more than a task's share of all cells; small ones go together. The
    result is as large as the sum of all supplies, so it leaves the task row by
    row and is written nowhere. One system must fit a task (about 100 bytes a
    cell). A cyclic one fails there with SingularTechnosphere.

    Cells are kept and sent as arrays, one row for each activity.
    """
    by = [c for c in technosphere.columns if c == "iteration"]
    columns = _columns(technosphere)
    edge = lambda inputs: columns.select(F.col("product_id").alias("consumer"), F.explode(inputs).alias("input"))
    # Two inputs of each product link most of what belongs together, so that few of all edges are left to be told of.
    alone = cut(columns.select("product_id").distinct().select("product_id", F.col("product_id").alias("class")))
    some = _classes(cut(edge(F.array(F.array_min("inputs"), F.array_max("inputs"))).where("input is not null")), alone)
    classes = _classes(edge("inputs"), some)
    mark = lambda df: F.broadcast(df) if df.count() <= 2_000_000 else df
    known = mark(classes)
    sizes = columns.select("product_id", F.size("inputs").alias("cells")).join(known, "product_id").groupBy("class").agg(F.countDistinct("product_id").alias("products"), F.sum("cells").alias("cells"))
    sizes = cut(sizes.select("class", "products", (F.col("cells") + F.col("products")).alias("cells")))
    whole, tasks = sizes.agg(F.sum("cells")).first()[0] or 1, technosphere.sparkSession.sparkContext.defaultParallelism
    groups = max(tasks, -(-whole // 1_000_000))
    own = F.col("cells") * 8 * groups >= whole
    parts = F.least(F.greatest(F.round(F.col("cells") * tasks / whole), F.lit(1)), F.ceil(F.col("products") / 64)).cast("int")
    dealt = sizes.select("class", F.when(own, F.col("class")).otherwise(F.pmod(F.xxhash64("class"), F.lit(groups))).alias("bucket"), own.alias("own"), F.when(own, parts).otherwise(1).alias("parts"))
    rows = columns if by else columns.withColumn("iteration", F.lit(0).cast("long"))
    rows = rows.join(known, "product_id").join(mark(dealt), "class").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["iteration", "own", "bucket", "part"]
    release(columns)

    def supplies(table: pa.Table):
        iteration, part, parts = (table.column(c)[0].as_py() for c in ("iteration", "part", "parts"))
        product = table.column("product_id").to_numpy()
        order = np.argsort(product, kind="stable")
        activity, per_unit = (table.column(c).to_numpy() for c in ("activity_id", "per_unit"))
        d = pc.list_value_length(table.column("inputs")).to_numpy()
        inp, amount = (pc.list_flatten(table.column(c)).to_numpy() for c in ("inputs", "amounts"))
        consumer, share = np.repeat(product, d), -amount / np.repeat(per_unit, d)
        # In order of inputs, so that sums are the same however cells were dealt out.
        keep = np.argsort(inp, kind="stable")
        keep = keep[amount[keep] != 0]
        products, activity, per_unit = product[order], activity[order], per_unit[order]
        for of, starts, at, amounts in unit_supplies(products, consumer[keep], inp[keep], share[keep], np.arange(part, len(products), parts)):
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in (activity[at], amounts / per_unit[at])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), iteration)), pa.array(products[of]), *lists], ["iteration", "product_id", "activity_ids", "amounts"])

    def run(batches):
        # Rows come sorted by the key, so a group ends where the key changes.
        held, last = [], None
        for b in batches:
            if not b.num_rows:
                continue
            ends = [tuple(b.column(c)[k].as_py() for c in key) for k in (0, b.num_rows - 1)]
            names = ends[:1] * b.num_rows if ends[0] == ends[1] else list(zip(*(b.column(c).to_pylist() for c in key)))
            at = 0
            while at < len(names):
                if names[at] != last and held:
                    yield from supplies(pa.Table.from_batches(held))
                    held = []
                last, to = names[at], at
                while to < len(names) and names[to] == last:
                    to += 1
                held.append(b.slice(at, to - at))
                at = to
        if held:
            yield from supplies(pa.Table.from_batches(held))

    sorted_rows = rows.select(*key, "parts", "product_id", "activity_id", "per_unit", "inputs", "amounts").repartition(4 * groups, *key).sortWithinPartitions(*key)
    found = sorted_rows.mapInArrow(run, "iteration long, product_id long, activity_ids array<long>, amounts array<double>")
    return found if by else found.drop("iteration")


def inverse(technosphere: DataFrame, solver="auto", chunk: int = 200) -> DataFrame:
    """([iteration,] product_id, activity_id, amount): the supply for one unit of every product."""
    if solver == "acyclic" or (solver == "auto" and _cells(technosphere) > TASK_CELLS and not unfit_for_joins(technosphere) and not cyclic(technosphere)):
        rows = inverse_rows(technosphere).withColumn("cell", F.explode(F.arrays_zip("activity_ids", "amounts")))
        return rows.select(*[c for c in rows.columns if c == "iteration"], "product_id", F.col("cell.activity_ids").alias("activity_id"), F.col("cell.amounts").alias("amount"))
    units = technosphere.select(F.col("row_id").cast("string").alias("fu"), F.col("row_id").alias("product_id"), F.lit(1.0).alias("amount")).distinct()
    found = supply(technosphere, units, solver, chunk)
    return found.withColumn("product_id", F.col("fu").cast("long")).drop("fu")


class SupplyCache:
    """Unit supplies by product, solved once and scaled for any demand on known products (by linearity)."""

    def __init__(self, technosphere: DataFrame, solver="auto"):
        self.technosphere, self.solver, self.products, self.units = technosphere, solver, set(), None

    def __contains__(self, product: int) -> bool:
        return product in self.products

    def __len__(self) -> int:
        return len(self.products)

    def __iter__(self):
        return iter(sorted(self.products))

    def add(self, products) -> None:
        """Solves for products that are not there yet; known ones keep their supply."""
        new = sorted(set(products) - self.products)
        if not new:
            return
        spark = self.technosphere.sparkSession
        units = spark.createDataFrame([(str(p), int(p), 1.0) for p in new], "fu string, product_id long, amount double")
        found = supply(self.technosphere, units, self.solver).withColumn("product_id", F.col("fu").cast("long")).drop("fu")
        found = cut(found)
        self.units = found if self.units is None else self.units.unionByName(found)
        self.products |= set(new)

    def reset(self) -> None:
        self.products, self.units = set(), None

    def supply(self, demands: DataFrame) -> DataFrame:
        """([iteration,] fu, activity_id, amount) from unit supplies."""
        self.add(r["product_id"] for r in demands.select("product_id").distinct().collect())
        by = [c for c in self.units.columns if c == "iteration"]
        scaled = demands.select("fu", "product_id", F.col("amount").alias("times")).join(self.units, "product_id")
        return scaled.groupBy(*by, "fu", "activity_id").agg(F.sum(F.col("amount") * F.col("times")).alias("amount")).where("amount <> 0")
