"""One registered query for each operator, over the derived system, and its equivalent in DuckDB's SQL.

Float results are rounded to six decimals on both sides, since sums are
associated differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import matrix as mat
from ..operators import solve as sol
from ..operators.contribution import annotate, contributions, mapped, pivoted, remap
from ..operators.partitioned import PartitionedMonteCarloLCA, classify, interface_products, static_background
from ..schema import BIOSPHERE, CHARACTERIZATION, NORMALIZATION, TECHNOSPHERE, WEIGHTING
from ..sources.packages import Resource, filter_by_identifier, has_matrix, package_from_frame
from . import derived as d
from .lca import LCA, FastScoresOnlyMultiLCA, MultiLCA, demand_frame

QUERIES: dict = {}
SQL: dict[str, str] = {}
ITERATIONS = 5


def _query(sql: str | None = None, system: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"with {d.SQL_SYSTEM.strip()}\n{sql}" if system else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("amount",)})


def single(spark: SparkSession, sf: str, *names: str, solver="acyclic", **options) -> LCA:
    s = d.system(spark, sf)
    return LCA(d.SINGLE, [s["inventory"], s["method"], *[s[n] for n in names]], solver=solver, **options)


def multi(spark: SparkSession, sf: str, kind=MultiLCA, solver="acyclic", weighted=True, **options):
    s = d.system(spark, sf)
    config = d.CONFIG if weighted else {"impact_categories": d.CONFIG["impact_categories"]}
    return kind(d.DEMANDS, config, list(s.values())[:4], solver=solver, **options)


def _loaded(lca):
    lca.load_lci_data()
    return lca


def _assessed(lca, *verbs: str):
    for v in ("lci", "lcia", *verbs):
        getattr(lca, v)()
    return lca


T = f"(select product as row_id, product + {d.OFFSET} as col_id, cast(1 as double) as amount from (select p_partkey as product from part) union all select inp, con + {d.OFFSET}, -amount from w)"


# sources and matrices
@_query(f"select 'technosphere_matrix' as matrix, count(*) as n, round(sum(amount), 6) as total from (select 1.0::double as amount from part union all select amount from w) union all select 'biosphere_matrix', count(*), round(sum(amount), 6) from bio union all select 'characterization_matrix', 2 * count(*), round(sum(factor + 100), 6) from cf")
def scan_exchanges(spark, sf):
    s = d.system(spark, sf)
    rows = s["inventory"].frame.unionByName(s["method"].frame)
    return rounded(rows.groupBy("matrix").agg(F.count("*").alias("n"), F.sum("amount").alias("total")), "total")


@_query("select * from (values ('technosphere', true), ('biosphere', true), ('weighting', false)) t(label, present)", system=False)
def has_matrix_query(spark, sf):
    s = d.system(spark, sf)
    packages = [s["inventory"], s["method"]]
    return spark.createDataFrame([(n, has_matrix(packages, n)) for n in ("technosphere", "biosphere", "weighting")], "label string, present boolean")


QUERIES["has_matrix"], SQL["has_matrix"] = QUERIES.pop("has_matrix_query"), SQL.pop("has_matrix_query")


@_query("select flow as row_id, factor as amount from cf where r_name = 'ASIA'")
def filter_identifier(spark, sf):
    kept = filter_by_identifier([d.system(spark, sf)["method"]], "ASIA")[0]
    return kept.frame.where("col_id = 0").select("row_id", "amount")


@_query(f"select row_id, col_id, round(amount, 6) as amount from {T}")
def technosphere_matrix(spark, sf):
    return rounded(mat.build_matrix([d.system(spark, sf)["inventory"]], TECHNOSPHERE))


@_query(f"select flow as row_id, part + {d.OFFSET} as col_id, round(amount, 6) as amount from bio")
def biosphere_matrix(spark, sf):
    return rounded(_loaded(single(spark, sf)).biosphere_matrix)


@_query("select flow as row_id, factor as amount from cf where flow in (select flow from bio)")
def characterization_matrix(spark, sf):
    lca = _loaded(single(spark, sf))
    lca.load_lcia_data()
    return lca.characterization_matrix


@_query("select flow as row_id, round(factor, 6) as amount from nf where flow in (select flow from bio)")
def normalization_matrix(spark, sf):
    lca = _loaded(single(spark, sf, "normalization"))
    lca.load_normalization_data()
    return rounded(lca.normalization_matrix)


@_query("select distinct flow as row_id, cast(2.5 as double) as amount from bio")
def weighting_matrix(spark, sf):
    lca = _loaded(single(spark, sf, "weight"))
    lca.load_weighting_data()
    return lca.biosphere_matrix.select("row_id").distinct().crossJoin(F.broadcast(lca.weighting_value))


@_query("select '\"' || r_name || '\"' as lcia, flow as row_id, factor as amount from cf where flow in (select flow from bio)")
def multi_characterization(spark, sf):
    m = _loaded(multi(spark, sf))
    m.load_lcia_data()
    return m.characterization_matrix.select("lcia", "row_id", "amount")


@_query("select '\"norm ' || r_name || '\"' as normalization, flow as row_id, round(factor, 6) as amount from nf where flow in (select flow from bio)")
def multi_normalization(spark, sf):
    m = _loaded(multi(spark, sf))
    m.load_normalization_data()
    return rounded(m.normalization_matrix.select("normalization", "row_id", "amount"))


@_query("select '\"weight ' || r_name || '\"' as weighting, value as amount from wf")
def multi_weighting(spark, sf):
    m = multi(spark, sf)
    m.load_weighting_data()
    return m.weighting_value.select("weighting", "amount")


@_query("select cast(0 as bigint) as global_index", system=False)
def global_index(spark, sf):
    return spark.createDataFrame([(mat.global_index([d.system(spark, sf)["method"]]),)], "global_index long")


# demands and supply
@_query("select product as product_id, sum(amount) as amount from fu group by all")
def demand_vector(spark, sf):
    lca = _loaded(single(spark, sf))
    lca._set_demand(None)
    return lca.demands.groupBy("product_id").agg(F.sum("amount").alias("amount"))


@_query("select fu, product as product_id, amount from fu")
def multi_demand(spark, sf):
    m = _loaded(multi(spark, sf))
    m._set_demand(None)
    return m.demands


XS = f"select product + {d.OFFSET} as activity_id, round(amount, 6) as amount from xs where round(amount, 6) <> 0"
XF = f"select fu, product + {d.OFFSET} as activity_id, round(amount, 6) as amount from x where round(amount, 6) <> 0"


def _supply(spark, sf, solver, **options) -> DataFrame:
    a = mat.build_matrix([d.system(spark, sf)["inventory"]], TECHNOSPHERE)
    return rounded(sol.supply(a, demand_frame(spark, {"demand": d.SINGLE}), solver, **options).select("activity_id", "amount")).where("amount <> 0")


@_query(XS)
def supply_vector(spark, sf):
    return _supply(spark, sf, "acyclic")


@_query(XS)
def supply_gmres(spark, sf):
    return _supply(spark, sf, "gmres")


@_query(XS)
def supply_iterative(spark, sf):
    return _supply(spark, sf, "cgs", rtol=1e-12)


@_query(XS)
def supply_dense(spark, sf):
    return _supply(spark, sf, "dense")


@_query(XS)
def supply_least_squares(spark, sf):
    return _supply(spark, sf, "least_squares")


@_query(XF)
def supply_many(spark, sf):
    a = mat.build_matrix([d.system(spark, sf)["inventory"]], TECHNOSPHERE)
    return rounded(sol.supply(a, demand_frame(spark, d.DEMANDS), "gmres", chunk=2)).where("amount <> 0")


def _cached(spark, sf):
    a = mat.build_matrix([d.system(spark, sf)["inventory"]], TECHNOSPHERE)
    return rounded(sol.SupplyCache(a, "acyclic").supply(demand_frame(spark, d.DEMANDS))).where("amount <> 0")


@_query(XF)
def supply_cached(spark, sf):
    return _cached(spark, sf)


@_query(XS)
def supply_factorized(spark, sf):
    lca = single(spark, sf)
    lca.lci(factorize=True)
    return rounded(lca.supply_array.select("activity_id", "amount")).where("amount <> 0")


@_query(f"""select product_id, count(*) as n, round(sum(amount), 6) as total from (
  select product_id, product, sum(amount) as amount from (
    select p_partkey as product_id, p_partkey as product, cast(1 as double) as amount from part
    union all select con, inp, amount from w
    union all select a.con, b.inp, a.amount * b.amount from w a join w b on a.inp = b.con
    union all select a.con, c.inp, a.amount * b.amount * c.amount from w a join w b on a.inp = b.con join w c on b.inp = c.con) group by all) group by product_id""")
def inverse_technosphere(spark, sf):
    a = mat.build_matrix([d.system(spark, sf)["inventory"]], TECHNOSPHERE, by_column=True)
    total = F.aggregate("amounts", F.lit(0.0), lambda x, y: x + y)
    return rounded(sol.inverse_rows(a).select("product_id", F.size("activity_ids").cast("long").alias("n"), total.alias("total")), "total")


# inventories
CELL = f"flow as row_id, part + {d.OFFSET} as col_id, round(amount, 6) as amount"


def _cells(df: DataFrame, *labels: str) -> DataFrame:
    return rounded(df.select(*labels, "row_id", "col_id", "amount"))


@_query(f"select {CELL} from gs where amount <> 0")
def inventory(spark, sf):
    lca = single(spark, sf)
    lca.lci()
    return _cells(lca.inventory)


@_query(f"select fu, {CELL} from g where amount <> 0")
def multi_inventory(spark, sf):
    m = multi(spark, sf)
    m.lci()
    return _cells(m.inventory, "fu")


@_query(f"select {CELL} from hs where amount <> 0")
def characterized_inventory(spark, sf):
    return _cells(_assessed(single(spark, sf)).characterized_inventory)


@_query(f"select fu, '\"' || r_name || '\"' as lcia, {CELL} from h where amount <> 0")
def multi_characterized(spark, sf):
    return _cells(_assessed(multi(spark, sf)).characterized_inventory, "fu", "lcia")


@_query(f"select {CELL} from ns where amount <> 0")
def normalized(spark, sf):
    return _cells(_assessed(single(spark, sf, "normalization"), "normalize").normalized_inventory)


@_query(f"select fu, '\"' || r_name || '\"' as lcia, '\"norm ' || r_name || '\"' as normalization, {CELL} from n where amount <> 0")
def multi_normalized(spark, sf):
    return _cells(_assessed(multi(spark, sf), "normalize").normalized_inventory, "fu", "lcia", "normalization")


@_query(f"select flow as row_id, part + {d.OFFSET} as col_id, round(amount * 2.5::double, 6) as amount from ns where amount <> 0")
def weighted(spark, sf):
    return _cells(_assessed(single(spark, sf, "normalization", "weight"), "normalize", "weight").weighted_inventory)


@_query(f"select fu, '\"' || r_name || '\"' as lcia, '\"weight ' || r_name || '\"' as weighting, flow as row_id, part + {d.OFFSET} as col_id, round(amount * value, 6) as amount from n join wf using (r_name) where amount <> 0")
def multi_weighted(spark, sf):
    return _cells(_assessed(multi(spark, sf), "normalize", "weight").weighted_inventory, "fu", "lcia", "weighting")


@_query("select fu, '\"' || r_name || '\"' as lcia, '\"norm ' || r_name || '\"' as normalization, round(sum(amount), 6) as amount from n where amount <> 0 group by all")
def restricted_join(spark, sf):
    m = _assessed(multi(spark, sf))
    m.load_normalization_data()
    allowed = inv.restrictions_frame(spark, m.config.texts("normalizations"), "normalization", "lcia")
    cells = inv.restricted(m.characterized_inventory, m.normalization_matrix, allowed, "lcia", "normalization")
    return rounded(cells.groupBy("fu", "lcia", "normalization").agg(F.sum("amount").alias("amount")))


# scores
@_query("select round(sum(amount), 6) as score from hs")
def score(spark, sf):
    return rounded(inv.score(_assessed(single(spark, sf)).characterized_inventory), "score")


@_query("select round(sum(amount) * 3, 6) as score from hs")
def switch_method(spark, sf):
    lca = _assessed(single(spark, sf))
    cf = d.system(spark, sf)["method"].frame.where("col_id = 0").withColumn("amount", F.col("amount") * 3)
    lca.switch_method([package_from_frame("other", cf, [Resource("other", CHARACTERIZATION, global_index=0)])])
    lca.lcia()
    return rounded(inv.score(lca.characterized_inventory), "score")


GRID = "(select distinct fu from fu) cross join (select r_name from wf)"


@_query(f"select fu, '\"' || r_name || '\"' as lcia, round(coalesce(sum(amount), 0), 6) as score from {GRID} left join h using (fu, r_name) group by all")
def multi_scores(spark, sf):
    return rounded(_assessed(multi(spark, sf)).score_frame(), "score").select("fu", "lcia", "score")


W_SCORES = f"select fu, '\"' || r_name || '\"' as lcia, '\"norm ' || r_name || '\"' as normalization, '\"weight ' || r_name || '\"' as weighting, round(coalesce(sum(amount * value), 0), 6) as score from {GRID} join wf using (r_name) left join n using (fu, r_name) group by all"


@_query(W_SCORES)
def multi_scores_weighted(spark, sf):
    return rounded(_assessed(multi(spark, sf), "normalize", "weight").score_frame(), "score").select("fu", "lcia", "normalization", "weighting", "score")


@_query(f"select '\"' || r_name || '\"' as lcia, part + {d.OFFSET} as col_id, round(sum(amount * factor), 6) as amount from bio join cf using (flow) group by all")
def precalculated(spark, sf):
    m = _loaded(multi(spark, sf, FastScoresOnlyMultiLCA, weighted=False))
    return rounded(m.build_precalculated())


@_query(W_SCORES)
def fast_scores(spark, sf):
    m = multi(spark, sf, FastScoresOnlyMultiLCA)
    return rounded(m.calculate(), "score").select("fu", "lcia", "normalization", "weighting", "score")


@_query("select '\"' || r_name || '\"' as lcia, " + ", ".join(f"round(coalesce(sum(amount) filter (where fu = 'fu{k}'), 0), 6) as fu{k}" for k in range(5)) + " from wf left join h using (r_name) group by r_name")
def fast_scores_wide(spark, sf):
    m = multi(spark, sf, FastScoresOnlyMultiLCA, weighted=False)
    return pivoted(rounded(m.calculate(), "score"), "lcia", "fu")


@_query("select '\"' || r_name || '\"' as lcia, round(coalesce(sum(amount), 0), 6) as score from wf left join (select * from h where fu = 'fu1') using (r_name) group by r_name")
def grid_slice(spark, sf):
    scores = multi(spark, sf, FastScoresOnlyMultiLCA, weighted=False).calculate()
    return rounded(scores.where("fu = 'fu1'").select("lcia", "score"), "score")


# contribution tables
@_query(f"select {CELL} from hs where amount <> 0 order by abs(hs.amount) desc, row_id, col_id limit 200")
def to_dataframe_number(spark, sf):
    return _cells(_assessed(single(spark, sf)).to_dataframe())


@_query(f"select {CELL} from hs where abs(amount) > (select sum(amount) from hs) * 0.001")
def to_dataframe_fraction(spark, sf):
    return _cells(_assessed(single(spark, sf)).to_dataframe(cutoff=0.001, cutoff_mode="fraction"))


@_query(f"select t.*, n_name as row_key, 'act' || (col_id - {d.OFFSET}) as col_key from (select {CELL} from hs where amount <> 0 order by abs(hs.amount) desc, row_id, col_id limit 50) t join nation on n_nationkey = row_id")
def to_dataframe_mapped(spark, sf):
    lca = _assessed(single(spark, sf))
    rows = d.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("key"))
    cols = d.read(spark, sf, "part").select((F.col("p_partkey") + d.OFFSET).alias("id"), F.concat(F.lit("act"), F.col("p_partkey")).alias("key"))
    return rounded(mapped(contributions(lca.characterized_inventory, 50).drop("fu"), rows, cols))


@_query(f"""select t.row_id, t.col_id, t.amount, n_name as row_name, 'flow' as row_type, 'nature::air' as row_categories, 'part ' || (col_id - {d.OFFSET}) as col_name, 'process' as col_type
from (select {CELL} from hs where amount <> 0 order by abs(hs.amount) desc, row_id, col_id limit 50) t join nation on n_nationkey = row_id""")
def to_dataframe_annotated(spark, sf):
    lca = _assessed(single(spark, sf))
    empty = F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    flows = d.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("bio").alias("database"), text(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"), empty.alias("location"), F.lit("kg").alias("unit"), F.lit("flow").alias("type"), F.array(F.lit("nature"), F.lit("air")).alias("categories"), empty.alias("product"))
    acts = d.read(spark, sf, "part").select((F.col("p_partkey") + d.OFFSET).alias("id"), F.lit("db").alias("database"), text(F.col("p_partkey")).alias("code"), F.concat(F.lit("part "), F.col("p_partkey")).alias("name"), empty.alias("location"), F.lit("piece").alias("unit"), empty.alias("type"), F.lit(None).cast("array<string>").alias("categories"), empty.alias("product"))
    found = annotate(contributions(lca.characterized_inventory, 50), flows.unionByName(acts))
    return rounded(found.select("row_id", "col_id", "amount", "row_name", "row_type", "row_categories", "col_name", "col_type"))


@_query("select case when product % 2 = 1 and product < 10 then 'part-' || product else cast(product as varchar) end as product_id, round(amount, 6) as amount from (select product, sum(amount) as amount from fu group by all)")
def remap_query(spark, sf):
    keys = spark.createDataFrame([(p, f"part-{p}") for p in range(1, 10, 2)], "id long, key string")
    return rounded(remap(demand_frame(spark, {"demand": d.SINGLE}).select("product_id", "amount"), "product_id", keys))


QUERIES["remap"], SQL["remap"] = QUERIES.pop("remap_query"), SQL.pop("remap_query")


# iterations
def _u(matrix: str, row: str, col: str) -> str:
    return f"(('0x' || substr(md5('{d.SEED}|' || it || '|{matrix}|' || ({row}) || '|' || ({col})), 1, 13))::bigint / cast(4503599627370496 as double))"


def _mc_sql(tail: str, sampled: str = "true") -> str:
    """CTEs of ITERATIONS draws; `sampled` says of a consuming part whether its exchanges are drawn."""
    ut, ub, uc, uw = _u(TECHNOSPHERE, "inp", f"con + {d.OFFSET}"), _u(BIOSPHERE, "flow", f"part + {d.OFFSET}"), _u(CHARACTERIZATION, "flow", "0"), _u(WEIGHTING, "0", "0")
    con, part = sampled.replace("?", "con"), sampled.replace("?", "part")
    triangular = "case when u * (2.0::double * amount - 0.5::double * amount) < amount - 0.5::double * amount then 0.5::double * amount + sqrt(u * (2.0::double * amount - 0.5::double * amount) * (amount - 0.5::double * amount)) else 2.0::double * amount - sqrt((1 - u) * (2.0::double * amount - 0.5::double * amount) * (2.0::double * amount - amount)) end"
    return f""", its as (select unnest(range(0, {ITERATIONS})) as it),
wi as (select it, inp, con, case when {con} then 0.8::double * amount + {ut} * (1.2::double * amount - 0.8::double * amount) else amount end as amount from w cross join its),
bi as (select it, flow, part, case when {part} then {triangular} else amount end as amount from (select *, {ub} as u from bio cross join its)),
ci as (select it, r_name, flow, 0.5::double * factor + {uc} * (1.5::double * factor - 0.5::double * factor) as factor from cf cross join its),
vi as (select it, 2.0::double + {uw} * (3.0::double - 2.0::double) as value from its),
y0 as (select it, fu, product, amount from x0 cross join its),
y1 as (select it, fu, inp as product, sum(y0.amount * wi.amount) as amount from y0 join wi using (it) where con = product group by all),
y2 as (select it, fu, inp as product, sum(y1.amount * wi.amount) as amount from y1 join wi using (it) where con = product group by all),
y3 as (select it, fu, inp as product, sum(y2.amount * wi.amount) as amount from y2 join wi using (it) where con = product group by all),
y as (select * from y0 union all select * from y1 union all select * from y2 union all select * from y3),
gi as (select it, fu, flow, sum(y.amount * bi.amount) as amount from y join bi using (it) where part = product group by all),
hi as (select it, fu, r_name, gi.amount * factor as amount from gi join ci using (it, flow))
{tail}"""


SCORES_IT = "select cast(it as bigint) as iteration, round(sum(amount), 6) as score from hi group by it"


@_query(_mc_sql(SCORES_IT))
def mc_scores(spark, sf):
    return rounded(single(spark, sf, use_distributions=True).run(ITERATIONS), "score")


@_query("select cast(it as bigint) as iteration, round(sum(amount) * (1 + 0.1::double * (it % 4)), 6) as score from hs cross join (select unnest(range(0, 6)) as it) group by it")
def scenario_scores(spark, sf):
    return rounded(single(spark, sf, "scenario", use_arrays=True).run(6), "score")


MULTI_IT = "select cast(it as bigint) as iteration, fu, '\"' || r_name || '\"' as lcia, round(sum(amount), 6) as score from hi group by it, fu, r_name"


@_query(_mc_sql(MULTI_IT))
def multi_mc_scores(spark, sf):
    return rounded(multi(spark, sf, use_distributions=True).run(ITERATIONS), "score")


@_query(_mc_sql("select cast(it as bigint) as iteration, round(value * (select sum(amount) from hs), 6) as score from vi"))
def mc_weighting(spark, sf):
    lca = _assessed(single(spark, sf, "weight"))
    value = mat.single_value(lca.packages, WEIGHTING, use_distributions=True, iterations=range(ITERATIONS))
    return rounded(inv.score(inv.weigh(lca.characterized_inventory, value), ["iteration"]), "score")


@_query(_mc_sql(MULTI_IT))
def fast_mc_scores(spark, sf):
    m = multi(spark, sf, FastScoresOnlyMultiLCA, weighted=False, use_distributions=True)
    a, b = m._lci_matrices(range(ITERATIONS))
    m.biosphere_matrix = b
    m.load_lcia_data(range(ITERATIONS))
    pre = inv.precalculated(b, m.characterization_matrix, ["iteration", "lcia"])
    return rounded(inv.fast_scores(pre, sol.supply(a, demand_frame(spark, d.DEMANDS), "acyclic"), ["lcia"]), "score")


@_query(_mc_sql("select fu, count(*) as n, round(avg(score), 6) as mean, round(stddev(score), 6) as stddev from (select it, fu, sum(amount) as score from hi group by all) group by fu"))
def mc_summary(spark, sf):
    scores = multi(spark, sf, use_distributions=True).run(ITERATIONS).groupBy("iteration", "fu").agg(F.sum("score").alias("score"))
    from ..streaming.draws import summary

    return rounded(summary(scores, ("fu",)).select("fu", "n", "mean", "stddev"), "mean", "stddev")


# partitioned Monte Carlo: parts 0 and 1 modulo 4 are the static database
def _parts(spark, sf):
    s = d.system(spark, sf)
    inventory_, own = s["inventory"], (F.col("col_id") - d.OFFSET) % 4 < 2
    kinds = lambda db: [Resource(f"{db}_technosphere_matrix", TECHNOSPHERE, uncertain=True), Resource(f"{db}_biosphere_matrix", BIOSPHERE, uncertain=True)]
    named = lambda db, rows: rows.withColumn("group", F.concat(F.lit(f"{db}_"), "matrix"))
    base = package_from_frame("base", named("base", inventory_.frame.where(own)), kinds("base"), seed=d.SEED, database_dependencies=())
    top = package_from_frame("top", named("top", inventory_.frame.where(~own)), kinds("top"), seed=d.SEED, database_dependencies=("base",))
    return [base, top, s["method"]]


@_query("select * from (values ('method', 1), ('static', 1), ('stochastic', 1)) t(bucket, packages)", system=False)
def partition_classes(spark, sf):
    found = classify(_parts(spark, sf), ["base"])
    return spark.createDataFrame([(k, len(v)) for k, v in found.items()], "bucket string, packages int")


@_query(f"select p_partkey as product_id, p_partkey + {d.OFFSET} as activity_id, cast(1 as double) as amount from part")
def production_exchanges(spark, sf):
    return sol.production_exchanges(mat.build_matrix([d.system(spark, sf)["inventory"]], TECHNOSPHERE))


@_query("select distinct inp as product_id from w where inp % 4 < 2 and con % 4 >= 2")
def interface_products_query(spark, sf):
    return interface_products(mat.build_matrix(_parts(spark, sf)[1:2], TECHNOSPHERE))


QUERIES["interface_products"], SQL["interface_products"] = QUERIES.pop("interface_products_query"), SQL.pop("interface_products_query")


@_query("""select p.product_id, flow as row_id, round(sum(p.amount * bio.amount), 6) as amount from (
  select inp as product_id, inp as product, cast(1 as double) as amount from (select distinct inp from w where inp % 4 < 2 and con % 4 >= 2)
  union all select f.inp, w.inp, w.amount from (select distinct inp from w where inp % 4 < 2 and con % 4 >= 2) f join w on w.con = f.inp) p join bio on part = p.product group by all""")
def static_background_query(spark, sf):
    base, top, _ = _parts(spark, sf)
    return rounded(static_background([base], interface_products(mat.build_matrix([top], TECHNOSPHERE)), "acyclic"))


QUERIES["static_background"], SQL["static_background"] = QUERIES.pop("static_background_query"), SQL.pop("static_background_query")


@_query("select round(sum(amount), 6) as score from hs")
def partitioned_score(spark, sf):
    p = PartitionedMonteCarloLCA(d.SINGLE, ["base"], _parts(spark, sf), solver="acyclic")
    p.use_distributions = False
    return rounded(inv.score(_assessed(p).characterized_inventory), "score")


@_query(_mc_sql(SCORES_IT, "? % 4 >= 2"))
def partitioned_mc(spark, sf):
    return rounded(PartitionedMonteCarloLCA(d.SINGLE, ["base"], _parts(spark, sf), solver="acyclic").run(ITERATIONS), "score")
