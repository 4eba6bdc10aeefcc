"""A life-cycle system derived from the driver's TPC-H-like tables, and its equivalent in SQL.

Products are parts, and each has an activity (its key plus OFFSET) that makes
one unit. A part consumes the parts of the same orders whose key modulo 4 is
smaller, half a unit in all; so chains end after three steps. Flows are
nations, from the turnover of suppliers there; impact categories are regions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, release
from ..schema import BIOSPHERE, CHARACTERIZATION, NORMALIZATION, TECHNOSPHERE, WEIGHTING, label
from ..sources.packages import Package, Resource, package_from_frame

OFFSET = 1_000_000_000
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
#: Five demands; the single demand is their sum.
DEMANDS = {f"fu{k}": {4 * k + 3: 1.0 + k} for k in range(5)}
SINGLE = {p: v for d in DEMANDS.values() for p, v in d.items()}
SCENARIOS, SEED = 4, 42


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(inp, con, amount): what a part consumes of others."""
    # Lines travel once by order, and pairs once by consumer.
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    a = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("inp"), "q")
    b = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("con"))
    pairs = a.join(b, "o").where("inp % 4 < con % 4").select("inp", "con", "q").repartition("con").groupBy("inp", "con").agg(F.sum("q").alias("q"))
    return pairs.select("inp", "con", (0.5 * F.col("q") / F.sum("q").over(Window.partitionBy("con"))).alias("amount"))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flow, part, amount)."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    li = read(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return li.groupBy(F.col("s_nationkey").cast("long").alias("flow"), F.col("l_partkey").alias("part")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("amount"))


def _dist(kind: int, low, mode, high):
    null = F.lit(None).cast("double")
    return F.struct(F.lit(kind).alias("uncertainty_type"), mode.alias("loc"), null.alias("scale"), null.alias("shape"), low.alias("minimum"), high.alias("maximum"), F.lit(False).alias("negative"))


@lru_cache(maxsize=8)
def _system(spark: SparkSession, sf_dir: str) -> dict[str, Package]:
    w = cut(inputs(spark, sf_dir))
    release(w)
    bio = cut(turnover(spark, sf_dir))
    release(bio)
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    one = part.select(F.lit(TECHNOSPHERE).alias("matrix"), F.lit("production").alias("group"), F.lit(0).alias("group_ord"), F.col("p").alias("row_id"), (F.col("p") + OFFSET).alias("col_id"), F.lit(1.0).alias("amount"), F.lit(False).alias("flip"))
    use = w.select(F.lit(TECHNOSPHERE).alias("matrix"), F.lit("inputs").alias("group"), F.lit(1).alias("group_ord"), F.col("inp").alias("row_id"), (F.col("con") + OFFSET).alias("col_id"), "amount", F.lit(True).alias("flip"), _dist(4, 0.8 * F.col("amount"), F.col("amount"), 1.2 * F.col("amount")).alias("dist"))
    flows = bio.select(F.lit(BIOSPHERE).alias("matrix"), F.lit("flows").alias("group"), F.lit(2).alias("group_ord"), F.col("flow").alias("row_id"), (F.col("part") + OFFSET).alias("col_id"), "amount", F.lit(False).alias("flip"), _dist(5, 0.5 * F.col("amount"), F.col("amount"), 2.0 * F.col("amount")).alias("dist"))
    inventory = package_from_frame("inventory", one.unionByName(use, allowMissingColumns=True).unionByName(flows, allowMissingColumns=True), [Resource("production", TECHNOSPHERE), Resource("inputs", TECHNOSPHERE, uncertain=True), Resource("flows", BIOSPHERE, uncertain=True)], seed=SEED)
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    region = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("r"), "r_name")
    nation = nation.join(region, "r")
    quoted = F.concat(F.lit('"'), F.col("r_name"), F.lit('"'))
    factor = (1 + F.col("n") % 7).cast("double")
    cf = nation.select(F.lit(CHARACTERIZATION).alias("matrix"), F.concat(F.lit("cf_"), "r_name").alias("group"), F.col("r").cast("int").alias("group_ord"), quoted.alias("identifier"), F.lit(0).alias("global_index"), F.col("n").alias("row_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("col_id"), factor.alias("amount"))
    cf = cf.withColumn("amount", F.when(F.col("col_id") == 0, F.col("amount")).otherwise(100.0)).withColumn("dist", _dist(4, 0.5 * F.col("amount"), F.col("amount"), 1.5 * F.col("amount")))
    method = package_from_frame("method", cf, [Resource(f"cf_{r}", CHARACTERIZATION, identifier=label(r), global_index=0, uncertain=True) for r in REGIONS], seed=SEED)
    nf = nation.select(F.lit(NORMALIZATION).alias("matrix"), F.concat(F.lit("nf_"), "r_name").alias("group"), F.col("r").cast("int").alias("group_ord"), F.concat(F.lit('"norm '), "r_name", F.lit('"')).alias("identifier"), F.col("n").alias("row_id"), F.lit(0).alias("col_id"), (1.0 / (1 + F.col("n") % 3)).alias("amount"))
    norm = package_from_frame("normalization", nf, [Resource(f"nf_{r}", NORMALIZATION, identifier=label(f"norm {r}")) for r in REGIONS])
    wf = region.select(F.lit(WEIGHTING).alias("matrix"), F.concat(F.lit("wf_"), "r_name").alias("group"), F.col("r").cast("int").alias("group_ord"), F.concat(F.lit('"weight '), "r_name", F.lit('"')).alias("identifier"), F.lit(0).alias("row_id"), F.lit(0).alias("col_id"), (2.0 + F.col("r")).alias("amount"))
    weights = package_from_frame("weights", wf, [Resource(f"wf_{r}", WEIGHTING, identifier=label(f"weight {r}")) for r in REGIONS])
    weight = package_from_frame("weight", spark.range(1).select(F.lit(WEIGHTING).alias("matrix"), F.lit("w").alias("group"), F.lit(0).alias("row_id"), F.lit(0).alias("col_id"), F.lit(2.5).alias("amount"), _dist(4, F.lit(2.0), F.lit(2.5), F.lit(3.0)).alias("dist")), [Resource("w", WEIGHTING, uncertain=True)], seed=SEED)
    steps = F.array(*[F.col("amount") * (1.0 + 0.1 * k) for k in range(SCENARIOS)])
    scenario = package_from_frame("scenario", bio.select(F.lit(BIOSPHERE).alias("matrix"), F.lit("flows").alias("group"), F.lit("array").alias("category"), F.col("flow").alias("row_id"), (F.col("part") + OFFSET).alias("col_id"), steps.alias("samples")), [Resource("flows", BIOSPHERE, "array")], sequential=True)
    return {"inventory": inventory, "method": method, "normalization": norm, "weights": weights, "weight": weight, "scenario": scenario}


def system(spark: SparkSession, sf_dir: str) -> dict[str, Package]:
    """Packages: inventory, method, normalization, weights (one per region), weight (a single one), scenario."""
    return _system(spark, sf_dir)


CONFIG = {"impact_categories": list(REGIONS), "normalizations": {f"norm {r}": [r] for r in REGIONS}, "weightings": {f"weight {r}": [f"norm {r}"] for r in REGIONS}}

#: The system, its supply and its inventory in DuckDB's SQL; queries go on from here.
SQL_SYSTEM = f"""
li as (select l_orderkey as o, l_partkey as p, sum(l_quantity) as q from lineitem group by all),
raw as (select a.p as inp, b.p as con, sum(a.q) as q from li a join li b using (o) where a.p % 4 < b.p % 4 group by all),
w as (select inp, con, cast(0.5 as double) * q / sum(q) over (partition by con) as amount from raw),
bio as (select cast(s_nationkey as bigint) as flow, l_partkey as part, sum(l_extendedprice * (1 - l_discount)) / cast(1000000 as double) as amount from lineitem join supplier on l_suppkey = s_suppkey group by all),
fu(fu, product, amount) as (values {", ".join(f"('{fu}', cast({p} as bigint), cast({v} as double))" for fu, d in DEMANDS.items() for p, v in d.items())}),
cf as (select cast(n_nationkey as bigint) as flow, cast(n_regionkey as bigint) as r, r_name, cast(1 + n_nationkey % 7 as double) as factor from nation join region on n_regionkey = r_regionkey),
nf as (select flow, r_name, cast(1 as double) / (1 + flow % 3) as factor from cf),
wf as (select r_name, cast(2 + r_regionkey as double) as value from region),
x0 as (select fu, product, sum(amount) as amount from fu group by all),
x1 as (select fu, inp as product, sum(x0.amount * w.amount) as amount from x0 join w on con = product group by all),
x2 as (select fu, inp as product, sum(x1.amount * w.amount) as amount from x1 join w on con = product group by all),
x3 as (select fu, inp as product, sum(x2.amount * w.amount) as amount from x2 join w on con = product group by all),
x as (select fu, product, sum(amount) as amount from (select * from x0 union all select * from x1 union all select * from x2 union all select * from x3) group by all),
xs as (select product, sum(amount) as amount from x group by all),
g as (select fu, flow, part, x.amount * bio.amount as amount from x join bio on part = product),
gs as (select flow, part, xs.amount * bio.amount as amount from xs join bio on part = product),
h as (select fu, r_name, flow, part, amount * factor as amount from g join cf using (flow)),
hs as (select flow, part, amount * factor as amount from gs join cf using (flow)),
n as (select fu, r_name, flow, part, amount * factor as amount from h join nf using (r_name, flow)),
ns as (select flow, part, amount * factor as amount from hs join nf using (flow))
"""
