"""Quality rules whose cutoffs are risk-controlled on labelled holdouts. DataFrame functions only.

Each rule compares one statistic with a cutoff from a fixed grid. The labelled
rows of every stratum (language) are split in two by a hash. The first half
proposes: for each rule the cutoff of most use (rejected bad documents less
COST times rejected good ones, the most lenient if tied, none unless positive
and under RISK), and an order of the rules by use. Settings are the first one,
two, ... of these rules together, with their cutoffs as proposed or some steps
more lenient. The second half, which has proposed nothing, tests each setting
as a whole: of n good documents its rules together reject k, and it is admitted
if the exact binomial tail P(Bin(n, RISK) <= k) is at most DELTA over the
number of all settings of all strata (Bonferroni). So with confidence 1 - DELTA
no stratum loses more than RISK of its good documents to all rules together. Of
the admitted settings a stratum takes that of most use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, Rounds, broadcast_if, saved

RISK, DELTA, COST = 0.01, 0.05, 20
#: Settings loosen the proposed cutoffs by so many steps of the grid.
LOOSER = (0, 1, 2)

#: Rule: the statistic that must stay at or below the cutoff, and the grid of cutoffs.
GRID = {
    "symbols": (5, 10, 15, 20, 30, 40, 60, 80, 100, 150),
    "dup_lines": (1, 2, 3, 4, 5, 6, 8, 10, 15, 20),
    "repeats": (5, 10, 15, 20, 25, 30, 35, 40, 45, 48),
    "long_words": (7, 8, 9, 10, 11, 12, 14, 16, 20, 30),
    "short_words": (-5, -4, -3, -2.5, -2, -1.5),
}


def _statistic(rule: str) -> Column:
    words = F.greatest("n_words", F.lit(1)).cast("double")
    return {
        "symbols": 100 * F.col("n_symbols") / words, "dup_lines": 100 * F.col("n_dup_lines") / words, "repeats": 100 * F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words, "short_words": -F.col("word_chars") / words,
    }[rule].cast("double")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", more: tuple[Column, ...] = ()) -> DataFrame:
    """The columns `more`, doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    One narrow pass: nothing is shuffled, however long a text is. Repeated
    windows are found by sorting the 64-bit hashes of a text's own windows.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col and stratum_col in docs.columns else F.lit("")
    t = docs.select(*more, F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    first = t.columns[:-1]
    t = t.select(*first, "t", F.array_remove(F.split("t", SPACE + "+"), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("words")
    hashes = F.when(n >= 3, F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    t = t.select(
        *first, n.cast("long").alias("n_words"), (F.length("t") - F.regexp_count("t", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), hashes.alias("hashes"),
    )
    repeated = F.size(F.array_distinct("hashes")) < F.size("hashes")
    kept = [*first, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    t = t.select(*kept, F.when(repeated, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("s"))
    again = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    t = t.select(*kept, F.sort_array(F.transform(again, lambda x: x["p"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    t = t.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term from the largest one, k, downwards in relative terms."""
    # term(i-1) / term(i) = i / (n - i + 1) * (1 - p) / p; sums are relative to term(k), whose logarithm is a sum of logs.
    log_top = n * F.log1p(F.lit(-p)) + F.aggregate(F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i * (p / (1 - p))))
    down = F.aggregate(
        F.when(k > 0, F.sequence(F.greatest(k, F.lit(1)).cast("int"), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.exp(log_top + F.log(down))


def calibrate(counts: DataFrame, labels: DataFrame, label: str = "quality", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff column for each rule (null: the rule does not apply there)."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    proposes = (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("proposes")
    rows = counts.where("not base_failed").join(known, F.col("doc_id") == F.col("_id")).select("stratum", "y", proposes, *[_statistic(r).alias(r) for r in GRID])
    good, bad = F.col("y") == 1, F.col("y") == 0

    def tried(part: DataFrame, by: list[str], tests: dict[tuple, Column], names: tuple[str, str]) -> DataFrame:
        """One row for each group and test, with n, false_rejections and worth."""
        sums = [s for k, over in enumerate(tests.values()) for s in (F.count_if(good & over).alias(f"k{k}"), F.count_if(bad & over).alias(f"b{k}"))]
        table = part.groupBy(*by).agg(F.count_if(good).alias("n"), *sums)
        each = [F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.col(f"k{k}").alias("false_rejections"), (F.col(f"b{k}") - COST * F.col(f"k{k}")).alias("worth")) for k, (a, b) in enumerate(tests)]
        return table.select(*by, "n", F.explode(F.array(*each)).alias("x")).select(*by, "n", "x.*")

    useful = (F.col("worth") > 0) & (F.col("false_rejections") <= risk * F.col("n"))
    proposed = tried(rows.where("proposes"), ["stratum"], {(r, j): F.col(r) > c for r, grid in GRID.items() for j, c in enumerate(grid)}, ("rule", "at")).where(useful)
    best = proposed.groupBy("stratum", "rule").agg(F.max(F.struct("worth", "at")).alias("best"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("best.worth"), "rule")))
    plan = saved(ranked.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{r}_{n}") for r in GRID for c, n in (("best.at", "at"), ("rank", "rank"))]))
    looked_up = lambda r, more: F.get(F.array(*[F.lit(float(c)) for c in GRID[r]]), F.col(f"{r}_at") + more)
    fields = plan.columns
    held = rows.where("not proposes").join(broadcast_if(plan).withColumnRenamed("stratum", "_s"), F.col("stratum") == F.col("_s"))
    # The first rule, in the stratum's order, that rejects the row; a setting of so many rules does or doesn't reach it.
    reached = {more: F.least(F.lit(len(GRID) + 1), *[F.when(F.col(r) > looked_up(r, more), F.col(f"{r}_rank")) for r in GRID]) for more in LOOSER}
    held = held.select(*fields, "y", *[c.alias(f"reached_{more}") for more, c in reached.items()])
    settings = {(j, more): F.col(f"reached_{more}") <= j for j in range(1, len(GRID) + 1) for more in LOOSER}
    tested = tried(held, fields, settings, ("rules", "looser")).withColumn("settings", F.count("*").over(Window.partitionBy(F.lit(0))))
    admitted = tested.where(useful).where(binomial_tail(F.col("false_rejections"), F.col("n"), risk) <= F.lit(delta) / F.col("settings"))
    chosen = admitted.groupBy(*fields).agg(F.max(F.struct("worth", (-F.col("rules")).alias("fewer"), "looser")).alias("best"))
    return chosen.select("stratum", *[F.when(F.col(f"{r}_rank") <= -F.col("best.fewer"), looked_up(r, F.col("best.looser"))).alias(r) for r in GRID])


def passing(counts: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The counts with kept: false if the base or a rule of the stratum's (checkpointed) cutoffs fails."""
    known = broadcast_if(cutoffs.withColumnRenamed("stratum", "_s"))
    passes = reduce(Column.__and__, [F.coalesce(_statistic(rule) <= F.col(rule), F.lit(True)) for rule in GRID])
    return counts.join(known, F.col("stratum") == F.col("_s"), "left").select(*counts.columns, (~F.col("base_failed") & passes).alias("kept"))


def judged(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The counts with kept, by the cutoffs that they and the labels calibrate."""
    return passing(counts, saved(calibrate(counts, labels, risk=risk, delta=delta)))


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row.

    Null texts have no words and fail the base. Rows in strata without an
    admitted setting (too few labelled good rows, or none at all) are kept
    unless the base fails. A null language is a stratum of its own; repeated
    rows and null ids are kept as rows; other columns are ignored.
    """
    counts = saved(base_counts(docs, id_col, text_col, stratum_col))
    return judged(counts, labels, risk, delta).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_passing(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of `docs` that the rules keep; all columns stay.

    Each row is judged by its own text, so rows with a null or repeated id go
    or stay like any other. The calibration reads a table of all counts, which
    goes again; then each row is counted once more and filtered where it is,
    so no copy of the rows is left behind, and only counts are shuffled.
    """
    files = Rounds(docs.sparkSession, "counts")
    cutoffs = saved(calibrate(files(base_counts(docs)), labels, risk=risk, delta=delta))
    files.drop()
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_row")
    # A column that isn't deterministic keeps the filter from being moved below the counts, which would compute them twice.
    counts = base_counts(docs, more=(row,)).withColumn("_n", F.monotonically_increasing_id())
    kept = passing(counts, cutoffs).where("kept and _n >= 0")
    return kept.select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def oracle() -> str:
    """The same as `apply_rules` over `documents` and `labels`, in DuckDB's SQL."""
    stat = {"symbols": "100 * n_symbols", "dup_lines": "100 * n_dup_lines", "repeats": "100 * n_repeat_words", "long_words": "word_chars", "short_words": "-word_chars"}
    value = {r: f"cast({s} as double) / greatest(n_words, 1)" for r, s in stat.items()}
    grid = ", ".join(f"('{r}', {j}, cast({c} as double))" for r, g in GRID.items() for j, c in enumerate(g))
    of_rule = "case rule " + " ".join(f"when '{r}' then {r}" for r in GRID) + " end"
    looked_up = lambda r, more: f"list_value({', '.join(f'cast({c} as double)' for c in GRID[r])})[{r}_at + {more} + 1]"
    over = " or ".join(f"coalesce({r}_rank <= rules and {r} > {looked_up(r, 'looser')}, false)" for r in GRID)
    chosen_cutoff = lambda r: f"case when {r}_rank <= -best.fewer then {looked_up(r, 'best.looser')} end as {r}"
    settings = ", ".join(f"({j}, {more})" for j in range(1, len(GRID) + 1) for more in LOOSER)
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(lang, '') as stratum from documents),
w as (select rid, doc_id, t, stratum, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select rid, unnest(range(1, len(words) - 1)) as p, words from w where len(words) >= 3),
h as (select rid, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as tri from g),
again as (select rid, p from h qualify count(*) over (partition by rid, tri) > 1),
covered as (select rid, count(distinct q) as n from (select rid, unnest([p, p + 1, p + 2]) as q from again) group by rid),
counts as (
  select w.doc_id, w.stratum, cast(len(words) as bigint) as n_words, cast(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from w left join covered c using (rid)),
based as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from counts),
grid(rule, place, cutoff) as (values {grid}),
labelled as (
  select b.stratum, l.quality as y, substr(md5(cast(b.doc_id as varchar)), 1, 1) < '8' as proposes, {", ".join(f"{v} as {r}" for r, v in value.items())}
  from based b join labels l on b.doc_id = l.doc_id where not base_failed and l.quality in (0, 1)),
proposed as (
  select stratum, rule, place, count(*) filter (where y = 1) as n, count(*) filter (where y = 1 and {of_rule} > cutoff) as k, count(*) filter (where y = 0 and {of_rule} > cutoff) - {COST} * k as worth
  from labelled cross join grid where proposes group by all),
best as (select stratum, rule, max(struct_pack(worth := worth, place := place)) as best from proposed where worth > 0 and k <= {RISK} * n group by all),
ranked as (select stratum, rule, best.place as place, row_number() over (partition by stratum order by best.worth desc, rule) as rank from best),
plan as (select stratum, {", ".join(f"max(place) filter (where rule = '{r}') as {r}_at, max(rank) filter (where rule = '{r}') as {r}_rank" for r in GRID)} from ranked group by stratum),
settings(rules, looser) as (values {settings}),
tried as (
  select stratum, rules, looser, count(*) filter (where y = 1) as n, count(*) filter (where y = 1 and ({over})) as k, count(*) filter (where y = 0 and ({over})) - {COST} * k as worth
  from labelled join plan using (stratum) cross join settings where not proposes group by all),
tested as (
  select *, count(*) over () as settings,
    list_sum(list_transform(range(0, k + 1), lambda i: exp((case when n > 0 then lgamma(n + 1) - lgamma(i + 1) - lgamma(greatest(n - i, 0) + 1) else 0 end) + i * ln({RISK}) + (n - i) * ln(1 - {RISK})))) as tail
  from tried),
chosen as (
  select stratum, max(struct_pack(worth := worth, fewer := -rules, looser := looser)) as best from tested
  where worth > 0 and k <= {RISK} * n and tail <= {DELTA} / settings group by stratum),
cutoffs as (select stratum, {", ".join(chosen_cutoff(r) for r in GRID)} from chosen join plan using (stratum))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed {" ".join(f"and coalesce({value[r]} <= {r}, true)" for r in GRID)} as kept
from based left join cutoffs using (stratum)
"""
