"""URL filters: explicit host and path rules, and boosted trees on lexical features for all other URLs.

The URLs that a rule decides are the labelled ones. How many of a top-level
domain or a suffix are blocked is counted over all of them and joined back.
Trees are fitted on a bounded sample (about `SAMPLE` URLs, by a hash) in numpy
on the driver, each without its own label in these counts; features and trees
are Spark column expressions, so URLs are judged JVM-side.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share_by_hash
from .trees import Node, boost

#: Labelled URLs that the trees are fitted on, about; labels that a share of blocked URLs has to begin with.
SAMPLE, PRIOR = 20_000, 4
ROUNDS, DEPTH = 40, 3

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "host_hyphens", "parameters", "query_length", "entropy", "longest_label", "tld_length", "fragment", "tld_blocked", "suffix_blocked")


def parts(url: str = "url") -> tuple[Column, Column]:
    """(host, path): host in ASCII lower case; both empty for null or a URL without `://`."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(u, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(u, pattern, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host (or a parent domain) and path; null if none does."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of the columns url, host and path; every one is a double, never null."""
    u = F.coalesce(F.col("url").cast("string"), F.lit(""))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    ordered = F.array_sort(chars)
    # Entropy in bits from run lengths of the sorted characters.
    state = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda s, c: F.struct(c.alias("c"), F.when(s["c"] == c, s["run"] + 1.0).otherwise(1.0).alias("run"), F.when(s["c"] == c, s["sum"]).otherwise(s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0)).alias("sum")),
        lambda s: s["sum"] + F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(0.0),
    )
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    labels = F.split("host", r"\.")
    out = {
        "length": F.length(u), "host_length": F.length("host"), "depth": count(F.col("path"), "/"), "labels": F.size(labels),
        "digit_ratio": count(u, "[0-9]") / n, "host_digits": count(F.col("host"), "[0-9]"), "hyphens": count(u, "-"), "host_hyphens": count(F.col("host"), "-"),
        "parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1), "query_length": F.length(query), "entropy": F.log2(n) - state / n,
        "longest_label": F.array_max(F.transform(labels, F.length)), "tld_length": F.length(F.element_at(labels, -1)), "fragment": F.instr(u, "#") > 0,
    }
    out = {k: v.cast("double") for k, v in out.items()}
    return df.withColumns(out | {"tld": F.element_at(labels, -1), "suffix": F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))})


def _compiled(node: Node, names: tuple[str, ...]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    return F.when(F.col(names[node.feature]) <= node.cut, _compiled(node.left, names)).otherwise(_compiled(node.right, names))


def rated(df: DataFrame, prior: float, own: Column | None = None) -> DataFrame:
    """Adds tld_blocked and suffix_blocked: smoothed shares of blocked URLs among the ruled ones (less the row's own label, if given)."""
    less, one = (own, F.when(own.isNotNull(), 1).otherwise(0)) if own is not None else (F.lit(0), F.lit(0))
    for key in ("tld", "suffix"):
        counts = df.where("rule is not null").groupBy(F.col(key).alias("_key")).agg(F.count_if(F.col("ruled") == "block").alias("_blocked"), F.count("*").alias("_total"))
        df = df.join(counts, F.col(key) == F.col("_key"), "left").withColumn(f"{key}_blocked", (F.coalesce("_blocked", F.lit(0)) - less + PRIOR * prior) / (F.coalesce("_total", F.lit(0)) - one + PRIOR)).drop("_key", "_blocked", "_total")
    return df


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block of every row.

    verdict is the longest fitting rule's, else block if the trees give more
    than one half. Null URLs and such without `://` have empty host and path,
    fit no rule and are scored like any other; with no labelled URL at all (an
    empty table, or none that a rule fits) the rest is allowed. Repeated rows
    and null ids are kept; other columns are ignored.
    """
    host, path = parts()
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    base = lexical(base.withColumns({"rule": rule, "ruled": verdict}))
    ruled = base.where("rule is not null")
    first = ruled.agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked")).first()
    prior = first["blocked"] / first["n"] if first["n"] else 0.0
    if 0 < prior < 1:
        label = (F.col("ruled") == "block").cast("double")
        some = rated(base, prior, F.when(F.col("rule").isNotNull(), label)).where("rule is not null")
        rows = share_by_hash(some, sample, "url").select("url", *FEATURES, label.alias("y")).distinct().toPandas().sort_values(["url", *FEATURES])
        start, trees = boost(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float), ROUNDS, DEPTH)
        base = rated(base, prior)
        margin = F.lit(start)
        for t in trees:
            margin = margin + _compiled(t, FEATURES)
        p = 1 / (1 + F.exp(-margin))
    else:
        p = F.lit(0.0)
    scored = base.select("page_id", "host", "path", "rule", "ruled", p.alias("p_block"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")
