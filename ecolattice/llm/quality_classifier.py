"""Quality classifier: a sparse rule ensemble over text statistics.

Boosted trees on the statistics propose conjunctive rules (their paths); a
lasso logistic regression weighs them and drops most; what is left is compiled
to one Spark column expression. Statistics and scores are computed JVM-side in
one pass over the texts; the driver sees the statistics of a bounded sample of
labelled rows (about `SAMPLE`) only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, id_text, saved, share_by_hash
from .trees import boost, paths

#: Labels that the model is fitted on, about, if there are more: those whose id's hash falls under a threshold.
SAMPLE = 20_000
TREES, DEPTH, MAX_RULES, PENALTIES = 40, 3, 400, (3e-2, 1e-2, 3e-3, 1e-3, 3e-4)

STATISTICS = ("n_chars", "n_words", "word_length", "upper_ratio", "digit_ratio", "symbol_ratio", "shout_ratio", "punct_ratio", "space_ratio", "line_length", "distinct_words", "distinct_lines", "stop_ratio")


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns `more` and the statistics of every whole text (null: empty); these are doubles, never null or NaN."""
    t = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("double")
    split = docs.select("doc_id", *more, t.alias("t")).select("doc_id", *more, "t", F.array_remove(F.split("t", SPACE + "+"), "").alias("words"), F.split("t", "\n").alias("lines"))
    counted = split.select(
        "doc_id", *more, F.length("t").cast("double").alias("n_chars"), F.size("words").cast("double").alias("n_words"), F.size("lines").cast("double").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("double").alias("n_distinct"), F.size(F.array_distinct("lines")).cast("double").alias("n_distinct_lines"),
        count(r"\p{Lu}").alias("upper"), count("[0-9]").alias("digits"), count(r"[#*$%&|<>_=~^{}\[\]\\]").alias("symbols"), count("[!?]").alias("shouts"), count("[.,;:]").alias("punct"), count(SPACE).alias("spaces"), count(r"[.!?](?:" + SPACE + "|$)").alias("stops"),
    )
    chars, words = F.greatest("n_chars", F.lit(1.0)), F.greatest("n_words", F.lit(1.0))
    return counted.select(
        "doc_id", *more, "n_chars", "n_words", ((F.col("n_chars") - F.col("spaces")) / words).alias("word_length"),
        *[(F.col(a) / chars).alias(b) for a, b in (("upper", "upper_ratio"), ("digits", "digit_ratio"), ("symbols", "symbol_ratio"), ("shouts", "shout_ratio"), ("punct", "punct_ratio"), ("spaces", "space_ratio"))],
        (F.col("n_chars") / F.col("n_lines")).alias("line_length"), (F.col("n_distinct") / words).alias("distinct_words"), (F.col("n_distinct_lines") / F.col("n_lines")).alias("distinct_lines"), (F.col("stops") / words).alias("stop_ratio"),
    )


@dataclass
class RuleEnsemble:
    """bias + sum of the weights of the rules that hold; a rule is a tuple of (statistic, is_at_most, cut)."""

    bias: float
    rules: list[tuple]
    weights: list[float]

    def column(self) -> Column:
        """The probability of quality 1 as a column over the statistics."""
        margin = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            holds = F.lit(True)
            for f, low, cut in rule:
                c = F.col(STATISTICS[f])
                holds = holds & ((c <= cut) if low else (c > cut))
            margin = margin + F.when(holds, F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights):
            margin += w * holds_for(rule, x)
        return 1 / (1 + np.exp(-margin))


def holds_for(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, low, cut in rule:
        out &= (x[:, f] <= cut) == low
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for the mean logistic loss plus penalty * |w|; the bias is free."""
    rate = 4.0 / (np.linalg.norm(r, 2) ** 2 / len(y) + 1)
    v, vb, last, lastb, t = w.copy(), b, w.copy(), b, 1.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(r @ v + vb, -30, 30))) - y
        w = v - rate * (r.T @ e) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b = vb - rate * e.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = w + (t - 1) / t2 * (w - last), b + (t - 1) / t2 * (b - lastb)
        last, lastb, t = w, b, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 1) -> RuleEnsemble:
    """Rules from boosted trees, weighed by the lasso whose penalty does best on a fifth of the rows."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    prior = float(np.log(p / (1 - p)))
    if len(y) < 20 or len(set(y)) < 2:
        return RuleEnsemble(prior, [], [])
    _, trees = boost(x, y, TREES, DEPTH, rate=0.2, bins=32, least=max(5, len(y) // 500), subsample=0.5, seed=seed)
    rules = list(dict.fromkeys(q for t in trees for q in paths(t)))
    r = np.stack([holds_for(q, x) for q in rules], 1).astype(np.float32)
    keep = np.unique(r, axis=1, return_index=True)[1]
    keep = keep[r[:, keep].std(0) > 0][:MAX_RULES]
    rules, r = [rules[k] for k in keep], r[:, keep].astype(float)
    test = np.random.default_rng(seed).random(len(y)) < 0.2
    best, w, b = None, np.zeros(len(rules)), prior
    for penalty in PENALTIES:
        w, b = lasso_logistic(r[~test], y[~test], penalty, w, b)
        prob = np.clip(1 / (1 + np.exp(-(r[test] @ w + b))), 1e-9, 1 - 1e-9)
        loss = -np.mean(np.where(y[test] == 1, np.log(prob), np.log(1 - prob)))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, penalty)
    w, b = lasso_logistic(r, y, best[1], np.zeros(len(rules)), prior, 600)
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(float(b), [rules[k] for k in used], [float(w[k]) for k in used])


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether the row's id belongs to the fold whose labels are never learned from (null ids do)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def known_labels(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """(_id, _y): about `sample` of the labels outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("_y")).where("_id is not null and _y in (0, 1)")
    return share_by_hash(known.where(~held_out("_id")).distinct(), sample, "_id")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """A model for the statistics, from labels of rows outside the held-out fold."""
    rows = stats.join(known_labels(labels, label, sample), F.col("doc_id") == F.col("_id")).select(*STATISTICS, "_y", "_id").distinct()
    # An id may have several texts.
    rows = share_by_hash(saved(rows), 2 * sample, "_id", *STATISTICS).toPandas().sort_values(["_id", *STATISTICS, "_y"])
    return fit(rows[list(STATISTICS)].to_numpy(float), rows["_y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    Null and empty texts are scored by the statistics of the empty text;
    repeated rows and null ids are kept; without usable labels every score is
    one half (or the labels' share of ones); other columns are ignored.
    """
    stats = saved(statistics(id_text(docs, id_col, text_col)))
    model = train(stats, labels, sample=sample)
    scored = stats.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that the model predicts to be of quality 1; all columns stay.

    Each row is judged by its own text, so rows with a null or repeated id go
    or stay like any other; a null text counts as empty. The model is fitted
    on the texts of the sampled labels; then the rows are filtered where they are.
    """
    known = saved(known_labels(labels, "quality", sample))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known.select(F.col("_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    model = train(statistics(some), labels, sample=sample)
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("_row")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row)
    # A column that isn't deterministic keeps the filter from being moved below the statistics, which would compute them for every rule.
    judged = statistics(own, "_row").select("_row", model.column().alias("_p"), F.monotonically_increasing_id().alias("_n"))
    return judged.where("_p >= 0.5 and _n >= 0").select(*[F.col(f"_row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
