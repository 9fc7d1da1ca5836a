"""Quality classifier: a sparse ensemble of rules, compiled into Spark column expressions.

Text statistics are built-in column functions. Shallow trees boosted on a bounded labelled sample give conjunctive rules
(the path to each node), a logistic regression with a lasso penalty keeps few of them, and what is left becomes one
column expression that Spark evaluates next to the statistics. Only fitting touches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import LINE_END, repeated_words
from .text import GAP, WORD_CHAR, bind, fold, whole

#: Statistics of a text, all numbers between 0 and about 10 whatever its length. Repetition is measured by windows of
#: eight words and not by distinct words, whose share falls with the length of any text.
STATISTICS = (
    "log_words", "word_length", "symbols", "bars", "bangs", "upper", "digits", "repeated", "distinct_lines",
    "open_lines", "words_per_line",
)


def statistics(text: Column) -> Column:
    """A struct of STATISTICS for a text; all 0 for a null or blank one."""
    text = whole(text)
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CHAR))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeated"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct"),
            F.size(F.filter(x, lambda line: ~line.rlike(LINE_END))).alias("open"))

    raw = F.struct(
        bind(F.array_remove(F.split(text, GAP), ""), of_words).alias("w"), bind(lines, of_lines).alias("l"),
        gone(r"[#*$%&<>]+").alias("symbols"), gone(r"\|+").alias("bars"), gone("!+").alias("bangs"),
        gone(r"\p{Lu}+").alias("upper"), gone("[0-9]+").alias("digits"))

    def shares(r: Column) -> Column:
        per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")
        chars, n, lines_n = r["w"]["chars"], r["w"]["n"], r["l"]["n"]
        values = (
            F.log10(n + F.lit(1.0)), per(chars, n), per(r["symbols"], chars), per(r["bars"], n), per(r["bangs"], n),
            per(r["upper"], chars), per(r["digits"], chars), per(r["w"]["repeated"], n), per(r["l"]["distinct"], lines_n),
            per(r["l"]["open"], lines_n), F.log10(per(n, lines_n) + 1))
        return F.struct(*[v.alias(name) for v, name in zip(values, STATISTICS)])

    return bind(raw, shares)


#: One side of a split: (statistic, threshold, whether the value must be above it).
Condition = tuple[int, float, bool]


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(intercept + weights of the rules that hold)))."""

    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for k, threshold, above in rule:
                value = stats[STATISTICS[k]]
                holds = holds & ((value > threshold) if above else (value <= threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    result = np.ones(len(x), bool)
    for k, threshold, above in rule:
        result &= (x[:, k] > threshold) if above else (x[:, k] <= threshold)
    return result


def _best_split(x: np.ndarray, slope: np.ndarray, least: int) -> tuple[float, int, float]:
    """(gain, statistic, threshold) of the split that separates the slopes best; gain 0 if there is none."""
    best = (1e-9, -1, 0.0)
    n, total = len(slope), slope.sum()
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        values, left = x[order, k], np.cumsum(slope[order])[:-1]
        sizes = np.arange(1, n)
        gain = left**2 / sizes + (total - left) ** 2 / (n - sizes) - total**2 / n
        gain[(values[1:] <= values[:-1]) | (sizes < least) | (n - sizes < least)] = -1
        at = int(np.argmax(gain)) if n > 1 else 0
        if n > 1 and gain[at] > best[0]:
            best = (float(gain[at]), k, float((values[at] + values[at + 1]) / 2))
    return best


def _tree_rules(x, slope, rows, path, depth, least, found, step):
    """Grow one tree; each node but the root is a rule. Returns the step of each row in its leaf."""
    gain, k, threshold = _best_split(x[rows], slope[rows], least) if depth and len(rows) >= 2 * least else (0, -1, 0)
    if k < 0:
        step[rows] = 4 * slope[rows].mean() if len(rows) else 0.0
        return
    for above in (False, True):
        side = rows[(x[rows, k] > threshold) == above]
        rule = (*path, (k, threshold, above))
        found.setdefault(tuple(sorted(rule)))
        _tree_rules(x, slope, side, rule, depth - 1, least, found, step)


def fit_rules(
    x: np.ndarray, y: np.ndarray, *, trees: int = 16, depth: int = 3, least: int = 8, penalty: float = 2e-4, rounds: int = 400,
) -> RuleModel:
    """Rules from boosted trees, weighted by a logistic regression with a lasso penalty (accelerated proximal steps)."""
    if not len(y):
        return RuleModel((), (), 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleModel((), (), intercept)
    found: dict[tuple[Condition, ...], None] = {}
    margin = np.full(len(y), intercept)
    for _ in range(trees):
        step = np.zeros(len(y))
        _tree_rules(x, y - 1 / (1 + np.exp(-margin)), np.arange(len(y)), (), depth, least, found, step)
        margin = np.clip(margin + 0.5 * step, -8, 8)
    rules = list(found)
    if not rules:
        return RuleModel((), (), intercept)
    holds = np.stack([_holds(x, r) for r in rules], 1).astype(float)
    design = np.concatenate([holds, np.ones((len(y), 1))], 1)
    size = 4 / np.linalg.eigvalsh(design.T @ design / len(y))[-1]
    w = np.zeros(design.shape[1])
    w[-1] = intercept
    moved = w.copy()
    for k in range(rounds):
        error = 1 / (1 + np.exp(-(design @ moved))) - y
        new = moved - size * (design.T @ error) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        moved = new + k / (k + 3) * (new - w)
        w = new
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-6]
    return RuleModel(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), float(w[-1]))


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` pairs of a label and a document: doc_id, label, statistics; the first by hash of id and text.

    The bound holds after the join, too, where one id stands for very many documents.
    """
    few = labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    few = few.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    # Broadcast is bounded by ``rows``; texts stay where they are.
    joined = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    sample = joined.select("doc_id", "label", F.xxhash64("doc_id", "text").alias("__h"), statistics(F.col("text")).alias("s"))
    return sample.orderBy("__h", "doc_id", "label", "s").limit(rows).select("doc_id", "label", "s.*")


def train(docs: DataFrame, labels: DataFrame, *, rows: int = 8192) -> RuleModel:
    """Fit on ``labels`` (doc_id, label 0/1) and the texts of ``docs``.

    At most ``rows`` labels are used, the first by hash of the id, and at most as many pairs of a label and a document; that
    bounds what reaches the driver. Labels that are null or whose document is missing are passed over; repeated ones count as
    often as they stand.
    """
    data = labelled_rows(docs, labels, rows).collect()
    data.sort(key=lambda r: tuple(r))
    x = np.array([[r[name] for name in STATISTICS] for r in data], float).reshape(len(data), len(STATISTICS))
    return fit_rules(x, np.array([r.label for r in data], float))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (probability of label 1) and predicted of every whole text of ``docs``.

    A null or blank text has all statistics 0 and is scored like any other. Rows are scored on their own: repeated rows and
    null ids are kept, further columns ignored, an empty table gives no rows.
    """
    scored = docs.select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", model.score(F.col("s")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify_by_fold(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """Learn from labels outside fold 0 and score every document: doc_id, held_out, score, predicted."""
    known = labels.where(fold(F.col("doc_id"), folds) != 0)
    scored = score_quality(docs, train(docs, known))
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", "predicted")
