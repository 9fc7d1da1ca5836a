"""URL filters: host and path rules first, a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import ship

#: Verdict and host/path of the default rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty for a null url or one without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null. A rule holds for its host and subdomains and paths that start with its own."""
    result = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        result = F.when(fits, F.lit(rule)).otherwise(result)
    return result


@dataclass(frozen=True)
class UrlModel:
    """Weights of a logistic regression; ``weights`` has one entry per hash bucket, the last one is the intercept."""

    weights: np.ndarray
    sizes: tuple[int, ...] = (3, 4, 5)

    def score(self, host: Sequence[str], path: Sequence[str]) -> np.ndarray:
        """Probability that each url should be blocked."""
        buckets = len(self.weights) - 1
        out = np.empty(len(host))
        for i, (h, p) in enumerate(zip(host, path)):
            at = grams(h, p, buckets, self.sizes)
            z = self.weights[-1] + (self.weights[at].sum() / np.sqrt(len(at)) if len(at) else 0.0)
            out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def grams(host: str, path: str, buckets: int, sizes: Sequence[int] = (3, 4, 5)) -> np.ndarray:
    """Distinct hash buckets of the character n-grams of host and path; the two are kept apart by their marks."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in sizes:
            found.update(zlib.crc32((mark + text[i:i + n]).encode("utf-8", "replace")) % buckets
                         for i in range(max(0, len(text) - n + 1)))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


def train(labelled: DataFrame, *, rows: int = 4096, buckets: int = 4096, rounds: int = 300, ridge: float = 1e-3) -> UrlModel:
    """Fit on a labelled URL table (host, path, label 0/1; 1 means block).

    At most ``rows`` rows are used, the first by hash of host and path, so that the table that reaches the driver is
    small however many rows are labelled. Repeated (host, path, label) rows count once. Without any labelled row, or
    with one label only, the model gives that label's share (0.5 when there is none) for every url.
    """
    small = (
        labelled.select("host", "path", F.col("label").cast("int").alias("label")).na.drop().distinct()
        .orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(rows).collect()
    )
    weights = np.zeros(buckets + 1)
    y = np.array([r.label for r in small], dtype=float)
    if not len(y) or y.min() == y.max():
        weights[-1] = 0.0 if not len(y) else 8.0 * (2 * y[0] - 1)
        return UrlModel(weights)
    rows_of = [grams(r.host, r.path, buckets) for r in small]
    row = np.repeat(np.arange(len(rows_of)), [len(g) for g in rows_of])
    col = np.concatenate(rows_of) if rows_of else np.empty(0, dtype=np.int64)
    scale = np.array([1 / np.sqrt(max(1, len(g))) for g in rows_of])[row]
    # Nesterov steps; each row has unit length, so 1/(0.25 * 2) bounds the curvature.
    step, moved = 2.0, weights.copy()
    for k in range(rounds):
        z = np.bincount(row, moved[col] * scale, len(y)) + moved[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        slope = np.append(np.bincount(col, error[row] * scale, buckets), error.sum()) + ridge * np.append(moved[:-1], 0.0) / 10
        new = moved - step * slope
        moved = new + k / (k + 3) * (new - weights)
        weights = new
    return UrlModel(weights)


def filter_urls(
    pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5,
) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score.

    A rule decides where one fits; else the model does, blocking from ``threshold`` on. A null url, or one without
    ``://``, has empty host and path and is judged by the model like any other. Repeated rows give repeated results; an
    empty table gives no rows.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))

    @F.pandas_udf("double")
    def blocked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, p in parts:
            yield pd.Series(model.score(h.tolist(), p.tolist()))

    says = F.lit(None).cast("string")
    for verdict, rule in rules:
        says = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(says)
    scored = parsed.withColumn("score", blocked("host", "path"))
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce(says, by_model).alias("verdict"), "score")


def rule_labels(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """A labelled URL table (host, path, label) from the urls that a rule decides."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(host.alias("host"), path.alias("path"))
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    label = F.lit(None).cast("int")
    for verdict, name in rules:
        label = F.when(F.col("rule") == name, F.lit(int(verdict == "block"))).otherwise(label)
    return parsed.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("host", "path", label.alias("label"))
