"""Mixing sources to target weights by hash-random order, range-wise prefix sums and an exact cut per source.

A source's documents are put into a random but repeatable order (md5 of id, size and text). The order is dealt into ranges of the
hash, so that a source of any size is many small groups; running sums inside a range plus the sums of the ranges before
it give every document's place in words. Only one row per range and per source is ever gathered by source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import id_text, words

#: About so many documents form a range; a window sorts one range at a time.
RANGE_ROWS = 8192
_P = "__mix_"


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """Target words of each source from ``sizes`` (source, source_size; one row per source).

    Sources by code point, null last, get the weights in turn and share ``share`` times all words; no target exceeds
    ``most`` times its source's size, and what is cut off goes to the others by weight. All sources below their limit
    then take the same multiple of their weight, and that multiple is found from one ordered pass over the sources.
    The frame has one row per source, a catalogue that grows with the sources and not with the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * most
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    all_words = F.sum("source_size").over(everything) * share
    all_weight = F.sum("weight").over(everything)
    level = (all_words - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / (
        all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("level", level)
        # The first source by limit that the level leaves below it names the level of all that follow.
        .withColumn("place", F.when(limit / F.col("weight") >= F.col("level"), F.row_number().over(by_limit)))
        .withColumn("level", F.min_by("level", "place").over(everything))
        .withColumn("target", F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit)))
        .select(*sizes.columns, "target")
    )


def _placed(docs: DataFrame, weights, share, most) -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, whole epochs, rest and the words before the document."""
    size = F.size(words(F.col("text"))).cast("bigint")
    text = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    order = F.md5(F.concat_ws(":", id_text(F.col("doc_id")), size.cast("string"), text).cast("binary"))
    # Rows of one id and text are told apart by their other columns.
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    sized = docs.withColumn(f"{_P}size", size).withColumn(f"{_P}tie", F.xxhash64(*hashed))
    totals = sized.groupBy("source").agg(
        F.sum(f"{_P}size").cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = source_targets(totals, weights, share, most).select(
        F.col("source").alias(f"{_P}source"), F.col("source_size").alias(f"{_P}source_size"),
        F.col("target").alias(f"{_P}target"), F.ceil(F.col("n_docs") / RANGE_ROWS).alias(f"{_P}ranges"))
    placed = (
        sized.withColumn(f"{_P}key", order)
        .join(plan, F.col("source").eqNullSafe(F.col(f"{_P}source")))
        .withColumn(f"{_P}range", F.floor(
            F.conv(F.substring(f"{_P}key", 1, 8), 16, 10).cast("bigint") * F.col(f"{_P}ranges") / F.lit(2**32)))
    )
    in_range = Window.partitionBy(f"{_P}source", f"{_P}range").orderBy(f"{_P}key", f"{_P}tie")
    local = placed.withColumn(
        f"{_P}local", F.sum(f"{_P}size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{_P}size"))
    ranges = placed.groupBy(f"{_P}source", f"{_P}range").agg(F.sum(f"{_P}size").alias("words"))
    ranges = ranges.select(
        F.col(f"{_P}source").alias(f"{_P}s"), F.col(f"{_P}range").alias(f"{_P}r"),
        (F.sum("words").over(Window.partitionBy(f"{_P}source").orderBy(f"{_P}range")) - F.col("words"))
        .alias(f"{_P}offset"))
    joined = local.join(
        ranges, F.col(f"{_P}source").eqNullSafe(F.col(f"{_P}s")) & (F.col(f"{_P}range") == F.col(f"{_P}r")))
    epochs = F.when(F.col(f"{_P}source_size") > 0, F.floor(F.col(f"{_P}target") / F.col(f"{_P}source_size"))).otherwise(0)
    return (
        joined.withColumn(f"{_P}before", F.col(f"{_P}offset") + F.col(f"{_P}local"))
        .withColumn(f"{_P}epochs", epochs.cast("bigint"))
        .withColumn(f"{_P}rest", F.floor(F.col(f"{_P}target")) - F.col(f"{_P}epochs") * F.col(f"{_P}source_size"))
    )


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """How many words of each document the mix takes: doc_id, source, size, source_size, target, taken.

    ``docs`` has doc_id, text and source. Each source gives floor(target) words exactly: whole epochs over all its
    documents, then documents in hash order up to the budget, the last of them in part. Null texts have size 0 and take
    part with 0 words; a null source is a source of its own; equal rows are interchangeable. An empty table
    gives no rows.
    """
    placed = _placed(docs.select("doc_id", "source", "text"), weights, share, most)
    size = F.col(f"{_P}size")
    part = F.greatest(F.lit(0), F.least(size, F.col(f"{_P}rest") - F.col(f"{_P}before")))
    return placed.select(
        "doc_id", "source", size.alias("size"), F.col(f"{_P}source_size").alias("source_size"),
        F.col(f"{_P}target").alias("target"), (F.col(f"{_P}epochs") * size + part).cast("bigint").alias("taken"))


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """The mix itself under the columns of ``docs``: a document once per epoch that takes it, always whole.

    The last epoch of a source ends at the document border nearest to its budget. A document without words goes along
    with the epochs that reach its place. Documents of one id and size have their places by their text, then by a hash of
    all columns, so reruns agree.
    """
    placed = _placed(docs, weights, share, most)
    reached = F.col(f"{_P}before") * 2 + F.col(f"{_P}size") <= F.col(f"{_P}rest") * 2
    copies = F.col(f"{_P}epochs") + F.when(reached & (F.col(f"{_P}rest") > 0), 1).otherwise(0)
    return (
        placed.withColumn(f"{_P}copies", copies.cast("int")).where(F.col(f"{_P}copies") > 0)
        .withColumn(f"{_P}copy", F.explode(F.sequence(F.lit(1), F.col(f"{_P}copies"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
