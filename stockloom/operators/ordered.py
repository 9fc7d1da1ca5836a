"""Running values over an ordered key that stay spread out when one key holds most of the rows.

A plain window sends every row of a key to one task. Here keys that hold more than their share of an average partition are
cut into blocks at sampled rows, so that a block is about a partition. Each block gets its local running value, and what
the blocks before it carry in comes from a summary of one row per block. The other keys are a block of their own.

A block follows from the row and the cuts alone, so it does not matter which task computes it, nor how often, and nothing is
written between the steps. Like a range partitioning, splitting takes a job of its own that counts and samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: A key is split when it holds more rows than so many average shuffle partitions.
SHARE = 2.0

_SAMPLES = 32  # of a hot key, per average partition; every 32nd one is a cut
_BLOCK = "_block"
_CUTS = "_cuts"
_POS = "_pos"
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number inside the partition in the lower 33 bits


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_splits(df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float = SHARE) -> DataFrame | None:
    """The keys worth splitting with the ordered rows that cut them: keys, _cuts (array of structs of ``order``), or None.

    There are at most ``partitions / share`` such keys, and about one cut for each average partition they fill (more for a
    share below 2); that bounds the frame whatever the size of ``df``. Rows are sampled by their hash.
    """
    spark = df.sparkSession
    parts = _partitions(spark)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    size = counts.agg(F.sum("_rows").alias("all"), F.max("_rows").alias("most")).first()
    if not size.all or size.most * parts <= share * size.all:
        return None
    hot = counts.where(F.col("_rows") * parts > share * size.all).select(*keys)
    rate = min(1.0, _SAMPLES * parts * SHARE / (share * size.all))
    drawn = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 30)) < int(rate * (1 << 30))
    sampled = df.select(*keys, *order).where(drawn).join(F.broadcast(hot), list(keys))
    rows = F.array_sort(F.collect_list(F.struct(*order)))
    cut = sampled.groupBy(*keys).agg(F.filter(rows, lambda _, i: i % _SAMPLES == _SAMPLES - 1).alias(_CUTS))
    found = cut.where(F.size(_CUTS) > 0).collect()
    return spark.createDataFrame(found, cut.schema) if found else None


def _with_block(df: DataFrame, most: int) -> DataFrame:
    """Add how many of the cuts of its key lie at or before a row, by bisection; 0 for a key without cuts."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(_CUTS, at + s - 1) <= F.col("_row"), at + s).otherwise(at))
    return df.withColumn(_BLOCK, F.when(F.col(_CUTS).isNull(), F.lit(0)).otherwise(place)).drop(_CUTS, "_row")


def _order(order: Sequence[str], latest_first: bool) -> list[Column]:
    return [F.col(c).desc() if latest_first else F.col(c).asc() for c in order]


def _local(df, partition, order, sums, lasts, latest_first):
    spec = Window.partitionBy(*partition).orderBy(*_order(order, latest_first))
    through = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    added = {name: F.sum(value).over(through) for name, value in sums.items()}
    added |= {name: F.last(value, ignorenulls=True).over(before) for name, value in lasts.items()}
    return df.withColumns(added)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    latest_first: bool = False,
    share: float = SHARE,
    splits: DataFrame | None | bool = True,
) -> DataFrame:
    """Add running columns per key, rows taken in ``order``.

    ``sums``: running total up to and including the row. ``lasts``: last non-null value strictly before the row.
    ``order`` must be unique within a key; ``latest_first`` walks it backwards. Keys and order are not null.
    ``splits``: what ``key_splits`` returns for these keys, if it is known already.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    if splits is True:
        splits = key_splits(df, keys, order, share)
    if splits is None:
        return _local(df, keys, order, sums, lasts, latest_first)
    most = splits.agg(F.max(F.size(_CUTS))).first()[0]
    rows = df.withColumn("_row", F.struct(*order))

    # The summary is taken from split keys only: at most one row per cut and key.
    rank = F.struct(*order)
    pick = F.min_by if latest_first else F.max_by
    totals = [F.sum(value).alias(f"_c_{name}") for name, value in sums.items()]
    totals += [pick(value, F.when(value.isNotNull(), rank)).alias(f"_c_{name}") for name, value in lasts.items()]
    summary = _with_block(rows.join(F.broadcast(splits), list(keys)), most).groupBy(*keys, _BLOCK).agg(*totals)
    earlier = Window.partitionBy(*keys).orderBy(*_order([_BLOCK], latest_first)).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{name}": F.sum(f"_c_{name}").over(earlier) for name in sums}
    carried |= {f"_c_{name}": F.last(f"_c_{name}", ignorenulls=True).over(earlier) for name in lasts}
    carry = F.broadcast(summary.withColumns(carried))

    marked = _with_block(rows.join(F.broadcast(splits), list(keys), "left"), most)
    local = _local(marked, [*keys, _BLOCK], order, sums, lasts, latest_first)
    joined = local.join(carry, [*keys, _BLOCK], "left")
    final = {name: F.coalesce(F.col(f"_c_{name}") + F.col(name), F.col(name), F.col(f"_c_{name}")) for name in sums}
    final |= {name: F.coalesce(F.col(name), F.col(f"_c_{name}")) for name in lasts}
    return joined.withColumns(final).select(*df.columns, *sums, *lasts)


def global_row_number(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """1-based position of each row in the order of the whole frame, without moving all rows to one task.

    The frame is range-sorted and written once; a row's number is its place inside its file partition plus the
    row counts of the partitions before it (one row per partition).
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ranked")
    df.orderBy(*order).withColumn(_POS, F.monotonically_increasing_id()).write.parquet(path)
    ranked = spark.read.parquet(path).withColumn(_BLOCK, F.shiftright(_POS, _LOCAL_BITS))
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranked.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
        .select(_BLOCK, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    place = F.col(_POS).bitwiseAND((1 << _LOCAL_BITS) - 1) + 1
    return (
        ranked.join(F.broadcast(offsets), _BLOCK)
        .withColumn(name, (F.col("_before") + place).cast("bigint"))
        .select(name, *df.columns)
    )
