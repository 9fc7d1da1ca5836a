"""Continuous logging of actions with the batch operators, and on-line duplicate removal.

Everything a micro-batch adds is appended under its own batch id, so a repeated batch replaces exactly what its
first attempt wrote, and no table is rewritten. Items and rentals are kept as changes and reduced on read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import ingest as ing
from ..schemas import CUSTOMERS, DEFAULT_USER, ITEMS, LIFECYCLE, MOVEMENTS, RENTALS, Tables

_BASE = -1


def _with(schema: StructType, *names: str) -> StructType:
    """Only the named columns of a table."""
    return StructType([f for f in schema if f.name in names])


# Every part holds all columns of its table, so that nothing is lost between a batch table and the store.
_PARTS = {
    "item_changes": ITEMS, "movements": MOVEMENTS, "lifecycle": LIFECYCLE, "customers": CUSTOMERS, "rentals": RENTALS,
    "closures": _with(RENTALS, "id", "item_sku").add("_returned_at", RENTALS["returned_at"].dataType),
    "open": _with(RENTALS, "id", "item_sku", "booked_at", "status"),
    "rejects": "seq bigint, created_at timestamp_ntz, shop_type string, item_sku string, item_name string,"
               " action_type string, errors array<string>",
    "commits": "live array<bigint>",
}

#: So many batches of bookings and returns are read on top of the open bookings before those are written anew.
_LIVE = 16


def _schema(spark: SparkSession, part: str) -> StructType:
    return spark.createDataFrame([], _PARTS[part]).schema


def _read(spark: SparkSession, root: str, part: str) -> DataFrame:
    schema = StructType([*_schema(spark, part), StructField("batch_id", LongType())])
    return spark.read.schema(schema).parquet(f"{root}/{part}")


def _read_batches(spark: SparkSession, root: str, part: str, batches: list[int]) -> DataFrame:
    """The rows of the named batches, read by their folders; no other folder is listed."""
    return spark.read.schema(_schema(spark, part)).parquet(*(f"{root}/{part}/batch_id={b}" for b in batches))


def _filled(df: DataFrame, part: str) -> DataFrame:
    """The frame with the columns of the part that it lacks, as nulls."""
    missing = [f for f in _schema(df.sparkSession, part) if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else df


def _write(df: DataFrame, root: str, part: str, batch_id: int) -> None:
    """The rows of one batch in as many files as their size asks for, mostly one."""
    shaped = df.to(_schema(df.sparkSession, part))
    shaped.hint("rebalance").write.mode("overwrite").parquet(f"{root}/{part}/batch_id={batch_id}")


def start_store(
    spark: SparkSession, root: str, tables: Tables | None = None, rejects: DataFrame | None = None
) -> None:
    """Create the stream's tables, empty or from existing ones."""
    start = {part: spark.createDataFrame([], schema) for part, schema in _PARTS.items()}
    if tables is not None:
        start |= {
            "item_changes": tables.items, "movements": tables.movements, "lifecycle": tables.lifecycle,
            "customers": tables.customers, "rentals": tables.rentals,
            "open": tables.rentals.where(F.col("status") == "Rented"),
        }
    if rejects is not None:
        start["rejects"] = rejects
    for part, rows in start.items():
        _write(_filled(rows, part), root, part, _BASE)


def _committed(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The last complete batch, or the last one before a given batch; the start of the store counts as one."""
    done = _read(spark, root, "commits")
    last = (done if before is None else done.where(F.col("batch_id") < before)).agg(F.max("batch_id")).first()[0]
    return _BASE if last is None else last


def _before(spark: SparkSession, root: str, batch_id: int) -> tuple[int, list[int]]:
    """The last complete batch before a batch, and its live folders: the one with all open bookings, then later batches.

    That is the batch with the number before, whose commit is read by its folder. Only where numbers jump, as at the start of
    a store, the commits are listed.
    """
    try:
        earlier, row = batch_id - 1, _read_batches(spark, root, "commits", [batch_id - 1]).first()
    except AnalysisException:  # no such folder
        row = None
    if row is None:
        earlier = _committed(spark, root, batch_id)
        row = _read_batches(spark, root, "commits", [earlier]).first()
    return earlier, list(row.live) if row is not None and row.live else [earlier]


def _open_bookings(spark: SparkSession, root: str, live: list[int]) -> DataFrame:
    """The open bookings after the last of the ``live`` batches: those of the first, with what the others booked and closed."""
    base, *later = live
    held = _read_batches(spark, root, "open", [base])
    if not later:
        return held
    booked = _read_batches(spark, root, "rentals", later).select(*held.columns)
    closed = _read_batches(spark, root, "closures", later).select("id", "item_sku")
    return held.unionByName(booked).join(closed, ["id", "item_sku"], "left_anti")


def _rentals(spark: SparkSession, root: str, upto: int) -> DataFrame:
    opened = _read(spark, root, "rentals").where(F.col("batch_id") <= upto).drop("batch_id")
    closed = _read(spark, root, "closures").where(F.col("batch_id") <= upto).drop("batch_id")
    joined = opened.join(closed, ["id", "item_sku"], "left")
    done = F.col("_returned_at").isNotNull()
    return joined.withColumns(
        {
            "returned_at": F.coalesce("_returned_at", "returned_at"),
            "status": F.when(done, "Returned").otherwise(F.col("status")),
        }
    ).drop("_returned_at")


def read_store(spark: SparkSession, root: str) -> Tables:
    """The tables after the last complete batch."""
    upto = _committed(spark, root)

    def part(name: str) -> DataFrame:
        return _read(spark, root, name).where(F.col("batch_id") <= upto)

    # A batch has one change per SKU. Numbers come from the last change, texts from the last that has one, and what is
    # settled for good from the first.
    order = F.struct("batch_id", "updated_at")
    latest, first = (*ing._LATEST, "updated_at"), ing._FIRST
    items = part("item_changes").groupBy("item_sku").agg(
        F.min_by(F.struct(*first), "batch_id").alias("_f"), F.max_by(F.struct(*latest), "batch_id").alias("_n"),
        *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in ing._KEPT),
    ).select("item_sku", "_f.*", "_n.*", *ing._KEPT).select(*ITEMS.names)
    return Tables(
        items, part("movements").drop("batch_id"), part("lifecycle").drop("batch_id"),
        part("customers").drop("batch_id"), _rentals(spark, root, upto),
    )


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "rejects").where(F.col("batch_id") <= _committed(spark, root)).drop("batch_id")


def compact_store(spark: SparkSession, root: str, target: str) -> None:
    """Write the state after the last complete batch as the start of a new store.

    A stream that was stopped goes on there with its old checkpoint; its batch numbers simply continue.
    """
    start_store(spark, target, read_store(spark, root), read_rejects(spark, root))


def apply_batch(batch: DataFrame, batch_id: int, root: str, user: str = DEFAULT_USER) -> None:
    """Log one micro-batch. Only state of earlier batches is read, so running it again gives the same result.

    What a batch needs of the past is the open bookings and the customers it names. The open bookings, at most one per SKU
    however long the history is, are written by every ``_LIVE``-th batch. In between they are those with the bookings and
    returns of the batches since, so a batch writes what it adds and reads a bounded number of folders, named by the commit
    before it.
    """
    spark = batch.sparkSession
    earlier, live = _before(spark, root, batch_id)
    actions = batch.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    still_open = _open_bookings(spark, root, live)
    renew = len(live) > _LIVE
    held: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return held[-1]

    try:
        decided = hold(ing.decide(actions, still_open, hold=hold))
        good = ing.accepted(decided)
        names = ing.new_customers(good, user)
        # Only the known customers named in this batch are kept: a scan with a semi-join, then a small join.
        known = (
            _read(spark, root, "customers").where(F.col("batch_id") <= earlier).drop("batch_id")
            .join(names.select("display_name"), "display_name", "left_semi")
        )
        opened, closed = ing.open_rentals(good, known, user), ing.rental_closures(good)
        parts = {
            "item_changes": ing.item_changes(good).withColumn("is_active", F.lit(True)),
            "movements": ing.append_movements(good, user),
            "lifecycle": ing.append_lifecycle(good, user),
            "customers": names.join(known.select("display_name"), "display_name", "left_anti"),
            "rentals": opened,
            "closures": closed,
            "rejects": ing.rejected(decided),
        }
        if renew:
            parts["open"] = still_open.unionByName(opened.select(*still_open.columns)).join(
                closed.select("id", "item_sku"), ["id", "item_sku"], "left_anti")
        for part, rows in parts.items():
            _write(_filled(rows, part), root, part, batch_id)
        # Written last: readers ignore batches without it.
        after = [batch_id] if renew else [*live, batch_id]
        _write(spark.range(1).select(F.array(*(F.lit(b).cast("bigint") for b in after)).alias("live")), root, "commits", batch_id)
    finally:
        for df in held:
            df.unpersist()


def ingest_stream(
    raw: DataFrame, root: str, checkpoint: str, every: str | None = "60 seconds", user: str = DEFAULT_USER,
) -> StreamingQuery:
    """Log a stream of raw actions; ``every=None`` handles what is there and stops."""
    timing = {"processingTime": every} if every else {"availableNow": True}
    return (
        raw.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, root, user))
        .option("checkpointLocation", checkpoint).trigger(**timing).start()
    )


def drop_repeats(raw: DataFrame, seconds: int = 5, lateness: str = "1 day") -> DataFrame:
    """Stream without the actions that repeat the SKU and action of the one before them within ``seconds``.

    The rows left are those that ``duplicate_submits`` does not list. Actions that follow each other within ``seconds`` make
    up a session, whatever order and micro-batch they arrive in, and the first of them is kept. The state of a SKU and action
    is that row and the end of its session; it is given out and forgotten once the watermark, ``lateness`` behind the newest
    action, has passed the session. So a row comes out that much later, and a stream that ends holds its last sessions back
    until a later action arrives. Actions further behind are no longer accepted, nor are those without a time.
    """
    timed = raw.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)
    rest = [c for c in raw.columns if c not in ("created_at", "seq", "item_sku", "action_type")]
    first = F.min(F.struct("created_at", "seq", *rest)).alias("_first")
    sessions = timed.groupBy(F.session_window("created_at", f"{seconds} seconds"), "item_sku", "action_type").agg(first)
    kind = raw.schema["created_at"].dataType
    at = {c: F.col(f"_first.{c}") for c in ("created_at", "seq", *rest)} | {c: F.col(c) for c in ("item_sku", "action_type")}
    at["created_at"] = at["created_at"].cast(kind)
    return sessions.select(*(at[c].alias(c) for c in raw.columns))
