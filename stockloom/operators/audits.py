"""Reconciliation checks over the log, the live list and physical counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import days_until, instant, is_overdue
from ..session import scratch_path
from .ordered import SHARE, key_splits, running
from .state import newest_rows

# Cause categories in the order the checks are run; the first that applies wins.
CAUSES = (
    "Counting error",
    "System or query bug",
    "Unrecorded return",
    "Data-entry error",
    "Lost transaction",
    "Cross-shop mixing",
    "Status desync",
)
UNKNOWN = "Unknown"

# Statuses of units that are away from the shops.
_AWAY = ("In Alteration", "Dry Cleaning")

_EVENT = ["created_at", "seq"]


def baseline_check(log: DataFrame, live: DataFrame) -> DataFrame:
    """SKUs whose summed quantity differs from the stock shown for them."""
    summed = log.groupBy("item_sku").agg(F.sum("quantity_change").alias("logged_qty"))
    shown = live.select("item_sku", "live_stock")
    both = shown.join(summed, "item_sku", "full").select(
        "item_sku", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("logged_qty", "live_stock"))
    )
    return both.where(F.col("logged_qty") != F.col("live_stock")).withColumn(
        "difference", F.col("live_stock") - F.col("logged_qty")
    )


def unmatched_rentals(log: DataFrame, paired: bool = False, share: float = SHARE) -> DataFrame:
    """Rental Out rows without a later Rental Return of the SKU.

    ``paired`` asks for a return of its own: the next rental action after the row must be a return.
    """
    keep = ("item_sku", "created_at", "seq", "customer_name_contact")
    action = F.col("action_type")
    if paired:
        moves = log.where(action.isin("Rental Out", "Rental Return")).select(*keep, "action_type")
        following = running(moves, ["item_sku"], _EVENT, lasts={"_next": action}, latest_first=True, share=share)
        unmatched = (action == "Rental Out") & ~F.col("_next").eqNullSafe(F.lit("Rental Return"))
        return following.where(unmatched).select(*keep)
    last = log.where(action == "Rental Return").groupBy("item_sku").agg(F.max("created_at").alias("_last_return"))
    out = log.where(action == "Rental Out").select(*keep).join(last, "item_sku", "left")
    return out.where(F.col("_last_return").isNull() | (F.col("_last_return") <= F.col("created_at"))).select(*keep)


def implausible_qty(log: DataFrame, k: int = 2) -> DataFrame:
    """Rentals and sales that move more than ``k`` units at once."""
    return log.where(
        F.col("action_type").isin("Rental Out", "Retail Sale") & (F.abs("quantity_change") > k)
    ).select("seq", "created_at", "item_sku", "action_type", "quantity_change")


def zero_qty_returns(log: DataFrame) -> DataFrame:
    return log.where((F.col("action_type") == "Rental Return") & (F.col("quantity_change") == 0)).select(
        "seq", "created_at", "item_sku", "quantity_change"
    )


def duplicate_submits(log: DataFrame, seconds: int = 5, share: float = SHARE) -> DataFrame:
    """Rows that repeat the SKU and action of the row before them within ``seconds``."""
    rows = log.select("seq", "created_at", "item_sku", "action_type")
    previous = F.struct(F.col("created_at").alias("at"), F.col("seq").alias("seq"))
    seen = running(rows, ["item_sku", "action_type"], _EVENT, lasts={"_previous": previous}, share=share)
    near = F.col("created_at") <= F.col("_previous.at") + F.make_dt_interval(secs=F.lit(seconds))
    return seen.where(near).select(
        "seq", "created_at", "item_sku", "action_type",
        F.col("_previous.seq").alias("repeats_seq"), F.col("_previous.at").alias("repeats_at"),
    )


def cross_shop_skus(log: DataFrame) -> DataFrame:
    """SKUs logged under both shops, with the rows in each."""
    shop = F.col("shop_type")
    return log.groupBy("item_sku").agg(
        F.count_if(shop == "Bags").alias("bags_rows"), F.count_if(shop == "Bridal").alias("bridal_rows")
    ).where((F.col("bags_rows") > 0) & (F.col("bridal_rows") > 0))


def status_desync(log: DataFrame) -> DataFrame:
    """SKUs whose last status says rented while the last action was a return, or the other way round."""
    when = F.struct("created_at", "seq")
    status = F.col("bridal_status")
    last = log.groupBy("item_sku").agg(
        F.max_by(status, F.when(status.isNotNull(), when)).alias("bridal_status"),
        F.max(F.struct("created_at", "seq", "action_type"))["action_type"].alias("last_action"),
    )
    rented = F.col("bridal_status").eqNullSafe(F.lit("Rented"))
    action = F.col("last_action")
    return last.where((rented & (action == "Rental Return")) | (~rented & (action == "Rental Out")))


def count_delta(
    counts: DataFrame, live: DataFrame, high_value: float | None = None, recurring: DataFrame | None = None
) -> DataFrame:
    """Counted against recorded stock with a severity; SKUs that agree are left out.

    ``counts``: item_sku, physical_qty. ``recurring``: SKUs with an earlier incident.
    """
    joined = counts.select("item_sku", "physical_qty").join(
        live.select("item_sku", "shop_type", "sell_price", "live_stock"), "item_sku"
    )
    again = F.lit(False)
    if recurring is not None:
        known = recurring.select("item_sku").distinct().withColumn("_again", F.lit(True))
        joined = joined.join(known, "item_sku", "left")
        again = F.coalesce("_again", F.lit(False))
    rows = joined.withColumn("delta", (F.col("physical_qty") - F.col("live_stock")).cast("bigint"))
    size = F.abs("delta")
    costly = F.lit(False) if high_value is None else F.col("sell_price") >= F.lit(high_value)
    severity = (
        F.when((size > 5) | costly | again, "severe")
        .when((size >= 2) | (F.col("shop_type") == "Bridal"), "moderate")
        .otherwise("minor")
    )
    return rows.where(F.col("delta") != 0).select(
        "item_sku", "shop_type", F.col("live_stock").alias("recorded_qty"),
        F.col("physical_qty").cast("bigint").alias("physical_qty"), "delta", severity.alias("severity"),
    )


def snapshot_sku(history: DataFrame, live: DataFrame, deltas: DataFrame, n: int = 5) -> DataFrame:
    """The newest ``n`` audit rows of every SKU under review, next to its recorded state and count."""
    review = deltas.select("item_sku", "recorded_qty", "physical_qty", "delta")
    events = history.join(review.select("item_sku"), "item_sku", "left_semi").select(
        "item_sku", "id", "created_at", "action_type", "quantity_change"
    )
    newest = newest_rows(events, "item_sku", ["created_at", "id"], n)
    state = live.select("item_sku", "bridal_status", "customer_name_contact", "rental_due_date")
    return newest.join(review, "item_sku").join(state, "item_sku")


def class_a_skus(live: DataFrame, pct: float = 0.2) -> DataFrame:
    """The most valuable ``pct`` of the rental SKUs with a price, for cycle counts; equal prices go by SKU.

    The share is cut at a price that follows from the counts per price, one row for each price there is. Only SKUs at or
    above it are ranked, each among those of its own price.
    """
    rentable = live.where((F.col("shop_type") == "Bridal") & F.col("sell_price").isNotNull()).select("item_sku", "item_name", "sell_price")
    counts = rentable.groupBy("sell_price").agg(F.count(F.lit(1)).alias("_n"))
    dearer = Window.orderBy(F.col("sell_price").desc()).rowsBetween(Window.unboundedPreceding, -1)
    share = F.ceil(counts.agg(F.sum("_n").cast("double")).scalar() * F.lit(pct))
    prices = counts.select("sell_price", F.coalesce(F.sum("_n").over(dearer), F.lit(0)).alias("_before")).where(F.col("_before") < share)
    placed = running(rentable.join(prices, "sell_price"), ["sell_price"], ["item_sku"], sums={"_place": F.lit(1)})
    ranked = placed.withColumn("value_rank", (F.col("_before") + F.col("_place")).cast("bigint"))
    return ranked.where(F.col("value_rank") <= share).select("value_rank", "item_sku", "item_name", "sell_price")


def discrepancy_trend(incidents: DataFrame, items: DataFrame) -> DataFrame:
    """Incidents per month by SKU, by staff and by cause, also per 100 items.

    ``incidents``: occurred_at, item_sku, staff, cause, delta.
    """
    groups = F.array(
        *(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("item_sku", "staff", "cause"))
    )
    month = F.date_trunc("month", F.col("occurred_at")).cast("date")
    rows = incidents.select(month.alias("month"), "delta", F.explode(groups).alias("g"))
    total = items.agg(F.count(F.lit(1))).scalar()
    return rows.groupBy("month", F.col("g.dimension").alias("dimension"), F.col("g.value").alias("value")).agg(
        F.count(F.lit(1)).alias("incidents"), F.sum(F.abs("delta")).cast("bigint").alias("units"),
    ).withColumn("per_100_items", F.round(F.col("incidents") * 100 / total, 4).cast("decimal(20,4)"))


def overdue_without_return(rentals: DataFrame, as_of: dt.datetime) -> DataFrame:
    due = F.col("due_date")
    return rentals.where((F.col("status") == "Rented") & is_overdue(due, as_of)).select(
        "id", "item_sku", "customer_id", "booked_at", "due_date", (-days_until(due, as_of)).alias("days_overdue")
    )


def recent_actors(log: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Staff who touched each SKU in the last ``days``, one row per SKU and person."""
    since, until = (instant(t) for t in (as_of - dt.timedelta(days=days), as_of))
    return log.where((F.col("created_at") > since) & (F.col("created_at") <= until)).groupBy(
        "item_sku", "created_by"
    ).agg(F.count(F.lit(1)).alias("actions"), F.max("created_at").alias("last_at"))


def correction_rows(history: DataFrame) -> DataFrame:
    """Annotated audit rows and the row they refer to; a correction without a reference is marked."""
    # The marker words used in notes.
    kind = F.regexp_extract("notes", r"(CORRECTION|BACKFILL|HOLD-RECONCILE)", 1)
    reference = F.regexp_extract("notes", r"row #([0-9]+)", 1)
    return history.where(F.col("notes").rlike("CORRECTION|BACKFILL|HOLD-RECONCILE")).select(
        "id", "created_at", "item_sku", "action_type", "notes", kind.alias("kind"),
        F.nullif(reference, F.lit("")).alias("row_reference"),
        ((kind == "CORRECTION") & (reference == "")).alias("missing_reference"),
    )


def gap_transactions(
    external: DataFrame, log: DataFrame, since: dt.datetime,
    on: Sequence[str] = ("item_sku", "action_type", "created_at"),
) -> DataFrame:
    """Receipts since the last good count that the log lacks, counted: two equal receipts need two log rows."""
    after = F.col("created_at") > instant(since)

    def tally(df: DataFrame, name: str) -> DataFrame:
        return df.where(after).groupBy(*on).agg(F.count(F.lit(1)).alias(name))

    both = tally(external, "receipts").join(tally(log, "_logged"), list(on), "left")
    missing = F.col("receipts") - F.coalesce("_logged", F.lit(0).cast("bigint"))
    return both.withColumn("missing", missing).where(F.col("missing") > 0).select(*on, "receipts", "missing")


def wrong_sku_pairs(deltas: DataFrame, share: float = SHARE) -> DataFrame:
    """Short SKUs next to SKUs of the same shop that are over by the same amount.

    Every SKU with such a counterpart is listed once with the number of counterparts, and with one proposed partner:
    the n-th short SKU goes with the n-th over SKU. The full set of pairs is all of one side with all of the other
    for equal (shop, amount); listing it would grow with the square of the group.

    Both sides are counted in one ordered walk of their group and one back, which give a SKU's place and the size of each side.
    Partners meet by place, so a group of any size is spread.
    """
    group = ["shop_type", "amount"]
    over = F.col("delta") > 0
    rows = deltas.where(F.col("delta") != 0).select("item_sku", "shop_type", "delta", F.abs("delta").alias("amount"))
    splits = key_splits(rows, group, ["item_sku"], share)
    sides = {"over": F.when(over, 1).otherwise(0), "short": F.when(over, 0).otherwise(1)}
    walked = running(rows, group, ["item_sku"], sums=sides, splits=splits)
    back = {f"_{name}": value for name, value in sides.items()}
    counted = running(walked, group, ["item_sku"], sums=back, latest_first=True, splits=splits)
    # Up to a row and from it on: the row itself counts twice.
    size = {name: F.col(name) + F.col(f"_{name}") - value for name, value in sides.items()}
    listed = counted.select(
        "item_sku", "shop_type", "delta", "amount", F.when(over, size["short"]).otherwise(size["over"]).alias("counterparts"),
        F.when(over, F.col("over")).otherwise(F.col("short")).alias("place")).where(F.col("counterparts") > 0)
    # At most one SKU of each side has a place.
    met = listed.groupBy(*group, "place").agg(F.collect_list(F.struct("item_sku", "delta", "counterparts")).alias("who"))
    one = F.explode(F.transform("who", lambda x: F.struct(
        x["item_sku"].alias("item_sku"), x["delta"].alias("delta"), x["counterparts"].alias("counterparts"),
        F.get(F.filter("who", lambda y: y["item_sku"] != x["item_sku"]), F.lit(0))["item_sku"].alias("partner_sku"))))
    return met.select("shop_type", one.alias("r")).select("r.item_sku", "shop_type", "r.delta", "r.counterparts", "r.partner_sku")


def counting_errors(deltas: DataFrame, recount: DataFrame) -> DataFrame:
    """Discrepancies that a second count (item_sku, physical_qty) does not confirm."""
    second = recount.select("item_sku", F.col("physical_qty").alias("_again"))
    return deltas.join(second, "item_sku").where(F.col("_again") == F.col("recorded_qty")).select("item_sku")


def off_site(deltas: DataFrame, live: DataFrame) -> DataFrame:
    """Short SKUs that stand at the dry cleaner or in alteration: their units may be there and not on the rack."""
    away = live.where(F.col("bridal_status").isin(*_AWAY)).select("item_sku", "bridal_status")
    return deltas.where(F.col("delta") < 0).select("item_sku", "delta").join(away, "item_sku")


def find_causes(
    deltas: DataFrame, log: DataFrame, trail: DataFrame, live: DataFrame, rentals: DataFrame, as_of: dt.datetime, *,
    recount: DataFrame | None = None, gaps: DataFrame | None = None, seconds: int = 5,
) -> DataFrame:
    """All checks of the audit procedure over ``deltas``, in its order; the first that lists a SKU names the cause.

    ``log`` are the logged actions, ``trail`` the rows whose quantities must add up to the stock shown; a SKU where they
    do not is a bug of the system and is not looked into further. ``recount`` is a second count, ``gaps`` the findings of
    ``gap_transactions``.

    The discrepancies are held once in the scratch folder, and every check sees only the rows of their SKUs.
    """
    path = scratch_path(deltas.sparkSession, "deltas")
    deltas.write.parquet(path)
    deltas = deltas.sparkSession.read.parquet(path)
    skus = deltas.select("item_sku").distinct()
    log, trail, live, rentals = (df.join(skus, "item_sku", "left_semi") for df in (log, trail, live, rentals))
    findings = {
        "Counting error": [counting_errors(deltas, recount)] if recount is not None else [],
        "System or query bug": [baseline_check(trail, live)],
        "Unrecorded return": [unmatched_rentals(log), overdue_without_return(rentals, as_of)],
        "Data-entry error": [
            implausible_qty(log), zero_qty_returns(log), duplicate_submits(log, seconds), wrong_sku_pairs(deltas)],
        "Lost transaction": [gaps] if gaps is not None else [],
        "Cross-shop mixing": [cross_shop_skus(log), off_site(deltas, live)],
        "Status desync": [status_desync(log)],
    }
    return assign_cause(deltas, findings)


def assign_cause(deltas: DataFrame, findings: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """Label each discrepancy with the first cause whose checks list its SKU, else Unknown.

    ``findings`` maps a category of ``CAUSES`` to frames with an ``item_sku`` column.
    """
    unknown = set(findings) - set(CAUSES)
    if unknown:
        raise ValueError(f"unknown causes {sorted(unknown)}")
    flags = None
    for rank, cause in enumerate(CAUSES):
        for frame in findings.get(cause, ()):
            part = frame.select("item_sku", F.lit(rank).alias("_rank"))
            flags = part if flags is None else flags.unionByName(part)
    cause: Column = F.lit(UNKNOWN)
    joined = deltas
    if flags is not None:
        first = flags.groupBy("item_sku").agg(F.min("_rank").alias("_rank"))
        joined = deltas.join(first, "item_sku", "left")
        names = F.array(*(F.lit(c) for c in CAUSES))
        cause = F.coalesce(F.get(names, F.col("_rank")), F.lit(UNKNOWN))
    return joined.withColumn("cause", cause).select(*deltas.columns, "cause")
