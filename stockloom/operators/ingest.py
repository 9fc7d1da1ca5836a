"""From raw text actions to table rows: validate, coerce, decide, apply.

One action is one transaction: it either reaches every table it touches or, when any rule fails, none of them. The
only rules that depend on other rows are "at most one open rental per SKU" and "a return closes the open rental";
both follow from the last earlier rental action of the SKU that is valid by itself, so no row-by-row replay is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blank_to_null, js_trim, money, normalize_sku, number_lead, number_of, whole_lead, whole_of
from ..schemas import (
    ACTIONS,
    BRIDAL_STATUSES,
    DEFAULT_ALERT,
    DEFAULT_USER,
    EMAIL_PATTERN,
    ITEMS,
    LEDGER_ACTIONS,
    LIFECYCLE_STATUSES,
    MONEY,
    MOVEMENT_ACTIONS,
    RENTAL_STATUSES,
    ROW_ID,
    SHOPS,
    TEXT_LENGTHS,
    WALK_IN,
    Tables,
)
from ..session import scratch_path
from .migrate import customer_id
from .ordered import SHARE, key_splits, running

_TEXT = ("brand_designer", "item_image", "bag_color", "bridal_size", "bridal_status", "customer_name_contact", "notes")


def _missing(text: Column) -> Column:
    return text.isNull() | (text == "")


def _problems(rules: dict[str, Column]) -> Column:
    return F.array_compact(
        F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.lit(message)) for message, broken in rules.items()))
    )


# --- validate, coerce, route ---------------------------------------------------------------------------------------


def validate_actions(raw: DataFrame) -> DataFrame:
    """Add ``errors``: every broken input rule of the action, empty when it may be logged."""
    shop, action, status = F.col("shop_type"), F.col("action_type"), F.col("bridal_status")
    rules = {
        # Message texts.
        'shop_type must be "Bags" or "Bridal".': shop.isNull() | ~shop.isin(*SHOPS),
        "item_sku is required.": F.col("item_sku").isNull() | (js_trim(F.col("item_sku")) == ""),
        "item_name is required.": F.col("item_name").isNull() | (js_trim(F.col("item_name")) == ""),
        "action_type is invalid.": action.isNull() | ~action.isin(*ACTIONS),
        "bridal_status is invalid.": ~_missing(status) & ~status.isin(*BRIDAL_STATUSES),
    }
    return raw.withColumn("errors", _problems(rules))


def coerce_actions(raw: DataFrame) -> DataFrame:
    """Text fields to typed columns. ``overflow`` marks numbers the target columns cannot hold."""
    # Each text is matched once; value and range flag are then taken from the matched part.
    leads = {f"_{c}": number_lead(F.col(c)) for c in ("stock_cost_price", "sell_price")}
    leads |= {f"_{c}": whole_lead(F.col(c)) for c in ("quantity_change", "min_stock_alert", "quantity")}
    matched = raw.withColumns(leads)
    cost, cost_big = number_of(F.col("_stock_cost_price"))
    sell, sell_big = number_of(F.col("_sell_price"))
    change, change_big = whole_of(F.col("_quantity_change"))
    alert, alert_big = whole_of(F.col("_min_stock_alert"))
    count, count_big = whole_of(F.col("_quantity"))
    rental = F.col("action_type") == "Rental Out"
    # Only the columns an action writes can overflow; item prices and alert are written by all of them.
    ledger = F.col("action_type").isin(*LEDGER_ACTIONS)
    typed = {
        "stock_cost_price": F.when(rental, F.lit(0).cast(MONEY)).otherwise(cost),
        "sell_price": sell,
        "quantity_change": F.coalesce(change, F.lit(0)),
        # A request for an alert of 0 is indistinguishable from none.
        "min_stock_alert": F.coalesce(F.nullif(alert, F.lit(0)), F.lit(DEFAULT_ALERT)),
        "quantity": F.when(count > 0, count).otherwise(F.lit(1)),
        "item_sku": normalize_sku(F.col("item_sku")),
        "rental_due_date": blank_to_null(F.col("rental_due_date")),
        "overflow": F.coalesce(
            (~rental & cost_big) | sell_big | alert_big | (ledger & change_big) | (rental & count_big), F.lit(False)
        ),
    }
    typed |= {c: blank_to_null(F.col(c)) for c in _TEXT}
    return matched.withColumns(typed).drop(*leads)


def route_of(action: Column) -> Column:
    return F.when(action == "Rental Out", "rental").when(action == "Rental Return", "return").when(
        action == "Status Change", "lifecycle"
    ).otherwise("ledger")


def route_actions(actions: DataFrame) -> dict[str, DataFrame]:
    """Actions by the table they lead to."""
    routed = actions.withColumn("route", route_of(F.col("action_type")))
    return {name: routed.where(F.col("route") == name).drop("route")
            for name in ("rental", "return", "lifecycle", "ledger")}


def _row_problems() -> Column:
    """Rules of the target tables that one coerced action can break by itself."""
    rental = F.col("action_type") == "Rental Out"
    due = F.col("rental_due_date").try_cast("date")
    status = F.coalesce("bridal_status", F.lit("Available"))
    rules = {
        "number out of range": F.col("overflow"),
        "price below 0": (F.col("sell_price") < 0) | (F.col("stock_cost_price") < 0),
        "due date missing or unreadable": rental & due.isNull(),
        "due date before booking": rental & (due < F.col("created_at").cast("date")),
        "status not allowed for a lifecycle event":
            (F.col("action_type") == "Status Change") & ~status.isin(*LIFECYCLE_STATUSES),
    }
    for column in ("item_sku", "item_name", "brand_designer", "bag_color", "bridal_size"):
        rules[f"{column} too long"] = F.length(column) > TEXT_LENGTHS[column]
    rules["customer_name_contact too long"] = (
        rental & (F.length("customer_name_contact") > TEXT_LENGTHS["customer_name_contact"])
    )
    return _problems(rules)


# --- decide --------------------------------------------------------------------------------------------------------

_OPEN = "open rental exists for this SKU"


def _held(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "actions")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def check_actions(raw: DataFrame) -> DataFrame:
    """Coerced actions with every rule they break by themselves in ``errors``."""
    typed = coerce_actions(validate_actions(raw))
    none = F.array().cast("array<string>")
    return typed.withColumn(
        "errors", F.concat("errors", F.when(F.size("errors") == 0, _row_problems()).otherwise(none))
    )


def decide(
    raw: DataFrame,
    open_rentals: DataFrame | None = None,
    share: float = SHARE,
    hold: Callable[[DataFrame], DataFrame] = _held,
) -> DataFrame:
    """Coerced actions with ``errors`` and, for returns that close a rental, ``closes``.

    ``raw`` is ordered by (created_at, seq). ``open_rentals`` are the bookings open before the first action; they
    are placed ahead of the actions of their SKU. ``closes`` is a struct (id, booked_at) of the closed booking.
    The parsed actions feed every table, so they are held once (by default written to the scratch folder).
    """
    checked = hold(check_actions(raw))
    rental = F.col("action_type").isin("Rental Out", "Rental Return")
    valid = F.size("errors") == 0
    # Only valid rental actions take part in the ordering; everything else is decided already.
    moving = checked.where(rental & valid)
    settled = checked.where(~F.coalesce(rental & valid, F.lit(False)))

    step = moving.withColumn("_phase", F.lit(1))
    if open_rentals is not None:
        seed = open_rentals.where(F.col("status") == "Rented").select(
            "item_sku", F.col("booked_at").alias("created_at"), F.lit(0).cast("bigint").alias("seq"),
            F.lit("Rental Out").alias("action_type"), F.lit(0).alias("_phase"),
            F.struct(F.col("id").cast(ROW_ID).alias("id"), "booked_at").alias("_seed"),
        ).join(moving.select("item_sku").distinct(), "item_sku", "left_semi")
        step = step.unionByName(seed, allowMissingColumns=True)
        booking = F.coalesce("_seed", F.struct(F.col("seq").cast(ROW_ID).alias("id"), F.col("created_at").alias("booked_at")))
    else:
        booking = F.struct(F.col("seq").cast(ROW_ID).alias("id"), F.col("created_at").alias("booked_at"))
    order = ["_phase", "created_at", "seq"]

    out = F.col("action_type") == "Rental Out"
    splits = key_splits(step, ["item_sku"], order, share)
    step = running(step, ["item_sku"], order, lasts={"_before": F.col("action_type")}, splits=splits)
    taken = F.coalesce(F.col("_before") == "Rental Out", F.lit(False))
    step = step.withColumns({"_accepted": out & ~taken, "_booking": booking})
    # Accepted bookings and closing returns alternate, so the last accepted booking is the one a return closes.
    step = running(step, ["item_sku"], order, lasts={"_opened": F.when(F.col("_accepted"), F.col("_booking"))}, splits=splits)
    decided = step.where(F.col("_phase") == 1).withColumns(
        {
            "errors": F.when(out & ~F.col("_accepted"), F.array(F.lit(_OPEN))).otherwise(F.col("errors")),
            "closes": F.when(~out & taken, F.col("_opened")),
        }
    )
    return decided.select(*checked.columns, "closes").unionByName(settled, allowMissingColumns=True)


def accepted(decided: DataFrame) -> DataFrame:
    return decided.where(F.size("errors") == 0).drop("errors", "overflow")


def rejected(decided: DataFrame) -> DataFrame:
    return decided.where(F.size("errors") > 0).select(
        "seq", "created_at", "shop_type", "item_sku", "item_name", "action_type", "errors"
    )


# --- apply ---------------------------------------------------------------------------------------------------------

# What every action overwrites; the remaining texts change only where an action brings a value.
_LATEST = ("item_name", "stock_cost_price", "sell_price", "min_stock_alert")
# What the first action of a SKU settles for good.
_FIRST = ("shop_code", "is_active", "created_at")
ITEM_COLUMNS = tuple(f.name for f in ITEMS if f.name not in ("is_active", "created_at", "updated_at"))
_KEPT = tuple(c for c in ITEM_COLUMNS if c not in (*_LATEST, *_FIRST, "item_sku"))


def item_changes(actions: DataFrame) -> DataFrame:
    """Accepted actions reduced to one change per SKU. Reducing changes again gives the same kind of change."""
    when = F.struct("created_at", "seq")
    newest = F.max(F.struct("created_at", "seq", *_LATEST))
    first = F.min(F.struct("created_at", "seq", "shop_type"))
    texts = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)) for c in _KEPT}
    rolled = actions.groupBy("item_sku").agg(
        newest.alias("_n"), first.alias("_f"), *(value.alias(c) for c, value in texts.items())
    )
    return rolled.select(
        "item_sku", F.col("_f.shop_type").alias("shop_code"), *(F.col(f"_n.{c}").alias(c) for c in _LATEST), *_KEPT,
        F.col("_f.created_at").alias("created_at"), F.col("_n.created_at").alias("updated_at"),
    )


def upsert_items(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items after the accepted actions, with every column of ``items``.

    Shop, active mark and creation time of a known item stay, even where they are null; numbers are always overwritten,
    texts only by a value. A new item is active and created at the time of its first action.
    """
    new = item_changes(actions)
    missing = [f for f in ITEMS if f.name not in items.columns]
    old = items.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).withColumn("_known", F.lit(True))
    both = old.alias("o").join(new.withColumn("is_active", F.lit(True)).alias("n"), "item_sku", "full")

    def merged(c: str) -> Column:
        if c in _FIRST:
            return F.when(F.col("_known"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.coalesce(f"n.{c}", f"o.{c}").alias(c)

    more = [c for c in items.columns if c not in ITEMS.names]
    return both.select("item_sku", *(merged(f.name) for f in ITEMS if f.name != "item_sku"), *(f"o.{c}" for c in more))


def _version(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*(value.alias(c) for c, value in fields.items())), {"ignoreNullFields": "false"})


def item_audit(items: DataFrame, actions: DataFrame, user: str = DEFAULT_USER, share: float = SHARE) -> DataFrame:
    """One audit row per accepted action that finds its item in place, with the item before and after it as JSON.

    ``items`` are the items before the first action. An action that changes nothing is listed like any other; the one that
    creates an item is not, those after it are. The versions of an item are running values over its actions, so an item with
    very many actions is spread. An item without actions takes no part beyond a join on its key.
    """
    changing = (*_LATEST, *_KEPT, "updated_at")
    missing = [f for f in ITEMS if f.name not in items.columns]
    known = items.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).withColumn("_known", F.lit(True))
    columns = [*ITEMS.names, *(c for c in items.columns if c not in ITEMS.names)]
    settled = [c for c in columns if c not in (*changing, "item_sku")]

    # What no action changes comes from the item or, for a new one, from its first action, and is seen by all of them.
    born = actions.groupBy("item_sku").agg(F.min(F.struct("created_at", "seq", "shop_type")).alias("_f"))
    first = {"shop_code": F.col("_f.shop_type"), "is_active": F.lit(True), "created_at": F.col("_f.created_at")}
    none = F.lit(None)
    fixed = F.struct(*(F.when(F.col("_known"), F.col(c)).otherwise(first.get(c, none)).alias(c) for c in settled))
    seed = born.join(known, "item_sku", "left").select(
        "item_sku", F.lit(0).alias("_phase"), F.col("_f.created_at").alias("_at"), F.col("_f.seq").alias("seq"),
        *changing, "_known", fixed.alias("_settled"))
    steps = actions.withColumn("updated_at", F.col("created_at")).select(
        "item_sku", F.lit(1).alias("_phase"), F.col("created_at").alias("_at"), "seq", *changing, F.lit(True).alias("_known"))
    lasts = {f"_b_{c}": F.col(c) for c in (*changing, "_known", "_settled")}
    walked = running(
        seed.unionByName(steps, allowMissingColumns=True), ["item_sku"], ["_phase", "_at", "seq"], lasts=lasts, share=share,
    ).where((F.col("_phase") == 1) & F.col("_b__known"))

    before = {c: F.col(f"_b_{c}") if c in changing else F.col(f"_b__settled.{c}") for c in columns if c != "item_sku"}
    after = {c: F.coalesce(F.col(c), value) if c in changing else value for c, value in before.items()}
    sku = {"item_sku": F.col("item_sku")}
    return walked.select(
        "seq", F.lit("items").alias("table_name"), F.col("item_sku").alias("row_pk"), F.lit("UPDATE").alias("action"),
        F.lit(user).alias("changed_by"), F.col("_at").alias("changed_at"),
        _version(sku | before).alias("old_data"), _version(sku | after).alias("new_data"))


def upsert_customers(customers: DataFrame, actions: DataFrame, user: str = DEFAULT_USER) -> DataFrame:
    """Customers after the accepted actions: one per contact text of a rental, blank contacts as a walk-in."""
    new = new_customers(actions, user).join(customers.select("display_name"), "display_name", "left_anti")
    return customers.unionByName(new.select("id", "display_name", "created_at", "created_by"), allowMissingColumns=True)


def new_customers(actions: DataFrame, user: str = DEFAULT_USER) -> DataFrame:
    """One row per contact text of a rental, created by ``user`` at the first of its bookings."""
    name = F.coalesce("customer_name_contact", F.lit(WALK_IN)).alias("display_name")
    booked = actions.where(F.col("action_type") == "Rental Out").select(name, "created_at")
    return booked.groupBy("display_name").agg(F.min("created_at").alias("created_at")).select(
        customer_id(F.col("display_name")).alias("id"), "display_name", "created_at", F.lit(user).alias("created_by"))


def open_rentals(
    actions: DataFrame, customers: DataFrame | None = None, user: str = DEFAULT_USER,
) -> DataFrame:
    """Bookings the accepted actions open. ``customers`` gives ids to names it already knows."""
    name = F.coalesce("customer_name_contact", F.lit(WALK_IN))
    rows = actions.where(F.col("action_type") == "Rental Out").withColumn("display_name", name)
    known = F.lit(None).cast("string")
    if customers is not None:
        rows = rows.join(customers.select(F.col("id").alias("_known"), "display_name"), "display_name", "left")
        known = F.col("_known").cast("string")
    return rows.select(
        F.col("seq").cast(ROW_ID).alias("id"), "item_sku",
        F.coalesce(known, customer_id(F.col("display_name"))).alias("customer_id"),
        F.col("created_at").alias("booked_at"), F.col("rental_due_date").cast("date").alias("due_date"),
        F.lit(None).cast("timestamp_ntz").alias("returned_at"), F.col("sell_price").alias("rental_price"),
        "quantity", F.lit("Rented").alias("status"), "notes", "created_at", F.lit(user).alias("created_by"),
    )


def rental_closures(actions: DataFrame) -> DataFrame:
    """(booking, return time) of the bookings the accepted returns close."""
    return actions.where(F.col("closes").isNotNull()).select(
        F.col("closes.id").alias("id"), "item_sku", F.col("created_at").alias("_returned_at")
    )


def close_rentals(rentals: DataFrame, actions: DataFrame) -> DataFrame:
    """Bookings, old and new, with those closed by the accepted returns marked as returned.

    Only open bookings are joined to the returns; the others, nearly all of a long history, pass by.
    """
    # A booking is found by id and SKU together: ids of a batch need not differ from older ids of other SKUs.
    is_open = F.col("status").eqNullSafe("Rented")
    joined = rentals.where(is_open).join(rental_closures(actions), ["id", "item_sku"], "left")
    done = F.col("_returned_at").isNotNull()
    closed = joined.withColumns(
        {
            "returned_at": F.when(done, F.col("_returned_at")).otherwise(F.col("returned_at")),
            "status": F.when(done, "Returned").otherwise(F.col("status")),
        }
    )
    return rentals.where(~is_open).unionByName(closed.select(*rentals.columns))


def append_lifecycle(actions: DataFrame, user: str = DEFAULT_USER) -> DataFrame:
    """Lifecycle events of status changes and of returns that name a lifecycle status."""
    change = F.col("action_type") == "Status Change"
    back = (F.col("action_type") == "Rental Return") & F.col("bridal_status").isin(*LIFECYCLE_STATUSES)
    return actions.where(change | F.coalesce(back, F.lit(False))).select(
        F.col("seq").cast(ROW_ID).alias("id"), "item_sku",
        F.coalesce("bridal_status", F.lit("Available")).alias("status"), "notes",
        F.col("created_at").alias("occurred_at"), F.lit(user).alias("recorded_by"),
    )


def append_movements(actions: DataFrame, user: str = DEFAULT_USER) -> DataFrame:
    return actions.where(F.col("action_type").isin(*LEDGER_ACTIONS)).select(
        F.col("seq").cast(ROW_ID).alias("id"), "item_sku", "action_type", "quantity_change",
        F.col("stock_cost_price").alias("unit_cost_price"), "notes", "created_at", F.lit(user).alias("created_by"),
    )


def action_result(actions: DataFrame) -> DataFrame:
    """What the caller of each accepted action is told."""
    action, sell, cost = F.col("action_type"), F.col("sell_price"), F.col("stock_cost_price")
    booked, back = action == "Rental Out", action == "Rental Return"
    quiet = back | (action == "Status Change")
    zero = F.lit(0).cast(MONEY)
    number = F.when(back, F.col("closes.id")).otherwise(F.col("seq").cast(ROW_ID))
    at = F.when(back, F.coalesce("closes.booked_at", "created_at")).otherwise(F.col("created_at"))
    return actions.select(
        "seq", number.alias("id"), at.alias("created_at"), "item_sku", "item_name", "action_type",
        F.when(booked, F.col("quantity")).alias("quantity"),
        F.when(booked, sell).when(quiet, zero).otherwise(money(sell - cost)).alias("gross_profit"),
        # A low price against a high cost gives a margin far below -100 %, hence the wider type.
        F.when(booked, F.lit(100)).when(quiet, F.lit(0)).otherwise(
            F.when(sell == 0, F.lit(0)).otherwise(F.round((sell - cost) / sell * 100, 2))
        ).cast("decimal(20,2)").alias("profit_margin"),
    )


@dataclass(frozen=True)
class Ingested:
    tables: Tables
    rejects: DataFrame
    results: DataFrame
    audit: DataFrame | None = None


def ingest(
    raw: DataFrame, tables: Tables, share: float = SHARE, user: str = DEFAULT_USER, audit: bool = False,
) -> Ingested:
    """Apply a batch of raw actions to the tables; ``user`` is noted on every row it adds.

    ``audit`` asks for the audit rows of all updates of items, too (``item_audit``).
    """
    decided = decide(raw, tables.rentals, share)
    actions = accepted(decided)
    customers = upsert_customers(tables.customers, actions, user)
    opened = tables.rentals.unionByName(open_rentals(actions, tables.customers, user), allowMissingColumns=True)
    after = Tables(
        upsert_items(tables.items, actions),
        tables.movements.unionByName(append_movements(actions, user), allowMissingColumns=True),
        tables.lifecycle.unionByName(append_lifecycle(actions, user), allowMissingColumns=True),
        customers,
        close_rentals(opened, actions),
    )
    trail = item_audit(tables.items, actions, user, share) if audit else None
    return Ingested(after, rejected(decided), action_result(actions), trail)


# --- data quality --------------------------------------------------------------------------------------------------


def _violations(df: DataFrame, table: str, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per broken rule; all rules of a table are tested in a single pass over it."""
    checks = [
        F.when(
            F.coalesce(broken, F.lit(False)),
            F.struct(F.lit(f"{table}.{name}").alias("rule"), value.cast("string").alias("value")),
        )
        for name, (broken, value) in rules.items()
    ]
    return df.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*checks))).alias("v")) \
        .select(F.col("v.rule").alias("rule"), "key", F.col("v.value").alias("value"))


def _not_null(*columns: str) -> dict[str, tuple[Column, Column]]:
    return {f"{c} not null": (F.col(c).isNull(), F.col(c)) for c in columns}


def _lengths(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    return {f"{c} length": (F.length(c) > size, F.col(c)) for c, size in TEXT_LENGTHS.items() if c in df.columns}


def _allowed(column: str, values: tuple[str, ...]) -> dict[str, tuple[Column, Column]]:
    return {f"{column} value": (~F.col(column).isin(*values), F.col(column))}


def _duplicates(df: DataFrame, table: str, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) & F.col(key).isNotNull()).select(
        F.lit(f"{table}.{key} unique").alias("rule"), F.col(key).cast("string").alias("key"),
        F.col("_n").cast("string").alias("value"),
    )


def _keys_at_fault(tables: Mapping[str, DataFrame], held: Sequence[tuple], used: Sequence[tuple]) -> DataFrame:
    """Keys that several rows hold, and keys that are referred to while no row holds them: (domain, key, n).

    ``held``: (domain, table, column, condition), ``used``: (domain, table, column); ``n`` is the number of holders, 0 for a
    key that is missing. All tables meet in one aggregation by domain and key, which adds up inside the map tasks first, so
    a SKU with very many rows is one row per task.
    """
    uses = {name: [] for name in tables}
    for domain, name, column, *where in held:
        key = F.when(where[0], F.col(column)) if where else F.col(column)
        uses[name].append((domain, key, 1))
    for domain, name, column in used:
        uses[name].append((domain, F.col(column), 0))
    union = None
    for name, df in tables.items():
        listed = F.array(*(
            F.struct(F.lit(domain).alias("domain"), key.cast("string").alias("key"), F.lit(n).alias("n"))
            for domain, key, n in uses[name]))
        part = df.select(F.explode(listed).alias("use")).select("use.*")
        union = part if union is None else union.unionByName(part)
    totals = union.where(F.col("key").isNotNull()).groupBy("domain", "key").agg(F.sum("n").alias("n"))
    return totals.where(F.col("n") != 1)


def _marked(df: DataFrame, faults: DataFrame, domain: str, column: str) -> DataFrame:
    """Rows with ``_no_<column>``, true where the key they refer to is missing."""
    missing = faults.where((F.col("domain") == domain) & (F.col("n") == 0)).select(
        F.col("key").alias("_key"), F.lit(True).alias(f"_no_{column}"))
    return df.join(missing, F.col(column).cast("string") == F.col("_key"), "left").drop("_key")


def _exists(*columns: str) -> dict[str, tuple[Column, Column]]:
    return {f"{c} exists": (F.col(f"_no_{c}"), F.col(c)) for c in columns}


def _required(df: DataFrame, *columns: str) -> dict[str, tuple[Column, Column]]:
    """Not-null rules of columns that have defaults, tested where a frame carries them."""
    return _not_null(*(c for c in columns if c in df.columns))


def check_constraints(tables: Tables, shops: DataFrame | None = None) -> DataFrame:
    """Every column, value, uniqueness and reference rule of the tables as a report (rule, key, value).

    ``shops``: the shop table that items refer to; without it the two fixed shops are the only check.

    Every table is read twice. The first pass finds keys held twice and keys that are missing, which are held in the scratch
    folder; the second tests the rows, and looks their references up among the missing keys.
    """
    t = tables
    item_rules = _not_null("item_sku", "shop_code", "item_name", "stock_cost_price", "sell_price", "min_stock_alert")
    item_rules |= _required(t.items, "is_active", "created_at", "updated_at")
    item_rules |= _allowed("shop_code", SHOPS) | _lengths(t.items)
    item_rules |= {f"{c} >= 0": (F.col(c) < 0, F.col(c)) for c in ("stock_cost_price", "sell_price")}
    move_rules = _not_null("item_sku", "action_type", "quantity_change", "created_at") | _lengths(t.movements)
    move_rules |= _allowed("action_type", MOVEMENT_ACTIONS) | _required(t.movements, "created_by")
    life_rules = _not_null("item_sku", "status", "occurred_at") | _allowed("status", LIFECYCLE_STATUSES)
    life_rules |= _lengths(t.lifecycle) | _required(t.lifecycle, "recorded_by")
    rent_rules = _not_null("item_sku", "customer_id", "booked_at", "due_date", "rental_price", "quantity", "status")
    rent_rules |= _allowed("status", RENTAL_STATUSES) | _lengths(t.rentals)
    rent_rules |= _required(t.rentals, "created_at", "created_by")
    rent_rules |= {
        "quantity > 0": (F.col("quantity") <= 0, F.col("quantity")),
        "due_date >= booked_at": (F.col("due_date") < F.col("booked_at").cast("date"), F.col("due_date")),
    }
    customer_rules = _not_null("id", "display_name") | _lengths(t.customers)
    customer_rules |= _required(t.customers, "created_at", "created_by")
    if "email" in t.customers.columns:
        customer_rules["email form"] = (~F.col("email").rlike(EMAIL_PATTERN), F.col("email"))
    sku, customer, shop = "items.item_sku", "customers.id", "shops.shop_code"
    named = {
        "items": t.items, "customers": t.customers, "stock_movements": t.movements, "item_lifecycle_events": t.lifecycle,
        "rentals": t.rentals,
    }
    held = [
        (sku, "items", "item_sku"), (customer, "customers", "id"), ("customers.display_name", "customers", "display_name"),
        *((f"{name}.id", name, "id") for name in ("stock_movements", "item_lifecycle_events", "rentals")),
        ("rentals open.item_sku", "rentals", "item_sku", F.col("status") == "Rented"),
    ]
    used = [(sku, name, "item_sku") for name in ("stock_movements", "item_lifecycle_events", "rentals")]
    used.append((customer, "rentals", "customer_id"))
    if shops is not None:
        named["shops"] = shops
        held.append((shop, "shops", "shop_code"))
        used.append((shop, "items", "shop_code"))
    path = scratch_path(t.items.sparkSession, "keys")
    _keys_at_fault(named, held, used).write.parquet(path)
    faults = t.items.sparkSession.read.schema("domain string, key string, n bigint").parquet(path)

    movements, lifecycle = (_marked(df, faults, sku, "item_sku") for df in (t.movements, t.lifecycle))
    rentals = _marked(_marked(t.rentals, faults, sku, "item_sku"), faults, customer, "customer_id")
    items = t.items if shops is None else _marked(t.items, faults, shop, "shop_code")
    parts = [
        _violations(items, "items", "item_sku", item_rules | (_exists("shop_code") if shops is not None else {})),
        _violations(movements, "stock_movements", "id", move_rules | _exists("item_sku")),
        _violations(lifecycle, "item_lifecycle_events", "id", life_rules | _exists("item_sku")),
        _violations(rentals, "rentals", "id", rent_rules | _exists("item_sku", "customer_id")),
        _violations(t.customers, "customers", "id", customer_rules),
        faults.where((F.col("n") > 1) & (F.col("domain") != shop)).select(
            F.concat("domain", F.lit(" unique")).alias("rule"), "key", F.col("n").cast("string").alias("value")),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def check_log(log: DataFrame) -> DataFrame:
    """The rules of the single-table log."""
    status = F.col("bridal_status")
    rules = _not_null("shop_type", "item_sku", "item_name", "stock_cost_price", "sell_price", "action_type")
    rules |= _allowed("shop_type", SHOPS) | _allowed("action_type", ACTIONS) | _lengths(log)
    rules["bridal_status value"] = (~status.isin(*BRIDAL_STATUSES), status)
    rules |= _not_null("seq")
    return _violations(log, "log", "seq", rules).unionByName(_duplicates(log, "log", "seq"))


# --- delete and guard ----------------------------------------------------------------------------------------------


def _normal_skus(skus: DataFrame) -> DataFrame:
    return skus.select(normalize_sku(F.col("item_sku")).alias("item_sku")).distinct()


def delete_items(tables: Tables, skus: DataFrame, shop: str | None = None) -> tuple[Tables, DataFrame]:
    """Remove items with all their rows; also the number of rows removed per SKU (0 where no item matched)."""
    if shop is not None and shop not in SHOPS:
        raise ValueError('shop_type must be "Bags" or "Bridal".')
    wanted = _normal_skus(skus)
    held = tables.items.where(F.col("shop_code") == shop) if shop else tables.items
    doomed = wanted.join(held.select("item_sku"), "item_sku", "left_semi")

    def survivors(df: DataFrame) -> DataFrame:
        return df.join(doomed, "item_sku", "left_anti")

    rows = None
    for df in (tables.items, tables.movements, tables.lifecycle, tables.rentals):
        part = df.select("item_sku").join(doomed, "item_sku", "left_semi")
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("item_sku").agg(F.count(F.lit(1)).alias("deleted"))
    report = wanted.join(counts, "item_sku", "left").select(
        "item_sku", F.coalesce("deleted", F.lit(0).cast("bigint")).alias("deleted")
    )
    after = Tables(
        survivors(tables.items), survivors(tables.movements), survivors(tables.lifecycle), tables.customers,
        survivors(tables.rentals),
    )
    return after, report


def delete_item(tables: Tables, sku: str, shop: str | None = None) -> tuple[Tables, DataFrame]:
    one = tables.items.sparkSession.createDataFrame([(sku,)], "item_sku string")
    return delete_items(tables, one, shop)


def guard_actions(raw: DataFrame, live: DataFrame, rentals: DataFrame, share: float = SHARE) -> DataFrame:
    """Soft checks before logging: booking an item without stock, returning an item nobody has rented."""
    decided = accepted(decide(raw, rentals, share))
    stock = live.select("item_sku", "live_stock")
    action = F.col("action_type")
    checked = decided.where(action.isin("Rental Out", "Rental Return")).join(stock, "item_sku", "left")
    no_stock = (action == "Rental Out") & (F.coalesce("live_stock", F.lit(0)) <= 0)
    orphan = (action == "Rental Return") & F.col("closes").isNull()
    return checked.select(
        "seq", "created_at", "item_sku", "action_type",
        F.when(no_stock, "reject: no stock").when(orphan, "warn: no open rental").alias("warning"),
    ).where(F.col("warning").isNotNull())
