"""Current state and history derived from the normalized tables.

Everything per item comes from one rollup per child table (sum, count and newest row in the same aggregation), so
each child table is scanned and shuffled once, and a SKU with very many rows is reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import margin_pct, money
from ..schemas import TOTAL, Tables
from ..session import held
from .ordered import SHARE, global_row_number, running

_MOVE, _LIFE, _RENT = 1, 2, 3  # source rank: breaks ties between tables, newest wins
_NOBODY = "\u0001"  # starts a join key that no customer id can have


def _rental_action() -> Column:
    return F.when(F.col("status") == "Rented", "Rental Out").otherwise("Rental Return")


def _event(at: str, source: int, action: Column) -> Column:
    return F.struct(
        F.col(at).alias("at"), F.lit(source).alias("src"), F.col("id").alias("seq"),
        action.alias("action"), F.col("notes").alias("notes"),
    )


def _latest_status() -> Column:
    return F.max(F.struct("occurred_at", "id", "status"))["status"]


def _open_rental() -> Column:
    row = F.struct("booked_at", "id", "due_date", "customer_id", "quantity")
    return F.max(F.when(F.col("status") == "Rented", row))


def movement_rollup(movements: DataFrame) -> DataFrame:
    """Per SKU: stock, number of sales rows, newest movement."""
    sale = F.col("action_type").isin("New Item", "Retail Sale")
    return movements.groupBy("item_sku").agg(
        F.sum("quantity_change").alias("live_stock"),
        F.count_if(sale).alias("sales_count"),
        F.max(_event("created_at", _MOVE, F.col("action_type"))).alias("last_move"),
    )


def rental_rollup(rentals: DataFrame) -> DataFrame:
    """Per SKU: revenue over all bookings, the open booking if any, newest booking."""
    return rentals.groupBy("item_sku").agg(
        F.sum("rental_price").cast(TOTAL).alias("rental_revenue"),
        _open_rental().alias("open_rental"),
        F.max(_event("booked_at", _RENT, _rental_action())).alias("last_booking"),
    )


def lifecycle_rollup(lifecycle: DataFrame) -> DataFrame:
    """Per SKU: newest lifecycle status and the event that set it."""
    return lifecycle.groupBy("item_sku").agg(
        _latest_status().alias("lifecycle_status"),
        F.max(_event("occurred_at", _LIFE, F.lit("Status Change"))).alias("last_change"),
    )


def _status(shop: Column, open_id: Column, lifecycle_status: Column) -> Column:
    """Only bridal items carry a status."""
    return F.when(
        shop == "Bridal",
        F.when(open_id.isNotNull(), "Rented").otherwise(F.coalesce(lifecycle_status, F.lit("Available"))),
    )


def item_stock(items: DataFrame, movements: DataFrame) -> DataFrame:
    stock = movements.groupBy("item_sku").agg(F.sum("quantity_change").alias("live_stock"))
    level = F.coalesce("live_stock", F.lit(0).cast("bigint"))
    return items.join(stock, "item_sku", "left").select(
        "item_sku", "item_name", "shop_code", level.alias("live_stock"), "min_stock_alert",
        (level <= F.col("min_stock_alert")).alias("low_stock"),
    )


def item_current_status(items: DataFrame, lifecycle: DataFrame, rentals: DataFrame) -> DataFrame:
    latest = lifecycle.groupBy("item_sku").agg(_latest_status().alias("lifecycle_status"))
    opened = open_rentals_view(rentals).groupBy("item_sku").agg(_open_rental().alias("open_rental"))
    return (
        items.where(F.col("shop_code") == "Bridal").select("item_sku", "shop_code")
        .join(latest, "item_sku", "left").join(opened, "item_sku", "left")
        .select(
            "item_sku", "shop_code",
            _status(F.col("shop_code"), F.col("open_rental.id"), F.col("lifecycle_status")).alias("current_status"),
            F.col("open_rental.id").alias("active_rental_id"),
            F.col("open_rental.due_date").alias("rental_due_date"),
            F.col("open_rental.customer_id").alias("customer_id"),
        )
    )


def item_profit(items: DataFrame) -> DataFrame:
    sell, cost = F.col("sell_price"), F.col("stock_cost_price")
    none = F.lit(None).cast("decimal(10,2)")
    return items.select(
        "item_sku", "item_name", "sell_price", "stock_cost_price", money(sell - cost).alias("gross_profit"),
        F.when(sell > 0, margin_pct(sell, cost)).otherwise(none).alias("profit_margin_pct"),
    )


def unified_history(
    items: DataFrame, movements: DataFrame, lifecycle: DataFrame, rentals: DataFrame
) -> DataFrame:
    """Ledger rows only, in the row shape of the single-table log."""
    status = item_current_status(items, lifecycle, rentals).select("item_sku", "current_status", "rental_due_date")
    described = items.join(status, "item_sku", "left")
    cost = F.coalesce("unit_cost_price", "stock_cost_price")
    return movements.join(described.drop("created_at"), "item_sku").select(
        "id", "created_at", F.col("shop_code").alias("shop_type"), "item_sku", "item_name", "brand_designer",
        "item_image", cost.alias("stock_cost_price"), "sell_price",
        money(F.col("sell_price") - cost).alias("gross_profit"), "quantity_change", "min_stock_alert", "bag_color",
        "bridal_size", F.col("current_status").alias("bridal_status"), "rental_due_date",
        F.lit(None).cast("string").alias("customer_name_contact"), "action_type", "notes",
    )


def sales_count(movements: DataFrame) -> DataFrame:
    """Number of New Item and Retail Sale rows per SKU: rows, not units."""
    sale = F.col("action_type").isin("New Item", "Retail Sale")
    return movements.groupBy("item_sku").agg(F.count_if(sale).alias("sales_count"))


def rental_revenue(rentals: DataFrame) -> DataFrame:
    """Booked revenue per SKU over every status, cancelled bookings included."""
    return rentals.groupBy("item_sku").agg(F.sum("rental_price").cast(TOTAL).alias("rental_revenue"))


def latest_event(movements: DataFrame, lifecycle: DataFrame, rentals: DataFrame) -> DataFrame:
    """Newest event per SKU over the three child tables."""
    events = (
        movements.select("item_sku", _event("created_at", _MOVE, F.col("action_type")).alias("event"))
        .unionByName(
            lifecycle.select("item_sku", _event("occurred_at", _LIFE, F.lit("Status Change")).alias("event"))
        )
        .unionByName(rentals.select("item_sku", _event("booked_at", _RENT, _rental_action()).alias("event")))
    )
    return events.groupBy("item_sku").agg(F.max("event").alias("event")).select(
        "item_sku", F.col("event.action").alias("action_type"), F.col("event.at").alias("occurred_at"),
        F.col("event.notes").alias("notes"),
    )


def active_rental(rentals: DataFrame) -> DataFrame:
    """Newest open booking per SKU."""
    return open_rentals_view(rentals).groupBy("item_sku").agg(_open_rental().alias("r")).select(
        "item_sku", F.col("r.customer_id").alias("customer_id"), F.col("r.quantity").alias("rental_quantity")
    )


def latest_lifecycle(lifecycle: DataFrame) -> DataFrame:
    return lifecycle.groupBy("item_sku").agg(_latest_status().alias("status"))


def open_rentals_view(rentals: DataFrame) -> DataFrame:
    return rentals.where(F.col("status") == "Rented")


def _with_customer(bookings: DataFrame, customers: DataFrame) -> DataFrame:
    # Most SKUs have no open booking. Their missing customer id is replaced by a key that matches nobody and differs
    # per SKU, otherwise all of them would meet in one task of this join.
    spread = F.coalesce(F.col("open_rental.customer_id").cast("string"), F.concat(F.lit(_NOBODY), "item_sku"))
    names = customers.select(
        F.col("id").cast("string").alias("_customer"), F.col("display_name").alias("customer_name_contact")
    )
    return bookings.withColumn("_customer", spread).join(names, "_customer", "left").drop("_customer")


def live_inventory(tables: Tables, with_customer: bool = True) -> DataFrame:
    """One row per item with its current state.

    ``with_customer=False`` leaves ``customer_name_contact`` out and with it the join to the customers, which boards
    of figures do not need. Other unused parts drop out by themselves, because the rollups are unique per SKU.
    """
    bookings = rental_rollup(tables.rentals)
    if with_customer:
        bookings = _with_customer(bookings, tables.customers)
    joined = (
        tables.items.join(movement_rollup(tables.movements), "item_sku", "left")
        .join(bookings, "item_sku", "left")
        .join(lifecycle_rollup(tables.lifecycle), "item_sku", "left")
    )
    sell, cost = F.col("sell_price"), F.col("stock_cost_price")
    sales = F.coalesce("sales_count", F.lit(0).cast("bigint"))
    rented = F.coalesce("rental_revenue", F.lit(0).cast(TOTAL))
    bridal = F.col("shop_code") == "Bridal"
    last = F.greatest("last_move", "last_change", "last_booking")
    return joined.select(
        F.col("item_sku").alias("id"),
        "item_sku",
        "item_name",
        "brand_designer",
        "item_image",
        F.col("shop_code").alias("shop_type"),
        "bag_color",
        "bridal_size",
        _status(F.col("shop_code"), F.col("open_rental.id"), F.col("lifecycle_status")).alias("bridal_status"),
        F.when(bridal, F.col("open_rental.due_date")).alias("rental_due_date"),
        *(("customer_name_contact",) if with_customer else ()),
        "min_stock_alert",
        "sell_price",
        "stock_cost_price",
        last["action"].alias("last_action"),
        last["at"].alias("last_updated"),
        last["notes"].alias("notes"),
        F.coalesce("live_stock", F.lit(0).cast("bigint")).alias("live_stock"),
        ((sell - cost) * sales + rented).cast(TOTAL).alias("total_gross_profit"),
        (sell * sales + rented).cast(TOTAL).alias("total_revenue"),
        margin_pct(sell, cost).alias("profit_margin"),
        F.col("open_rental.quantity").alias("rental_quantity"),
    )


_HISTORY = (
    "created_at", "shop_type", "item_sku", "item_name", "brand_designer", "item_image", "stock_cost_price",
    "sell_price", "gross_profit", "profit_margin", "quantity_change", "bag_color", "min_stock_alert",
    "bridal_size", "bridal_status", "rental_due_date", "customer_name_contact", "action_type", "notes",
)


def _history_events(tables: Tables) -> DataFrame:
    """The three event kinds in one narrow shape; item columns are joined later."""
    no_text, no_day = F.lit(None).cast("string"), F.lit(None).cast("date")
    no_money = F.lit(None).cast("decimal(10,2)")

    def shape(df, source, at, qty, cost, price, status, due, customer, action):
        return df.select(
            F.col(at).alias("created_at"), F.lit(source).alias("src"), F.col("id").alias("seq"), "item_sku",
            qty.cast("int").alias("quantity_change"), cost.alias("_unit_cost"), price.alias("_booking_price"),
            status.alias("_own_status"), due.alias("rental_due_date"), customer.alias("customer_name_contact"),
            action.alias("action_type"), "notes",
        )

    # Only bookings have a customer, so the name is looked up for them alone.
    names = tables.customers.select(F.col("id").alias("customer_id"), "display_name")
    bookings = tables.rentals.join(names, "customer_id", "left")
    return (
        shape(tables.movements, _MOVE, "created_at", F.col("quantity_change"), F.col("unit_cost_price"), no_money,
              no_text, no_day, no_text, F.col("action_type"))
        .unionByName(
            shape(tables.lifecycle, _LIFE, "occurred_at", F.lit(0), no_money, no_money, F.col("status"), no_day,
                  no_text, F.lit("Status Change"))
        )
        .unionByName(
            shape(bookings, _RENT, "booked_at", F.col("quantity"), no_money, F.col("rental_price"), F.col("status"),
                  F.col("due_date"), F.col("display_name"), _rental_action())
        )
    )


def history(tables: Tables, with_id: bool = True) -> DataFrame:
    """Every event as one chronological log; ``id`` is the 1-based position by (created_at, source, seq).

    Numbering needs the whole log in order, so it is done on the narrow events before the item columns are joined.
    ``with_id=False`` skips that step and leaves the order columns out as well.
    """
    events = _history_events(tables)
    return _described(tables, _numbered(tables, events) if with_id else events, with_id)


def history_actions(tables: Tables) -> DataFrame:
    """(id, created_at, item_sku, action_type, quantity_change) of ``history``, numbered and written without the rest."""
    events = _history_events(tables).select(*_RANK, "item_sku", "action_type", "quantity_change")
    return _numbered(tables, events).join(_item_texts(tables).select("item_sku"), "item_sku").select(
        "id", "created_at", "item_sku", "action_type", "quantity_change")


def _numbered(tables: Tables, events: DataFrame) -> DataFrame:
    """Events with their 1-based position; events of unknown items take no number."""
    known = events.join(tables.items.select("item_sku"), "item_sku", "left_semi")
    # Ranges are drawn in a pass of their own, so the events are derived once before it.
    return global_row_number(held(known, "events"), _RANK, "id")


def _item_texts(tables: Tables) -> DataFrame:
    """What history shows of an item."""
    status = item_current_status(tables.items, tables.lifecycle, tables.rentals).select("item_sku", "current_status")
    return tables.items.join(status, "item_sku", "left").select(
        "item_sku", F.col("shop_code").alias("shop_type"), "item_name", "brand_designer", "item_image",
        F.col("stock_cost_price").alias("_item_cost"), F.col("sell_price").alias("_item_sell"), "bag_color",
        "min_stock_alert", "bridal_size", "current_status",
    )


def _described(tables: Tables, events: DataFrame, with_id: bool) -> DataFrame:
    """Events with the columns of their items, prices and statuses."""
    joined = events.join(_item_texts(tables), "item_sku")

    booking, moved = F.col("src") == _RENT, F.col("src") == _MOVE
    cost = F.when(booking, money(F.lit(0))).otherwise(F.coalesce("_unit_cost", "_item_cost"))
    sell = F.when(booking, F.col("_booking_price")).otherwise(F.col("_item_sell"))
    priced = joined.withColumns({"stock_cost_price": cost, "sell_price": sell}).withColumns(
        {
            "gross_profit": money(F.col("sell_price") - F.col("stock_cost_price")),
            "profit_margin": F.when(booking, money(F.lit(100))).otherwise(
                margin_pct(F.col("sell_price"), F.col("stock_cost_price"))
            ),
            "bridal_status": F.when(moved, F.col("current_status")).otherwise(F.col("_own_status")),
        }
    )
    return priced.select(*(("id",) if with_id else ()), *_HISTORY)


_RANK = ("created_at", "src", "seq")


def _event_keys(tables: Tables, items: DataFrame) -> DataFrame:
    """(created_at, src, seq, item_sku) of the events of ``items``, straight from the three event tables."""
    parts = ((tables.movements, _MOVE, "created_at"), (tables.lifecycle, _LIFE, "occurred_at"), (tables.rentals, _RENT, "booked_at"))
    union = None
    for df, source, at in parts:
        keys = df.select(F.col(at).alias("created_at"), F.lit(source).alias("src"), F.col("id").alias("seq"), "item_sku")
        union = keys if union is None else union.unionByName(keys)
    return union.join(items.select("item_sku"), "item_sku", "left_semi")


def _ranks(keys: DataFrame, wanted: list) -> list[int]:
    """How many rows of ``keys`` come up to each of the ``wanted`` rows, which are in order and few enough for a literal.

    One aggregation over the bare keys: each row finds the wanted rows before it by bisection, whatever times they share.
    """
    schema = keys.select(*_RANK).schema
    text = "[" + ",".join(
        f'{{"created_at":{"null" if r.created_at is None else chr(34) + r.created_at.isoformat() + chr(34)},"src":{r.src},"seq":{r.seq}}}'
        for r in wanted) + "]"
    cuts = F.from_json(F.lit(text), f"array<{schema.simpleString()}>")
    row = F.struct(*_RANK)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(wanted).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) < row, at + s).otherwise(at))
    # Nearly all of a long log lies before a page.
    place = F.when(row <= F.get(cuts, F.lit(0)), F.lit(0)).otherwise(place)
    counts = {r.place: r.n for r in keys.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks, total = [], 0
    for k in range(len(wanted)):
        total += counts.get(k, 0)
        ranks.append(total)
    return ranks


def history_page(tables: Tables, shop: str | None, sku: str | None, size: int) -> DataFrame:
    """The newest ``size`` rows of ``history`` (of a shop, of a SKU) with their ids, without numbering the log.

    The id of an event is the number of events up to it. Both the choice of the page and the counts work on bare keys; names,
    prices and statuses are looked up for the rows of the page only. What comes back to the driver is no longer than the page.
    """
    spark = tables.items.sparkSession
    items = tables.items if shop is None else tables.items.where(F.col("shop_code") == shop)
    rows = _event_keys(tables, items if sku is None else items.where(F.col("item_sku") == sku))
    newest = rows.orderBy(*(F.col(c).desc() for c in _RANK)).limit(size)
    found = newest.collect()[::-1]
    ranks = _ranks(_event_keys(tables, tables.items), found) if found else []
    kind = newest.select("item_sku", *_RANK, F.lit(0).cast("bigint").alias("id")).schema
    page = spark.createDataFrame([(r.item_sku, r.created_at, r.src, r.seq, n) for r, n in zip(found, ranks)], kind)

    skus = F.broadcast(page.select("item_sku").distinct())
    of_page = lambda df: df.join(skus, "item_sku", "left_semi")
    listed = lambda df, source: df.join(
        F.broadcast(page.where(F.col("src") == source).select("item_sku", F.col("seq").alias("id"))), ["item_sku", "id"], "left_semi")
    near = Tables(of_page(tables.items), tables.movements, of_page(tables.lifecycle), tables.customers, of_page(tables.rentals))
    events = _history_events(Tables(
        near.items, listed(tables.movements, _MOVE), listed(tables.lifecycle, _LIFE), tables.customers, listed(tables.rentals, _RENT)))
    asked = page.select("id", *(F.col(c).alias(f"_p_{c}") for c in ("item_sku", *_RANK)))
    same = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in ("item_sku", *_RANK)]
    numbered = events.join(F.broadcast(asked), same).select(*events.columns, "id")
    return _described(near, numbered, True).orderBy(F.col("created_at").desc(), F.col("id").desc())


def legacy_live(log: DataFrame) -> DataFrame:
    """Current state straight from the single-table log: newest row per SKU plus running totals."""
    meta = (
        "shop_type", "item_name", "brand_designer", "item_image", "stock_cost_price", "sell_price",
        "min_stock_alert", "bag_color", "bridal_size", "bridal_status", "rental_due_date",
        "customer_name_contact", "action_type", "notes",
    )
    rolled = log.groupBy("item_sku").agg(
        F.max(F.struct("created_at", "seq", *meta)).alias("last"),
        F.coalesce(F.sum("quantity_change"), F.lit(0)).alias("live_stock"),
        F.sum("gross_profit").cast(TOTAL).alias("total_gross_profit"),
    )
    names = {"action_type": "last_action"}
    return rolled.select(
        "item_sku", *(F.col(f"last.{c}").alias(names.get(c, c)) for c in meta),
        F.col("last.created_at").alias("last_updated"), "live_stock", "total_gross_profit",
        margin_pct(F.col("last.sell_price"), F.col("last.stock_cost_price")).alias("profit_margin"),
    )


def running_stock(log: DataFrame, share: float = SHARE) -> DataFrame:
    """Log rows with the stock level of their SKU after each row."""
    quantity = F.coalesce("quantity_change", F.lit(0))
    return running(log, ["item_sku"], ["created_at", "seq"], sums={"running_stock": quantity}, share=share)


def newest_rows(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key. Spark limits each key inside the map tasks first, so hot keys stay small."""
    latest = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n)
