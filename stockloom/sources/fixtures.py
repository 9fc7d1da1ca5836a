"""Inventory tables derived from the star-schema test tables (see FIXTURES.md for the mapping).

Two widths differ from the mapping text so that it also holds for very large sources: SKU numbers are padded to 12
digits and row ids are DECIMAL(38,0), because the 64-bit form overflows at about a million orders.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Tables

AS_OF = dt.datetime(2001, 6, 1, 12, 0, 0)

_SKU = "concat('SKU-', lpad(CAST({key} AS STRING), 12, '0'))"
_SEQ = (
    "CAST((CAST(l_orderkey * 10 + l_linenumber AS DECIMAL(16,0)) * CAST(100000000000 AS DECIMAL(12,0))"
    " + CAST(l_partkey AS DECIMAL(11,0))) * CAST(100000000000 AS DECIMAL(12,0))"
    " + CAST(l_suppkey * 100 + CAST(l_quantity AS INT) AS DECIMAL(11,0)) AS DECIMAL(38,0))"
)
_RENTAL = "l_partkey % 3 = 0 AND l_returnflag = 'N' AND l_linestatus = 'O'"
_LIFECYCLE = "l_partkey % 3 = 0 AND l_returnflag = 'A' AND l_linestatus = 'O'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    # Filter on the source columns first so that it reaches the scan.
    return table(spark, sf_dir, "lineitem").where(condition).withColumns(
        {
            "id": F.expr(_SEQ),
            "item_sku": F.expr(_SKU.format(key="l_partkey")),
            "at": F.expr("l_shipdate + make_dt_interval(0, 0, 0, CAST(l_orderkey % 86400 AS INT))"),
            "staff": F.expr("concat('staff-', CAST(l_suppkey % 7 AS STRING))"),
        }
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.expr(_SKU.format(key="p_partkey")).alias("item_sku"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'Bridal' ELSE 'Bags' END").alias("shop_code"),
        F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("brand_designer"),
        F.expr("CAST(NULL AS STRING)").alias("item_image"),
        F.expr(
            "CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(p_size + 40 AS DECIMAL(4,0)) * 0.01BD AS DECIMAL(10,2))"
        ).alias("stock_cost_price"),
        F.expr(
            "CASE WHEN p_partkey % 50 = 7 THEN CAST(0 AS DECIMAL(10,2)) ELSE CAST(p_retailprice AS DECIMAL(10,2)) END"
        ).alias("sell_price"),
        F.col("p_size").alias("min_stock_alert"),
        F.expr("CASE WHEN p_partkey % 3 <> 0 THEN split_part(p_name, ' ', 1) END").alias("bag_color"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat('UK ', CAST(p_size % 12 + 4 AS STRING)) END").alias(
            "bridal_size"
        ),
    )


def full_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with all columns of their table; every fifth has no creation time."""
    number = "CAST(substr(item_sku, 5) AS BIGINT)"
    at = "TIMESTAMP_NTZ '1991-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({0} % 86400 AS INT))"
    return items(spark, sf_dir).withColumns({
        "is_active": F.expr(f"{number} % 4 <> 0"),
        "created_at": F.expr(f"CASE WHEN {number} % 5 <> 0 THEN {at.format(number)} END"),
        "updated_at": F.expr(f"CASE WHEN {number} % 7 = 0 THEN {at.format(number)} END"),
    })


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir, f"NOT ({_RENTAL}) AND NOT ({_LIFECYCLE})")
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return lines.join(price, "l_partkey").select(
        "id",
        "item_sku",
        F.expr(
            "CASE WHEN l_discount > 0.095 THEN 'Adjustment' WHEN l_returnflag = 'A' THEN 'New Item' "
            "WHEN l_returnflag = 'R' THEN 'Restock' ELSE 'Retail Sale' END"
        ).alias("action_type"),
        F.expr(
            "CASE WHEN l_returnflag = 'N' THEN -(CAST(l_quantity AS INT) % 25 + 1) "
            "ELSE CAST(l_quantity AS INT) % 10 + 1 END"
        ).alias("quantity_change"),
        F.expr(
            "CASE WHEN l_linenumber <> 2 THEN CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 0.50BD AS DECIMAL(10,2)) END"
        ).alias("unit_cost_price"),
        F.expr("CASE WHEN l_linenumber = 3 THEN 'CORRECTION of row #1' END").alias("notes"),
        F.col("at").alias("created_at"),
        F.col("staff").alias("created_by"),
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, _LIFECYCLE).select(
        "id",
        "item_sku",
        F.expr(
            "CASE l_linenumber % 4 WHEN 0 THEN 'Available' WHEN 1 THEN 'In Alteration' "
            "WHEN 2 THEN 'Dry Cleaning' ELSE 'Sold' END"
        ).alias("status"),
        F.expr("CASE WHEN l_linenumber = 3 THEN 'HOLD-RECONCILE' END").alias("notes"),
        F.col("at").alias("occurred_at"),
        F.col("staff").alias("recorded_by"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("display_name")
    )


def full_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers with all columns of their table. Some bear the names that raw actions use."""
    raw = table(spark, sf_dir, "customer")
    return raw.select(
        F.col("c_custkey").cast("string").alias("id"),
        F.expr("CASE WHEN c_custkey <= 10 THEN concat('Customer ', CAST(c_custkey AS STRING)) ELSE c_name END").alias("display_name"),
        F.expr("concat('+44 ', CAST(c_custkey AS STRING))").alias("phone"),
        F.expr("concat('c', CAST(c_custkey AS STRING), '@example.org')").alias("email"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'regular' END").alias("notes"),
        F.expr("TIMESTAMP_NTZ '1991-02-01 00:00:00'").alias("created_at"), F.lit("desk").alias("created_by"),
    )


def full_rentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rentals(spark, sf_dir).withColumn("created_at", F.col("booked_at"))


def rentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    booker = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = _lines(spark, sf_dir, _RENTAL)
    booked = lines.join(booker, "l_orderkey")
    # The newest booking of every second SKU is still open. Every line has its order, so no join is needed here.
    newest = (
        lines.where("l_partkey % 2 = 0").groupBy("item_sku").agg(F.max(F.struct("at", "id")).alias("newest"))
        .select(F.col("newest.id").alias("id"), F.lit(True).alias("is_open"))
    )
    status = F.expr(
        "CASE WHEN is_open THEN 'Rented' WHEN l_discount > 0.095 THEN 'Cancelled' ELSE 'Returned' END"
    )
    return booked.join(newest, "id", "left").withColumn("status", status).select(
        "id",
        "item_sku",
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("at").alias("booked_at"),
        F.expr("date_add(CAST(at AS DATE), CAST(l_quantity AS INT))").alias("due_date"),
        F.expr("CASE WHEN status = 'Returned' THEN at + INTERVAL '3' DAY END").alias("returned_at"),
        F.expr("CAST(l_extendedprice AS DECIMAL(10,2))").alias("rental_price"),
        F.expr("CAST(1 + l_linenumber % 3 AS INT)").alias("quantity"),
        "status",
        F.expr("CAST(NULL AS STRING)").alias("notes"),
        F.col("staff").alias("created_by"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        items(spark, sf_dir),
        movements(spark, sf_dir),
        lifecycle(spark, sf_dir),
        customers(spark, sf_dir),
        rentals(spark, sf_dir),
    )


def full_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables with every column of their schemas filled."""
    return Tables(
        full_items(spark, sf_dir), movements(spark, sf_dir), lifecycle(spark, sf_dir), full_customers(spark, sf_dir),
        full_rentals(spark, sf_dir),
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-table action log that the normalized tables could have come from."""
    t = tables(spark, sf_dir)
    item = t.items.select(
        "item_sku", F.col("shop_code").alias("shop_type"), "item_name", "brand_designer", "item_image",
        F.col("stock_cost_price").alias("_cost"), F.col("sell_price").alias("_sell"), "min_stock_alert",
        "bag_color", "bridal_size",
    )
    text, day, zero = "CAST(NULL AS STRING)", "CAST(NULL AS DATE)", "CAST(0 AS DECIMAL(10,2))"

    def rows(df, at, cost, sell, qty, status, due, contact, action, staff):
        return df.select(
            F.col("id").alias("seq"), F.col(at).alias("created_at"), "item_sku",
            F.expr(cost).alias("stock_cost_price"), F.expr(sell).alias("sell_price"),
            F.expr(qty).alias("quantity_change"), F.expr(status).alias("bridal_status"),
            F.expr(due).alias("rental_due_date"), F.expr(contact).alias("customer_name_contact"),
            F.expr(action).alias("action_type"), "notes", F.col(staff).alias("created_by"),
        )

    missing = "CAST(NULL AS DECIMAL(10,2))"
    moved = rows(
        t.movements.where("action_type <> 'Adjustment'"), "created_at", "unit_cost_price", missing,
        "quantity_change", text, day, text, "action_type", "created_by",
    )
    changed = rows(
        t.lifecycle, "occurred_at", zero, zero, "0", "status", day, text, "'Status Change'", "recorded_by"
    )
    named = t.rentals.join(t.customers.select(F.col("id").alias("customer_id"), "display_name"), "customer_id")
    out = rows(
        named, "booked_at", zero, "rental_price", "0", "'Rented'", "CASE WHEN quantity <> 3 THEN due_date END",
        "display_name", "'Rental Out'", "created_by",
    )
    back = rows(
        t.rentals.where("returned_at IS NOT NULL"), "returned_at", zero, zero, "0", "'Returned'", day, text,
        "'Rental Return'", "created_by",
    )
    union = moved.unionByName(changed).unionByName(out).unionByName(back)
    filled = union.join(item, "item_sku").withColumns(
        {
            "stock_cost_price": F.coalesce("stock_cost_price", "_cost"),
            "sell_price": F.coalesce("sell_price", "_sell"),
        }
    )
    return filled.drop("_cost", "_sell").withColumn(
        "gross_profit", (F.col("sell_price") - F.col("stock_cost_price")).cast("decimal(10,2)")
    )


def raw_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped actions as a client would send them, one per event."""
    return raw_from_events(table(spark, sf_dir, "events"))


def raw_from_events(events: DataFrame) -> DataFrame:
    amount = "CAST(CAST(value AS DECIMAL(10,2)) AS STRING)"
    text = "CAST(NULL AS STRING)"
    columns = {
        "seq": "event_id",
        "created_at": "ts",
        "shop_type": "CASE WHEN event_id % 37 = 0 THEN 'Shoes' WHEN user_id % 3 = 0 THEN 'Bridal' ELSE 'Bags' END",
        "item_sku": "CASE WHEN event_id % 43 = 0 THEN '  ' ELSE concat(' sku-', lpad(CAST(user_id AS STRING), 12, '0'), ' ') END",
        "item_name": "concat('Item ', CAST(user_id AS STRING))",
        "brand_designer": text,
        "item_image": text,
        "stock_cost_price": f"CASE WHEN event_id % 5 = 0 THEN '12.50kg' WHEN event_id % 5 = 1 THEN 'abc' ELSE {amount} END",
        "sell_price": f"CASE WHEN event_id % 53 = 0 THEN '-1' ELSE {amount} END",
        "quantity_change": "CASE WHEN event_type = 'purchase' THEN '-1' WHEN event_id % 6 = 0 THEN '3.7' ELSE '5' END",
        "quantity": "CASE WHEN event_id % 4 = 0 THEN '2' END",
        "bag_color": "CASE WHEN event_id % 7 = 0 THEN 'red' WHEN event_id % 7 = 1 THEN '' END",
        "min_stock_alert": "CASE WHEN event_id % 3 = 0 THEN '0' ELSE CAST(event_id % 9 AS STRING) END",
        "bridal_size": text,
        "bridal_status": "CASE WHEN event_id % 17 = 0 THEN 'Lost' WHEN event_id % 4 = 0 THEN 'Available' "
                         "WHEN event_id % 4 = 1 THEN 'Rented' WHEN event_id % 4 = 2 THEN '' END",
        "rental_due_date": "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '2023-12-31' "
                           "ELSE '2024-03-01' END",
        "customer_name_contact": "CASE WHEN event_id % 7 = 0 THEN '' "
                                 "ELSE concat('Customer ', CAST(user_id % 20 AS STRING)) END",
        "action_type": "CASE WHEN event_id % 41 = 0 THEN 'Bogus' WHEN event_type = 'signup' THEN 'New Item' "
                       "WHEN event_type = 'purchase' THEN 'Retail Sale' WHEN event_type = 'view' THEN 'Rental Out' "
                       "WHEN event_type = 'click' THEN 'Rental Return' ELSE 'Status Change' END",
        "notes": text,
    }
    return events.select(*(F.expr(sql).alias(name) for name, sql in columns.items()))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A careless single-table log, one row per event: mixed shops, odd quantities, statuses out of step."""
    columns = {
        "seq": "event_id",
        "created_at": "ts",
        "shop_type": "CASE WHEN (user_id % 3 = 0) <> (event_id % 61 = 0) THEN 'Bridal' ELSE 'Bags' END",
        "item_sku": _SKU.format(key="user_id"),
        "quantity_change": "CASE event_type WHEN 'purchase' THEN -CAST(event_id % 6 AS INT) "
                           "WHEN 'click' THEN CAST(event_id % 2 AS INT) WHEN 'view' THEN 0 "
                           "ELSE CAST(event_id % 9 AS INT) END",
        "bridal_status": "CASE WHEN event_id % 4 = 0 THEN 'Available' WHEN event_id % 4 = 1 THEN 'Rented' END",
        "customer_name_contact": "concat('Customer ', CAST(user_id % 20 AS STRING))",
        "action_type": "CASE event_type WHEN 'signup' THEN 'New Item' WHEN 'purchase' THEN 'Retail Sale' "
                       "WHEN 'view' THEN 'Rental Out' WHEN 'click' THEN 'Rental Return' ELSE 'Status Change' END",
        "created_by": "concat('staff-', CAST(event_id % 7 AS STRING))",
    }
    events = table(spark, sf_dir, "events")
    return events.select(*(F.expr(sql).alias(name) for name, sql in columns.items()))


def counts(live: DataFrame) -> DataFrame:
    """Physical counts that differ from the recorded stock for some SKUs."""
    number = "CAST(substr(item_sku, 5) AS BIGINT)"
    off = f"CASE {number} % 11 WHEN 0 THEN {number} % 7 + 1 WHEN 1 THEN -({number} % 7 + 1) ELSE 0 END"
    return live.select("item_sku", (F.col("live_stock") + F.expr(off)).alias("physical_qty"))


def shortages(live: DataFrame) -> DataFrame:
    """Physical counts that miss something of every item."""
    off = F.expr("CAST(substr(item_sku, 5) AS BIGINT) % 7 + 1")
    return live.select("item_sku", (F.col("live_stock") - off).alias("physical_qty"))


def tidy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with plausible quantities, four events to a SKU."""
    plain = "CASE WHEN action_type IN ('Rental Out', 'Retail Sale') THEN -1 ELSE 1 END"
    return event_log(spark, sf_dir).withColumns({
        "item_sku": F.expr(_SKU.format(key="seq div 4")), "quantity_change": F.expr(plain),
        "shop_type": F.expr("CASE WHEN seq % 10 = 0 THEN 'Bridal' ELSE 'Bags' END")})


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales as an outside till saw them."""
    sales = movements(spark, sf_dir).where("action_type = 'Retail Sale'")
    return sales.select("item_sku", "action_type", "created_at", "quantity_change")


def patchy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger without the rows of one member of staff."""
    return movements(spark, sf_dir).where("created_by <> 'staff-3'")


def damaged_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger without the rows of some items."""
    return movements(spark, sf_dir).where("CAST(substr(item_sku, 5) AS BIGINT) % 41 <> 3")


def recounts(deltas: DataFrame) -> DataFrame:
    """Second counts of discrepant items; some agree with the recorded stock."""
    wrong = F.expr("CAST(substr(item_sku, 5) AS BIGINT) % 9 = 2")
    return deltas.select("item_sku", F.when(wrong, F.col("recorded_qty")).otherwise(F.col("physical_qty")).alias("physical_qty"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A discrepancy log with one incident per order."""
    columns = {
        "occurred_at": "o_orderdate",
        "item_sku": _SKU.format(key="o_custkey"),
        "staff": "concat('staff-', CAST(o_custkey % 7 AS STRING))",
        "cause": "CASE o_orderstatus WHEN 'F' THEN 'Data-entry error' WHEN 'O' THEN 'Unrecorded return' "
                 "ELSE 'Unknown' END",
        "delta": "CAST(o_orderkey % 11 AS INT) - 5",
    }
    return table(spark, sf_dir, "orders").select(*(F.expr(sql).alias(name) for name, sql in columns.items()))


def repriced_items(base: DataFrame) -> DataFrame:
    """A later snapshot of the items: some prices changed, some items gone."""
    number = "CAST(substr(item_sku, 5) AS BIGINT)"
    kept = base.where(f"{number} % 97 <> 5")
    return kept.withColumn(
        "sell_price",
        F.expr(f"CAST(CASE WHEN {number} % 10 = 0 THEN sell_price + 1 ELSE sell_price END AS DECIMAL(10,2))"),
    )


def flawed_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables that break several rules: missing items, early due dates, odd e-mail addresses, negative prices."""
    t = tables(spark, sf_dir)
    number = "CAST(substr(item_sku, 5) AS BIGINT)"
    price = F.expr(f"CAST(CASE WHEN {number} % 90 = 7 THEN -1 ELSE sell_price END AS DECIMAL(10,2))")
    due = F.expr("CASE WHEN quantity = 2 THEN date_add(due_date, -20) ELSE due_date END")
    email = F.expr("CASE WHEN CAST(id AS BIGINT) % 13 = 0 THEN 'nobody' ELSE concat(display_name, '@example.org') END")
    return Tables(
        t.items.where(f"{number} % 97 <> 5").withColumn("sell_price", price), t.movements, t.lifecycle,
        t.customers.withColumn("email", email), t.rentals.withColumn("due_date", due),
    )
