import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators import boards, migrate, queries, scope, state
from stockloom.schemas import CUSTOMERS, ITEMS, LIFECYCLE, LOG, MOVEMENTS, RENTALS, Tables
from stockloom.sources import fixtures as fx
from stockloom.sources import tables as files

T0 = dt.datetime(2024, 3, 1, 9)
D = Decimal


def item(sku, shop, cost, sell, alert, name="thing"):
    return (sku, shop, name, None, None, D(cost), D(sell), alert, None, None, True, T0, T0)


@pytest.fixture(scope="module")
def tables(spark):
    items = [item("BAG", "Bags", "4", "10", 0), item("GOWN", "Bridal", "40", "100", 1), item("FREE", "Bridal", "5", "0", 2),
             item("IDLE", "Bridal", "1", "2", 2)]
    moves = [(D(1), "BAG", "New Item", 5, None, None, T0, "ann"), (D(2), "BAG", "Retail Sale", -3, D("6"), "till", T0, "bob"),
             (D(3), "GOWN", "Restock", 1, D("40"), None, T0, "ann")]
    life = [(D(1), "GOWN", "Sold", None, T0, "ann"), (D(2), "GOWN", "Dry Cleaning", "hem", T0, "ann"),
            (D(3), "FREE", "In Alteration", None, T0, "ann"), (D(4), "BAG", "Sold", None, T0 - dt.timedelta(days=1), "ann")]
    rents = [
        (D(1), "GOWN", "c1", T0 - dt.timedelta(days=9), dt.date(2024, 2, 25), None, D("30"), 1, "Cancelled", None, T0, "ann"),
        (D(2), "GOWN", "c2", T0, dt.date(2024, 3, 4), None, D("50"), 2, "Rented", "vip", T0, "ann"),
    ]
    return Tables(
        spark.createDataFrame(items, ITEMS), spark.createDataFrame(moves, MOVEMENTS), spark.createDataFrame(life, LIFECYCLE),
        spark.createDataFrame([("c1", "Ann", *[None] * 5), ("c2", "Bea", *[None] * 5)], CUSTOMERS),
        spark.createDataFrame(rents, RENTALS),
    )


@pytest.fixture(scope="module")
def live(tables):
    return {r.item_sku: r for r in state.live_inventory(tables).collect()}


def test_live(live):
    bag, gown, free, idle = (live[k] for k in ("BAG", "GOWN", "FREE", "IDLE"))
    # New Item rows count as sales at full profit; bags have no status even with lifecycle rows.
    assert (bag.total_gross_profit, bag.total_revenue, bag.live_stock, bag.bridal_status) == (D("12.00"), D("20.00"), 2, None)
    # Equal times: the later source wins, then the later row. Cancelled bookings count as revenue.
    assert (gown.last_action, gown.notes, gown.total_revenue) == ("Rental Out", "vip", D("80.00"))
    assert (gown.bridal_status, gown.customer_name_contact, gown.rental_quantity) == ("Rented", "Bea", 2)
    assert (free.profit_margin, free.bridal_status) == (D("0.00"), "In Alteration")
    assert (idle.bridal_status, idle.live_stock, idle.last_action, idle.total_gross_profit) == ("Available", 0, None, D("0.00"))
    assert bag.last_action == "Retail Sale"


def test_history(tables):
    rows = {r.id: r for r in state.history(tables).collect()}
    assert len(rows) == 9 and sorted(rows) == list(range(1, 10))
    assert rows[1].action_type == "Rental Return" and rows[1].profit_margin == D("100.00") and rows[1].bridal_status == "Cancelled"
    assert rows[9].action_type == "Rental Out" and rows[9].quantity_change == 2 and rows[9].customer_name_contact == "Bea"
    sale = next(r for r in rows.values() if r.action_type == "Retail Sale")
    assert (sale.stock_cost_price, sale.gross_profit, sale.profit_margin) == (D("6.00"), D("4.00"), D("40.00"))
    without = state.history(tables, with_id=False)
    assert "id" not in without.columns and without.count() == 9


def test_queries(tables):
    inv = state.live_inventory(tables)
    assert queries.live(inv, "Hats").count() == 4 and queries.live(inv, "Bags").count() == 1
    s = queries.live_summary(inv, dt.datetime(2024, 3, 4, 1)).first()
    # The summary takes the alert of 0 as it is, so the bag with two in stock is not low there.
    assert (s.total_items, s.active_rentals, s.overdue_rentals, s.low_stock_items) == (4, 1, 1, 0)
    assert queries.page_size("12abc") == 12 and queries.page_size("0") == queries.page_size("x") == 500
    page = queries.history_query(state.history(tables), sku=" gown ", limit="2").collect()
    assert [r.action_type for r in page] == ["Rental Out", "Status Change"]


def test_lookup_and_versions(spark, tables, tmp_path):
    inv = state.live_inventory(tables, with_customer=False)
    assert "customer_name_contact" not in inv.columns
    assert queries.item_lookup(inv, "GOWN").count() == 1 and queries.item_lookup(inv, "GOWN", "Bags").count() == 0
    asked = spark.createDataFrame([(" gown ",), ("GOWN",), ("none",)], "item_sku string")
    assert [r.item_sku for r in queries.owned(tables.items, asked, "Bridal").collect()] == ["GOWN"]
    root = str(tmp_path / "tables")
    files.write_tables(tables, root)
    # The second version is built from the first while that stays readable.
    current = files.current_tables(spark, root)
    files.write_tables(Tables(current.items.where("item_sku <> 'IDLE'"), current.movements, current.lifecycle,
                              current.customers, current.rentals), root)
    assert files.latest_version(spark, root) == 2
    assert files.current_tables(spark, root).items.count() == 3 and current.items.count() == 4


def test_boards(tables):
    inv, now = state.live_inventory(tables), dt.datetime(2024, 3, 2, 12)
    band = {r.item_sku: (r.stock_band, r.row_flag) for r in boards.stock_band(inv, now).collect()}
    # Boards read an alert of 0 as the default of 2.
    assert band == {"BAG": ("low", "low-stock"), "GOWN": ("low", ""), "FREE": ("zero", ""), "IDLE": ("zero", "")}
    board = boards.rental_board(inv, "all", now).collect()
    assert [r.item_sku for r in board] == ["GOWN", "FREE", "IDLE"]
    assert (board[0].days_left, board[0].due_badge, board[1].due_badge) == (2, "2d left", None)
    late = boards.rental_board(inv, "overdue", dt.datetime(2024, 3, 7)).first()
    assert late.due_badge == "3d overdue"
    assert boards.rental_board(inv, "Returned", now).count() == 0
    unknown = inv.withColumn("bridal_status", F.when(F.col("item_sku") != "IDLE", F.col("bridal_status")))
    assert boards.bridal_stats(unknown).first().available == 1 and boards.rental_stats(unknown, now).first().available == 0
    assert boards.rentable(unknown).count() == 1
    summary = {r.shop_type: r.low_stock for r in boards.shop_summary(inv).collect()}
    assert summary == {"Bags": 1, "Bridal": None}
    label = boards.product_label(inv).where("item_sku = 'GOWN'").first().label
    assert label == "thing (GOWN) · stock 1 · Rented"


def test_scope(tables):
    assert scope.scope_items(tables.items, None).count() == 0
    seen = {(r.role, r.table_name): r.visible for r in scope.role_counts(tables, "Bridal").collect()}
    assert seen["readonly", "items"] == 3 and seen["readonly", "rentals"] == 0 and seen["readonly", "customers"] == 2
    assert seen["rental_clerk", "movements"] == 1 and seen["app_admin", "movements"] == 3
    for role in scope.ROLES:
        view = scope.role_view(role, tables, "Bridal")
        assert {n: getattr(view, n).count() for n in Tables.names()} == {n: seen[role, n] for n in Tables.names()}
    assert scope.check_write_scope(tables.movements, tables.items, "Bridal").count() == 2
    assert scope.check_write_scope(tables.items, tables.items, None).count() == 4


def log_row(seq, sku, action, **kw):
    base = dict.fromkeys((f.name for f in LOG), None)
    base |= {"seq": D(seq), "created_at": T0 + dt.timedelta(hours=seq), "shop_type": "Bridal", "item_sku": sku, "item_name": sku,
             "stock_cost_price": D(1), "sell_price": D(2), "quantity_change": 0, "action_type": action} | kw
    return tuple(base[f.name] for f in LOG)


def test_migration(spark):
    rows = [
        log_row(1, "A", "Rental Out", customer_name_contact="Ann"), log_row(2, "A", "Rental Return"),
        log_row(3, "A", "Rental Out", customer_name_contact="Bea"), log_row(4, "A", "Rental Return"),
        log_row(5, "A", "Rental Return"), log_row(6, "B", "Rental Out"), log_row(7, "B", "New Item", quantity_change=None),
        log_row(8, "B", "Status Change", bridal_status="Returned"), log_row(9, "B", "Status Change", bridal_status="Sold"),
    ]
    log = spark.createDataFrame(rows, LOG)
    moved = migrate.migrate(log)
    done = moved.tables
    rent = done.rentals.collect()
    assert [(r.item_sku, r.status, r.returned_at, r.due_date) for r in rent] == [
        ("A", "Returned", T0 + dt.timedelta(hours=4), dt.date(2024, 3, 8))]
    # The same with every key cut into blocks.
    assert sorted(map(tuple, migrate.backfill_rentals(log, done.customers, share=0.01).collect())) == sorted(map(tuple, rent))
    # No contact means no customer row to point at.
    assert [r.item_sku for r in migrate.rental_rejects(log, done.customers).collect()] == ["B"]
    assert [r.status for r in migrate.lifecycle_rejects(log).collect()] == ["Returned"]
    assert {r.item_sku: r.min_stock_alert for r in done.items.collect()} == {"A": 2, "B": 2}
    counts = {r.table_name: r["count"] for r in migrate.migration_counts(done).collect()}
    assert counts == {"items": 2, "stock_movements": 1, "item_lifecycle_events": 1, "customers": 2, "rentals": 1}
    again = migrate.migration_counts(migrate.migrate(log, done).tables).collect()
    assert {r.table_name: r["count"] for r in again} == counts
    assert migrate.sku_parity(log, done.items).first().match


def test_migration_takes_or_rejects_every_booking(spark):
    """Early due dates, unknown customers and second open bookings come back with a reason; kept rows stay whole."""
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "Bags", "A", "Rental Out", "Ann", dt.date(2020, 1, 1)), (2, at, "Bags", "B", "Rental Out", None, None),
            (3, at, "Bags", "C", "Rental Out", "Bob", None), (4, at, "Bags", "D", "Rental Out", "Bob", None),
            (5, at, "Bags", "E", "Status Change", None, None)]
    log = spark.createDataFrame(
        [(Decimal(r[0]), r[1], r[2], r[3], "n", None, None, Decimal(1), Decimal(2), 0, 1, None, None, "Returned", r[6], r[5], r[4], None) for r in rows],
        LOG)
    kept = migrate.migrate(log.where("item_sku = 'C'")).tables
    kept = Tables(kept.items, kept.movements, kept.lifecycle, kept.customers.withColumn("phone", F.lit("1")),
                  kept.rentals.withColumn("created_by", F.lit("desk")))
    done = migrate.migrate(log, kept)
    assert {(r.table_name, r.item_sku, r.reason) for r in done.rejects.collect()} == {
        ("rentals", "A", "due date before booking"), ("rentals", "B", "customer unknown"),
        ("rentals", "C", "open rental exists for this SKU"), ("item_lifecycle_events", "E", "status not allowed")}
    assert {(r.item_sku, r.created_by) for r in done.tables.rentals.collect()} == {("C", "desk"), ("D", "migration")}
    assert {(r.display_name, r.phone) for r in done.tables.customers.collect()} == {("Ann", None), ("Bob", "1")}


def test_migration_reads_its_log_once(spark):
    rows = [log_row(1, "A", "New Item", quantity_change=2), log_row(2, "A", "Rental Out", customer_name_contact="Ann"),
            log_row(3, "A", "Rental Return"), log_row(4, "B", "New Item", sell_price=D(-1))]
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    log = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1).map(seen), LOG)
    source = migrate.read_source(log)
    first = migrate.migrate(source)
    again = migrate.migrate(source, first.tables)
    assert {r.table_name: r["count"] for r in migrate.migration_counts(again.tables).collect()} == {
        "items": 1, "stock_movements": 1, "item_lifecycle_events": 0, "customers": 1, "rentals": 1}
    assert {(r.table_name, r.item_sku) for r in again.rejects.collect()} == {("items", "B"), ("stock_movements", "B")}
    assert read.value == len(rows)


def test_history_actions(tables):
    """Bare rows of the history, also where items and customers are repeated."""
    t = tables
    twice = Tables(t.items.unionAll(t.items), t.movements, t.lifecycle, t.customers.unionAll(t.customers), t.rentals)
    bare = state.history_actions(twice)
    whole = state.history(twice).select(*bare.columns)
    assert bare.count() and sorted(map(tuple, bare.collect())) == sorted(map(tuple, whole.collect()))


def test_history_page_has_the_ids_of_the_log(spark):
    for shop, sku, limit in ((None, None, 7), ("Bridal", None, 40), (None, "SKU-000000000012", 3), ("Bags", "SKU-000000000012", 5)):
        tables = fx.tables(spark, "/root/testdata/sf0.001")
        plain = queries.history_query(state.history(tables), shop, sku, limit)
        assert queries.history_page(tables, shop, sku, limit).collect() == plain.collect()


def test_history_page_of_tied_events(spark):
    """All events of an import share one time; ranks come from one pass over their keys."""
    tables = fx.tables(spark, "/root/testdata/sf0.001")
    at = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    tied_page = state.Tables(tables.items, tables.movements.withColumn("created_at", at), tables.lifecycle, tables.customers, tables.rentals)
    plain = queries.history_query(state.history(tied_page), None, None, 400)
    assert queries.history_page(tied_page, None, None, 400).collect() == plain.collect()


def test_history_page_of_nothing(spark):
    tables = fx.tables(spark, "/root/testdata/sf0.001")
    assert queries.history_page(tables, None, "no such SKU", 5).collect() == []
