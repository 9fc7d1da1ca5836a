import datetime as dt
import json
import random
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators import ingest
from stockloom.operators.migrate import customer_id
from stockloom.schemas import CUSTOMERS, ITEMS, LIFECYCLE, MOVEMENTS, RAW_ACTIONS, RAW_FIELDS, RENTALS, Tables
from stockloom.streaming import actions as stream

START = dt.datetime(2024, 1, 1, 8)
RENTAL_COLUMNS = "id, item_sku, customer_id, booked_at, due_date, returned_at, rental_price, quantity, status"


def raw(spark, actions):
    rows = [(a["seq"], a["created_at"], *(a.get(f) for f in RAW_FIELDS)) for a in actions]
    return spark.createDataFrame(rows, RAW_ACTIONS)


def base_tables(spark):
    item = [("A", "Bridal", "gown", "Vera", None, Decimal("10.00"), Decimal("20.00"), 3, None, "UK 8", True, START, START)]
    rental = [(Decimal(-1), "A", "c1", dt.datetime(2023, 12, 1), dt.date(2023, 12, 9), None, Decimal("50.00"), 1, "Rented",
               None, dt.datetime(2023, 12, 1), "x")]
    return Tables(
        spark.createDataFrame(item, ITEMS), spark.createDataFrame([], MOVEMENTS), spark.createDataFrame([], LIFECYCLE),
        spark.createDataFrame([("c1", "Eve", None, None, None, START, "x")], CUSTOMERS),
        spark.createDataFrame(rental, RENTALS),
    )


def random_actions(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(1, n + 1):
        out.append({
            "seq": seq, "created_at": START + dt.timedelta(minutes=seq // 3),  # equal times on purpose
            "shop_type": rng.choice(["Bags", "Bridal", "Bridal", "Bridal", "Shoes"] if rng.random() < 0.2 else ["Bridal", "Bags"]),
            "item_sku": rng.choice([" a", "A ", "b", "B", "c", " "]), "item_name": rng.choice(["x", "y", "z", " "]),
            "action_type": rng.choice(["Rental Out", "Rental Return", "Rental Out", "Rental Return", "New Item", "Status Change"]),
            "sell_price": rng.choice(["5", "7.25", "-1", "junk", None]), "stock_cost_price": rng.choice(["3kg", "", "2"]),
            "quantity_change": rng.choice(["1", "-2", "3.9", ""]), "min_stock_alert": rng.choice(["0", "4", None]),
            "quantity": rng.choice([None, "2", "0"]), "bag_color": rng.choice(["", "red", None]),
            "bridal_status": rng.choice(["", "Available", "Sold", "Rented", "Lost", None]),
            "rental_due_date": rng.choice(["2024-02-01", "2024-02-01", "2023-01-01", None, "soon"]),
            "customer_name_contact": rng.choice(["", "Ann", "Eve"]),
        })
    return out


def replay(actions):
    """One action after the other, the way a transactional server would take them."""
    items = {"A": {"shop": "Bridal", "name": "gown", "cost": 10.0, "sell": 20.0, "alert": 3, "color": None}}
    open_by_sku, rentals, moves, life, names, rejects = {"A": -1}, {-1: ("Rented", None)}, [], [], {"Eve"}, set()
    number = {"5": 5.0, "7.25": 7.25, "-1": -1.0, "junk": 0.0, None: 0.0, "3kg": 3.0, "": 0.0, "2": 2.0}
    whole = {"1": 1, "-2": -2, "3.9": 3, "": 0}
    for a in actions:
        sku, action, status = a["item_sku"].strip().upper(), a["action_type"], a["bridal_status"]
        if a["shop_type"] == "Shoes" or not sku or not a["item_name"].strip() or status == "Lost":
            rejects.add(a["seq"])
            continue
        sell, cost = number[a["sell_price"]], 0.0 if action == "Rental Out" else number[a["stock_cost_price"]]
        bad = sell < 0
        if action == "Rental Out":
            bad |= a["rental_due_date"] != "2024-02-01" or sku in open_by_sku
        if action == "Status Change":
            bad |= status == "Rented"
        if bad:
            rejects.add(a["seq"])
            continue
        item = items.setdefault(sku, {"shop": a["shop_type"], "color": None})
        item.update(name=a["item_name"], cost=cost, sell=sell, alert=4 if a["min_stock_alert"] == "4" else 2)
        item["color"] = a["bag_color"] or item["color"]
        if action == "Rental Out":
            names.add(a["customer_name_contact"] or "Walk-in")
            open_by_sku[sku] = a["seq"]
            rentals[a["seq"]] = ("Rented", None)
        elif action == "Rental Return":
            if sku in open_by_sku:
                rentals[open_by_sku.pop(sku)] = ("Returned", a["created_at"])
            if status in ("Available", "Sold"):
                life.append((a["seq"], status))
        elif action == "Status Change":
            life.append((a["seq"], status or "Available"))
        else:
            moves.append((a["seq"], whole[a["quantity_change"]], cost))
    return items, rentals, moves, life, names, rejects


def check(tables, rejects, actions):
    items, rentals, moves, life, names, rejected = replay(actions)
    got = {r.item_sku: {"shop": r.shop_code, "name": r.item_name, "cost": float(r.stock_cost_price),
                        "sell": float(r.sell_price), "alert": r.min_stock_alert, "color": r.bag_color}
           for r in tables.items.collect()}
    assert got == items
    assert {int(r.id): (r.status, r.returned_at) for r in tables.rentals.collect()} == rentals
    assert sorted((int(r.id), r.quantity_change, float(r.unit_cost_price)) for r in tables.movements.collect()) == sorted(moves)
    assert sorted((int(r.id), r.status) for r in tables.lifecycle.collect()) == sorted(life)
    assert sorted(r.display_name for r in tables.customers.collect()) == sorted(names)
    assert {r.seq for r in rejects.collect()} == rejected


@pytest.mark.parametrize("seed,share", [(1, 10**9), (2, 0.01)])
def test_ingest_equals_replay(spark, seed, share):
    actions = random_actions(300, seed)
    done = ingest.ingest(raw(spark, actions), base_tables(spark), share)
    check(done.tables, done.rejects, actions)


def versions(actions):
    """(seq, sku, version before, version after) of every update, one action after the other."""
    _, _, _, _, _, rejects = replay(actions)
    number = {"5": 5.0, "7.25": 7.25, "junk": 0.0, None: 0.0, "3kg": 3.0, "": 0.0, "2": 2.0}
    state = {"A": {"item_sku": "A", "shop_code": "Bridal", "item_name": "gown", "brand_designer": "Vera", "item_image": None,
                   "stock_cost_price": 10.0, "sell_price": 20.0, "min_stock_alert": 3, "bag_color": None, "bridal_size": "UK 8",
                   "is_active": True, "created_at": START, "updated_at": START, "shelf": "left"}}
    out = []
    for a in (a for a in actions if a["seq"] not in rejects):
        sku = a["item_sku"].strip().upper()
        old = state.get(sku)
        new = dict(old) if old else {"item_sku": sku, "shop_code": a["shop_type"], "brand_designer": None, "item_image": None,
                                     "bag_color": None, "bridal_size": None, "is_active": True, "created_at": a["created_at"],
                                     "shelf": None}
        cost = 0.0 if a["action_type"] == "Rental Out" else number[a["stock_cost_price"]]
        new.update(item_name=a["item_name"], stock_cost_price=cost, sell_price=number[a["sell_price"]],
                   min_stock_alert=4 if a["min_stock_alert"] == "4" else 2, updated_at=a["created_at"])
        new["bag_color"] = a["bag_color"] or new["bag_color"]
        if old:
            out.append((a["seq"], sku, a["created_at"], old, new))
        state[sku] = new
    return out


@pytest.mark.parametrize("seed,share", [(1, 10**9), (2, 0.01)])
def test_each_action_on_an_item_is_audited(spark, seed, share):
    actions = random_actions(300, seed)
    last = {**actions[-1], "action_type": "New Item", "item_sku": "a", "shop_type": "Bags", "item_name": "x", "bridal_status": None,
            "sell_price": "5", "stock_cost_price": "2", "min_stock_alert": "4", "bag_color": ""}
    actions += [{**last, "seq": 301}, {**last, "seq": 302}]  # the second one changes nothing
    tables = base_tables(spark)
    tables = replace(tables, items=tables.items.withColumn("shelf", F.lit("left")))
    trail = ingest.ingest(raw(spark, actions), tables, share, "till", audit=True).audit.collect()

    def read(text):
        row = json.loads(text)
        return row | {c: dt.datetime.fromisoformat(row[c]) for c in ("created_at", "updated_at")}

    got = sorted(((int(r.seq), r.row_pk, r.changed_at, read(r.old_data), read(r.new_data)) for r in trail), key=lambda r: r[0])
    assert got == versions(actions)
    assert {(r.table_name, r.action, r.changed_by) for r in trail} == {("items", "UPDATE", "till")}
    assert {k: v for k, v in got[-1][3].items()} == got[-1][4]


def test_audit_of_no_actions_is_empty(spark):
    done = ingest.ingest(raw(spark, []), base_tables(spark), audit=True)
    assert done.audit.count() == 0
    assert ingest.ingest(raw(spark, []), base_tables(spark)).audit is None


def test_stream_equals_replay_and_survives_repeats(spark, tmp_path):
    actions = random_actions(120, 3)
    root = str(tmp_path / "store")
    stream.start_store(spark, root, base_tables(spark))
    for batch in range(3):
        part = raw(spark, actions[batch * 40:(batch + 1) * 40])
        stream.apply_batch(part, batch, root)
        if batch == 1:
            stream.apply_batch(part, batch, root)  # the same batch again, as after a lost driver
        if batch == 1:
            root, old = str(tmp_path / "compacted"), root
            stream.compact_store(spark, old, root)
    check(stream.read_store(spark, root), stream.read_rejects(spark, root), actions)


def test_existing_customer_keeps_id(spark):
    act = {"seq": 1, "created_at": START, "shop_type": "Bridal", "item_sku": "n", "item_name": "n", "action_type": "Rental Out",
           "rental_due_date": "2024-02-01", "customer_name_contact": "Eve", "sell_price": "9"}
    walk = {**act, "seq": 2, "item_sku": "m", "customer_name_contact": ""}
    done = ingest.ingest(raw(spark, [act, walk]), base_tables(spark))
    ids = {r.item_sku: r.customer_id for r in done.tables.rentals.collect()}
    walk_in = spark.range(1).select(customer_id(F.lit("Walk-in"))).first()[0]
    assert ids == {"A": "c1", "N": "c1", "M": walk_in}


def test_messages_and_results(spark):
    acts = [
        {"seq": 1, "shop_type": "Hats", "item_sku": " ", "item_name": "", "action_type": "Swap", "bridal_status": "Lost"},
        {"seq": 2, "shop_type": "Bags", "item_sku": "b", "item_name": "bag", "action_type": "New Item", "sell_price": "3",
         "stock_cost_price": "1"},
        {"seq": 3, "shop_type": "Bags", "item_sku": "b", "item_name": "bag", "action_type": "Restock", "sell_price": "999999999"},
        {"seq": 4, "shop_type": "Bags", "item_sku": "b" * 101, "item_name": "bag", "action_type": "Restock"},
    ]
    decided = ingest.decide(raw(spark, [{"created_at": START, **a} for a in acts]))
    errors = {r.seq: list(r.errors) for r in decided.collect()}
    assert len(errors[1]) == 5 and errors[2] == []
    assert errors[3] == ["number out of range"] and errors[4] == ["item_sku too long"]
    result = ingest.action_result(ingest.accepted(decided)).first()
    assert (result.gross_profit, result.profit_margin) == (Decimal("2.00"), Decimal("66.67"))


def test_constraints_and_delete(spark):
    t = base_tables(spark)
    bad = Tables(
        t.items, t.movements, t.lifecycle,
        spark.createDataFrame([("c1", "Eve", None, "no-at", None, START, "x"), ("c2", "Eve", None, "a@b.co", None, START, "x")], CUSTOMERS),
        t.rentals.unionByName(t.rentals.withColumn("id", F.lit(-2).cast("decimal(38,0)")).withColumn("customer_id", F.lit("c9"))),
    )
    found = {(r.rule, r.key) for r in ingest.check_constraints(bad).collect()}
    assert found == {("customers.email form", "c1"), ("customers.display_name unique", "Eve"),
                     ("rentals open.item_sku unique", "A"), ("rentals.customer_id exists", "-2")}
    after, report = ingest.delete_item(t, " a ")
    assert [tuple(r) for r in report.collect()] == [("A", 2)]
    assert after.items.count() == after.rentals.count() == 0 and after.customers.count() == 1
    assert [tuple(r) for r in ingest.delete_item(t, "A", "Bags")[1].collect()] == [("A", 0)]
    with pytest.raises(ValueError):
        ingest.delete_item(t, "A", "Hats")


def test_constraints_of_keys_in_all_tables(spark):
    """Twice held keys and missing references of every table; null references are a matter of the row rules alone."""
    t = base_tables(spark)
    shops = spark.createDataFrame([("Bags",)], "shop_code string")
    moves = spark.createDataFrame(
        [{"id": Decimal(k), "item_sku": sku, "action_type": "New Item", "quantity_change": 1, "created_at": START, "created_by": "x"}
         for k, sku in ((1, "A"), (1, "A"), (2, "gone"), (3, None), *((k, "hot") for k in range(10, 60)))], MOVEMENTS)
    found = sorted((r.rule, r.key, r.value) for r in ingest.check_constraints(
        Tables(t.items, moves, t.lifecycle, t.customers, t.rentals), shops).collect())
    assert found == sorted([
        ("items.shop_code exists", "A", "Bridal"), ("stock_movements.id unique", "1", "2"),
        ("stock_movements.item_sku exists", "2", "gone"), ("stock_movements.item_sku not null", "3", None),
        *(("stock_movements.item_sku exists", str(k), "hot") for k in range(10, 60))])


def test_stream_reads_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    """Open bookings are written anew with every second batch here, and the tables are still those of one batch."""
    monkeypatch.setattr(stream, "_LIVE", 1)
    actions, root = random_actions(48, 5), str(tmp_path / "store")
    stream.start_store(spark, root, base_tables(spark))
    for k in range(4):
        stream.apply_batch(raw(spark, actions[12 * k:12 * k + 12]), k, root)
    assert {r.batch_id: r.live for r in spark.read.parquet(f"{root}/commits").collect()} == {0: [-1, 0], 1: [1], 2: [1, 2], 3: [3]}
    done, got = ingest.ingest(raw(spark, actions), base_tables(spark)).tables, stream.read_store(spark, root)
    for name in Tables.names():
        expected = getattr(done, name)
        assert sorted(map(str, getattr(got, name).select(*expected.columns).collect())) == sorted(map(str, expected.collect())), name


def test_stream_store_keeps_every_column(spark, tmp_path):
    """Batch and stream leave the same tables, whatever columns an action does not know; compaction keeps them."""
    actions = random_actions(60, 11)
    tables = base_tables(spark)
    done = ingest.ingest(raw(spark, actions), tables, user="till").tables
    root = str(tmp_path / "store")
    stream.start_store(spark, root, tables)
    assert stream.read_store(spark, root).items.count() == 1
    stream.apply_batch(raw(spark, actions[:25]), 0, root, "till")
    stream.apply_batch(raw(spark, actions[25:]), 1, root, "till")
    compact = str(tmp_path / "compact")
    stream.compact_store(spark, root, compact)
    for name in Tables.names():
        expected = getattr(done, name)
        for where in (root, compact):
            got = getattr(stream.read_store(spark, where), name)
            assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect())), name
    item = {r.item_sku: r for r in done.items.collect()}
    assert item["A"].is_active and item["A"].created_at == START
    assert all(r.created_by in ("x", "till") for r in done.rentals.collect())


def test_known_items_keep_what_actions_do_not_say(spark):
    old = spark.createDataFrame(
        [("A", "Bridal", "gown", None, None, Decimal("1.00"), Decimal("2.00"), 3, None, None, False, None, None)], ITEMS)
    old = old.withColumn("shelf", F.lit("left"))
    action = {"seq": 1, "created_at": START, "shop_type": "Bags", "item_sku": "a", "item_name": "x", "action_type": "New Item"}
    row = ingest.upsert_items(old, ingest.accepted(ingest.decide(raw(spark, [action])))).first()
    assert (row.shop_code, row.is_active, row.created_at, row.updated_at, row.shelf) == ("Bridal", False, None, START, "left")
