import csv
import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators import audits
from stockloom.sources import csv_files, tables as files
from stockloom.streaming.actions import drop_repeats

NOW = dt.datetime(2024, 3, 1, 9)
LIVE = ("shop_type string, item_sku string, item_name string, brand_designer string, item_image string,"
        " stock_cost_price decimal(10,2), sell_price decimal(10,2), live_stock bigint, min_stock_alert int, bag_color string,"
        " bridal_size string, bridal_status string, rental_due_date date, customer_name_contact string, last_action string,"
        " total_gross_profit decimal(20,2), profit_margin decimal(10,2)")


def test_export_import_round_trip(spark, tmp_path):
    awkward = 'say "hi", all\nof you'
    rows = [("Bags", "A1", awkward, None, None, Decimal(1), Decimal(2), 3, 4, "red", None, None, None, None, "Restock", Decimal(5), Decimal(50)),
            ("Bridal", "B1", "x", *[None] * 14)]
    live = spark.createDataFrame(rows, LIVE)
    path = csv_files.export_csv(csv_files.export_rows(live, "Bags"), str(tmp_path), "Bags", NOW.date())
    assert path.endswith("inventory-bags-2024-03-01")
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    assert '"say ""hi"", all\nof you"' in text and ",red,,,,," in text
    back = csv_files.read_import_csv(spark, path, multi_line=True).collect()  # a value holds a line break
    assert len(back) == 1 and back[0].item_name == awkward and back[0].brand_designer == ""
    action = csv_files.normalize_import(csv_files.read_import_csv(spark, path), NOW).first()
    # An exported file carries stock, not a quantity change, so it comes back with 0.
    assert (action.quantity_change, action.action_type, action.shop_type) == ("0", "New Item", "Bags")


def test_import_aliases_and_report(spark, tmp_path):
    file = tmp_path / "in.csv"
    file.write_text("sku , name,cost,price,qty_change,shop_type\n a1 , Bag ,1,2,3,\n\nb2,\nc3,Hat,1,2,3,Hats\n ,  \n")
    rows = csv_files.read_import_csv(spark, str(file))
    got = {r.item_sku: r for r in csv_files.normalize_import(rows, NOW).collect()}
    assert set(got) == {"a1", "b2", "c3", ""}  # a line of nothing but a comma is a row
    assert (got["a1"].item_name, got["a1"].shop_type, got["a1"].stock_cost_price, got["a1"].quantity_change) == ("Bag", "Bags", "1", "3")
    report = csv_files.import_report(csv_files.normalize_import(rows, NOW)).first()
    assert (report.ok, report.failed) == (1, 3)
    empty = tmp_path / "empty.csv"
    empty.write_text("sku,name\n")
    assert csv_files.read_import_csv(spark, str(empty)).count() == 0


def test_broken_lines_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(5)
    words = ["", "a", "b c", 'say "hi"', "two\nlines", '"\n\n"', "x,y", '"', "end\n", " \n,", "\u00e9\n"]
    files_ = {}
    for k, end in enumerate(("\n", "\r\n")):
        rows = [[f"s{k}-{n}", *(rng.choice(words) for _ in range(3))] for n in range(200)]
        files_[k] = rows
        with open(tmp_path / f"part{k}.csv", "w", newline="", encoding="utf-8") as out:
            if k:
                out.write(end)  # a blank line ahead of the header
            csv.writer(out, lineterminator=end).writerows([["sku", "na\nme", "brand", "notes"], *rows])
    expected = [tuple(v.strip() for v in r) for k in sorted(files_) for r in files_[k]]
    for size in ("100", "128MB"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = csv_files.read_import_csv(spark, str(tmp_path), multi_line=True)
            got = csv_files.read_import_csv(spark, str(tmp_path), multi_line=True, numbered=True).orderBy("row_no").collect()
            tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
            assert sorted(tuple(r) for r in rows.collect()) == sorted(expected)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [tuple(r)[:-1] for r in got] == expected and [r.row_no for r in got] == list(range(400))
        assert rows.columns == ["sku", "na\nme", "brand", "notes"] and (size != "100" or tasks > 50)
    (tmp_path / "part9.csv").write_text("name,sku\nx,s9\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_import_csv(spark, str(tmp_path), multi_line=True).collect()


def test_unclosed_quote_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sku,name\ns1,x\ns2,"open\ns3,y\n')
    (tmp_path / "b.csv").write_text("sku,name\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted(tuple(r) for r in csv_files.read_import_csv(spark, str(tmp_path), multi_line=True).collect())
    assert [r[0] for r in got] == ["s1", "s2"] and "s3,y" in got[1][1]


def test_import_folder_is_numbered_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part{k}.csv").write_text("sku,name\n" + "".join(f"s{k}{n},x\n" for n in range(4)))
    rows = csv_files.read_import_csv(spark, str(tmp_path), numbered=True)
    got = csv_files.normalize_import(rows, NOW, first=100).collect()
    assert [r.item_sku for r in sorted(got, key=lambda r: r.seq)] == [f"s{k}{n}" for k in range(3) for n in range(4)]
    assert sorted(r.seq for r in got) == list(range(100, 112))
    (tmp_path / "part9.csv").write_text("name,sku\nx,s9\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_files.read_import_csv(spark, str(tmp_path)).collect()


def test_shops_and_archive(spark, tmp_path):
    known = spark.createDataFrame([("Bags", "mine")], "shop_code string, description string")
    assert {r.shop_code: r.description for r in files.shops(spark, known).collect()} == {
        "Bags": "mine", "Bridal": "Bridal wear retail and rental"}
    trail = spark.createDataFrame([("Bags", NOW, 1), ("Bags", NOW, 2)], "shop_type string, created_at timestamp_ntz, n int")
    for _ in range(2):
        files.archive_history(trail, str(tmp_path / "archive"))
    assert files.read_archive(spark, str(tmp_path / "archive")).where("period = '2024-03-01'").count() == 2
    later = trail.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    day = dt.datetime(NOW.year, NOW.month, NOW.day) + dt.timedelta(days=1)
    files.archive_history(trail.unionByName(later), str(tmp_path / "archive"), since=day, until=day + dt.timedelta(days=1))
    assert sorted(r["count"] for r in files.read_archive(spark, str(tmp_path / "archive")).groupBy("period").count().collect()) == [2, 2]
    with pytest.raises(ValueError):
        files.archive_history(trail, str(tmp_path / "archive"), since=NOW)
    assert files.latest_version(spark, str(tmp_path / "none")) == 0


def log(spark, rows):
    data = [(n, NOW + dt.timedelta(seconds=s), sku, action, shop, qty, status) for n, (s, sku, action, shop, qty, status) in enumerate(rows)]
    return spark.createDataFrame(
        data, "seq bigint, created_at timestamp_ntz, item_sku string, action_type string, shop_type string, quantity_change int,"
              " bridal_status string").withColumn("customer_name_contact", F.lit("Ann")).withColumn("created_by", F.lit("bob"))


def test_log_audits(spark):
    df = log(spark, [
        (0, "A", "Rental Out", "Bridal", 0, "Rented"), (3, "A", "Rental Out", "Bridal", 0, "Rented"),
        (60, "A", "Rental Return", "Bags", 0, "Rented"), (70, "B", "Rental Out", "Bridal", -3, None),
    ])
    assert [r.seq for r in audits.unmatched_rentals(df).collect()] == [3]
    assert sorted(r.seq for r in audits.unmatched_rentals(df, paired=True).collect()) == [0, 3]
    for share in (10**9, 0.01):
        repeats = audits.duplicate_submits(df, 5, share).collect()
        assert [(r.seq, r.repeats_seq) for r in repeats] == [(1, 0)]
    assert [r.item_sku for r in audits.cross_shop_skus(df).collect()] == ["A"]
    assert sorted((r.item_sku, r.bridal_status) for r in audits.status_desync(df).collect()) == [("A", "Rented"), ("B", None)]
    assert [r.seq for r in audits.zero_qty_returns(df).collect()] == [2]
    assert [r.seq for r in audits.implausible_qty(df).collect()] == [3]
    assert audits.recent_actors(df, NOW + dt.timedelta(days=1)).count() == 2


def test_counts(spark):
    live = spark.createDataFrame(
        [("A", "Bags", 1.0, 5), ("B", "Bags", 1.0, 5), ("C", "Bags", 1.0, 5), ("D", "Bridal", 1.0, 5), ("E", "Bags", 99.0, 5)],
        "item_sku string, shop_type string, sell_price double, live_stock bigint")
    counts = spark.createDataFrame([("A", 6), ("B", 4), ("C", 6), ("D", 6), ("E", 4)], "item_sku string, physical_qty int")
    again = spark.createDataFrame([("C",), ("C",)], "item_sku string")
    deltas = audits.count_delta(counts, live, high_value=50, recurring=again)
    assert {r.item_sku: r.severity for r in deltas.collect()} == {
        "A": "minor", "B": "minor", "C": "severe", "D": "moderate", "E": "severe"}
    for share in (10**9, 0.01):
        pairs = {r.item_sku: (r.counterparts, r.partner_sku) for r in audits.wrong_sku_pairs(deltas, share).collect()}
        assert pairs == {"A": (2, "B"), "B": (2, "A"), "C": (2, "E"), "E": (2, "C")}
    causes = audits.assign_cause(deltas, {
        "Status desync": [deltas.where("item_sku in ('A', 'B')")], "Unrecorded return": [deltas.where("item_sku = 'A'")]})
    assert {r.item_sku: r.cause for r in causes.collect()} == {
        "A": "Unrecorded return", "B": "Status desync", "C": "Unknown", "D": "Unknown", "E": "Unknown"}


def test_gaps_count_copies(spark):
    ext = spark.createDataFrame([("A", "Retail Sale", NOW)] * 3, "item_sku string, action_type string, created_at timestamp_ntz")
    found = audits.gap_transactions(ext, ext.limit(1), NOW - dt.timedelta(days=1)).first()
    assert (found.receipts, found.missing) == (3, 2)


def test_corrections(spark):
    rows = [(1, "CORRECTION of row #41 - wrong"), (2, "CORRECTION"), (3, "BACKFILL - x"), (4, "fine"), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, notes string").withColumns(
        {"created_at": F.lit("x"), "item_sku": F.lit("A"), "action_type": F.lit("Restock")})
    got = {r.id: (r.kind, r.row_reference, r.missing_reference) for r in audits.correction_rows(df).collect()}
    assert got == {1: ("CORRECTION", "41", False), 2: ("CORRECTION", None, True), 3: ("BACKFILL", None, False)}


def test_repeats_on_a_stream_are_those_of_the_batch(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=draw.choice([5 * i, 7 * draw.randrange(300), 500, 505, 510.001])),
             draw.choice(["hot", "hot", "hot", "b", None]), draw.choice(["Restock", "Retail Sale"]), f"n{i}") for i in range(300)]
    schema = "seq bigint, created_at timestamp_ntz, item_sku string, action_type string, notes string"
    # Six micro-batches whose rows come in no order; the last one moves the watermark past all of them.
    for k in range(6):
        spark.createDataFrame(rows[k::6], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([(10**6, dt.datetime(2030, 1, 1), "end", "Restock", None)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/9")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = drop_repeats(source, 5, "1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) >= 6
    kept = spark.read.schema(schema).parquet(f"{tmp_path}/out").where("item_sku is null or item_sku <> 'end'").collect()
    repeats = {r.seq for r in audits.duplicate_submits(spark.createDataFrame(rows, schema), 5).collect()}
    assert len(repeats) > 50
    assert sorted(tuple(r) for r in kept) == sorted((r for r in rows if r[0] not in repeats), key=lambda r: r[0])


def test_imports_from_csv_share_no_id(spark, tmp_path):
    from test_ingest import base_tables

    lines = ["shop_type,item_sku,item_name,action_type,sell_price,quantity_change",
             'Bags,n1,"New, one",New Item,5,2', "Bags,n2,Two,Restock,5,3", "Shoes,n3,Three,Restock,5,3", ",n4,,New Item,,"]
    (tmp_path / "rows.csv").write_text("\n".join(lines))
    before = base_tables(spark)
    once = csv_files.import_csv(spark, str(tmp_path / "rows.csv"), before, NOW, user="desk")
    assert [tuple(r) for r in csv_files.import_counts(once).collect()] == [(2, 2)]
    twice = csv_files.import_csv(spark, str(tmp_path / "rows.csv"), once.tables, NOW, user="desk")
    known = before.movements.count()
    ids = [r.id for r in twice.tables.movements.collect()]
    assert len(ids) == known + 4 and len(set(ids)) == len(ids)
    assert {r.item_sku for r in twice.tables.items.collect()} >= {"N1", "N2"}
    assert {len(r.errors) > 0 for r in twice.rejects.collect()} == {True}


def test_short_items_may_be_off_site(spark):
    deltas = spark.createDataFrame([("a", -1), ("b", -2), ("c", 3), ("d", -1)], "item_sku string, delta bigint")
    live = spark.createDataFrame(
        [("a", "Dry Cleaning"), ("b", "Available"), ("c", "In Alteration"), ("d", None)], "item_sku string, bridal_status string")
    assert [tuple(r) for r in audits.off_site(deltas, live).collect()] == [("a", -1, "Dry Cleaning")]
