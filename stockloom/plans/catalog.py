"""Every operator as a named query over the test tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, boards, ingest, migrate, queries, scope, state

from ..schemas import Tables
from ..session import held, scratch_path
from ..sources import csv_files, tables as files
from ..sources import fixtures as fx
from ..streaming import actions as stream

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = fx.AS_OF
IMPORT_AT = dt.datetime(2001, 6, 1, 12, 0, 0)
EVENTS_AS_OF = dt.datetime(2024, 1, 20, 0, 0, 0)
GAP_SINCE = dt.datetime(2000, 6, 1, 0, 0, 0)
REPEAT_SECONDS = 3 * 3600
HIGH_VALUE = 1000.0

_REGISTRY: dict[str, Query] = {}


def _query(build: Query) -> Query:
    _REGISTRY[build.__name__] = build
    return build


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


def _live(spark: SparkSession, d: str) -> DataFrame:
    return state.live_inventory(fx.tables(spark, d))


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """The live list for queries that show no customer."""
    return state.live_inventory(fx.tables(spark, d), with_customer=False)


def _ids_as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Row ids can exceed what a result viewer keeps exact, so they are shown as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# --- sources and sinks ---------------------------------------------------------------------------------------------


@_query
def s1_read_log(spark, d):
    path = scratch_path(spark, "log")
    fx.log(spark, d).drop("gross_profit", "created_by").write.parquet(path)
    return _ids_as_text(files.read_log(spark, path), "seq")


@_query
def s2_read_tables(spark, d):
    root = scratch_path(spark, "tables")
    files.write_tables(fx.tables(spark, d), root)
    return migrate.migration_counts(files.current_tables(spark, root))


@_query
def s3_shops(spark, d):
    held = fx.items(spark, d).groupBy("shop_code").agg(F.count(F.lit(1)).alias("items"))
    return files.shops(spark).join(held, "shop_code", "left")


def _exported(spark, d, shop):
    rows = csv_files.export_rows(_live(spark, d), shop)
    return csv_files.export_csv(rows, scratch_path(spark, "export"), shop, AS_OF.date())


@_query
def s4_read_import_csv(spark, d):
    return csv_files.read_import_csv(spark, _exported(spark, d, "Bridal"))


@_query
def s4_read_broken_lines(spark, d):
    """Values with quotes, commas and line breaks, written as CSV and read again by splits."""
    path = scratch_path(spark, "import")
    label = F.concat("item_name", F.lit('\n"'), F.coalesce("brand_designer", F.lit("")), F.lit('",\n\n'), "item_sku")
    rows = fx.items(spark, d).select("item_sku", label.alias("label"), "shop_code")
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    return csv_files.read_import_csv(spark, path, multi_line=True)


@_query
def s5_normalize_import(spark, d):
    listed = csv_files.export_rows(_live(spark, d), "Bags").orderBy("item_sku")
    path = csv_files.export_csv(listed, scratch_path(spark, "export"), "Bags", AS_OF.date())
    rows = csv_files.read_import_csv(spark, path, numbered=True)
    return csv_files.normalize_import(rows, IMPORT_AT, first=1000).drop("quantity")


@_query
def s6_import_report(spark, d):
    """A CSV folder imported into the tables: what was logged and what failed."""
    path = scratch_path(spark, "import")
    raw = fx.raw_actions(spark, d).orderBy("created_at", "seq").drop("created_at", "seq")
    raw.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
    return csv_files.import_counts(csv_files.import_csv(spark, path, fx.full_tables(spark, d), EVENTS_AS_OF))


@_query
def s7_export_rows(spark, d):
    return csv_files.export_rows(_live(spark, d), "Bridal")


@_query
def s8_export_csv(spark, d):
    lines = spark.read.text(_exported(spark, d, "Bags"))
    return lines.where(~F.col("value").startswith("shop_type,item_sku,"))


@_query
def s9_archive_history(spark, d):
    path = scratch_path(spark, "archive")
    files.archive_history(state.history(fx.tables(spark, d), with_id=False), path, "month")
    return files.read_archive(spark, path).groupBy("shop_type", F.col("period").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity_change").cast("bigint").alias("quantity")
    )


# --- ingest --------------------------------------------------------------------------------------------------------


def _decided(spark, d):
    return ingest.decide(fx.raw_actions(spark, d), fx.rentals(spark, d))


def _actions(spark, d):
    return ingest.accepted(_decided(spark, d))


@_query
def i1_validate_actions(spark, d):
    checked = ingest.validate_actions(fx.raw_actions(spark, d))
    return checked.select("seq", F.concat_ws(" ", "errors").alias("errors"))


@_query
def i2_coerce_actions(spark, d):
    return ingest.coerce_actions(fx.raw_actions(spark, d))


@_query
def i3_route_actions(spark, d):
    routes = ingest.route_actions(fx.raw_actions(spark, d))
    union = None
    for name, rows in routes.items():
        part = rows.select("seq", F.lit(name).alias("route"))
        union = part if union is None else union.unionByName(part)
    return union


@_query
def i4_upsert_items(spark, d):
    return ingest.upsert_items(fx.full_items(spark, d), _actions(spark, d))


@_query
def i5_upsert_customers(spark, d):
    return ingest.upsert_customers(fx.full_customers(spark, d), _actions(spark, d), "till")


@_query
def i6_open_rentals(spark, d):
    return _ids_as_text(ingest.open_rentals(_actions(spark, d), fx.customers(spark, d), "till"), "id")


@_query
def i7_close_rentals(spark, d):
    actions, old = _actions(spark, d), fx.full_rentals(spark, d)
    every = old.unionByName(ingest.open_rentals(actions, fx.customers(spark, d), "till"), allowMissingColumns=True)
    return _ids_as_text(ingest.close_rentals(every, actions), "id")


@_query
def i8_append_lifecycle(spark, d):
    return _ids_as_text(ingest.append_lifecycle(_actions(spark, d), "till"), "id")


@_query
def i9_append_movements(spark, d):
    return _ids_as_text(ingest.append_movements(_actions(spark, d), "till"), "id")


@_query
def i10_action_result(spark, d):
    return _ids_as_text(ingest.action_result(_actions(spark, d)), "id")


@_query
def i_rejects(spark, d):
    return ingest.rejected(_decided(spark, d)).select("seq", "item_sku", F.concat_ws("; ", "errors").alias("errors"))


@_query
def i11_check_constraints(spark, d):
    return ingest.check_constraints(fx.flawed_tables(spark, d))


@_query
def i11_check_log(spark, d):
    """The rules of the single-table log over raw actions taken as they are."""
    return ingest.check_log(fx.raw_actions(spark, d))


@_query
def i12_delete_item(spark, d):
    doomed = fx.table(spark, d, "part").where("p_size = 7").select(
        F.expr("concat(' sku-', lpad(CAST(p_partkey AS STRING), 12, '0'))").alias("item_sku")
    )
    return ingest.delete_items(fx.tables(spark, d), doomed, "Bags")[1]


@_query
def i12_rows_left(spark, d):
    """Every row that a deletion leaves, as text."""
    doomed = fx.table(spark, d, "part").where("p_size = 7").select(
        F.expr("concat('SKU-', lpad(CAST(p_partkey AS STRING), 12, '0'))").alias("item_sku")
    )
    after, _ = ingest.delete_items(fx.full_tables(spark, d), doomed, "Bags")
    return _as_lines({name: getattr(after, name) for name in after.names()})


def _streamed(spark, d):
    root = scratch_path(spark, "store")
    stream.start_store(spark, root, fx.full_tables(spark, d))
    events = fx.table(spark, d, "events").schema
    source = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(d)
    raw = fx.raw_from_events(source)
    stream.ingest_stream(raw, root, scratch_path(spark, "offsets"), every=None, user="till").awaitTermination()
    return root


@_query
def i13_ingest_stream(spark, d):
    return stream.read_store(spark, _streamed(spark, d)).items


@_query
def i13_stream_rows(spark, d):
    """Every row of the other tables and of the rejects after the stream, as text."""
    root = _streamed(spark, d)
    after = stream.read_store(spark, root)
    frames = {name: getattr(after, name) for name in ("movements", "lifecycle", "customers", "rentals")}
    frames["rejects"] = stream.read_rejects(spark, root).select("seq", "item_sku", F.concat_ws("; ", "errors").alias("errors"))
    return _as_lines(frames)


def _as_lines(frames):
    """Full rows of several tables in one frame: (table_name, line)."""
    union = None
    for name, df in frames.items():
        line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)))
        part = df.select(F.lit(name).alias("table_name"), line.alias("line"))
        union = part if union is None else union.unionByName(part)
    return union


@_query
def i14_guard_actions(spark, d):
    return ingest.guard_actions(fx.raw_actions(spark, d), _figures(spark, d), fx.rentals(spark, d))


# --- derived state -------------------------------------------------------------------------------------------------


@_query
def v1_item_stock(spark, d):
    return state.item_stock(fx.items(spark, d), fx.movements(spark, d))


@_query
def v2_item_current_status(spark, d):
    status = state.item_current_status(fx.items(spark, d), fx.lifecycle(spark, d), fx.rentals(spark, d))
    return _ids_as_text(status, "active_rental_id")


@_query
def v3_item_profit(spark, d):
    return state.item_profit(fx.items(spark, d))


@_query
def v4_unified_history(spark, d):
    t = fx.tables(spark, d)
    return _ids_as_text(state.unified_history(t.items, t.movements, t.lifecycle, t.rentals), "id")


@_query
def v5_sales_count(spark, d):
    return state.sales_count(fx.movements(spark, d))


@_query
def v6_rental_revenue(spark, d):
    return state.rental_revenue(fx.rentals(spark, d))


@_query
def v7_latest_event(spark, d):
    return state.latest_event(fx.movements(spark, d), fx.lifecycle(spark, d), fx.rentals(spark, d))


@_query
def v8_active_rental(spark, d):
    return state.active_rental(fx.rentals(spark, d))


@_query
def v9_latest_lifecycle(spark, d):
    return state.latest_lifecycle(fx.lifecycle(spark, d))


@_query
def v10_open_rentals(spark, d):
    opened = state.open_rentals_view(fx.rentals(spark, d))
    return _ids_as_text(opened.select("id", "item_sku", "customer_id", "booked_at", "due_date", "rental_price"), "id")


@_query
def v11_live_inventory(spark, d):
    return _live(spark, d)


@_query
def v12_history(spark, d):
    return state.history(fx.tables(spark, d))


@_query
def v13_legacy_live(spark, d):
    return state.legacy_live(fx.log(spark, d))


@_query
def v14_running_stock(spark, d):
    rows = state.running_stock(fx.log(spark, d)).select(
        "seq", "created_at", "item_sku", "action_type", "quantity_change", "running_stock"
    )
    return _ids_as_text(rows, "seq")


# --- reads ---------------------------------------------------------------------------------------------------------


@_query
def q1_live(spark, d):
    return queries.live(_live(spark, d), "Bridal")


@_query
def q2_live_summary(spark, d):
    return queries.live_summary(_figures(spark, d), AS_OF)


@_query
def q3_history_query(spark, d):
    return queries.history_page(fx.tables(spark, d), "Bridal", limit="500")


@_query
def q3_history_count(spark, d):
    page = queries.history_query(state.history(fx.tables(spark, d), with_id=False), sku=" sku-000000000012 ")
    return queries.history_count(page)


@_query
def q4_item_lookup(spark, d):
    return queries.item_lookup(_live(spark, d), "SKU-000000000012", "Bridal")


@_query
def q5_owned(spark, d):
    asked = fx.raw_actions(spark, d).select("item_sku")
    return queries.owned(fx.items(spark, d), asked, "Bridal")


# --- boards --------------------------------------------------------------------------------------------------------


@_query
def d1_dashboard(spark, d):
    return boards.dashboard(_figures(spark, d), AS_OF)


@_query
def d2_shop_summary(spark, d):
    return boards.shop_summary(_figures(spark, d))


@_query
def d3_bags_stats(spark, d):
    return boards.bags_stats(_figures(spark, d))


@_query
def d4_bridal_stats(spark, d):
    return boards.bridal_stats(_figures(spark, d))


@_query
def d5_rental_stats(spark, d):
    return boards.rental_stats(_figures(spark, d), AS_OF)


@_query
def d6_rental_board(spark, d):
    return boards.rental_board(_live(spark, d), "all", AS_OF)


@_query
def d6_rental_board_overdue(spark, d):
    return boards.rental_board(_live(spark, d), "overdue", AS_OF)


@_query
def d7_upcoming_returns(spark, d):
    return boards.upcoming_returns(_live(spark, d))


@_query
def d8_days_until(spark, d):
    return boards.due_days(_figures(spark, d), AS_OF)


@_query
def d9_search_inventory(spark, d):
    return boards.search_inventory(_figures(spark, d), "Red").select("item_sku", "item_name", "bag_color")


@_query
def d10_search_history(spark, d):
    found = boards.search_history(state.history(fx.tables(spark, d), with_id=False), "correction")
    return found.select("created_at", "item_sku", "action_type", "notes", "quantity_change")


@_query
def d11_stock_band(spark, d):
    return boards.stock_band(_figures(spark, d), AS_OF)


@_query
def d12_margin_band(spark, d):
    rows = state.history(fx.tables(spark, d), with_id=False)
    return boards.margin_band(rows, "created_at", "item_sku", "action_type")


@_query
def d13_sellable(spark, d):
    return boards.sellable(_figures(spark, d), "Bags").select("item_sku", "live_stock")


@_query
def d14_rentable(spark, d):
    return boards.rentable(_figures(spark, d)).select("item_sku", "bridal_status")


@_query
def d15_returnable(spark, d):
    return boards.returnable(_live(spark, d)).select("item_sku", "customer_name_contact")


@_query
def d16_product_label(spark, d):
    return boards.product_label(_figures(spark, d))


# --- migration -----------------------------------------------------------------------------------------------------


@_query
def m1_backfill_items(spark, d):
    return migrate.backfill_items(fx.log(spark, d), fx.full_items(spark, d), AS_OF)


@_query
def m2_backfill_customers(spark, d):
    return migrate.backfill_customers(fx.log(spark, d), fx.full_customers(spark, d), AS_OF, "mover")


@_query
def m3_backfill_movements(spark, d):
    return _ids_as_text(migrate.backfill_movements(fx.log(spark, d)), "id")


@_query
def m4_backfill_lifecycle(spark, d):
    return _ids_as_text(migrate.backfill_lifecycle(fx.log(spark, d)), "id")


@_query
def m4_lifecycle_rejects(spark, d):
    return migrate.lifecycle_rejects(fx.event_log(spark, d).withColumn("notes", F.lit("moved"))).select(
        "id", "item_sku", "status", "occurred_at"
    )


@_query
def m5_backfill_rentals(spark, d):
    log = fx.log(spark, d)
    return _ids_as_text(migrate.backfill_rentals(log, migrate.backfill_customers(log)), "id")


@_query
def m6_migration_rerun(spark, d):
    """Counts after a second run over the result of the first: the same as after one run."""
    log = migrate.read_source(fx.log(spark, d))
    root = scratch_path(spark, "migrated")
    files.write_tables(migrate.migrate(log).tables, root)
    return migrate.migration_counts(migrate.migrate(log, files.current_tables(spark, root)).tables)


@_query
def m6_rerun_rows(spark, d):
    """Every row after a migration into filled tables and a second one over its result, as text."""
    log = migrate.read_source(fx.log(spark, d))
    root = scratch_path(spark, "migrated")
    old = fx.full_tables(spark, d)
    base = Tables(old.items, old.movements.where("false"), old.lifecycle.where("false"), old.customers, old.rentals.where("false"))
    files.write_tables(migrate.migrate(log, base, AS_OF, "mover").tables, root)
    after = migrate.migrate(log, files.current_tables(spark, root), AS_OF, "mover").tables
    return _as_lines({name: getattr(after, name) for name in after.names()})


@_query
def m_rejects(spark, d):
    """What a migration cannot take from a log with prices below 0, early due dates, missing contacts and odd statuses."""
    bad = fx.log(spark, d).withColumns({
        "sell_price": F.expr("CASE WHEN min_stock_alert % 11 = 0 THEN CAST(-1 AS DECIMAL(10,2)) ELSE sell_price END"),
        "rental_due_date": F.expr("CASE WHEN min_stock_alert % 5 = 0 THEN DATE'1990-01-01' ELSE rental_due_date END"),
        "customer_name_contact": F.expr("CASE WHEN min_stock_alert % 7 = 0 THEN NULL ELSE customer_name_contact END"),
        "bridal_status": F.expr("CASE WHEN action_type = 'Status Change' AND min_stock_alert % 3 = 0 THEN 'Returned' ELSE bridal_status END"),
    })
    return _ids_as_text(migrate.migrate(bad).rejects, "id")


@_query
def m7_migration_counts(spark, d):
    return migrate.migration_counts(migrate.migrate(fx.log(spark, d)).tables)


@_query
def m8_sku_parity(spark, d):
    log = fx.log(spark, d)
    return migrate.sku_parity(log, migrate.backfill_items(log))


@_query
def m9_inflight_rentals(spark, d):
    return migrate.inflight_rentals(fx.log(spark, d), dt.datetime(2001, 3, 1, 0, 0, 0), minutes=60 * 24)


# --- scope and audit -----------------------------------------------------------------------------------------------


@_query
def r1_scope_items(spark, d):
    return scope.scope_items(fx.items(spark, d), "Bridal")


@_query
def r4_role_rows(spark, d):
    """Keys of every row that each role sees."""
    t = fx.tables(spark, d)
    union = None
    for role in scope.ROLES:
        seen = scope.role_view(role, t, "Bridal")
        for name in seen.names():
            rows = getattr(seen, name)
            key = F.col("item_sku" if name == "items" else "id").cast("string").alias("key")
            part = rows.select(F.lit(role).alias("role"), F.lit(name).alias("table_name"), key)
            union = part if union is None else union.unionByName(part)
    return union


@_query
def r5_refused_writes(spark, d):
    """Rows that each role may not write in a session of the bridal shop, per table."""
    t = fx.tables(spark, d)
    union = None
    for role in scope.ROLES:
        for name in t.names():
            rows = scope.refused_writes(role, name, getattr(t, name), t.items, "Bridal")
            part = rows.agg(F.count(F.lit(1)).alias("refused")).select(
                F.lit(role).alias("role"), F.lit(name).alias("table_name"), "refused")
            union = part if union is None else union.unionByName(part)
    return union


@_query
def r2_scope_children(spark, d):
    rows = scope.scope_children(fx.movements(spark, d), fx.items(spark, d), "Bridal")
    return _ids_as_text(rows.select("id", "item_sku", "action_type", "quantity_change"), "id")


@_query
def r3_scope_customers(spark, d):
    t = fx.tables(spark, d)
    return scope.scope_customers(t.customers, t.rentals, t.items, "Bridal")


@_query
def r4_role_view(spark, d):
    return scope.role_counts(fx.tables(spark, d), "Bridal")


@_query
def r5_check_write_scope(spark, d):
    rows = scope.check_write_scope(fx.movements(spark, d), fx.items(spark, d), "Bridal")
    return _ids_as_text(rows.select("id", "item_sku"), "id")


@_query
def r6_audit_items(spark, d):
    old = fx.items(spark, d)
    return scope.audit_items(old, fx.repriced_items(old), AS_OF, "app_admin")


@_query
def r6_audit_actions(spark, d):
    return ingest.item_audit(fx.full_items(spark, d), _actions(spark, d), "till")


# --- reconciliation ------------------------------------------------------------------------------------------------


@_query
def a1_baseline_check(spark, d):
    return audits.baseline_check(fx.log(spark, d), _figures(spark, d))


@_query
def a2_unmatched_rentals(spark, d):
    return audits.unmatched_rentals(fx.event_log(spark, d))


@_query
def a2_unpaired_rentals(spark, d):
    return audits.unmatched_rentals(fx.event_log(spark, d), paired=True)


@_query
def a3_implausible_qty(spark, d):
    return audits.implausible_qty(fx.event_log(spark, d))


@_query
def a4_zero_qty_returns(spark, d):
    return audits.zero_qty_returns(fx.event_log(spark, d))


@_query
def a5_duplicate_submits(spark, d):
    return audits.duplicate_submits(fx.event_log(spark, d), REPEAT_SECONDS)


@_query
def a5_drop_repeats_stream(spark, d):
    """The actions left when the log arrives in five parts, each with actions of all times, and a last one far ahead."""
    parts, events = scratch_path(spark, "parts"), fx.table(spark, d, "events")
    for part in range(5):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(5)) == part).write.parquet(f"{parts}/{part}")
    ahead = events.orderBy("event_id").limit(1).withColumn("ts", (F.col("ts") + F.make_ym_interval(F.lit(100))).cast(events.schema["ts"].dataType))
    ahead.write.parquet(f"{parts}/ahead")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", "true").parquet(parts)
    raw = fx.raw_from_events(source).select("seq", "created_at", "item_sku", "action_type")
    unique = stream.drop_repeats(raw, REPEAT_SECONDS, "1000 days")
    out = scratch_path(spark, "unique")
    unique.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", scratch_path(spark, "offsets")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(unique.schema).parquet(out)


@_query
def a6_cross_shop_skus(spark, d):
    return audits.cross_shop_skus(fx.event_log(spark, d))


@_query
def a7_status_desync(spark, d):
    return audits.status_desync(fx.event_log(spark, d))


def _deltas(spark, d, live):
    recurring = fx.incidents(spark, d).where("delta > 4")
    return audits.count_delta(fx.counts(live), live, HIGH_VALUE, recurring)


@_query
def a8_count_delta(spark, d):
    return _deltas(spark, d, _figures(spark, d))


@_query
def a9_snapshot_sku(spark, d):
    t = fx.tables(spark, d)
    # Asked for by the counts, the deltas and the snapshot.
    live = held(state.live_inventory(t).select(
        "item_sku", "shop_type", "sell_price", "live_stock", "bridal_status", "customer_name_contact", "rental_due_date"), "live")
    return audits.snapshot_sku(state.history_actions(t), live, audits.count_delta(fx.counts(live), live))


@_query
def a10_class_a_skus(spark, d):
    return audits.class_a_skus(_figures(spark, d))


@_query
def a11_discrepancy_trend(spark, d):
    return audits.discrepancy_trend(fx.incidents(spark, d), fx.items(spark, d))


@_query
def a12_overdue_without_return(spark, d):
    return _ids_as_text(audits.overdue_without_return(fx.rentals(spark, d), AS_OF), "id")


@_query
def a13_recent_actors(spark, d):
    return audits.recent_actors(fx.event_log(spark, d), EVENTS_AS_OF)


@_query
def a14_correction_rows(spark, d):
    return audits.correction_rows(state.history(fx.tables(spark, d)))


@_query
def a15_gap_transactions(spark, d):
    return audits.gap_transactions(fx.receipts(spark, d), fx.patchy_log(spark, d), GAP_SINCE)


@_query
def a16_wrong_sku_pairs(spark, d):
    live = _figures(spark, d)
    return audits.wrong_sku_pairs(audits.count_delta(fx.counts(live), live))


@_query
def a17_shortage_causes(spark, d):
    """A count that misses something of every item, next to a log with few faults: each cause comes first somewhere."""
    live = _figures(spark, d)
    deltas = audits.count_delta(fx.shortages(live), live)
    gaps = audits.gap_transactions(fx.receipts(spark, d), fx.patchy_log(spark, d), GAP_SINCE)
    return audits.find_causes(
        deltas, fx.tidy_log(spark, d), fx.damaged_trail(spark, d), live, fx.rentals(spark, d), AS_OF,
        recount=fx.recounts(deltas), gaps=gaps, seconds=REPEAT_SECONDS // 3)


@_query
def a17_assign_cause(spark, d):
    live = _figures(spark, d)
    deltas = audits.count_delta(fx.counts(live), live)
    gaps = audits.gap_transactions(fx.receipts(spark, d), fx.patchy_log(spark, d), GAP_SINCE)
    return audits.find_causes(
        deltas, fx.event_log(spark, d), fx.damaged_trail(spark, d), live, fx.rentals(spark, d), AS_OF,
        recount=fx.recounts(deltas), gaps=gaps, seconds=REPEAT_SECONDS)
