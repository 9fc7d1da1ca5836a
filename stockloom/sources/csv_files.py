"""CSV import and export of the item list."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import instant, js_trim
from ..operators.ingest import Ingested, accepted, decide, ingest
from ..operators.ordered import global_row_number
from ..schemas import DEFAULT_USER, RAW_FIELDS, ROW_ID, Tables

# The exported columns, in order.
EXPORT_COLUMNS = (
    "shop_type", "item_sku", "item_name", "brand_designer", "item_image", "stock_cost_price", "sell_price",
    "live_stock", "min_stock_alert", "bag_color", "bridal_size", "bridal_status", "rental_due_date",
    "customer_name_contact", "last_action", "total_gross_profit", "profit_margin",
)
_EMPTY_FOR_NULL = (
    "brand_designer", "item_image", "bag_color", "bridal_size", "bridal_status", "rental_due_date",
    "customer_name_contact",
)
# Other header names an import accepts, and the value of an absent field.
_ALIASES = {
    "item_sku": "sku", "item_name": "name", "stock_cost_price": "cost", "sell_price": "price",
    "quantity_change": "qty_change",
}
_DEFAULTS = {
    "shop_type": "Bags", "stock_cost_price": "0", "sell_price": "0", "quantity_change": "0",
    "min_stock_alert": "2", "action_type": "New Item",
}


def _records(lines: DataFrame) -> DataFrame:
    """Lines (_file, _start, _line, value) joined to records: a line break inside quotes ends none.

    A line begins a record where the quotes before it in its file are even. They are counted inside each split of a file, and
    a row per split carries the count and the last beginning on, so a file of any size is spread over the tasks of its
    splits. Only lines of records with breaks are grouped. Adds ``_head``, whether the record is the first of its file that
    is not blank.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    split = Window.partitionBy("_file", "_start").orderBy("_line")
    earlier = split.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_quotes", quotes).withColumn("_odd", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    splits = placed.groupBy("_file", "_start").agg(
        F.sum("_quotes").alias("_sum"), F.max(F.when(F.col("_odd") == 0, F.col("_line"))).alias("_even_line"),
        F.max(F.when(F.col("_odd") == 1, F.col("_line"))).alias("_odd_line"),
        F.min(F.when(F.trim("value") != "", F.col("_line"))).alias("_top"))
    file = Window.partitionBy("_file")
    before = file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.struct("_start", F.when(F.col("_in") == 0, F.col("_even_line")).otherwise(F.col("_odd_line")).alias("_line"))
    carried = (
        splits.withColumn("_in", F.coalesce(F.sum("_sum").over(before), F.lit(0)) % 2)
        .withColumn("_open", F.last(F.when(begun["_line"].isNotNull(), begun), ignorenulls=True).over(before))
        .withColumn("_first", F.min(F.when(F.col("_top").isNotNull(), F.struct("_start", F.col("_top").alias("_line")))).over(file))
        .select("_file", "_start", "_in", "_open", "_first")
    )
    begins = (F.col("_odd") + F.col("_in")) % 2 == 0
    upto = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(begins, F.struct("_start", "_line")), ignorenulls=True).over(upto)
    marked = placed.join(carried, ["_file", "_start"]).withColumn("_at", F.coalesce(own, "_open")).withColumn(
        "_whole", begins & (F.col("_quotes") % 2 == 0))
    columns = ["_file", F.col("_at._start").alias("_start"), F.col("_at._line").alias("_line"), "value",
               (F.col("_at") == F.col("_first")).alias("_head")]
    torn = marked.where(~F.col("_whole")).groupBy("_file", "_at", "_first").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "_line", "value"))), lambda x: x["value"]), "\n")
        .alias("value"))
    return marked.where("_whole").select(*columns).unionByName(torn.select(*columns))


def _broken_lines(spark: SparkSession, path: str, header: list[str], options: dict) -> DataFrame:
    """Rows of CSV files whose values may hold line breaks, with _file, _start and _line of the line where they begin."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    schema = ", ".join(f"c{i} string" for i in range(len(header)))
    rows = _records(lines).where(F.trim("value") != "").withColumn("_v", F.from_csv("value", schema, options))
    names = F.array(*(F.lower(F.trim(F.coalesce(F.col(f"_v.c{i}"), F.lit("")))) for i in range(len(header))))
    same = names == F.array(*(F.lit(c.strip().lower()) for c in header))
    other = F.raise_error(F.concat(F.lit("another header in "), F.col("_file")))
    return rows.where(F.when(F.col("_head") & ~same, other).otherwise(~F.col("_head"))).select(
        *(F.col(f"_v.c{i}").alias(c) for i, c in enumerate(header)), "_file", "_start", "_line")


def read_import_csv(spark: SparkSession, path: str, multi_line: bool = False, numbered: bool = False) -> DataFrame:
    """Rows of a CSV file or folder as trimmed text; absent trailing fields are ''.

    Blank lines are no rows, lines of nothing but commas are. Standard quoting: doubled quotes belong to the value.
    Large files are split over tasks. ``multi_line=True`` is needed only where a value holds a line break: lines are then
    joined while the quotes before them are odd, still split over tasks, for lines that end in LF or CRLF; a quote that is
    never closed runs to the end of its file. All files of a folder must have the same header, otherwise reading fails.
    ``numbered`` adds ``row_no``, counted from 0 by file name and place in the file, whatever way the files were split.
    """
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    raw = spark.read.csv(path, header=True, multiLine=multi_line, inferSchema=False, enforceSchema=False, **options)
    if not raw.columns:
        return raw
    names = raw.columns
    if multi_line:
        raw = _broken_lines(spark, path, names, {k: str(v).lower() if v is True else v for k, v in options.items()})
    cleaned = {c.strip(): F.coalesce(js_trim(F.col(f"`{c}`")), F.lit("")) for c in names}
    columns = [value.alias(name) for name, value in cleaned.items()]
    if not numbered:
        return raw.select(*columns)
    # Ids rise within a split of a file, so file, start of the split and id give the order of the lines.
    place = [F.col(c) for c in ("_file", "_start", "_line")] if multi_line else [
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line")]
    counted = global_row_number(raw.select(*columns, *place), ["_file", "_start", "_line"], "row_no")
    return counted.withColumn("row_no", F.col("row_no") - 1).select(*cleaned, "row_no")


def normalize_import(rows: DataFrame, as_of: dt.datetime, first: int = 0) -> DataFrame:
    """Imported rows as raw actions. '' counts as absent, so aliases and defaults apply to it too.

    Actions are numbered from ``first`` on by ``row_no`` where the rows have it (see ``read_import_csv``). Numbers become
    row ids, so each import should start above the ids of the last.
    """

    def pick(field: str) -> Column:
        names = [n for n in (field, _ALIASES.get(field)) if n in rows.columns]
        values = [F.nullif(F.col(n), F.lit("")) for n in names]
        return F.coalesce(*values, F.lit(_DEFAULTS.get(field, ""))).alias(field)

    fields = [f for f in RAW_FIELDS if f != "quantity"]
    number = F.col("row_no") if "row_no" in rows.columns else F.monotonically_increasing_id()
    # Ids of very large sources do not fit 64 bits.
    fits = first < 1 << 62
    seq = (number + F.lit(first)).cast("bigint") if fits else (number.cast(ROW_ID) + F.lit(Decimal(first))).cast(ROW_ID)
    return rows.select(
        seq.alias("seq"), instant(as_of).alias("created_at"),
        *(pick(f) for f in fields), F.lit(None).cast("string").alias("quantity"),
    )


def next_id(tables: Tables) -> int:
    """A number above the row ids of all event tables."""
    tops = [df.agg(F.max("id").alias("top")) for df in (tables.movements, tables.lifecycle, tables.rentals)]
    top = tops[0].unionByName(tops[1]).unionByName(tops[2]).agg(F.max("top")).first()[0]
    return 0 if top is None else int(top) + 1


def import_csv(
    spark: SparkSession, path: str, tables: Tables, as_of: dt.datetime, first: int | None = None, user: str = DEFAULT_USER,
    multi_line: bool = False,
) -> Ingested:
    """A CSV file or folder logged as actions: the tables after it, the rejects, and a result for each logged row.

    Rows are taken in the order of the files and get ids from ``first`` on, by default above all ids in the tables, so no
    two imports share an id. A row that fails leaves no trace but its reject.
    """
    rows = read_import_csv(spark, path, multi_line, numbered=True)
    start = next_id(tables) if first is None else first
    return ingest(normalize_import(rows, as_of, start), tables, user=user)


def import_counts(done: Ingested) -> DataFrame:
    """ok and failed: how many rows of an import were logged, how many were not."""
    marked = done.results.select(F.lit(1).alias("ok")).unionByName(done.rejects.select(F.lit(0).alias("ok")))
    return marked.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.count_if(F.col("ok") == 0).alias("failed"))


def import_report(actions: DataFrame, open_rentals: DataFrame | None = None) -> DataFrame:
    """How many imported rows are logged and how many fail."""
    decided = decide(actions, open_rentals)
    return decided.agg(
        F.count_if(F.size("errors") == 0).alias("ok"), F.count_if(F.size("errors") > 0).alias("failed")
    )


def import_actions(
    rows: DataFrame, as_of: dt.datetime, open_rentals: DataFrame | None = None, first: int = 0,
) -> DataFrame:
    return accepted(decide(normalize_import(rows, as_of, first), open_rentals))


def export_rows(live: DataFrame, shop: str) -> DataFrame:
    rows = live.where(F.col("shop_type") == shop)
    return rows.select(
        *(
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in _EMPTY_FOR_NULL else F.col(c)
            for c in EXPORT_COLUMNS
        )
    )


def export_csv(rows: DataFrame, folder: str, shop: str, day: dt.date) -> str:
    """Write export rows below ``folder`` as inventory-<shop>-<day>; values are quoted only where needed."""
    path = f"{folder}/inventory-{shop.lower()}-{day.isoformat()}"
    rows.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return path
