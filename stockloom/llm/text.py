"""Column helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import held  # noqa: F401

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"


def whole(text: Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of the whole text in order; an empty array for a null or blank text."""
    return F.array_remove(F.split(whole(text), GAP), "")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` mentions it.

    Expressions inside higher-order functions are evaluated per element, so a plain reference to a computed column could
    be inlined there and run again for every element; a lambda variable cannot.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def id_text(doc_id: Column) -> Column:
    """A document id as text; null reads as empty."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(folds)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark context, the way ``--py-files`` does.

    The archive is written on the driver and handed to Spark, which serves it to every executor, also to later ones.
    """
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="stockloom-code-"), "stockloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._llm_shipped = True
