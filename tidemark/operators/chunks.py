"""Updating a large table in keyset pages: each page is one bounded range of keys and one commit."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_ranges(df: DataFrame, key: str) -> DataFrame:
    """df sorted into ranges of the key, kept until it is unpersisted: what ``numbered`` counts must not change."""
    return df.repartitionByRange(key).withColumn("_r", F.spark_partition_id()).persist()


def numbered(ranged: DataFrame, key: str, size: int) -> DataFrame:
    """Rows of ``by_ranges`` with ``page``, their run of ``size`` keys in order. Only one count a range is summed up."""
    ahead = Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1
    return ranged.join(F.broadcast(counts.select("_r", "_before")), "_r").withColumn("page", F.floor(place / size).cast("bigint")).drop("_r", "_before")


def page_bounds(df: DataFrame, key: str, size: int) -> DataFrame:
    """(page, lo, hi, rows) of runs of ``size`` keys in order, from one sort by ranges."""
    rows = numbered(by_ranges(df.select(key), key), key, size)
    return rows.groupBy("page").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("rows"))


def pages(df: DataFrame, key: str, size: int, most: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(after, upto, rows) of each page in key order, until the table or ``most`` rows are used up.

    Only page bounds reach the driver, one row a page. The last page that ``most`` allows is whole if the limit
    falls between pages, else it is looked up on its own.
    """
    left = most
    for r in page_bounds(df, key, size).orderBy("page").collect():
        lo, hi, rows = r["lo"], r["hi"], r["rows"]
        if left is not None and left <= 0:
            return
        if left is not None and rows > left:
            hi, rows = df.filter(F.col(key).between(lo, hi)).select(key).orderBy(key).limit(left).agg(F.max(key), F.count(F.lit(1))).first()
        yield lo, hi, rows
        left = None if left is None else left - rows


def chunked_update(df: DataFrame, key: str, size: int, change: dict[str, Column], commit: Callable[[DataFrame], None], most: int | None = None) -> int:
    """Commit the changed rows page by page; returns how many there were."""
    total = 0
    for lo, hi, rows in pages(df, key, size, most):
        commit(df.filter(F.col(key).between(lo, hi)).withColumns(change))
        total += rows
    return total


def page_totals(df: DataFrame, key: str, size: int) -> DataFrame:
    """(page, rows, last) of pages of a dense key range, in one plan."""
    page = F.floor(F.col(key) / size).cast("bigint")
    return df.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("rows"), F.max(key).alias("last"))
