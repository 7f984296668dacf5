"""Which fields a change touched, and the audit rows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stands for a value that the log did not carry.
UNREADABLE = "__debezium_unavailable_value"


def _get(image: Column, name: Column) -> Column:
    return F.try_element_at(image, name)


def field_diff(before: Column, after: Column, absent_is_null: bool = True) -> Column:
    """(identifiable, changed, unreadable): without both images nothing can be told.

    An absent field is null, or, if that is not wanted, a field that only one image has is changed.
    """
    names = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))

    def hidden(c: Column) -> Column:
        return F.coalesce(_get(before, c) == UNREADABLE, F.lit(False)) | F.coalesce(_get(after, c) == UNREADABLE, F.lit(False))

    known = before.isNotNull() & after.isNotNull()
    none = F.array().cast("array<string>")

    def other(c: Column) -> Column:
        differs = ~_get(before, c).eqNullSafe(_get(after, c))
        return differs if absent_is_null else differs | (F.map_contains_key(before, c) != F.map_contains_key(after, c))

    changed = F.filter(names, lambda c: other(c) & ~hidden(c))
    return F.struct(
        known.alias("identifiable"), F.when(known, changed).otherwise(none).alias("changed"), F.when(known, F.filter(names, hidden)).otherwise(none).alias("unreadable")
    )


def subset_json(image: Column, names: Column) -> Column:
    """JSON of the named fields, nulls kept; null where none is named."""
    picked = F.map_filter(image, lambda k, _: F.array_contains(names, k))
    return F.when((F.size(names) > 0) & image.isNotNull(), F.to_json(picked, {"ignoreNullFields": "false"}))


def recovered(before: Column, after: Column) -> Column:
    """The after image with values the log left out taken from the before image."""
    return F.when(before.isNull(), after).otherwise(F.map_zip_with(after, F.map_filter(before, lambda k, _: F.map_contains_key(after, k)), lambda _, a, b: F.when((a == UNREADABLE) & b.isNotNull(), b).otherwise(a)))


def row_key(before: Column, after: Column, key: str = "id") -> Column:
    return F.coalesce(_get(F.coalesce(after, before), F.lit(key)), F.lit("?"))


def audit(events: DataFrame, tables: str, pipeline: str, now: str) -> DataFrame:
    """One row for each update of the listed tables (comma-separated; empty: none), once a position."""
    listed = [t.strip() for t in tables.split(",") if t.strip()]
    rows = events.filter((F.col("op") == "u") & F.col("table").isin(*listed)) if listed else events.limit(0)
    rows = rows.withColumn("d", field_diff(F.col("before"), F.col("after")))
    return rows.select(
        F.lit(pipeline).alias("pipeline"), F.col("table").alias("source_table"), row_key(F.col("before"), F.col("after")).alias("row_key"), F.col("lsn").alias("source_lsn"),
        F.when(F.col("source_ts_ms") > 0, F.timestamp_millis("source_ts_ms")).otherwise(F.lit(now).cast("timestamp")).alias("source_ts"),
        F.col("d.identifiable").alias("identifiable"), F.concat_ws(",", "d.changed").alias("changed_fields"), F.concat_ws(",", "d.unreadable").alias("unreadable_fields"),
        subset_json(F.col("before"), F.col("d.changed")).alias("before_values"), subset_json(F.col("after"), F.col("d.changed")).alias("after_values"),
    ).dropDuplicates(["pipeline", "source_table", "row_key", "source_lsn"])


def with_before(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Before images rebuilt from the change before of the same key."""
    return events.withColumn("before", F.lag("after").over(Window.partitionBy(*key).orderBy(order)))
