"""Row shapes of the engine and the registry of replicated tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

TEXT_MAP = T.MapType(T.StringType(), T.StringType(), True)
#: One row change: images are text maps, lsn orders changes, source_ts_ms is 0 where unknown.
CHANGE_EVENT = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("op", T.StringType()), T.StructField("before", TEXT_MAP),
    T.StructField("after", TEXT_MAP), T.StructField("lsn", T.LongType()), T.StructField("source_ts_ms", T.LongType()),
])
#: A key-only change log.
OUTBOX = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("table_name", T.StringType()), T.StructField("row_id", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("changed_at", T.TimestampType()),
])
DEAD_LETTER = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("pipeline", T.StringType()), T.StructField("source_table", T.StringType()),
    T.StructField("op", T.StringType()), T.StructField("source_lsn", T.LongType()), T.StructField("payload", T.StringType()),
    T.StructField("failure_type", T.StringType()), T.StructField("failure_sql_state", T.StringType()), T.StructField("failure_message", T.StringType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("first_failed_at", T.TimestampType()), T.StructField("last_failed_at", T.TimestampType()),
])
CHANGE_AUDIT = T.StructType([
    T.StructField("pipeline", T.StringType()), T.StructField("source_table", T.StringType()), T.StructField("row_key", T.StringType()),
    T.StructField("source_lsn", T.LongType()), T.StructField("source_ts", T.TimestampType()), T.StructField("identifiable", T.BooleanType()),
    T.StructField("changed_fields", T.StringType()), T.StructField("unreadable_fields", T.StringType()),
    T.StructField("before_values", T.StringType()), T.StructField("after_values", T.StringType()),
])
FIELD_DIFF = T.StructType([
    T.StructField("identifiable", T.BooleanType()), T.StructField("changed", T.ArrayType(T.StringType())), T.StructField("unreadable", T.ArrayType(T.StringType())),
])
METRIC = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("labels", TEXT_MAP), T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()),
])

UPSERTS = ("r", "c", "u")
OPS = ("r", "c", "u", "d")


@dataclass(frozen=True)
class TableSpec:
    """How changes of one source table become rows of its target.

    fields: target column -> (source columns it needs, SQL type each is parsed as, expression over the
    parsed columns). guarded tables compare log positions and delete softly; others take the last arrival
    and delete rows.
    """

    name: str
    source: dict[str, str]
    fields: dict[str, str]
    key: str = "id"
    guarded: bool = True
    transform: Callable | None = field(default=None, compare=False)


#: Won per dollar that target prices are given in.
RATE = 1350

SPECS = {
    s.name: s
    for s in (
        TableSpec("car", {"id": "bigint", "name": "string", "brand": "string", "price": "decimal(12,2)", "created_at": "timestamp", "updated_at": "timestamp"},
                  {"id": "id", "name": "name", "brand": "brand", "price": "price", "created_at": "created_at", "updated_at": "updated_at"}, guarded=False),
        TableSpec("computer", {"id": "bigint", "brand": "string", "model": "string", "cpu": "string", "ram_gb": "int", "price_usd": "decimal(10,2)"},
                  {"id": "id", "full_name": "concat(brand, ' ', model)", "spec": "concat(cpu, ' / ', ram_gb, 'GB')", "price_krw": f"cast(round(price_usd * {RATE}, 0) as decimal(14,0))"}),
        TableSpec("grade", {"id": "bigint", "code": "string", "name": "string", "discount_rate": "decimal(5,2)", "created_at": "timestamp"},
                  {"id": "id", "code": "code", "name": "name", "discount_rate": "discount_rate", "created_at": "created_at"}),
        TableSpec("member", {"id": "bigint", "email": "string", "name": "string", "grade_id": "bigint", "point": "int", "created_at": "timestamp", "updated_at": "timestamp"},
                  {"id": "id", "email": "email", "name": "name", "grade_id": "grade_id", "point": "point", "created_at": "created_at", "updated_at": "updated_at"}),
    )
}


def registry(*specs: TableSpec) -> dict[str, TableSpec]:
    """Specs by name; two for one name are an error."""
    out: dict[str, TableSpec] = {}
    for s in specs:
        if s.name in out:
            raise ValueError(f"two handlers for table {s.name}")
        out[s.name] = s
    return out
