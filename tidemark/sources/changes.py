"""Where changes come from: event envelopes, key-only logs, snapshots and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import OPS

_BODY = "before: map<string,string>, after: map<string,string>, source: struct<`table`: string, lsn: bigint, ts_ms: bigint>, op: string"
ENVELOPE = f"struct<{_BODY}, payload: struct<{_BODY}>, _bad: string>"


def parse_envelopes(df: DataFrame, column: str = "value") -> DataFrame:
    """Change events of JSON envelopes, wrapped in a payload or bare, with a column ``broken``.

    Null and blank texts (tombstones) and other operations than r, c, u, d are dropped; text that is no
    JSON stays, as a broken row with its raw text, so that it can be quarantined.
    """
    raw = df.filter(F.col(column).isNotNull() & (F.trim(column) != "")).select(F.col(column).alias("raw"))
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    e = raw.withColumn("e", F.from_json("raw", ENVELOPE, options))

    def part(name: str) -> Column:
        return F.coalesce(F.col(f"e.payload.{name}"), F.col(f"e.{name}"))

    out = e.select(
        part("source.table").alias("table"), part("op").alias("op"), part("before").alias("before"), part("after").alias("after"),
        F.coalesce(part("source.lsn"), F.lit(0)).alias("lsn"), F.coalesce(part("source.ts_ms"), F.lit(0)).alias("source_ts_ms"),
        (F.col("e").isNull() | F.col("e._bad").isNotNull()).alias("broken"), "raw",
    )
    return out.filter(F.col("broken") | F.col("op").isin(*OPS))


def poll(log: DataFrame, after: int, most: int) -> DataFrame:
    """The next entries of a key-only log."""
    return log.filter(F.col("seq") > after).orderBy("seq").limit(most)


def snapshot(rows: DataFrame, table: str, key: str = "id", lsn: int = 0) -> DataFrame:
    """A full copy as change events of operation r."""
    image = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))])
    return rows.select(
        F.lit(table).alias("table"), F.lit("r").alias("op"), F.lit(None).cast("map<string,string>").alias("before"),
        image.alias("after"), F.lit(lsn).cast("bigint").alias("lsn"), F.lit(0).cast("bigint").alias("source_ts_ms"),
    )


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op) of what turned one state of a table into another: c, u or d."""
    rest = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("old_key"), F.struct(*rest).alias("old"))
    b = new.select(F.col(key).alias("new_key"), F.struct(*rest).alias("new"))
    both = a.join(b, F.col("old_key") == F.col("new_key"), "full_outer")
    op = F.when(F.col("old_key").isNull(), "c").when(F.col("new_key").isNull(), "d").when(~F.col("old").eqNullSafe(F.col("new")), "u")
    return both.select(F.coalesce("new_key", "old_key").alias(key), op.alias("op")).filter("op is not null")


def current_rows(source: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The present rows of changed keys; keys without a row are skipped. Catalyst broadcasts the keys if they are few."""
    return source.join(keys.select(key).distinct(), key, "left_semi")


def route(events: DataFrame, tables: list[str], column: str = "table") -> DataFrame:
    """Events with ``routed``: handled, internal (own cdc_ tables, skipped silently) or unknown (skipped)."""
    return events.withColumn("routed", F.when(F.col(column).isin(*tables), "handled").when(F.col(column).startswith("cdc_"), "internal").otherwise("unknown"))


def tables_with_prefix(spark, without: str = "cdc_") -> list[str]:
    """Catalog tables but those of the engine itself."""
    return sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith(without))


def snapshot_tables(tables: list[str], without: tuple[str, ...] = ("cdc_heartbeat",)) -> list[str]:
    """Tables to copy at the start: beats are not."""
    return [t for t in tables if t not in without]


#: Kinds of replication messages that only move the position.
SILENT = ("begin", "commit", "truncate", "relation", "keepalive")
DATA = {"insert": "c", "update": "u", "delete": "d", "snapshot_row": "r"}


def undecodable(messages: DataFrame) -> DataFrame:
    """Messages of no known kind, with their raw text, as rows that can be quarantined."""
    known = F.coalesce(F.col("kind").isin(*SILENT, *DATA), F.lit(False))
    raw = F.to_json(F.struct("kind", "table", "lsn"), {"ignoreNullFields": "false"})
    return messages.filter(~known).select("lsn", F.lit(True).alias("broken"), raw.alias("raw"))


def acknowledged(messages: DataFrame) -> DataFrame:
    """(position, data, silent, undecodable): how far the log may be released once a batch is committed.

    Messages without rows, and those that went to quarantine, move the position as well.
    """
    kind = F.col("kind")
    known = F.coalesce(kind.isin(*SILENT, *DATA), F.lit(False))
    return messages.agg(F.max("lsn").alias("position"), F.count_if(kind.isin(*DATA)).alias("data"), F.count_if(kind.isin(*SILENT)).alias("silent"), F.count_if(~known).alias("undecodable"))


def decode(messages: DataFrame) -> DataFrame:
    """Replication messages (kind, old, new, table, lsn, sent_ms) as change events.

    Inserts, updates, deletes and rows of a snapshot count (the last without a time); other kinds go.
    """
    op = F.create_map(*[F.lit(x) for pair in DATA.items() for x in pair])[F.col("kind")]
    out = messages.withColumn("op", op).filter("op is not null")
    return out.select(
        "table", "op", F.when(F.col("op").isin("u", "d"), F.col("old")).alias("before"), F.when(F.col("op") != "d", F.col("new")).alias("after"), "lsn",
        F.when(F.col("op") == "r", 0).otherwise(F.col("sent_ms")).cast("bigint").alias("source_ts_ms"),
    )
