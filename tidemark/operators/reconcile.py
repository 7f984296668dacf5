"""Comparing source and target: counts, checksums, orphans, missing and duplicate keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import md5

#: Bytes of text that one task puts in order and hashes for a checksum.
MOST = 1 << 26


def live(df: DataFrame) -> DataFrame:
    """Rows that are not softly deleted, where the table has that flag."""
    return df.filter(~F.col("deleted")) if "deleted" in df.columns else df


def row_counts(tables: dict[str, DataFrame], prefix_skip: str = "cdc_") -> DataFrame:
    """(table_name, n) of live rows, own tables left out."""
    parts = [live(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t, df in sorted(tables.items()) if not t.startswith(prefix_skip)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def ordered_checksum(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """md5 over the rows' texts in key order ('' for none): one string, so for tables of moderate size; see ``chained_checksum``."""
    lines = F.expr(f"listagg(line, ',') within group (order by {key})")
    return df.select(key, row_text(columns).alias("line")).agg(F.count(F.lit(1)).alias("n"), F.md5(F.coalesce(lines, F.lit(""))).alias("checksum"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a range in order, a batch of them as one piece."""
    place, n = TaskContext.get().partitionId(), 0
    for b in batches:
        if b.num_rows:
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("line")), ",").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([n], pa.int32()), text], ["place", "piece", "text"])
            n += 1


def chained_checksum(df: DataFrame, columns: list[str], key: str, folder: str, most: int = MOST) -> DataFrame:
    """What ``ordered_checksum`` tells, for a table of any size.

    Its string is cut into ranges of keys of about ``most`` bytes, which are put in order side by side and written to
    ``folder``; then one short task a range takes the md5 up where the range before has put it down, so no task
    holds or reads more than a range, and the driver only the 92 bytes between two. Lines of one key go by their text.
    """
    lines = df.select(F.col(key).alias("key"), row_text(columns).alias("line"))
    n, size = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0))).first()
    if size <= most:
        return ordered_checksum(df, columns, key)
    ranges, path = -(-size // most), f"{folder}/{uuid.uuid4().hex}"
    sorted_lines = lines.repartitionByRange(ranges, "key", "line").sortWithinPartitions("key", "line").select("line")
    sorted_lines.mapInArrow(_pieces, "place int, piece int, text binary").write.partitionBy("place").parquet(path)
    pieces = df.sparkSession.read.schema("piece int, text binary, place int").parquet(path)
    state = None
    for place in range(ranges):

        def taken_up(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for text in b.column("text"):
                    state = md5.START if state is None else md5.update(state, b",")
                    state = md5.update(state, text.as_py())
            if state is not None:
                yield pa.RecordBatch.from_arrays([pa.array([state], pa.binary())], ["state"])

        own = pieces.filter(F.col("place") == place).coalesce(1).sortWithinPartitions("piece")
        told = own.select("text").mapInArrow(taken_up, "state binary").first()
        state = state if told is None else bytes(told["state"])
    return df.sparkSession.createDataFrame([(n, md5.hexdigest(state))], "n long, checksum string")


def bucket_checksums(df: DataFrame, columns: list[str], key: str, buckets: int = 64) -> DataFrame:
    """Order-free checksums of key buckets: sums of row hashes, aggregated map-side at any size."""
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("bigint") % buckets
    line = F.conv(F.substring(F.md5(row_text(columns)), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.select(part.alias("bucket"), line.alias("h")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("checksum"))


def both_sides(pairs: dict[str, tuple[DataFrame, DataFrame, list[str]]], folder: str, most: int = MOST) -> DataFrame:
    """(table_name, source_rows, target_rows, verdict) of tables on both sides: rows, values, or equal.

    Columns are named by each table, its key first. Counts decide before checksums, which are joined by table. ``folder`` and ``most`` are those of ``chained_checksum``.
    """
    def sums(side: int) -> DataFrame:
        out = None
        for name, pair in sorted(pairs.items()):
            one = chained_checksum(live(pair[side]), pair[2], pair[2][0], folder, most).withColumn("table_name", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out

    a = sums(0).select("table_name", F.col("n").alias("source_rows"), F.col("checksum").alias("_s"))
    b = sums(1).select("table_name", F.col("n").alias("target_rows"), F.col("checksum").alias("_t"))
    verdict = F.when(F.col("source_rows") != F.col("target_rows"), "rows").when(F.col("_s") != F.col("_t"), "values").otherwise("equal")
    return a.join(b, "table_name").select("table_name", "source_rows", "target_rows", verdict.alias("verdict"))


def totals(df: DataFrame, when: str, amount: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("latest"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount"))


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Children that name a parent that is not there; softly deleted rows count on both sides."""
    p = parent.select(F.col(key).alias("_p")).distinct()
    c = child.filter(F.col(fk).isNotNull())
    return c.join(p, c[fk] == p["_p"], "left_anti")


def foreign_keys(columns: DataFrame) -> DataFrame:
    """(child, fk, parent) found by name: a column <parent>_id beside a table <parent> that has an id."""
    parents = columns.filter("column_name = 'id'").select(F.col("table_name").alias("parent"))
    return columns.join(parents, F.col("column_name") == F.concat("parent", F.lit("_id"))).select(F.col("table_name").alias("child"), F.col("column_name").alias("fk"), "parent")


def guard_matrix(columns: DataFrame, names: tuple[str, ...] = ("source_lsn", "deleted", "synced_at")) -> DataFrame:
    """Which tables have certain columns: a position, a deletion flag and a time of synchronisation."""
    def has(name: str) -> Column:
        return F.max(F.when(F.col("column_name") == name, 1).otherwise(0)).alias(f"has_{name}")

    return columns.groupBy("table_name").agg(*[has(n) for n in names])


def drift(source: DataFrame, target: DataFrame, pending: DataFrame) -> DataFrame:
    """|source - target| - pending letters by table: not 0 means an unexplained difference."""
    s = source.select("table_name", F.col("n").alias("s"))
    t = target.select("table_name", F.col("n").alias("t"))
    p = pending.select("table_name", F.col("n").alias("p"))
    out = s.join(t, "table_name").join(p, "table_name", "left")
    return out.select("table_name", (F.abs(F.col("s") - F.col("t")) - F.coalesce("p", F.lit(0))).alias("drift"))


def key_reconcile(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, state) of keys that differ: missing, extra or changed."""
    s = source.select(F.col(key).alias("s"), F.md5(row_text(columns)).alias("hs"))
    t = live(target).select(F.col(key).alias("t"), F.md5(row_text(columns)).alias("ht"))
    both = s.join(t, F.col("s") == F.col("t"), "full_outer")
    state = F.when(F.col("t").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("hs") != F.col("ht"), "changed")
    return both.select(F.coalesce("s", "t").alias(key), state.alias("state")).filter("state is not null")
