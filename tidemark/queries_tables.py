"""Queries that compare tables by trees of digests, find keys from values and read the catalog of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import digests, inclusion, reconcile
from tidemark.query_base import query, t, written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# --- trees of digests --------------------------------------------------------------------------------

#: A target that differs in two places: rows missing in one, changed in another.
PLACES_SQL = "p as (select max(o_orderkey) as top from orders), s as (select o.*, o_orderkey between top // 3 and top // 3 + 40 and o_orderkey % 3 = 0 as missing, o_orderkey between top // 2 and top // 2 + 9 as changed from orders o, p)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    top = o.agg(F.max("o_orderkey").alias("top"))
    x = o.join(F.broadcast(top))  # one row
    third, half = F.floor(F.col("top") / 3), F.floor(F.col("top") / 2)
    gone = F.col("o_orderkey").between(third, third + 40) & (F.col("o_orderkey") % 3 == 0)
    changed = F.when(F.col("o_orderkey").between(half, half + 9), F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    return o, x.filter(~gone).withColumn("o_custkey", changed).drop("top")


@query(f"with {PLACES_SQL} select o_orderkey, case when missing then 'missing' else 'changed' end as state from s where missing or changed")
def tree_reconcile(spark, d):
    """Keys that differ, found by going down a tree of digests."""
    return digests.tree_reconcile(*_sides(spark, d), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"], written(spark), leaf=32, fan=8)[0]


@query(f"with {PLACES_SQL}, l as (select o_orderkey // 32 as leaf, count(*) as n, bool_or(missing or changed) as unlike from s group by 1) select count(*) filter (where unlike) as leaves, coalesce(sum(n) filter (where unlike), 0)::bigint as source_rows from l")
def tree_reconcile_effort(spark, d):
    """Leaves that differ and the rows compared for them."""
    found = digests.tree_reconcile(*_sides(spark, d), "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"], written(spark), leaf=32, fan=8)[1]
    return spark.createDataFrame([(found["leaves"], found["source_rows"])], "leaves long, source_rows long")


# --- keys from values --------------------------------------------------------------------------------

KEYED = "region nation customer supplier part orders lineitem events".split()
#: Whole-number columns of these tables.
WHOLE_SQL = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "events": ["event_id", "user_id"]}
INCLUDED_SQL = "with v as (" + " union all ".join(f"select '{n}.{c}' as c, {c} as x, count(*) as rows from {n} where {c} is not null group by {c}" for n, cs in WHOLE_SQL.items() for c in cs) + """),
n as (select c, count(*) as n, max(rows) as most from v group by c), i as (select a.c as child, b.c as parent, count(*) as shared from v a join v b on a.x = b.x and a.c <> b.c group by all),
f as (select child, parent, shared / b.n as share from i join n a on a.c = child join n b on b.c = parent where shared = a.n and b.most = 1)"""


@query(INCLUDED_SQL + " select child, parent, round(share, 9) as share from f")
def value_inclusions(spark, d):
    """Columns whose values all stand in a key, by values alone."""
    return inclusion.inclusions({n: t(spark, d, n) for n in KEYED}).withColumn("share", F.round("share", 9))


@query(INCLUDED_SQL + " select child, parent, round(share, 9) as share from f where split_part(child, '_', -1) = split_part(parent, '_', -1) and split_part(child, '.', 1) <> split_part(parent, '.', 1)")
def foreign_key_discovery(spark, d):
    return inclusion.foreign_keys({n: t(spark, d, n) for n in KEYED}).withColumn("share", F.round("share", 9))


# --- the catalog of the given tables -----------------------------------------------------------------

COLUMNS_SQL = "with cols as (select table_name, column_name from information_schema.columns where table_name in (" + ", ".join(f"'{n}'" for n in TABLES) + "))"


def columns(spark, d) -> DataFrame:
    """(table_name, column_name) of the given tables, from their schemas."""
    return spark.createDataFrame([(n, c) for n in TABLES for c in t(spark, d, n).columns], "table_name string, column_name string")


@query(COLUMNS_SQL + " select table_name, max((column_name = 'ts')::int) as has_ts, max((column_name = 'text')::int) as has_text, max((column_name = 'label')::int) as has_label from cols group by table_name")
def guard_matrix(spark, d):
    """Which tables have a time, a text and a label."""
    return reconcile.guard_matrix(columns(spark, d), ("ts", "text", "label"))


@query(COLUMNS_SQL + " select t.table_name, c.column_name is not null as written from (select distinct table_name from cols) t left join cols c on c.table_name = t.table_name and c.column_name = 'text'")
def catalog_left_join(spark, d):
    c = columns(spark, d)
    flag = c.filter("column_name = 'text'").select("table_name", F.lit(True).alias("written"))
    return c.select("table_name").distinct().join(flag, "table_name", "left").select("table_name", F.coalesce("written", F.lit(False)).alias("written"))


@query(COLUMNS_SQL + " select table_name, count(*) as n from cols where table_name in (select table_name from cols where column_name = 'text') group by table_name")
def catalog_semi_join(spark, d):
    c = columns(spark, d)
    return c.join(c.filter("column_name = 'text'").select("table_name"), "table_name", "left_semi").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


@query(" union all ".join(f"select '{n}' as table_name, count(*) as n from {n}" for n in TABLES))
def catalog_row_counts(spark, d):
    """Rows of every table that the catalog lists, each read once."""
    return reconcile.row_counts({n: t(spark, d, n) for n in TABLES})
