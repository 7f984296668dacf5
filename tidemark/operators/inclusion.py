"""Foreign keys found from values: which column's values all stand in a key of another table.

Every value is listed with the columns that hold it, and columns are included in those that stand with all of
their values. Values with the same set of columns are counted together before pairs are made, so pairs follow the
number of such sets, not of values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE = ("tinyint", "smallint", "int", "bigint")


def listed(tables: dict[str, DataFrame]) -> DataFrame:
    """(column, value, rows) of all whole-number columns, once for each different value; nulls are no values."""
    out = None
    for name, df in sorted(tables.items()):
        own = [c for c, kind in df.dtypes if kind in WHOLE]
        if own:  # one scan a table
            pairs = F.explode(F.array(*[F.struct(F.lit(f"{name}.{c}").alias("column"), F.col(c).cast("bigint").alias("value")) for c in own]))
            one = df.select(pairs.alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
            out = one if out is None else out.unionByName(one)
    return out


def inclusions(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, share): each pair of columns of which the parent is unique in its table and holds all of the child's values.

    share: how much of the parent's values the child has.
    """
    values = listed(tables)
    columns = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most"))
    sets = values.groupBy("value").agg(F.sort_array(F.collect_set("column")).alias("held")).groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select("n", F.explode("held").alias("child"), "held").select("n", "child", F.explode("held").alias("parent")).filter("child <> parent")
    pairs = pairs.groupBy("child", "parent").agg(F.sum("n").alias("both"))
    child = columns.select(F.col("column").alias("child"), F.col("n").alias("own"))
    parent = columns.filter("most = 1").select(F.col("column").alias("parent"), F.col("n").alias("all"))
    found = pairs.join(child, "child").join(parent, "parent").filter("both = own")
    return found.select("child", "parent", (F.col("both") / F.col("all")).alias("share"))


def foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, share) of inclusions between tables whose column names agree after their prefix."""
    def name(c: str):
        return F.substring_index(F.col(c), "_", -1)

    return inclusions(tables).filter((name("child") == name("parent")) & (F.substring_index("child", ".", 1) != F.substring_index("parent", ".", 1)))
