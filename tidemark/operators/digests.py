"""A tree of digests over key ranges: two sides are compared from the top, and only where they differ further down.

A leaf is a range of ``leaf`` keys and holds the number of its rows and the sum of their hashes; a node over
``fan`` leaves or nodes holds the sums of theirs. Leaves are summed map-side, one row a range and task, and
written; every level above is a sum of that small table. Going down, a node is looked at if its parent differs, and
rows are read and compared for leaves that differ alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reconcile import key_reconcile, live, row_text

LEAF, FAN = 1024, 64
#: Differing leaves whose numbers are broadcast at most (eight bytes each); more are joined.
MOST = 1 << 20


def leaves(df: DataFrame, key: str, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """(node, n, digest) of each key range that has rows. Keys are whole numbers."""
    hashed = F.conv(F.substring(F.md5(row_text(columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    return live(df).select(F.floor(F.col(key) / leaf).alias("node"), hashed.alias("h")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("digest"))


def _level(nodes: DataFrame, width: int) -> DataFrame:
    return nodes.groupBy(F.floor(F.col("node") / width).alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that are not the same on both sides."""
    x, y = (s.select("node", F.col("n").alias(f"n_{i}"), F.col("digest").alias(f"d_{i}")) for i, s in enumerate((a, b)))
    both = x.join(y, "node", "full_outer")
    return both.filter(~(F.col("n_0").eqNullSafe(F.col("n_1")) & F.col("d_0").eqNullSafe(F.col("d_1")))).select("node")


def differing_leaves(a: DataFrame, b: DataFrame, written, fan: int = FAN) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Leaves that differ between two tables of leaves, and (width in leaves, nodes looked at) of each level; what differs is written level by level."""
    ends = a.select("node").unionByName(b.select("node")).agg(F.min("node"), F.max("node")).first()
    width = 1
    while ends[0] is not None and ends[1] // width - ends[0] // width >= fan:  # the top level has up to fan nodes
        width *= fan
    found, seen = None, []
    while True:
        x, y = (_level(s, width) if width > 1 else s for s in (a, b))
        if found is not None:
            parents = found.withColumnRenamed("node", "parent")
            x, y = (s.join(parents, F.floor(F.col("node") / fan) == F.col("parent"), "left_semi") for s in (x, y))
        seen.append((width, x.select("node").unionByName(y.select("node")).distinct().count()))
        found = written(_unlike(x, y))
        if width == 1:
            return found, seen
        width //= fan


def tree_reconcile(source: DataFrame, target: DataFrame, key: str, columns: list[str], written, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, dict]:
    """(key, state) of keys that differ, as ``key_reconcile`` tells, and how much was compared.

    written: makes a table of a DataFrame (a path of its own each time) and reads it back.
    """
    a, b = (written(leaves(s, key, columns, leaf)) for s in (source, target))
    found, seen = differing_leaves(a, b, written, fan)
    count = found.count()
    few = F.broadcast(found) if count <= MOST else found
    rows = [s.join(few, F.floor(F.col(key) / leaf) == F.col("node"), "left_semi") for s in (source, target)]
    held = a.join(found, "node", "left_semi").agg(F.sum("n")).first()[0] or 0
    return key_reconcile(*rows, key, columns), {"levels": seen, "leaves": count, "source_rows": held}
