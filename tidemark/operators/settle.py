"""Positions that become visible out of order: how far a reader may go without leaving any behind.

A number is taken before its transaction commits, so a lower one may become visible in a later batch. A reader
that goes on from the highest number seen never comes back for it. The settling mark after a batch is the highest
position below which nothing is missing; positions over it are held back. A position is then read in the
first batch by which it and all lower ones are visible: a running maximum of batches over positions, so each
is read once and none is passed over.

A number whose transaction failed never becomes visible. With a ``horizon`` the reader waits for a hole as
many batches after the first one that shows a higher position, then takes it for void; what becomes visible later
yet is ``late`` and is read in its own batch, told as such.

Running maxima over positions are sums over spans of ``SPAN`` positions and spans of spans, carried in, so no task
sorts more than that many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Positions that are sorted together.
SPAN = 1 << 16


def over_others(rows: DataFrame, position: str, name: str, value: Column, span: int = SPAN, after: bool = False) -> DataFrame:
    """rows with the greatest value of those at lower positions (with after: the least of those at higher ones); null if there is none.

    Positions are distinct whole numbers.
    """
    best = F.min if after else F.max
    rows = rows.withColumn("_v", value).withColumn("_span", F.floor(F.col(position) / span)).withColumn("_block", F.floor(F.col("_span") / span))

    def beside(by: list[str], order: str):
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        return w.orderBy(F.col(order).desc() if after else F.col(order)).rowsBetween(Window.unboundedPreceding, -1)

    pick = F.least if after else F.greatest
    spans = rows.groupBy("_block", "_span").agg(best("_v").alias("_s"))
    blocks = spans.groupBy("_block").agg(best("_s").alias("_b"))  # one row for span * span positions
    blocks = blocks.select("_block", best("_b").over(beside([], "_block")).alias("_b"))
    spans = spans.withColumn("_s", best("_s").over(beside(["_block"], "_span"))).join(blocks, "_block")
    spans = spans.select("_span", pick("_s", "_b").alias("_s"))
    out = rows.withColumn("_v", best("_v").over(beside(["_span"], position))).join(spans, "_span")
    return out.withColumn(name, pick("_v", "_s")).drop("_v", "_s", "_span", "_block")


def read_in(seen: DataFrame, first: int = 1, horizon: int | None = None, span: int = SPAN) -> DataFrame:
    """(position, batch, read_in, late): in which batch each visible position is read; null where a hole below still holds it.

    seen: (position, batch); a position seen more than once counts where it is seen first. Those below first are
    not read.
    """
    rows = seen.filter(F.col("position") >= first).groupBy("position").agg(F.min("batch").alias("batch"))
    rows = over_others(rows, "position", "last", F.col("position"), span)
    hole = F.col("position") > F.coalesce("last", F.lit(first - 1)) + 1
    never = F.lit((1 << 63) - 1)
    if horizon is None:
        rows = rows.withColumn("own", F.col("batch")).withColumn("below", F.when(hole, never))
    else:
        rows = over_others(rows, "position", "higher", F.col("batch"), span, after=True)
        rows = rows.withColumn("own", F.least("batch", F.col("higher") + horizon))
        rows = rows.withColumn("below", F.when(hole, F.least("batch", "higher") + horizon))
    rows = over_others(rows, "position", "before", F.greatest("own", "below"), span)
    when = F.greatest("own", "below", "before")
    late = F.col("own") < F.col("batch")
    return rows.select("position", "batch", F.when(late, F.col("batch")).when(when < never, when).alias("read_in"), late.alias("late"))


def marks(seen: DataFrame, first: int = 1, horizon: int | None = None, span: int = SPAN) -> DataFrame:
    """(batch, mark, held, holes): after each batch, the settling mark and what lies between it and the highest position seen.

    ``held`` positions there are visible and wait, ``holes`` are not visible.
    """
    rows = read_in(seen, first, horizon, span)
    none = F.lit(None).cast("bigint")
    went = rows.filter("read_in is not null").groupBy(F.col("read_in").alias("batch")).agg(F.max(F.when(~F.col("late"), F.col("position"))).alias("mark"), (-F.count(F.lit(1))).alias("n"), none.alias("top"))
    came = rows.groupBy("batch").agg(none.alias("mark"), F.count(F.lit(1)).alias("n"), F.max("position").alias("top"))
    # one row a batch from here on
    each = went.unionByName(came).groupBy("batch").agg(F.max("mark").alias("mark"), F.sum("n").alias("n"), F.max("top").alias("top"))
    so_far = Window.partitionBy(F.lit(1)).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    out = each.select("batch", F.coalesce(F.max("mark").over(so_far), F.lit(first - 1)).alias("mark"), F.max("top").over(so_far).alias("top"), F.sum("n").over(so_far).alias("held"))
    return out.select("batch", "mark", "held", (F.greatest(F.col("top"), F.col("mark")) - F.col("mark") - F.col("held")).alias("holes"))


def advance(holes: DataFrame, top: int, fresh: DataFrame) -> tuple[DataFrame, int]:
    """The interval set of open holes (lo, hi) and the highest position, after a batch of positions.

    What lies between the old top and the new one is a hole first; then each hole is cut at the positions that came
    in it. Positions in no hole have been seen before and change nothing. Holes are few, one for each run of
    transactions in flight, and a batch is as large as its reader lets it be: they are sorted together.
    """
    came = fresh.select(F.col("position").cast("bigint").alias("at")).distinct()
    newest = came.agg(F.max("at")).first()[0]
    if newest is None:
        return holes, top
    if newest > top:
        holes = holes.unionByName(holes.sparkSession.range(1).select(F.lit(top + 1).cast("bigint").alias("lo"), F.lit(newest).cast("bigint").alias("hi")))
    ends = holes.select((F.col("hi") + 1).alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("opens"))
    starts = holes.select((F.col("lo") - 1).alias("at"), F.lit(2).alias("kind"), F.lit(1).alias("opens"))
    every = ends.unionByName(starts).unionByName(came.select("at", F.lit(1).alias("kind"), F.lit(0).alias("opens")))
    order = Window.partitionBy(F.lit(1)).orderBy("at", "kind")
    every = every.withColumn("inside", F.sum("opens").over(order)).withColumn("next", F.lead("at").over(order))
    cut = every.filter("inside > 0 and at + 1 <= next - 1").select((F.col("at") + 1).alias("lo"), (F.col("next") - 1).alias("hi"))
    return cut, max(top, newest)


def mark_of(holes: DataFrame, top: int) -> int:
    """The position below which nothing is missing."""
    least = holes.agg(F.min("lo")).first()[0]
    return top if least is None else least - 1
