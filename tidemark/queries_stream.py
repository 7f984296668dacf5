"""Queries of the guard as a segmented scan, of positions out of order, and of streams over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import merge, settle
from tidemark.query_base import log, query, shared_folder, t
from tidemark.sources.positions import PositionSource
from tidemark.streaming import state
from tidemark.streaming.twophase import TwoPhaseTable, committed

# --- the guard with a hot key ------------------------------------------------------------------------

HOT_SQL = """, ev as (select case when seq % 3 = 0 then 0 else row_id end as row_id, (seq * 7919) % 104729 as arrival, op, seq as lsn, amount from log),
a as (select *, sum(case when op <> 'd' then 1 else 0 end) over (partition by row_id order by arrival, lsn rows unbounded preceding) as ups from ev),
b as (select *, max(lsn) over (partition by row_id order by arrival, lsn rows between unbounded preceding and 1 preceding) as top from a where ups > 0),
k as (select * from b where top is null or lsn > top)"""


def _hot(spark, d) -> DataFrame:
    key = F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("row_id"))
    return log(spark, d).select(key.alias("row_id"), (F.col("seq") * 7919 % 104729).alias("arrival"), "op", F.col("seq").alias("lsn"), "amount")


@query(HOT_SQL + " select row_id, max_by(amount, lsn) filter (where op <> 'd') as amount, max_by(op, lsn) = 'd' as deleted, max(lsn) as source_lsn from k group by row_id", decimals="amount")
def guarded_hot_key(spark, d):
    """A third of all changes are of one key; it is gone through in segments of 1,000 arrivals."""
    return merge.guarded(_hot(spark, d), "row_id", ["amount"], span=1000)


@query(HOT_SQL + " select row_id, arrival, op, lsn from k")
def guard_accepted_hot_key(spark, d):
    return merge.applied(_hot(spark, d), "row_id", span=1000)


# --- positions out of order --------------------------------------------------------------------------

SEEN_SQL = ", seen as (select seq as position, (seq + seq * 7919 % 397) // 250 as batch from log where seq % 1009 <> 5), last as (select max(batch) as batch from seen)"


def seen(spark, d) -> DataFrame:
    """Positions of the log, each visible up to 397 positions late; one in 1,009 never is."""
    return log(spark, d).select(F.col("seq").alias("position"), F.floor((F.col("seq") + F.col("seq") * 7919 % 397) / 250).alias("batch")).filter("position % 1009 <> 5")


@query(SEEN_SQL + """, ok as (select * from seen where position < 1014 or position % 1009 <> 5), b as (select distinct batch from seen),
v as (select b.batch, s.position from b join seen s on s.batch <= b.batch), i as (select batch, position, position - row_number() over (partition by batch order by position) as island from v),
m as (select batch, coalesce(max(position) filter (where island = 0), 0) as mark, max(position) as top, count(*) as n, count(*) filter (where island = 0) as read from i group by batch)
select batch, mark, n - read as held, top - mark - (n - read) as holes from m""")
def settling_marks(spark, d):
    """How far a reader may go after each batch; the first number that never comes holds it for good."""
    return settle.marks(seen(spark, d), span=1000)


@query(SEEN_SQL + """, gaps as (select position, min(batch) over (order by position desc rows between unbounded preceding and 1 preceding) as higher, lag(position) over (order by position) as before, batch from seen),
o as (select position, batch, least(batch, coalesce(higher + 3, batch)) as own, case when position > coalesce(before, 0) + 1 then least(batch, coalesce(higher, batch)) + 3 end as below from gaps),
r as (select position, batch, max(greatest(own, coalesce(below, own))) over (order by position) as w, own < batch as late from o)
select position, batch, case when late then batch else w end as read_in, late from r""")
def settled_reads(spark, d):
    """In which batch each position is read if holes are given up three batches after they show: once each, none is lost."""
    return settle.read_in(seen(spark, d), horizon=3, span=1000)


@query(SEEN_SQL + """, gaps as (select position, min(batch) over (order by position desc rows between unbounded preceding and 1 preceding) as higher, lag(position) over (order by position) as before, batch from seen),
o as (select position, batch, least(batch, coalesce(higher + 3, batch)) as own, case when position > coalesce(before, 0) + 1 then least(batch, coalesce(higher, batch)) + 3 end as below from gaps),
r as (select position, batch, case when own < batch then batch else max(greatest(own, coalesce(below, own))) over (order by position) end as read_in, own < batch as late from o),
b as (select batch from r union select read_in from r)
select b.batch, coalesce(max(position) filter (where not late and read_in <= b.batch), 0) as mark, count(*) filter (where r.batch <= b.batch and read_in > b.batch) as held,
  greatest(max(position) filter (where r.batch <= b.batch), coalesce(max(position) filter (where not late and read_in <= b.batch), 0)) - coalesce(max(position) filter (where not late and read_in <= b.batch), 0) - count(*) filter (where r.batch <= b.batch and read_in > b.batch) as holes
from b cross join r group by b.batch""")
def settling_marks_given_up(spark, d):
    return settle.marks(seen(spark, d), horizon=3, span=1000)


# --- streams over the event table --------------------------------------------------------------------

REPLAYED_SQL = """, ev as (select row_id, (seq * 7919) % 104729 + pass * 104729 as arrival, op, seq as lsn, amount from log, range(2) p(pass)
  union all select c_custkey, -1, 'c', c_custkey * 13, cast(c_acctbal as decimal(12,2)) from customer where c_custkey % 3 = 0),
a as (select *, sum(case when op <> 'd' then 1 else 0 end) over (partition by row_id order by arrival, lsn rows unbounded preceding) as ups from ev),
b as (select *, max(lsn) over (partition by row_id order by arrival, lsn rows between unbounded preceding and 1 preceding) as top from a where ups > 0),
k as (select * from b where top is null or lsn > top)"""


def _run(stream: DataFrame, root: str, query: str, position: str) -> None:
    """Everything that the source has for now, batch by batch, into a two-phase table; state in eight partitions."""
    conf, many = stream.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(many)
    conf.set(many, "8")
    try:
        q = stream.writeStream.format("tidemark_table").options(path=f"{root}/table", query=query, position=position).option("checkpointLocation", f"{root}/progress").outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    finally:
        conf.set(many, before)


@query(REPLAYED_SQL + " select row_id, max_by(amount, lsn) filter (where op <> 'd') as amount, max_by(op, lsn) = 'd' as deleted, max(lsn) as source_lsn from k where row_id in (select row_id from k where arrival >= 0) group by row_id", decimals="amount")
def guarded_stream(spark, d):
    """The guard as state of a stream: the log by ranges of arrival, stored rows as initial state, two restarts, one of them from the start.

    The rows that the stream has changed, as the table holds them at the end. All changes come a second time; of those
    only deletes that found no row at first, and stand higher than all that did, pass the guard then.
    """
    spark.dataSource.register(PositionSource)
    spark.dataSource.register(TwoPhaseTable)
    state.with_rocksdb(spark)
    root = shared_folder(spark)
    ev = log(spark, d).select("row_id", (F.col("seq") * 7919 % 104729).alias("arrival"), "op", F.col("seq").alias("lsn"), "amount")
    ev.repartitionByRange("arrival").sortWithinPartitions("arrival").write.parquet(f"{root}/log")
    again = ev.withColumn("arrival", F.col("arrival") + 104729)
    again.write.mode("append").parquet(f"{root}/log")
    stored = t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("decimal(12,2)").alias("amount"), (F.col("c_custkey") * 13).alias("source_lsn"))
    for upto in (40_000, 104_728, 209_457):  # the query is stopped, and goes on
        source = spark.readStream.format("tidemark_positions").options(path=f"{root}/log", position="arrival", slot=f"{root}/slot.json", rows="70000", upto=str(upto)).load()
        _run(state.guarded_stream(source, "row_id", {"amount": "decimal(12,2)"}, stored), root, "guard", "arrival")
    rows = committed(spark, f"{root}/table", "row_id long, arrival long, amount decimal(12,2), deleted boolean, source_lsn long")
    last = rows.groupBy("row_id").agg(F.max_by(F.struct("amount", "deleted", "source_lsn"), "source_lsn").alias("r"))
    return last.select("row_id", "r.*")


@query(""", e as (select *, row_number() over (partition by table_name order by seq) as rn from log),
s as (select 1) select * from (with recursive b(table_name, batch, rn) as (select distinct table_name, 0::bigint, 1::bigint from e
  union all select b.table_name, b.batch + 1, min(n.rn) from b join e o on o.table_name = b.table_name and o.rn = b.rn join e n on n.table_name = b.table_name and n.rn > b.rn and (n.rn >= b.rn + 20 or epoch_us(n.changed_at) - epoch_us(o.changed_at) >= 21600000000) group by b.table_name, b.batch)
select b.table_name, b.batch, count(*) as n, min(e.seq) as lo, max(e.seq) as hi from b left join b c on c.table_name = b.table_name and c.batch = b.batch + 1 join e on e.table_name = b.table_name and e.rn >= b.rn and (c.rn is null or e.rn < c.rn) group by all)""")
def batches_by_count_or_age(spark, d):
    """Batches of each table: 20 events, or six hours after the first; the last ones are closed by their timers."""
    spark.dataSource.register(PositionSource)
    spark.dataSource.register(TwoPhaseTable)
    state.with_rocksdb(spark)
    root = shared_folder(spark)
    x = log(spark, d).select("table_name", F.col("seq").alias("position"), F.col("changed_at").cast("timestamp").alias("ts"))
    x.repartitionByRange("position").sortWithinPartitions("position").write.parquet(f"{root}/log")
    # a beat a day later moves the watermark past all that is open
    beat = x.agg((F.max("position") + 1).alias("position"), (F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts")).select(F.lit("beat").alias("table_name"), "position", "ts")
    beat.write.mode("append").parquet(f"{root}/log")
    source = spark.readStream.format("tidemark_positions").options(path=f"{root}/log", position="position", slot=f"{root}/slot.json", rows="40000", backlog="1280000").load()
    out = state.batches(source, "table_name", 20, 21600, "1 hour")
    _run(out, root, "batches", "hi")
    return committed(spark, f"{root}/table", "table_name string, batch long, n long, lo long, hi long")
