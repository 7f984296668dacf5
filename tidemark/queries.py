"""Queries of the change-stream engine over the test tables, each with the SQL that gives the same rows.

The change log is that of ``query_base``. Series and alerts are in ``queries_series``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.clock import code_of, skew_seconds, skewed
from tidemark.functions.lsn import format_lsn, lsn_lag, parse_lsn
from tidemark.functions.strict import strict
from tidemark.functions.verdict import verdict
from tidemark.operators import chunks, diff, fold, guard, merge, quarantine, reconcile
from tidemark.operators import timeseries as S
from tidemark.operators.mapping import mapped, typed
from tidemark.query_base import LOG_SQL, NOW, SQL, Q, log, query, scratch, shared_folder, t, written
from tidemark.schemas import SPECS
from tidemark.sources import changes
from tidemark.streaming import metrics as stream_metrics
from tidemark.streaming import outbox

def changes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as change events with images of three text fields."""
    x = log(spark, sf_dir)
    image = F.create_map(F.lit("id"), F.col("row_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("amount"), F.col("amount").cast("string"))
    rows = x.select("seq", "row_id", F.col("table_name").alias("table"), "op", image.alias("after"), F.col("seq").alias("lsn"), F.unix_millis(F.col("changed_at").cast("timestamp")).alias("source_ts_ms"))
    return diff.with_before(rows, ["row_id"], "seq")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind and hour: events (a gauge), and their running sum a day (a counter that restarts)."""
    e = t(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("gauge"))
    day = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("counter", F.sum("gauge").over(day))


HOURLY_SQL = """h as (select event_type, date_trunc('hour', ts)::timestamp as ts, count(*)::double as gauge from events group by all),
h2 as (select *, sum(gauge) over (partition by event_type, date_trunc('day', ts) order by ts rows unbounded preceding) as counter from h)"""

#: Modules that register queries beside those of this one.
MODULES = ("queries_series", "queries_stream", "queries_tables")

# --- sources ---------------------------------------------------------------------------------------


@query("select seq, table_name, row_id, op from log where seq > 1000 order by seq limit 500")
def outbox_poll(spark, d):
    return changes.poll(log(spark, d), 1000, 500).select("seq", "table_name", "row_id", "op")


@query(""", snap as (select c_custkey as id, 'r' as op, 0 as lsn from customer), tail as (select row_id as id, op, seq as lsn from log where table_name = 'member')
select op, count(*) as n, count(distinct id) as ids, min(lsn)::bigint as lo, max(lsn)::bigint as hi from (select * from snap union all select * from tail) group by op""")
def initial_snapshot_then_stream(spark, d):
    snap = changes.snapshot(t(spark, d, "customer").withColumnRenamed("c_custkey", "id"), "member")
    snap = snap.select(F.element_at("after", "id").cast("bigint").alias("id"), "op", "lsn")
    tail = log(spark, d).filter("table_name = 'member'").select(F.col("row_id").alias("id"), "op", F.col("seq").alias("lsn"))
    return snap.unionByName(tail).groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("lsn").alias("lo"), F.max("lsn").alias("hi"))


@query("select distinct c_custkey, c_name, c_acctbal from customer where c_custkey in (select row_id from log where table_name = 'member' and seq <= 2000)")
def keyed_lookup(spark, d):
    keys = log(spark, d).filter("table_name = 'member' and seq <= 2000").select(F.col("row_id").alias("c_custkey"))
    return changes.current_rows(t(spark, d, "customer"), keys, "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("""with old as (select c_custkey, c_nationkey from customer where c_custkey % 7 <> 0), new as (select c_custkey, case when c_custkey % 5 = 0 then c_nationkey + 1 else c_nationkey end as c_nationkey from customer where c_custkey % 11 <> 0)
select coalesce(n.c_custkey, o.c_custkey) as c_custkey, case when o.c_custkey is null then 'c' when n.c_custkey is null then 'd' else 'u' end as op
from old o full join new n on o.c_custkey = n.c_custkey where o.c_custkey is null or n.c_custkey is null or o.c_nationkey is distinct from n.c_nationkey""")
def snapshot_difference(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_nationkey")
    old = c.filter("c_custkey % 7 <> 0")
    new = c.filter("c_custkey % 11 <> 0").withColumn("c_nationkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return changes.difference(old, new, "c_custkey")


@query("select op, table_name, lsn::bigint as lsn, id::bigint as id, kind from (select op, table_name, seq as lsn, row_id as id, event_type as kind from log where event_type <> 'view')")
def envelope_parse(spark, d):
    x = changes_of(spark, d)
    op = F.when(F.element_at("after", "kind") == "view", "t").otherwise(F.col("op"))
    body = F.struct(F.lit(None).cast("map<string,string>").alias("before"), "after", F.struct("table", "lsn", F.col("source_ts_ms").alias("ts_ms")).alias("source"), op.alias("op"))
    text = F.when(F.col("seq") % 2 == 0, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("payload"))))
    blank = spark.createDataFrame([("",), (None,), ("  ",)], "value string")
    e = changes.parse_envelopes(x.select(text.alias("value")).unionByName(blank)).filter("not broken")
    return e.select("op", F.col("table").alias("table_name"), "lsn", F.element_at("after", "id").cast("bigint").alias("id"), F.element_at("after", "kind").alias("kind"))


@query(", r as (select case when table_name in ('computer', 'member') then 'handled' when table_name = 'car' then 'internal' else 'unknown' end as routed, seq from log) select routed, count(*) as n, max(seq) as top from r group by routed")
def table_routing(spark, d):
    x = log(spark, d).withColumn("table", F.when(F.col("table_name") == "car", "cdc_heartbeat").otherwise(F.col("table_name")))
    return changes.route(x, ["computer", "member"]).groupBy("routed").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("top"))


@query("select table_name, count(*) as n from log where table_name in ('car', 'grade') group by table_name")
def include_list(spark, d):
    return log(spark, d).filter(F.col("table_name").isin("car", "grade")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


# --- folding ----------------------------------------------------------------------------------------


@query("select table_name, row_id, max_by(op, seq) as op, max(seq) as seq, max_by(op, seq) = 'd' as is_delete from log group by table_name, row_id")
def fold_latest(spark, d):
    return fold.fold(log(spark, d))


@query("select (seq - 1) // 500 as batch, count(*) as entries, count(distinct (table_name, row_id)) as folded, max(seq) as max_seq, round(count(*) / count(distinct (table_name, row_id)), 6) as ratio from log group by 1")
def fold_ratio(spark, d):
    return fold.batch_stats(log(spark, d), 500)


@query("select table_name, min(changed_at) as oldest from log group by table_name")
def oldest_change(spark, d):
    return fold.oldest_change(log(spark, d))


@query("select table_name, op, count(*) as n from log group by table_name, op")
def op_counters(spark, d):
    return log(spark, d).groupBy("table_name", "op").agg(F.count(F.lit(1)).alias("n"))


@query("select max(seq) as high_water, count(*) as n from log")
def high_water_mark(spark, d):
    return log(spark, d).agg(F.max("seq").alias("high_water"), F.count(F.lit(1)).alias("n"))


# --- mapping ----------------------------------------------------------------------------------------

PART_AS = {"id": "p_partkey", "brand": "p_brand", "model": "p_name", "cpu": "p_type", "ram_gb": "p_size"}


@query("""select p_partkey as id, p_brand || ' ' || p_name as full_name, p_type || ' / ' || p_size || 'GB' as spec, cast(round(cast(p_retailprice as decimal(10,2)) * 1350, 0) as decimal(14,0)) as price_krw from part""", decimals="price_krw")
def computer_mapping(spark, d):
    p = t(spark, d, "part").select(*[F.col(v).alias(k) for k, v in PART_AS.items()], F.col("p_retailprice").cast("decimal(10,2)").alias("price_usd"))
    return mapped(p, SPECS["computer"])


@query("select c_custkey as id, c_name || '@example.org' as email, c_name as name, c_nationkey::bigint as grade_id, c_acctbal::int as point, timestamp '2024-01-01 00:00:00' as created_at, timestamp '2024-01-01 00:00:00' as updated_at from (select c_custkey, c_name, c_nationkey, trunc(c_acctbal) as c_acctbal from customer)")
def member_mapping(spark, d):
    day = F.lit("2024-01-01T00:00:00Z")
    c = t(spark, d, "customer")
    image = F.create_map(F.lit("id"), F.col("c_custkey").cast("string"), F.lit("email"), F.concat("c_name", F.lit("@example.org")), F.lit("name"), F.col("c_name"), F.lit("grade_id"), F.col("c_nationkey").cast("string"), F.lit("point"), F.col("c_acctbal").cast("int").cast("string"), F.lit("created_at"), day, F.lit("updated_at"), day)
    e = c.select(F.lit("u").alias("op"), image.alias("after"), F.lit(None).cast("map<string,string>").alias("before"))
    rows = typed(e, SPECS["member"]).filter("fault is null")
    return rows.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.endswith("_at") else F.col(c) for c in SPECS["member"].fields])


@query("select n_nationkey::bigint as id, 'G' || n_nationkey as code, n_name as name, cast(n_regionkey * 1.25 as decimal(5,2)) as discount_rate from nation", decimals="discount_rate")
def grade_mapping(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("G"), "n_nationkey").alias("code"), F.col("n_name").alias("name"), (F.col("n_regionkey") * F.lit(1.25)).cast("decimal(5,2)").alias("discount_rate"), F.lit(None).cast("timestamp").alias("created_at"))
    return mapped(n, SPECS["grade"]).drop("created_at")


@query("select p_partkey as id, p_name as name, p_brand as brand, cast(p_retailprice as decimal(12,2)) as price from part", decimals="price")
def car_mapping(spark, d):
    p = t(spark, d, "part")
    image = F.create_map(F.lit("id"), F.col("p_partkey").cast("string"), F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("price"), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("created_at"), F.lit("2024-01-01T00:00:00Z"), F.lit("updated_at"), F.lit("2024-01-01T00:00:00Z"))
    e = p.select(F.lit("c").alias("op"), image.alias("after"), F.lit(None).cast("map<string,string>").alias("before"))
    return typed(e, SPECS["car"]).filter("fault is null").select("id", "name", "brand", "price")


@query("""select k, v, case when k % 5 in (0, 3) then p::varchar else 'none' end as number from (select event_id as k, event_id % 5 as m, case event_id % 5 when 0 then event_id::varchar when 1 then ' ' || event_id when 2 then event_id || 'x' when 3 then '-' || event_id else '' end as v,
  case event_id % 5 when 0 then event_id else -event_id end as p from events)""")
def strict_numbers(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("k"))
    v = F.col("k").cast("string")
    text = F.when(F.col("k") % 5 == 0, v).when(F.col("k") % 5 == 1, F.concat(F.lit(" "), v)).when(F.col("k") % 5 == 2, F.concat(v, F.lit("x"))).when(F.col("k") % 5 == 3, F.concat(F.lit("-"), v)).otherwise("")
    return e.select("k", text.alias("v")).withColumn("number", F.coalesce(strict(F.col("v"), "bigint").cast("string"), F.lit("none")))


# --- merging ----------------------------------------------------------------------------------------


@query("select row_id, max_by(amount, seq) as amount from log group by row_id having max_by(op, seq) <> 'd'", decimals="amount")
def hard_delete_state(spark, d):
    e = log(spark, d).select("row_id", F.col("seq").alias("arrival"), "op", "amount")
    return merge.last_arrival(None, e, "row_id", ["amount"])


@query(", x as (select *, row_number() over (partition by table_name, row_id order by seq desc) as n from log) select table_name, row_id, op = 'd' as deleted, seq as source_lsn from x where n = 1")
def soft_delete_state(spark, d):
    w = Window.partitionBy("table_name", "row_id").orderBy(F.col("seq").desc())
    x = log(spark, d).withColumn("n", F.row_number().over(w)).filter("n = 1")
    return x.select("table_name", "row_id", (F.col("op") == "d").alias("deleted"), F.col("seq").alias("source_lsn"))


@query("select row_id, max_by(amount, seq) filter (where op <> 'd') as amount, max_by(op, seq) = 'd' as deleted, max(seq) as source_lsn from log group by row_id having count(*) filter (where op <> 'd') > 0", decimals="amount")
def guarded_merge_inorder(spark, d):
    e = log(spark, d).select("row_id", "op", F.col("seq").alias("lsn"), "amount")
    return merge.guarded_in_order(e, "row_id", ["amount"])


REPLAY_SQL = """, ev as (select row_id, (seq * 7919) % 104729 as arrival, op, seq as lsn, amount from log
  union all select c_custkey, -1, case when c_custkey % 6 = 0 then 'D' else 'c' end, c_custkey * 13, cast(c_acctbal as decimal(12,2)) from customer where c_custkey % 3 = 0),
a as (select *, sum(case when op <> 'd' then 1 else 0 end) over (partition by row_id order by arrival, lsn rows unbounded preceding) as ups from ev),
b as (select *, max(lsn) over (partition by row_id order by arrival, lsn rows between unbounded preceding and 1 preceding) as top from a where ups > 0),
k as (select * from b where top is null or lsn > top)"""


def _replay(spark, d):
    e = log(spark, d).select("row_id", (F.col("seq") * 7919 % 104729).alias("arrival"), "op", F.col("seq").alias("lsn"), "amount")
    stored = t(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").cast("decimal(12,2)").alias("amount"), (F.col("c_custkey") % 6 == 0).alias("deleted"), (F.col("c_custkey") * 13).alias("source_lsn"))
    return e, stored


@query(REPLAY_SQL + " select row_id, max_by(amount, lsn) filter (where op <> 'd') as amount, max_by(op, lsn) in ('d', 'D') as deleted, max(lsn) as source_lsn from k group by row_id", decimals="amount")
def guarded_merge_replay(spark, d):
    e, stored = _replay(spark, d)
    return merge.guarded(e, "row_id", ["amount"], stored)


# op is shown, so it decides last among changes of one position
@query(REPLAY_SQL.replace("order by arrival, lsn", "order by arrival, lsn, op") + " select row_id, arrival, op, lsn from k where arrival >= 0")
def guard_accepted(spark, d):
    e, stored = _replay(spark, d)
    return merge.applied(e, "row_id", stored)


@query(", o as (select c_custkey as id, c_acctbal as v from customer where c_custkey % 2 = 0), n as (select c_custkey as id, c_acctbal + 1 as v from customer where c_custkey % 3 = 0) select id, v from o where id not in (select id from n) union all select id, v from n")
def bulk_upsert(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"))
    return merge.bulk_upsert(c.filter("id % 2 = 0"), c.filter("id % 3 = 0").withColumn("v", F.col("v") + 1), "id")


@query("select c_custkey as id, c_custkey % 5 = 0 or c_custkey % 4 = 0 as deleted, case when c_custkey % 4 = 0 then 99 else 1 end::bigint as source_seq from customer")
def bulk_soft_delete(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    target = c.withColumn("deleted", F.col("id") % 5 == 0).withColumn("source_seq", F.lit(1).cast("bigint"))
    return merge.bulk_soft_delete(target, c.filter("id % 4 = 0"), "id", 99)


@query("select c_custkey as id from customer where c_custkey not in (select row_id from log where op = 'd')")
def bulk_delete(spark, d):
    return merge.bulk_delete(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), log(spark, d).filter("op = 'd'").select(F.col("row_id").alias("id")), "id")


@query("select c_custkey as id, c_name as name from customer where c_custkey % 2 = 0 union all select c_custkey, c_name || '+' from customer where c_custkey % 3 = 0 and c_custkey % 2 <> 0")
def insert_if_absent(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return merge.insert_if_absent(c.filter("id % 2 = 0"), c.filter("id % 3 = 0").withColumn("name", F.concat("name", F.lit("+"))), "id")


@query("""select p_partkey as id, p_size + 1 as point, cast(cast(p_retailprice as decimal(12,2)) * 1.01 as decimal(12,2)) as price,
cast(case when (cast(cast(p_retailprice as decimal(10,2)) * 100 as bigint)) % 2 = 0 then cast(p_retailprice as decimal(10,2)) + 0.01 else cast(p_retailprice as decimal(10,2)) - 0.01 end as decimal(10,2)) as toggled
from part""", decimals="price toggled")
def bulk_update_expressions(spark, d):
    p = t(spark, d, "part")
    price, usd = F.col("p_retailprice").cast("decimal(12,2)"), F.col("p_retailprice").cast("decimal(10,2)")
    cent = F.lit("0.01").cast("decimal(3,2)")
    toggled = F.when((usd * 100).cast("bigint") % 2 == 0, usd + cent).otherwise(usd - cent)
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1).alias("point"), (price * F.lit("1.01").cast("decimal(3,2)")).cast("decimal(12,2)").alias("price"), toggled.cast("decimal(10,2)").alias("toggled"))


@query("select seq, table_name, row_id, op from log where seq > 4000")
def outbox_prune(spark, d):
    """The log as it is after pruning up to a position that is applied, once more than needed."""
    log_ = outbox.Outbox(scratch(spark))
    log_.append(log(spark, d))
    log_.prune(4000)
    log_.prune(1000)
    return log_.rows().select("seq", "table_name", "row_id", "op")


#: Present rows of the source: a member for each customer, but one in eleven is gone.
MEMBERS_SQL = "members as (select c_custkey as id, c_name || '@example.org' as email, c_name as name, c_nationkey::bigint as grade_id from customer where c_custkey % 11 <> 0)"
CYCLE = 4000


def _members(spark, d):
    c = t(spark, d, "customer").filter("c_custkey % 11 <> 0")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("@example.org")).alias("email"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("bigint").alias("grade_id"), F.lit(0).alias("point"), at.alias("created_at"), at.alias("updated_at"))


@query(f""", {MEMBERS_SQL}, f as (select row_id, (seq - 1) // {CYCLE} as cycle, max_by(op, seq) = 'd' as gone from log where table_name = 'member' group by all),
top as (select (seq - 1) // {CYCLE} as cycle, max(seq) as seq from log group by 1),
w as (select f.row_id, f.gone, top.seq, m.email, m.grade_id, m.id is not null as found from f join top using (cycle) left join members m on m.id = f.row_id),
k as (select row_id, max_by(email, seq) filter (where found and not gone) as email, max_by(grade_id, seq) filter (where found and not gone) as grade_id,
  max(seq) filter (where found and not gone) as up, max(seq) filter (where gone) as down from w group by row_id)
select row_id as id, email, grade_id, coalesce(down > up, false) as deleted, greatest(up, coalesce(down, 0)) as source_seq from k where up is not null""")
def outbox_cycles(spark, d):
    """Cycles of the outbox worker until nothing is waiting; the members it leaves."""
    log_ = outbox.Outbox(scratch(spark))
    log_.append(log(spark, d))
    store = scratch(spark)
    worker = outbox.Worker(log_, {"member": _members(spark, d)}.__getitem__, store, {"member": SPECS["member"]}, CYCLE, 4)
    outbox.catch_up(worker)
    return store.read("member").select("id", "email", "grade_id", "deleted", "source_seq")


# --- joins ------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 3)")
def orphan_rows(spark, d):
    return reconcile.orphans(t(spark, d, "orders"), t(spark, d, "customer").filter("c_custkey % 10 <> 3"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("with s as (select c_nationkey as k, count(*) as n from customer group by 1), x as (select s_nationkey as k, count(*) as n from supplier group by 1) select s.k, s.n - x.n as gap from s join x on s.k = x.k")
def label_join(spark, d):
    s = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    x = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    return s.join(x, "k").select("k", (F.col("n") - F.col("m")).alias("gap"))


@query("select n_nationkey, n_name from nation where (select count(*) from log where op = 'd' and value > 100) > 0")
def gate_join(spark, d):
    return S.gate(t(spark, d, "nation").select("n_nationkey", "n_name"), log(spark, d).filter("op = 'd' and value > 100"))


@query("with a as (select c_nationkey as k, count(*) as v from customer where c_nationkey < 20 group by 1), b as (select s_nationkey as k, -count(*) as v from supplier group by 1) select k, v from a union all select k, v from b where k not in (select k from a)")
def or_fallback(spark, d):
    a = t(spark, d, "customer").filter("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    b = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((-F.count(F.lit(1))).alias("v"))
    return S.otherwise(a, b, ["k"])


@query("with v as (select * from (values ('a@x', 'ASIA'), ('b@x', 'EUROPE'), ('c@x', 'NOWHERE')) x(email, code)) select email, r_regionkey from v join region on r_name = code")
def values_lookup(spark, d):
    v = spark.createDataFrame([("a@x", "ASIA"), ("b@x", "EUROPE"), ("c@x", "NOWHERE")], "email string, code string")
    r = t(spark, d, "region")
    return v.join(r, v["code"] == r["r_name"]).select("email", "r_regionkey")


@query("""with g as (select list(n_nationkey order by n_regionkey, n_nationkey) as ids from nation) select i, 'user-' || i as name, case when i % 10 < 6 then 'low' when i % 10 < 9 then 'mid' else 'top' end as tier, ids[(i % len(ids) + 1)::int]::bigint as nation_id,
 timestamp '2024-01-01 00:00:00' + to_seconds(i * 30) as created_at from range(1, 2001) r(i), g""")
def seed_generator(spark, d):
    g = t(spark, d, "nation").agg(F.array_sort(F.collect_list(F.struct("n_regionkey", "n_nationkey"))).alias("s")).select(F.transform("s", lambda x: x["n_nationkey"]).alias("ids"))
    i = F.col("i")
    tier = F.when(i % 10 < 6, "low").when(i % 10 < 9, "mid").otherwise("top")
    return spark.range(1, 2001).withColumnRenamed("id", "i").crossJoin(F.broadcast(g)).select(
        "i", F.format_string("user-%d", i).alias("name"), tier.alias("tier"), F.element_at("ids", (i % F.size("ids") + 1).cast("int")).cast("bigint").alias("nation_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, i * 30)").alias("created_at"),
    )


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (select o_orderkey from orders where o_orderstatus = 'O' order by o_orderkey limit 100)")
def in_subquery(spark, d):
    o = t(spark, d, "orders")
    keys = o.filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(100).select("o_orderkey")
    return o.join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("select c_custkey from customer except select o_custkey from orders where o_custkey % 7 <> 3")
def missing_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey").subtract(t(spark, d, "orders").filter("o_custkey % 7 <> 3").select(F.col("o_custkey").alias("c_custkey")))


@query(", h as (select max(seq) as top from log), a as (select log.* from log, h where seq <= top * 0.6), b as (select log.* from log, h where seq > top * 0.5) select seq, row_id from b where exists (select 1 from a where a.seq = b.seq)")
def duplicate_lsn(spark, d):
    x = log(spark, d)
    top = F.broadcast(x.agg(F.max("seq").alias("top")))  # one row
    a = x.join(top, F.col("seq") <= F.col("top") * 0.6).select("seq")
    return x.join(top, F.col("seq") > F.col("top") * 0.5).join(a, "seq", "left_semi").select("seq", "row_id")


# --- aggregation ------------------------------------------------------------------------------------


@query("select table_name, n from (select 'customer' as table_name, count(*) as n from customer union all select 'orders', count(*) from orders union all select 'part', count(*) from part where p_size % 4 <> 0)")
def exact_row_counts(spark, d):
    part = t(spark, d, "part").withColumn("deleted", F.col("p_size") % 4 == 0)
    return reconcile.row_counts({"customer": t(spark, d, "customer"), "orders": t(spark, d, "orders"), "part": part, "cdc_checkpoint": t(spark, d, "region")})


@query("select count(*) filter (where p_size % 4 = 0) as deleted from part")
def soft_deleted_count(spark, d):
    return t(spark, d, "part").agg(F.count_if(F.col("p_size") % 4 == 0).alias("deleted"))


def _letters(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in ("PENDING", "RETRY_REQUESTED", "RESOLVED", "DISCARDED")]), (F.col("seq") % 4 + 1).cast("int"))
    return log(spark, d).filter("op = 'd'").select(F.col("seq").alias("id"), F.col("table_name").alias("source_table"), status.alias("status"))


LETTERS_SQL = "letters as (select seq as id, table_name as source_table, ['PENDING', 'RETRY_REQUESTED', 'RESOLVED', 'DISCARDED'][(seq % 4 + 1)::int] as status from log where op = 'd')"


@query(f", {LETTERS_SQL} select count(*) filter (where status = 'PENDING') as pending, count(*) filter (where status = 'RETRY_REQUESTED') as retry_requested, count(*) filter (where status = 'RESOLVED') as resolved, count(*) filter (where status = 'DISCARDED') as discarded, count(*) as total from letters")
def dlq_status_pivot(spark, d):
    return quarantine.status_pivot(_letters(spark, d))


@query(f", {LETTERS_SQL} select source_table, status, count(*) as n from letters group by all")
def dlq_by_table(spark, d):
    return _letters(spark, d).groupBy("source_table", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f", {LETTERS_SQL} select count(*) as n from letters where status in ('PENDING', 'RETRY_REQUESTED')")
def dlq_pending(spark, d):
    return _letters(spark, d).filter(F.col("status").isin("PENDING", "RETRY_REQUESTED")).agg(F.count(F.lit(1)).alias("n"))


#: Every delete of the log as a faulty event, in order of arrival, as the stream quarantines it.
FAULTS_SQL = "faults as (select row_number() over (order by seq) + 100 as id, seq, table_name, row_id, amount, epoch_us(changed_at) // 1000 as ms from log where op = 'd')"


def _faults(spark, d):
    x = changes_of(spark, d).filter("op = 'd'").withColumns({"broken": F.lit(False), "raw": F.lit(None).cast("string"), "fault": F.lit("bad:amount"), "arrival": F.col("seq")})
    return quarantine.dead_letters(quarantine.numbered(x, 100), "main", NOW)


@query(f", {FAULTS_SQL} select id, table_name as source_table, seq as source_lsn from faults where seq % 3 = 0 order by id limit 50")
def dlq_claim(spark, d):
    letters = _faults(spark, d)
    asked = letters.withColumn("status", F.when(F.col("source_lsn") % 3 == 0, "RETRY_REQUESTED").otherwise(F.col("status")))
    return quarantine.claim(asked, 50).select("id", "source_table", "source_lsn")


@query(f", {FAULTS_SQL} select id, case when seq % 6 = 0 then 'RESOLVED' else 'PENDING' end as status, case when seq % 6 = 3 then 2 else 1 end::int as attempts from faults")
def dlq_settle(spark, d):
    letters = _faults(spark, d)
    asked = letters.withColumn("status", F.when(F.col("source_lsn") % 3 == 0, "RETRY_REQUESTED").otherwise(F.col("status")))
    claimed = quarantine.claim(asked, 1 << 30).select("id", "source_lsn")
    twice = lambda df: df.unionByName(df)  # noqa: E731  an id given twice settles one letter
    return quarantine.settled(asked, twice(claimed.filter("source_lsn % 6 = 0")), twice(claimed.filter("source_lsn % 6 <> 0")), NOW).select("id", "status", "attempts")


@query("select count(*) as n, md5(coalesce(string_agg(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || cast(o_totalprice as decimal(14,2)), ',' order by o_orderkey), '')) as checksum from orders")
def reconcile_checksum(spark, d):
    o = t(spark, d, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(14,2)"))
    return reconcile.chained_checksum(o, ["o_orderkey", "o_custkey", "o_orderstatus", "amount"], "o_orderkey", shared_folder(spark))


LINE_SQL = "md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || cast(o_totalprice as decimal(14,2)))"


@query(f"select ('0x' || substr(md5(o_orderkey::varchar), 1, 12))::bigint % 64 as bucket, count(*) as n, sum(('0x' || substr({LINE_SQL}, 1, 12))::bigint)::hugeint::varchar as checksum from orders group by 1")
def reconcile_bucket_checksums(spark, d):
    o = t(spark, d, "orders").withColumn("amount", F.col("o_totalprice").cast("decimal(14,2)"))
    return reconcile.bucket_checksums(o, ["o_orderkey", "o_custkey", "o_orderstatus", "amount"], "o_orderkey").withColumn("checksum", F.col("checksum").cast("string"))


@query("""with s as (select 'orders' as table_name, count(*) as n, md5(coalesce(string_agg(o_orderkey || '|' || o_orderstatus, ',' order by o_orderkey), '')) as c from orders),
x as (select 'orders' as table_name, count(*) as n, md5(coalesce(string_agg(o_orderkey || '|' || case when o_orderkey = 7 then 'X' else o_orderstatus end, ',' order by o_orderkey), '')) as c from orders),
cs as (select 'customer' as table_name, count(*) as n, md5(coalesce(string_agg(c_custkey || '|' || c_name, ',' order by c_custkey), '')) as c from customer),
cx as (select 'customer' as table_name, count(*) as n, md5(coalesce(string_agg(c_custkey || '|' || c_name, ',' order by c_custkey), '')) as c from customer where c_custkey % 5 <> 0),
b as (select s.table_name, s.n as source_rows, x.n as target_rows, s.c = x.c as same from s join x using (table_name) union all select cs.table_name, cs.n, cx.n, cs.c = cx.c from cs join cx using (table_name))
select table_name, source_rows, target_rows, case when source_rows <> target_rows then 'rows' when not same then 'values' else 'equal' end as verdict from b""")
def reconcile_both_sides(spark, d):
    """Count and checksum of both sides, told apart: missing rows, or values that differ at equal counts."""
    o, c = t(spark, d, "orders"), t(spark, d, "customer")
    wrong = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 7, "X").otherwise(F.col("o_orderstatus")))
    pairs = {"orders": (o, wrong, ["o_orderkey", "o_orderstatus"]), "customer": (c, c.filter("c_custkey % 5 <> 0"), ["c_custkey", "c_name"])}
    return reconcile.both_sides(pairs, shared_folder(spark))


@query("select count(*) as n, max(o_orderdate) as latest, sum(cast(o_totalprice as decimal(18,2)))::decimal(28,2) as amount from orders", decimals="amount")
def reconcile_totals(spark, d):
    return reconcile.totals(t(spark, d, "orders"), "o_orderdate", "o_totalprice")


@query("""with s as (select o_orderstatus as table_name, count(*) as s from orders group by 1), x as (select o_orderstatus as table_name, count(*) as n from orders where o_orderkey % 100 <> 0 group by 1)
select table_name, abs(s - n) - case when table_name = 'F' then 3 else 0 end as drift from s join x using (table_name)""")
def reconcile_counts(spark, d):
    o = t(spark, d, "orders").withColumnRenamed("o_orderstatus", "table_name")
    pending = spark.createDataFrame([("F", 3)], "table_name string, n bigint")
    return reconcile.drift(o.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")), o.filter("o_orderkey % 100 <> 0").groupBy("table_name").agg(F.count(F.lit(1)).alias("n")), pending)


@query("select o_orderkey, case when o_orderkey % 100 = 0 then 'missing' else 'changed' end as state from orders where o_orderkey % 100 = 0 or o_orderkey % 101 = 5")
def key_reconcile(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    target = o.filter("o_orderkey % 100 <> 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 101 == 5, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return reconcile.key_reconcile(o, target, "o_orderkey", ["o_orderkey", "o_custkey"])


@query(f"select count(*) as pending, coalesce(date_diff('second', min(changed_at), timestamp '{NOW}'), 0)::bigint as age from log where seq > 6000")
def outbox_backlog(spark, d):
    age = (F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.min("changed_at")).cast("timestamp"))).alias("age")
    return log(spark, d).filter("seq > 6000").agg(F.count(F.lit(1)).alias("pending"), F.coalesce(age, F.lit(0)).alias("age"))


@query("select (seq - 1) // 500 as batch, round(avg(case when op = 'd' then 1.0 else 0.0 end), 6) as ratio, avg(case when op = 'd' then 1.0 else 0.0 end) > 0.2 as halt from log group by 1")
def failure_ratio(spark, d):
    bad = F.avg((F.col("op") == "d").cast("double"))
    return log(spark, d).groupBy(F.floor((F.col("seq") - 1) / 500).alias("batch")).agg(F.round(bad, 6).alias("ratio"), (bad > 0.2).alias("halt"))


@query("select min(o_orderkey) as lo, max(o_orderkey) as hi from orders")
def key_bounds(spark, d):
    return t(spark, d, "orders").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("select r_name, list_transform(list(n_name order by n_nationkey), lambda x: x)::varchar as names from nation join region on n_regionkey = r_regionkey group by r_name")
def ordered_array_agg(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return n.groupBy("r_name").agg(F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]")).alias("names"))


@query("with s as (select event_type, user_id % 10 as shard, sum(cast(value as decimal(12,2))) as v from events group by all) select event_type, sum(v)::decimal(38,2) as total, max(v)::decimal(38,2) as top, min(v)::decimal(38,2) as low, count(*) as series from s group by event_type", decimals="total top low")
def label_aggregations(spark, d):
    s = t(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.sum(F.col("value").cast("decimal(12,2)")).alias("v"))
    return s.groupBy("event_type").agg(F.sum("v").cast("decimal(38,2)").alias("total"), F.max("v").cast("decimal(38,2)").alias("top"), F.min("v").cast("decimal(38,2)").alias("low"), F.count(F.lit(1)).alias("series"))


@query("with s as (select distinct event_type, user_id from events) select count(*) as kinds from (select event_type from s group by event_type)")
def count_of_counts(spark, d):
    return t(spark, d, "events").select("event_type", "user_id").distinct().groupBy("event_type").count().agg(F.count(F.lit(1)).alias("kinds"))


@query("select coalesce(sum(p_size), 0)::bigint as bytes, count(*) as files from part")
def directory_stats(spark, d):
    return t(spark, d, "part").agg(F.coalesce(F.sum("p_size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("files"))


@query(f"select table_name, round(avg(greatest(date_diff('microsecond', changed_at, timestamp '{NOW}'), 0) / 1e6), 3) as lag_avg, max(greatest(date_diff('microsecond', changed_at, timestamp '{NOW}'), 0)) as lag_max_us from log group by table_name")
def apply_lag(spark, d):
    us = F.greatest(F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("changed_at").cast("timestamp")), F.lit(0))
    return log(spark, d).groupBy("table_name").agg(F.round(F.avg(us / 1e6), 3).alias("lag_avg"), F.max(us).alias("lag_max_us"))


@query("select user_id % 20 as job, round(count(*) filter (where event_type = 'click') / greatest(count(*) filter (where event_type in ('click', 'view')), 1), 6) as ratio from events group by 1")
def guarded_ratio(spark, d):
    hit, read = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type").isin("click", "view"))
    return t(spark, d, "events").groupBy((F.col("user_id") % 20).alias("job")).agg(F.round(hit / F.greatest(read, F.lit(1)), 6).alias("ratio"))


AVG_SQL = f"""with {HOURLY_SQL}, p as (select *, sum(gauge * 2.5) over (partition by event_type, date_trunc('day', ts) order by ts rows unbounded preceding) as total, lag(counter) over w as pc from h2 window w as (partition by event_type order by ts)),
q as (select *, lag(total) over (partition by event_type order by ts) as pt from p),
i as (select *, case when counter >= pc then counter - pc when pc is not null then counter end as dc, case when total >= pt then total - pt when pt is not null then total end as dt from q),
v as (select event_type, ts, sum(coalesce(dc, 0)) over x - coalesce(first(dc) over x, 0) as c, sum(coalesce(dt, 0)) over x - coalesce(first(dt) over x, 0) as s from i
  window x as (partition by event_type order by epoch_us(ts) range between 21599999999 preceding and current row))"""


@query(AVG_SQL + " select event_type, ts, round(s / c, 6) as lag_avg from v where c > 0")
def lag_average_rate(spark, d):
    """Average lag over six hours as a timer tells it: rate of its sum over rate of its count."""
    x = hourly(spark, d)
    day = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    total = x.withColumn("value", F.sum(F.col("gauge") * 2.5).over(day)).select("event_type", "ts", "value")
    return S.rate_ratio(total, x.select("event_type", "ts", F.col("counter").alias("value")), ["event_type"], 21600).select("event_type", "ts", F.round("ratio", 6).alias("lag_avg"))


@query(AVG_SQL + " select event_type, ts, round((s / 21600) / greatest(c / 21600, 0.001), 6) as ratio from v")
def guarded_rate_ratio(spark, d):
    """The same with the divisor held above a least value, so that quiet times give 0."""
    x = hourly(spark, d)
    day = Window.partitionBy("event_type", F.date_trunc("day", "ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    total = x.withColumn("value", F.sum(F.col("gauge") * 2.5).over(day)).select("event_type", "ts", "value")
    return S.rate_ratio(total, x.select("event_type", "ts", F.col("counter").alias("value")), ["event_type"], 21600, 0.001).select("event_type", "ts", F.round("ratio", 6).alias("ratio"))


# --- windows and series -----------------------------------------------------------------------------


@query(", x as (select row_id, seq, lag(seq) over (partition by row_id order by changed_at, seq) as p from log) select count(*) as n, count(*) filter (where p is not null and seq <= p) as wrong from x")
def lsn_monotone(spark, d):
    x = log(spark, d).withColumn("p", F.lag("seq").over(Window.partitionBy("row_id").orderBy("changed_at", "seq")))
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p").isNotNull() & (F.col("seq") <= F.col("p"))).alias("wrong"))


#: Slots by the sample that starts each: the first one a slot's time or more past the start before.
SLOTS_SQL = """with recursive b as (select user_id, epoch_us(ts) as t, value from events where ts <= timestamp '{upto}'),
s(user_id, start, before) as (select user_id, min(t), null::bigint from b group by user_id
  union all select s.user_id, min(b.t), s.start from s join b on b.user_id = s.user_id and b.t >= s.start + {width} group by s.user_id, s.start),
o as (select s.user_id, s.start, s.before, max(b.value) as top from s asof join b n on n.user_id = s.user_id and s.start >= n.t join b on b.user_id = s.user_id and b.t >= s.start
  left join s z on z.user_id = s.user_id and z.before = s.start where z.start is null or b.t < z.start group by all),
r as (select user_id, start, top, greatest(top, case when start - before < 2 * {width} then lag(top) over (partition by user_id order by start) end) as rolling_max from o)"""


@query(SLOTS_SQL.format(upto="9999-01-01", width=21_600_000_000) + " select user_id, start, top, rolling_max from r")
def lag_rolling_max(spark, d):
    return S.rolling_max(t(spark, d, "events"), ["user_id"], 21600, written(spark))


@query(SLOTS_SQL.format(upto="2024-01-30 12:00:00", width=86_400_000_000) + """, l as (select user_id, max(start) as start, max_by(top, start) as top, max_by(rolling_max, start) as rolling_max from r group by user_id)
select e.user_id, coalesce(case when epoch_us(timestamp '2024-01-30 12:00:00') - l.start >= 2 * 86400000000 then 0 when epoch_us(timestamp '2024-01-30 12:00:00') - l.start >= 86400000000 then top else rolling_max end, 0) as rolling_max
from (select distinct user_id from events) e left join l on l.user_id = e.user_id""")
def rolling_max_read(spark, d):
    return S.rolling_max_at(t(spark, d, "events"), ["user_id"], 86400, "2024-01-30 12:00:00", written(spark))


RATE_SQL = f"""with {HOURLY_SQL}, p as (select *, lag(counter) over (partition by event_type order by ts) as prev from h2),
s as (select *, case when prev is null then null when counter >= prev then counter - prev else counter end as step, case when prev is not null and prev <> counter then 1 else 0 end as ch from p),
r as (select event_type, ts, sum(coalesce(step, 0)) over w - coalesce(first_value(step) over w, 0) as increase, (sum(ch) over w - first_value(ch) over w)::bigint as changes
  from s window w as (partition by event_type order by ts range between interval '6 hours' - interval '1 microsecond' preceding and current row))"""


@query(RATE_SQL + " select event_type, ts, increase, round(increase / 21600, 9) as rate from r")
def rate_increase(spark, d):
    x = hourly(spark, d).select("event_type", "ts", F.col("counter").alias("value"))
    return S.rate(x, ["event_type"], 21600).select("event_type", "ts", "increase", F.round("rate", 9).alias("rate"))


@query(RATE_SQL + " select event_type, ts, changes from r")
def value_changes(spark, d):
    x = hourly(spark, d).select("event_type", "ts", F.col("counter").alias("value"))
    return S.changes(x, ["event_type"], 21600).select("event_type", "ts", "changes")


@query(f"with {HOURLY_SQL} select event_type, ts, gauge - first_value(gauge) over (partition by event_type order by ts range between interval '6 hours' - interval '1 microsecond' preceding and current row) as delta from h2")
def gauge_delta(spark, d):
    x = hourly(spark, d).select("event_type", "ts", F.col("gauge").alias("value"))
    return S.delta(x, ["event_type"], 21600).select("event_type", "ts", "delta")


@query(f"""with {HOURLY_SQL}, o as (select event_type, ts, gauge >= 3 as ok from h2), g as (select *, case when not ok or not coalesce(lag(ok) over w, false) or coalesce(ts - lag(ts) over w > interval '1 hour', true) then 1 else 0 end as brk from o window w as (partition by event_type order by ts)),
i as (select *, sum(brk) over (partition by event_type order by ts rows unbounded preceding) as run from g)
select event_type, min(ts) as began, max(ts) as ended from i where ok group by event_type, run having max(ts) - min(ts) >= interval '2 hours'""")
def alert_for(spark, d):
    x = hourly(spark, d).select("event_type", "ts", F.col("gauge").alias("value"))
    return S.held_for(x, ["event_type"], F.col("value") >= 3, 7200, 3600)


@query(f"with {HOURLY_SQL} select ts, sum(gauge) as v, 5.0::double as goal from h2 group by ts having sum(gauge) > 5")
def constant_series(spark, d):
    return hourly(spark, d).groupBy("ts").agg(F.sum("gauge").alias("v")).withColumn("goal", F.lit(5.0)).filter("v > goal")


# --- sort, limit, sets ------------------------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderkey > 500 order by o_orderkey limit 100")
def keyset_page(spark, d):
    return t(spark, d, "orders").filter("o_orderkey > 500").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("select event_type, n from (select event_type, count(*) as n from events group by 1) order by n desc, event_type limit 3")
def top_kinds(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("with m as (select (min(c_custkey) + (max(c_custkey) - min(c_custkey)) * 0.4)::bigint as lo from customer) select c_custkey from customer, m where c_custkey >= lo order by c_custkey limit 50")
def contiguous_slice(spark, d):
    c = t(spark, d, "customer")
    lo = c.agg((F.min("c_custkey") + F.round((F.max("c_custkey") - F.min("c_custkey")) * 0.4)).cast("bigint").alias("lo"))
    return c.join(F.broadcast(lo), F.col("c_custkey") >= F.col("lo")).orderBy("c_custkey").limit(50).select("c_custkey")


@query("select 'region' as name, count(*) as n from region union all select 'nation', count(*) from nation")
def union_of_counts(spark, d):
    one = lambda n: t(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
    return one("region").unionByName(one("nation"))


# --- field diff -------------------------------------------------------------------------------------

DIFF_SQL = ", x as (select seq, row_id, op, event_type, amount, lag(seq) over w as ps, lag(event_type) over w as pk, lag(amount) over w as pa from log window w as (partition by row_id order by seq)), f as (select seq, ps is not null as identifiable, case when ps is null then '' else array_to_string(list_filter([case when amount is distinct from pa then 'amount' end, case when event_type is distinct from pk then 'kind' end], lambda z: z is not null), ',') end as changed from x)"


@query(DIFF_SQL + " select seq, identifiable, changed, '' as unreadable from f")
def field_diff(spark, d):
    x = changes_of(spark, d).withColumn("f", diff.field_diff(F.col("before"), F.col("after")))
    return x.select("seq", F.col("f.identifiable").alias("identifiable"), F.array_join("f.changed", ",").alias("changed"), F.array_join("f.unreadable", ",").alias("unreadable"))


@query(DIFF_SQL + " select changed, count(*) as n from f group by changed order by n desc, changed limit 20")
def change_combo_top20(spark, d):
    return field_diff(spark, d).groupBy("changed").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "changed").limit(20)


@query(DIFF_SQL + " select count(*) as n from f where not identifiable")
def unidentifiable(spark, d):
    return field_diff(spark, d).agg(F.count_if(~F.col("identifiable")).alias("n"))


@query(DIFF_SQL + """, a as (select x.seq, x.row_id, f.identifiable, f.changed, x.amount, x.pa, x.event_type, x.pk from x join f using (seq) where x.op = 'u' and x.row_id % 4 in (1, 3))
select row_id::varchar as row_key, seq as source_lsn, identifiable, changed as changed_fields, case changed when '' then null when 'amount' then '{"amount":"' || pa || '"}' when 'kind' then '{"kind":"' || pk || '"}' else '{"kind":"' || pk || '","amount":"' || pa || '"}' end as before_values,
case changed when '' then null when 'amount' then '{"amount":"' || amount || '"}' when 'kind' then '{"kind":"' || event_type || '"}' else '{"kind":"' || event_type || '","amount":"' || amount || '"}' end as after_values from a""")
def change_audit(spark, d):
    x = diff.audit(changes_of(spark, d), "computer, member", "main", NOW)
    return x.select("row_key", "source_lsn", "identifiable", "changed_fields", "before_values", "after_values")


@query(f"""select row_id::varchar as row_key, seq as source_lsn, case when seq % 5 = 0 then 0 else epoch_us(timestamp '{NOW}') // 1000 - epoch_us(changed_at) // 1000 end as age_ms
from log where op = 'u' and row_id % 4 in (1, 3)""")
def audit_source_times(spark, d):
    """How old audited changes are by the source's time, which every fifth does not tell: those count from now."""
    x = changes_of(spark, d).withColumn("source_ts_ms", F.when(F.col("lsn") % 5 != 0, F.col("source_ts_ms")))
    age = F.unix_millis(F.lit(NOW).cast("timestamp")) - F.unix_millis("source_ts")
    return diff.audit(x, "computer, member", "main", NOW).select("row_key", "source_lsn", age.alias("age_ms"))


@query(", x as (select seq, amount, lag(amount) over (partition by row_id order by seq) as pa from log) select seq, case when seq % 3 = 0 and pa is not null then pa else case when seq % 3 = 0 then null else amount end end as amount from x", decimals="amount")
def toast_recovery(spark, d):
    x = changes_of(spark, d)
    hidden = F.transform_values("after", lambda k, v: F.when((k == "amount") & (F.col("seq") % 3 == 0), F.lit(diff.UNREADABLE)).otherwise(v))
    x = x.withColumn("after", hidden).withColumn("after", diff.recovered(F.col("before"), F.col("after")))
    return x.select("seq", F.element_at("after", "amount").try_cast("decimal(12,2)").alias("amount"))


# --- positions, verdicts, gaps -----------------------------------------------------------------------


@query("select seq, printf('%X/%X', (seq * 1234567) >> 32, (seq * 1234567) & 4294967295) as lsn from log")
def lsn_format(spark, d):
    return log(spark, d).select("seq", format_lsn(F.col("seq") * 1234567).alias("lsn"))


@query("select seq, seq * 1234567 as number from log")
def lsn_roundtrip(spark, d):
    return log(spark, d).select("seq", parse_lsn(format_lsn(F.col("seq") * 1234567)).alias("number"))


@query("select seq, case when seq % 5 = 0 then 0 else seq * 100 - seq * 90 end::bigint as lag_bytes from log")
def slot_lag(spark, d):
    restart = F.when(F.col("seq") % 5 != 0, F.col("seq") * 90)
    return log(spark, d).select("seq", lsn_lag(F.col("seq") * 100, restart).alias("lag_bytes"))


# fixed values: states of the SQL standard
STATES = ["40001", "40P01", "55P03", "08006", "53300", "57014", "22018", "23505", "28000", "3D000", "3F000", "42P01", "XX000"]


CASES_SQL = ", s as (select seq, [{}][(seq % {} + 1)::int] as state from log)"


def _cases(spark, d, states: list[str]) -> DataFrame:
    """The log with one of some states for each change."""
    return log(spark, d).select("seq", F.element_at(F.array(*[F.lit(x) for x in states]), (F.col("seq") % len(states) + 1).cast("int")).alias("state"))


@query(CASES_SQL.format(", ".join(f"'{x}'" for x in STATES), len(STATES)) + """ select seq, state, case when state in ('40001', '40P01', '55P03') or left(state, 2) in ('08', '53', '57') then 'RETRY' when left(state, 2) in ('22', '23') then 'DEAD_LETTER'
when left(state, 2) in ('28', '3D', '3F', '42') then 'HALT' else 'RETRY' end as verdict from s""")
def failure_verdict(spark, d):
    return _cases(spark, d, STATES).select("seq", "state", verdict(F.col("state")).alias("verdict"))


WAL = {"reserved": 0, "extended": 1, "unreserved": 2, "lost": 3}
IDENTITY = {"d": 0, "f": 1, "i": 2, "n": 3}


@query(CASES_SQL.format("'reserved', 'extended', 'unreserved', 'lost', 'other'", 5) + " select state as status, case state when 'reserved' then 0 when 'extended' then 1 when 'unreserved' then 2 when 'lost' then 3 else -1 end as code, count(*) as n from s group by all")
def status_codes(spark, d):
    s = _cases(spark, d, [*WAL, "other"]).select(F.col("state").alias("status"), code_of(F.col("state"), WAL).alias("code"))
    return s.groupBy("status", "code").agg(F.count(F.lit(1)).alias("n"))


@query(CASES_SQL.format("'d', 'f', 'i', 'n', '?'", 5) + " select seq, state, case state when 'd' then 0 when 'f' then 1 when 'i' then 2 when 'n' then 3 else -1 end as code from s")
def replica_identity_codes(spark, d):
    return _cases(spark, d, [*IDENTITY, "?"]).select("seq", "state", code_of(F.col("state"), IDENTITY).alias("code"))


@query("""with c as (select c_custkey as pipeline, nullif(c_custkey % 50, 0) as last_applied from customer), s as (select c_custkey as pipeline, case when c_custkey % 9 = 0 then null else (c_custkey * 7) % 60 end as restart from customer where c_custkey % 4 <> 0)
select c.pipeline::varchar as pipeline, last_applied, case when s.pipeline is not null then coalesce(restart, 0)::varchar else 'none' end as restart, case when s.pipeline is null then 'slot missing' else 'restart after last applied' end as reason
from c left join s on c.pipeline = s.pipeline where last_applied is not null and (s.pipeline is null or coalesce(restart, 0) > last_applied)""")
def capture_gaps(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("pipeline"))
    slots = c.filter("c_custkey % 4 <> 0").select("pipeline", F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") * 7 % 60).alias("restart"))
    return guard.gaps(c.select("pipeline", F.nullif(F.col("c_custkey") % 50, F.lit(0)).alias("last_applied")), slots).withColumn("restart", F.coalesce(F.col("restart").cast("string"), F.lit("none")))


@query(f"select table_name, date_diff('second', date_trunc('second', max(changed_at)), timestamp '{NOW}')::bigint as age from log group by table_name")
def heartbeat_age(spark, d):
    age = F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.max("changed_at")).cast("timestamp"))
    return log(spark, d).groupBy("table_name").agg(age.alias("age"))


@query("select round(avg(octet_length(c_name::blob)), 6) as c_name, round(avg(octet_length(c_mktsegment::blob)), 6) as c_mktsegment from customer")
def column_width(spark, d):
    return t(spark, d, "customer").agg(*[F.round(F.avg(F.octet_length(c)), 6).alias(c) for c in ("c_name", "c_mktsegment")])


@query("select c_custkey, c_name from customer where c_name like 'Customer#00000%' and c_name not like 'Customer#000000%'")
def like_filters(spark, d):
    return t(spark, d, "customer").filter(F.col("c_name").like("Customer#00000%") & ~F.col("c_name").like("Customer#000000%")).select("c_custkey", "c_name")


@query(r"select p_partkey, p_brand || '_' || p_size || '%' as code from part where p_brand || '_' || p_size || '%' like '%#_1\_1%\%' escape '\'")
def like_escaped(spark, d):
    """Wildcards taken as they stand where they are escaped."""
    code = F.concat("p_brand", F.lit("_"), F.col("p_size").cast("string"), F.lit("%"))
    return t(spark, d, "part").select("p_partkey", code.alias("code")).filter(F.col("code").like(r"%#_1\_1%\%"))


@query("select event_type, count(*) as n from events where event_type <> 'view' and regexp_full_match(event_type, 'c.*|e.*') and not regexp_full_match(event_type, '.*r') group by 1")
def label_matchers(spark, d):
    e = t(spark, d, "events").withColumn("labels", F.create_map(F.lit("kind"), F.col("event_type")))
    return S.match_labels(e, unequal={"kind": "view"}, like={"kind": "c.*|e.*"}, unlike={"kind": ".*r"}).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f", {FAULTS_SQL} select id, table_name as \"table\", 'd' as op, seq as lsn, ms as source_ts_ms, amount::varchar as amount, true as restored from faults")
def dlq_roundtrip(spark, d):
    back = quarantine.from_payload(_faults(spark, d))
    return back.select("id", "table", F.col("op_").alias("op"), "lsn", "source_ts_ms", F.element_at("after", "amount").alias("amount"), "restored")


@query(""", m as (select seq, case seq % 7 when 0 then 'begin' when 1 then 'insert' when 2 then 'update' when 3 then 'delete' when 4 then 'snapshot_row' when 5 then 'commit' else 'truncate' end as kind, epoch_us(changed_at) // 1000 as ms from log)
select seq as lsn, case kind when 'insert' then 'c' when 'update' then 'u' when 'delete' then 'd' else 'r' end as op, kind in ('update', 'delete') as has_before, kind <> 'delete' as has_after, case kind when 'snapshot_row' then 0 else ms end::bigint as source_ts_ms
from m where kind in ('insert', 'update', 'delete', 'snapshot_row')""")
def message_decode(spark, d):
    x = log(spark, d)
    kinds = F.array(*[F.lit(k) for k in ("begin", "insert", "update", "delete", "snapshot_row", "commit", "truncate")])
    image = F.create_map(F.lit("id"), F.col("row_id").cast("string"))
    m = x.select(F.col("table_name").alias("table"), F.element_at(kinds, (F.col("seq") % 7 + 1).cast("int")).alias("kind"), image.alias("old"), image.alias("new"), F.col("seq").alias("lsn"), F.unix_millis(F.col("changed_at").cast("timestamp")).alias("sent_ms"))
    return changes.decode(m).select("lsn", "op", F.col("before").isNotNull().alias("has_before"), F.col("after").isNotNull().alias("has_after"), "source_ts_ms")


MESSAGES_SQL = "m as (select seq as lsn, case seq % 9 when 0 then 'begin' when 1 then 'insert' when 2 then 'update' when 3 then 'delete' when 4 then 'snapshot_row' when 5 then 'commit' when 6 then 'truncate' when 7 then 'garbage' end as kind, table_name from log)"


def _messages(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("begin", "insert", "update", "delete", "snapshot_row", "commit", "truncate", "garbage", None)])
    return log(spark, d).select(F.col("seq").alias("lsn"), F.element_at(kinds, (F.col("seq") % 9 + 1).cast("int")).alias("kind"), F.col("table_name").alias("table"))


@query(f""", {MESSAGES_SQL} select lsn, true as broken, '{{"kind":' || case when kind is null then 'null' else '"' || kind || '"' end || ',"table":"' || table_name || '","lsn":' || lsn || '}}' as raw from m where kind is null or kind = 'garbage'""")
def message_undecodable(spark, d):
    return changes.undecodable(_messages(spark, d))


@query(f", {MESSAGES_SQL} select max(lsn) as position, count(*) filter (where kind in ('insert', 'update', 'delete', 'snapshot_row')) as data, count(*) filter (where kind in ('begin', 'commit', 'truncate')) as silent, count(*) filter (where kind is null or kind = 'garbage') as undecodable from m")
def message_acknowledged(spark, d):
    return changes.acknowledged(_messages(spark, d))


@query(", p as (select distinct table_name as pipeline from log union all select 'gone') select pipeline, r.restart is not null as present, coalesce(r.restart, 0)::bigint as restart from p left join (select table_name, min(seq) as restart from log where seq > 3000 group by 1) r on r.table_name = p.pipeline")
def slot_states(spark, d):
    x = log(spark, d).select(F.col("table_name").alias("pipeline"), F.col("seq").alias("lsn"))
    named = x.select("pipeline").distinct().unionByName(spark.createDataFrame([("gone",)], "pipeline string"))
    return guard.slot_states(named, x.filter("lsn > 3000"))


@query("with p as (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 700 as page from orders where o_orderkey % 3 <> 1) select page, min(o_orderkey) as lo, max(o_orderkey) as hi, count(*) as rows from p group by page")
def keyset_pages(spark, d):
    return chunks.page_bounds(t(spark, d, "orders").filter("o_orderkey % 3 <> 1"), "o_orderkey", 700)


@query("select 'none' as which, 0.0::double as value union all select 'some', max(o_orderkey)::double from orders")
def or_zero(spark, d):
    o = t(spark, d, "orders").agg(F.max("o_orderkey").cast("double").alias("value"))
    return S.or_zero(o.filter("value < 0")).select(F.lit("none").alias("which"), "value").unionByName(S.or_zero(o).select(F.lit("some").alias("which"), "value"))


@query(f"select user_id, round(epoch_us(timestamp '{NOW}') / 1e6 - min(epoch_us(ts)) / 1e6, 6) as value from events group by user_id")
def uptime(spark, d):
    started = t(spark, d, "events").groupBy("user_id").agg((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6).alias("value"))
    return S.seconds_since(started, NOW).withColumn("value", F.round("value", 6))


@query(f"with b as (select user_id % 3 as pipeline, to_timestamp((epoch_us(ts) // 10000000 * 10)::double)::timestamp as beat_at from events) select pipeline, max(beat_at) as beat_at, date_diff('second', max(beat_at), timestamp '{NOW}')::bigint as age from b group by pipeline")
def heartbeat_state(spark, d):
    """One row a pipeline, rewritten by each beat (every ten seconds in which there was one)."""
    at = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 10) * 10).cast("timestamp_ntz")
    beats = t(spark, d, "events").select((F.col("user_id") % 3).alias("pipeline"), at.alias("beat_at")).distinct()
    rows = merge.last_arrival(None, beats.select("pipeline", F.unix_micros(F.col("beat_at").cast("timestamp")).alias("arrival"), F.lit("u").alias("op"), "beat_at"), "pipeline", ["beat_at"])
    return rows.withColumn("age", F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("beat_at").cast("timestamp")))


@query("""select 'wal_bytes_total' as name, sum(strlen(props))::double as value from events union all select 'connections', count(distinct user_id) from events
union all select 'wide_values', count(*) filter (where strlen(text) > 2000) from documents union all select 'wide_bytes', coalesce(sum(strlen(text)) filter (where strlen(text) > 2000), 0) from documents union all select 'database_bytes', sum(strlen(text)) from documents""")
def source_figures(spark, d):
    """What an exporter reads off a source: bytes of log and of tables, sessions, values too wide to stay in their row."""
    e, x = t(spark, d, "events"), t(spark, d, "documents")
    n = F.octet_length("text")
    a = e.agg(F.sum(F.octet_length("props")).alias("wal_bytes_total"), F.count_distinct("user_id").alias("connections"))
    b = x.agg(F.count_if(n > 2000).alias("wide_values"), F.coalesce(F.sum(F.when(n > 2000, n)), F.lit(0)).alias("wide_bytes"), F.sum(n).alias("database_bytes"))
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("r")).select("r.*")
    return long(a).unionByName(long(b))


@query(", x as (select seq, op, event_type, lag(event_type) over (partition by row_id order by seq) as pk, lag(seq) over (partition by row_id order by seq) as ps from log) select seq, case when ps is null then '' else array_to_string(list_filter([case when seq % 4 = 0 then 'amount' end, case when event_type is distinct from pk then 'kind' end], lambda z: z is not null), ',') end as changed from x")
def field_diff_one_sided(spark, d):
    """A field that only one image has counts as changed, be it null there."""
    x = changes_of(spark, d)
    drop = lambda m, names: F.map_filter(m, lambda k, _: ~k.isin(*names))
    null = F.create_map(F.lit("amount"), F.lit(None).cast("string"))
    after = F.when(F.col("seq") % 4 == 0, F.map_concat(drop(F.col("after"), ["amount"]), null)).otherwise(drop(F.col("after"), ["amount"]))
    f = diff.field_diff(drop(F.col("before"), ["amount"]), after, absent_is_null=False)
    return x.select("seq", F.array_join(f["changed"], ",").alias("changed"))


@query("select o_orderkey // 1000 as page, count(*) as rows, max(o_orderkey) as last from orders group by 1")
def chunk_totals(spark, d):
    return chunks.page_totals(t(spark, d, "orders"), "o_orderkey", 1000)


@query("select event_id, round((event_id % 1000 * 1000.0 - 400000.0) / 1e6, 6) as skew, abs((event_id % 1000 * 1000.0 - 400000.0) / 1e6) > 0.5 as skewed from events")
def clock_skew(spark, d):
    e = t(spark, d, "events").select("event_id")
    skew = skew_seconds(F.col("event_id") % 1000 * 1000, F.lit(300000), F.lit(500000))
    return e.select("event_id", F.round(skew, 6).alias("skew"), skewed(skew).alias("skewed"))


@query("select table_name as \"table\", op, count(*) as n from log where table_name in ('computer', 'grade', 'member') group by all")
def registered_counters(spark, d):
    return stream_metrics.counters(log(spark, d).withColumnRenamed("table_name", "table"), ["computer", "grade", "member"])


@query(f"select table_name as \"table\", round(max(greatest((epoch_us(timestamp '{NOW}') - epoch_us(changed_at) // 1000 * 1000) / 1e6, 0)), 3) as lag_max from log where seq % 4 <> 0 group by table_name")
def known_lags(spark, d):
    ms = F.when(F.col("seq") % 4 != 0, F.unix_millis(F.col("changed_at").cast("timestamp"))).otherwise(0)
    x = log(spark, d).withColumn("source_ts_ms", ms).withColumnRenamed("table_name", "table")
    return stream_metrics.lags(x, NOW).select("table", F.round("lag_max", 3).alias("lag_max"))


@query(f"select c_custkey as pipeline, date_diff('second', timestamp '2024-01-01 00:00:00' + to_seconds(c_custkey), timestamp '{NOW}')::bigint as stale from customer")
def checkpoint_staleness(spark, d):
    at = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("c_custkey")
    return t(spark, d, "customer").select(F.col("c_custkey").alias("pipeline"), (F.unix_seconds(F.lit(NOW).cast("timestamp")) - at).alias("stale"))


@query("select n_name, r_name, s_name from nation join region on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey")
def catalog_inner_joins(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "s_name")


@query("select seq from log where seq % 10 = 0 and seq not in (select seq from log where seq % 20 = 0)")
def expected_not_received(spark, d):
    x = log(spark, d).select("seq")
    return x.filter("seq % 10 = 0").exceptAll(x.filter("seq % 20 = 0"))


@query("select row_id, string_agg(op, '' order by seq) as ops, string_agg(op, '' order by seq)[-1:] as last_op from log group by row_id")
def key_histories(spark, d):
    h = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "op"))), lambda s: s["op"]), "")
    return log(spark, d).groupBy("row_id").agg(h.alias("ops")).withColumn("last_op", F.substring("ops", -1, 1))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    for module in MODULES:
        importlib.import_module(f"tidemark.{module}")
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
