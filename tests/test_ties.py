"""Changes of one key that arrive at once: the log's arrivals repeat after 104,729 positions."""

import random

import duckdb
import pytest
from conftest import collected, duck
from pyspark.sql import functions as F
from test_scan import guarded_one_by_one

from tidemark import queries as M
from tidemark.operators import merge


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Events of 40 users, three at each arrival, two of which are the same user's; the newest stand first in the file."""
    d = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    kind = "case event_id * 31 % 7 when 0 then 'signup' when 1 then 'error' when 2 then 'error' else 'view' end"
    con.execute(f"copy (select *, {kind} as event_type, event_id % 1000 / 4 as value, '' as props from (select i + 104729 * block as event_id, timestamp '2024-01-01' + to_seconds(i + 104729 * block) as ts, case block when 2 then i * 7 % 40 else i % 40 end as user_id from range(600) r(i), range(3) b(block)) order by event_id desc) to '{d}/events.parquet'")
    for name in "region nation customer supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        con.execute(f"copy (select * from '/root/testdata/sf0.001/{name}.parquet') to '{d}/{name}.parquet'")
    return str(d)


@pytest.mark.parametrize("span", [None, 7, 1 << 16])
def test_equal_arrivals_go_by_position(spark, span):
    r = random.Random(8)
    events = [(r.randrange(20), r.randrange(30), r.choice("cuud"), lsn, lsn * 10) for lsn in range(600, 0, -1)]
    want, _ = guarded_one_by_one(sorted(events, key=lambda e: e[3]), {})  # its own sort by arrival keeps that order
    df = spark.createDataFrame(events, "k int, arrival long, op string, lsn long, v int").coalesce(1)
    assert {r["k"]: (r["source_lsn"], r["deleted"], r["v"]) for r in merge.guarded(df, "k", ["v"], span=span).collect()} == want
    rising = merge.applied(df, "k", span=span).groupBy("k", "arrival").agg(F.count(F.lit(1)).alias("n"))
    assert rising.filter("n > 1").count() > 0  # several of one arrival pass, the lower first


def test_guarded_merge_replay_with_ties(spark, tied):
    assert collected(M.queries()["guarded_merge_replay"](spark, tied)) == duck(M.oracle_sql()["guarded_merge_replay"], tied)


def test_guard_accepted_with_ties(spark, tied):
    got = collected(M.queries()["guard_accepted"](spark, tied))
    assert got == duck(M.oracle_sql()["guard_accepted"], tied)


def test_guard_accepted_hot_key_with_ties(spark, tied):
    assert collected(M.queries()["guard_accepted_hot_key"](spark, tied)) == duck(M.oracle_sql()["guard_accepted_hot_key"], tied)


def test_guarded_hot_key_with_ties(spark, tied):
    assert collected(M.queries()["guarded_hot_key"](spark, tied)) == duck(M.oracle_sql()["guarded_hot_key"], tied)


def test_guarded_stream_takes_the_log_twice(spark, tied):
    assert collected(M.queries()["guarded_stream"](spark, tied)) == duck(M.oracle_sql()["guarded_stream"], tied)


@pytest.mark.parametrize("odd", ["no key", "one position", "both"])
def test_guard_accepted_with_rows_without_key_and_several_changes_of_a_position(spark, tied, tmp_path, odd):
    con = duckdb.connect()
    user = "case when event_id % 5 = 0 then null else user_id end" if odd != "one position" else "user_id"
    again = "['signup', 'error', 'view']" if odd != "no key" else "[event_type]"  # each event comes as all three, in any order
    con.execute(f"copy (select event_id, ts, {user} as user_id, event_type, value, props from (select * exclude (event_type), unnest({again}) as event_type from '{tied}/events.parquet') order by hash(event_id, event_type)) to '{tmp_path}/events.parquet'")
    con.execute(f"copy (select * from '{tied}/customer.parquet') to '{tmp_path}/customer.parquet'")
    for name in "region nation supplier part orders lineitem documents embeddings pages benchmark labels conversations".split():
        (tmp_path / f"{name}.parquet").symlink_to(f"{tied}/{name}.parquet")
    want = duck(M.oracle_sql()["guard_accepted"], str(tmp_path))
    assert collected(M.queries()["guard_accepted"](spark, str(tmp_path))) == want
    assert any(r[-1] == "None" for r in want[0]) == (odd != "one position")
