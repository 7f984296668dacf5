"""The guarded merge against a sequential simulator."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.operators import merge


def simulate(stored, events):
    rows = {k: list(v) for k, v in stored.items()}
    for key, _, op, lsn, v in sorted(events, key=lambda e: e[1]):
        now = rows.get(key)
        if op == "d":
            if now is not None and now[2] < lsn:
                now[1], now[2] = True, lsn
        elif now is None or lsn > now[2]:
            rows[key] = [v, False, lsn]
    return {k: tuple(v) for k, v in rows.items()}


def run(spark, stored, events):
    e = spark.createDataFrame(events, "id long, arrival long, op string, lsn long, v long")
    s = spark.createDataFrame([(k, *v) for k, v in stored.items()], "id long, v long, deleted boolean, source_lsn long")
    return {r["id"]: (r["v"], r["deleted"], r["source_lsn"]) for r in merge.guarded(e, "id", ["v"], s).collect()}


def test_shuffled_log(spark):
    rng = random.Random(4)
    events = [(rng.randrange(300), i, rng.choice("cuud"), rng.randrange(1, 5000), rng.choice([None, i])) for i in range(4000)]
    stored = {k: (k, k % 7 == 0, rng.randrange(1, 4000)) for k in range(0, 400, 2)}
    assert run(spark, stored, events) == simulate(stored, events)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from("cud"), st.integers(1, 9)), min_size=1, max_size=20))
def test_small_logs(spark, log):
    events = [(k, i, op, lsn, i) for i, (k, op, lsn) in enumerate(log)]
    stored = {0: (100, False, 4), 1: (101, True, 6)}
    assert run(spark, stored, events) == simulate(stored, events)


def test_in_order_form_agrees(spark):
    rng = random.Random(9)
    events = [(rng.randrange(50), i, rng.choice("cud"), i + 1, i) for i in range(600)]
    e = spark.createDataFrame(events, "id long, arrival long, op string, lsn long, v long")
    got = {r["id"]: (r["v"], r["deleted"], r["source_lsn"]) for r in merge.guarded_in_order(e, "id", ["v"]).collect()}
    assert got == simulate({}, events)


def test_replay_applies_nothing(spark):
    events = [(k, k, "u", k + 10, k) for k in range(200)]
    e = spark.createDataFrame(events, "id long, arrival long, op string, lsn long, v long")
    state = merge.guarded(e, "id", ["v"])
    assert merge.applied(e, "id").count() == 200
    assert merge.applied(e, "id", state).count() == 0


def test_checkpoint_only_moves_forward():
    assert merge.advanced(None, 5) == 5 and merge.advanced(9, 5) == 9 and merge.advanced(5, 9) == 9
