"""Trees of digests and keys found from values."""

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark import queries as M
from tidemark.operators import digests, inclusion
from tidemark.operators.reconcile import key_reconcile


def test_a_tree_goes_down_only_where_sides_differ(spark, tmp_path):
    def written(df):
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.coalesce(1).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    source = spark.range(-500, 20_000).withColumn("v", F.col("id") * 3)
    target = source.filter("id not in (7, 9001) and id <> 15000").withColumn("v", F.when(F.col("id").between(9000, 9003), 0).otherwise(F.col("v"))).unionByName(spark.range(30_000, 30_001).withColumn("v", F.lit(1).cast("long")))
    plain = lambda df: {(r["id"], r["state"]) for r in df.collect()}
    found, told = digests.tree_reconcile(source, target, "id", ["id", "v"], written, leaf=100, fan=4)
    assert plain(found) == plain(key_reconcile(source, target, "id", ["id", "v"])) and (30_000, "extra") in plain(found)
    assert told["leaves"] == 4 and told["source_rows"] == 300  # of 20,500
    widths = [w for w, _ in told["levels"]]
    assert widths == sorted(widths, reverse=True) and widths[-1] == 1 and all(n <= 4 * 5 for _, n in told["levels"])
    same, told = digests.tree_reconcile(source, source, "id", ["id", "v"], written, leaf=100, fan=4)
    assert same.count() == 0 and told["leaves"] == 0 and told["source_rows"] == 0
    none = source.limit(0)
    assert digests.tree_reconcile(none, none, "id", ["id", "v"], written)[0].count() == 0
    assert plain(digests.tree_reconcile(none, source.limit(2), "id", ["id", "v"], written)[0]) == {(-500, "extra"), (-499, "extra")}


def test_inclusions_need_every_value_in_a_unique_column(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "a_id long, a_x int")
    b = spark.createDataFrame([(1, 9), (1, 9), (3, 8)], "b_id long, b_y int")
    c = spark.createDataFrame([(1, "t"), (4, "u")], "c_id long, c_t string")
    got = {(r["child"], r["parent"]): r["share"] for r in inclusion.inclusions({"a": a, "b": b, "c": c}).collect()}
    assert got == {("b.b_id", "a.a_id"): 2 / 3}
    assert [(r["child"], r["parent"]) for r in inclusion.foreign_keys({"a": a, "b": b, "c": c}).collect()] == [("b.b_id", "a.a_id")]


def test_keys_of_the_given_tables(spark):
    from conftest import SF

    found = {(r["child"], r["parent"]) for r in M.queries()["foreign_key_discovery"](spark, SF).collect()}
    assert found == {("nation.n_regionkey", "region.r_regionkey"), ("customer.c_nationkey", "nation.n_nationkey"), ("supplier.s_nationkey", "nation.n_nationkey"), ("orders.o_custkey", "customer.c_custkey"), ("lineitem.l_orderkey", "orders.o_orderkey"), ("lineitem.l_partkey", "part.p_partkey"), ("lineitem.l_suppkey", "supplier.s_suppkey")}


def test_a_checksum_is_taken_up_range_by_range(spark, tmp_path, monkeypatch):
    """A table of many ranges has the checksum of its one string, which is never made."""
    import hashlib

    from tidemark.operators import reconcile

    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("ä"), F.col("id"))).alias("v"))
    line = {r["id"]: f"{r['id']}|{r['v'] or ''}" for r in df.collect()}
    want = hashlib.md5(",".join(line[k] for k in sorted(line)).encode()).hexdigest()
    monkeypatch.setattr(reconcile, "ordered_checksum", lambda *a: pytest.fail("one string"))
    for most in (2_000, 30_000):
        got = reconcile.chained_checksum(df, ["id", "v"], "id", f"file://{tmp_path}", most).first()
        assert (got["n"], got["checksum"]) == (5000, want)
    twice = df.filter("id < 900").select("id", F.explode(F.array(F.lit("b"), F.lit("a"))).alias("v"))  # keys that stand twice go by their text
    got = reconcile.chained_checksum(twice, ["id", "v"], "id", f"file://{tmp_path}", 1_000).first()
    assert got["checksum"] == hashlib.md5(",".join(f"{k}|{v}" for k in range(900) for v in "ab").encode()).hexdigest()
    x = df.withColumn("v", F.when(F.col("id") == 4321, "x").otherwise(F.col("v")))
    sides = reconcile.both_sides({"t": (df, x, ["id", "v"]), "u": (df, df, ["id", "v"])}, f"file://{tmp_path}", 20_000)
    assert {r["table_name"]: r["verdict"] for r in sides.collect()} == {"t": "values", "u": "equal"}


def test_md5_is_put_down_and_taken_up():
    import hashlib
    import random

    from tidemark.functions import md5

    r = random.Random(3)
    for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 1000):
        text = r.randbytes(size)
        for update in (md5.update, md5.update_plain, lambda s, b: r.choice([md5.update, md5.update_plain])(s, b)):
            state, i = md5.START, 0
            while i < size:
                j = i + r.randrange(1, 90)
                state, i = update(state, text[i:j]), j
            assert len(state) == 92 and md5.hexdigest(state) == hashlib.md5(text).hexdigest() == md5.hexdigest(state, md5.update)
