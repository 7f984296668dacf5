"""Whitening, vector codes and exact duplicates: against numpy, brute force and on odd input."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import codes, exact, queries, whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    """Columns of names that are used inside stand beside."""
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("dim", "x", "n", "code", "error", "node", "component", "k"):
        df = df.withColumn(name, F.lit("extra"))
    return df


def whitened_by_numpy(rows):
    """(vec_id, x) to n, deviation and whitened of all rows, shares of the variance."""
    x = np.array([v for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e / e.sum()


def same_as_numpy(got, rows):
    n, deviation, white, share = whitened_by_numpy(rows)
    k = min(16, white.shape[1])
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r)
    assert sorted(by) == list(range(1, k + 1))
    for c in range(k):
        mine = {r["vec_id"]: r for r in by[c + 1]}
        assert len(by[c + 1]) == len(rows)
        w = np.array([mine[i]["whitened"] for i, _ in rows])
        sign = np.sign(w[np.abs(w).argmax()] * white[np.abs(w).argmax(), c])
        assert np.allclose(w * sign, white[:, c], atol=1e-8)
        assert all(mine[i]["n"] == n and mine[i]["deviation"] == int(d) for (i, _), d in zip(rows, deviation, strict=True))
        assert abs(mine[rows[0][0]]["explained"] / share[c] - 1) < 1e-9 and mine[rows[0][0]]["identity_error"] < 1e-9


def test_whitening_same_as_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], [math.floor(64 * float(c)) + 1_000_000 for c in r["embedding"]]) for r in table.collect()]
    same_as_numpy(queries.op11_embedding_whitening(spark, SF).collect(), rows)


def test_merged_states_equal_one(spark):
    """Many partitions of very different means, merged over several levels."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1 + abs(m), (40, 6)) for m in range(-3, 4)]).astype(np.float32)
    rows = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in enumerate(x)]
    made = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], VECTORS)
    for partitions in (1, 100):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            got = whitening.whiten(made).collect()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        same_as_numpy(got, rows)


def test_odd_vectors_are_whitened(spark):
    bad = [(1, None, 0), (2, [0.5, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 1), (5, [], 1)]
    good = [(6, [0.1, 0.2], 0), (6, [0.1, 0.2], 0), (None, [0.4, -0.9], None), (8, [1.0, 0.3], 1), (9, [0.1, 0.2], 1)]
    lone = [(10, [1.0, 2.0, 3.0], 0), (11, [1.0, 2.0, 3.0], 0), (12, [1e30, -1e30, 0.0, 1.0], 0), (13, [0.0, 0.0, 0.0, 1.0], 0)]
    got = whitening.whiten(vectors(spark, bad + good + lone)).collect()
    two = [r for r in got if r["vec_id"] in (6, None, 8, 9)]
    assert len(two) == 10 and {r["n"] for r in two} == {3} and {r["component"] for r in two} == {1, 2}
    alone = [r for r in got if r["vec_id"] in (10, 11)]
    assert len(alone) == 6 and all(r["whitened"] == 0 and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] == 0 for r in alone)
    assert not any(r["vec_id"] in (1, 2, 3, 4, 5) for r in got)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0


def test_exponion_same_as_all_entries_and_fewer():
    rng = np.random.default_rng(5)
    book = rng.integers(-900, 900, (16, 8))
    book[7], book[3] = book[12], book[12]  # equal entries: the lowest index is nearest
    x = np.concatenate([book[rng.integers(0, 16, 600)] + rng.integers(-60, 60, (600, 8)), rng.integers(-2000, 2000, (200, 8)), book])
    d = ((x[:, None, :] - book[None]) ** 2).sum(2)
    before = d.argmin(1)
    before[::7] = rng.integers(0, 16, len(before[::7]))
    compared: list[int] = []
    code, error = codes.exponion(x, before, book, compared)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    assert sum(compared) < len(x) * 15 / 2


def coded_by_force(rows, rounds=6):
    """vec_id to (code, error), and the codebooks' digest."""
    rows = sorted(rows)
    x = np.array([v for _, v in rows], object).reshape(len(rows), 8, -1)
    book = x[:16].transpose(1, 0, 2).copy()
    for n in range(rounds + 1):
        d = ((x[:, :, None, :] - book[None]) ** 2).sum(3).astype(np.int64)
        code = d.argmin(2)
        for p in range(8):
            for k in range(book.shape[1]):
                mine = x[code[:, p] == k, p]
                if len(mine) and n < rounds:
                    book[p, k] = [int(s) // len(mine) for s in mine.sum(0)]
    text = ",".join(str(int(v)) for v in book.ravel())
    return {i: ("".join(f"{c:02x}" for c in code[r]), int(d[r].min(1).sum())) for r, (i, _) in enumerate(rows)}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("count", [5, 16, 300])
def test_codes_same_as_brute_force(spark, count):
    rng = np.random.default_rng(count)
    x = rng.normal(0, 0.4, (count, 16)).astype(np.float32)
    x[count // 2 :] = x[: count - count // 2]  # equal vectors, and ties
    rows = [(i * 3, [float(c) for c in v], None if i % 3 == 0 else i % 2) for i, v in enumerate(x)]
    want, sha = coded_by_force([(i, [math.floor(4096 * c) for c in v]) for i, v, _ in rows])
    got = codes.compress(vectors(spark, rows).repartition(7)).collect()
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want and {r["codebooks_sha256"] for r in got} == {sha}
    for label in (None, 0, 1):
        ids = [i for i, _, at in rows if at == label]
        assert {r["label_error"] for r in got if r["vec_id"] in ids} == ({sum(want[i][1] for i in ids)} if ids else set())


def test_odd_vectors_are_coded(spark):
    odd = [(1, None, 0), (2, [0.5] * 7 + [None], 0), (3, [float("nan")] * 8, 0), (4, [float("inf")] * 8, 1), (5, [], 1), (6, [0.1] * 9, 1), (7, [1e30] * 8, 0)]
    rows = [*odd, (None, [0.2] * 8, None), (9, [0.3] * 8, None), (9, [0.3] * 8, 1), (10, [0.1] * 16, 2)]
    by = {}
    for r in codes.compress(vectors(spark, rows)).collect():
        by.setdefault(r["vec_id"], []).append(r)
    assert sorted(by, key=str) == sorted([5, 6, 7, None, 9, 10], key=str) and len(by[9]) == 2
    assert all(by[i][0]["code"] is None and by[i][0]["error"] is None for i in (5, 6, 7)) and by[7][0]["label_error"] is None
    # the two equal vectors are entries 0 and 1, the one without id is the last
    assert {r["code"] for r in by[9]} == {"00" * 8} and by[None][0]["code"] == "02" * 8 and by[10][0]["code"] == "00" * 8
    assert codes.compress(spark.createDataFrame([], VECTORS)).count() == 0


def test_exact_duplicates_on_odd_rows(spark):
    long = "Grüße AN alle " * 30_000
    rows = [(1, None), (2, ""), (3, long), (4, long.replace("AN", "an")), (5, long + "x"), (6, long + "y"), (None, "a"), (None, "A"), (None, "b"), (7, "A"), (8, "b "), (9, "c"), (9, "C"), (10, "É"), (11, "é"), (12, "same start " * 10 + "1"), (13, "same start " * 10 + "2"), (None, "n1"), (None, "N1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("bytes", "row", "open", "stays", "whole", "kept", "n", "begins"):
        df = df.withColumn(name, F.lit("extra"))
    for most in (exact.BROADCAST_BYTES, 0):  # keys broadcast, and keys joined
        got = exact.duplicates(df, digest=True, most=most).collect()
        assert len(got) == len(rows) and sum(r["kept"] for r in got) == 13
        by = {(r["doc_id"], r["text_sha256"]): r for r in got}
        sha = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("", "a", "b", "c", "n1", "É")}
        assert by[1, sha[""]]["keep_id"] == 2 and by[1, sha[""]]["group_size"] == 2
        assert by[None, sha["a"]]["keep_id"] == 7 and by[7, sha["a"]]["group_size"] == 3 and not by[None, sha["a"]]["kept"]
        assert by[None, sha["b"]]["kept"] and by[None, sha["b"]]["group_size"] == 1
        assert sorted(r["kept"] for r in got if r["text_sha256"] == sha["c"]) == [False, True]
        assert sorted((r["kept"], r["keep_id"]) for r in got if r["text_sha256"] == sha["n1"]) == [(False, None), (True, None)]
        assert by[10, sha["É"]]["group_size"] == 1
        kept = exact.deduplicate(df, most)
        assert kept.columns == df.columns
        rest = kept.collect()
        assert len(rest) == 13 and all(r["row"] == r["kept"] == r["whole"] == "extra" for r in rest)
        assert {r["doc_id"] for r in rest if r["text"] and len(r["text"]) > 1000} == {4, 5, 6}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact.duplicates(empty, digest=True).count() == 0 and exact.deduplicate(empty).count() == 0


def test_a_text_in_a_third_of_all_rows(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Often").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    got = exact.duplicates(docs).filter("group_size > 1")
    assert got.count() == 2000 and got.filter("kept").collect()[0]["doc_id"] == 5997
