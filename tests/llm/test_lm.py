"""Language-model scores of texts outside the corpus, and of very frequent contexts."""

import numpy as np
import pytest
from conftest import SF, duck
from pyspark.sql import functions as F

from tidemark.llm import lm_model, lm_score


def same(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)

    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and (a[2] == b[2] or a[2] == pytest.approx(b[2], abs=2e-6)), (a, b)


@pytest.mark.parametrize("hot", [10, 50_000])
def test_texts_outside_the_corpus_as_sql_scores_them(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = lm_model.score_texts(lm_model.count_tables(docs.filter(~held)), docs.filter(held), hot=hot).collect()
    ids = ", ".join(str(r[0]) for r in docs.filter(held).select("doc_id").collect())
    sql = lm_model.oracle(f"(select * from documents where doc_id not in ({ids}))", f"(select * from documents where doc_id in ({ids}))")
    rows, names = duck(sql)
    assert names == ["doc_id", "n_words", "score"]
    same([tuple(r) for r in got], [(int(float(i)), int(float(n)), None if s == "None" else float(s)) for i, n, s in rows])


def test_texts_of_the_corpus_score_as_the_query_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(5))
    same([tuple(r) for r in lm_model.score_texts(lm_model.count_tables(docs), docs).collect()], [tuple(r) for r in lm_score.score(docs).collect()])


def test_backoff_by_hand(spark):
    corpus = spark.createDataFrame([(1, "a b c a b d")], "doc_id long, text string")
    texts = spark.createDataFrame([(1, "A b c"), (2, "x a b"), (3, "b c d"), (4, "z"), (5, None), (6, " "), (None, "a b"), (None, "a b")], "doc_id long, text string").withColumn("at", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["doc_id"]: r["score"] for r in lm_model.score_texts(lm_model.count_tables(corpus), texts).collect()}
    lg, d = np.log10, 0.4
    assert got[1] == pytest.approx((lg(2 / 6) + lg(2 / 2) + lg(1 / 2)) / 3, abs=1e-6)
    assert got[2] == pytest.approx((lg(d / 6) + lg(d * 2 / 6) + lg(d * 2 / 2)) / 3, abs=1e-6)
    assert got[3] == pytest.approx((lg(2 / 6) + lg(1 / 2) + lg(d * d * 1 / 6)) / 3, abs=1e-6)
    assert got[4] == pytest.approx(lg(d / 6), abs=1e-6) and got[5] is None and got[6] is None
    assert got[None] == pytest.approx((lg(2 / 6) + lg(1)) / 2, abs=1e-6)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    got = lm_model.score_texts(lm_model.count_tables(none), some).collect()
    assert [tuple(r) for r in got] == [(1, 2, None)] * 2
    assert lm_model.score_texts(lm_model.count_tables(some), none).count() == 0


@pytest.mark.parametrize("most", [5, 200])
def test_contexts_of_many_rows_are_shared_out(spark, most):
    # a share so small that only the absolute bound finds anything
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**6, "of the " * 3000 + "end", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    same([tuple(r) for r in lm_score.score(docs, 1, 10_000, most).collect()], [tuple(r) for r in lm_score.score(docs).collect()])


def test_third_words_are_told_apart_by_all_their_bits(spark):
    # 300,000 continuations of one context: some pairs of them agree in 32 bits of their hashes
    docs = spark.createDataFrame([(i, " ".join(f"a b w{k}" for k in range(i * 3000, i * 3000 + 3000))) for i in range(100)], "doc_id long, text string")
    got = lm_score.score(docs, hot=1).collect()
    n = 900_000
    a, b, w, ctx = np.log10(300_000 / n), 0.0, np.log10(1 / 300_000), 0.0
    # a text: a, then b after a, then (a b w) 3000 times, (b w a) and (w a b) 2999 times each
    want = (a + b + 3000 * w + 2999 * ctx) / 9000
    inside = [r["score"] for r in got]
    assert all(s == pytest.approx(inside[0], abs=1e-6) for s in inside) and inside[0] == pytest.approx(want, abs=1e-6)
