"""Later cases: wrappers of pages, products of cells, very frequent rows, rows numbered for the mix."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import embeddings, html_text, minhash, mixing

BODY = "<p>The harbour was quiet that morning, and only two boats had gone out before the fog came down.</p><p>By noon it had lifted, and the market opened as on any other day of the week.</p>"
TEXT = "The harbour was quiet that morning, and only two boats had gone out before the fog came down.\n\nBy noon it had lifted, and the market opened as on any other day of the week."


@pytest.mark.parametrize(
    "page",
    [
        f'<div class="layout no-sidebar"><article>{BODY}</article></div>',
        f'<div id="with-sidebar"><main>{BODY}</main></div>',
        f'<article class="post has-comments">{BODY}</article>',
        f'<article class="page-sidebar">{BODY}</article>',
        f'<div class="left-sidebar"><div><article>{BODY}</article></div></div>',
        f'<div class="hide-banner"><article>{BODY}<div class="discussion"><p>I was there and saw no fog at all that day.</p></div></article></div>',
        f'<article>{BODY}<section id="respond"><p>Well told, thank you for writing this up for us.</p></section></article>',
        f'<article>{BODY}<div id="disqus"><p>I do not believe a word of this story, sorry.</p></div></article>',
        f'<article>{BODY}<div class="paid"><p>Our boats are the best boats, come and buy one now.</p></div></article>',
        f'<article>{BODY}<div class="user-comments"><p>We were at the market at noon, and it was shut.</p></div></article>',
        f'<div class="sidebar"><p>Read this other story about the harbour as well.</p></div><article>{BODY}</article>',
        f'<article>{BODY}</article><div class="comments"><article class="comment"><p>Nice story, I liked it a lot.</p></article></div>',
        f'<article>{BODY}</article><div class="left-sidebar"><p>More stories of the week for you to read here.</p></div>',
    ],
)
def test_wrappers_do_not_decide_for_an_article(page):
    assert html_text.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == TEXT


def rows_of_cells(spark, pivots):
    """Units of a made label with that many pivots, and products of each pair of sides."""
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(0, 20, 1200)] + 0.35 * rng.normal(size=(1200, 24))
    x /= np.sqrt((x * x).sum(1))[:, None]
    shared = spark.sparkContext.broadcast({24: embeddings._spread_out(x[: 4 * pivots], pivots)})
    rows = spark.createDataFrame([(i, "a", 24, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "id long, label string, dim int, n long, unit binary")
    placed = rows.mapInArrow(embeddings._cells(shared, float(np.sqrt(2 - 2 * 0.98))), "id long, label string, dim int, n long, unit binary, cell long, home boolean")
    units = embeddings._paired(placed, 100).groupBy("cell", "i", "j").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    return sum(r["a"] * (r["a"] if r["i"] == r["j"] else r["b"]) for r in units.collect()), placed.count()


def test_cells_take_fewer_products_than_all_pairs(spark):
    (eight, _), (many, copies) = rows_of_cells(spark, 8), rows_of_cells(spark, 32)
    assert copies > 1200  # there are copies
    assert eight < 1200 * 1200 and many < eight


def test_blocks_of_a_cell_find_all_links(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 300)] + 0.1 * rng.normal(size=(300, 8))
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.sqrt((x * x).sum(1))[:, None]
    near = (u @ u.T >= 0.98) & ~np.eye(300, dtype=bool)
    comp = list(range(300))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = comp[i], comp[j]
        if a != b:
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), comp[i]) for i in range(300)} and near.sum() > 1000


def test_a_row_in_a_third_of_all_stays_once(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = spark.range(1500).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(12)])).alias("text"), F.lit("x").alias("n"))
    out = minhash.keep_one(rows)
    assert out.columns == rows.columns and out.count() == 1001 and out.filter("doc_id is null").count() == 1


def test_two_rows_of_one_hash_are_told_apart(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (2, "h i j k l m n"), (3, "o p q r s t u")], "doc_id long, text string")
    whole = F.xxhash64
    # 1 and 2 get one hash as (doc_id, hash of the text); what is hashed otherwise stays
    monkeypatch.setattr(minhash.F, "xxhash64", lambda *c: F.when(F.col("doc_id") < 3, F.lit(7)).otherwise(whole(*c)) if isinstance(c[0], str) and c[0] == "doc_id" else whole(*c))
    got = minhash._vertices(rows).collect()
    assert len({r["__v"] for r in got}) == 3 and len({r["__v"] for r in got if r["doc_id"] == 2}) == 1


def test_equal_rows_without_id_share_no_task_in_the_mix(spark):
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 2 == 0, "a").alias("source"), F.lit(1).alias("copies"))
    plan = mixing.mix_plan(rows)
    out = mixing.mix(rows)
    assert out.columns == rows.columns and out.count() == plan.agg(F.sum("copies")).first()[0]
    by = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {r["source"]: r["n"] for r in plan.groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert by == want
