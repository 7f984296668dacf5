"""Stupid backoff for texts outside the corpus: counts as a table, joined to the exploded n-grams of other texts.

``count_tables`` gives every word, bigram and trigram of a corpus with its count, a row each, partitioned by the hash
of its words; it may be written and used again. ``score_texts`` explodes the n-grams of any texts and joins them to
the counts. A word scores by the longest context that the corpus knows it in: c(trigram) / c(first two words), else
``discount`` times c(bigram) / c(first word), else that squared times c(word) / N. The first two words of a text have
shorter contexts to begin with, and no discount for it. A word that is not in the corpus at all is discounted once
more, as if it stood there once. A text's score is the mean of the log10 over its words.

Words are runs of non-space bytes, A-Z lower-cased, told apart by 64-bit hashes; n-grams are told by all their words.
Each side of the large join has an n-gram once or is dealt by it; n-grams that make one in ``HOT`` of the texts' words
or more are joined by broadcast instead (at most three times ``HOT`` rows), so none is hot whichever corpus it meets.

Null and empty texts have no words and a null score, as all texts have against an empty corpus. A text of any length
is read whole. Equal rows get equal scores and are all given back. ``doc_id`` must be a number or null. Columns beside
doc_id and text are not read, whatever their names. No texts give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

HOT = 50_000
DISCOUNT = 0.4
GRAM = ["size", "a", "b", "c"]


def _exploded(batches):
    """(doc_id, key, text) to (doc_id, key, at, size, a, b, c): a row for each n-gram, at the place of its last word."""
    for b in batches:
        data, offsets = C.texts(b["text"])
        for i, j in C.runs(offsets):
            h, row, _, _ = C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], C.NOT_SPACE)
            h = h.view(np.int64)
            place = np.arange(len(h)) - np.searchsorted(row, row)
            for size in (1, 2, 3):
                at = np.flatnonzero(place >= size - 1)
                words = [h[at - k] if k < size else np.zeros(len(at), np.int64) for k in (2, 1, 0)]
                rows = pa.array(i + row[at])
                names = ["doc_id", "key", "at", *GRAM]
                yield pa.record_batch([b["doc_id"].take(rows), b["key"].take(rows), pa.array(place[at]), pa.array(np.full(len(at), size, np.int32)), *map(pa.array, words)], names)


def _grams(docs: DataFrame) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), "text")
    return keyed.mapInArrow(_exploded, "doc_id long, key long, at long, size int, a long, b long, c long")


def count_tables(docs: DataFrame) -> DataFrame:
    """size, a, b, c, n: each n-gram by the hashes of its words (0 before a short one's), with its count."""
    return _grams(docs).groupBy(*GRAM).agg(F.count(F.lit(1)).alias("n"))


def score_texts(model: DataFrame, texts: DataFrame, discount: float = DISCOUNT, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, score of texts against the counts of a corpus: one row a text."""
    total = model.filter("size = 1").agg(F.sum("n")).first()[0] or 0
    mine = count_tables(texts).withColumnRenamed("n", "m").join(model, GRAM, "left").select(*GRAM, "m", F.coalesce("n", F.lit(0)).alias("n"))
    mine = C.cut(mine)
    words = mine.filter("size = 1").agg(F.sum("m")).first()[0] or 0
    often = F.col("m") * hot >= words
    grams = _grams(texts).join(F.broadcast(mine.filter(often).drop("m").withColumnRenamed("n", "often")), GRAM, "left")
    found = grams.filter("often is not null").withColumnRenamed("often", "n")
    found = found.unionByName(grams.filter("often is null").drop("often").join(mine.filter(~often).drop("m"), GRAM))

    # an n-gram counts at its last word, and is the context of the word after it
    none = F.lit(None).cast("long")
    here = F.struct("at", "size", "n", none.alias("of"))
    after = F.struct((F.col("at") + 1).alias("at"), (F.col("size") + 1).alias("size"), none.alias("n"), F.col("n").alias("of"))
    uses = found.select("doc_id", "key", F.inline(F.array(here, after)))
    counts = [F.max(F.when(F.col("size") == k, F.col(c))).alias(f"{c}{k}") for c, k in (("n", 1), ("n", 2), ("n", 3), ("of", 2), ("of", 3))]
    by_word = uses.groupBy("doc_id", "key", "at").agg(*counts).filter("n1 is not null")  # copies of a row are one here
    longest = F.least(F.col("at") + 1, F.lit(3))
    fine = F.log10(F.lit(discount))
    known = F.when(F.col("n3") > 0, F.log10(F.col("n3") / F.col("of3"))).when(F.col("n2") > 0, (longest - 2) * fine + F.log10(F.col("n2") / F.col("of2")))
    value = known.when(F.col("n1") > 0, (longest - 1) * fine + F.log10(F.col("n1") / F.lit(total))).otherwise(longest * fine - F.log10(F.lit(total)))
    scored = by_word.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_words"), F.round(F.avg(value), 6).alias("score"))

    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key")).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    scored = scored.withColumnRenamed("doc_id", "id").withColumnRenamed("key", "k")
    out = rows.join(scored, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    out = out.select("doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), "score", F.explode(F.expr("sequence(1L, rows)")).alias("i"))
    return out.drop("i")


def oracle(corpus: str, texts: str, discount: float = DISCOUNT) -> str:
    """The same in SQL for DuckDB, of two tables or subqueries with doc_id and text."""
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
with t as (select doc_id, row_number() over () as r, {words} as w from {texts}),
ck as (select r, generate_subscripts(w, 1) as i, unnest(w) as w from (select row_number() over () as r, {words} as w from {corpus})),
cp as (select w, lag(w) over o as x, lag(w, 2) over o as y from ck window o as (partition by r order by i)),
c1 as (select w, count(*) as n from ck group by w),
c2 as (select x, w, count(*) as n from cp where x is not null group by all),
c3 as (select y, x, w, count(*) as n from cp where y is not null group by all),
k as (select r, generate_subscripts(w, 1) as i, unnest(w) as w from t),
p as (select r, i, w, lag(w) over o as x, lag(w, 2) over o as y, least(i, 3) as longest from k window o as (partition by r order by i)),
s as (select p.r, case when c3.n is not null then log10(c3.n / of_two.n)
                       when c2.n is not null then (longest - 2) * log10({discount}) + log10(c2.n / of_one.n)
                       when c1.n is not null then (longest - 1) * log10({discount}) + log10(c1.n / (select count(*) from ck))
                       else longest * log10({discount}) - log10((select count(*) from ck)) end as s
        from p left join c1 on c1.w = p.w left join c1 of_one on of_one.w = p.x left join c2 on c2.x = p.x and c2.w = p.w
        left join c2 of_two on of_two.x = p.y and of_two.w = p.x left join c3 on c3.y = p.y and c3.x = p.x and c3.w = p.w),
g as (select r, avg(s) as s from s group by r)
select doc_id, len(w)::bigint as n_words, case when len(w) > 0 then round(g.s, 6) end as score from t left join g using (r)
"""
