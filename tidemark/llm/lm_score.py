"""Operator 5: stupid-backoff scores of documents, computed relationally.

Words are runs of non-space bytes, A-Z lower-cased. Every word, bigram and trigram of the whole corpus counts,
whatever its number. A word scores log10(c(trigram) / c(its first two words)), the second of a text
log10(c(bigram) / c(first word)), the first log10(c / N); a document's score is the mean over its words. The
documents scored are the corpus counted, so each of their trigrams is seen and the backoff, which takes the next
shorter context for what is not, ends only at the beginning of a text. The first two words together give
log10(c(bigram) / N), so that words alone count in texts of one.

Each trigram is exploded into its two words as a 64-bit hash, its third as its number among the words that are at
least one in ``HOT`` of all (at most ``HOT``, broadcast) or else as another hash, and its document. These are shuffled once, packed by run of text, to the bucket of the two words'
hash, there being one for each ``ROWS`` words of the corpus: there a sort counts the trigram and its context at once,
and the gains are summed by document (each comes from as many buckets as it has words, at most). Contexts that are at
least one in ``HOT`` of all words, or that stand ``MOST`` times, are counted beforehand and broadcast (at most ``HOT``
and one for each ``MOST`` words of the corpus, 16 bytes each): their trigrams are shuffled by a hash of all three
words, or added where the text is if they are as frequent themselves. So no key has much more than ``MOST`` rows.

Those of a share are found by sums of counts by run of text: a run leaves out what it holds less than one in twice
``HOT`` times, so that no hot one falls below half its bound. Those of a number are found by drawing ``DRAWN`` places
in ``MOST`` at random, half as many draws being enough. All that pass are counted exactly, and one that is missed
only makes its bucket larger: results are the same whatever is hot.

Texts outside the corpus, with the discounted backoff that these then need, are scored by ``lm_model``, which keeps
the counts as a table and gives the same scores for texts of the corpus.

Null and empty texts have no words and a null score. A text of any length is read whole. Rows are told apart by a
hash of (doc_id, text); equal rows get equal scores and are all counted. Columns beside doc_id and text are not
read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

HOT = 50_000
#: Rows of a key that make it hot whatever its share, and draws expected of such a one.
MOST, DRAWN = 1 << 23, 64
RUN = 2 << 20
#: Bytes of text packed together, words of the corpus to a bucket of counts, and buckets at least.
PACK, ROWS, BUCKETS = 1 << 20, 3_000_000, 32
#: The number of a third word that is not a frequent one: its hash stands among the others.
OTHER = 65_535
#: The code under which all words are counted.
ALL = 0
#: What a row is: the end of a text (its context counts), a trigram, the beginning of a text, a trigram of a hot context.
END, INSIDE, BEGIN, WHOLE = range(4)


def _place(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


class _Grams:
    """The bigrams (odd codes) of some rows one after another, and of each the trigram it begins (even code)."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        h, row, _, _ = C.words(data, starts, C.NOT_SPACE)
        self.words = np.bincount(row, minlength=len(starts) - 1)
        at = np.flatnonzero(row[1:] == row[:-1])
        self.row = row[at]
        context = C.pair(h[at], h[at + 1]) | np.uint64(1)
        last = np.ones(len(at), bool)
        last[:-1] = at[1:] != at[:-1] + 1
        first = np.ones(len(at), bool)
        first[1:] = last[:-1]
        third = h[np.minimum(at + 2, max(len(h) - 1, 0))] if len(h) else h
        self.context, self.first, self.last = context.view(np.int64), first, last
        self.third = third
        self.whole = (C.pair(context, third) & ~np.uint64(1)).view(np.int64)

    def codes(self) -> np.ndarray:
        return np.concatenate([self.context, self.whole[~self.last]])


def _cut_up(column: pa.Array, most: int = RUN):
    """(rows from, rows to, their grams) of a batch's texts."""
    data, offsets = C.texts(column)
    for i, j in C.runs(offsets, most):
        yield i, j, _Grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _often(hot: int, most: int):
    """text to (code, n, drawn): all words under ALL, what a run holds often enough, and some drawn at random."""

    def run(batches):
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for b in batches:
            for _, _, g in _cut_up(b["text"]):
                codes = g.codes()
                u, n = np.unique(codes, return_counts=True)
                words = g.words.sum()
                some = n * 2 * hot >= words
                code, n = np.append(u[some], ALL), np.append(n[some], words)
                drawn = rng.choice(codes, rng.binomial(len(codes), min(1.0, DRAWN / most))) if len(codes) else codes
                zero, one = np.zeros(len(code), np.int64), np.ones(len(drawn), np.int64)
                cols = np.append(code, drawn), np.append(n, 0 * one), np.append(zero, one)
                yield pa.record_batch([pa.array(c) for c in cols], ["code", "n", "drawn"])

    return run


def _exact(table):
    """text to (code, n) of the codes in the table."""

    def run(batches):
        codes = table.value
        for b in batches:
            sums = np.zeros(len(codes), np.int64)
            for _, _, g in _cut_up(b["text"]):
                at, hit = _place(codes, g.codes())
                sums += np.bincount(at[hit], minlength=len(codes))
            some = np.flatnonzero(sums)
            yield pa.record_batch([pa.array(codes[some]), pa.array(sums[some])], ["code", "n"])

    return run


def _words(batches):
    """text to (word, n)."""
    for b in batches:
        data, offsets = C.texts(b["text"])
        for i, j in C.runs(offsets, 4 * RUN):
            h, _, _, _ = C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], C.NOT_SPACE)
            u, n = np.unique(h, return_counts=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(n)], ["word", "n"])


def _base(table):
    """(doc_id, key, text) to (doc_id, key, n_words, total, word): the sum without what is shuffled, and a text's only word."""

    def run(batches):
        codes, logs, log_all = table.value
        for b in batches:
            data, offsets = C.texts(b["text"])
            n_words, sums, only = np.zeros(len(b), np.int64), np.zeros(len(b)), np.zeros(len(b), np.int64)
            for i, j, g in _cut_up(b["text"]):
                n_words[i:j] = g.words
                at, hot = _place(codes, g.context)
                at_whole, hot_whole = _place(codes, g.whole)
                inside = hot & ~g.last
                gain = np.zeros(len(at))
                if len(codes):
                    gain = np.where(inside, np.where(hot_whole, logs[at_whole], 0.0) - logs[at], 0.0) + np.where(hot & g.first, logs[at], 0.0)
                sums[i:j] = np.bincount(g.row, gain, j - i)
                if (g.words == 1).any():
                    h, row, _, _ = C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], C.NOT_SPACE)
                    alone = g.words[row] == 1
                    only[i + row[alone]] = h[alone].view(np.int64)
            word = pa.array(only, mask=n_words != 1)
            yield pa.record_batch([b["doc_id"], b["key"], pa.array(n_words), pa.array(sums - log_all), word], ["doc_id", "key", "n_words", "total", "word"])

    return run


def _exploded(table, frequent, buckets: int):
    """(key, text) to (bucket, codes, thirds, others, whats, keys, times) of what is not broadcast: a row a run and bucket.

    Codes, thirds and whats hold a value for each trigram, others the hashes of third words without a number, keys and
    times the documents they are of, one after another.
    """

    def run(batches):
        codes, common = table.value[0], frequent.value
        for b in batches:
            keys = b["key"].to_numpy()
            for i, _, g in _cut_up(b["text"], PACK):
                hot = _place(codes, g.context)[1]
                whole = np.flatnonzero(hot & ~g.last & ~_place(codes, g.whole)[1])
                cold, begin = np.flatnonzero(~hot), np.flatnonzero(~hot & g.first)
                at = np.concatenate([cold, begin, whole])
                if not len(at):
                    continue
                code = np.concatenate([g.context[cold], g.context[begin], g.whole[whole]])
                third = np.concatenate([np.where(g.last[cold], np.uint64(0), g.third[cold]), np.zeros(len(begin) + len(whole), np.uint64)])
                what = np.concatenate([np.where(g.last[cold], END, INSIDE), np.full(len(begin), BEGIN), np.full(len(whole), WHOLE)]).astype(np.uint8)
                bucket = ((code.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                row = g.row[at]
                order = np.lexsort((row, bucket))
                code, third, what, row, bucket = code[order], third[order], what[order], row[order], bucket[order]
                number, known = _place(common, third)
                number = np.where(known | (what != INSIDE), number, OTHER).astype(np.uint16)
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                parts = []
                for lo, hi in zip(starts, np.append(starts[1:], len(code)), strict=True):
                    first = np.flatnonzero(np.diff(row[lo:hi], prepend=-1))
                    times = np.diff(np.append(first, hi - lo)).astype(np.int32)
                    others = third[lo:hi][number[lo:hi] == OTHER]
                    parts.append([x.tobytes() for x in (code[lo:hi], number[lo:hi], others, what[lo:hi], keys[i + row[lo + first]], times)])
                cols = zip(*parts, strict=True)
                yield pa.record_batch([pa.array(bucket[starts]), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "codes", "thirds", "others", "whats", "keys", "times"])

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """The values packed in the rows of a binary column, one after another."""
    parts = []
    for c in column.chunks:
        bounds = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        if bounds[-1] > bounds[0]:  # a column of empty values may have no bytes at all
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(kind))
    return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, kind), *parts])


def _thirds(packed: pa.Table) -> np.ndarray:
    """A number for the third word of each trigram of the bucket, equal for equal words only."""
    third = _joined(packed["thirds"], np.uint16).astype(np.int32)
    third[third == OTHER] += 1 + np.unique(_joined(packed["others"], np.uint64), return_inverse=True)[1].astype(np.int32)
    return third


def _counted(packed: pa.Table) -> pa.Table:
    """All rows of a bucket to (key, gain): each trigram and its context are counted here, and gains summed by document."""
    code, what, key, times = (_joined(packed[c], t) for c, t in (("codes", np.int64), ("whats", np.uint8), ("keys", np.int64), ("times", np.int32)))
    third = _thirds(packed)
    order = np.lexsort((third, code))
    code, third, what = code[order], third[order], what[order]
    new = np.diff(code, prepend=code[0] - 1) != 0
    run = np.cumsum(new, dtype=np.int32) - 1
    gain = np.log10(np.maximum(np.bincount(run, what != BEGIN), 1))[run]  # of the context
    new |= np.diff(third, prepend=third[0]) != 0
    del code, third
    run = np.cumsum(new, dtype=np.int32) - 1
    inside = what == INSIDE
    gain[what == END] = 0.0
    gain[inside] = np.log10(np.maximum(np.bincount(run, inside), 1))[run[inside]] - gain[inside]
    del run, new, inside, what
    keys, which = np.unique(key, return_inverse=True)
    document = np.repeat(which, times)[order]
    sums = np.bincount(document, gain, len(keys))
    some = np.flatnonzero(sums)
    return pa.table({"key": keys[some], "gain": sums[some]})


def score(docs: DataFrame, hot: int = HOT, rows: int = ROWS, most: int = MOST) -> DataFrame:
    """doc_id, n_words, score: one row a document. ``doc_id`` must be a number; a text as id is an error."""
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select("text")
    often = texts.mapInArrow(_often(hot, most), "code long, n long, drawn long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("drawn").alias("drawn"))
    often = C.cut(often)
    total = often.filter(F.col("code") == ALL).agg(F.sum("n")).first()[0] or 0
    # at most four times hot, and four for each most words
    maybe = often.filter((F.col("code") != ALL) & ((F.col("n") * (2 * hot) >= total) | (F.col("drawn") * 2 >= DRAWN)))
    maybe = send(np.sort(maybe.select("code").toArrow()["code"].to_numpy()))
    counts = texts.mapInArrow(_exact(maybe), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # at most twice hot, and two for each most words
    counts = counts.filter((F.col("n") * hot >= total) | (F.col("n") >= most)).toArrow().sort_by("code")
    table = send((counts["code"].to_numpy(), np.log10(counts["n"].to_numpy().astype(float)), float(np.log10(max(total, 1)))))

    words = C.cut(texts.mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # at most one in OTHER of all words, so no more than OTHER of them
    frequent = words.filter(F.col("n") * min(hot, OTHER) >= total).select("word").toArrow()
    frequent = send(np.sort(frequent["word"].to_numpy().view(np.uint64)))

    # equal rows have equal keys
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", F.xxhash64("text")).alias("key"), "text")
    grams = keyed.select("key", "text").mapInArrow(_exploded(table, frequent, max(BUCKETS, int(total // rows + 1))), "bucket long, codes binary, thirds binary, others binary, whats binary, keys binary, times binary")
    grams = grams.groupBy("bucket").applyInArrow(_counted, "key long, gain double")
    # a row's own gains are summed once for each equal row, and shared out again
    more = grams.groupBy("key").agg(F.sum("gain").alias("more"))

    base = C.cut(keyed.mapInArrow(_base(table), "doc_id long, key long, n_words long, total double, word long"))
    alone = base.filter("word is not null").select("word").distinct()
    alone = words.join(alone, "word").select("word", F.log10("n").alias("log_n"))
    base = base.groupBy("doc_id", "key", "n_words", "word").agg(F.first("total").alias("total"), F.count(F.lit(1)).alias("rows"))
    out = base.join(more, "key", "left").join(alone, "word", "left")
    whole = F.col("total") + F.coalesce(F.col("more") / F.col("rows"), F.lit(0.0)) + F.coalesce("log_n", F.lit(0.0))
    out = out.withColumn("value", F.when(F.col("n_words") > 0, F.round(whole / F.col("n_words"), 6)))
    return out.withColumn("i", F.explode(F.expr("sequence(1L, rows)"))).select("doc_id", "n_words", F.col("value").alias("score"))


ORACLE = r"""
with t as (select doc_id, row_number() over () as r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
k as (select r, generate_subscripts(w, 1) as i, unnest(w) as w from t),
p as (select r, i, w, lag(w) over o as x, lag(w, 2) over o as y from k window o as (partition by r order by i)),
c1 as (select w, count(*) as n from k group by w),
c2 as (select x, w, count(*) as n from p where x is not null group by all),
c3 as (select y, x, w, count(*) as n from p where y is not null group by all),
s as (select p.r, case when p.y is not null then log10(c3.n / of_two.n) when p.x is not null then log10(c2.n / of_one.n) else log10(c1.n / (select count(*) from k)) end as s
        from p join c1 on c1.w = p.w left join c1 of_one on of_one.w = p.x left join c2 on c2.x = p.x and c2.w = p.w
        left join c2 of_two on of_two.x = p.y and of_two.w = p.x left join c3 on c3.y = p.y and c3.x = p.x and c3.w = p.w),
g as (select r, sum(s) as s from s group by r)
select doc_id, len(w)::bigint as n_words, case when len(w) > 0 then round(g.s / len(w), 6) end as score from t left join g using (r)
"""
