"""Operator 10: toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A text has
the features w, (w, next) and (w, next but one), hashed to 2**bits places, each counted once. Learning is
bounded: of the labelled rows that may be learned from, those with the smallest hashes of doc_id, about
``max_rows`` of them, are turned into feature lists on the executors and read by one task in hash order
for ``epochs`` rounds of FTRL-proximal with per-coordinate rates. L1 leaves few weights; only those
(never more than 2**bits) reach the driver and are broadcast.

Texts that are null or empty have the bias alone and get its score. A null doc_id is neither learned
from nor held out; labels that are null or not 0/1 are ignored; a doc_id labelled twice is learned from
twice, and repeated rows as often as they stand; equal hashes are ordered by label, then by length. Texts of any
length are scored whole. Columns beside doc_id and text are not read; ``drop_toxic`` gives them back under any
names. Empty documents give an empty result. With no label to learn from, every weight is 0, every score 0.5 less
a little (0.49).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

BITS = 20
MAX_ROWS = 16000
EPOCHS = 6
ALPHA, BETA, L2 = 2.0, 1.0, 0.05
#: L1 is this times the root of the number of rows learned from, so that chance words stay out at any size.
L1_RATE = 0.05
SKIP = np.uint64(0x5851F42D4C957F2D)


def _features(data: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) of each feature occurrence of the rows."""
    w, row, _, _ = C.words(data, starts, C.ALNUM)
    same1 = row[1:] == row[:-1]
    same2 = row[2:] == row[:-2]
    places = np.concatenate([w, C.pair(w[:-1], w[1:])[same1], C.pair(w[:-2] ^ SKIP, w[2:])[same2]])
    rows = np.concatenate([row, row[1:][same1], row[2:][same2]])
    return (places >> np.uint64(64 - bits)).astype(np.int64), rows


def _lists(bits: int):
    """Batches of (h, toxic, text) to (h, toxic, places)."""

    def run(batches):
        for b in batches:
            data, offsets = C.texts(b["text"])
            lists = []
            for i, j in C.runs(offsets):
                place, row = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                key = np.unique(row << bits | place)
                cuts = np.searchsorted(key, np.arange(1, j - i) << bits)
                lists += [x.astype(np.int32) for x in np.split(key & ((1 << bits) - 1), cuts)]
            yield pa.record_batch([b["h"], b["toxic"], pa.array(lists, pa.list_(pa.int32()))], ["h", "toxic", "places"])

    return run


def _fit(bits: int, epochs: int, alpha: float, beta: float, l1_rate: float, l2: float):
    """The rows of one task, in hash order, to (place, weight); the bias has place 2**bits."""

    def run(batches):
        rows = [(h, y, np.array(p, np.int64)) for b in batches for h, y, p in zip(b["h"].to_pylist(), b["toxic"].to_pylist(), b["places"].to_numpy(zero_copy_only=False), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1], len(r[2])))
        size = (1 << bits) + 1
        z, n = np.zeros(size), np.zeros(size)
        l1 = l1_rate * np.sqrt(len(rows))
        for _ in range(epochs):
            for _, y, p in rows:
                i = np.append(p, size - 1)
                zi, ni = z[i], n[i]
                root = np.sqrt(ni)
                bound = np.full(len(i), l1)
                bound[-1] = 0.0
                w = np.where(np.abs(zi) <= bound, 0.0, -(zi - np.sign(zi) * bound) / ((beta + root) / alpha + l2))
                g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
                now = ni + g * g
                z[i] = zi + g - (np.sqrt(now) - root) / alpha * w
                n[i] = now
        bound = np.full(size, l1)
        bound[-1] = 0.0
        w = np.where(np.abs(z) <= bound, 0.0, -(z - np.sign(z) * bound) / ((beta + np.sqrt(n)) / alpha + l2))
        if not rows:
            w[-1] = np.log(0.49 / 0.51)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["place", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, bits: int = BITS, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """(place, weight) of the weights that are not zero."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & (C.crc_mod("doc_id", folds) != held_out)).select(F.col("doc_id").alias("l_doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.withColumn("h", F.xxhash64(F.col("l_doc_id"), F.lit(10)))
    # the smallest hashes: a share of the hash range that holds about max_rows
    total = marked.count()
    top = -(1 << 63) + int((1 << 64) * min(1.0, max_rows / max(total, 1))) - 1
    marked = marked.filter(F.col("h") <= top)
    joined = docs.select("doc_id", "text").join(marked, F.col("doc_id") == F.col("l_doc_id")).select("h", "toxic", "text")
    lists = joined.mapInArrow(_lists(bits), "h long, toxic int, places array<int>")
    return lists.repartition(1).mapInArrow(_fit(bits, epochs, ALPHA, BETA, L1_RATE, L2), "place long, weight double")


def _scorer(model, bits: int, text_at: str):
    """Batches to the same with a score column."""

    def run(batches):
        place, weight = model.value
        table = np.zeros((1 << bits) + 1)
        table[place] = weight
        for b in batches:
            data, offsets = C.texts(b[text_at])
            total = np.full(len(b), table[-1])
            for i, j in C.runs(offsets):
                at, row = _features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                hit = np.flatnonzero(table[at])
                key = np.unique(row[hit] << bits | at[hit])
                total[i:j] += np.bincount(key >> bits, table[key & ((1 << bits) - 1)], j - i)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "__score"])

    return run


def score(docs: DataFrame, model: DataFrame, bits: int = BITS) -> DataFrame:
    """docs with one more column, __score."""
    rows = model.collect()  # at most 2**bits + 1 weights
    value = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(value)
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(_scorer(shared, bits, "text"), schema)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kept = docs.select("doc_id", "text")
    out = score(kept, train(docs, labels, **options))
    return out.select(
        "doc_id", F.coalesce(C.crc_mod("doc_id", options.get("folds", 5)) == options.get("held_out", 0), F.lit(False)).alias("held_out"),
        F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    docs, names, own = C.plain_names(docs, ["doc_id", "text"])
    return score(docs, train(docs, labels, **options)).filter("__score < 0.5").select(*names).toDF(*own)
