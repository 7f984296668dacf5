"""Operator 4: removal of repeated byte strings by distributed prefix doubling over sparse positions.

A byte is removed if a string of ``least`` bytes that covers it starts anywhere else in the corpus as
well. Prefix doubling ranks positions by growing prefixes and drops those that have become unique. Positions are
thinned before the first rank: of every h + 1 neighbouring prefixes of h = least / 2 bytes the one with the
smallest fingerprint is the anchor (the leftmost of equals), so equal strings of ``least`` bytes have the same
anchor at the same place, and every start belongs to one anchor.

1. Doubling: anchors are ranked by their first h / 2 bytes, then by pairs of that rank and the next h / 2, and so
   by h bytes. Each round counts the pairs, drops those of a single anchor with all its starts, and Spark
   sorts the others by ranges: their places in that order are the new ranks.
2. The next pair is of the rank and all that an anchor's starts reach, up to 2 * least bytes: anchors that are
   equal over the whole stretch make all their starts repeated; one of each such class stands for it from here on.
3. The other starts in steps of ``STEP``: a step whose common core (least - STEP + 1 bytes) is unique has
   no repeated start; one whose whole stretch is repeated has only repeated ones.
4. Single starts of the steps left, at ``least`` bytes, past which nothing is compared.

What no rank covers yet is compared by 64-bit fingerprints, of which only equality counts. Pairs are counted by
map-side partial sums, each is sorted once however many anchors have it, and ranks are joined back on equal keys,
so a passage that stands in a third of all documents is no hot spot. Each document's spans meet its text once. Null and empty texts
and those shorter than ``least`` keep everything; repeated rows are occurrences of their own; rows are
told apart by (doc_id, hash of the text), and equal rows get equal results. Matches never cross
documents. A very long text is handled whole, in one piece. Columns beside doc_id and
text are not read; ``remove_repeated`` gives them back under any names. An empty table gives an empty result. A
text of which the rest is not valid UTF-8 is decoded leaving the broken characters out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common as C

LEAST = 400
STEP = 25


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(x)
    if n < w:
        return x[:0]
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(-1, w)
    left = np.minimum.accumulate(grid, 1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _anchors(least: int):
    """Batches of (doc_id, th, text) to (doc_id, th, start, width, back, near, next, whole): one row an anchor.

    Its starts are start .. start + width, the anchor stands back bytes after the first of them; near and next
    are fingerprints of the two halves of its prefix.
    """
    half = least // 2
    near = half // 2

    def run(batches):
        for b in batches:
            data, offsets = C.texts(b["text"])
            out, at = [], []
            for i, j in C.runs(offsets):
                d = data[offsets[i] : offsets[j]]
                st = (offsets[i : j + 1] - offsets[i]).astype(np.int64)
                n = len(d)
                if n < least:
                    continue
                h, down = C.prefix_hash(d)
                gram = C.mix((h[half:] - h[:-half]) * down[: n - half + 1])
                coded = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
                anchor = (_window_min(coded, half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
                anchor = anchor[: n - least + 1]
                size = np.diff(st)
                row = np.repeat(np.arange(j - i), size)[: len(anchor)]
                ok = np.arange(len(anchor)) + least <= st[1:][row]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                change = np.flatnonzero(new | np.concatenate([[False], ok[1:] != ok[:-1]]))
                end = np.append(change[1:], len(anchor)) - 1
                use = ok[change]
                s, e = change[use], end[use]
                if not len(s):
                    continue
                a = anchor[s]
                shape = ((a - s).astype(np.uint64) << np.uint64(32)) | (e - s).astype(np.uint64)
                whole = C.pair(C.mix((h[e + least] - h[s]) * down[s]), shape)
                r = row[s]
                at.append(r + i)
                first, second = (C.mix((h[a + y] - h[a + x]) * down[a + x]).view(np.int64) for x, y in ((0, near), (near, half)))
                out.append(np.stack([(s - st[r]), e - s, a - s, first, second, whole.view(np.int64)]))
            if not out:
                continue
            at, out = pa.array(np.concatenate(at)), np.concatenate(out, 1)
            cols = [b["doc_id"].take(at), b["th"].take(at)]
            cols += [pa.array(x.astype(np.int32)) for x in out[:3]] + [pa.array(x) for x in out[3:]]
            yield pa.record_batch(cols, ["doc_id", "th", "start", "width", "back", "near", "next", "whole"])

    return run


def _reranked(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows whose pair in by is shared, with its place among all shared pairs instead of it."""
    shared = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by)
    # a table of its own, so that the join may split a pair that is very common
    order = C.cut(shared.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))
    out = C.cut(rows.join(order, by).drop(*by))
    C.drop(order)
    return out


def _contexts(least: int, step: int):
    """Documents with their listed anchors to rows of steps: the ranks of the core, the stretch and each start.

    A step holds the starts from hi to lo bytes before the anchor (hi >= lo), those of them that exist.
    """

    def steps(d: np.ndarray, s, e, a, half, times) -> list[np.ndarray]:
        """first, back, half, times, k, core, stretch of each step, then sizes and ranks of its starts."""
        h, down = C.prefix_hash(d)

        def rank(lo, hi):
            return C.mix((h[hi] - h[lo]) * down[lo])

        count = (a - s) // step - (a - e) // step + 1
        at = np.repeat(np.arange(len(s)), count)
        k = (a - e)[at] // step + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        first, last = np.maximum(s[at], a[at] - (k + 1) * step + 1), np.minimum(e[at], a[at] - k * step)
        core = rank(a[at] - k * step, a[at] - (k + 1) * step + 1 + least)
        shape = ((a[at] - first) << 16 | (last - first)).astype(np.uint64)
        stretch = C.pair(rank(first, last + least), shape)
        n = last - first + 1
        p = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return [first, a[at] - first, half[at], times[at], k, core.view(np.int64), stretch.view(np.int64), n, rank(p, p + least).view(np.int64)]

    def run(batches):
        codec = pa.Codec("zstd")
        for b in batches:
            listed = b["anchors"]
            bounds = np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy())])
            flat = listed.flatten()
            start, width, back, half, times = (flat.field(f).to_numpy().astype(np.int64) for f in ("start", "width", "back", "half", "times"))
            rows, made, held = [], [], 0
            for r in range(len(b)):
                d = np.frombuffer(C.unpack(codec, b["packed"][r], b["n_bytes"][r].as_py()), np.uint8)
                x = slice(bounds[r], bounds[r + 1])
                made.append(steps(d, start[x], start[x] + width[x], start[x] + back[x], half[x], times[x]))
                rows.append(np.full(len(made[-1][0]), r))
                held += len(made[-1][0])
                if held >= 4096 or r == len(b) - 1:
                    cols = [np.concatenate(c) for c in zip(*made, strict=True)]
                    at = pa.array(np.concatenate(rows))
                    ranks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(cols[7])]).astype(np.int32)), pa.array(cols[8]))
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), b["th"].take(at), *[pa.array(c) for c in cols[:7]], ranks], names=_STEP_NAMES)
                    rows, made, held = [], [], 0

    return run


_STEP_NAMES = ["doc_id", "th", "first", "back", "half", "times", "k", "core", "stretch", "starts"]
_STEP_SCHEMA = "doc_id long, th long, first long, back long, half long, times long, k long, core long, stretch long, starts array<long>"


def repeated_spans(docs: DataFrame, least: int = LEAST, step: int = STEP) -> DataFrame:
    """doc_id, th, lo, hi: byte ranges whose union is what repeats; rows keyed by (doc_id, hash of the text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    every = C.cut(keyed.mapInArrow(_anchors(least), "doc_id long, th long, start int, width int, back int, near long, next long, whole long"))
    begun = _reranked(every, ["near"], "rank")
    C.drop(every)
    found = _reranked(begun, ["rank", "next"], "half")
    C.drop(begun)
    one = F.struct("doc_id", "th", "start", "width", "back")
    classes = C.cut(found.groupBy("half", "whole").agg(F.count(F.lit(1)).alias("times"), F.min(one).alias("one")))
    sure = found.join(classes.filter("times > 1").select("half", "whole"), ["half", "whole"])
    spans = sure.select("doc_id", "th", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("width") + least).cast("long").alias("hi"))
    # anchors that are not decided, and one of each decided class that they may share starts with
    open_halves = classes.filter("times = 1").select("half").distinct()
    left = classes.join(open_halves, "half", "left_semi").select("half", F.least("times", F.lit(2)).alias("times"), "one.*")
    left = left.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "width", "back", "half", "times")).alias("anchors"))
    left = left.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "anchors")
    # one row of each (doc_id, th) is enough: equal rows have equal bytes
    texts = keyed.mapInArrow(C.pack, "doc_id long, th long, packed binary, n_bytes long")
    texts = texts.join(left, texts["doc_id"].eqNullSafe(left["r_id"]) & (texts["th"] == left["r_th"])).drop("r_id", "r_th")
    single = texts.dropDuplicates(["doc_id", "th"])
    every = C.cut(single.mapInArrow(_contexts(least, step), _STEP_SCHEMA))
    core = C.cut(every.groupBy("half", "k", "core").agg(F.sum("times").alias("c"), F.min("times").alias("open")).filter("c > 1 and open = 1").select("half", "k", "core"))
    open_steps = C.cut(every.join(core, ["half", "k", "core"]))
    C.drop(every, core)
    stretch = C.cut(open_steps.groupBy("half", "k", "stretch").agg(F.sum("times").alias("s")).filter("s > 1"))
    steps = open_steps.join(stretch, ["half", "k", "stretch"], "left").withColumn("s", F.coalesce("s", F.lit(1)))
    n = F.size("starts")
    # a stretch that is repeated: all its starts are
    sure = steps.filter("times = 1 and s > 1").select("doc_id", "th", F.col("first").alias("lo"), (F.col("first") + n - 1 + least).alias("hi"))
    single = steps.select("doc_id", "th", "first", "back", "half", "times", "s", F.posexplode("starts").alias("i", "rank"))
    single = single.withColumn("off", F.col("back") - F.col("i"))
    counts = C.cut(single.groupBy("half", "off", "rank").agg(F.sum("times").alias("c")).filter("c > 1").select("half", "off", "rank"))
    last = single.filter("times = 1 and s = 1").join(counts, ["half", "off", "rank"])
    last = last.select("doc_id", "th", (F.col("first") + F.col("i")).alias("lo"), (F.col("first") + F.col("i") + least).alias("hi"))
    out = C.cut(spans.unionByName(sure).unionByName(last).distinct())
    C.drop(found, classes, open_steps, stretch, counts)
    return out


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _kept(packed, size: int, spans, codec) -> tuple[bytes, list[tuple[int, int]]]:
    raw, at, parts = C.unpack(codec, packed, size), 0, []
    runs = _merged((x["lo"], x["hi"]) for x in spans) if spans else []
    for lo, hi in runs:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]]), runs


def _digests(batches):
    codec = pa.Codec("zstd")
    for b in batches:
        rows = []
        for r in range(len(b)):
            size = b["n_bytes"][r].as_py()
            kept, runs = _kept(b["packed"][r], size, b["spans"][r].as_py(), codec)
            rows.append((b["doc_id"][r].as_py(), size, size - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rest(batches):
    """Batches of (columns, packed, n_bytes, spans) to the columns with the text that is left."""
    codec = pa.Codec("zstd")
    for b in batches:
        kept = [_kept(b["packed"][r], b["n_bytes"][r].as_py(), b["spans"][r].as_py(), codec)[0].decode("utf-8", "ignore") if b["packed"][r].is_valid else None for r in range(len(b))]
        names = [n for n in b.schema.names if n not in ("packed", "n_bytes", "spans")]
        yield pa.RecordBatch.from_arrays([*[b[n] for n in names], pa.array(kept, pa.string())], names=[*names, "__text"])


def _by_document(spans: DataFrame) -> DataFrame:
    """Spans gathered by document; there are at most as many as a text has bytes, and most are merged first."""
    return spans.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def removal(docs: DataFrame, least: int = LEAST, step: int = STEP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document."""
    found = _by_document(repeated_spans(docs, least, step))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    packed = keyed.mapInArrow(C.pack, "doc_id long, th long, packed binary, n_bytes long")
    joined = packed.join(found, packed["doc_id"].eqNullSafe(found["r_id"]) & (packed["th"] == found["r_th"]), "left")
    out = joined.select("doc_id", "packed", "n_bytes", "spans")
    return out.mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeated(docs: DataFrame, least: int = LEAST, step: int = STEP) -> DataFrame:
    """The documents with what is left of each text, and all their other columns."""
    docs, order, own = C.plain_names(docs, ["doc_id", "text"])
    spans = _by_document(repeated_spans(docs, least, step))
    keyed = docs.withColumn("__th", F.xxhash64("text"))
    names = [n for n in keyed.columns if n != "text"]
    fields = {f.name: f for f in keyed.schema.fields}
    packed = keyed.select(*names, "text").mapInArrow(C.pack, T.StructType([*[fields[n] for n in names], T.StructField("packed", T.BinaryType()), T.StructField("n_bytes", T.LongType())]))
    joined = packed.join(spans, packed["doc_id"].eqNullSafe(spans["r_id"]) & (packed["__th"] == spans["r_th"]), "left").drop("r_id", "r_th")
    out = joined.mapInArrow(_rest, T.StructType([*[fields[n] for n in names], T.StructField("__text", T.StringType())]))
    return out.select(*[F.col("__text").alias("text") if n == "text" else F.col(n) for n in order]).toDF(*own)
