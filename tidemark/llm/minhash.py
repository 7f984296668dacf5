"""Operator 6: near-duplicates by banded MinHash with sequential Bayesian verification.

A document's set holds the distinct hashes (64 bit) of its ``shingle``-word shingles, words being runs of
non-space bytes with A-Z lower-cased; a text of fewer words has its whole sequence as one. Equal sets
are collapsed first, whatever their number. Of the rest, signatures of at most ``MINIMA`` minima are cut
into bands (as many, and as wide, as the threshold asks for); in each bucket of two or more, every member is compared with a centre (the member that
collides most), and then, only where that leaves a bucket in several components, members of different
components are compared block by block inside workers, which verify survivors there and hand on links
that join components, never candidates. Buckets that share members form one unit of that work, so that
a document is sent once; units of over ``UNIT`` members are taken bucket by bucket instead. A pair is
compared a batch of minima at a time and given up once the posterior probability that its similarity
reaches the threshold falls below ``MISS``; every survivor is verified on the full sets.

Empty and null texts have no shingle and link with nothing. Rows sharing a doc_id are one vertex; rows
without doc_id link with nothing, are kept and have a null component. Ties cannot matter: components do
not depend on which links span them. Texts of any length are read whole; columns beside doc_id and text are not
read, and ``keep_one`` gives them back under any names. A bucket of very many members is joined in slices. An
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.graph import components

#: Most minima of a signature, and the chance that a pair at the threshold shares no band.
MINIMA = 128
MISS_BANDS = 1e-6
#: Minima compared at a time, and the chance of giving up a pair at the threshold.
BATCH = 24
MISS = 1e-7
#: Members of a block, of which two at a time meet in a worker, and of a unit.
BLOCK = 512
UNIT = 32 * BLOCK


def _sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the rows one after another, and where each row starts."""
    w, row, _, _ = C.words(data, starts, C.NOT_SPACE)
    n_rows = len(starts) - 1
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    h = w
    for d in range(1, k):
        h = C.pair(h[: len(w) - d], w[d:]) if len(w) > d else np.zeros(0, np.uint64)
    whole = {int(r): w[first[r] : first[r + 1]] for r in np.flatnonzero((count > 0) & (count < k))}
    parts, sizes = [], np.zeros(n_rows, np.int64)
    for r in np.flatnonzero(count):
        if r in whole:
            x = whole[r][:1]
            for y in whole[r][1:]:
                x = C.pair(x, np.array([y]))
            u = C.mix(x + np.uint64(len(whole[r])))
        else:
            u = np.unique(h[first[r] : first[r + 1] - k + 1])
        parts.append(u)
        sizes[r] = len(u)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _signatures(hashes: np.ndarray, starts: np.ndarray, size: int, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and their minima (rows x size)."""
    some = np.flatnonzero(np.diff(starts))
    out = np.empty((len(some), size), np.uint64)
    if len(some):
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, size, np.uint64)
        at = starts[some]
        for i in range(size):
            out[:, i] = np.minimum.reduceat(hashes * a[i] + b[i], at)
    return some, out


def _banded(k: int, bands: int, rows: int):
    """Batches of (doc_id, text) to (doc_id, n_shingles, k1, k2, bands)."""

    def run(batches):
        for b in batches:
            data, offsets = C.texts(b["text"])
            n = np.zeros(len(b), np.int64)
            keys = np.zeros((2, len(b)), np.int64)
            bucket = np.zeros((len(b), bands), np.int64)
            for i, j in C.runs(offsets):
                u, st = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n[i:j] = np.diff(st)
                some, sig = _signatures(u, st, bands * rows)
                if not len(some):
                    continue
                keys[0, i + some] = np.add.reduceat(C.mix(u), st[some]).view(np.int64)
                keys[1, i + some] = np.add.reduceat(C.mix(u ^ np.uint64(0x5555555555555555)), st[some]).view(np.int64)
                for x in range(bands):
                    h = np.full(len(some), x + 1, np.uint64)
                    for y in range(rows):
                        h = C.pair(h, sig[:, x * rows + y])
                    bucket[i + some, x] = h.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * bands), pa.array(bucket.ravel()))
            yield pa.record_batch([b["doc_id"], pa.array(n), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _full(k: int, bands: int, rows: int):
    """Batches of (id, packed text) to (id, sig, hashes), both binary."""

    def run(batches):
        for b in batches:
            data, offsets = C.unpacked(b["packed"], b["n_bytes"])
            ids = b["id"].to_numpy()
            for i, j in C.runs(offsets):
                u, st = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                some, sig = _signatures(u, st, bands * rows)
                short = (sig >> np.uint64(32)).astype(np.uint32)
                yield pa.record_batch(
                    [pa.array(ids[i:j][some]), pa.array([x.tobytes() for x in short], pa.binary()), pa.array([u[st[r] : st[r + 1]].tobytes() for r in some], pa.binary())],
                    ["id", "sig", "hashes"],
                )

    return run


def banding(threshold: float, minima: int = MINIMA, miss: float = MISS_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which few enough bands keep that chance."""
    for rows in range(12, 0, -1):
        bands = int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))
        if bands * rows <= minima:
            return bands, rows
    return minima, 1


def least_matches(threshold: float, size: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(minima compared, least matches to go on) after each batch, by the posterior under a flat prior."""
    x = (np.arange(200_000) + 0.5) / 200_000
    lx, ly = np.log(x), np.log1p(-x)
    out = []
    for n in [*range(batch, size, batch), size]:
        for m in range(n + 1):
            d = m * lx + (n - m) * ly
            d = np.exp(d - d.max())
            if d[x >= threshold].sum() >= miss * d.sum():
                out.append((n, m))
                break
    return out


def _verify(percent: int, steps: list[tuple[int, int]]):
    """Batches of pairs with both signatures and sets to the pairs that are similar enough."""

    def run(batches):
        for b in batches:
            keep = []
            for r in range(len(b)):
                s, t = (np.frombuffer(b[c][r].as_buffer(), np.uint32) for c in ("sig_a", "sig_b"))
                same = s == t
                if any(int(same[:n].sum()) < m for n, m in steps):
                    continue
                x, y = (np.frombuffer(b[c][r].as_buffer(), np.uint64) for c in ("hashes_a", "hashes_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(r)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b["a"].take(at), b["b"].take(at)], ["a", "b"])

    return run


def _blocks(percent: int, steps: list[tuple[int, int]]):
    """The members of one pair of blocks to links that join their components."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, ids, comp, n = (table[c].to_numpy().copy() for c in ("block", "id", "comp", "n_hashes"))
        sig = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in table["sig"].combine_chunks()])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"].combine_chunks()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b = [], []
        for x in left:
            y = right[(comp[right] != comp[x]) & ((right > x) | (i != j))]
            y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
            done, match = 0, np.zeros(len(y), np.int64)
            for size, least in steps:
                match = match + (sig[y, done:size] == sig[x, done:size]).sum(1)
                on = match >= least
                y, match, done = y[on], match[on], size
            a = sets[x]
            for k in y[np.argsort(-match, kind="stable")]:
                if comp[k] == comp[x]:  # joined meanwhile
                    continue
                b = sets[k]
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    found_a.append(ids[x])
                    found_b.append(ids[k])
                    comp[comp == comp[k]] = comp[x]
        a, b = np.array(found_a, np.int64), np.array(found_b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, minima: int = MINIMA, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    bands, rows = banding(percent / 100, minima)
    steps = least_matches(percent / 100, bands * rows, BATCH, miss)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = C.cut(source.mapInArrow(_banded(shingle, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"))
    vertices = base.filter("n_shingles > 0 and doc_id is not null")
    least = vertices.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    same = vertices.join(least.filter("n > 1"), ["k1", "k2"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = vertices.join(least.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"]).select(F.col("doc_id").alias("id"), "bands")

    # buckets of two or more, one of each set of members
    spread = reps.select("id", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")).filter("n > 1")
    sizes = C.cut(sizes.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    member = C.cut(spread.join(sizes, "bucket"))
    weight = member.groupBy("id").agg(F.sum("n").alias("weight"))
    member = member.join(weight, "id")
    centre = member.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("less"))).alias("c"), F.first("n").alias("n")).select("bucket", (-F.col("c.less")).alias("centre"), "n")
    pairs = C.join_sliced(member, centre, "bucket", "n", "id").filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    pairs = C.cut(pairs)

    # full sets of the documents that are compared at all; texts are packed for the shuffle, which is the
    # plan at every size (broadcasting the ids would only do for few)
    wanted = member.select("id").distinct().hint("merge")
    full = source.select(F.col("doc_id").alias("id"), "text").mapInArrow(C.pack, "id long, packed binary, n_bytes long").join(wanted, "id")
    full = C.cut(full.mapInArrow(_full(shingle, bands, rows), "id long, sig binary, hashes binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        a = full.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.col("hashes").alias("hashes_a"))
        b = full.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"), F.col("hashes").alias("hashes_b"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_verify(percent, steps), "a long, b long")

    links = C.cut(verified(pairs).unionByName(same))
    joined = C.cut(components(links))

    # buckets that are still in several components: compare across them, unit by unit
    label = joined.select("id", F.col("component").alias("comp"))
    member = member.select("bucket", "id", "n").filter("n > 2").join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.first("n").alias("n")).filter("lo <> hi").select("bucket", "n")
    member = C.cut(C.join_sliced(member, mixed, "bucket", "n", "id").select("bucket", "id", "comp", "n"))
    near = member.groupBy("bucket").agg(F.min("id").alias("first"), F.first("n").alias("n"))
    near = components(C.join_sliced(member, near, "bucket", "n", "id").select(F.col("id").alias("a"), F.col("first").alias("b")))
    near = C.cut(near.join(near.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component"))
    member = member.drop("n").join(near, "id")
    small = member.filter(F.col("size") <= UNIT).select(F.lit(0).alias("kind"), F.col("component").alias("unit"), "id", "comp", "size").distinct()
    large = member.filter(F.col("size") > UNIT)
    counts = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket"))
    large = large.join(counts, "bucket").select(F.lit(1).alias("kind"), F.col("bucket").alias("unit"), "id", "comp", F.col("in_bucket").alias("size"))
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    work = small.unionByName(large).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    work = work.select("kind", "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "comp")
    work = work.join(full.select("id", "sig", "hashes", (F.octet_length("hashes") / 8).cast("long").alias("n_hashes")), "id")
    more = C.cut(work.groupBy("kind", "unit", "i", "j").applyInArrow(_blocks(percent, steps), "a long, b long"))
    if not more.isEmpty():
        joined = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = base.select("doc_id", "n_shingles").join(joined.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def _vertices(docs: DataFrame) -> DataFrame:
    """docs with ``__v``, a number for each different (doc_id, text): their hash, or where two have one hash another."""
    keys = "doc_id", F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    rows = docs.withColumn("__v", F.xxhash64(*keys[:2]))
    each = rows.select("__v", F.struct(*keys).alias("key")).groupBy("__v").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    shared = C.cut(each.filter(~F.col("lo").eqNullSafe(F.col("hi"))).select(F.col("__v").alias("__clash")))
    if shared.isEmpty():  # three are expected in 10^10 rows
        return rows
    rows = rows.join(shared, F.col("__v") == F.col("__clash"), "left")
    return rows.withColumn("__v", F.when(F.col("__clash").isNull(), F.col("__v")).otherwise(F.xxhash64(F.lit(2), *keys))).drop("__clash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of which one of each group stays, with all their columns.

    Here the vertex is the row, told by (doc_id, text): rows that share an id but not the text are judged
    apart, null ids take part, and of rows equal in both one stays. Of a group the row of the smallest
    doc_id stays, null last. Rows without words all stay.
    """
    docs, names, own = C.plain_names(docs, ["doc_id", "text"])
    rows = _vertices(docs)
    found = near_duplicates(rows.select(F.col("__v").alias("doc_id"), "text"), **options)
    member = C.cut(found.filter("n_shingles > 0").groupBy(F.col("doc_id").alias("v"), F.col("component_id").alias("c")).agg(F.count(F.lit(1)).alias("n")))
    groups = member.groupBy("c").agg(F.sum("n").alias("rows")).filter("rows > 1").select("c")
    member = member.join(groups, "c").select("v", "c", "n")
    ids = rows.select(F.col("__v").alias("v"), "doc_id").distinct()
    first = member.join(ids, "v").groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("f"))
    judged = member.join(first.select(F.col("c"), F.col("f.v").alias("first")), "c")
    judged = C.cut(judged.select(F.col("v").alias("__at"), (F.col("v") == F.col("first")).alias("__first"), "n"))
    # one merge on the row's key, whose large parts are split
    out = rows.join(judged.hint("merge"), F.col("__v") == F.col("__at"), "left").filter("__first is null or (__first and n = 1)")
    # rows that are equal: one of each, by partial sums, so that however many there are a task hands on one
    same = rows.join(judged.filter("__first and n > 1").hint("merge"), F.col("__v") == F.col("__at")).dropDuplicates(["__v"])
    return out.select(*names).unionByName(same.select(*names)).toDF(*own)


ORACLE = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 or w is null then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as g from t),
n as (select doc_id, len(g)::bigint as n_shingles from s),
e as (select doc_id, unnest(g) as g from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as both from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i.both >= 85 * (x.n_shingles + y.n_shingles - i.both)),
u as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from u union select r.a, u.b from r join u on r.b = u.a),
c as (select a, least(a, min(b)) as m from r group by a)
select n.doc_id, n.n_shingles, coalesce(c.m, n.doc_id) as component_id, n.doc_id = coalesce(c.m, n.doc_id) as kept from n left join c on c.a = n.doc_id
"""
