"""Operator 2: exact near-duplicates among embeddings by a metric range join.

On unit vectors cosine >= c is Euclidean distance <= r with r^2 = 2 - 2c. Pivots, spread out over a
bounded sample, partition the vectors of a label into cells (nearest pivot). By the triangle inequality
a vector of cell i can be that near to one of cell j only if it lies within r of the plane between the
two pivots: (d(x, pj)^2 - d(x, pi)^2) / (2 d(pi, pj)) <= r. It is then copied to cell j (only for j > i, so
that each pair meets once), and cells join independently, with double-precision matrix products: the vectors at
home in a cell with each other and with the copies, never copies with copies. A cell of more than ``BLOCK`` rows is
joined by pairs of blocks. Workers hand on a count and one spanning link a row, never pairs. There is a pivot for
each ``BLOCK`` vectors of the largest label, as far as ``PIVOT_BYTES`` of them go (8,192 of 512 components): up to
there a cell has about ``BLOCK`` rows of its own, past it their number grows in proportion. Copies come on top: how
many depends on how near the planes between pivots the vectors lie.

Equal vectors of a label are collapsed first, whatever their number. Vectors that are null, empty, zero
or hold null or non-finite components, and those without label or vec_id, link with nothing (without
vec_id: kept, null component). Vectors of different length never link. Repeated rows are separate
vectors of one vertex; equal distances to pivots go to the first. Columns beside vec_id, embedding and label are
not read, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.graph import components

COSINE = 0.98
BLOCK = 2048
#: Bytes of pivots at most, which are broadcast, and vectors to choose each among; and distances held at once.
PIVOT_BYTES, CHOICE, CELLS = 32 << 20, 4, 1 << 20


def _units(batches):
    """(vec_id, embedding, label, k1, k2) to (vec_id, label, dim, k1, k2, unit); keys and unit are null where nothing links."""
    for b in batches:
        values = b["embedding"]
        sizes = pc.fill_null(values.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
        start = np.cumsum(sizes) - sizes
        known = pc.and_(b["label"].is_valid(), b["vec_id"].is_valid()).to_numpy(zero_copy_only=False) & (sizes > 0)
        units: list[bytes | None] = [None] * len(b)
        for dim in np.unique(sizes[known]):
            rows = np.flatnonzero(known & (sizes == dim))
            x = flat[start[rows][:, None] + np.arange(dim)]
            top = np.abs(x).max(1)
            good = np.isfinite(top) & (top > 0)  # nan and infinity reach the maximum
            x = x[good] / top[good][:, None]
            x /= np.sqrt((x * x).sum(1))[:, None]
            for r, unit in zip(rows[good], x, strict=True):
                units[r] = unit.tobytes()
        none = np.array([u is None for u in units], bool)
        keys = [pa.array(b[k].to_numpy(zero_copy_only=False), mask=none) for k in ("k1", "k2")]
        yield pa.record_batch([b["vec_id"], b["label"], pa.array(np.where(none, 0, sizes).astype(np.int32)), *keys, pa.array(units, pa.binary())], ["vec_id", "label", "dim", "k1", "k2", "unit"])


def _spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """That many of the rows, each as far as can be from those before it."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        k = int(near.argmax())
        if near[k] <= 1e-9:
            break
        chosen.append(k)
        near = np.minimum(near, ((sample - sample[k]) ** 2).sum(1))
    return sample[chosen]


def _cells(shared, r: float):
    """(id, label, dim, n, unit) to the same with cell and home, once for its cell and once for each cell it reaches into."""

    def run(batches):
        pivots = shared.value
        for b in batches:
            out_row, out_cell, out_home = [], [], []
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                p = pivots.get(int(dim))
                if p is None:
                    out_row.append(rows), out_cell.append(np.zeros(len(rows), np.int64)), out_home.append(np.ones(len(rows), bool))
                    continue
                step = max(1, CELLS // len(p))
                for part in np.split(rows, range(step, len(rows), step)):
                    x = np.stack([np.frombuffer(b["unit"][int(i)].as_buffer()) for i in part])
                    d = 2 - 2 * (x @ p.T)
                    home = d.argmin(1)
                    apart = np.sqrt(np.maximum(2 - 2 * (p[home] @ p.T), 1e-18))
                    reach = (d - d[np.arange(len(x)), home][:, None]) / (2 * apart) <= r + 1e-9
                    reach &= np.arange(len(p))[None, :] > home[:, None]
                    i, j = np.nonzero(reach)
                    out_row += [part, part[i]]
                    out_cell += [home, j]
                    out_home += [np.ones(len(part), bool), np.zeros(len(i), bool)]
            at = pa.array(np.concatenate(out_row) if out_row else np.zeros(0, np.int64))
            cell = pa.array((np.concatenate(out_cell) if out_cell else np.zeros(0)).astype(np.int64))
            yield pa.record_batch([*[b[c].take(at) for c in ("id", "label", "dim", "n", "unit")], cell, pa.array(np.concatenate(out_home) if out_home else np.zeros(0, bool))], ["id", "label", "dim", "n", "unit", "cell", "home"])

    return run


def _join(cosine: float):
    """The rows of one unit to (id, links, other): links found, and a vector of the same component.

    A unit is a block of a cell's own rows (side 0) with itself, or with another block of own rows or of copies (side 1).
    """

    def run(table: pa.Table) -> pa.Table:
        ids, n, side = (table[c].to_numpy() for c in ("id", "n", "side"))
        x = np.stack([np.frombuffer(v.as_buffer()) for v in table["unit"].combine_chunks()])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        if alone:
            b = a
        near = x[a] @ x[b].T >= cosine
        if alone:
            np.fill_diagonal(near, False)
        links = np.zeros(len(ids), np.int64)
        links[a] += near @ n[b]
        if not alone:
            links[b] += near.T @ n[a]
        # components inside these rows: the smallest id of each row's neighbours, until nothing changes
        rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        near = near[np.ix_(rows, cols)]
        to = ids.copy()
        while len(rows):
            was = to.copy()
            for at, other, seen in ((a[rows], b[cols], near), (b[cols], a[rows], near.T)):
                least = np.where(seen, to[other][None, :], np.iinfo(np.int64).max).min(1)
                to[at] = np.minimum(to[at], least)
            if (to == was).all():
                break
        some = np.flatnonzero(links)
        return pa.table({"id": ids[some], "links": links[some], "other": to[some]})

    return run


def _paired(placed: DataFrame, block: int) -> DataFrame:
    """Rows of cells, once for each unit they belong to: label, dim, cell, i, j, side, and what they carry.

    Blocks of a cell's own rows are numbered from 0, those of copies go on after them.
    """
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count_if("home").alias("own"), F.count_if(~F.col("home")).alias("copies")).filter("own > 0 and own + copies > 1")
    blocks = [F.ceil(F.col(c) / block).cast("int").alias(n) for c, n in (("own", "owns"), ("copies", "others"))]
    rows = placed.join(sizes.select(*cell, *blocks), cell)
    deal = F.xxhash64("id", F.lit(2))
    rows = rows.withColumn("block", F.when(F.col("home"), F.pmod(deal, F.col("owns"))).otherwise(F.col("owns") + F.pmod(deal, F.greatest("others", F.lit(1)))).cast("int"))
    # a block of own rows meets itself, every other one and all copies; a block of copies meets those of own rows
    met = F.when(F.col("home"), F.sequence(F.lit(0), F.col("owns") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("owns") - 1))
    rows = rows.withColumn("other", F.explode(met))
    return rows.select(*cell, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "id", "n", "unit")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    spark = embeddings.sparkSession
    r = float(np.sqrt(2 - 2 * cosine))
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    source = source.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(2), "embedding"))
    base = C.cut(source.mapInArrow(_units, "vec_id long, label string, dim int, k1 long, k2 long, unit binary"))
    fine = base.filter("unit is not null")
    classes = C.cut(fine.groupBy("label", "dim", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.min_by("unit", "vec_id").alias("unit")))
    pivots = {}
    for dim, most in classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n")).orderBy(F.max("n").desc()).limit(64).collect():
        if most > BLOCK:  # fewer make one cell
            count = max(2, min(PIVOT_BYTES // (8 * dim), -(-most // BLOCK)))
            rows = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").select("unit").limit(CHOICE * count).collect()
            pivots[dim] = _spread_out(np.stack([np.frombuffer(x[0]) for x in rows]), count)
    shared = spark.sparkContext.broadcast(pivots)
    placed = classes.select("id", "label", "dim", "n", "unit").mapInArrow(_cells(shared, r), "id long, label string, dim int, n long, unit binary, cell long, home boolean")
    placed = C.cut(placed)
    found = C.cut(_paired(placed, BLOCK).groupBy("label", "dim", "cell", "i", "j").applyInArrow(_join(cosine), "id long, links long, other long"))
    joined = components(found.filter("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    rep = classes.select("label", "dim", "k1", "k2", "id", "n").join(links, "id", "left").join(joined, "id", "left")
    rep = rep.select("label", "dim", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("found"), F.coalesce("component", "id").alias("least"))
    out = base.select("vec_id", "label", "dim", "k1", "k2").join(rep, ["label", "dim", "k1", "k2"], "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("found", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (F.col("vec_id") == component)).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
n as (select a, count(*) as n from l group by a),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) as m from r group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.m, vec_id) as component_id, vec_id = coalesce(c.m, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id
"""
