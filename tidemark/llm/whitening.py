"""Operator 11: whitening of embeddings by hierarchical merging of singular value decompositions.

A component c becomes the integer x = floor(64 c) + 1000000. The fit takes each distinct x vector once. A
part of the fit is held as its number of vectors n, its exact sums S, and R = diag(s) V^T of its centred
vectors, all dimensions kept, so R^T R is n times the covariance. Two parts merge without loss: the rows of
both R and one row sqrt(n1 n2 / (n1 + n2)) (m1 - m2), which makes up for the two means, are decomposed
again. Each partition merges its vectors in blocks of ``BLOCK``; then ``FAN`` states at a time are merged by
Spark groups, level by level, until one is left, each level a written table. A state has d * d numbers,
whatever the number of vectors, and a task holds ``FAN`` of them.

Distinct vectors meet by a packed form of their integers (a byte a component where they fit), after map-side
partial deduplication, so a very common vector is one row a task. The model (means, up to ``COMPONENTS``
unit vectors) goes to all rows by broadcast, lengths dealt with in passes of ``MODEL_BYTES``. The check of the
identity sums blocks of the whitened fit the same way.

Vectors that are null or hold null or non-finite components are dropped, those without components give no
rows. Vectors of each length are whitened among themselves. A null vec_id is kept, repeated rows count once in
the fit and give their own rows. |64 c| counts as at most 2^31. A component without variance (fewer
distinct vectors than dimensions) has whitened 0 and explained 0, and is left out of the identity. A
deviation that does not fit a long is null. Of two equal eigenvalues either order, of a component either
sign, the same for all rows. Columns beside vec_id and embedding are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Vectors that are decomposed at once, states that one task merges, bytes of models broadcast at once.
BLOCK, FAN, MODEL_BYTES = 4096, 8, 64 << 20
#: Magnitude at which scaled components stay, so that sums of them are exact.
MOST = 2.0**31
_STATE = "dim int, node long, n long, sums binary, r binary"


def packed_integers(embedding: pa.ListArray, scale: int, most: float) -> tuple[np.ndarray, list[bytes | None]]:
    """Lengths, and floor(scale * c) of each vector in the fewest bytes a component; None where a vector is dropped.

    The first byte tells the width, which the values decide, so equal integers have equal bytes.
    """
    sizes = embedding.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
    start = np.cumsum(sizes) - sizes
    out: list[bytes | None] = [None] * len(embedding)
    there = embedding.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[there]):
        rows = np.flatnonzero(there & (sizes == dim))
        c = flat[start[rows][:, None] + np.arange(dim)]
        good = np.isfinite(c).all(1)
        x = np.floor(np.clip(c[good] * scale, -most, most)).astype(np.int64)
        top = np.abs(x).max(1, initial=0)
        width = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
        for r, w, v in zip(rows[good], width, x, strict=True):
            out[r] = bytes([w]) + v.astype(f"<i{w}").tobytes()
    return sizes, out


def integers(packed: pa.Array) -> np.ndarray:
    """The vectors of packed integers of one length, one a row."""
    raw = [v.as_buffer() for v in packed]
    return np.stack([np.frombuffer(b, f"<i{memoryview(b)[0]}", offset=1).astype(np.int64) for b in raw])


def _pack(batches):
    for b in batches:
        sizes, packed = packed_integers(b["embedding"], SCALE, MOST)
        yield pa.record_batch([b["vec_id"], pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary())], ["vec_id", "dim", "x"])


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


class State:
    """n vectors of integers: their sums, and R with R^T R the scatter about their mean."""

    def __init__(self, n: int, sums: np.ndarray, r: np.ndarray):
        self.n, self.sums, self.r = n, sums, r

    @staticmethod
    def of(x: np.ndarray) -> State:
        n, sums = len(x), x.sum(0)
        return State(n, sums, _reduced((n * x - sums) / n if np.abs(x).max() < 2**62 // n else x - sums / n))

    def merge(self, other: State) -> State:
        apart = np.sqrt(self.n * other.n / (self.n + other.n)) * (self.sums / self.n - other.sums / other.n)
        return State(self.n + other.n, self.sums + other.sums, _reduced(np.vstack([self.r, other.r, apart])))

    @staticmethod
    def read(n: int, sums: bytes, r: bytes) -> State:
        s = np.frombuffer(sums, np.int64)
        return State(n, s, np.frombuffer(r).reshape(-1, len(s)))

    def columns(self) -> tuple[int, bytes, bytes]:
        return self.n, self.sums.tobytes(), self.r.tobytes()


def _reduced(rows: np.ndarray) -> np.ndarray:
    """diag(s) V^T of the rows: at most as many as there are dimensions, with the same inner products of columns."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _states(batches):
    """(dim, x) of a partition to one state a length, vectors taken by blocks."""
    done: dict[int, State] = {}
    waiting: dict[int, list[np.ndarray]] = {}

    def close(dim: int) -> None:
        if waiting.get(dim):
            made = State.of(np.concatenate(waiting.pop(dim)))
            done[dim] = done[dim].merge(made) if dim in done else made

    node = None
    for b in batches:
        for dim, rows in by_length(b):
            node = b["node"][0].as_py() if node is None else node
            waiting.setdefault(dim, []).append(integers(b["x"].take(pa.array(rows))))
            if sum(map(len, waiting[dim])) >= BLOCK:
                close(dim)
    for dim in list(waiting):
        close(dim)
    if done:
        yield _state_rows([(dim, node, *s.columns()) for dim, s in done.items()])


def _state_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["dim", "node", "n", "sums", "r"])


def _merge(table: pa.Table) -> pa.Table:
    """Up to ``FAN`` states of one length to one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["node"])
    state = State.read(rows[0]["n"], rows[0]["sums"], rows[0]["r"])
    for r in rows[1:]:
        state = state.merge(State.read(r["n"], r["sums"], r["r"]))
    return pa.Table.from_batches([_state_rows([(rows[0]["dim"], rows[0]["node"] // FAN, *state.columns())])])


def fit(distinct: DataFrame) -> DataFrame:
    """dim, node, n, sums, r: one state a length, of distinct (dim, x)."""
    placed = distinct.select("dim", "x", F.spark_partition_id().cast("long").alias("node"))
    states = C.cut(placed.mapInArrow(_states, _STATE))
    most = states.agg(F.max("node")).first()[0] or 0
    while most > 0:
        merged = C.cut(states.groupBy("dim", F.floor(F.col("node") / FAN).alias("to")).applyInArrow(_merge, _STATE))
        C.drop(states)
        states, most = merged, most // FAN
    return states


class Model:
    """What a row needs: n, S, the directions over the root of their eigenvalues, and shares of the variance."""

    def __init__(self, n: int, sums: bytes, r: bytes):
        state = State.read(n, sums, r)
        _, s, v = np.linalg.svd(state.r, full_matrices=False)
        self.n, self.sums = n, state.sums
        shown = min(COMPONENTS, len(self.sums))
        e = np.zeros(shown)
        e[: len(s)] = s[:shown] ** 2 / n
        #: numbers below the rounding of the decomposition are no variance
        self.real = e > (s[0] * np.finfo(float).eps * len(self.sums)) ** 2 / n
        self.explained = np.where(self.real, e / max((s**2).sum() / n, 1e-300), 0.0)
        self.to = np.zeros((shown, len(self.sums)))
        self.to[self.real] = v[:shown][self.real[: len(v)]] / np.sqrt(e[self.real])[:, None]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self._apart(x) / self.n @ self.to.T

    def _apart(self, x: np.ndarray) -> np.ndarray:
        """n x - S: integers where they fit, whole Python numbers elsewhere."""
        if max(int(np.abs(x).max(initial=0)) * self.n, int(np.abs(self.sums).max())) < 2**62:
            return self.n * x - self.sums
        return (x.astype(object) * self.n - self.sums.astype(object)).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        apart = self._apart(x)
        if apart.dtype == np.int64 and int(np.abs(apart).max(initial=0)) ** 2 * max(x.shape[1], 1) < 2**63:
            return (apart * apart).sum(1).tolist()
        exact = ((x.astype(object) * self.n - self.sums.astype(object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]


def _squares(shared):
    """(dim, x) of a partition to the sums of products of whitened components, one row a length."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, rows in by_length(b):
                if dim in shared.value:
                    w = shared.value[dim].whitened(integers(b["x"].take(pa.array(rows))))
                    w = np.hstack([w, np.ones((len(w), 1))])
                    sums[dim] = sums.get(dim, 0) + w.T @ w
        for dim, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.record_batch([pa.array(np.full(s.size, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())], ["dim", "i", "j", "v"])

    return run


def _identity_errors(distinct: DataFrame, shared, models: dict[int, Model]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit's covariance minus the identity, by length."""
    found: dict[int, np.ndarray] = {dim: np.zeros((len(m.real) + 1,) * 2) for dim, m in models.items()}
    summed = distinct.mapInArrow(_squares(shared), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v"))
    for r in summed.collect():  # 17 * 17 rows a length
        found[r["dim"]][r["i"], r["j"]] = r["v"]
    out = {}
    for dim, s in found.items():
        m, real = models[dim], models[dim].real
        mean = s[-1, :-1] / m.n
        off = s[:-1, :-1] / m.n - np.outer(mean, mean) - np.eye(len(real))
        out[dim] = float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))
    return out


def _project(shared, errors: dict[int, float]):
    """(vec_id, dim, x) to a row for each component."""

    def run(batches):
        for b in batches:
            for dim, rows in by_length(b):
                m = shared.value.get(dim)
                if m is None:
                    continue
                for part in np.split(rows, range(BLOCK, len(rows), BLOCK)):
                    x = integers(b["x"].take(pa.array(part)))
                    k = len(m.real)
                    deviation = pa.array(m.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                    n = len(x) * k
                    yield pa.record_batch(
                        [b["vec_id"].take(pa.array(np.repeat(part, k))), pa.array(np.tile(np.arange(1, k + 1), len(x)).astype(np.int32)), pa.array(np.full(n, m.n)), deviation, pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.explained, len(x))), pa.array(np.full(n, errors[dim]))],
                        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return run


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark = embeddings.sparkSession
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = C.cut(source.mapInArrow(_pack, "vec_id long, dim int, x binary").filter("x is not null and dim > 0"))
    distinct = C.cut(base.select("dim", "x").distinct())
    states = fit(distinct)
    sizes = sorted(r[0] for r in states.select("dim").collect())
    passes: list[list[int]] = [[]]
    for dim in sizes:  # a state has dim * dim numbers and is read by the driver, one pass at a time
        if passes[-1] and 8 * sum(d * d for d in [*passes[-1], dim]) > MODEL_BYTES:
            passes.append([])
        passes[-1].append(dim)
    out = []
    for dims in passes:
        rows = states.filter(F.col("dim").isin(dims)).collect()
        models = {r["dim"]: Model(r["n"], bytes(r["sums"]), bytes(r["r"])) for r in rows}
        shared = spark.sparkContext.broadcast(models)
        here = F.col("dim").isin(dims) if len(passes) > 1 else F.lit(True)
        errors = _identity_errors(distinct.filter(here), shared, models)
        out.append(base.filter(here).mapInArrow(_project(shared, errors), _OUT))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole
