"""Operator 13: vectors as codes of eight parts, codebooks trained by exact rounds with Exponion search.

A component x becomes floor(4096 x); vectors are cut into ``PARTS`` equal parts. The codebook of a part starts
as that part of the ``ENTRIES`` smallest vec_ids; in each of ``ROUNDS`` rounds parts go to their nearest entry and
entries become the floored mean of their parts; at the end parts are assigned once more.

Nearest entries are found by Exponion search. A part is at distance u of the entry it had before, a. An entry
c that is as near has d(a, c) <= d(a, x) + d(x, c) <= 2 u, so it stands in the list of a's neighbours, sorted
by distance, before the first whose squared distance is over 4 u^2: only these are compared. All distances are
squared integers, so the radius is exact, and equal distances go to the lower index. The parts of a batch
that share a are searched together; those whose radius ends leave the search.

A round is one pass over a written table that holds each vector's integers and codes; nothing is shuffled but
one row of sums a task, which stands in the same table (a task that is lost leaves neither) and is added up by
slots with partial sums. Codebooks have ``ENTRIES`` times the length of a vector in numbers, whatever
the number of vectors, and are broadcast; the table before last is dropped. Error sums of labels are partial sums,
joined back by a broadcast where their number is counted to be small, else by a join that AQE splits.

Vectors that are null or hold null or non-finite components are dropped. Vectors of each length have
codebooks of their own. Where no codes can be told - a length that is no multiple of eight, or a magnitude of
``MOST`` or more in a component - code and error are null and the vector takes no part in codebooks. A null vec_id
comes after all others, equal ones follow their vectors' integers; fewer than 16 vectors make fewer entries.
``label_error`` sums the errors that are known (null if none is); rows with null label count together.
Columns beside vec_id, embedding and label are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.whitening import by_length, integers, packed_integers

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this have distances that fit 64 bits, for vectors of up to 2^13 components.
MOST = 4096.0
#: Groups of tasks whose smallest vec_ids are gathered apart before they meet.
GROUPS = 256
#: Rows of label sums that are broadcast at most.
LABELS = 1 << 20

_ROW = "vec_id long, label string, dim int, x binary, code binary, error long, sums binary"


def _pack(batches):
    for b in batches:
        sizes, packed = packed_integers(b["embedding"], SCALE, MOST * SCALE)
        coded = [p is not None and d > 0 and d % PARTS == 0 and (p[0] < 4 or int(np.abs(integers(pa.array([p], pa.binary()))).max()) < MOST * SCALE) for d, p in zip(sizes, packed, strict=True)]
        yield pa.record_batch([b["vec_id"], b["label"], pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary()), pa.array(coded, pa.bool_())], ["vec_id", "label", "dim", "x", "coded"])


def exponion(x: np.ndarray, before: np.ndarray, book: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of the rows of x and their squared distances, from the entries they had before."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        order = np.argsort(apart[a], kind="stable")
        near = apart[a][order]
        own = ((x[rows] - book[a]) ** 2).sum(1)
        best, at = own.copy(), np.full(len(rows), a)
        live = np.arange(len(rows))
        for c, d in zip(order, near, strict=True):
            live = live[4 * own[live] >= d]
            if not len(live):
                break
            if c == a:
                continue
            got = ((x[rows[live]] - book[c]) ** 2).sum(1)
            better = (got < best[live]) | ((got == best[live]) & (c < at[live]))
            best[live[better]], at[live[better]] = got[better], c
            if compared is not None:
                compared.append(len(live))
        code[rows], error[rows] = at, best
    return code, error


def _assign(books: dict[int, np.ndarray], summed: bool):
    """Rows to the same with new codes and errors; with summed, a last row with the sums of the parts of each entry.

    books: PARTS x entries x part length, by vector length.
    """

    def run(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            codes: list[bytes | None] = [None] * len(b)
            errors = np.zeros(len(b), np.int64)
            for dim, rows in by_length(b):
                book = books[dim]
                x = integers(b["x"].take(pa.array(rows))).reshape(len(rows), PARTS, -1)
                before = np.stack([np.frombuffer(v.as_buffer(), np.uint8) for v in b["code"].take(pa.array(rows))]).astype(np.int64)
                code, error = np.zeros((len(rows), PARTS), np.int64), np.zeros(len(rows), np.int64)
                if summed and dim not in sums:
                    sums[dim] = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
                for p in range(PARTS):
                    code[:, p], e = exponion(x[:, p], before[:, p], book[p])
                    error += e
                    if summed:
                        np.add.at(sums[dim][0][p], code[:, p], x[:, p])
                        sums[dim][1][p] += np.bincount(code[:, p], minlength=book.shape[1])
                for r, c in zip(rows, code.astype(np.uint8), strict=True):
                    codes[r] = c.tobytes()
                errors[rows] = error
            kept = [b[n] for n in ("vec_id", "label", "dim", "x")]
            yield pa.record_batch([*kept, pa.array(codes, pa.binary()), pa.array(errors), pa.nulls(len(b), pa.binary())], names=["vec_id", "label", "dim", "x", "code", "error", "sums"])
        if sums:
            none = [pa.nulls(len(sums), t) for t in (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int64())]
            none[2] = pa.array(list(sums), pa.int32())
            made = [total.tobytes() + count.tobytes() for total, count in sums.values()]
            yield pa.record_batch([*none, pa.array(made, pa.binary())], names=["vec_id", "label", "dim", "x", "code", "error", "sums"])

    return run


def _slots(batches):
    """Rows of sums, added up in this task, to (dim, slot, value)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for dim, s in zip(b["dim"].to_pylist(), b["sums"], strict=True):
            sums[dim] = sums.get(dim, 0) + np.frombuffer(s.as_buffer(), np.int64)
    for dim, s in sums.items():
        yield pa.record_batch([pa.array(np.full(len(s), dim, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["dim", "slot", "value"])


def _moved(table: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The codebooks after a round; entries without parts stay."""
    found = table.filter("sums is not null").select("dim", "sums").mapInArrow(_slots, "dim int, slot int, value long")
    out = {dim: b.copy() for dim, b in books.items()}
    sums = {dim: np.zeros(b.size + b.shape[0] * b.shape[1], np.int64) for dim, b in books.items()}
    for r in found.groupBy("dim", "slot").agg(F.sum("value").alias("value")).collect():  # 16 * (length + 8) rows a length
        sums[r["dim"]][r["slot"]] = r["value"]
    for dim, b in out.items():
        total, count = sums[dim][: b.size].reshape(b.shape), sums[dim][b.size :].reshape(b.shape[:2])
        used = count > 0
        b[used] = total[used] // count[used][:, None]
    return out


def _start(base: DataFrame) -> dict[int, np.ndarray]:
    """The parts of the smallest vec_ids, by length."""
    order = F.col("vec_id").asc_nulls_last(), "x"
    first = base.select("dim", "vec_id", "x", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("group"))
    for by in (["dim", "group"], ["dim"]):  # each task hands on its smallest, and so does each group
        first = first.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= ENTRIES)
    rows: dict[int, list] = {}
    for r in sorted(first.collect(), key=lambda r: (r["dim"], r["k"])):
        rows.setdefault(r["dim"], []).append(bytes(r["x"]))
    return {dim: np.ascontiguousarray(integers(pa.array(x, pa.binary())).reshape(len(x), PARTS, -1).transpose(1, 0, 2)) for dim, x in rows.items()}


def train(base: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """base (vec_id, label, dim, x) with code and error under the final codebooks, and these by length."""
    books = _start(base)
    table = base.select("vec_id", "label", "dim", "x", F.lit(bytes(PARTS)).alias("code"))
    cut = None
    for n in range(rounds + 1):
        made = C.cut(table.select("vec_id", "label", "dim", "x", "code").mapInArrow(_assign(books, n < rounds), _ROW))
        if n < rounds:
            books = _moved(made, books)
        if cut is not None:
            C.drop(cut)
        cut, table = made, made.filter("sums is null")
    return table.select("vec_id", "label", "dim", "code", "error"), books


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256: one row a vector."""
    source = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    base = C.cut(source.mapInArrow(_pack, "vec_id long, label string, dim int, x binary, coded boolean").filter("x is not null"))
    coded, books = train(base.filter("coded"))
    shas = {dim: hashlib.sha256(",".join(map(str, b.ravel().tolist())).encode()).hexdigest() for dim, b in books.items()}
    out = coded.select("vec_id", "label", "error", F.lower(F.hex("code")).alias("code"), "dim")
    out = out.unionByName(base.filter("not coded").select("vec_id", "label", "dim"), allowMissingColumns=True)
    sums = C.cut(out.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= LABELS:
        sums = F.broadcast(sums)
    out = out.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")), "left")
    sha = F.create_map(*[F.lit(v) for pair in shas.items() for v in pair])[F.col("dim")] if shas else F.lit(None).cast("string")
    return out.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))


def oracle() -> str:
    """The same by comparing each part with each entry, for vectors of one length that is a multiple of eight."""
    dist = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for n in range(ROUNDS + 1):
        steps.append(f"a{n} as materialized (select p.part, p.vec_id, p.label, any_value(p.v) as v, min({dist} * {ENTRIES} + c.k)::bigint as best from p join c{n} c on p.part = c.part group by all)")
        if n < ROUNDS:
            steps.append(f"s{n} as (select part, best % {ENTRIES} as k, i, sum(v[i])::bigint as s, count(*) as n from a{n}, range(1, len(v) + 1) t(i) group by all)")
            steps.append(f"m{n} as (select part, k, list((s - ((s % n) + n) % n) // n order by i) as v from s{n} group by all)")
            steps.append(f"c{n + 1} as materialized (select c.part, c.k, coalesce(m.v, c.v) as v from c{n} c left join m{n} m on m.part = c.part and m.k = c.k)")
    return f"""
with e as materialized (select vec_id, label, list_transform(embedding::double[], lambda x: floor(4096 * x)::bigint) as y from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, label, t.part, y[t.part * (len(y) // {PARTS}) + 1 : (t.part + 1) * (len(y) // {PARTS})] as v from e, range({PARTS}) t(part)),
c0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as k, v from p qualify row_number() over (partition by part order by vec_id) <= {ENTRIES}),
{", ".join(steps)},
d as (select vec_id, label, string_agg(printf('%02x', best % {ENTRIES}), '' order by part) as code, sum(best // {ENTRIES})::bigint as error from a{ROUNDS} group by all),
b as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, k)) as sha from c{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256 from d, b
"""
