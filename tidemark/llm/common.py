"""What the corpus operators share: byte kernels over Arrow strings, lineage cuts and stable splits.

Texts reach Python as Arrow batches. Every kernel works on the concatenated UTF-8 bytes of a bounded
run of rows (a single longer text makes a run of its own), so memory follows the longest text, not
the partition.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text handled at once by the kernels.
RUN_BYTES = 1 << 20
#: Odd base of the rolling hash (any odd number has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: The same, with A-Z valued as a-z.
LOWER_VALUES = BYTE_VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
#: Bytes that are not white space (space, and tab to carriage return).
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: ASCII digits and letters, and every byte of a character beyond ASCII.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(RUN_BYTES + 4096, n)
        inverse = pow(BASE, -1, 1 << 64)
        out = []
        for b in (BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        if size > 1 << 23:  # one extreme text: do not keep its tables
            return out[0], out[1]
        _powers[:] = out
    return _powers[0], _powers[1]


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray]:
    """H with H[j] - H[i] times inverse[i] the hash of data[i:j], and the inverses."""
    up, down = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=h[1:])
    return h, down


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where each row starts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def pack(batches):
    """Batches with their text column as compressed bytes (packed) and size (n_bytes), to shuffle less."""
    codec = pa.Codec("zstd", 3)
    for b in batches:
        raw = [x.as_buffer() if x.is_valid else None for x in b["text"].cast(pa.large_binary())]
        packed = pa.array([None if x is None else codec.compress(x, asbytes=True) for x in raw], pa.binary())
        sizes = pa.array([0 if x is None else x.size for x in raw], pa.int64())
        rest = [n for n in b.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[b[n] for n in rest], packed, sizes], names=[*rest, "packed", "n_bytes"])


def unpack(codec: pa.Codec, packed, size: int) -> bytes:
    """One packed text (null: empty)."""
    return codec.decompress(packed.as_buffer(), size, asbytes=True) if size and packed.is_valid else b""


def unpacked(packed: pa.Array, sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of packed texts one after another and where each starts, as ``texts`` gives them."""
    codec = pa.Codec("zstd")
    n = sizes.to_numpy()
    data = b"".join(unpack(codec, packed[i], int(n[i])) for i in range(len(n)))
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(n)])


def words(data: np.ndarray, starts: np.ndarray, inside: np.ndarray, values: np.ndarray = LOWER_VALUES):
    """Hash of each maximal run of bytes that are inside, and the row it is in.

    data holds rows one after another; starts are their first bytes and the end of the last.
    """
    n = len(data)
    rows = len(starts) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ok = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ok[:-1]
    first = np.flatnonzero(ok & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ok[1:]
    last = np.flatnonzero(ok & (~after | edge[1:])) + 1
    h, down = prefix_hash(data, values)
    found = mix((h[last] - h[first]) * down[first] + (last - first).astype(np.uint64))
    row = np.searchsorted(starts, first, "right") - 1
    return found, np.minimum(row, rows - 1), first, last


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-aware hash of two hashes."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n (null for null)."""
    return F.crc32(F.col(column).cast("string")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended already; the folder is the cluster's to clean
            return


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from a table in the shared folder: later steps neither recompute nor lose them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def drop(*cuts: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once what was made of them is written itself."""
    for df in cuts:
        spark, path = df.sparkSession, df._cut_at
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove((spark, path))


#: Rows of a key that are joined in one place.
SLICE = 2000


def join_sliced(many: DataFrame, one: DataFrame, key: str, n: str, row: str, rows: int = SLICE) -> DataFrame:
    """many joined to one by a key that many rows may share, a key having a slice for each so many of its rows.

    Both have the number of the key's rows in ``n``; many is dealt by the hash of ``row``, one goes to all slices.
    """
    slices = F.ceil(F.col(n) / rows)
    left = many.withColumn("slice", F.pmod(F.xxhash64(row), slices))
    right = one.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1))).drop(n)
    return left.join(right, [key, "slice"]).drop("slice")


def sums_before(df: DataFrame, order: list[str], **sums: Column) -> DataFrame:
    """df with, for each name, the sum of that column over the rows that stand before in the order (a total one).

    Rows are sorted by ranges, never all in one task; only one row a range is summed up globally.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(F.lit(1)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranged.groupBy("__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    whole = whole.select("__range", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    out = ranged.join(F.broadcast(whole), "__range")
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{n}")).alias(n) for n, c in sums.items()])


def plain_names(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """df with the wanted columns as named and all others as x0, x1, ..., these names in order, and its own names.

    Columns of any name then cannot clash with those that an operator adds; ``toDF`` gives the names back.
    """
    now = [n if n in wanted else f"x{i}" for i, n in enumerate(df.columns)]
    return df.toDF(*now), now, df.columns
