"""A stream source that reads a table of changes by ranges of positions, with a slot of its own.

``spark.readStream.format("tidemark_positions")`` with ``path`` (Parquet files), ``position`` (a column of whole
numbers, each standing once), ``slot`` (a file for its progress), and perhaps ``rows`` (positions a batch at
most), ``backlog`` (the same while the stream is behind), ``ranges`` (tasks a batch) and ``upto`` (a position to stop at).

A batch goes from the position where the one before ended to at most ``rows`` further on, so however far the
stream is behind, a batch has a bound. With ``backlog`` a batch that follows a full one may be eight times as large, up
to that many positions, so a long log takes few batches; one that is not full brings the size back to ``rows``. Each task reads one range of it, with the filter and the columns pushed
to the files. The slot holds the end of the last batch that was planned, so that a restart goes on from there, and
the end of the last one that Spark has committed, up to which the log may be pruned. Batches that were planned and
not committed are planned again by Spark's own checkpoint with the same ends. A slot that was lost while the
checkpoint goes on is an error, never a silent start from elsewhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


class SlotLost(RuntimeError):
    """The checkpoint is ahead of the slot."""


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with or without scheme, and the path there."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def read_json(path: str) -> dict | None:
    where, p = located(path)
    if where.get_file_info(p).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(p) as f:
        return json.loads(f.read())


def write_json(path: str, value: dict) -> None:
    """Written beside and moved, so that no reader sees half of it."""
    where, p = located(path)
    where.create_dir(p.rpartition("/")[0], recursive=True)
    with where.open_output_stream(f"{p}.tmp") as f:
        f.write(json.dumps(value).encode())
    where.move(f"{p}.tmp", p)


def table_of(path: str) -> ds.Dataset:
    where, p = located(path)
    return ds.dataset(p, filesystem=where, format="parquet")


def in_micros(schema: pa.Schema) -> pa.Schema:
    """The schema with times in microseconds, which is what Spark has."""
    return pa.schema([pa.field(f.name, pa.timestamp("us", f.type.tz)) if pa.types.is_timestamp(f.type) else f for f in schema])


def highest(table: ds.Dataset, column: str) -> int:
    """The greatest value of a column, by the statistics of the files where they have them; -1 without rows."""
    top = -1
    for fragment in table.get_fragments():
        meta = fragment.metadata
        place = meta.schema.names.index(column)
        for n in range(meta.num_row_groups):
            stats = meta.row_group(n).column(place).statistics
            if stats is not None and stats.has_min_max:
                found = stats.max
            else:
                found = pc.max(fragment.subset(row_group_ids=[n]).to_table(columns=[column]).column(column)).as_py()
            top = top if found is None else max(top, int(found))
    return top


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class PositionReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.column, self.slot = options["path"], options["position"], options["slot"]
        self.rows, self.ranges = int(options.get("rows", 5000)), int(options.get("ranges", 4))
        self.size, self.backlog = self.rows, max(self.rows, int(options.get("backlog", self.rows)))
        self.upto = int(options["upto"]) if "upto" in options else None
        self.start = int(options.get("start", 0))
        #: end of the last planned batch: the first position that is not in it
        self.planned = (read_json(self.slot) or {}).get("planned", self.start)

    def initialOffset(self) -> dict:
        return {"position": self.start}

    def latestOffset(self) -> dict:
        top = highest(table_of(self.path), self.column) + 1
        if self.upto is not None:
            top = min(top, self.upto + 1)
        return {"position": max(self.planned, min(top, self.planned + self.size))}

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        lo, hi = start["position"], end["position"]
        if hi < lo:
            raise SlotLost(f"the slot {self.slot} stands at {hi}, the checkpoint at {lo}")
        if hi > self.planned:
            self.size = min(self.size * 8, self.backlog) if hi - lo >= self.size else self.rows
            self.planned = hi
            write_json(self.slot, (read_json(self.slot) or {}) | {"planned": hi})
        step = max(1, -(-(hi - lo) // self.ranges))
        return [Range(x, min(hi, x + step)) for x in range(lo, hi, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where = (ds.field(self.column) >= partition.lo) & (ds.field(self.column) < partition.hi)
        table = table_of(self.path)
        wanted = in_micros(table.schema)
        for batch in table.to_batches(filter=where):
            yield batch.cast(wanted, safe=False)

    def commit(self, end: dict) -> None:
        write_json(self.slot, (read_json(self.slot) or {}) | {"planned": self.planned, "confirmed": end["position"]})


class PositionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_positions"

    def schema(self):
        return from_arrow_schema(in_micros(table_of(self.options["path"]).schema))

    def streamReader(self, schema) -> PositionReader:
        return PositionReader(dict(self.options))
