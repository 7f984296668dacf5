"""A table whose writes become visible at once: tasks write files, the commit of a batch names them.

``format("tidemark_table")`` with ``path`` and ``query``, for streams and (with ``epoch``) for batches. Each task writes
one Parquet file and hands on its name, its rows and the highest ``position`` (a column, if the option names one) as
its commit message. The driver puts all messages of an epoch into one file ``commits/<query>/<epoch>``, written
aside and moved: before that nothing of the epoch can be seen, afterwards all of it, and so is how far the
query has come. What a task that failed or was tried twice has left is named by no commit. An epoch that is there
already is not written again, so a batch that is replayed counts once; queries have epochs of their own, so
nothing that writes to the same table moves those of another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from tidemark.sources.positions import located, read_json, write_json


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int
    position: int | None


class _Files:
    """What both kinds of writers do."""

    def __init__(self, options: dict[str, str]):
        self.path, self.query, self.position = options["path"].rstrip("/"), options["query"], options.get("position")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = located(self.path)
        name, rows, top, out = f"{uuid.uuid4().hex}.parquet", 0, None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                where.create_dir(f"{root}/data", recursive=True)
                out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=where)
            out.write_batch(batch)
            rows += batch.num_rows
            if self.position:
                own = pc.max(batch.column(self.position)).as_py()
                top = own if top is None else top if own is None else max(top, own)
        if out is None:
            return Written(None, 0, None)
        out.close()
        return Written(name, rows, top)

    def _commit(self, messages, epoch: int) -> bool:
        at = f"{self.path}/commits/{self.query}/{epoch:012d}.json"
        if read_json(at) is not None:
            self._abort(messages)
            return False
        told = [m for m in messages if m is not None and m.file]
        positions = [m.position for m in told if m.position is not None]
        write_json(at, {"epoch": epoch, "files": [m.file for m in told], "rows": sum(m.rows for m in told), "position": max(positions, default=None)})
        return True

    def _abort(self, messages) -> None:
        where, root = located(self.path)
        for m in messages:
            if m is not None and m.file and where.get_file_info(f"{root}/data/{m.file}").type != fs.FileType.NotFound:
                where.delete_file(f"{root}/data/{m.file}")


class StreamFiles(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages, batchId: int) -> None:
        self._commit(messages, batchId)

    def abort(self, messages, batchId: int) -> None:
        self._abort(messages)


class BatchFiles(_Files, DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.epoch = int(options["epoch"])

    def commit(self, messages) -> None:
        self._commit(messages, self.epoch)

    def abort(self, messages) -> None:
        self._abort(messages)


class TwoPhaseTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_table"

    def streamWriter(self, schema, overwrite: bool) -> StreamFiles:
        return StreamFiles(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BatchFiles:
        return BatchFiles(dict(self.options))


def commits(path: str) -> list[dict]:
    """Every commit of a table, with its query."""
    where, root = located(path.rstrip("/"))
    found = where.get_file_info(fs.FileSelector(f"{root}/commits", recursive=True, allow_not_found=True))
    files = sorted(f.path for f in found if f.path.endswith(".json"))
    scheme = path.rstrip("/").removesuffix(root)
    return [read_json(scheme + p) | {"query": p.split("/")[-2]} for p in files]


def position(path: str, query: str) -> int | None:
    """How far a query has come: it never goes back."""
    return max((c["position"] for c in commits(path) if c["query"] == query and c["position"] is not None), default=None)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits."""
    files = [f"{path.rstrip('/')}/data/{f}" for c in commits(path) for f in c["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
