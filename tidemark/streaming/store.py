"""Versioned tables under one manifest: a commit is one rename.

A batch writes new versions of what it touches, its audit rows and its dead letters, and then replaces the
manifest, which names the files of each table and the position applied. A table may be kept in buckets by a
hash of its key; a batch then writes only the buckets that hold its keys. Versions count commits of any kind.
The stream's batches have a mark of their own, which maintenance (``batch`` None) never moves: a batch that is
committed already is skipped when it is replayed, and no other is. Renames go through Hadoop's file system, so any store with an atomic rename
will do.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket a key is kept in."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def manifest(self) -> dict:
        """{versions: table -> paths (by bucket, or a list), position, version, batch, marks}."""
        p = self._path(f"{self.root}/manifest.json")
        if not self._fs.exists(p):
            return {"versions": {}, "position": None, "version": -1, "batch": -1, "marks": {}}
        stream = self._fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def paths(self, table: str, buckets: list[int] | None = None) -> list[str]:
        """The files of a table, or of some of its buckets."""
        kept = self.manifest()["versions"].get(table, [])
        if isinstance(kept, dict):
            return [p for b, p in sorted(kept.items()) if buckets is None or int(b) in buckets]
        return kept

    def read(self, table: str, schema=None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its buckets; without rows None, or an empty table of the schema."""
        paths = self.paths(table, buckets)
        if paths:
            return self.spark.read.parquet(*paths)
        return self.spark.createDataFrame([], schema) if schema is not None else None

    def commit(self, batch: int | None, position: int | None, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None, touched: dict[str, list[int]] | None = None, marks: dict | None = None) -> bool:
        """Write tables and make them the present; False if it is a batch that was committed before.

        A replaced table with a list of touched buckets has a column ``_bucket`` and takes the place of those
        buckets alone; without one it takes the place of the whole table.
        """
        now = self.manifest()
        if batch is not None and batch <= now["batch"]:
            return False
        version = now.get("version", now["batch"]) + 1
        versions = dict(now["versions"])
        for name, df in (replace or {}).items():
            path = f"{self.root}/{name}/r-{version}"
            if touched is not None and name in touched:
                df.write.mode("overwrite").partitionBy(BUCKET).parquet(path)
                old = versions.get(name, {})
                kept = {b: p for b, p in (old if isinstance(old, dict) else {}).items() if int(b) not in touched[name]}
                made = [s.getPath().getName() for s in self._fs.listStatus(self._path(path))]
                versions[name] = kept | {m.split("=")[1]: f"{path}/{m}" for m in made if m.startswith(f"{BUCKET}=")}
            else:
                df.write.mode("overwrite").parquet(path)
                versions[name] = [path]
        for name, df in (append or {}).items():
            path = f"{self.root}/{name}/a-{version}"
            df.write.mode("overwrite").parquet(path)
            versions[name] = [*versions.get(name, []), path]
        old = now["position"]
        position = old if position is None else position if old is None else max(old, position)
        text = json.dumps({"versions": versions, "position": position, "version": version, "batch": now["batch"] if batch is None else batch, "marks": now.get("marks", {}) | (marks or {})})
        fresh, final = self._path(f"{self.root}/manifest.{version}.tmp"), self._path(f"{self.root}/manifest.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(rename, 1)
        array[0] = rename.OVERWRITE
        context.rename(fresh, final, array)
        return True

    def compact(self, table: str, most: int = 32) -> bool:
        """Rewrite a table that batches append to as one version, once it has more than so many; then the list starts anew."""
        paths = self.paths(table)
        if len(paths) <= most:
            return False
        return self.commit(None, None, {table: self.read(table)})

    def prune(self, keep: int = 2) -> list[str]:
        """Remove versions that the present does not use, but the newest few of each table; returns what went."""
        live = {p.removeprefix("file:") for kept in self.manifest()["versions"].values() for p in (kept.values() if isinstance(kept, dict) else kept)}
        gone = []
        for status in self._fs.listStatus(self._path(self.root)):
            if not status.isDirectory():
                continue
            found = sorted((s.getPath().toString() for s in self._fs.listStatus(status.getPath()) if s.getPath().getName()[:2] in ("r-", "a-")), key=lambda p: int(p.rsplit("-", 1)[1]))
            for p in found[: max(0, len(found) - keep)]:
                plain = p.removeprefix("file:").replace("///", "/")
                if not any(x.replace("///", "/") == plain or x.replace("///", "/").startswith(plain + "/") for x in live):
                    self._fs.delete(self._path(p), True)
                    gone.append(p)
        return gone
