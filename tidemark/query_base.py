"""What query modules share: the register of queries and their SQL, the tables, and the change log.

The change log is derived from the event table: position = event_id + 1, key = user_id, one of four
tables by key, sign-ups create, errors delete, anything else updates. Times are passed in, never now().
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.store import Store

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG_SQL = """log as (select event_id + 1 as seq, user_id as row_id, case user_id % 4 when 0 then 'car' when 1 then 'computer' when 2 then 'grade' else 'member' end as table_name,
  case event_type when 'signup' then 'c' when 'error' then 'd' else 'u' end as op, ts as changed_at, event_type, value, cast(value as decimal(12,2)) as amount from events)"""
#: A fixed instant that stands for now.
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None, decimals: str = ""):
    """Register a query and its SQL; decimal columns named are compared as doubles, as both sides print them apart."""
    names = decimals.split()

    def add(f):
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("double") for c in names}) if names else out

        Q[f.__name__] = shown
        if sql:
            text = f"with {LOG_SQL} {sql}" if sql.lstrip().startswith((",", "select")) else sql
            SQL[f.__name__] = f"select * replace ({', '.join(f'{c}::double as {c}' for c in names)}) from ({text})" if names else text
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    names = F.element_at(F.array(*[F.lit(x) for x in ("car", "computer", "grade", "member")]), (F.col("user_id") % 4 + 1).cast("int"))
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("row_id"), names.alias("table_name"), op.alias("op"), F.col("ts").alias("changed_at"), "event_type", "value", F.col("value").cast("decimal(12,2)").alias("amount"))


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that all executors share; a local one only where all run on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{shared.rstrip('/')}/store-{uuid.uuid4().hex}"


def written(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Keeps tables in a folder of its own there."""
    root = shared_folder(spark)

    def one(df: DataFrame) -> DataFrame:
        path = f"{root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return one


def scratch(spark: SparkSession) -> Store:
    return Store(spark, shared_folder(spark))
