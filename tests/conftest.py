import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{root}/shared").config("spark.sql.warehouse.dir", f"{root}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str = SF):
    """Rows of the SQL over the tables, as sorted tuples of comparable values, and the column names in order."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return plain(cur.fetchall(), names)


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(v):
        return repr(float(v)) if type(v).__name__ in ("int", "float", "Decimal") and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows), [names[i] for i in order]


def collected(df):
    return plain([tuple(r) for r in df.collect()], df.columns)
