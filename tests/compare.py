"""Compare registered queries with their SQL in DuckDB, as the driver does: same columns, same rows, any order."""

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " commits file_changes components touches cases evidence loads mix_targets"
).split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(p):
            continue
        c.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return c


def rows_of(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.select(*names).collect())


def compare(spark: SparkSession, sf_dir: str, f, sql: str, con=None) -> str:
    """Empty if equal, else what differs."""
    names, ours = rows_of(f(spark, sf_dir))
    cur = (con or duck(sf_dir)).execute(sql)
    theirs_names = [x[0] for x in cur.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only ours {list((ours - theirs).items())[:4]}; only SQL {list((theirs - ours).items())[:4]}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from loamline.session import local_session

    d = f"/root/testdata/{sys.argv[1]}"
    spark, q, s = local_session(), e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or q:
        t = time.time()
        try:
            if n in s:
                said = compare(spark, d, q[n], s[n]) or "same"
            else:
                said = f"{q[n](spark, d).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            said = f"FAILED {str(x)[:1500]}"
        print(f"{n}: {said} ({time.time() - t:.1f} s)", flush=True)
