"""Small made-up tables, written as Parquet with the schemas of the test data."""

import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq

SCHEMAS = "/root/testdata/sf0.001"
DAY0 = datetime.datetime(2024, 1, 1)


def at(days: float) -> datetime.datetime:
    return DAY0 + datetime.timedelta(days=days)


def write(folder, name: str, rows: list[dict]) -> str:
    """Columns that a row leaves out are null."""
    schema = pq.read_schema(f"{SCHEMAS}/{name}.parquet")
    cols = {f.name: pa.array([r.get(f.name) for r in rows], f.type) for f in schema}
    pq.write_table(pa.table(cols, schema=pa.schema([(f.name, f.type) for f in schema])), os.path.join(folder, f"{name}.parquet"))
    return str(folder)
