"""Runs a query in Spark and its SQL in DuckDB and compares all rows, in any order."""

from __future__ import annotations

import duckdb
import pandas as pd
import pyarrow as pa

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return repr(value.item() if hasattr(value, "item") else value)


def as_pandas(df) -> pd.DataFrame:
    """A Spark result whose integers stay integers where some are null, as DuckDB gives them."""
    table = df.toArrow()
    columns = {}
    for name, column in zip(table.column_names, table.columns):
        mapper = NULLABLE.get if column.null_count else None
        columns[name] = column.to_pandas(types_mapper=mapper)
    return pd.DataFrame(columns)


def _kind(dtype) -> str:
    return str(dtype)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False))


def differences(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    left, right = sorted(spark_frame.columns), sorted(duck_frame.columns)
    if left != right:
        return f"columns {left} != {right}"
    types = [
        (c, _kind(spark_frame[c].dtype), _kind(duck_frame[c].dtype))
        for c in left
        if _kind(spark_frame[c].dtype) != _kind(duck_frame[c].dtype)
    ]
    mine, theirs = rows(spark_frame), rows(duck_frame)
    if mine != theirs:
        only_mine = [r for r in mine if r not in set(theirs)][:2]
        only_theirs = [r for r in theirs if r not in set(mine)][:2]
        return f"{len(mine)} vs {len(theirs)} rows; spark {only_mine}; duckdb {only_theirs}"[:3000]
    types = [t for t in types if not {"str", "object"} >= set(t[1:]) and "datetime" not in t[1]]
    return f"types {types}" if types else None
