"""Running a query's SQL in DuckDB and comparing rows, whatever their order."""
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    db = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            db.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, bool) or value is None:
        return value
    return value if isinstance(value, int) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def of_sql(db, sql: str):
    result = db.execute(sql)
    return rows([c[0] for c in result.description], result.fetchall())


def of_frame(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
