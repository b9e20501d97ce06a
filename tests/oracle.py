"""Compare a query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float, Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _cell(v)) for k, v in x.items()))
    return x


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sf: str = SF):
    import duckdb

    from lociflow.session import TABLES

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            tail = "/*.parquet" if os.path.isdir(f"{sf}/{t}.parquet") else ""
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{tail}'")
    return con


def same(spark, name: str, sf: str = SF) -> tuple[Counter, Counter]:
    """Rows that only the query, and only the SQL, gives."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = duck(sf).execute(e.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns), (cols, df.columns)
    want = rows_of(cols, cur.fetchall())
    return got - want, want - got
