"""A query against its SQL twin in DuckDB: column names, row counts and values."""

from __future__ import annotations

import math
from pathlib import Path


def duck(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [x[0] for x in found.description], found.fetchall()


def canonical(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    number = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(None if isinstance(v := r[k], float) and math.isnan(v) else number(v) for k in order) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))


def check(spark, f, sf: str, sql: str) -> int:
    df = f(spark, sf)
    names, rows = duck(sf, sql)
    assert sorted(df.columns) == sorted(names)
    mine, theirs = canonical(df.columns, df.collect()), canonical(names, rows)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, next((a, b) for a, b in zip(mine, theirs, strict=True) if a != b)
    return len(mine)
