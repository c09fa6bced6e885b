"""Compare a registered query with its SQL twin run by DuckDB."""

import math
import os

import duckdb

TABLES = ("documents", "labels", "pages", "benchmark", "embeddings", "conversations")


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{os.path.join(sf_dir, name)}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    return names, types, cursor.fetchall()


# Names of the same type in Spark and DuckDB.
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


def _normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def difference(df, sql: str, sf_dir: str):
    """None if equal, else a short description."""
    names, types, expected = sql_rows(sql, sf_dir)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    uneven = [(c, t, types[c]) for c, t in df.dtypes if SAME_TYPE.get(t) != types[c]]
    if uneven:
        return f"types {uneven}"
    got = _normal(df.columns, [tuple(r) for r in df.collect()])
    want = _normal(names, expected)
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first {got[:2]} / {want[:2]}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(wrong)} of {len(got)} rows differ, first {str(wrong[0])[:600]}" if wrong else None
