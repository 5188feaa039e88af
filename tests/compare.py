"""Strict comparison of a Spark result with the SQL result: names, types, every value."""

import datetime as dt

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPE_NAMES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return repr(value) if isinstance(value, float) else value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    con.execute("SET TimeZone='UTC'")
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    return types, cursor.fetchall()


def differences(df, sql, sf_dir):
    """Empty text if equal, else the first differences."""
    types, expected = oracle_rows(sql, sf_dir)
    got_types = {n: TYPE_NAMES.get(t, t) for n, t in df.dtypes}
    if got_types != types:
        return f"types differ: spark {got_types} sql {types}"
    got = _sorted(df.columns, df.collect())
    want = _sorted(list(types), expected)
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:3]
        lacking = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows, expected {len(want)}; extra {extra} lacking {lacking}"
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a} sql {b}"
    return ""
