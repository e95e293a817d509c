"""Runs catalogue queries next to their SQL and compares all values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def compare(spark_df, sql, connection):
    """Differences in names or values, none if there are none."""
    rel = connection.sql(sql)
    names = sorted(spark_df.columns)
    assert names == sorted(rel.columns), (names, rel.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    a = sorted((tuple(_plain(x) for x in r) for r in spark_df.select(*names).collect()), key=key)
    b = sorted((tuple(_plain(x) for x in r) for r in rel.select(", ".join(f'"{n}"' for n in names)).fetchall()), key=key)
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y] if len(a) == len(b) else [(len(a), len(b))]
