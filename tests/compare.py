"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, bool) or isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same_result(sdf, con, sql):
    cols = sdf.columns
    rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    assert sorted(cols) == sorted(dcols), (cols, dcols)
    order = sorted(cols)
    a = Counter(tuple(norm(r[cols.index(c)]) for c in order) for r in rows)
    b = Counter(tuple(norm(r[dcols.index(c)]) for c in order) for r in drows)
    assert len(rows) == len(drows), (len(rows), len(drows))
    assert a == b, (list((a - b).elements())[:3], list((b - a).elements())[:3])
