"""Compare every registered Spark query with its DuckDB SQL on the same parquet tables.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows, schema and value comparison (exact and with a
float tolerance).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from kestrel.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_DT = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
       "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "FLOAT": "float", "SMALLINT": "smallint"}


def duck_type(t: str) -> str:
    if t.endswith("[]"):
        return f"array<{duck_type(t[:-2])}>"
    return _DT.get(t, t)


def _norm(v, tol):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, tol) if tol is not None else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, tol) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, tol)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), tol)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item(), tol)
        except Exception:  # noqa: BLE001
            return v
    return v


def rows_of(values, cols, tol):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], tol) for i in order) for r in values]
    return sorted(out, key=repr)


def compare(spark, sf_dir: str, key: str, con) -> tuple[bool, str]:
    qfn = E.queries()[key]
    sql = E.oracle_sql().get(key)
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return True, f"{key}: rows={len(srows)} (no oracle) {t1 - t0:.1f}s"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    msgs = []
    ok = True
    if sorted(scols) != sorted(dcols):
        return False, f"{key}: COLUMNS spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        ok = False
        msgs.append(f"ROWS spark={len(srows)} duck={len(drows)}")
    # exact: compare value text, so -0.0 vs 0.0 or last-bit float differences show up
    exact = [repr(r) for r in rows_of(srows, scols, None)] == [repr(r) for r in rows_of(drows, dcols, None)]
    loose = rows_of(srows, scols, 6) == rows_of(drows, dcols, 6)
    if not loose:
        ok = False
        a, b = rows_of(srows, scols, 6), rows_of(drows, dcols, 6)
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        msgs.append(f"VALUES differ e.g. {diff}")
    stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    dtypes = {d[0]: duck_type(str(d[1])) for d in res.description}
    bad_t = {k: (stypes[k], dtypes[k]) for k in stypes if stypes[k] != dtypes.get(k)}
    if bad_t:
        msgs.append(f"TYPES {bad_t}")
    status = "OK" if ok else "FAIL"
    extra = "" if exact else " (float-tolerance only)"
    return ok, f"{key}: {status}{extra} rows={len(srows)} {t1 - t0:.1f}s {'; '.join(msgs)}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and "/" in sys.argv[1] else "/root/testdata/sf0.01"
    keys = [k for k in sys.argv[1:] if "/" not in k] or list(E.queries())
    from kestrel.session import get_session
    spark = get_session("local[8]")
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            ok, msg = compare(spark, sf_dir, k, con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{k}: ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(msg, flush=True)
    print(f"failed {bad} of {len(keys)}")


if __name__ == "__main__":
    main()
