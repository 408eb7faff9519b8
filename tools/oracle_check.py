"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python tools/oracle_check.py [--sf-dir DIR] [name-substring ...]
Prints one line per query: OK / MISMATCH / ERROR with row counts.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tillcast.registry import load_all  # noqa: E402
from tillcast.session import get_spark  # noqa: E402
from tillcast.sources.tables import TABLES  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        r = v if os.environ.get("EXACT_FLOATS") else round(v, 5)
        return 0.0 if r == 0 else r
    if isinstance(v, decimal.Decimal):
        return norm(float(v))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


SPARK_FAMILY = {"int": "int32", "smallint": "int16", "tinyint": "int8", "bigint": "int64", "double": "float64",
                "float": "float32", "string": "string", "date": "date", "timestamp": "timestamp",
                "timestamp_ntz": "timestamp", "boolean": "bool"}
DUCK_FAMILY = {"INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8", "BIGINT": "int64", "DOUBLE": "float64",
               "FLOAT": "float32", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp",
               "BOOLEAN": "bool", "HUGEINT": "int128"}


def type_diffs(sdf, rel):
    """Columns whose Spark and DuckDB types fall in different families."""
    st = {n: SPARK_FAMILY.get(t, t) for n, t in sdf.dtypes}
    out = []
    for name, dtype in zip([d[0] for d in rel.description], [str(d[1]) for d in rel.description]):
        fam = DUCK_FAMILY.get(dtype.upper(), dtype)
        if fam.startswith("DECIMAL"):
            fam = "decimal"
        if name in st and st[name] != fam:
            out.append(f"{name}: spark={st[name]} duck={fam}")
    return out


def duck_connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    qs, sqls = load_all()
    spark = get_spark("local[8]", 8)
    con = duck_connect(args.sf_dir)
    bad = 0
    for name in sorted(qs):
        if args.names and not any(n in name for n in args.names):
            continue
        t0 = time.time()
        try:
            sdf = qs[name](spark, args.sf_dir)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
        except Exception:
            print(f"ERROR-SPARK {name}\n{traceback.format_exc()[-2500:]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS-ONLY {name}: spark rows={len(srows)} cols={scols} ({ts:.1f}s)")
            continue
        try:
            rel = con.execute(sqls[name])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception:
            print(f"ERROR-DUCK {name}\n{traceback.format_exc()[-2500:]}")
            bad += 1
            continue
        tdiff = type_diffs(sdf, rel)
        if tdiff:
            print(f"TYPES {name}: {tdiff}")
        c1, r1 = canon(scols, srows)
        c2, r2 = canon(dcols, drows)
        if c1 != c2:
            print(f"MISMATCH-COLS {name}: spark={c1} duck={c2}")
            bad += 1
        elif r1 != r2:
            bad += 1
            print(f"MISMATCH {name}: spark={len(r1)} duck={len(r2)} rows")
            s1, s2 = set(r1), set(r2)
            print("  only spark:", list(s1 - s2)[:3])
            print("  only duck: ", list(s2 - s1)[:3])
        else:
            print(f"OK {name}: rows={len(r1)} ({ts:.1f}s)")
    print(f"done, {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
