"""Run every registered query next to its SQL twin and compare rows, columns, types and values.

    python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfline.plans import registry  # noqa: E402
from shelfline.session import local_session  # noqa: E402

KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "hugeint": "huge", "integer": "int", "double": "double", "float": "double",
    "string": "str", "varchar": "str", "date": "date", "timestamp": "ts", "timestamp_ntz": "ts", "boolean": "bool",
}


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}" if v != 0 else "0.000000"
    if isinstance(v, decimal.Decimal):
        return f"{v}"
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    sf = f"/root/testdata/sf{a.sf}"
    queries, sqls = registry.all_queries(), registry.all_sql()
    names = [n for n in queries if not a.names or any(n.startswith(p) for p in a.names)]
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    spark = local_session()
    bad = []
    for n in names:
        t0 = time.time()
        try:
            df = queries[n](spark, sf)
            cols = sorted(df.columns)
            rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
            t1 = time.time()
            if n not in sqls:
                print(f"ROWS  {n} rows={len(rows)} {t1 - t0:.1f}s", flush=True)
                if not rows:
                    bad.append(n)
                continue
            cur = con.execute(sqls[n])
            desc = {d[0]: str(d[1]).lower() for d in cur.description}
            ocols = sorted(desc)
            got = cur.fetchall()
            names_in = [d[0] for d in cur.description]
            idx = [names_in.index(c) for c in ocols]
            orows = sorted(tuple(norm(r[i]) for i in idx) for r in got)
            msg = ""
            if cols != ocols:
                msg = f"columns spark-only={set(cols) - set(ocols)} sql-only={set(ocols) - set(cols)}"
            else:
                types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
                tdiff = {c: (types[c], desc[c]) for c in cols if KINDS.get(types[c], types[c]) != KINDS.get(desc[c], desc[c])}
                if tdiff:
                    msg += f"types {tdiff} "
                if len(rows) != len(orows):
                    msg += f"rows {len(rows)} vs {len(orows)}"
                if rows != orows:
                    d = [(x, y) for x, y in zip(rows, orows) if x != y]
                    if d:
                        x, y = d[0]
                        msg += f" values differ in {len(d)} rows: " + "; ".join(f"{c}: {p} | {q}" for c, p, q in zip(cols, x, y) if p != q)
            if not rows:
                msg += " EMPTY"
            print(f"{'FAIL' if msg else 'ok  '}  {n} rows={len(rows)} {t1 - t0:.1f}s {msg[:900]}", flush=True)
            if msg:
                bad.append(n)
            if a.show:
                df.show(5, truncate=30)
        except Exception as e:  # report and go on
            bad.append(n)
            text = str(e)
            cut = text.find("JVM stacktrace")
            print(f"FAIL  {n} {type(e).__name__}: {text[: cut if 0 < cut < 900 else 900]}", flush=True)
            if a.show:
                traceback.print_exc()
    print(f"{len(names) - len(bad)}/{len(names)} match; bad={bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
