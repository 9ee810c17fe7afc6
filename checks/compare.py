"""Runs every query next to its SQL and reports differences.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from checks.queries import QUERIES, SQL
from checks.tables import Data
from countylens.session import local_session


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def norm(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](Data(spark, folder))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in SQL:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    want = rows_of(names, rel.fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return False, (f"{len(got)} vs {len(want)} rows; only Spark {sorted(extra, key=repr)[:2]}; "
                       f"only SQL {sorted(missing, key=repr)[:2]}")[:900]
    kinds = dict(df.dtypes)
    sql_kinds = {c[0]: str(c[1]) for c in rel.description}
    return True, f"{len(got)} rows, {took:.1f}s, " + ", ".join(
        f"{c}:{kinds[c]}/{sql_kinds[c]}" for c in sorted(kinds))


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), duck(folder)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree", bad)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
