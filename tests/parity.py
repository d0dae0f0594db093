"""Compare registered queries with their oracle SQL: ``python tests/parity.py SF_DIR [name ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assayer.plans.oracles import ORACLES  # noqa: E402
from assayer.plans.queries import QUERIES  # noqa: E402
from assayer.plans.workload import TABLES  # noqa: E402


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return str(value)


def table(rows, names) -> tuple[list[str], list]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str, int]:
    df = QUERIES[name](spark, sf_dir)
    got_names, got = table([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLES:
        return True, "no oracle", len(got)
    cursor = con.execute(ORACLES[name])
    want_names, want = table(cursor.fetchall(), [d[0] for d in cursor.description])
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}", len(got)
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; only here {only_got}; only oracle {only_want}", len(got)
    return True, "equal", len(got)


def main() -> None:
    from assayer.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("OFF")
    con = oracle_connection(sf_dir)
    for name in names:
        start = time.time()
        try:
            ok, note, rows = compare(spark, con, name, sf_dir)
        except Exception as error:
            ok, note, rows = False, f"{type(error).__name__}: {str(error)[:600]}", -1
        print(f"{'ok  ' if ok else 'FAIL'} {name} rows={rows} {time.time() - start:.1f}s {note}", flush=True)


if __name__ == "__main__":
    main()
