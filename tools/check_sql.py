"""Run registered queries on Spark and their SQL text on DuckDB, and compare the rows.

usage: check_sql.py <table folder> [name prefix ...] [setting=value ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.registry import all_queries, all_sql  # noqa: E402
from tidemark.session import build_session  # noqa: E402
from tidemark.sources.tables import SCHEMAS  # noqa: E402


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != 0 else "0"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return value
    return str(value)


def kinds(rows, names):
    """The Python types seen in each column."""
    return {n: sorted({type(v).__name__ for v in (r[i] for r in rows) if v is not None}) for i, n in enumerate(names)}


def run_both(spark, db, folder: str, run, text: str | None):
    """(column names, Spark rows, SQL rows); the SQL rows are None without a text."""
    frame = run(spark, folder)
    names = sorted(frame.columns)
    mine = [tuple(r) for r in frame.select(*[f"`{n}`" for n in names]).collect()]
    if text is None:
        return names, mine, None
    cursor = db.execute(text)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        raise ValueError(f"columns {names} against {sorted(found)}")
    places = [found.index(n) for n in names]
    return names, mine, [tuple(r[i] for i in places) for r in cursor.fetchall()]


def as_counts(rows) -> Counter:
    return Counter(tuple(map(plain, r)) for r in rows)


def open_tables(folder: str):
    db = duckdb.connect()
    for table in SCHEMAS:
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return db


def main() -> int:
    words = sys.argv[1:]
    settings = dict(w.split("=", 1) for w in words if "=" in w)
    folder, *prefixes = [w for w in words if "=" not in w]
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("check", "local[8]", **{**defaults, **settings})
    spark.sparkContext.setLogLevel("OFF")
    db, texts, bad, checked = open_tables(folder), all_sql(), [], 0
    for name, run in all_queries().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        start = time.time()
        try:
            names, mine, theirs = run_both(spark, db, folder, run, texts.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            bad.append(name)
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:600]}")
            continue
        spent = time.time() - start
        checked += 1
        if not mine:
            print(f"EMPTY {name}")
        if theirs is None:
            print(f"rows {name}: {len(mine)} rows {spent:.1f}s")
            continue
        left, right = kinds(mine, names), kinds(theirs, names)
        if left != right:
            print(f"TYPE {name}:", {n: (left[n], right[n]) for n in names if left[n] != right[n]})
        a, b = as_counts(mine), as_counts(theirs)
        if a == b:
            print(f"ok   {name}: {len(mine)} rows {spent:.1f}s")
        else:
            bad.append(name)
            print(f"DIFF {name}: {len(mine)} vs {len(theirs)}; columns {names}")
            print("   only spark:", list((a - b).items())[:3])
            print("   only sql:  ", list((b - a).items())[:3])
    print(f"{checked} run, {len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
