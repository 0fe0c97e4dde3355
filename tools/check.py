"""Compare every named query with its checking SQL.

usage: python tools/check.py [sf folder] [name part ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from vigilflow.catalog import ORACLES, QUERIES
from vigilflow.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def cell(value):
    """Value in a form both engines share; floats stay exact."""
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(cell(row[i])) for i in order) for row in rows)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for name in TABLES.split():
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, function in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        begin = time.time()
        try:
            frame = function(spark, folder)
            mine = [tuple(r) for r in frame.collect()]
            spent = time.time() - begin
            if name not in ORACLES:
                print(f"rows  {name:34s} {len(mine):8d} {spent:6.2f}s")
                continue
            result = duck.execute(ORACLES[name])
            columns = [d[0] for d in result.description]
            theirs = result.fetchall()
            kinds = dict(zip(columns, [str(d[1]) for d in result.description]))
            a, b = rows_of(frame.columns, mine), rows_of(columns, theirs)
            same = sorted(frame.columns) == sorted(columns) and a == b
            print(f"{'ok  ' if same else 'DIFF'}  {name:34s} {len(mine):8d} {spent:6.2f}s", flush=True)
            if not same:
                bad += 1
                print("   spark", dict(frame.dtypes), "\n   duck ", kinds)
                missing, extra = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
                print(f"   rows {len(a)} / {len(b)}\n   only spark {missing}\n   only duck  {extra}", flush=True)
        except Exception as error:  # a failing query is reported, the others still run
            bad += 1
            text = traceback.format_exc() if os.environ.get("TRACE") else str(error)
            causes = "\n".join(line for line in text.splitlines() if "Caused by" in line or "- " in line[:4] or "object (class" in line)
            print(f"FAIL  {name}: {text[:1500]}\n{causes[:3000]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
