"""Seconds of named queries after a warm-up run.

usage: python tools/time_queries.py [sf folder] name ...
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import run
from vigilflow.session import build_session


def main() -> None:
    folder, names = (sys.argv[1], sys.argv[2:]) if os.path.isdir(sys.argv[1]) else ("/root/testdata/sf0.1", sys.argv[1:])
    spark = build_session("timing", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        run(spark, name, folder)
        print(name, round(run(spark, name, folder), 2), flush=True)


if __name__ == "__main__":
    main()
