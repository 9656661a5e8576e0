"""Run queries next to their SQL twins: python tools/compare.py [--sf DIR] [--explain] [key prefixes]."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from waymark.plans import registry  # noqa: E402
from waymark.sources.tables import TABLES  # noqa: E402


def local_session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def kind(value) -> str:
    name = type(value).__name__
    return {"float64": "float", "int64": "int", "Decimal": "DECIMAL"}.get(name, name)


def canon(rows, order):
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("--plain", action="store_true", help="session without tuning, as a driver might make it")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").getOrCreate() if args.plain else local_session()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    queries, oracles = registry.all_queries(), registry.all_oracles()
    bad = []
    for key, fn in queries.items():
        if args.keys and not any(key == k or key.startswith(k + "_") or (k.endswith("*") and key.startswith(k[:-1])) for k in args.keys):
            continue
        try:
            t0 = time.time()
            df = fn(spark, args.sf)
            if args.explain:
                df.explain("formatted")
            rows = [tuple(r) for r in df.collect()]
            t1 = time.time()
            if key not in oracles:
                print(f"ROWS {key}: {len(rows)} rows {t1 - t0:.2f}s", flush=True)
                continue
            cur = con.execute(oracles[key])
            names = [d[0] for d in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            problems = []
            if sorted(names) != sorted(df.columns):
                problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
            else:
                mine = [df.columns.index(c) for c in sorted(names)]
                theirs = [names.index(c) for c in sorted(names)]
                a, b = canon(rows, mine), canon(want, theirs)
                if rows and want:
                    for c, i, j in zip(sorted(names), mine, theirs):
                        ka = {kind(r[i]) for r in rows if r[i] is not None}
                        kb = {kind(r[j]) for r in want if r[j] is not None}
                        if ka != kb:
                            problems.append(f"type {c}: {ka} vs {kb}")
                if a != b:
                    sa, sb = set(a), set(b)
                    problems.append(
                        f"rows {len(a)} vs {len(b)}; sample mine {sorted(sa - sb)[:2]} theirs {sorted(sb - sa)[:2]}; "
                        f"n {len(sa - sb)}/{len(sb - sa)}"
                    )
            state = "BAD " if problems else "ok  "
            note = "" if rows else " EMPTY"
            print(f"{state} {key}: {len(rows)} rows spark {t1 - t0:.2f}s sql {t2 - t1:.2f}s{note}", flush=True)
            for p in problems:
                print("     ", p, "cols", sorted(names), flush=True)
            if problems:
                bad.append(key)
        except Exception as error:  # noqa: BLE001
            bad.append(key)
            print(f"FAIL {key}: {str(error)[:1500]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
