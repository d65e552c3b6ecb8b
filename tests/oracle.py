"""Run registered queries next to their SQL oracle and compare whole results."""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value + 0.0:.9g}")
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, str]:
    """('ok' | 'rows' | 'DIFF', detail)."""
    from tierloom.plans.registry import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in ORACLES:
        return "rows", f"{len(got)} rows"
    cur = con.execute(ORACLES[name])
    have = [d[0] for d in cur.description]
    if sorted(have) != names:
        return "DIFF", f"columns {names} vs {sorted(have)}"
    order = [have.index(c) for c in names]
    want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    kinds_got = {c: {type(r[i]).__name__ for r in got if r[i] is not None} for i, c in enumerate(names)}
    kinds_want = {c: {type(r[i]).__name__ for r in want if r[i] is not None} for i, c in enumerate(names)}
    if got and want and kinds_got != kinds_want:
        bad = {c: (kinds_got[c], kinds_want[c]) for c in names if kinds_got[c] != kinds_want[c]}
        return "DIFF", f"types {bad}"
    a, b = Counter(got), Counter(want)
    if a != b:
        return "DIFF", (f"{len(got)} vs {len(want)} rows; spark only {list((a - b).items())[:3]}; "
                        f"sql only {list((b - a).items())[:3]}")
    return ("ok", f"{len(got)} rows") if got else ("DIFF", "no rows on either side")


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("prefix", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    from tierloom import plans  # noqa: F401
    from tierloom.plans.registry import QUERIES
    from tierloom.session import local_session

    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(os.environ.get("BENCH_CPUS", "8")), database(sf_dir)
    bad = 0
    for name in QUERIES:
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        t = time.time()
        try:
            state, detail = compare(spark, con, name, sf_dir)
        except Exception as exc:
            state, detail = "FAIL", f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += state in ("DIFF", "FAIL")
        print(f"{state:5} {name} {time.time() - t:.1f}s {detail}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
