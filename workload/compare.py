"""Run queries in Spark and their SQL in DuckDB and compare rows.

``python -m workload.compare /root/testdata/sf0.01 [query ...]``
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

from workload.oracle import ORACLE
from workload.queries import QUERIES


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _types(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def difference(spark, con, name: str, sf: str) -> str | None:
    """What differs between the two results, or None."""
    ours = QUERIES[name](spark, sf).toArrow()
    theirs = con.sql(ORACLE[name]).to_arrow_table()
    if sorted(ours.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(ours.column_names)} != {sorted(theirs.column_names)}"
    order = sorted(ours.column_names)
    ours, theirs = ours.select(order), theirs.select(order)
    if _types(ours) != _types(theirs):
        mine, other = _types(ours), _types(theirs)
        return "types " + str({c: (mine[c], other[c]) for c in order if mine[c] != other[c]})
    left = Counter(zip(*[c.to_pylist() for c in ours.columns]))
    right = Counter(zip(*[c.to_pylist() for c in theirs.columns]))
    if left != right:
        extra, missing = left - right, right - left
        return (
            f"{ours.num_rows} rows vs {theirs.num_rows}; ours only {sum(extra.values())}: "
            f"{list(extra)[:2]}; sql only {sum(missing.values())}: {list(missing)[:2]} ({order})"
        )
    return None if ours.num_rows else "both results are empty"


def main() -> int:
    from coffer.session import local_session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), duck(sf)
    failed = 0
    for name in wanted or QUERIES:
        if name not in ORACLE:
            print(f"--   {name}: no SQL", flush=True)
            continue
        began = time.time()
        try:
            problem = difference(spark, con, name, sf)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
