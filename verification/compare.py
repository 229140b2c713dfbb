"""Run queries beside their SQL twins in DuckDB and report differences.

    python -m verification.compare /path/to/tables [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from verification.registry import ORACLES, QUERIES

TYPES = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(directory, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return a == b


def compare(spark, con, directory: str, name: str) -> tuple[bool, str]:
    """Whether query and twin agree in names, types, row count and values."""
    df = QUERIES[name](spark, directory)
    got_cols = sorted(df.dtypes)
    got = [tuple(r[c] for c, _ in got_cols) for r in df.collect()]
    res = con.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    kinds = {d[0]: TYPES.get(str(d[1]).upper(), str(d[1])) for d in res.description}
    raw = res.fetchall()
    want_cols = sorted(kinds.items())
    order = [names.index(c) for c, _ in want_cols]
    want = [tuple(r[i] for i in order) for r in raw]
    if [c for c, _ in got_cols] != [c for c, _ in want_cols]:
        return False, f"columns {got_cols} != {want_cols}"
    notes = "" if got_cols == want_cols else f"types {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    for a, b in zip(sorted(got, key=_key), sorted(want, key=_key)):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return False, f"\n   got  {a}\n   want {b}\n   {[c for c, _ in got_cols]}"
    return not notes, notes or f"{len(got)} rows"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    directory, wanted = argv[0], argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        if name not in ORACLES:
            rows = len(QUERIES[name](spark, directory).collect())
            print(f"rows {name:32s} {time.time() - start:5.1f}s  {rows}", flush=True)
            continue
        try:
            fine, note = compare(spark, con, directory, name)
        except Exception as error:
            fine, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += not fine
        print(f"{'ok  ' if fine else 'FAIL'} {name:32s} {time.time() - start:5.1f}s  {note}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
