"""Compare every query with its DuckDB SQL on one data folder.

python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = _rows(names, result.fetchall())
    found = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} expected {sorted(names)}"
    if len(found) != len(expected):
        return f"{len(found)} rows, expected {len(expected)}"
    different = [(f, e) for f, e in zip(found, expected) if f != e]
    if different:
        return f"{len(different)} rows differ, first {str(different[0])[:600]}"
    return None if found else "no rows"


def types(con, sql: str) -> dict[str, str]:
    return {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}


def main() -> int:
    import __spark_entry__ as entry
    from brevia.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:] or list(entry.queries())
    spark, con, bad = local_session(os.environ.get("BREVIA_TEST_CPUS", "8")), connect(sf_dir), 0
    for name in wanted:
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            sql = entry.oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else None
            kinds = types(con, sql) if sql else {}
            schema = {f.name: (f.dataType.simpleString(), kinds.get(f.name)) for f in df.schema}
            odd = {n: t for n, t in schema.items() if t not in {
                ("string", "VARCHAR"), ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE")}}
            problem = problem or (f"types {odd}" if odd and sql else None)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
    print("failed:", bad, "of", len(wanted))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
