"""Run a registered query beside its SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, sf)
    got = df.collect()
    if sql is None:
        return f"no SQL, {len(got)} rows", None
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want = res.fetchall()
    problems = []
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", "columns"
    types = {d[0]: str(d[1]) for d in res.description}
    for f in df.schema:
        kind = KINDS.get(f.dataType.simpleString(), f.dataType.simpleString())
        if kind != types[f.name].upper() and not (kind == "VARCHAR" and types[f.name] == "STRING"):
            problems.append(f"type {f.name}: {kind} != {types[f.name]}")
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(columns, want)
    if a != b:
        sa, sb = set(a), set(b)
        problems.append(f"rows {len(a)} != {len(b)}; only Spark {sorted(sa - sb)[:3]}; "
                        f"only SQL {sorted(sb - sa)[:3]}")
    return f"{len(a)} rows", "; ".join(problems) or None


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from dnslake.session import build_session
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        start = time.time()
        try:
            note, problem = compare(spark, con, sf, name, fn, sql.get(name))
        except Exception as failure:  # report and go on
            note, problem = "", f"{type(failure).__name__}: {str(failure)[:600]}"
            if only:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'BAD' if problem else 'ok '} {name} {time.time() - start:.1f}s {note} {problem or ''}",
              flush=True)
    print(f"{bad} bad")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
