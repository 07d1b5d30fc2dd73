"""Compares a registered query with its SQL counterpart, the way the driver does."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "replace") and hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


KINDS = {
    "bigint": "long", "int": "int", "integer": "int", "hugeint": "hugeint", "double": "double", "float": "float",
    "varchar": "string", "string": "string", "boolean": "boolean", "timestamp": "timestamp",
}


def kind(t) -> str:
    name = str(t).lower()
    return KINDS.get(name, name.split("(")[0])


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(((tuple(plain(r[n]) for n in names)) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, rel.types))
    mine = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [
        f"{n}: {mine[n]} vs {types[n]}" for n in names
        if kind(mine[n]) != kind(types[n]) and not mine[n].startswith(("array", "struct"))
    ]
    index = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in index) for r in rel.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, first: {str(a)[-300:]} vs {str(b)[-300:]}"
    return f"types {odd}" if odd else None


def main() -> None:
    import __spark_entry__ as entry
    from jobtide.session import get_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                result = compare(spark, con, sf_dir, fn, oracles[name])
                status = result or "ok"
            else:
                status = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as e:
            status = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not (status == "ok" or status.startswith("rows only"))
        print(f"{time.time() - start:6.2f} {name}: {status}", flush=True)
    print(f"{bad} bad, {len(queries)} queries, {len(oracles)} with SQL")


if __name__ == "__main__":
    main()
