"""Compare a named query with its check SQL on the same tables.

``python tests/compare.py FOLDER [NAME ...]`` runs some or all of them.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def tables_of(folder: str):
    base = duckdb.connect()
    base.execute("set timezone = 'UTC'")
    for name in TABLES:
        base.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return base


def normal(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted: what a value hash would see."""
    out = pd.DataFrame({c: pdf[c].map(_text) for c in sorted(pdf.columns)})
    return out.sort_values(list(out.columns), ignore_index=True)


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0) if value != int(value) or abs(value) > 1e15 else str(int(value))
    return str(value)


def difference(spark_rows: pd.DataFrame, check_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(check_rows.columns):
        return f"columns {sorted(spark_rows.columns)} against {sorted(check_rows.columns)}"
    if len(spark_rows) != len(check_rows):
        return f"{len(spark_rows)} rows against {len(check_rows)}"
    ours, theirs = normal(spark_rows), normal(check_rows)
    differ = (ours != theirs).any(axis=1)
    if differ.any():
        return f"{differ.sum()} of {len(ours)} rows differ:\n{ours[differ].head(4)}\n{theirs[differ].head(4)}"
    return None


def main(folder: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from cadenza.session import build_session

    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    base, checks, bad = tables_of(folder), oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        begun = time.time()
        try:
            df = run(spark, folder)
            rows = df.toPandas()
            took = time.time() - begun
            if name not in checks:
                print(f"rows  {name}: {len(rows)} rows, {took:.1f} s", flush=True)
                continue
            relation = base.sql(checks[name])
            wanted = relation.df()
            found = difference(rows, wanted)
            kinds = {f.name: f.dataType.simpleString() for f in df.schema}
            theirs = dict(zip(relation.columns, map(str, relation.types)))
            odd = {c: (kinds[c], theirs.get(c)) for c in kinds if _kind(kinds[c]) != _kind(theirs.get(c, ""))}
        except Exception as error:  # report and go on
            found, took, rows, odd = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - begun, [], {}
        bad += found is not None
        print(f"{'BAD ' if found else 'same'}  {name}: {len(rows)} rows, {took:.1f} s {odd or ''} {found or ''}", flush=True)
    print(f"{bad} bad", flush=True)
    return bad


def _kind(name: str) -> str:
    same = {"bigint": "i64", "int": "i32", "integer": "i32", "string": "text", "varchar": "text", "double": "f64"}
    return same.get(name.lower(), name.lower())


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
