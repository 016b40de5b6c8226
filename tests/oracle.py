"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, decimal.Decimal, float)):
        return round(float(value), 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def differences(query, spark, con, sf_dir: str) -> list[str]:
    frame = query.run(spark, sf_dir)
    names = sorted(frame.columns)
    mine = Counter(tuple(_plain(v) for v in row) for row in frame.select(*[f"`{n}`" for n in names]).collect())
    if query.sql is None:
        return [] if mine else ["no rows"]
    result = con.execute(query.sql)
    theirs_names = [column[0] for column in result.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} against {sorted(theirs_names)}"]
    order = [theirs_names.index(name) for name in names]
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())
    if not theirs:
        return ["SQL gives no rows"]
    if mine == theirs:
        return []
    extra, lacking = mine - theirs, theirs - mine
    return [
        f"rows {sum(mine.values())} against {sum(theirs.values())}",
        *[f"only here:  {str(row)[:700]}" for row in list(extra)[:2]],
        *[f"only there: {str(row)[:700]}" for row in list(lacking)[:2]],
    ]


if __name__ == "__main__":
    from tripleloom.session import build_session
    from tripleloom.workloads import ALL

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session("oracle", master="local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name, query in ALL.items():
        if wanted and name not in wanted:
            continue
        begun = time.time()
        try:
            found = differences(query, session, connection, sf_dir)
        except Exception as error:  # keep going, report all
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(found)
        print(f"{'ok  ' if not found else 'FAIL'} {name} {time.time() - begun:.2f}s", *found, sep="\n     " if found else " ")
    print(f"{failed} failed")
