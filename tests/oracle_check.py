"""Runs registered queries against their SQL twins: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, name, sf_dir):
    """(message or None, rows): None means equal columns and values."""
    from __spark_entry__ import oracle_sql, queries

    frame = queries()[name](spark, sf_dir)
    mine = frame.collect()
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(mine)
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    theirs = found.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}", len(mine)
    a, b = canonical([tuple(r) for r in mine], frame.columns), canonical(theirs, columns)
    if a == b:
        return None, len(mine)
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows vs {len(b)}; ours {only_a} theirs {only_b}", len(mine)


if __name__ == "__main__":
    from pagewright import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[2:] or list(queries()):
        start = time.time()
        try:
            message, rows = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            message, rows = f"{type(error).__name__}: {str(error)[:600]}", -1
        state = "ok  " if message is None else "FAIL"
        if message is None and name not in oracle_sql():
            state = "rows"
        print(state, name, rows, f"{time.time() - start:.1f}s", message[:900] if message else "", flush=True)
