"""Comparison of a query with its SQL, as sorted rows."""

import glob
import os

import duckdb


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 9))
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
    relation = con.sql(sql)
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(row[i]) for i in place]) for row in relation.fetchall())
    assert mine == theirs
    return len(mine)
