"""Queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb

from compare import rows

FOLDER = os.environ.get("PLUMBLINE_TABLES", "/root/testdata/sf0.001")
TABLES = "documents embeddings dataset_index manifest near_pairs features audit_runs class_list eval_items".split()


def agree(spark, module, name: str) -> None:
    got = module.QUERIES[name](spark, FOLDER).toPandas()
    if name in module.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
        want = con.sql(module.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
