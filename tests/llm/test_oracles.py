"""The operators' queries against their SQL."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from commitlake.llm import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(oracles.SQL))
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    out = queries.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in out.columns)
    want = db.execute(f"SELECT {columns} FROM ({oracles.SQL[name]})").fetchall()
    assert want and Counter(tuple(r) for r in out.collect()) == Counter(want)
