"""Registered queries of the library against their SQL."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from tessera import queries

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda v: [fix(x) for x in v] if isinstance(v, list | tuple) else round(v, 6) if isinstance(v, float) else v
    return sorted(str([fix(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    out = queries.QUERIES[name](spark, SF)
    names = sorted(out.columns)
    got = plain(map(tuple, out.select(*(f"`{n}`" for n in names)).collect()))
    if name not in queries.ORACLES:
        assert got
        return
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    order = [columns.index(n) for n in names]
    assert sorted(columns) == names and got == plain([r[i] for i in order] for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= set(__spark_entry__.queries())


def test_library_stands_without_the_optional_part():
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, files in os.walk(os.path.join(root, "tessera")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as source:
                    assert not re.search(r"\bllm\b", source.read())
