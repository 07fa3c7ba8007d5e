"""Every registered query of the engine against its SQL, at the smallest size."""

import os

import duckdb
import pytest

from tidemark.plans import banding, scanning, services, streams  # noqa: F401
from tidemark.plans.catalogue import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def ordered(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted(tuple(str(r[k]) for k in at) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = ordered(frame.columns, [tuple(r) for r in frame.collect()])
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        assert got == ordered([c[0] for c in found.description], found.fetchall())
