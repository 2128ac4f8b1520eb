"""Registered queries against DuckDB, and random filters against a plain model of matching."""

import random

import duckdb
import pytest

from quillstream.model import EventFilter, EventReference, FilterItem, Tag, Tags
from quillstream.plans import predicates as P
from quillstream.queries import QUERIES, SQL, log_view


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())


def test_random_filters(spark, sf):
    log = log_view(spark, sf).cache()
    rows = log.select("position", "tx", "event_type", "event_tags").collect()
    rng = random.Random(5)
    types = ["click", "view", "purchase", "signup", "error", "none"]
    pool = [t for r in rows[:50] for t in r.event_tags]
    for _ in range(12):
        items = tuple(
            FilterItem(frozenset(rng.sample(types, rng.randint(0, 3))), Tags.of(*rng.sample(pool, rng.randint(0, 2)))) for _ in range(rng.randint(0, 3))
        )
        until = EventReference("x", rng.randint(1, 900), rng.randint(1, 300)) if rng.random() < 0.5 else None
        f = EventFilter(items, until)
        want = sorted(
            r.position for r in rows
            if f.matches(r.event_type, Tags(Tag.parse(t) for t in r.event_tags), EventReference("x", r.position, r.tx))
        )
        assert sorted(r.position for r in log.where(P.filter_matches(f)).select("position").collect()) == want
    log.unpersist()


def test_entry():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
