"""Every registered query of the duplicate-marking operators against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from readdup.plans import queries as plans
from readdup.sources import fixture

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, name):
    found = plans.queries()[name](spark, DIR)
    columns = sorted(found.columns)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{DIR}/orders.parquet'")
    want = db.execute(plans.oracle_sql()[name])
    of = [d[0] for d in want.description]
    assert sorted(of) == columns
    assert sorted(repr([r[c] for c in columns]) for r in found.collect()) == sorted(repr([r[of.index(c)] for c in columns]) for r in want.fetchall())


def test_all_names_are_operators():
    assert len(plans.queries()) >= 39


def test_the_fixture_stores_what_its_order_needs_alone(spark):
    fixture.reads(spark, DIR)
    kept = fixture._KEPT[(spark.sparkContext.applicationId, DIR, "coordinate")]
    assert set(kept.columns) == {"idx", *fixture.SEEDS, *(f"_{c}" for c in fixture.PLACED)}


def test_frames_that_several_need_are_stored_once(spark):
    job = plans.run_once(spark, DIR, tagging_policy="all")
    for df in (job.ends, job.pair_sets, job.duplicates, job.optical):
        assert all(f.startswith(job.work.removesuffix("/")) or job.work.split("/")[-1] in f for f in df.inputFiles()) and df.inputFiles()
