"""Every registered query of the reference's own operators against its SQL twin."""

from __future__ import annotations

import pytest

from quillon.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, name):
    check(spark, QUERIES[name], sf, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "position"]


def test_cidr_member_of_every_user(spark, tmp_path):
    from quillon.plans.event_queries import cidr_member

    spark.createDataFrame([(x,) for x in (0, 63, 64, 65535, 65536, 70000, 70000, None)], "user_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = {r.user_id: (r.ip, r.member) for r in cidr_member(spark, str(tmp_path)).collect()}
    assert found == {0: ("10.0.0.0", True), 63: ("10.0.0.63", True), 64: ("10.0.0.64", False), 65535: ("10.0.255.255", False), 65536: ("10.1.0.0", False), 70000: ("10.1.17.112", False)}
