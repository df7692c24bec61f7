"""Queries downstream of the policy must plan and run with the optimizer's
default settings (the driver's session), not only with the settings that
``get_session`` applies."""

import pytest

import __spark_entry__ as E
from compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture
def default_optimizer(spark):
    key = "spark.sql.constraintPropagation.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    yield spark
    spark.conf.set(key, old)


@pytest.mark.parametrize("name", ["decline_reasons", "case_selection", "pricing_distribution", "gate_evaluation"])
def test_policy_consumers_with_default_optimizer(default_optimizer, name):
    r = compare(default_optimizer, name, SF, duck(SF))
    assert r["status"] == "match", r
