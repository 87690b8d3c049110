"""Validation of events reads what its rules need and no more."""

from chronika.plans import registry

SF = "/root/testdata/sf0.001"


def test_references_are_not_gathered_for_rules_on_sides(spark):
    plan = registry.queries()["validate_events"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "c_custkey" not in plan
    assert plan.count("collect_list") == 1
