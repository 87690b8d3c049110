"""Replays are gathered as the numbers of their lines."""

from chronika.plans import replay_queries

SF = "/root/testdata/sf0.001"


def test_replays_shuffle_numbers_not_phases(spark):
    plan = replay_queries.made(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "collect_list" in line and "narration" in line]
