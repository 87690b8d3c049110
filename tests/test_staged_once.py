"""What the sources change is worked out once a row, whatever number of its fields is used."""

from chronika.operators import reconcile
from tests.test_reconcile import events


def test_the_fix_is_a_generated_column(spark):
    plan = reconcile.reconciled(events(spark, {}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan
