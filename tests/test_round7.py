"""Round 7: what fits leave on the driver, and how many jobs they take."""

from __future__ import annotations

from matchloom.operators import models as M


def test_steps_of_a_choice_fit_are_no_queries_of_their_own(spark):
    """each step left a query with its plan and stages on the driver."""
    f = spark.createDataFrame([(e, o, f"k{(e + o) % 7}", 1.0 + o) for e in range(300) for o in range(3)], "event_id long, option int, key string, value double")
    c = spark.createDataFrame([(e, e * e % 3) for e in range(300)], "event_id long, chosen int")
    store = spark._jsparkSession.sharedState().statusStore()

    def queries(steps: int) -> int:
        before = store.executionsCount()
        assert M.choice_fit(f, c, steps).count() == 7
        return store.executionsCount() - before

    queries(1)
    assert queries(21) - queries(1) < 5
