from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import same

from seqmill import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, SF, plans.QUERIES[name], plans.ORACLE_SQL[name])


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


#: One bout of a user whose kinks turn by equal angles but for the last bits of their lengths and arc cosines.
EQUAL_TURNS = (
    ("click", 10.1, 35), ("click", 88.9, 51), ("click", 10.1, 12), ("purchase", 66.06, 35), ("purchase", 9.87, 35),
    ("purchase", 88.9, 12), ("purchase", 120.71, 35), ("purchase", 9.87, 35), ("click", 47.33, 12), ("purchase", 9.87, 12),
)


def write_events(path, rows, step=1):
    """events of user 2, one a second, from (type, value, k); ids are multiples of ``step``."""
    ts = [datetime(2024, 1, 1) + timedelta(seconds=i) for i in range(len(rows))]
    types, values, ks = zip(*rows, strict=True)
    events = {"event_id": range(0, len(rows) * step, step), "ts": ts, "user_id": [2] * len(rows), "event_type": types, "value": values, "props": [f'{{"k": {k}}}' for k in ks]}
    pq.write_table(pa.table({k: pa.array(v) for k, v in events.items()}), path / "events.parquet")


def test_best_detector_with_equal_turns(spark, tmp_path):
    write_events(tmp_path, EQUAL_TURNS)
    same(spark, str(tmp_path), plans.QUERIES["best_detector"], plans.ORACLE_SQL["best_detector"])


def test_best_detector_passes_over_the_events_once(spark):
    """All candidates are settled in one pass of whole trajectories; no point is shuffled once per candidate, no half searched in vain."""
    plan = plans.QUERIES["best_detector"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(x) for x in ("FileScan parquet", "MapInArrow", "ArrowEvalPython", "Generate ")] == [1, 1, 0, 0]
    assert plan.count("Exchange hashpartitioning") == 3 and "% 2) = 0" in plan.split("MapInArrow")[1]  # by user, by bout, by candidate


def test_detected_events_turns_near_reversal(spark, tmp_path):
    write_events(tmp_path, [("view", 21.47, 9), ("view", 8.8, 23), ("view", 17.85, 13)])
    same(spark, str(tmp_path), plans.QUERIES["detected_events"], plans.ORACLE_SQL["detected_events"])


def test_detector_search_with_equal_turns(spark, tmp_path):
    rows = [("click", 10.1, 12), ("click", 66.06, 35), ("purchase", 66.06, 53), ("purchase", 88.9, 12), ("purchase", 88.9, 53), ("purchase", 66.06, 51), ("purchase", 88.9, 53), ("purchase", 88.9, 35)]
    write_events(tmp_path, [*rows, ("click", 47.33, 35), ("purchase", 10.1, 53)])
    same(spark, str(tmp_path), plans.QUERIES["detector_search"], plans.ORACLE_SQL["detector_search"])


def test_free_intervals_of_a_long_sequence(spark, tmp_path):
    """Spans go on beyond 300, where the SQL ends the last interval alone."""
    write_events(tmp_path, [("view", 1.0, 50)] * 130, 9)
    same(spark, str(tmp_path), plans.QUERIES["free_intervals"], plans.ORACLE_SQL["free_intervals"])
