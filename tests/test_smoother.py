import random

import pytest

from seqmill.operators.intervals import smooth_states
from seqmill.streaming import smoother

SCHEMA = "video int, frame long, sa int"


@pytest.fixture
def store(spark):
    spark.conf.set(*smoother.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(smoother.STORE[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def run(spark, at, length, idle_ms=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    out = smoother.smooth_stream(stream, "video", "frame", "sa", length, idle_ms)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(20 if idle_ms else 120)  # timers keep a query going
    query.stop()
    assert query.exception() is None
    return sorted(tuple(r) for r in spark.read.parquet(f"{at}/out").collect())


def test_stream_equals_the_table_and_survives_a_restart(store, tmp_path):
    """Batches cut runs and windows anywhere; the second run goes on from the checkpoint of the first."""
    rng = random.Random(4)
    rows = [(v, f * 3, int(rng.random() < (0.8 if f // 25 % 2 else 0.2))) for v, n in ((1, 120), (2, 4), (3, 3), (4, 57)) for f in range(n)]
    cuts = [0, 20, 21, 60, 95, 200]
    for run_, batches in enumerate((cuts[:4], cuts[3:])):
        for a, b in zip(batches, batches[1:], strict=False):
            part = [r for r in rows if a <= r[1] // 3 < b]
            rng.shuffle(part)
            store.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen = [r for r in rows if r[1] // 3 < batches[-1]]
        want = smooth_states(store.createDataFrame(seen, SCHEMA), "video", "frame", "sa", 4).select("video", "frame", "sa", "state", "change").collect()
        assert run(store, tmp_path, 4) == sorted(tuple(r) for r in want), run_
    assert {r[3] for r in want} == {0, 1} and not any(r[0] == 3 for r in want)


def test_repeats_and_missing_samples_go(store, tmp_path):
    for part in ([(1, 1, 1), (1, 2, 1), (1, 3, 1)], [(1, 2, 0), (1, None, 1), (1, 4, None), (1, 5, 0)], [(None, 1, 1), (None, 2, 1), (1, 6, 0)]):
        store.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(store, tmp_path, 2, idle_ms=600_000)
    assert got == [(1, 1, 1, 1, 1), (1, 2, 1, 1, 0), (1, 3, 1, 1, 0), (1, 5, 0, 0, -1)]


def test_tables_and_other_stores_are_refused(spark):
    with pytest.raises(ValueError, match="stream"):
        smoother.smooth_stream(spark.createDataFrame([(1, 1, 1)], SCHEMA), "video", "frame", "sa", 4)
    with pytest.raises(ValueError, match="providerClass"):
        smoother.smooth_stream(spark.readStream.schema(SCHEMA).parquet("/root/testdata/sf0.001"), "video", "frame", "sa", 4)
