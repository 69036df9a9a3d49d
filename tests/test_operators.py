import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill import functions as fn
from seqmill import sources, streaming
from seqmill.operators import intervals, joins, moments, scores, sequences, summaries, trajectory, units


def test_greedy_match_equals_a_loop(spark):
    rng = random.Random(3)
    a, b = (sorted((k, rng.randrange(30)) for k in range(6) for _ in range(12)) for _ in range(2))  # with ties
    want = []
    for k in range(6):
        free = [y for q, y in b if q == k]
        for x in [x for q, x in a if q == k]:
            near = [y for y in free if abs(y - x) <= 3]
            if near:
                y = min(near, key=lambda y: (abs(y - x), y))
                free.remove(y)
                want.append((k, x, y, abs(y - x)))
    left, right = (spark.createDataFrame(r, "k int, frame bigint") for r in (a, b))
    assert sorted(tuple(r) for r in intervals.greedy_match(left, right, "k", "frame", 3).collect()) == sorted(want)
    two = spark.createDataFrame([(0, 10), (0, 10)], "k int, frame bigint"), spark.createDataFrame([(0, 10), (0, 11)], "k int, frame bigint")
    assert sorted(r.truth for r in intervals.greedy_match(two[1], two[0], "k", "frame", 3).collect()) == [10, 10]


def test_suppression_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, f, rng.random()) for k in range(5) for f in range(40) if rng.random() < 0.6]
    want = set()
    for k in range(5):
        kept = []
        for s, f in sorted((-s, f) for q, f, s in rows if q == k):
            if all(abs(f - g) >= 5 for g in kept):
                kept.append(f)
                want.add((k, f, -s))
    got = trajectory.suppress(spark.createDataFrame(rows, "k int, frame bigint, score double"), "k", "frame", "score", 5)
    assert {tuple(r) for r in got.collect()} == want


def test_jump_gate_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(k, f, rng.random() * 100, rng.random() * 100) for k in range(4) for f in range(30)]
    want = set()
    for k in range(4):
        last = None
        for _, f, x, y in [r for r in rows if r[0] == k]:
            if last is None or ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5 <= 20 * (f - last[0]):
                last = (f, x, y)
                want.add((k, f, x, y))
    got = trajectory.jump_gate(spark.createDataFrame(rows, "k int, f bigint, x double, y double"), "k", "f", "x", "y", 20.0)
    assert {tuple(r) for r in got.collect()} == want


def test_empty_log_gives_empty_results(spark):
    empty = spark.createDataFrame([], "k int, o bigint, t string, v double")
    assert sequences.transitions(empty, "k", "o", "t").count() == 0
    assert sequences.ngram_support(sequences.token_lists(empty, "k", "o", "t"), 2).count() == 0
    assert intervals.merge_intervals(spark.createDataFrame([], "k int, start bigint, end bigint"), "k").count() == 0


def test_scalar_functions(spark):
    row = spark.range(1).select(
        fn.key_text(F.lit(" 12.0 ")).alias("a"), fn.key_text(F.lit("x1")).alias("b"), fn.lenient_int(F.lit("12.7")).alias("c"), fn.lenient_int(F.lit("no"), -1).alias("d"),
        fn.truth(F.lit("Yes")).alias("e"), fn.without_side(F.lit("Top_net shot")).alias("f"), fn.without_side(F.lit(None).cast("string")).alias("g"), fn.binned(F.lit(1.01), [0.0, 0.4, 1.01]).alias("h"),
    ).first()
    assert tuple(row) == ("12", "x1", 12, -1, True, "net shot", "none", None)


def test_set_directory(spark, tmp_path):
    for match, n in (("a b", 1), ("c", 2)):
        (tmp_path / match).mkdir()
        (tmp_path / match / f"set{n}.csv").write_text("rally,type\n1,x\n2,\n")
    rows = sources.read_set_directory(spark, str(tmp_path), ["rally", "type"]).collect()
    assert {(r.match_name, r.set_id, r.rally, r.type) for r in rows} == {("a b", 1, "1", "x"), ("a b", 1, "2", None), ("c", 2, "1", "x"), ("c", 2, "2", None)}


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    e.write.parquet(f"{tmp_path}/in")
    stream = streaming.tumbling_counts(streaming.with_event_time(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")), "1 day", "event_type")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = streaming.tumbling_counts(streaming.with_event_time(e), "1 day", "event_type")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_sequences_that_are_no_sessions_raise(spark):
    rows = spark.range(20).selectExpr("1 AS k", "id AS v")
    with pytest.raises(Exception, match="finer key"):
        rows.groupBy("k").agg(intervals.bounded(F.collect_list("v"), 19).alias("v")).collect()
    assert len(rows.groupBy("k").agg(intervals.bounded(F.collect_list("v"), 20).alias("v")).first().v) == 20


def test_cascade_equals_a_loop(spark):
    rng = random.Random(6)
    sets = [[(k, f, round(rng.random(), 6)) for k in range(4) for f in range(30) if rng.random() < 0.4] for _ in range(3)]

    def alone(rows):
        kept = []
        for s, f in sorted((-s, f) for f, s in rows):
            if all(abs(f - g) >= 4 for g, _ in kept):
                kept.append((f, -s))
        return kept

    want = {(k, f, s) for k in range(4) for f, s in alone([x for rows in sets for x in alone([(f, s) for q, f, s in rows if q == k])])}
    got = moments.cascade([spark.createDataFrame(r, "k int, frame bigint, score double") for r in sets], "k", "frame", "score", 4)
    assert {tuple(r) for r in got.collect()} == want


def test_joins_that_must_agree_raise(spark):
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "k int, x int"), spark.createDataFrame([(1, 7)], "k int, y int")
    with pytest.raises(joins.JoinError, match="2"):
        joins.required(a, b, ["k"])
    with pytest.raises(joins.JoinError, match="unequal"):
        joins.ordinal_join(a, b, ["k"], "x", "y")
    good, bad = joins.split_problems(a, b, ["k"], "lost")
    assert [tuple(r) for r in good.collect()] == [(1, 5, 7)] and [tuple(r) for r in bad.collect()] == [(2, 6, "lost")]


def test_contract_is_enforced(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, -1)], "k int, x int")
    checks = summaries.contract(rows, ["k"], negative=F.col("x") < 0)
    assert {tuple(r) for r in checks.collect()} == {("duplicate_keys", 1), ("negative", 1)}
    with pytest.raises(summaries.ContractError, match="negative: 1"):
        summaries.enforce(checks)
    summaries.enforce(summaries.contract(rows.where("x = 5"), ["k"], negative=F.col("x") < 0))


def test_two_clear_clusters_are_found(spark):
    """Twelve units around two centres: the sweep prefers two clusters, and they part the units."""
    shift = np.linspace(-0.025, 0.025, 6)
    rows = [(f"a{i}", [0.8 + x, 0.1 - x, 0.1]) for i, x in enumerate(shift.tolist())] + [(f"b{i}", [0.1 - x, 0.8 + x, 0.1]) for i, x in enumerate(shift.tolist())]
    points = spark.createDataFrame(rows, "unit string, v array<double>")
    sweep = units.kmeans_sweep(points, "v", [2, 3, 4], starts=3)
    assert units.best_k(sweep).first().k == 2
    found = {r.unit: r.cluster for r in units.clusters(points, "v", 2).collect()}
    assert len({found[f"a{i}"] for i in range(6)}) == len({found[f"b{i}"] for i in range(6)}) == 1 and len(set(found.values())) == 2
    pc = {r.unit: np.array(r.components) for r in units.principal_components(points, "v").collect()}
    x = np.array([v for _, v in rows])
    x = x - x.mean(axis=0)
    first = x @ np.linalg.svd(x)[2][0]
    own = np.array([pc[u][0] for u, _ in rows])
    own = own - own.mean()
    assert np.allclose(np.abs(own), np.abs(first), atol=1e-9)


def test_ranks_without_variation_have_no_correlation(spark):
    flat = spark.createDataFrame([(1, 2.0, 3.0), (2, 2.0, 4.0)], "k int, a double, b double")
    assert scores.spearman(flat, "a", "b").first().rho is None and scores.spearman(flat.limit(1), "a", "b").first().rho is None


def test_labels_and_ranges(spark):
    assert fn.id_ranges("1-3, 7") == [(1, 3), (7, 7)]
    for bad in ("x", "3-1"):
        with pytest.raises(ValueError):
            fn.id_ranges(bad)
    side = lambda x: fn.side_and_name(F.lit(x))
    row = spark.range(1).select(
        side("Top_net shot")["side"].alias("a"), side("Top_net shot")["name"].alias("b"), side("drive")["side"].alias("c"), side("drive")["name"].alias("d"),
        fn.delta_text(F.array(F.lit("x"), F.lit("y"), F.lit("z")), F.array(F.lit(0.1), F.lit(-0.25), F.lit(0.1)), 2).alias("e"), fn.translated(F.lit("q"), {"a": "b"}, "unknown").alias("f"),
        fn.dropout_tier(F.lit(0.0), F.lit(True)).alias("g"), fn.dropout_tier(F.lit(1.0), F.lit(False)).alias("h"),
    ).first()
    assert tuple(row) == ("Top", "net shot", "", "drive", "x(+0.100), z(+0.100)", "unknown", "exact_label_pose_dropout_lt_25", "candidate_only_all_pose_missing")


def test_rest_covers_keys_without_intervals(spark):
    keys, active = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 3, 5)], "k string, start bigint, end bigint")
    assert {tuple(r) for r in moments.rest(active, keys, "k", 1, 10).collect()} == {("a", 0, 1), ("a", 7, 9), ("b", 0, 9)}


def test_sinks_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("x", "y", 0.25), ("y", "x", 1.0)], "cur string, nxt string, value double")
    sources.write_matrix(cells, f"{tmp_path}/m", ["x", "y"])
    assert {tuple(r) for r in sources.read_matrix(spark, f"{tmp_path}/m", ["x", "y"]).collect()} == {("x", "x", 0.0), ("x", "y", 0.25), ("y", "x", 1.0), ("y", "y", 0.0)}
    sources.write_json(cells, f"{tmp_path}/j")
    assert sorted(map(tuple, spark.read.schema(cells.schema).json(f"{tmp_path}/j").collect())) == sorted(map(tuple, cells.collect()))
    sources.write_partitioned(cells, f"{tmp_path}/p", "cur")
    assert spark.read.parquet(f"{tmp_path}/p").where("cur = 'x'").count() == 1
    sources.write_columns(cells, f"{tmp_path}/c", ["nxt", "more"], "csv")
    assert {tuple(r) for r in sources.read_text_csv(spark, f"{tmp_path}/c", ["nxt", "more"]).collect()} == {("y", None), ("x", None)}
    (tmp_path / "k" / "smash").mkdir(parents=True)
    (tmp_path / "k" / "smash" / "1.bin").write_bytes(b"abc")
    assert [(r.label, r.length) for r in sources.read_classes(spark, f"{tmp_path}/k").collect()] == [("smash", 3)]


def test_lengths_and_bones_of_small_arrays(spark):
    from seqmill.functions import tensors

    points = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array(i.cast("double"), F.lit(0.0)))
    rows = spark.createDataFrame([(n,) for n in (3, 4, 5, 7, 9)], "n int").withColumn("p", tensors.thinned(points, 4))
    got = {r.n: [x[0] for x in r.q] for r in rows.select("n", tensors.padded(F.col("p"), 4, F.array(F.lit(0.0), F.lit(0.0))).alias("q")).collect()}
    assert got == {3: [1, 2, 3, 0], 4: [1, 2, 3, 4], 5: [1, 2, 3, 4], 7: [1, 3, 5, 7], 9: [1, 3, 5, 7]}
    two = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(0.0)))
    row = spark.range(1).select(tensors.bones(two, [(0, 1)]).alias("b"), tensors.mid_joints(two, [(0, 1)]).alias("m")).first()
    assert row.b == [[3.0, 0.0]] and row.m == [[2.5, 0.0]]
    none = spark.createDataFrame([([],)], "p array<array<double>>").select(tensors.last_visible(F.col("p")).alias("l"), tensors.frame_at(F.col("p"), F.lit(3)).alias("f")).first()
    assert none.l is None and none.f is None
