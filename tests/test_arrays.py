import numpy as np
import pytest

from seqmill.sources import arrays


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    made = {"a.npy": rng.normal(size=(1000, 3, 2)), "b.npy": rng.integers(0, 9, (57, 4)).astype(np.int16), "c.npy": np.zeros((0, 5), np.float32), "d.npy": np.array([1.5, np.nan, -2.0], np.float32)}
    for name, a in made.items():
        np.save(tmp_path / name, a)
    return str(tmp_path), made


def test_rows_of_all_files_in_ranges(spark, folder):
    at, made = folder
    df = arrays.scan_npy(spark, at, 4800)
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 10 + 1 + 1
    assert len(rows) == 1060
    for r in rows:
        assert np.array_equal(np.array(r["values"]), made[r.file][r.row_index].ravel().astype(float), equal_nan=True)
    assert {(r.file, r.row_index) for r in rows} == {(n, i) for n, a in made.items() for i in range(len(a))}


def test_filters_prune_ranges(spark, folder):
    at, made = folder
    one = arrays.scan_npy(spark, at, 480).where("file = 'a.npy' AND row_index >= 500 AND row_index < 517")
    assert sorted(r.row_index for r in one.collect()) == list(range(500, 517))
    assert one.rdd.getNumPartitions() == 2
    assert arrays.scan_npy(spark, at).where("row_index = 2 AND file IN ('b.npy', 'd.npy')").count() == 2
    assert arrays.scan_npy(spark, at).where("row_index > 100000").count() == 0
    assert arrays.scan_npy(spark, at).where("row_index <= 1 AND row_index < 40").count() == 6
    assert arrays.scan_npy(spark, f"{at}/b*.npy").count() == 57


def test_shapes_and_bad_files(spark, folder, tmp_path_factory):
    at, made = folder
    got = {r.file: (r.dtype, r["shape"], r.n_rows) for r in arrays.npy_shapes(spark, at).collect()}
    assert got == {n: (str(a.dtype), list(a.shape), len(a)) for n, a in made.items()}
    other = tmp_path_factory.mktemp("bad")
    for i, a in enumerate((np.array(3.0), np.asfortranarray(np.ones((2, 3))), np.array(["x"]))):
        np.save(other / f"{i}.npy", a)
        with pytest.raises(ValueError, match="C order"):
            arrays.header(str(other / f"{i}.npy"))
    np.save(other / "cut.npy", np.ones(100))
    (other / "cut.npy").write_bytes((other / "cut.npy").read_bytes()[:-8])
    with pytest.raises(ValueError, match="shorter"):
        arrays.header(str(other / "cut.npy"))
    with pytest.raises(FileNotFoundError):
        arrays.npy_shapes(spark, f"{at}/none")


def test_gather_by_row_index(spark, folder):
    at, made = folder
    asked = spark.createDataFrame([(1, "b.npy", 56), (2, "b.npy", 56), (3, "b.npy", 57), (4, "a.npy", 0), (5, None, 0), (6, "d.npy", None), (7, "d.npy", -1)], "id int, file string, at long")
    rows = {r.id: r for r in arrays.gathered(asked, arrays.scan_npy(spark, at), "at").collect()}
    assert [rows[i].in_range for i in range(1, 8)] == [True, True, False, True, False, False, False]
    assert rows[2]["values"] == made["b.npy"][56].astype(float).tolist() and rows[3]["values"] is None
    assert np.allclose(rows[4]["values"], made["a.npy"][0].ravel())


def test_sink_commits_whole_jobs_only(spark, tmp_path):
    at = str(tmp_path / "out")
    rows = [(i, [float(i), i / 2, -1.0]) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, values array<double>").repartition(5)
    arrays.write_npy(df, at, 3)
    read = lambda: sorted(tuple(r["values"]) for r in arrays.scan_npy(spark, at).collect())
    want = sorted(tuple(v) for _, v in rows)
    assert read() == want and sum(f["n_rows"] for f in arrays.manifest(at)) == 500
    for bad in ([(1, [1.0, float("nan"), 2.0])], [(1, [1.0, None, 2.0])], [(1, [1.0])], [(1, None)], [(1, [1.0, 2.0, float("inf")])]):
        with pytest.raises(Exception, match="finite values"):
            arrays.write_npy(df.union(spark.createDataFrame(bad, df.schema)), at, 3)
        assert read() == want
    with pytest.raises(Exception, match="different widths"):
        arrays.write_npy(spark.createDataFrame([(1, [1.0])], df.schema), at)
    assert read() == want
    (tmp_path / "out" / "part-stray.npy").write_bytes(b"half")
    arrays.write_npy(df.limit(0), at, 3)
    assert read() == want
    arrays.write_npy(df.where("i < 7"), at, 3)
    assert len(read()) == 507
    arrays.write_npy(df.where("i < 2"), at, 3, "overwrite")
    assert read() == [(0.0, 0.0, -1.0), (1.0, 0.5, -1.0)]
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    arrays.write_npy(df.limit(0), str(tmp_path / "none"))
    assert arrays.scan_npy(spark, str(tmp_path / "none")).count() == 0
