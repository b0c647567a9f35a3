
import pytest

from tabprism.operators import features as FE
from tabprism.sources.csv import NA_TOKENS, read_csv, write_csv
from tabprism.sources.materialize import load_or_build
from tabprism.sources.scratch import scratch_path


def test_minmax_constant_and_all_null(spark):
    df = spark.createDataFrame([(1, 5.0, None, 0.0), (2, 5.0, None, 10.0), (3, None, None, 5.0)],
                               "id long, c double, n double, x double")
    out = {r["id"]: r for r in FE.minmax_scale(df, ["c", "n", "x"]).collect()}
    assert [out[i]["c"] for i in (1, 2, 3)] == [0.0, 0.0, 0.0]      # missing row too
    assert all(out[i]["n"] is None for i in (1, 2, 3))
    assert [out[i]["x"] for i in (1, 2, 3)] == [0.0, 1.0, 0.5]
    vals = [r["x"] for r in FE.minmax_scale(spark.range(50).selectExpr("id * 1.7 AS x"), ["x"]).collect()]
    assert min(vals) == 0.0 and max(vals) == 1.0


def test_standard_and_robust_edge_cases(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert FE.standard_scale(one, ["x"]).first()["x"] is None           # n−1 std of one value
    const = spark.createDataFrame([(2.0,)] * 5 + [(9.0,)], "x double")   # q1 = q3 = 2
    assert [r["x"] for r in FE.robust_scale(const, ["x"]).collect()] == [0.0] * 6
    st = FE.standard_scale(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double"), ["x"])
    assert [r["x"] for r in st.collect()] == [-1.0, 0.0, 1.0]


def test_params_tables(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    mm = FE.minmax_params(df, ["x"]).first()
    assert (mm["min"], mm["max"], mm["range"], mm["scaled_mean"]) == (0.0, 10.0, 10.0, 0.5)
    rb = FE.robust_params(df, ["x"]).first()
    assert (rb["median"], rb["q1"], rb["q3"], rb["iqr"], rb["outliers"]) == (5.0, 2.5, 7.5, 5.0, 0)


def test_ordinal_unmapped_and_absent(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "lv string")
    m = {"lv": {"a": 1, "b": 2}, "missing": {"q": 1}}
    assert [r[0] for r in FE.ordinal_encode(df, m).collect()] == [1, 2, None, None]
    meta = {r["level"]: (r["code"], r["n_rows"], r["mapping"]) for r in FE.ordinal_meta(df, m).collect()}
    assert meta["z"][0] is None and meta["a"] == (1, 1, "a → 1 | b → 2")


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "b", True), (2, "a", False), (3, None, True), (4, "c", None)],
                               "id long, cat string, flag boolean")
    out = FE.one_hot(df, ["cat"])
    assert out.columns == ["id", "flag", "cat_b", "cat_c"]
    got = {r["id"]: (r["cat_b"], r["cat_c"]) for r in out.collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (0, 0), 4: (0, 1)}
    assert dict(out.dtypes)["flag"] == "int"                      # C7: booleans become 0/1
    assert sum(sum(v) for v in got.values()) <= 4
    with pytest.raises(ValueError):
        FE.one_hot(spark.range(50).selectExpr("CAST(id AS STRING) AS s"), ["s"], max_levels=10)
    meta = FE.nominal_meta(df, ["cat", "nope"]).first()
    assert (meta["column_name"], meta["unique_count"], meta["new_columns"]) == ("cat", 3, "cat_...")


def test_csv_roundtrip_na_tokens(spark, tmp_path):
    src = tmp_path / "in.csv"
    lines = ["a,b,c,d"] + [f"{i},{tok},x{i},{bo}" for i, (tok, bo) in
                           enumerate(zip(["1.5", "NA", "n/a", "", "2"], ["True", "false", "", "TRUE", "False"]))]
    src.write_text("\n".join(lines) + "\n")
    df = read_csv(spark, str(src))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean"}
    assert [r["d"] for r in df.orderBy("a").collect()] == [True, False, None, True, False]
    assert [r["b"] for r in df.orderBy("a").collect()] == [1.5, None, None, None, 2.0]
    assert "NA" in NA_TOKENS and "" in NA_TOKENS
    out = write_csv(df, scratch_path(spark, "t"))
    assert read_csv(spark, out, schema=df.schema).count() == 5
    assert read_csv(spark, str(tmp_path / "absent.csv"), missing_ok=True) is None
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "absent.csv"))


def test_load_or_build_reuses(spark):
    path = scratch_path(spark, "mat")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    assert load_or_build(spark, path, build).count() == 3
    assert load_or_build(spark, path, build).count() == 3
    assert len(calls) == 1


def test_csv_keeps_timestamp_microseconds(spark):
    df = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-01 00:00:07.179575' AS ntz, "
                   "TIMESTAMP '2024-01-01 00:00:07.000001' AS ltz")
    back = read_csv(spark, write_csv(df, scratch_path(spark, "ts")), schema=df.schema).first()
    assert back["ntz"].microsecond == 179575 and back["ltz"].microsecond == 1


def test_nominal_meta_counts_levels_without_copies_of_rows(spark):
    from tabprism.operators import features as FT
    df = spark.createDataFrame([("a", 0.0, None, 1), ("b", -0.0, None, 1), (None, 2.5, None, 2)], "x string, y double, z string, w int")
    for approx in (False, True):
        got = {r["column_name"]: (r["column_idx"], r["unique_count"]) for r in FT.nominal_meta(df, ["x", "y", "z", "gone", "w"], approx=approx).collect()}
        assert got == {"x": (0, 2), "y": (1, 2), "z": (2, 0), "w": (3, 2)}
    plan = FT.nominal_meta(df, ["x", "y", "w"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
