import numpy as np
from pyspark.sql import functions as F

from tabprism.operators import clean as C
from tabprism.operators import sampling as S
from tabprism.operators.positions import row_index


def test_median_impute_nan_null_and_absent(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 3.0)], "id long, x double")
    out = dict(C.median_impute(df, ["x", "absent"]).select("id", "x").collect())
    assert out == {1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0}


def test_median_impute_long_column_becomes_double(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 20)], "id long, k long")
    got = C.median_impute(df, ["k"])
    assert dict(got.dtypes)["k"] == "double"
    assert dict(got.select("id", "k").collect())[2] == 15.0


def test_dedupe_keep_first_hot_key(spark):
    data = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(60)]
    df = spark.createDataFrame(data, "id long, key string")
    out = C.dedupe_keep_first(df, ["key"], ["id"])
    assert out.columns == ["id", "key"]
    got = dict((k, i) for i, k in out.collect())
    assert got["hot"] == 0 and len(got) == 1 + 40
    assert C.dedupe_dropped(df, ["key"]).first()["n_dropped"] == 19


def test_coerce_text_in_numeric_column(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), (None,), ("NaN",), (" 7 ",)], "x string")
    assert [r[0] for r in C.coerce_numeric(df, ["x"]).collect()] == [1.5, None, None, None, 7.0]


def test_dropna(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 2.0, float("nan")), (3, 3.0, 3.0)], "id long, a double, b double")
    assert C.dropna_any(df, ["a", "b"]).count() == 1
    assert C.dropna_subset(df, ["a"]).count() == 2


def test_row_index_matches_sort(spark):
    rng = np.random.default_rng(1)
    keys = rng.permutation(500)
    df = spark.createDataFrame([(int(k), int(k % 7)) for k in keys], "k long, g long")
    got = row_index(df, "k", num_partitions=5).select("k", "pos").collect()
    assert sorted((r["pos"], r["k"]) for r in got) == [(i, i) for i in range(500)]
    comp = row_index(df, ["g", "k"], num_partitions=3).collect()
    expect = sorted((int(k % 7), int(k)) for k in keys)
    assert sorted((r["pos"], (r["g"], r["k"])) for r in comp) == list(enumerate(expect))
    assert row_index(df.where("k < 0"), "k").count() == 0


def test_split_sizes_sum_to_n(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    tr, te, n_train = S.train_test_split(df, "k")
    assert n_train == 80 and tr.count() == 80 and te.count() == 21
    assert tr.agg(F.max("k")).first()[0] == 79 and te.agg(F.min("k")).first()[0] == 80


def test_pages(spark):
    assert S.clamp_page("x", 120) == 1 and S.clamp_page(99, 120) == 3 and S.clamp_page(-4, 120) == 1
    assert S.clamp_page(1, 0) == 1
    df = spark.range(120).withColumnRenamed("id", "k")
    last = S.page_slice(df, "k", 3)
    assert sorted(r["k"] for r in last.collect()) == list(range(100, 120))
    idx = S.page_index(df).orderBy("page").collect()
    assert [(r["first_row"], r["last_row"]) for r in idx] == [(1, 50), (51, 100), (101, 120)]
    assert idx[0]["has_prev"] is False and idx[-1]["has_next"] is False


def test_pages_of_a_two_column_key_with_nulls(spark):
    rows = [(None if i < 7 else i // 5, f"t{i:03d}", float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "a int, b string, v double").repartition(6)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for page, size in ((1, 5), (2, 5), (9, 10), (1, 1000), (99, 20)):
        p = S.clamp_page(page, 90, size)
        got = sorted((r["pos"], r["a"], r["b"], r["v"]) for r in S.page_slice(df, ["a", "b"], page, size).collect())
        assert [g[0] for g in got] == list(range((p - 1) * size, min(90, p * size)))
        assert [g[1:] for g in got] == ordered[(p - 1) * size:p * size]
    assert S.page_slice(df.limit(0), ["a", "b"], 3).collect() == []


def test_page_scan_gets_the_bounds(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    plan = S.page_slice(spark.read.parquet(str(tmp_path / "t")), "k", 4)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(k,150)" in plan and "LessThanOrEqual(k,199)" in plan


def keep_first(rows):
    least = {}
    for key, o1, o2, v in rows:
        rank = tuple((o is not None, o or 0) for o in (o1, o2))
        if key not in least or rank < least[key][0]:
            least[key] = (rank, set())
        if rank == least[key][0]:
            least[key][1].add((key, o1, o2, v))
    return least


def test_dedupe_ties_nulls_and_equal_digests(spark):
    rows = [("a", 2, 1.0, "x"), ("a", 1, 5.0, "y"), ("a", 1, 4.0, "z"), ("a", 1, 4.0, "w"), (None, 3, 1.0, "n"), (None, None, 9.0, "m"),
            ("b", 1, 1.0, "p"), ("b", 1, 1.0, "p"), ("c", 7, float("inf"), None), ("c", 7, None, "q")] + [("hot", i, 0.0, "h") for i in range(400)]
    df = spark.createDataFrame(rows, "key string, o1 int, o2 double, v string").repartition(5)
    want = keep_first(rows)
    for how in ({}, {"digest": lambda cols, salt: C.row_digest(cols, salt) if salt == 2 else F.lit(7).cast("bigint")},
                {"digest": lambda cols, salt: F.pmod(C.row_digest(cols, salt), F.lit(2)) if salt == 1 else C.row_digest(cols, salt)}):
        out = C.dedupe_keep_first(df, ["key"], ["o1", "o2"], **how)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(want) == 5 and out.columns == df.columns
        assert all(g in want[g[0]][1] for g in got)
    again = {tuple(r) for r in C.dedupe_keep_first(df.repartition(2), ["key"], ["o1", "o2"]).collect()}
    assert again == {tuple(r) for r in C.dedupe_keep_first(df, ["key"], ["o1", "o2"]).collect()}     # ties fall alike
    plan = C.dedupe_keep_first(df, ["key"], ["o1", "o2"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    text = C.dedupe_keep_first(df, ["key"], ["v"]).collect()        # text order: another plan
    assert {r["key"] for r in text} == {"a", "b", "c", "hot", None}


def test_linspace_positions_match_numpy():
    for n, k in [(1, 200), (7, 200), (1000, 200), (12345, 200), (3000, 30)]:
        assert S.linspace_positions(n, k) == np.linspace(0, n - 1, min(k, n), dtype=int).tolist()


def test_seeded_sample_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = [r["k"] for r in S.seeded_sample(df, "k", 10, 42).collect()]
    b = [r["k"] for r in S.seeded_sample(df.repartition(7), "k", 10, 42).collect()]
    assert a == b and len(set(a)) == 10
    assert S.seeded_sample(df.limit(5), "k", 10).count() == 5


def test_seeded_sample_cut_keeps_the_plain_top_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 8_000, F.lit(7)).otherwise(F.col("id")).alias("k"),
                                    F.col("id").alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    plain = df.orderBy(S.hash_order(["k"], 42), "k", "v").limit(50)
    got = S.seeded_sample(df, "k", 50, 42, ties=["v"])
    assert sorted(r["v"] for r in got.collect()) == sorted(r["v"] for r in plain.collect())
