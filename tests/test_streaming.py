import os

import pytest

from tabprism.operators import features as FE
from tabprism.operators import models as M
from tabprism.operators import scoring as SC
from tabprism.sources.scratch import scratch_path
from tabprism.streaming import score_stream, stream_source, write_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_stream_scoring_equals_batch(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    prep = M.prepare(part, ["p_partkey"], "p_retailprice", "p_partkey")
    p = M.fit_slr_gd(prep.train, "p_partkey", "p_retailprice").params
    scaler = FE.fit_minmax(part, ["p_size"])
    src = scratch_path(spark, "stream-in")
    part.repartition(3).write.parquet(src)
    stream = stream_source(spark, src, part.schema, max_files_per_trigger=1)
    scored = score_stream(stream, lambda d: FE.transform(d, scaler),
                          lambda d: SC.score_linear(d, p, "prediction"))
    assert scored.isStreaming
    out = scratch_path(spark, "stream-out")
    q = write_stream(scored, out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.read.parquet(out)
    batch = SC.score_linear(FE.transform(part, scaler), p, "prediction")
    assert got.count() == part.count()
    assert got.select("p_partkey", "p_size", "prediction").exceptAll(
        batch.select("p_partkey", "p_size", "prediction")).count() == 0


def test_refit_reaches_a_running_stream(spark):
    """The version published between two batches scores the second one."""
    from tabprism.sources import params as PR
    from tabprism.streaming import write_versioned_stream
    src, table, out = (scratch_path(spark, n) for n in ("versions-in", "versions-params", "versions-out"))
    rows = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double")

    def line(slope):
        return M.LinearParams(["x"], [0.0], [1.0], [slope], 1.0)

    assert PR.latest_version(spark, table) is None
    with pytest.raises(ValueError):
        PR.load_version(spark, table)
    assert PR.publish_fitted(spark, line(2.0), table) == 1
    rows.where("id < 5").coalesce(1).write.mode("append").parquet(src)
    q = write_versioned_stream(stream_source(spark, src, rows.schema), table, lambda d, p: SC.score_linear(d, p, "y", digits=None), out)
    try:
        q.processAllAvailable()
        assert PR.publish_fitted(spark, line(-3.0), table) == 2
        rows.where("id >= 5").coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["id"]: (r["y"], r["params_version"]) for r in spark.read.parquet(out).collect()}
    assert got == {i: (1 + 2.0 * i, 1) if i < 5 else (1 - 3.0 * i, 2) for i in range(10)}
    assert PR.load_version(spark, table, 1)[0] == line(2.0) and PR.load_version(spark, table) == (line(-3.0), 2)


def test_saved_scaler_keeps_its_statistics(spark):
    from tabprism.sources.params import load_fitted, save_fitted
    df = spark.createDataFrame([(1.0, None), (3.0, None), (8.0, None)], "a double, b double")
    for fit in (FE.fit_minmax, FE.fit_standard, FE.fit_robust):
        p = fit(df, ["a", "b"])
        assert load_fitted(spark, save_fitted(spark, p, scratch_path(spark, "scaler"))) == p
