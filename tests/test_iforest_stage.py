"""The forest as an ML stage: the operator's scores, later rows, pipelines, persistence."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from netweave.operators import iforest as I
from netweave.operators.iforest_stage import IsolationForest, IsolationForestModel

COLS = ["a", "b", "c"]


def table(spark, n=600):
    i = F.col("id")
    return spark.range(n).select(
        i.cast("string").alias("flow_id"), (i % 17).cast("double").alias("a"),
        F.when(i % 100 == 7, 1000.0).when(i % 100 == 8, float("nan")).otherwise((i % 5).cast("double")).alias("b"),
        F.lit(3.0).alias("c"), F.lit("kept").alias("other"))


def test_equals_the_operator_and_survives_saving(spark, tmp_path):
    rows = table(spark)
    stage = IsolationForest(inputCols=COLS, contamination=0.02, numTrees=20, sampleSize=64)
    model = stage.fit(rows)
    got = {r.flow_id: (r.anomaly_score, r.anomaly) for r in model.transform(rows).collect()}
    want = {r.flow_id: (r.anomaly_score, r.anomaly)
            for r in I.isolation_forest(rows, "flow_id", COLS, contamination=0.02, trees=20, sample=64).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0], abs=1e-12) for k in got)
    assert [k for k in got if got[k][1] != want[k][1]] == []
    scores = sorted(v[0] for v in got.values())
    assert all(got[str(i)][0] > scores[len(scores) // 2] for i in range(7, 600, 100))  # planted rows stand out
    model.write().overwrite().save(str(tmp_path / "model"))
    again = IsolationForestModel.load(str(tmp_path / "model"))
    assert again.uid == model.uid and again.extractParamMap() == model.extractParamMap()
    assert {r.flow_id: (r.anomaly_score, r.anomaly) for r in again.transform(rows).collect()} == got
    stage.save(str(tmp_path / "stage"))
    assert IsolationForest.load(str(tmp_path / "stage")).getOrDefault("sampleSize") == 64


def test_in_a_pipeline_on_later_rows(spark, tmp_path):
    rows = table(spark)
    double = SQLTransformer(statement="SELECT *, a * 2 AS twice FROM __THIS__")
    fitted = Pipeline(stages=[double, IsolationForest(inputCols=["twice", "b"], contamination=0.02, numTrees=20, scoreCol="s")]).fit(rows)
    fitted.save(str(tmp_path / "pipe"))
    later = spark.createDataFrame([("x", 1.0, 5000.0, "o"), ("y", 3.0, 2.0, "o"), (None, None, None, None)],
                                  "flow_id string, a double, b double, other string")
    out = {r.flow_id: r for r in PipelineModel.load(str(tmp_path / "pipe")).transform(later).collect()}
    assert (out["x"].anomaly, out["y"].anomaly) == (-1, 1) and out["x"].s > out["y"].s and out[None].s is not None
    with pytest.raises(ValueError, match="no rows"):
        IsolationForest(inputCols=COLS).fit(rows.limit(0))
