"""Rankers and encoders inside saved pipelines."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer

from sparkwell.operators.embeddings import random_dense
from sparkwell.operators.stages import EncoderStage, LambdaRankModel, LambdaRankStage, LinearRankerModel, LinearRankerStage


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for q in range(12):
        for d in range(8):
            x = rng.normal(size=3)
            rows.append((q, d, int(np.clip(round(x[0] + 1), 0, 3)), int(x[0] > 0.3), *map(float, x)))
    return spark.createDataFrame(rows, "query_id int, doc_id int, relevance_score int, label int, a double, b double, c double")


def values(df, column):
    return {(r.query_id, r.doc_id): r[column] for r in df.collect()}


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
def test_linear_ranker_in_a_saved_pipeline(spark, pairs, tmp_path, loss):
    p = Pipeline(stages=[SQLTransformer(statement="SELECT *, a * b AS ab FROM __THIS__"), LinearRankerStage(featureNames=["a", "b", "ab"], loss=loss, grid=[0.1, 1.0], folds=3, predictionCol="s")])
    p.write().overwrite().save(str(tmp_path / "unfitted"))
    fitted = Pipeline.load(str(tmp_path / "unfitted")).fit(pairs)
    fitted.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    assert isinstance(again.stages[1], LinearRankerModel) and again.stages[1].uid == fitted.stages[1].uid
    one, two = (values(m.transform(pairs), "s") for m in (fitted, again))
    assert one == two and len(set(one.values())) > 50
    assert again.stages[1].ranker.c == fitted.stages[1].ranker.c and again.stages[1].ranker.auc > 0.9


def test_lambdarank_and_encoder_in_a_saved_pipeline(spark, pairs, tmp_path):
    encoder = EncoderStage(random_dense(3, 6, 4, seed=2), "x", "features")
    p = Pipeline(stages=[SQLTransformer(statement="SELECT *, array(a, b, c) AS x FROM __THIS__"), encoder, LambdaRankStage(hidden=[8], epochs=3, rate=0.01, dropout=0.0)])
    fitted = p.fit(pairs)
    fitted.write().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    assert isinstance(again.stages[2], LambdaRankModel) and isinstance(again.stages[1], EncoderStage)
    one, two = (values(m.transform(pairs), "score") for m in (fitted, again))
    assert one == two and len(set(one.values())) > 50
    vec = again.transform(pairs).first().features
    assert abs(np.linalg.norm(vec) - 1) < 1e-9


def test_parameters_are_kept(spark, pairs, tmp_path):
    s = LambdaRankStage(hidden=[4, 2], epochs=1, seed=5, labelCol="label")
    s.write().save(str(tmp_path / "stage"))
    t = LambdaRankStage.load(str(tmp_path / "stage"))
    assert (t.getOrDefault(t.hidden), t.getOrDefault(t.epochs), t.getSeed(), t.getLabelCol()) == ([4, 2], 1, 5, "label")
    with pytest.raises(Exception, match="exist"):
        s.write().save(str(tmp_path / "stage"))
