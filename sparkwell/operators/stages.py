"""Rankers and encoders as stages of Spark ML pipelines: estimators, models, writers and readers.

A saved stage is Spark's own metadata (class, uid, parameters) and one row of JSON text with what was learned, written by
Spark, so that a pipeline of these and of Spark's stages is saved and loaded as a whole on any file system.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embeddings import Dense, encode
from .lambdarank import HIDDEN, Network, Trainer
from .linear import GRID, LinearRanker, fit_logistic, fit_svm
from .ranking import FEATURES


class _Writer(MLWriter):
    def __init__(self, stage: _Learned) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        rows = self.sparkSession.createDataFrame([(json.dumps(self.stage._state()),)], "value string")
        rows.coalesce(1).write.text(f"{path}/state")


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._restore(json.loads(self.sparkSession.read.text(f"{path}/state").first()["value"]))
        return stage


class _Learned(MLWritable, MLReadable):
    """A stage with something learned, given as and taken from JSON values."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def _state(self) -> dict:
        raise NotImplementedError

    def _restore(self, state: dict) -> None:
        raise NotImplementedError


def _layers(layers: list[tuple[np.ndarray, np.ndarray]]) -> list:
    return [[w.tolist(), b.tolist()] for w, b in layers]


def _arrays(layers: list) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.array(w), np.array(b)) for w, b in layers]


# ------------------------------------------------------------------ linear rankers


class _LinearParams(HasLabelCol, HasPredictionCol):
    featureNames = Param(Params._dummy(), "featureNames", "columns of the features", TypeConverters.toListString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="score", featureNames=list(FEATURES))


class LinearRankerStage(Estimator, _LinearParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a logistic or squared-hinge ranker, the strength chosen by cross-validation."""

    loss = Param(Params._dummy(), "loss", "logistic or squared_hinge", TypeConverters.toString)
    grid = Param(Params._dummy(), "grid", "inverse strengths", TypeConverters.toListFloat)
    folds = Param(Params._dummy(), "folds", "held-out parts", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, labelCol: str = "label", predictionCol: str = "score", featureNames: list[str] | None = None, loss: str = "logistic", grid: list[float] | None = None, folds: int = 5) -> None:
        super().__init__()
        self._setDefault(loss="logistic", grid=list(GRID), folds=5)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LinearRankerModel:
        get = self.getOrDefault
        fit = {"logistic": fit_logistic, "squared_hinge": fit_svm}[get(self.loss)]
        model = LinearRankerModel(fit(dataset, tuple(get(self.featureNames)), tuple(get(self.grid)), get(self.folds), self.getLabelCol()))
        return self._copyValues(model)


class LinearRankerModel(Model, _LinearParams, _Learned):
    """Adds the score of a linear ranker."""

    def __init__(self, ranker: LinearRanker | None = None) -> None:
        super().__init__()
        self.ranker = ranker

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), self.ranker.score())

    def _state(self) -> dict:
        r = self.ranker
        return {"features": list(r.features), "mean": r.mean.tolist(), "scale": r.scale.tolist(), "weight": r.weight.tolist(), "bias": r.bias, "logistic": r.logistic, "c": r.c, "auc": r.auc}

    def _restore(self, state: dict) -> None:
        arrays = {n: np.array(state.pop(n)) for n in ("mean", "scale", "weight")}
        self.ranker = LinearRanker(features=tuple(state.pop("features")), **arrays, **state)


# ------------------------------------------------------------------ LambdaRank


class _RankParams(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    def __init__(self) -> None:
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="relevance_score", predictionCol="score")


class LambdaRankStage(Estimator, _RankParams, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Trains a LambdaRank network on (query_id, doc_id, label, features)."""

    hidden = Param(Params._dummy(), "hidden", "widths of the hidden layers", TypeConverters.toListInt)
    epochs = Param(Params._dummy(), "epochs", "passes over all queries", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "first learning rate", TypeConverters.toFloat)
    dropout = Param(Params._dummy(), "dropout", "share of hidden values dropped in training", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "relevance_score", predictionCol: str = "score", hidden: list[int] | None = None, epochs: int = 20, rate: float = 1e-3, dropout: float = 0.1, seed: int = 0) -> None:
        super().__init__()
        self._setDefault(hidden=list(HIDDEN), epochs=20, rate=1e-3, dropout=0.1, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LambdaRankModel:
        get = self.getOrDefault
        groups = dataset.withColumn("features", F.col(self.getFeaturesCol()))
        first = groups.where("features is not null").select(F.size("features").alias("n")).first()
        t = Trainer(Network.random(first["n"] if first else 0, tuple(get(self.hidden)), self.getSeed()), get(self.rate), dropout=get(self.dropout), seed=self.getSeed())
        t.train(groups, epochs=get(self.epochs), label=self.getLabelCol())
        return self._copyValues(LambdaRankModel(t.network))


class LambdaRankModel(Model, _RankParams, _Learned):
    """Adds the network's score."""

    def __init__(self, network: Network | None = None) -> None:
        super().__init__()
        self.network = network

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return Trainer(self.network).predict(dataset, self.getFeaturesCol(), self.getPredictionCol())

    def _state(self) -> dict:
        return {"layers": _layers(list(zip(self.network.weights, self.network.biases)))}

    def _restore(self, state: dict) -> None:
        layers = _arrays(state["layers"])
        self.network = Network([w for w, _ in layers], [b for _, b in layers])


# ------------------------------------------------------------------ encoders


class EncoderStage(Transformer, HasInputCol, HasOutputCol, _Learned):
    """Adds a network's unit vector of an array column."""

    def __init__(self, model: Dense | None = None, inputCol: str = "x", outputCol: str = "vec") -> None:
        super().__init__()
        self._setDefault(inputCol="x", outputCol="vec")
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.model = model

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode(dataset, self.getInputCol(), self.model, self.getOutputCol())

    def _state(self) -> dict:
        return {"layers": _layers(self.model.layers), "normalize": self.model.normalize, "frozen": self.model.frozen}

    def _restore(self, state: dict) -> None:
        self.model = Dense(_arrays(state["layers"]), state["normalize"], state["frozen"])
