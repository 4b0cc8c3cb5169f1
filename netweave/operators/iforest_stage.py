"""The isolation forest as a Spark ML stage.

``IsolationForest`` fits what ``operators.iforest.isolation_forest`` computes in one go:
the scaling of the features, the trees, and the score from which a row is anomalous.
``IsolationForestModel`` scores any rows with them, so rows that come later are judged by
the same forest; on the rows it was fitted on, its scores and labels are those of the
operator. Both have params, take part in a ``Pipeline`` and can be saved and loaded:
the metadata as other stages keep it, the trees as one small Parquet table beside it.

Null and NaN features count as 0; a feature with one value tells nothing. The fit raises on an
empty table. All columns of the rows pass; the two output columns replace columns of the
same name. Rows that share a key are sampled and scored as rows of their own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasPredictionCol, HasSeed
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions.quantile import exact_quantiles
from netweave.operators.iforest import NODE_SCHEMA, fit_forest, forest_score


class _ForestParams(HasInputCols, HasPredictionCol, HasSeed):
    keyCol = Param(Params._dummy(), "keyCol", "column that names a row", TypeConverters.toString)
    scoreCol = Param(Params._dummy(), "scoreCol", "column of the anomaly score", TypeConverters.toString)
    contamination = Param(Params._dummy(), "contamination", "share of rows called anomalous", TypeConverters.toFloat)
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    sampleSize = Param(Params._dummy(), "sampleSize", "rows a tree grows from", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(keyCol="flow_id", scoreCol="anomaly_score", predictionCol="anomaly", seed=42,
                         contamination=K.IFOREST_CONTAMINATION, numTrees=K.IFOREST_TREES, sampleSize=K.IFOREST_SAMPLE)


def _plain(column: str):
    value = F.col(f"`{column}`").cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


class IsolationForest(Estimator, _ForestParams, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator: ``inputCols`` (features) and ``keyCol`` of a table to a model."""

    @keyword_only
    def __init__(self, *, inputCols=None, keyCol="flow_id", scoreCol="anomaly_score", predictionCol="anomaly", seed=42,
                 contamination=K.IFOREST_CONTAMINATION, numTrees=K.IFOREST_TREES, sampleSize=K.IFOREST_SAMPLE):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        cols, key = self.getInputCols(), self.getOrDefault("keyCol")
        names = [f"feature_{i}" for i in range(len(cols))]
        rows = dataset.select(F.col(f"`{key}`").alias("key"), *[_plain(c).alias(n) for c, n in zip(cols, names)])
        if rows.isEmpty():
            raise ValueError("no rows to fit a forest on")
        raw = VectorAssembler(inputCols=names, outputCol="raw").transform(rows)
        scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(raw)
        array = vector_to_array("scaled")
        data = scaler.transform(raw).select("key", *[array[i].alias(n) for i, n in enumerate(names)])
        nodes, psi = fit_forest(data, "key", names, self.getOrDefault("numTrees"), self.getOrDefault("sampleSize"), self.getSeed())
        model = self._copyValues(IsolationForestModel(nodes, psi, scaler.mean.toArray(), scaler.std.toArray(), 0.0))
        scored = model._score(dataset).select((-F.col(self.getOrDefault("scoreCol"))).alias("neg"))
        model.threshold = -exact_quantiles(scored, ["neg"], self.getOrDefault("contamination"))["neg"]
        return model


class IsolationForestModel(Model, _ForestParams, MLReadable, MLWritable):
    """Scores rows, and calls those above ``threshold`` anomalous (-1, others 1)."""

    def __init__(self, nodes: pd.DataFrame, psi: int, mean: np.ndarray, std: np.ndarray, threshold: float):
        super().__init__()
        self.nodes, self.psi, self.mean, self.std, self.threshold = nodes, psi, np.asarray(mean), np.asarray(std), threshold

    def _score(self, dataset: DataFrame) -> DataFrame:
        nodes, psi, mean = self.nodes, self.psi, self.mean
        scale = np.divide(1.0, self.std, out=np.zeros_like(self.std), where=self.std != 0)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            walk = forest_score(nodes, psi)
            for pdf in batches:
                yield pd.Series(walk((pdf.to_numpy(dtype=float) - mean) * scale))

        features = F.struct(*[_plain(c).alias(f"feature_{i}") for i, c in enumerate(self.getInputCols())])
        return dataset.withColumn(self.getOrDefault("scoreCol"), score(features))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        high = F.col(f"`{self.getOrDefault('scoreCol')}`") > F.lit(float(self.threshold))
        return self._score(dataset).withColumn(self.getPredictionCol(), F.when(high, -1).otherwise(1))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        more = {"psi": m.psi, "threshold": float(m.threshold), "mean": m.mean.tolist(), "std": m.std.tolist()}
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"forest": more})
        self.sparkSession.createDataFrame(m.nodes, NODE_SCHEMA).coalesce(1).write.parquet(os.path.join(path, "nodes"))


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> IsolationForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession, f"{self.cls.__module__}.{self.cls.__name__}")
        more = metadata["forest"]
        nodes = self.sparkSession.read.schema(NODE_SCHEMA).parquet(os.path.join(path, "nodes")).toPandas()
        model = self.cls(nodes, more["psi"], np.array(more["mean"]), np.array(more["std"]), more["threshold"])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
