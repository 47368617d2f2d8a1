"""The fitted preparation of a roster (E10, E11) as a Spark ML estimator and model.

``RosterPreparation`` fits every statistic of the preparation: both cleaning
passes, the outlier limits, the label codes, the scaling and the class edges, on
all rows or (E10) on the rows of the training split alone.  The fitted model is
applied to any roster as one projection, can be a stage of a pipeline and is
saved with it: the statistics as JSON, the label codes as a table.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.exprs import sql_name
from cohortlens.operators import clean as cl
from cohortlens.operators.bands import BandState, fit_quantile_band, fitted_band
from cohortlens.operators.encode import ScaleState, apply_label_codes, apply_scaling, fit_label_codes, fit_scaling
from cohortlens.operators.features import row_features
from cohortlens.schema import numeric_columns, require_column, string_columns
from cohortlens.session import spread

TRAIN = "train"


class _PreparationParams(Params):
    target = Param(Params._dummy(), "target", "grade column", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "row id column", TypeConverters.toString)
    excludeCols = Param(Params._dummy(), "excludeCols", "columns left out", TypeConverters.toListString)
    removeOutliers = Param(Params._dummy(), "removeOutliers", "leave out rows past the z-score limit",
                           TypeConverters.toBoolean)
    fitOn = Param(Params._dummy(), "fitOn", "rows the statistics come from: all or train", TypeConverters.toString)
    splitCol = Param(Params._dummy(), "splitCol", "column that names a row's split", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(target="G3", idCol="student_id", excludeCols=["G1", "G2"], removeOutliers=True, fitOn="all",
                         splitCol="split")

    def _keep(self) -> tuple[str, str]:
        return self.getOrDefault(self.idCol), self.getOrDefault(self.splitCol)


class RosterPreparation(Estimator, _PreparationParams, DefaultParamsReadable, DefaultParamsWritable):
    """E11 fit; with ``fitOn='train'`` (E10) only rows whose split is 'train' are looked at."""

    def __init__(self, target="G3", id_col="student_id", exclude_cols=("G1", "G2"), remove_outliers=True, fit_on="all",
                 split_col="split"):
        super().__init__()
        if fit_on not in ("all", TRAIN):
            raise ValueError(f"Unknown fit_on: {fit_on}")
        self._set(target=target, idCol=id_col, excludeCols=list(exclude_cols), removeOutliers=remove_outliers,
                  fitOn=fit_on, splitCol=split_col)

    def _fit(self, df: DataFrame) -> RosterPreparationModel:
        target, exclude = self.getOrDefault(self.target), self._keep()
        if self.getOrDefault(self.fitOn) == TRAIN:
            require_column(df, exclude[1])
            df = df.filter(F.col(exclude[1]) == TRAIN)
        df = df.drop(*self.getOrDefault(self.excludeCols))
        require_column(df, target)
        raw = cl.fit_clean(df, exclude=exclude)
        derived = row_features(cl.apply_clean(df, raw)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            full = cl.fit_clean(derived, exclude=exclude)
            kept = cl.apply_clean(derived, full, new_rows=False)
            numeric = numeric_columns(kept, exclude)
            outliers = cl.OutlierState({}, {})
            if self.getOrDefault(self.removeOutliers):
                outliers = cl.fit_outliers(kept, numeric)
                kept = kept.filter(cl.outlier_keep_condition(outliers))
            strings = string_columns(kept, exclude)
            mapping = fit_label_codes(kept, strings)
            features = [c for c in kept.columns if c in {*numeric, *strings} - {target}]
            scale = fit_scaling(apply_label_codes(kept, mapping, strings), features)
            edges = fit_quantile_band(kept, target)
        finally:
            derived.unpersist()
        state = {"raw": asdict(raw), "full": asdict(full), "outliers": asdict(outliers), "scale": asdict(scale),
                 "edges": asdict(edges), "strings": strings, "features": features}
        return self._copyValues(RosterPreparationModel(state, mapping))


class RosterPreparationModel(Model, _PreparationParams, MLReadable, MLWritable):
    """Fitted E11.

    ``transform`` prepares every row of any roster (new rows too): id, split if
    there is one, all features as doubles, and ``label`` (the cleaned grade) if
    the roster has grades.  ``prepare`` leaves out the outliers among the rows
    that were fitted on, as training does."""

    def __init__(self, state: dict | None = None, mapping: DataFrame | None = None):
        super().__init__()
        self.state, self.mapping = state or {}, mapping

    @property
    def features(self) -> list[str]:
        return list(self.state["features"])

    @property
    def edges(self) -> BandState:
        return BandState(**self.state["edges"])

    def class_name(self, c: str = "label") -> Column:
        """The risk class of a cleaned grade by the fitted edges."""
        return fitted_band(c, self.edges)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._prepared(df, False)

    def prepare(self, df: DataFrame) -> DataFrame:
        return self._prepared(df, True)

    def _prepared(self, df: DataFrame, drop_outliers: bool) -> DataFrame:
        st, (id_col, split_col) = self.state, self._keep()
        target = self.getOrDefault(self.target)
        x = df.drop(*self.getOrDefault(self.excludeCols))
        x = row_features(cl.apply_clean(x, cl.CleanState(**st["raw"])))
        # features of cleaned columns miss nothing that they did not miss when fitted
        x = cl.apply_clean(x, cl.CleanState(**st["full"]), new_rows=False)
        if drop_outliers and self.getOrDefault(self.removeOutliers):
            normal = cl.outlier_flag(cl.OutlierState(**st["outliers"]))
            if self.getOrDefault(self.fitOn) == TRAIN:  # other rows are there to be scored
                normal = normal | ~F.col(split_col).eqNullSafe(F.lit(TRAIN))
            # the random term is never true: it keeps the optimizer from writing the whole preparation into the filter
            x = x.withColumn("__normal", normal | (F.rand(0) < 0)).filter("__normal").drop("__normal")
        x = apply_label_codes(x, self.mapping, st["strings"])
        grade = [F.col(target).cast("double").alias("label")] if target in x.columns else []
        keep = [c for c in (id_col, split_col) if c in x.columns]
        x = x.select(*keep, *[F.expr(f"CAST({sql_name(c)} AS DOUBLE) AS {sql_name(c)}") for c in st["features"]], *grade)
        return apply_scaling(x, ScaleState(**st["scale"]), exclude=(*keep, "label"))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RosterPreparationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        spark.createDataFrame([(json.dumps(self.model.state),)], "state string").write.text(f"{path}/state")
        self.model.mapping.write.parquet(f"{path}/codes")


class _Reader(MLReader):
    def load(self, path: str) -> RosterPreparationModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        state = json.loads(spark.read.text(f"{path}/state").first()[0])
        model = RosterPreparationModel(state, spark.read.parquet(f"{path}/codes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def preprocess(df: DataFrame, target: str = "G3", exclude_cols=("G1", "G2"), remove_outliers: bool = True,
               id_col: str = "student_id") -> DataFrame:
    """Drop, target check, clean / features / clean, outlier filter, split target, label codes, scaling,
    numeric select, final safety: ``id_col``, every feature (double) and ``label`` (the cleaned target)."""
    df = spread(df, "roster")
    return RosterPreparation(target, id_col, exclude_cols, remove_outliers).fit(df).prepare(df)
