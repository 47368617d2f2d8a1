"""Sources and sinks.

Readers take an explicit schema (no inference pass over the data); writers
never funnel data into one task (no ``coalesce(1)``): a table is a folder of
part files, as distributed writers produce.
"""

from __future__ import annotations

import datetime as _dt
import importlib
import json

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLReadable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.exprs import to_number
from cohortlens.schema import ROSTER_SCHEMA
from cohortlens.session import written

FORMATS = ("csv", "parquet", "json")


def read_delimited(spark: SparkSession, path: str, sep: str = ",",
                   schema: T.StructType | None = ROSTER_SCHEMA, header: bool = True) -> DataFrame:
    """Delimited text with a header row, ``,`` or ``;``; bad numbers become
    null instead of failing the read.

    Columns are matched by their header name, in any order; a column of the
    schema that the file lacks is null, and columns that only the file has stay
    (as text, at the end). Without a header the schema's order is the file's."""
    r = spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
    if schema is None:
        return r.option("inferSchema", True).csv(path)
    if not header:
        return r.schema(schema).csv(path)
    raw = r.csv(path)
    named = {c.strip().lower(): c for c in raw.columns}

    def typed(f: T.StructField):
        c = named.pop(f.name.lower(), None)
        if c is None:
            out = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, T.StringType):
            out = F.col(f"`{c}`")
        elif isinstance(f.dataType, T.NumericType):
            out = to_number(F.col(f"`{c}`")).try_cast(f.dataType)
        else:
            out = F.col(f"`{c}`").try_cast(f.dataType)
        return out.alias(f.name, metadata=f.metadata)

    known = [typed(f) for f in schema.fields]
    return raw.select(*known, *[F.col(f"`{c}`") for c in raw.columns if c in named.values()])


def with_row_ids(df: DataFrame, id_col: str = "student_id") -> DataFrame:
    """An id for rows that have none, the same however the file is split, ordered or read again.

    It is a 63-bit hash of the row's values; rows that repeat each other are
    counted first (in every map task) and their repetitions numbered, so many
    equal rows do not meet in one task."""
    cols = [c for c in df.columns if c != id_col]
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
    again = counted.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    key = F.xxhash64(*[F.struct(F.col(f"`{c}`")) for c in cols], F.col("__k")).bitwiseAND(F.lit((1 << 63) - 1))
    return again.select(key.alias(id_col), *[F.col(f"`{c}`") for c in cols])


def read_roster(spark: SparkSession, path: str, sep: str = ",", id_col: str = "student_id") -> DataFrame:
    """S1 as the flows read it: a roster file with header, its columns in any order; ids are given where it has none."""
    df = read_delimited(spark, path, sep)
    held = {c.strip().lower() for c in spark.read.option("header", True).option("sep", sep).csv(path).columns}
    return df if id_col in held else with_row_ids(df.drop(id_col), id_col)


def load(spark: SparkSession, path: str, file_type: str = "csv", schema=None, **options) -> DataFrame:
    """Read by declared type from an allow-list; anything else is an error.
    (Spreadsheet files are not read: convert them to csv or parquet first.)"""
    if file_type not in FORMATS:
        raise ValueError(f"Unsupported file type: {file_type}")
    r = spark.read.format(file_type).options(**options)
    if file_type == "csv":
        r = r.option("header", options.get("header", True))
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_related(spark: SparkSession, base: str, names=("customer", "orders", "lineitem", "events")):
    """S3: the student table and its 1:N record tables (joined by J5)."""
    return {n: spark.read.parquet(f"{base.rstrip('/')}/{n}.parquet") for n in names}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Table with a header row (one part file per task)."""
    df.write.mode(mode).option("header", True).csv(path)


def save_model(model, path: str, metrics: DataFrame | None = None,
               importance: DataFrame | None = None, info: dict | None = None) -> None:
    """Fitted model + metrics / importance tables + metadata beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    meta = {"saved_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
            "model_class": type(model).__name__, "model_module": type(model).__module__, **(info or {})}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string") \
        .write.mode("overwrite").text(f"{path}/meta")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    if importance is not None:
        importance.write.mode("overwrite").parquet(f"{path}/importance")


def load_model(path: str, cls: type[MLReadable] | None = None):
    """Load what ``save_model`` wrote (``PipelineModel`` unless a class is given)."""
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if cls is None:
        import pyspark.ml.classification as C
        import pyspark.ml.pipeline as P
        if meta.get("model_module", "").startswith("cohortlens."):  # a model of this library
            cls = getattr(importlib.import_module(meta["model_module"]), meta["model_class"])
            return cls.load(f"{path}/model"), meta
        cls = getattr(C, meta["model_class"], None) or getattr(P, meta["model_class"], PipelineModel)
    return cls.load(f"{path}/model"), meta


def append_run_metadata(spark: SparkSession, path: str, model_type: str, config: dict,
                        data_info: dict, accuracy: float | None) -> None:
    """One row per training run appended to a JSON table."""
    row = (model_type, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None), json.dumps(config, default=str),
           json.dumps(data_info, default=str), accuracy)
    spark.createDataFrame([row], "model_type string, trained_at timestamp, config string, "
                                 "data_info string, accuracy double") \
        .write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """The long metric table (model, split, metric, value, training_time)."""
    report.write.mode("overwrite").parquet(path)


def write_explanations(expl: DataFrame, path: str) -> None:
    """Nested explanation records (factor arrays of structs) as JSON lines."""
    expl.write.mode("overwrite").json(path)


def append_predictions(pred: DataFrame, path: str, model_name: str, roster: DataFrame | None = None,
                       explanations: DataFrame | None = None) -> DataFrame:
    """Risk predictions with date, model, score, level, confidence, appended
    and partitioned by model name. Returns what was written.

    ``roster`` (by student_id) gives each record its risk factors (R1);
    ``explanations`` (by id: positive_factors, negative_factors, recommendations)
    its explanation as JSON and its intervention recommendations. Students
    without them keep empty lists."""
    from cohortlens.operators.risk import factor_array

    out = pred.select(
        F.col("id").cast("long").alias("student_id"),
        F.current_timestamp().alias("prediction_date"),
        F.lit(model_name).alias("model_name"),
        F.col("probability")[0].alias("risk_score"),
        F.col("y_pred").alias("risk_level"),
        F.array_max("probability").alias("confidence_score"))
    if roster is not None:
        out = out.join(roster.select(F.col("student_id").cast("long").alias("student_id"),
                                     factor_array(roster).alias("factors")), "student_id", "left")
    if explanations is not None:
        told = explanations.select(
            F.col("id").cast("long").alias("student_id"),
            F.to_json(F.struct("positive_factors", "negative_factors")).alias("explanation"),
            F.col("recommendations").alias("intervention_recommendations"))
        out = out.join(told, "student_id", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(F.col(c), none) for c in ("factors", "intervention_recommendations") if c in out.columns}
    out = out.withColumns(lists) if lists else out
    out.write.mode("append").partitionBy("model_name").parquet(path)
    return out


def batch_score(spark: SparkSession, data: DataFrame, model_paths: dict, classes) -> DataFrame:
    """Score the whole table with each saved model. A missing or failing
    model, one that fails at run time too, becomes one error row, not a failure
    of the run: each is scored to storage before the next."""
    schema = "model string, id long, y_true string, y_pred string, error string"
    parts = []
    cls = F.array(*[F.lit(c) for c in classes])
    for name, path in model_paths.items():
        try:
            model, _ = load_model(path)
            scored = model.transform(data).select(
                F.lit(name).alias("model"), F.col("id").cast("long").alias("id"),
                F.col("class_name").alias("y_true"),
                F.coalesce(F.element_at(cls, F.col("prediction").cast("int") + 1), F.lit("Unknown")).alias("y_pred"),
                F.lit(None).cast("string").alias("error"))
            parts.append(written(scored, "scored"))
        except Exception as ex:  # noqa: BLE001 - reported as a row
            msg = f"{type(ex).__name__}: {str(ex).splitlines()[0] if str(ex) else ''}"[:300]
            parts.append(spark.createDataFrame([(name, None, None, None, msg)], schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
