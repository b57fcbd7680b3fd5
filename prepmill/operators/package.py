"""Saving, loading and reporting of trained models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader, MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ensemble import StackedModel
from .kernel import LandmarkMap, LinearScore
from .metrics import classification_metrics
from .models import (
    Binned,
    FittedModel,
    MarginProbability,
    MeanOfModels,
    Neighbours,
    ProbabilityFromRaw,
    RandomFourier,
    SammeModel,
)
from .preprocess import Preprocessor
from .profile import duplicate_count, overview, percent
from .target import class_imbalance
from .tuning import Calibration

# What triggers a recommendation.
MISSING_ABOVE = 10.0
F1_BELOW = 0.7
R2_BELOW = 0.8


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"].rstrip("\n")


def _save_stage(spark: SparkSession, stage, path: str) -> dict:
    """Write one stage (with its parts) below ``path`` and describe it."""
    def parts(items):
        return [_save_stage(spark, s, f"{path}/{i}") for i, s in enumerate(items)]

    if isinstance(stage, FittedModel):
        return {"type": "fitted", "name": stage.name, "kind": stage.kind, "classes": stage.classes, "parts": parts(stage.stages)}
    if isinstance(stage, MeanOfModels):
        return {"type": "mean", "kind": stage.kind, "weights": stage.weights, "parts": parts(stage.members)}
    if isinstance(stage, SammeModel):
        return {"type": "samme", "alphas": stage.alphas, "classes": stage.classes, "parts": parts(stage.trees)}
    if isinstance(stage, StackedModel):
        return {"type": "stack", "kind": stage.kind, "classes": stage.classes, "parts": parts([*stage.bases, stage.meta])}
    if isinstance(stage, ProbabilityFromRaw):
        return {"type": "softmax", "classes": stage.classes}
    if isinstance(stage, MarginProbability):
        return {"type": "margin", "slope": stage.slope, "intercept": stage.intercept}
    if isinstance(stage, RandomFourier):
        return {"type": "cosines", "weights": stage.weights.tolist(), "shift": stage.shift.tolist(), "out": stage.out}
    if isinstance(stage, Binned):
        return {"type": "bins", "edges": [e.tolist() for e in stage.edges], "out": stage.out}
    if isinstance(stage, LandmarkMap):
        return {"type": "landmarks", "rows": stage.landmarks.tolist(), "gamma": stage.gamma, "out": stage.out}
    if isinstance(stage, LinearScore):
        return {"type": "linear", "weights": stage.weights.tolist(), "intercept": stage.intercept, "vector": stage.vector}
    if isinstance(stage, Neighbours):
        stage.train.write.parquet(f"{path}/rows")
        return {"type": "neighbours", "kind": stage.kind, "classes": stage.classes, "k": stage.k, "path": f"{path}/rows"}
    if isinstance(stage, Calibration):
        return {"type": "calibration", "method": stage.method, "parts": parts(stage.models)}
    if isinstance(stage, MLWritable):
        stage.write().save(f"{path}/spark")
        return {"type": "spark", "path": f"{path}/spark"}
    raise TypeError(f"cannot save {type(stage).__name__}")


def _load_stage(spark: SparkSession, root: str, made_at: str, facts: dict):
    import numpy as np

    def here(path: str) -> str:
        # A package may have been moved since it was written.
        return root + path[len(made_at):]

    parts = [_load_stage(spark, root, made_at, p) for p in facts.get("parts", [])]
    kind = facts["type"]
    if kind == "fitted":
        return FittedModel(facts["name"], facts["kind"], parts, facts["classes"])
    if kind == "mean":
        return MeanOfModels(parts, facts["kind"], facts["weights"])
    if kind == "samme":
        return SammeModel(parts, facts["alphas"], facts["classes"])
    if kind == "stack":
        return StackedModel(parts[:-1], parts[-1], facts["kind"], facts["classes"])
    if kind == "softmax":
        return ProbabilityFromRaw(facts["classes"])
    if kind == "margin":
        return MarginProbability(facts["slope"], facts["intercept"])
    if kind == "cosines":
        made = RandomFourier(1, 1.0, 1, facts["out"])
        made.weights, made.shift = np.array(facts["weights"]), np.array(facts["shift"])
        return made
    if kind == "bins":
        return Binned([np.array(e, float) for e in facts["edges"]], facts["out"])
    if kind == "landmarks":
        return LandmarkMap(np.array(facts["rows"]), facts["gamma"], facts["out"])
    if kind == "linear":
        return LinearScore(np.array(facts["weights"]), facts["intercept"], facts["vector"])
    if kind == "neighbours":
        return Neighbours(spark.read.parquet(here(facts["path"])), facts["kind"], facts["classes"], facts["k"])
    if kind == "calibration":
        return Calibration(parts, facts["method"])
    return DefaultParamsReader.loadParamsInstance(here(facts["path"]), spark)


@dataclass
class ModelPackage:
    """A saved model: preparation, model and the facts stored with it."""

    model: FittedModel
    preprocessor: Preprocessor
    facts: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.preprocessor.model.transform(df))


def save_package(
    spark: SparkSession, path: str, model: FittedModel, preprocessor: Preprocessor, features: list[str], target: str,
    metrics: dict | None = None, shape: tuple[int, int] | None = None, class_distribution: dict | None = None,
) -> str:
    """Write model, preparation and metadata (JSON) below ``path`` in the shared file system."""
    path = path.rstrip("/")
    stage = _save_stage(spark, model, f"{path}/model")
    preprocessor.model.write().save(f"{path}/preprocessor")
    facts = {
        "path": path, "name": model.name, "problem_type": model.kind, "features": features, "target": target,
        "classes": model.classes, "metrics": metrics or {}, "preprocessing": preprocessor.config,
        "slots": preprocessor.names, "trained_at": datetime.now(timezone.utc).isoformat(),
        "shape": list(shape) if shape else None, "class_distribution": class_distribution, "model": stage,
    }
    _write_text(spark, json.dumps(facts), f"{path}/facts")
    return path


def load_package(spark: SparkSession, path: str) -> ModelPackage:
    """Read a saved package back."""
    path = path.rstrip("/")
    facts = json.loads(_read_text(spark, f"{path}/facts"))
    model = _load_stage(spark, path, facts["path"], facts["model"])
    prepared = PipelineModel.load(f"{path}/preprocessor")
    return ModelPackage(model, Preprocessor(prepared, facts["slots"], facts["preprocessing"]), facts)


def load_packages(spark: SparkSession, folder: str) -> dict[str, ModelPackage]:
    """All packages directly below a folder, by folder name."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory())
    return {n: load_package(spark, f"{folder.rstrip('/')}/{n}") for n in names}


def comparison_report(spark: SparkSession, results: dict) -> DataFrame:
    """Result table with the best parameters as text ('Default' when not tuned)."""
    from .training import results_table

    texts = [
        (r.name, ", ".join(f"{k}={v}" for k, v in sorted(r.best_params.items())) or "Default") for r in results.values()
    ]
    named = spark.createDataFrame(texts, "model string, best_params string")
    return results_table(spark, results).join(named, "model")


def analysis_facts(
    df: DataFrame, target: str | None = None, kind: str = "classification", predictions: DataFrame | None = None,
    exclude: list[str] | tuple[str, ...] = (),
) -> DataFrame:
    """Report rows ``section, item, value``: shape, gaps, copies, imbalance, model scores, recommendations.

    ``predictions`` is a long table ``model, label, prediction``.
    """
    from .metrics import regression_metrics

    def rows(one: DataFrame, section: str, items: list[str]) -> DataFrame:
        return one.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(i).alias("item"), F.col(i).cast("double").alias("value"))
            for i in items
        ])))

    shape = overview(df)
    copies = duplicate_count(df, exclude)
    n_rows = shape.select("n_rows").first()[0]
    copies = copies.withColumn("duplicate_pct", percent(F.col("duplicate_rows"), F.lit(n_rows)))
    out = rows(shape, "overview", ["n_rows", "n_columns", "missing_cells", "missing_pct"])
    out = out.unionByName(rows(copies, "overview", ["duplicate_rows", "duplicate_pct"]))
    if target is not None and kind == "classification":
        balance = class_imbalance(df, target).select(F.col("ratio").alias("imbalance_ratio"), F.col("is_imbalanced").cast("int").alias("is_imbalanced"))
        out = out.unionByName(rows(balance, "target", ["imbalance_ratio", "is_imbalanced"]))
    if predictions is not None:
        if kind == "classification":
            scores = classification_metrics(predictions, "label", "prediction", ["model"]).select("model", F.col("f1").alias("value"))
        else:
            scores = regression_metrics(predictions, "label", "prediction", ["model"]).select("model", F.col("r2").alias("value"))
        out = out.unionByName(scores.select(F.lit("models").alias("section"), F.col("model").alias("item"), "value"))
    # A few rows, read again by the rules below: computed once.
    out = cut_lineage(out)
    best_below = F1_BELOW if kind == "classification" else R2_BELOW
    rules = [
        ("handle missing values", (F.col("item") == "missing_pct") & (F.col("value") > MISSING_ABOVE)),
        ("remove duplicates", (F.col("item") == "duplicate_rows") & (F.col("value") > 0)),
        ("balance classes", (F.col("item") == "is_imbalanced") & (F.col("value") == 1)),
    ]
    advice = F.array(*[
        F.struct(F.lit("recommendation").alias("section"), F.lit(text).alias("item"), F.when(rule, 1.0).alias("value"))
        for text, rule in rules
    ])
    extra = out.where("section <> 'models'").select(F.inline(advice)).where("value is not null")
    if predictions is not None:
        best = out.where("section = 'models'").agg(F.max("value").alias("b"))
        extra = extra.unionByName(best.where(F.col("b") < best_below).select(
            F.lit("recommendation").alias("section"), F.lit("improve models").alias("item"), F.lit(1.0).alias("value")))
    return out.unionByName(extra)
