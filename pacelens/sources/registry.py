"""A versioned store of fitted models under one folder, for later sessions.

A version is a folder of its own: coefficient tables as Parquet, tree pipelines as
Spark saves them.  It counts only once a row in the ``published`` table names it, and
that row is written last, so a reader never sees half a version and a writer that
dies leaves nothing but an unnamed folder.  Two writers get folders of their own; of
equal version numbers the later name counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLISHED = "version long, name string, pipelines array<string>"


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """(version, name, pipelines) of every published version."""
    try:
        return spark.read.schema(PUBLISHED).parquet(f"{folder}/published")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], PUBLISHED)


def publish(coefficients: DataFrame, folder: str, pipelines: Mapping[str, PipelineModel] | None = None) -> int:
    """Store models as the next version and name it; gives its number."""
    spark, pipelines = coefficients.sparkSession, dict(pipelines or {})
    number = (versions(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    name = f"{number:08d}-{uuid.uuid4().hex}"
    coefficients.write.parquet(f"{folder}/{name}/coefficients")
    for kind, fitted in pipelines.items():
        fitted.write().save(f"{folder}/{name}/pipelines/{kind}")
    spark.createDataFrame([(number, name, sorted(pipelines))], PUBLISHED).coalesce(1).write.mode("append").parquet(f"{folder}/published")
    return number


def _named(spark: SparkSession, folder: str, version: int | None) -> str:
    known = versions(spark, folder)
    known = known if version is None else known.where(F.col("version") == version)
    found = known.agg(F.max(F.struct("version", "name"))["name"]).first()[0]
    if found is None:
        raise LookupError(f"no version {version or ''} published under {folder}")
    return found


def load(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The coefficient table of a version; None: the latest."""
    return spark.read.parquet(f"{folder}/{_named(spark, folder, version)}/coefficients")


def load_pipeline(spark: SparkSession, folder: str, kind: str, version: int | None = None) -> PipelineModel:
    """A stored tree pipeline."""
    return PipelineModel.load(f"{folder}/{_named(spark, folder, version)}/pipelines/{kind}")
