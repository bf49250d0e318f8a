"""Apply a fitted FeatureModel to a file stream (Structured Streaming).

``FeatureModel.transform`` is stateless (projections plus stream-static left
joins against broadcast encoder tables), so it runs unchanged on a streaming
DataFrame. Output goes to a parquet sink under ``spark.checkpoint.dir`` with
its own checkpoint location, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabprobe.operators.features import FeatureModel
from tabprobe.session import ensure_checkpoint_dir


def apply_model_stream(spark: SparkSession, model: FeatureModel, stream: DataFrame, name: str | None = None) -> DataFrame:
    """Run the model over everything available in ``stream`` (availableNow trigger); return the written rows."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{name or uuid.uuid4().hex}"
    out = model.transform(stream)
    q = (out.writeStream.format("parquet").option("path", f"{base}/data")
         .option("checkpointLocation", f"{base}/_checkpoint").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/data")


def file_stream(spark: SparkSession, directory: str, file_glob: str, schema) -> DataFrame:
    """A parquet file stream over the files of ``directory`` matching ``file_glob``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", 1).parquet(directory))
