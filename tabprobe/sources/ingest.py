"""Sources and sinks.

CSV is read as text, NA tokens become NULL *before* typing (Spark's inference
would keep a column holding ``NA`` as string), and each column's type is then
picked by ``try_cast`` success counts in one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabprobe.functions.columns import c, is_string

# fixed values: pandas' default NA tokens, and the id column names the reference looks for
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ID_CANDIDATES = ["id", "ID", "Id", "row_id", "PassengerId"]
CLASSIFICATION_MAX_DISTINCT = 10
DATETIME_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"


#: A number as CSV readers take it: no type suffixes (``1d``, ``2f``), which a cast would accept.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"

def _parses(v):
    return F.coalesce(v.rlike(DATETIME_PATTERN) & F.try_to_timestamp(v).isNotNull(), F.lit(False))


def infer_types(text: DataFrame) -> DataFrame:
    """Cast string columns to bigint / double / boolean / timestamp when every non-null value converts."""
    cols = [f.name for f in text.schema.fields if is_string(f.dataType)]
    if not cols:
        return text
    aggs = []
    for i, x in enumerate(cols):
        v = c(x)
        aggs += [F.count(v).alias(f"n{i}"), F.count(v.try_cast("bigint")).alias(f"i{i}"),
                 F.count(F.when(v.rlike(NUMBER), v.try_cast("double"))).alias(f"d{i}"),
                 F.count_if(v.isin("True", "False", "true", "false")).alias(f"b{i}"),
                 F.count_if(_parses(v)).alias(f"t{i}")]
    r = text.agg(*aggs).first()
    exprs = {}
    for i, x in enumerate(cols):
        n = r[f"n{i}"]
        if n == 0:
            continue
        if r[f"i{i}"] == n:
            exprs[x] = c(x).try_cast("bigint")
        elif r[f"d{i}"] == n:
            exprs[x] = c(x).try_cast("double")
        elif r[f"b{i}"] == n:
            exprs[x] = F.lower(c(x)) == "true"
        elif r[f"t{i}"] == n:
            exprs[x] = F.try_to_timestamp(c(x))
    return text.withColumns(exprs) if exprs else text


def read_table(spark: SparkSession, path: str, fmt: str = "csv") -> tuple[DataFrame | None, str | None]:
    """A1: load a table; a failure is returned as a message, not raised."""
    try:
        if fmt == "parquet":
            return spark.read.parquet(path), None
        text = spark.read.option("header", True).option("inferSchema", False).csv(path)
        na = {x: F.when(c(x).isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c(x)) for x in text.columns}
        return infer_types(text.withColumns(na)), None
    except Exception as e:  # noqa: BLE001 — reported to the caller
        return None, f"Failed to load dataset: {e}".splitlines()[0]


def preview_columns(spark: SparkSession, path: str) -> list[str]:
    """A2: column names from the header and the first rows only."""
    return spark.read.option("header", True).csv(path).limit(5).columns


def detect_problem_type(df: DataFrame, target: str) -> str:
    """A3: classification for a string target or one with < 10 distinct values, else regression."""
    if is_string(df.schema[target].dataType):
        return "classification"
    n = df.select(F.countDistinct(c(target))).first()[0]
    return "classification" if n < CLASSIFICATION_MAX_DISTINCT else "regression"


def parse_datetimes(df: DataFrame) -> DataFrame:
    """A4: a string column becomes a timestamp when all its non-null values parse (one aggregation)."""
    cols = [f.name for f in df.schema.fields if is_string(f.dataType)]
    if not cols:
        return df
    r = df.agg(*[F.count_if(c(x).isNotNull() & ~_parses(c(x))).alias(f"bad{i}") for i, x in enumerate(cols)],
               *[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(cols)]).first()
    conv = {x: F.try_to_timestamp(c(x)) for i, x in enumerate(cols) if r[f"bad{i}"] == 0 and r[f"n{i}"] > 0}
    return df.withColumns(conv) if conv else df


def validate_target(df: DataFrame, target: str) -> None:
    """A5: raise with the available columns when the target is missing."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' not found in dataset. Available: {list(df.columns)}")


def call_log_usage(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines call logs (agent, model, timestamp, usage{prompt,completion,total}) → totals by agent/model/day."""
    logs = spark.read.json(path)
    u = F.col("usage")
    return logs.groupBy("agent", "model", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("calls"), F.sum(u["prompt_tokens"]).alias("prompt_tokens"),
        F.sum(u["completion_tokens"]).alias("completion_tokens"), F.sum(u["total_tokens"]).alias("total_tokens"))


def id_column(df: DataFrame, key: Sequence[str] | None = None) -> str | None:
    for x in ID_CANDIDATES:
        if x in df.columns:
            return x
    return key[0] if key else None


def write_predictions(df: DataFrame, path: str, key: Sequence[str] | None = None, fmt: str = "csv") -> str:
    """Write id + prediction; the id is the first known id column, else the caller's key."""
    ident = id_column(df, key)
    if ident is None:
        raise ValueError("no id column: pass the key that identifies a row")
    out = df.select(c(ident).alias(ident), "prediction")
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path
