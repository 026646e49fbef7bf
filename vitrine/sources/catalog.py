"""Sources and sinks: tolerant and strict JSON-lines scans, aligned vectors, manifests, ordered and resumable writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATALOG = (
    "parent_asin string, title string, features array<string>, description array<string>, price string, categories array<string>, "
    "details map<string,string>, average_rating double, rating_number bigint, store string"
)
ATTRIBUTES = ("brand", "category", "color", "material", "style", "feature", "use_case")


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that parse; bad JSON, non-objects and a missing file are skipped."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.withColumn("_ok", F.col("_corrupt_record").isNull()).where("_ok").drop("_ok", "_corrupt_record")


def strict_jsonl(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Fails on bad JSON; with a key also on missing or repeated ones (checked when read)."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if key is None else unique_key(rows, key)


def unique_key(rows: DataFrame, key: str) -> DataFrame:
    """The rows; reading them fails if a key is null, blank or repeated."""
    n = F.count("*").over(Window.partitionBy(key))
    bad = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "") | (n > 1)
    return rows.withColumn("_bad", bad).where(F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("bad key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit(True)).cast("boolean")).drop("_bad")


def with_order(rows: DataFrame, order_by: str) -> DataFrame:
    """Adds the persisted catalog order."""
    return rows.withColumn("catalog_order", F.row_number().over(Window.orderBy(order_by)) - 1)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(conf).exists(h):
            return p
    return None


def successful(annotations: DataFrame) -> DataFrame:
    """Annotation rows without a status or with success."""
    return annotations.where("annotation.status is null or lower(annotation.status) = 'success'")


def skip_reasons(rows: DataFrame) -> DataFrame:
    """(parent_asin, facts) -> rows with a skip_reason, null where the row is good."""
    return rows.withColumn(
        "skip_reason",
        F.when(F.col("parent_asin").isNull() | (F.trim("parent_asin") == ""), "missing_id").when(F.col("facts").isNull(), "missing_facts"),
    )


def resume_state(done: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed keys, and the greatest attempt of each failed key."""
    return done.select("parent_asin").distinct(), failed.groupBy("parent_asin").agg(F.max("attempt").alias("attempt"))


def annotate(catalog: DataFrame, done: DataFrame, call: Callable[[str], str], retries: int = 2) -> DataFrame:
    """Calls an injected model for the rows that are not done: parent_asin, result, error, attempt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, prompt in zip(b["parent_asin"], b["prompt"]):
                result = error = None
                for attempt in range(1, retries + 2):
                    try:
                        result, error = call(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001  the failure is a row of the failure log
                        error = str(e)
                out.append((key, result, error, attempt))
            yield pd.DataFrame(out, columns=["parent_asin", "result", "error", "attempt"])

    todo = catalog.join(done.select("parent_asin"), "parent_asin", "left_anti")
    return todo.select("parent_asin", "prompt").mapInPandas(run, "parent_asin string, result string, error string, attempt int")


def aligned_vectors(rows: DataFrame, dimension: int, tolerance: float = 1e-3) -> DataFrame:
    """Checks of an embedding table as one row: rows, wrong sizes, non-finite values, non-unit present rows, non-zero absent rows."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.withColumn("norm", norm).agg(
        F.count("*").alias("rows"),
        F.count_if(F.size("embedding") != dimension).alias("wrong_size"),
        F.count_if(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite"),
        F.count_if(F.col("present") & (F.abs(F.col("norm") - 1) > tolerance)).alias("not_unit"),
        F.count_if(~F.col("present") & (F.col("norm") > 0)).alias("not_zero"),
    )


def write_in_order(rows: DataFrame, catalog: DataFrame, path: str) -> None:
    """Keys of the catalog only, in catalog order."""
    rows.join(catalog.select("parent_asin", "catalog_order"), "parent_asin").orderBy("catalog_order").drop("catalog_order").write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, schema: str) -> None:
    """Appends the rows whose key is not there yet, so that a repeated run changes nothing."""
    have = tolerant_jsonl(rows.sparkSession, path, schema)
    rows.join(have.select("parent_asin"), "parent_asin", "left_anti").write.mode("append").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Content hash and size of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
