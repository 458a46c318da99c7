"""Readers: parquet tables, rule files, manifests, metric facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a variant is stored: whole, or as the rows it changes and adds (then with the place of the clean table); its columns, as
# JSON of their schema; rows of the variant, rows stored, labels.
STORED_SCHEMA = "storage string, clean_path string, schema string, n_rows bigint, n_stored bigint, n_labels bigint"
MANIFEST_SCHEMA = (
    f"table_id string, error_type string, rate double, seed bigint, data_path string, labels_path string, {STORED_SCHEMA}"
)
RULE_SCHEMA = "expectation_type string, kwargs string, rationale string"


def _normalized(field: T.StructField) -> Column | None:
    """Replacement for a column whose type or missing marker differs from the internal one."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DecimalType):
        return c.cast("double")
    if isinstance(field.dataType, T.DateType):
        return c.cast("timestamp_ntz")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None).cast(field.dataType))
    return None


def normalize_types(df: DataFrame) -> DataFrame:
    """Decimals to double, dates to timestamps, NaN to NULL."""
    changed = {f.name: e for f in df.schema if (e := _normalized(f)) is not None}
    return df.withColumns(changed) if changed else df


def type_changes(df: DataFrame) -> list[tuple[str, str, str]]:
    """Columns that ``normalize_types`` casts: (column, type before, type after)."""
    after = normalize_types(df).schema
    return [
        (f.name, f.dataType.simpleString(), after[f.name].dataType.simpleString())
        for f in df.schema
        if f.dataType != after[f.name].dataType
    ]


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    return normalize_types(spark.read.parquet(path))


def scan_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: scan_table(spark, path) for name, path in paths.items()}


def scan_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule file: one JSON array of rule objects; kwargs stay JSON text."""
    return spark.read.schema(RULE_SCHEMA).json(path, multiLine=True)


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of written variants; a missing one reads as empty."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Metric facts written by an earlier run; a missing path is an error."""
    return spark.read.parquet(path)
