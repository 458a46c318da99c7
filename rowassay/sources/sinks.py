"""Writers for cleaned tables, audits, variants, manifests, facts and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay.sources.scan import STORED_SCHEMA


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_audit(audit: DataFrame, path: str) -> None:
    """The cleaning trail, a handful of rows, as one JSON file."""
    audit.coalesce(1).write.mode("overwrite").json(path)


def write_variants(variants: DataFrame | list[DataFrame], labels: DataFrame, root: str) -> None:
    """Corrupted tables (in one frame, or in several, each of other variants) and their labels, one partition per variant.

    Both have the variant's identity in ``table_id``, ``variant_type``, ``variant_rate`` and
    ``variant_seed``; labels keep their own type, rate and seed as ``label_type``, ``label_rate`` and
    ``label_seed``. Variants already under ``root`` stay, unless they are written again.
    """
    keys = {"variant_type": "error_type", "variant_rate": "rate", "variant_seed": "seed"}
    own = {c: f"label_{c.removeprefix('error_')}" for c in ("error_type", "rate", "seed")}
    frames = [("data", frame) for frame in (variants if isinstance(variants, list) else [variants])]
    for name, frame in [*frames, ("labels", labels.withColumnsRenamed(own))]:
        writer = frame.withColumnsRenamed(keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("table_id", *keys.values()).parquet(f"{root}/{name}")


def manifest_of(variants: DataFrame, root: str) -> DataFrame:
    """Manifest lines for variants given as (table_id, error_type, rate, seed) and, where known, how they are stored."""
    # Spark's own name for the partition of a missing value: a mix has no single rate.
    rate = F.coalesce(F.col("rate").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    part = F.concat(
        F.lit("table_id="), F.col("table_id"),
        F.lit("/error_type="), F.col("error_type"),
        F.lit("/rate="), rate,
        F.lit("/seed="), F.col("seed").cast("string"),
    )
    about = [
        F.col(f.name) if f.name in variants.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(STORED_SCHEMA)
    ]
    return variants.select(
        "table_id", "error_type", "rate", F.col("seed").cast("bigint").alias("seed"),
        F.concat(F.lit(f"{root}/data/"), part).alias("data_path"),
        F.concat(F.lit(f"{root}/labels/"), part).alias("labels_path"),
        *about,
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_results(facts: DataFrame, root: str) -> None:
    """Metric facts, as parquet and as CSV."""
    facts.write.mode("overwrite").parquet(f"{root}/facts.parquet")
    facts.coalesce(1).write.mode("overwrite").csv(f"{root}/facts.csv", header=True)


def write_report(tables: dict[str, DataFrame], root: str) -> None:
    """Each report table (tens of rows) as one CSV file."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").csv(f"{root}/{name}.csv", header=True)


def write_suite_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").parquet(path)
