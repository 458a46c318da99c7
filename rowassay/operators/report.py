"""Summary tables over the metric facts. Undefined values are NULL, so averages skip them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Which metrics and conditions the tables show, in this order.
MODEL_METRICS = ["executability", "fp_rate_rules", "fp_rate_rows", "suite_size", "redundancy"]
OVERALL_METRICS = ["precision", "recall", "f1"]
CONDITIONS = ["a", "b", "c"]
GENERATED = "llm:"


def table_executability(facts: DataFrame) -> DataFrame:
    """Model by metric."""
    chosen = facts.filter(F.col("metric").isin(MODEL_METRICS))
    return chosen.groupBy("model").pivot("metric", MODEL_METRICS).agg(F.avg("value"))


def table_recall_by_type(facts: DataFrame, methods: list[str]) -> DataFrame:
    """Error type by method."""
    chosen = facts.filter(F.col("metric") == "recall_by_type")
    return chosen.groupBy("error_type").pivot("method", methods).agg(F.avg("value"))


def table_overall(facts: DataFrame) -> DataFrame:
    """Method by precision, recall, F1; mixed variants are left out."""
    chosen = facts.filter(F.col("metric").isin(OVERALL_METRICS) & (F.col("error_type") != "mixed"))
    return chosen.groupBy("method").pivot("metric", OVERALL_METRICS).agg(F.avg("value"))


def table_condition(facts: DataFrame) -> DataFrame:
    """Prompt condition by executability and recall, generated suites only."""
    chosen = facts.filter(F.col("method").startswith(GENERATED) & F.col("condition").isin(CONDITIONS))
    return (
        chosen.groupBy("condition").agg(
            F.avg(F.when(F.col("metric") == "executability", F.col("value"))).alias("executability"),
            F.avg(F.when(F.col("metric") == "recall_by_type", F.col("value"))).alias("recall"),
        )
        .filter("executability is not null or recall is not null")
        .orderBy("condition")
    )


def rank_models(facts: DataFrame) -> DataFrame:
    """Models by mean executability, best first."""
    chosen = facts.filter(F.col("metric") == "executability")
    return (
        chosen.groupBy("model").agg(F.avg("value").alias("executability"))
        .orderBy(F.desc("executability"), "model")
    )


def method_names(facts: DataFrame) -> list[str]:
    """Methods that have per-type recall: as many as there were suites."""
    chosen = facts.filter(F.col("metric") == "recall_by_type").select("method").distinct()
    return sorted(r["method"] for r in chosen.collect())


def report_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """All summary tables, by file name."""
    return {
        "executability_by_model": table_executability(facts),
        "recall_by_error_type": table_recall_by_type(facts, method_names(facts)),
        "detection_overall": table_overall(facts),
        "condition_comparison": table_condition(facts),
        "models_by_executability": rank_models(facts),
    }
