"""Scores of a suite, all NULL where a denominator is empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowassay import ROW_ID

FACT_COLUMNS = [
    "model", "dataset", "condition", "repetition", "method", "error_type", "rate", "seed", "metric", "value",
]
OVERALL = "overall"


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def f1_score(precision: Column, recall: Column) -> Column:
    """Undefined when either side is; 0 when both are 0."""
    both = precision + recall
    return F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(2 * precision * recall, both))


def executability(counts: DataFrame, runtime_errors: DataFrame, by: list[str]) -> DataFrame:
    """(valid - runtime errors) / all rules, from per-status counts and ``n_runtime_errors``."""
    total = sum((F.col(s) for s in ("json_error", "unknown_expectation", "invalid_kwargs")), F.col("valid"))
    joined = counts.join(runtime_errors, by, "left").na.fill(0, ["n_runtime_errors"])
    return joined.select(*by, ratio(F.col("valid") - F.col("n_runtime_errors"), total).alias("executability"))


def rule_false_positive_rate(outcomes: DataFrame) -> DataFrame:
    """Failed rules over all rules, those that could not run included."""
    failed = F.count_if(F.coalesce(~F.col("success"), F.lit(False)))
    return outcomes.agg(ratio(failed, F.count("*")).alias("fp_rate_rules"))


def row_false_positive_rate(clean: DataFrame, flagged: DataFrame) -> DataFrame:
    """Flagged rows over rows of a clean table."""
    rows = clean.agg(F.count("*").alias("_n")).select(F.struct("_n", F.lit(0).cast("bigint").alias("_f")).alias("_c"))
    hits = flagged.select(ROW_ID).distinct().agg(F.count("*").alias("_f"))
    both = rows.unionByName(hits.select(F.struct(F.lit(0).cast("bigint").alias("_n"), "_f").alias("_c")))
    return both.agg(ratio(F.sum("_c._f"), F.sum("_c._n")).alias("fp_rate_rows"))


def labels_in(labels: DataFrame, rows: DataFrame) -> DataFrame:
    """Labels of rows that are (still) in the table."""
    return labels.join(rows.select(ROW_ID), ROW_ID, "left_semi")


def true_positives(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids that are both flagged and labelled."""
    return flagged.select(ROW_ID).distinct().join(labels.select(ROW_ID), ROW_ID, "left_semi")


def detection_scores(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Precision, recall and F1 over sets of row ids, as one row."""
    f = flagged.select(ROW_ID, F.lit(True).alias("_f"), F.lit(False).alias("_l"))
    l = labels.select(ROW_ID, F.lit(False).alias("_f"), F.lit(True).alias("_l"))  # noqa: E741
    sides = f.unionByName(l).groupBy(ROW_ID).agg(F.bool_or("_f").alias("_f"), F.bool_or("_l").alias("_l"))
    counts = sides.agg(
        F.count_if("_f").alias("n_flagged"), F.count_if("_l").alias("n_injected"),
        F.count_if(F.col("_f") & F.col("_l")).alias("true_positives"),
    )
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    """Add precision, recall, f1 to ``n_flagged, n_injected, true_positives``."""
    scored = counts.withColumns({
        "precision": ratio(F.col("true_positives"), F.col("n_flagged")),
        "recall": ratio(F.col("true_positives"), F.col("n_injected")),
    })
    return scored.withColumn("f1", f1_score(F.col("precision"), F.col("recall")))


def recall_by_type(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Per error type: share of its labelled rows that are flagged."""
    wanted = labels.select("error_type", ROW_ID).distinct()
    hit = flagged.select(F.col(ROW_ID).alias("_f")).distinct()
    joined = wanted.join(hit, F.col(ROW_ID) == F.col("_f"), "left")
    return joined.groupBy("error_type").agg(
        F.count("*").alias("n_injected"), F.count("_f").alias("n_found"),
        ratio(F.count("_f"), F.count("*")).alias("recall"),
    )


def suite_size(outcomes: DataFrame) -> DataFrame:
    """Rules evaluated, those that could not run included."""
    return outcomes.agg(F.count("*").alias("suite_size"))


def redundancy(rules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rules that repeat another one exactly: same type, same arguments in any order.

    Rules are dealt out before they are counted, as most differ: a task that read them would hold all that its part of the
    input says. A rule that many parts of the input have goes to several tasks.
    """
    by = by or []
    spread = rules.repartition(*by, "expectation_type", "kwargs", F.spark_partition_id() % 32)
    return spread.groupBy(*by).agg(
        (F.count("*") - F.count_distinct("expectation_type", "kwargs")).alias("redundancy")
    )


def long_facts(wide: DataFrame, metrics: list[str]) -> DataFrame:
    """Wide scores to tidy facts, one row per metric; absent dimensions are NULL."""
    dims = FACT_COLUMNS[:-2]
    defaults = {
        "model": F.lit(None).cast("string"), "dataset": F.lit(None).cast("string"),
        "condition": F.lit(None).cast("string"), "repetition": F.lit(None).cast("int"),
        "method": F.lit(None).cast("string"), "error_type": F.lit(OVERALL),
        "rate": F.lit(None).cast("double"), "seed": F.lit(None).cast("bigint"),
    }
    typed = wide.select(
        *[F.col(d) if d in wide.columns else defaults[d].alias(d) for d in dims],
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    return typed.unpivot(dims, metrics, "metric", "value")
