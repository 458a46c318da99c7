"""Dense row ids without funnelling the table through one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay import ROW_ID
from rowassay.session import materialize

_LOW_BITS = 33  # monotonically_increasing_id(): partition above these bits, position below


_PREFIX = 32  # characters of a text that may be a range key
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def _range_keys(df: DataFrame, keys: list[str]) -> list[Column]:
    """Narrow columns that order rows as ``keys`` do, as far as they tell them apart."""
    texts = [c for c in keys if isinstance(df.schema[c].dataType, T.StringType)]
    longest = df.agg(*[F.max(F.char_length(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(texts)]).first() if texts else []
    long = {c for c, n in zip(texts, longest) if (n or 0) > _PREFIX}
    bounds: list[Column] = []
    for c in keys:
        if c in long:
            return [*bounds, F.substring(f"`{c}`", 1, _PREFIX)]
        if isinstance(df.schema[c].dataType, _NESTED) and bounds:
            return bounds
        bounds.append(F.col(f"`{c}`"))
    return [*bounds, F.col("_tie")]


def add_row_ids(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Fresh ids 0..N-1 in the order of ``order_by`` (then all other columns), as first column.

    The table is range-partitioned and sorted in parallel and written once, its only shuffle; the id of a row is
    its position in its own partition plus the sizes of the partitions before it. Identical rows are
    told apart by their place in the input, so a large group of copies spreads over partitions;
    for that the input should be a scan (or a written table), whose row order is repeatable.

    Spark samples range keys to the driver, so they are narrow: up to the first column, in that order,
    that is nested or holds long text; of such a text its beginning still counts.
    """
    first = list(order_by or [])
    keys = first + [c for c in df.columns if c not in first]
    bounds = _range_keys(df, keys)
    ordered = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*bounds)
        .sortWithinPartitions(*[F.col(f"`{c}`") for c in keys], "_tie")
        .drop("_tie")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    written = materialize(ordered, "ordered").withColumns({
        "_part": F.shiftright("_place", _LOW_BITS),
        "_pos": F.col("_place").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)),
    })
    # One row per partition: bounded by the number of tasks, not by the data. The starts are a literal of the projection: a
    # join would shuffle and sort the whole table again, by as few keys as there are partitions.
    sizes = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()}
    starts = list(accumulate([0] + [sizes.get(part, 0) for part in range(max(sizes, default=-1) + 1)]))
    start = F.element_at(F.array(*[F.lit(n) for n in starts]).cast("array<bigint>"), (F.col("_part") + 1).cast("int"))
    return written.select((start + F.col("_pos")).alias(ROW_ID), *df.columns)
